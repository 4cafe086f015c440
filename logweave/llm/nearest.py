"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, split in two until each part holds at most ``LIST_SIZE`` times the
sampling rate of vectors; a split always halves its part, so lists stay balanced where the sample is dense.
Every vector goes to the list of its nearest centroid, and boundary vectors also to lists whose centroid
is nearly as near (``REPLICATE``, ``COPIES``). Centroids are searched through an in-memory graph of each
one's nearest centroids. A query first searches the ``LEAST`` nearest lists, then all others whose centroid is within
``RATIO`` times the distance of the nearest; the graph search widens until it has passed that distance. The first
lists give the score of the k-th best so far, below which the others return nothing; a list returns one row for a
query, its k best, however many vectors tie.

Equal vectors are one entry that keeps its smallest ids: one more than are asked for, as no other can be
among the nearest. A list that holds more than ``BLOCK`` entries is dealt to several blocks, and its queries
go to each, so no task gathers a large list. Nothing is capped. Scores are cosines in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows with a null id; vectors of each length are searched among themselves; a
repeated id with different vectors is listed once for each, the best score counts; fewer candidates than
asked give fewer rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import hash_share, keep

#: The sample that centroids are fitted on: at most so many vectors, and so many floats.
SAMPLE_ROWS, SAMPLE_FLOATS = 65_536, 16_000_000
LIST_SIZE = 128
#: Centroids at most; beyond that lists grow and are dealt in blocks.
MAX_LISTS = 16_384
BLOCK = 4096
#: A vector is also put into lists whose centroid is within REPLICATE times its nearest distance, COPIES in all.
REPLICATE, COPIES = 1.01, 3
#: Measured recall of the five nearest on 51,282 vectors of 64 dimensions: see the README.
RATIO, LEAST = 1.16, 8
DEGREE, BEAM = 24, 32


def split(vectors: np.ndarray, most: int) -> list[np.ndarray]:
    """Centroids of parts of at most ``most`` vectors: each part is halved along its two-means axis."""
    rng, done, todo = np.random.default_rng(5), [], [np.arange(len(vectors))]
    while todo:
        own = todo.pop()
        x = vectors[own]
        if len(own) <= most:
            done.append(x.mean(0))
            continue
        a, b = x[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            order = np.argsort(x @ (a - b), kind="stable")
            left, right = order[: len(own) // 2], order[len(own) // 2 :]
            a, b = x[left].mean(0), x[right].mean(0)
        todo += [own[left], own[right]]
    return done


class Graph:
    """Centroids, each with its nearest ones and a few far ones, searched greedily from fixed entries."""

    def __init__(self, centroids: np.ndarray):
        self.points, n = centroids, len(centroids)
        rng, near = np.random.default_rng(7), []
        for a in range(0, n, 1024):
            d = self.distances(centroids[a : a + 1024])
            near.append(np.argsort(d, 1, kind="stable")[:, : DEGREE + 1])
        far = rng.integers(0, n, (n, 4))
        self.links = np.hstack([np.vstack(near), far])
        self.entries = np.unique(rng.integers(0, n, 64))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(1)[:, None] + (self.points**2).sum(1)[None] - 2 * x @ self.points.T, 0)

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of about the ``beam`` nearest centroids of each row, nearest first; -1: none."""
        beam = min(beam, len(self.points))
        best = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        reach, before = None, None
        while True:
            both = np.sort(best if reach is None else np.hstack([best, reach.reshape(len(x), -1)]), 1)
            repeated = np.hstack([np.zeros((len(x), 1), bool), both[:, 1:] == both[:, :-1]])
            d = (x**2).sum(1)[:, None] + (self.points[both] ** 2).sum(2) - 2 * np.einsum("ijk,ik->ij", self.points[both], x)
            d = np.where(repeated, np.inf, np.maximum(d, 0))
            order = np.argsort(d, 1, kind="stable")[:, :beam]
            best, d = np.take_along_axis(both, order, 1), np.take_along_axis(d, order, 1)
            if before is not None and before.shape == best.shape and (before == best).all():
                return np.where(np.isfinite(d), best, -1), d
            before, reach = best, self.links[best[:, : max(8, beam // 4)]]


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """vec array<double>, ids: the k + 1 smallest ids of each distinct vector, in order."""
    x = F.col("vec")
    good = F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False)) & F.exists(x, lambda v: v != 0)
    valid = vectors.where("id is not null and vec is not null").where(good)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = [np.asarray(v, np.float64).tobytes() for v in batch["vec"]]
            batch = batch.assign(key=key).drop_duplicates(["key", "id"]).sort_values("id")
            yield batch[batch.groupby("key").cumcount() <= k][["id", "vec"]]

    few = valid.select("id", "vec").mapInPandas(least, "id long, vec array<double>")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    salted = few.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    return salted.groupBy("vec").agg(smallest.alias("ids")).withColumn("entry", F.element_at("ids", 1))


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def lists_of(graph: Graph, x: np.ndarray, ratio: float, copies: int | None = None, least: int = 1) -> Iterator[tuple[int, list[int]]]:
    """Row and its lists: within ``ratio`` times the nearest distance, ``least`` at any rate; copies: at most so many."""
    todo, beam = np.arange(len(x)), BEAM
    while len(todo):
        wider = []
        for a in range(0, len(todo), max(1, 8192 // beam)):
            rows = todo[a : a + max(1, 8192 // beam)]
            found, d = graph.search(x[rows], beam)
            within = (d <= np.maximum(d[:, :1], 1e-12) * ratio**2) | (np.arange(d.shape[1]) < least)
            for i, row in enumerate(rows.tolist()):
                if copies is None and within[i, -1] and beam < len(graph.points):
                    wider.append(row)
                else:
                    own = found[i, within[i] & (found[i] >= 0)].tolist()
                    yield row, own if copies is None else own[:copies]
        todo, beam = np.array(wider, int), beam * 4


def best_of(score: np.ndarray, firsts: np.ndarray, ids: list, query: int, k: int, bound: float) -> list[tuple[int, float]]:
    """The k best (id, score) other than the query's own, at ``bound`` or above: by score to twelve digits, then by id."""
    n = min(len(score), k + 2)
    near = np.flatnonzero(score >= max(np.partition(score, -n)[-n], bound) - 1e-12)
    level = np.round(score[near], 12)
    best: list[tuple[float, int, float]] = []
    for i in np.lexsort((firsts[near], -level)).tolist():
        c, away = near[i], -float(level[i])
        if len(best) == k and best[-1][:2] < (away, firsts[c]):
            break
        for v in ids[c]:
            if v != query and all(v != b[1] for b in best):
                bisect.insort(best, (away, int(v), float(score[c])))
        del best[k:]
    return [(v, x) for _, v, x in best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, ratio: float = RATIO) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of ``vectors`` other than its own id.

    Both tables have id long and vec array<double>; a query's vector is compared on its direction only.
    """
    sizes = sorted(r["size"] for r in vectors.where("vec is not null and size(vec) > 0").select(F.size("vec").alias("size")).distinct().collect())
    found = [x for n in sizes if (x := search_length(vectors.where(F.size("vec") == n), queries.where(F.size("vec") == n), n, k, ratio)) is not None]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def search_length(vectors: DataFrame, queries: DataFrame, size: int, k: int, ratio: float) -> DataFrame | None:
    """``search`` among vectors of one length; None if no vector takes part."""
    spark = vectors.sparkSession
    index = keep(entries(vectors, k), "entries")
    total = index.count()
    if not total:
        return None
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_FLOATS // size) / total)
    sample = index.where(hash_share(F.col("entry"), share)).orderBy("entry").select("vec").toPandas()
    points = unit(sample["vec"].tolist() if len(sample) else [r["vec"] for r in index.limit(1).collect()])
    most = max(2, round(max(LIST_SIZE * share, len(points) / MAX_LISTS)))
    graph = spark.sparkContext.broadcast(Graph(np.array(split(points, most))))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, i) for i, own in lists_of(graph.value, unit(batch["vec"].tolist()), REPLICATE, COPIES) for c in own]
            places = [i for _, i in rows]
            yield pd.DataFrame({"list": [c for c, _ in rows], "entry": batch["entry"].to_numpy()[places], "ids": batch["ids"].to_numpy()[places], "vec": batch["vec"].to_numpy()[places]})

    posted = keep(index.mapInPandas(post, "list int, entry long, ids array<long>, vec array<double>"), "posted")
    blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks)  # at most MAX_LISTS rows
    lists = posted.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
    asked = keep(queries.join(index.select("vec"), "vec", "left_semi").select("id", "vec"), "asked")

    def probes(first: bool):
        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                near = lists_of(graph.value, unit(batch["vec"].tolist()), 1.0 if first else ratio, least=LEAST)
                rows = [(c, i) for i, own in near for c in (own[:LEAST] if first else own[LEAST:])]
                places = [i for _, i in rows]
                yield pd.DataFrame({"list": [c for c, _ in rows], "query": batch["id"].to_numpy()[places], "vec": batch["vec"].to_numpy()[places]})

        return probe

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, ids, x, firsts = None, [], [], None, None
        for batch in batches:
            out, keys = [], list(zip(batch["list"], batch["block"]))
            kinds, bounds, i = batch["kind"].to_numpy(), batch["bound"].fillna(-2.0).to_numpy(), 0
            while i < len(batch):
                if keys[i] != at:
                    at, held, ids, x = keys[i], [], [], None
                j = i
                while j < len(batch) and keys[j] == at and kinds[j] == kinds[i]:
                    j += 1
                if not kinds[i]:
                    held += batch["vec"].iloc[i:j].tolist()
                    ids += batch["ids"].iloc[i:j].tolist()
                elif held:
                    if x is None:
                        x, firsts = unit(held), np.array([v[0] for v in ids])
                    for a in range(i, j, 256):
                        score = unit(batch["vec"].iloc[a : min(j, a + 256)].tolist()) @ x.T
                        for r, query in enumerate(batch["query"].iloc[a : min(j, a + 256)]):
                            if best := best_of(score[r], firsts, ids, query, k, bounds[a + r]):
                                out.append((int(query), [v for v, _ in best], [s for _, s in best]))
                i = j
            yield pd.DataFrame(out, columns=["query_id", "vec_ids", "scores"])

    none = F.lit(None)

    def searched(asking: DataFrame) -> DataFrame:
        """query_id and the arrays vec_ids and scores, a row for each query and block of a list."""
        asking = asking.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = lists.select("list", "block", F.lit(0).alias("kind"), none.cast("long").alias("query"), none.cast("double").alias("bound"), "entry", "ids", "vec").unionByName(
            asking.select("list", "block", F.lit(1).alias("kind"), "query", "bound", none.cast("long").alias("entry"), none.cast("array<long>").alias("ids"), "vec")
        )
        both = both.repartition("list", "block").sortWithinPartitions("list", "block", "kind", "entry", "query")
        return both.mapInPandas(compare, "query_id long, vec_ids array<long>, scores array<double>")

    def merged(rows: DataFrame) -> DataFrame:
        """query_id and best, its k best: rounding may differ by the place in a block, a thousandth of a billionth makes a tie."""
        each = rows.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("f")).groupBy("query_id", F.col("f.vec_ids").alias("vec_id")).agg(F.max("f.scores").alias("score"))
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("away"), "vec_id", "score"))), 1, k)
        return each.groupBy("query_id").agg(best.alias("best"))

    first = merged(searched(asked.mapInPandas(probes(True), "list int, query long, vec array<double>").withColumn("bound", none.cast("double"))))
    first = keep(first, "first")
    bound = first.select("query_id", F.when(F.size("best") == k, F.element_at("best", -1)["score"]).alias("bound"))
    more = asked.mapInPandas(probes(False), "list int, query long, vec array<double>").join(bound, F.col("query") == F.col("query_id"), "left")
    so_far = first.select("query_id", F.col("best.vec_id").alias("vec_ids"), F.col("best.score").alias("scores"))
    ranked = merged(so_far.unionByName(searched(more))).select("query_id", F.posexplode("best").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return search(vectors, vectors.where("id % 50 = 0"))
