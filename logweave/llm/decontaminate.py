"""Benchmark decontamination by size-partitioned MinHash containment search.

A document leaks a test item when it holds at least ``containment`` of the item's distinct five-word
shingles. Items are dealt to partitions by the power of two of their size. Each item is sketched by
its smallest hashes, as many as the size partition needs: of an item of n shingles, a leaking document
misses fewer than ``missable(n)`` of them, so it holds at least one of the ``missable(n) + 1`` smallest.
The sketch therefore loses no leak, however long the document (a fixed-length signature of a long
document would: its own minima crowd out those of a short item). Each hit is verified by counting the
item's shingles in the document's whole shingle set.

Items of at most ``block_shingles`` shingles together are one index, which is broadcast: documents are read once and not
shuffled. More items are joined in Spark, sketches by (size partition, hash), with the shingles of documents that pass
a bitmap of fixed size; documents are then told apart by the digest of their text. Either way gives the same rows.

Defined cases: null, empty or word-less documents and items take part in nothing. Items of under five
words are one shingle of all their words. Items of equal text each get their rows, and so do repeated
documents. Rows with a null id take part and carry the null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import forget, keep, shingle_hashes, slices, word_hashes

SHINGLE = 5
CONTAINMENT_PERCENT = 80
BLOCK_SHINGLES = 1_000_000
#: Bits of the bitmap of all items' shingles: 16 MB, whatever the items. Leaking texts that may be broadcast (32 bytes each).
FILTER_BITS, BROADCAST_TEXTS = 1 << 27, 300_000
WORD = re.compile(r"[^\W_]+")

LEAKS = "doc_id long, item_id long, item_shingles long, shared_shingles long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def missable(n: int, percent: int = CONTAINMENT_PERCENT) -> int:
    """Shingles that a leaking document may lack of an item's n."""
    return n - -(-percent * n // 100)


class ItemIndex:
    """The sketches and shingles of one block of items, by shingle length and size partition."""

    def __init__(self, items: list[tuple[int | None, np.ndarray, int]], percent: int):
        self.ids = [i for i, _, _ in items]
        self.sizes = [len(h) for _, h, _ in items]
        self.percent = percent
        self.by_length: dict[int, tuple] = {}
        for length in sorted({k for _, _, k in items}):
            sketch, full = [], []
            for row, (_, hashes, k) in enumerate(items):
                if k == length:
                    partition = len(hashes).bit_length()
                    sketch += [(h, partition) for h in hashes[: missable(len(hashes), percent) + 1].tolist()]
                    full += [(h, row) for h in hashes.tolist()]
            least = {}
            for h, partition in sketch:
                least[h] = min(partition, least.get(h, partition))
            keys = np.array(sorted(least), np.uint64)
            partitions = np.array([least[k] for k in keys.tolist()])
            full.sort()
            self.by_length[length] = keys, partitions, np.array([h for h, _ in full], np.uint64), np.array([r for _, r in full])

    def leaks(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(row of an item, its shingles in the document) for every item that the document leaks."""
        found = []
        for length, (keys, partitions, hashes, rows) in self.by_length.items():
            own = shingle_hashes(words, length)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            # a document too short for the smallest item of a size partition needs no verification there
            if not (hit := keys[at] == own).any() or (2 ** (partitions[at[hit]] - 1) * self.percent > 100 * len(own)).all():
                continue
            own = np.unique(own)
            left, right = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            counts = np.bincount(np.concatenate([rows[a:b] for a, b in zip(left, right) if a < b]))
            found += [(r, int(counts[r])) for r in np.flatnonzero(counts).tolist() if 100 * counts[r] >= self.percent * self.sizes[r]]
        return found


def described(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, k (its shingles' length), hashes (distinct, smallest first) of every item with words."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, item_id, text in zip(batch["item"], batch["item_id"].astype("Int64"), batch["text"]):
                if words := words_of(text):
                    length = min(SHINGLE, len(words))
                    rows.append((item, item_id, length, np.unique(shingle_hashes(word_hashes(words), length)).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item", "item_id", "k", "hashes"]).astype({"item_id": "Int64"})
        forget()

    items = benchmark.where("text is not null").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return keep(items.mapInPandas(describe, "item long, item_id long, k int, hashes array<long>"), "items")


def small_index(items: DataFrame, percent: int, most: int) -> ItemIndex | None:
    """All items as one index, if they have at most ``most`` shingles; an item costs at least one."""
    if items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0] > most:
        return None
    rows = items.select("item_id", "k", "hashes").collect()
    return ItemIndex([(r["item_id"], np.array(r["hashes"], np.int64).view(np.uint64), r["k"]) for r in rows], percent)


def bitmap(shingles: DataFrame) -> np.ndarray:
    """Which remainders of hashes by FILTER_BITS the items' shingles have: a bitmap of fixed size, however many they are."""
    at = F.pmod("h", F.lit(FILTER_BITS))
    parts = shingles.groupBy(F.floor(at / 32_768).cast("long").alias("part")).agg(F.bitmap_construct_agg((at % 32_768).cast("long")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def joined_leaks(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """digest (of a text), item, item_id, item_shingles, shared_shingles of every leak, for any number of items.

    Documents' shingles that no item can have are left out by a bitmap of fixed size. What is left is joined with the items'
    sketches by size partition and hash, and the pairs that meet there with the items' whole shingle sets.
    """
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE of them
    shingles = items.select("item", "k", F.explode("hashes").alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(shingles))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts):
                out = []
                for digest, text in zip(batch["digest"].iloc[a:b], texts[a:b]):
                    words = word_hashes(words_of(text))
                    for k in lengths:
                        own = np.unique(shingle_hashes(words, k))
                        at = (own.view(np.int64) % FILTER_BITS).astype(np.int64)
                        hit = own[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                        if len(hit):
                            out.append(pd.DataFrame({"digest": [digest] * len(hit), "k": k, "h": hit.view(np.int64), "n": len(own)}))
                if out:
                    yield pd.concat(out)
        forget()

    texts = docs.where("text is not null").select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    hits = keep(texts.mapInPandas(search, "digest binary, k int, h long, n long").distinct(), "hits")
    n = F.size("hashes")
    partition = F.ceil(F.log2(n + 1)).cast("int")  # the power of two of the item's size
    spare = n - F.ceil(F.lit(percent) * n / 100)
    sketches = items.select("item", "k", partition.alias("partition"), F.explode(F.slice("hashes", F.lit(1), (spare + 1).cast("int"))).alias("h"))
    long_enough = F.pow(F.lit(2), F.col("partition") - 1) * percent <= F.col("n") * 100
    met = hits.join(sketches, ["k", "h"]).where(long_enough).select("digest", "item").distinct()
    counts = hits.join(shingles, ["k", "h"]).join(met, ["digest", "item"], "left_semi").groupBy("digest", "item").agg(F.count("*").alias("shared_shingles"))
    whole = items.select("item", "item_id", n.cast("long").alias("item_shingles"))
    return keep(counts.join(whole, "item").where(F.col("shared_shingles") * 100 >= F.col("item_shingles") * percent), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows of LEAKS for every document and item of which it holds ``percent`` of the shingles or more."""
    items = described(benchmark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    small = small_index(items, percent, block_shingles)
    if small is None:
        leaks = joined_leaks(texts, items, percent)
        return texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")).join(leaks, "digest").select("doc_id", "item_id", "item_shingles", "shared_shingles")
    index = docs.sparkSession.sparkContext.broadcast(small)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = index.value
        for batch in batches:
            ids, bodies = batch["doc_id"].astype("Int64"), batch["text"].tolist()
            for a, b in slices(bodies):
                rows = [(ids.iloc[i], items.ids[r], items.sizes[r], n) for i in range(a, b) for r, n in items.leaks(word_hashes(words_of(bodies[i])))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_shingles", "shared_shingles"]).astype({"doc_id": "Int64", "item_id": "Int64"})
        forget()

    return texts.mapInPandas(search, LEAKS)


def leaky(index, text: Column) -> Column:
    """Whether a text leaks an item of the broadcast index."""

    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t is not None and bool(index.value.leaks(word_hashes(words_of(t)))) for t in texts], dtype=bool)
        forget()

    return leaks(text)


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` without the rows that leak a test item, all columns kept; null texts stay."""
    items = described(benchmark)
    small = small_index(items, percent, block_shingles)
    if small is not None:
        return docs.where(~leaky(docs.sparkSession.sparkContext.broadcast(small), docs["text"]))
    leaks = keep(joined_leaks(docs, items, percent).select(F.col("digest").alias("leaked")).distinct(), "leaked")
    own = F.unhex(F.sha2(docs["text"], 256))
    return docs.join(F.broadcast(leaks) if leaks.count() <= BROADCAST_TEXTS else leaks, own == leaks["leaked"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The query's rows by plain SQL: every shingle of a document of a length that items have, joined with the items' own.
ORACLE = rf"""
with items as (select row_number() over () as item, item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as words from benchmark where text is not null),
docs as (select row_number() over () as doc, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as words from documents where text is not null),
sized as (select *, least({SHINGLE}, len(words)) as k from items where len(words) > 0),
item_shingles as (select distinct item, item_id, k, array_to_string(words[i:i + k - 1], ' ') as s from (select *, unnest(range(1, len(words) - k + 2)) as i from sized)),
totals as (select item, count(*) as n from item_shingles group by item),
lengths as (select distinct k from sized),
doc_shingles as (select distinct doc, doc_id, k, array_to_string(words[i:i + k - 1], ' ') as s from (select *, unnest(range(1, len(words) - k + 2)) as i from docs cross join lengths)),
shared as (select d.doc, d.doc_id, i.item, i.item_id, count(*) as k from doc_shingles d join item_shingles i on d.k = i.k and d.s = i.s group by all)
select doc_id, item_id, n as item_shingles, k as shared_shingles from shared join totals using (item) where 100 * k >= {CONTAINMENT_PERCENT} * n
"""
