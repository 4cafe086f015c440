"""Exact Jaccard join of documents' word shingles in metric space, and its connected components.

Distance is 1 - Jaccard; documents link at distance ``r`` = 1 - percent/100 or less. Documents with equal
sets are one node. Nothing is sampled, capped or approximated.

Regions. Unrelated documents are all at about distance 1 from one another, so single documents as pivots
cannot part a whole corpus. The first regions therefore form around shared pieces of content: sizes fall into
rings, a ring's hash space is cut into parts, a third more than the elements that a linked pair's sets can
differ in, so a linked pair agrees on the rest and meets in their regions. A document near its ring's upper edge is
replicated to the next ring, where larger partners are: the window that the triangle inequality gives for
distances to the empty set. Of the regions that a set can spare it leaves out the most populated ones. In each region
the least node is the pivot; every member is compared with it.

Comparing. A parity sketch counts set elements by hash modulo 2 in about n/2 cells. The Hamming distance of two
sketches never exceeds the sets' symmetric difference, so it proves most pairs too far; the rest are
measured on whole sets, members sent to their pivot in blocks of bounded size.

Recursion. A region whose members ended in several components may still hide links between members that are
not with the pivot. It is joined again around its most central member as the next pivot, which then leaves. What is left is compared by finer sketches in blocks of bounded size, and only pairs of different
components that the sketches don't prove too far are sent on to be measured. Where these pairs would outnumber their members,
the members are sent on instead, to a block that has whole sets and gives no more links than join its components.

Defined cases: documents without words, or with null text, have no shingles, link with nothing and are
their own component; fewer words than a shingle has make one shingle; rows with a null doc_id are counted but
stay out of the links and have a null component; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import forget, keep, mixed, shingle_hashes, slices, word_hashes

#: Ids that may be broadcast to choose documents; beyond it they are joined.
BROADCAST_IDS = 300_000
#: Members of a region that one task compares with the pivot.
MEMBERS = 512
#: Members of a region that are compared by sketches at once, and rounds of central pivots before.
BLOCK, ROUNDS = 2048, 2
#: Bytes of such members' data, and pairs of a block that are listed however few members they have.
BLOCK_BYTES, FEW = 16 << 20, 32
#: Sets that a task remembers, to send on each once.
NODE_CACHE = 100_000


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; words are what ASCII white space leaves, A-Z in lower case."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    return np.unique(shingle_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


def node_of(hashes: np.ndarray) -> int:
    """The number of a set: equal sets are one node."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sketch(hashes: np.ndarray, fine: bool = False) -> bytes:
    """Parities of the elements that fall in each of a power of two of cells: at least 64 and n/2; fine: 1024 and 8 n."""
    cells = max(1024, 1 << (8 * len(hashes)).bit_length()) if fine else max(64, 1 << (len(hashes) // 2).bit_length())
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A number of elements that the sets of two sketches differ in at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
    return int(np.bitwise_count(x ^ y).sum())


def folded(fine: bytes, n: int) -> bytes:
    """A fine sketch of n elements as that of at least 128 and n cells."""
    x = np.frombuffer(fine, np.uint8)
    while len(x) > max(16, (1 << n.bit_length()) // 8):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


class Rings:
    """Ring borders for set sizes, and the regions of a set: one for each part of the hash space in its rings."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1]
        while self.edges[-1] < 1 << 44:
            self.edges.append(self.edges[-1] * 10_000 // percent**2 + 1)

    def regions(self, hashes: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
        """(ring, regions, how many of these the set can do without in that ring)."""
        n = len(hashes)
        ring = int(np.searchsorted(self.edges, n, "right")) - 1
        rings = [ring, ring + 1] if 100 * n >= self.percent * self.edges[ring + 1] else [ring]
        return [(r, *self.parts(hashes, r)) for r in rings]

    def parts(self, hashes: np.ndarray, ring: int) -> tuple[np.ndarray, int]:
        # two linked sets of at most ``top`` elements differ in ``most`` of them, so in the content of as many parts
        top = self.edges[ring + 1] - 1
        most = 2 * (100 - self.percent) * top // (100 + self.percent)
        if not most:
            return np.empty(0, np.uint64), 0
        n_parts = most + 2 + most // 3
        part = ((hashes >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        own, content = part[starts], np.add.reduceat(mixed(hashes), starts)
        spare = max(0, len(own) - most - 1)
        if not spare:  # then a part that two sets agree on may be an empty one
            empty = np.setdiff1d(np.arange(n_parts, dtype=np.uint64), own, assume_unique=True)
            own, content = np.concatenate([own, empty]), np.concatenate([content, np.zeros(len(empty), np.uint64)])
        return mixed(content + mixed(own * np.uint64(128) + np.uint64(ring))), spare


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node and sketch of every row."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in slices(texts):
                sets = [shingle_set(t, size) for t in texts[a:b]]
                out = pd.DataFrame({"n_shingles": [len(s) for s in sets], "node": pd.array([node_of(s) if len(s) else None for s in sets], "Int64"), "sketch": [sketch(s) if len(s) else None for s in sets]})
                out.insert(0, "doc_id", batch["doc_id"].iloc[a:b].astype("Int64").values)
                yield out
        forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(describe, "doc_id long, n_shingles long, node long, sketch binary")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("text is not null and doc_id is not null")


def chosen_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the documents in ``wanted`` (doc and more columns)."""
    wanted = keep(wanted, "wanted")
    return texts_of(docs).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc")


def regions(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """region, node: the least populated regions of every set, enough of them that linked sets share one.

    Linked sets of a ring agree on more parts than either can spare. Each leaves out as many of its regions as it can
    spare, the most populated ones, in one order for all; so linked sets still share a region, while sets that
    share a passage alone, or a part that is everywhere, no longer meet.
    """
    rings = Rings(percent)

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = set()
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts, 1_000_000):
                found = []
                for text in texts[a:b]:
                    own = shingle_set(text, size)
                    if not len(own) or (node := node_of(own)) in nodes:
                        continue
                    if len(nodes) < NODE_CACHE:
                        nodes.add(node)
                    found += [(keys.view(np.int64), node, ring, spare) for ring, keys, spare in rings.regions(own)]
                if found:
                    n = [len(keys) for keys, *_ in found]
                    yield pd.DataFrame({"region": np.concatenate([keys for keys, *_ in found])} | {c: np.repeat([f[i] for f in found], n) for i, c in enumerate(("node", "ring", "spare"), 1)})
        forget()

    crossed = texts_of(docs).mapInPandas(cross, "region long, node long, ring int, spare int")
    # a set that several tasks have sent counts as often, for all sets alike
    peopled = crossed.withColumn("people", F.count("*").over(Window.partitionBy("region"))).where("people > 1")
    own = peopled.repartition("node").groupBy("node", "ring", "region").agg(F.first("people").alias("people"), F.first("spare").alias("spare"))
    place = F.row_number().over(Window.partitionBy("node", "ring").orderBy(F.desc("people"), "region"))
    return keep(own.withColumn("place", place).where("place > spare").select("region", "node"), "regions")


def first_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of every region with its pivot b, the least of them."""
    met = members.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy("region")).alias("b"))
    return met.where("a <> b").distinct()


def promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches don't prove too far."""
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = pairs.join(x, "a").join(y, "b").where(near)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = np.array([least_difference(a, b) for a, b in zip(batch["sketch_a"], batch["sketch_b"])], np.int64)
            size = (batch["n_a"] + batch["n_b"]).to_numpy()
            yield batch.loc[100 * (size - least) >= percent * (size + least), ["a", "b"]]

    return both.mapInPandas(test, "a long, b long")


def measured(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """pairs (a, b) with shared, the size of the intersection of the whole sets, and joint, that of the union."""
    members = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    place = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    sent = pairs.join(members, "b").select(F.col("a").alias("node"), F.col("b").alias("pivot"), place.alias("block"))
    pivots = members.select(F.col("b").alias("node"), F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    targets = sent.union(pivots).groupBy("node").agg(F.collect_list(F.struct("pivot", "block")).alias("targets"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts):
                rows = []
                for node, text, to in zip(batch["node"].iloc[a:b], texts[a:b], batch["targets"].iloc[a:b]):
                    own = shingle_set(text, size)
                    if len(own) and node_of(own) == node:
                        data = own.tobytes()
                        rows += [(t["pivot"], t["block"], node != t["pivot"], node, data) for t in to]
                yield pd.DataFrame(rows, columns=["pivot", "block", "member", "node", "data"])
        forget()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, before = None, None, None
        for batch in batches:
            rows = []
            for pivot, block, member, node, data in batch.itertuples(index=False):
                own = np.frombuffer(data, np.uint64)
                if not member:
                    at, held, before = (pivot, block), own, None
                elif at == (pivot, block) and node != before:  # a repeated document is measured once
                    shared = len(np.intersect1d(held, own, assume_unique=True))
                    rows.append((node, pivot, shared, len(held) + len(own) - shared))
                    before = node
            yield pd.DataFrame(rows, columns=["a", "b", "shared", "joint"])

    texts = chosen_texts(docs, targets.join(nodes.select("node", "doc"), "node")).select("node", "text", "targets")
    sets = texts.mapInPandas(send, "pivot long, block int, member boolean, node long, data binary")
    together = sets.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "member", "node")
    return keep(together.mapInPandas(compare, "a long, b long, shared long, joint long"), "measured")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable over edges (a, b): hook to the least neighbour, then jump."""
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = hooked.select(F.col("node").alias("at"), F.col("label").alias("next"))
        # labels are nodes that have edges themselves, so each finds its own label
        new = keep(hooked.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "next").alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(100 * F.col("shared") >= percent * F.col("joint")).select("a", "b")


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the regions that still hold several components, with their label."""
    found = members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = Window.partitionBy("region")
    several = found.withColumns({"low": F.min("label").over(own), "high": F.max("label").over(own)}).where("low <> high")
    return keep(several.drop("low", "high"), "members")


def dealt(members: DataFrame, data: DataFrame, width: int = 0) -> DataFrame:
    """Members of regions with their data, for every two blocks of their region: region, low, high, own, node, label, n, data.

    A block holds BLOCK members at most; given the bytes of data an element has (``width``), also about BLOCK_BYTES.
    """
    size = F.count("*") / BLOCK
    sizes = members.groupBy("region").agg(F.ceil(F.greatest(size, F.sum("n") * width / BLOCK_BYTES) if width else size).cast("int").alias("blocks"))
    facts = members.select("region", "node", "label").join(data, "node").join(sizes, "region")
    own = facts.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "label", "n", "data")
    return own.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high", "node")


def bit_rows(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the length of the shortest."""
    least = min(map(len, sketches))
    out = []
    for x in (np.frombuffer(b, np.uint64) for b in sketches):
        while len(x) > least // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.array(out)


class Block:
    """Rows of two blocks of a region (those of ``dealt``), or of one with itself."""

    def __init__(self, rows: list[tuple], percent: int):
        self.rows, self.percent = rows, percent
        self.side, self.node, self.label, self.n = (np.array([r[i] for r in rows]) for i in (3, 4, 5, 6))

    def near(self, sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places x, y of pairs of different components that sketches don't prove too far, with the differences proved, by runs of x."""
        node, label, n, side, bits = self.node, self.label, self.n, self.side, bit_rows(sketches)
        step = max(1, 2_000_000 // bits.size)
        within = len(set(side.tolist())) < 2
        for at in range(0, len(node), step):
            i = slice(at, at + step)
            size = n[i, None] + n[None]
            least = np.bitwise_count(bits[i, None] ^ bits[None]).sum(2, dtype=np.int64)
            good = (label[i, None] != label[None]) & (node[i, None] < node[None]) & (100 * (size - least) >= self.percent * (size + least))
            if not within:
                good &= side[i, None] != side[None]
            x, y = np.nonzero(good)
            yield x + at, y, least[x, y]

    def sifted(self) -> list[tuple]:
        """(a, b) of near pairs; if these are more than their members, (a, none, region, label, n) of each of these members."""
        found, n_found, met = [], 0, np.zeros(len(self.rows), bool)
        for x, y, _ in self.near([r[7] for r in self.rows]):
            met[x] = met[y] = True
            n_found += len(x)
            if n_found <= max(FEW, len(self.rows)):
                found += zip(self.node[x].tolist(), self.node[y].tolist())
        if n_found <= max(FEW, met.sum()):
            return [(a, b, None, None, None) for a, b in found]
        return [(r[4], None, r[0], r[5], r[6]) for r, near in zip(self.rows, met) if near]

    def joined(self) -> list[tuple]:
        """Links (a, b) measured on whole sets: enough that all links of the block are reached, so fewer than members."""
        sets, up, out = [np.frombuffer(r[7], np.uint64) for r in self.rows], {}, []

        def top(label: int) -> int:
            while label in up:
                up[label] = label = up.get(up[label], up[label])
            return label

        for x, y, least in self.near([sketch(own, fine=True) for own in sets]):
            likely = np.argsort(least, kind="stable")
            for i, j in zip(x[likely].tolist(), y[likely].tolist()):
                a, b = top(self.rows[i][5]), top(self.rows[j][5])
                if a == b:
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= self.percent * (len(sets[i]) + len(sets[j]) - shared):
                    up[a] = b
                    out.append((self.rows[i][4], self.rows[j][4]))
        return out


def by_block(rows: DataFrame, percent: int, method: Callable[[Block], list[tuple]], columns: str) -> DataFrame:
    """What ``method`` gives for every two blocks in ``rows`` (those of ``dealt``)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if row[:3] != key:
                    out += method(Block(held, percent)) if len(held) > 1 else []
                    key, held = row[:3], []
                held.append(row)
            yield pd.DataFrame(out, columns=names, dtype="Int64").drop_duplicates()
            out = []
        yield pd.DataFrame(method(Block(held, percent)) if len(held) > 1 else [], columns=names, dtype="Int64")

    return rows.mapInPandas(compare, columns)


def listed(docs: DataFrame, members: DataFrame, nodes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of a region's members in different components that sizes and fine sketches don't prove too far, and links.

    A member is sent to each of its regions, so what is sent there is the fine sketch folded to one or two cells an element.
    Blocks in which this leaves more pairs than members don't list them: their members meet again by fine sketches, in which
    next to no two elements share a cell, and where these leave more pairs than members too, by whole sets. Whole sets give
    links, no more of them than join the block's components; so what comes out of a block is never more than what it is dealt.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts):
                own = [shingle_set(t, size) for t in texts[a:b]]
                rows = [(node, len(x), fine := sketch(x, fine=True), folded(fine, len(x))) for node, x in zip(batch["node"].iloc[a:b], own) if len(x) and node_of(x) == node]
                yield pd.DataFrame(rows, columns=["node", "n", "sketch", "small"])
        forget()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts):
                own = [shingle_set(t, size) for t in texts[a:b]]
                rows = [(node, len(x), x.tobytes()) for node, x in zip(batch["node"].iloc[a:b], own) if len(x) and node_of(x) == node]
                yield pd.DataFrame(rows, columns=["node", "n", "data"])
        forget()

    def texts(members: DataFrame) -> DataFrame:
        return chosen_texts(docs, members.select("node").distinct().join(nodes.select("node", "doc"), "node")).select("node", "text")

    def sift(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Pairs, and members of regions whose blocks hold more of them than members."""
        out = keep(by_block(rows, percent, Block.sifted, "a long, b long, region long, label long, n long"), name)
        return out.where("b is not null").select("a", "b"), out.where("b is null").select("region", F.col("a").alias("node"), "label", "n").distinct()

    # a repeated document describes its node again
    fine = keep(texts(members).mapInPandas(describe, "node long, n long, sketch binary, small binary").dropDuplicates(["node"]), "fine")
    pairs, dense = sift(dealt(members, fine.select("node", "n", F.col("small").alias("data"))), "pairs")
    links = None
    if not dense.isEmpty():
        more, dense = sift(dealt(dense, fine.select("node", "n", F.col("sketch").alias("data")), 2), "fine_pairs")
        pairs = pairs.union(more)
        if not dense.isEmpty():
            sets = keep(texts(dense).mapInPandas(whole, "node long, n long, data binary").dropDuplicates(["node"]), "sets")
            links = keep(by_block(dealt(dense, sets, 8), percent, Block.joined, "a long, b long").distinct(), "dense_links")
    return promising(keep(pairs.distinct(), "distinct_pairs"), fine, percent), links


def rest_of(docs: DataFrame, nodes: DataFrame, members: DataFrame, edges: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """All links so far and those that the first pivots left in regions that hold several components."""
    members = labelled(members, labels)
    if members.isEmpty():
        return edges
    weight = members.groupBy("node").agg(F.count("*").alias("weight"))
    members = members.join(weight, "node")
    for _ in range(ROUNDS):
        # the most central member is the pivot: it shares most of its regions with others
        pivots = members.groupBy("region").agg(F.max(F.struct("weight", "node")).alias("top")).select("region", F.col("top.node").alias("pivot"))
        placed = keep(members.join(pivots, "region").where("node <> pivot"), "placed")
        met = keep(promising(placed.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), nodes, percent), "met")
        edges = keep(edges.union(linked(measured(docs, nodes, met, size), percent)), "links")
        # a pivot has met its whole region and leaves it
        members = labelled(placed.drop("pivot"), components(edges))
    rest, sure = listed(docs, members, nodes, size, percent)
    edges = edges.union(linked(measured(docs, nodes, keep(rest, "rest"), size), percent))
    return keep(edges.union(sure) if sure else edges, "links")


def links(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """node and label, for nodes with a link: the smallest node of the component."""
    members = regions(docs, size, percent)
    met = promising(first_pairs(members), nodes, percent)
    edges = keep(linked(measured(docs, nodes, keep(met, "promising"), size), percent), "links")
    labels = components(edges)
    more = rest_of(docs, nodes, members, edges, labels, size, percent)
    return labels if more is edges else components(more)


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node, label (the least node of the group) and component_id (its smallest doc_id) for every row of docs."""
    rows = keep(described(docs, size), "described")
    nodes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = keep(nodes, "nodes")
    named = keep(nodes.select("node", "doc").join(links(docs, nodes, size, percent), "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    least = named.groupBy("label").agg(F.min("doc").alias("component"))
    named = named.join(least, "label").select(F.col("node").alias("key"), "label", "component")
    # documents without words each have a key of their own, else all would meet in one task
    keyed = rows.withColumn("key", F.coalesce("node", F.xxhash64("doc_id", "n_shingles")))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return keyed.join(named, "key", "left").select("doc_id", "n_shingles", "node", "label", own.alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of docs."""
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, one of the smallest doc_id; rows with a null id or without words stay.

    Rows are told apart by doc_id where it is theirs alone, else by doc_id and node; of rows that share both, one of the
    least text stays.
    """
    groups = keep(grouped(docs, size, percent).where("doc_id is not null").select("doc_id", "node", "label"), "groups")
    repeated = keep(groups.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("rows")).where("rows > 1").select("again"), "repeated")
    worded = groups.where("node is not null")
    first = worded.groupBy(F.col("label").alias("of")).agg(F.min(F.struct("doc_id", "node")).alias("first"))
    spare = worded.join(first, F.col("label") == F.col("of")).where(F.struct("doc_id", "node") != F.col("first"))
    spare = keep(spare.select(F.col("doc_id").alias("spare"), F.col("node").alias("spare_node")).distinct(), "spare")
    n_spare, n_repeated = spare.count(), repeated.count()

    def few(ids: DataFrame, n: int) -> DataFrame:
        return F.broadcast(ids) if n <= BROADCAST_IDS else ids

    if not n_repeated:
        return docs.join(few(spare, n_spare), docs["doc_id"] == spare["spare"], "left_anti")
    ids = few(spare.join(repeated, F.col("spare") == F.col("again"), "left_anti").union(repeated.select("again", F.lit(0))).select("spare").distinct(), n_spare + n_repeated)
    single = docs.join(ids, docs["doc_id"] == ids["spare"], "left_anti")

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        sets = (shingle_set(t or "", size) for t in texts)
        return pd.Series([node_of(x) if len(x) else None for x in sets], dtype="Int64")

    rows = docs.join(few(repeated, n_repeated), docs["doc_id"] == repeated["again"], "left_semi")
    rows = keep(rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("of_text"), node(F.col("text")).alias("set")), "repeated_rows")
    mine = rows.where("set is not null").join(few(spare, n_spare), (F.col("id") == F.col("spare")) & (F.col("set") == F.col("spare_node")), "left_anti")
    chosen = mine.groupBy("id", "set").agg(F.min_by("row", "of_text").alias("row")).select("row.*")
    return single.unionByName(chosen).unionByName(rows.where("set is null").select("row.*"))


#: The query's rows by plain SQL: all pairs that share a shingle, and what links reach.
ORACLE = r"""with recursive
worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
sets as (select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
  else list_distinct([array_to_string(words[i:i + 2], ' ') for i in range(1, len(words) - 1)]) end as own from worded),
elements as (select doc_id, unnest(own) as shingle from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from elements a join elements b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * k >= 90 * (len(x.own) + len(y.own) - k)),
ways as (select a, b from links union select b, a from links),
reach as (select doc_id as node, doc_id as root from sets union select b, root from reach join ways on a = node)
select doc_id, cast(len(own) as bigint) as n_shingles, least_root as component_id
from sets join (select node, min(root) as least_root from reach group by node) on node = doc_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90)
