"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' token ids. Windows of ``window_sequences`` sequences are filled
in turn: each window gives each queue its target share of the window's tokens, and the part of a token
that a share leaves over is carried to the next window as that queue's deficit, so that after any number
of windows every queue is within a token of its target. Written as cumulative sums this needs no turn
by turn work: with C_j the target tokens of queues 1..j and T those of all, queues 1..j have given
floor(t * C_j / T) tokens when t tokens are laid out. Each document then computes where its pieces go
from its place in its queue alone, and deficits carry across partitions because places are global.

The default target is the share of each source in the corpus, so all queues end together. Given weights,
a queue that runs dry leaves its share to the others: the layout has one phase for each such event. Sources
without a weight share, by their size, what the weights leave of 1; sources whose share is zero come last.
Sources beyond the ``max_queues`` largest that have no weight share one queue, in which they follow the parts of the input.

Two passes: documents are tokenized once and their ids written to the shared folder with their place in
the partition's queue; queue totals by partition (a small table) give the global place; the second pass
cuts pieces. Token ids are never shuffled.

Defined cases: a null or empty text is one piece holding only the end id; a null source is a queue of its
own; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import forget, keep, slices

SEQUENCE = 2048
WINDOW_SEQUENCES = 64
MAX_QUEUES = 256
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Chunks of text, and words, whose ids one worker remembers.
CHUNK_CACHE, WORD_CACHE = 100_000, 400_000
#: Rows of the table of queue totals that may be broadcast; beyond it, the table is joined.
BROADCAST_ROWS = 500_000
#: White space that Python splits at and the tokenizer's rules do not, or the start of a special token.
UNUSUAL = re.compile("[\x1c-\x1f\x85᠎​﻿]|<\\|")
#: Chunks of printable ASCII and Latin letters with accents: no normal form changes them but lower case.
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Whole texts of these characters and white space that Python and the tokenizer's rules both split at.
PLAIN = re.compile("[\x20\x09-\x0D!-~À-ÖØ-öø-ÿ]*")
#: Fixed values, the tokenizer's own words: a run of letters, an ending, a digit, a run of other signs.
WORDS = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\x20\x09-\x0Da-z0-9ß-öø-ÿ]+")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Known(dict):
    """What ``find`` gives for a key; at most ``most`` results are remembered."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        self.find, self.most = find, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.find(key)
        return value


class Tokens:
    """Token ids by word, or by chunk: this tokenizer's words never cross white space, so a chunk has the same ids in any text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # Spark's tasks fill the cores; threads of each task's own would only take them from one another
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {i: spell(chr(i))[0][0] for i in range(ord("ß"), ord("ÿ") + 1)}
        self.chunks, self.words = Known(self.chunk, CHUNK_CACHE), Known(self.word, WORD_CACHE)

    def forget(self) -> None:
        self.chunks.clear()
        self.words.clear()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def word(self, word: str) -> bytes:
        """The ids of one of the tokenizer's words, in lower case."""
        return array("H", [t.id for t in self.model.tokenize(word.translate(self.spelled))]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """The ids of a chunk: of SIMPLE characters by its words, of which there are fewer; any other as it is."""
        return b"".join(map(self.words.__getitem__, WORDS.findall(chunk.lower()))) if SIMPLE.fullmatch(chunk) else self.whole(chunk)

    def encode(self, text: str) -> bytes:
        """The little-endian 16-bit ids of a text."""
        if PLAIN.fullmatch(text) and "<|" not in text:  # most texts: there are far fewer words than chunks
            return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))
        if UNUSUAL.search(text):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, (text.lower() if text.isascii() else text).split()))


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, ids (16-bit, with the end id), part, local (tokens of this source before it in the part)."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), defaultdict(int)
        coder, end = tokens(path), np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in slices(texts):
                ids = [coder.encode(t) + end for t in texts[a:b]]
                sources, local = batch["source"].tolist()[a:b], []
                for s, x in zip(sources, ids):
                    local.append(before[s])
                    before[s] += len(x) // 2
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64").values, "source": sources, "ids": ids, "part": part, "local": local})
        coder.forget()
        forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")).mapInPandas(encode, "doc_id long, source string, ids binary, part int, local long")


class Layout:
    """Where the tokens of each queue lie. phases: (first position, [(first token, tokens) of each queue])."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = SEQUENCE * WINDOW_SEQUENCES):
        self.window, self.phases = window, []
        left, given, start = list(totals), [0] * len(totals), 0
        while any(left):
            live = [i for i, n in enumerate(left) if n and (weights is None or weights[i] > 0)]
            if weights is None or not live:
                take = list(left)  # in proportion to what is left: all queues end together
            else:
                rounds = min(left[i] / weights[i] for i in live)
                take = [0] * len(left)
                for i in live:
                    take[i] = min(left[i], max(1, round(rounds * weights[i])))
            ends = [0]
            for n in take:
                ends.append(ends[-1] + n)
            self.phases.append((start, list(given), ends))
            start += ends[-1]
            left = [a - b for a, b in zip(left, take)]
            given = [a + b for a, b in zip(given, take)]

    def pieces(self, queue: int, first: int, n: int, sequence: int = SEQUENCE) -> Iterator[tuple[int, int, int]]:
        """(tokens before it in the document, length, position) of each piece of n tokens from the queue's token ``first``."""
        done = 0
        for start, given, ends in self.phases:
            low, size, total = given[queue], ends[queue + 1] - ends[queue], ends[-1]
            if done == n or first + done >= low + size or not size:
                continue

            def gave(t: int, low=ends[queue], high=ends[queue + 1], total=total) -> int:
                return t * high // total - t * low // total

            k = first + done - low
            w = max(0, k * total // size // self.window - 1)
            while done < n and k < size:
                while gave(min((w + 1) * self.window, total)) <= k:
                    w += 1
                t, u = w * self.window, min((w + 1) * self.window, total)
                before = u * ends[queue] // total - t * ends[queue] // total
                at = start + t + before + k - gave(t)
                length = min(n - done, gave(u) - k, sequence - at % sequence)
                yield done, length, at
                done, k = done + length, k + length


def shares_of(totals: list[int], given: list[float | None]) -> list[float]:
    """Target shares: the given ones; queues without one share by size what these leave of 1."""
    rest, size = max(0.0, 1.0 - sum(w or 0.0 for w in given)), sum(n for n, w in zip(totals, given) if w is None)
    return [rest * n / max(1, size) if w is None else max(0.0, w) for n, w in zip(totals, given)]


def pack(docs: DataFrame, weights: dict[str, float] | None = None, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, max_queues: int = MAX_QUEUES, tokenizer: str | None = None) -> DataFrame:
    """Rows of PIECES: every token id of every document in exactly one piece. weights: target shares by source."""
    spark, window = docs.sparkSession, sequence * window_sequences
    coded = keep(tokenized(docs, tokenizer or public_tokenizers.path(TOKENIZER)), "token_ids")
    by_part = coded.groupBy("part", "source").agg(F.sum(F.octet_length("ids") / 2).cast("long").alias("n"))
    by_part = keep(by_part, "queue_totals")
    # sources in the driver: bounded, the named and the largest ones; all others are summed into one
    by_source = by_part.groupBy("source").agg(F.sum("n").alias("n"))
    largest = by_source.orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(max_queues - 1).collect()
    named = by_source.where(F.col("source").isin(list(weights))).collect() if weights else []
    totals = {r["source"]: r["n"] for r in [*largest, *named]}
    whole = by_part.agg(F.sum("n")).first()[0] or 0
    own = list(totals)
    sizes = [totals[s] for s in own]
    sizes.append(whole - sum(sizes))
    layout = Layout(sizes, None if weights is None else shares_of(sizes, [weights.get(s) for s in own] + [None]), window)
    number = F.lit(len(own))
    for i, s in enumerate(own):
        number = F.when(F.col("source").eqNullSafe(F.lit(s)), i).otherwise(number)
    # a queue's order: part, then source, then order in the part
    order = Window.partitionBy("queue").orderBy("part", F.asc_nulls_last("source"))
    base = by_part.withColumn("queue", number).withColumn("base", F.sum("n").over(order) - F.col("n"))
    base = base.select(F.col("part").alias("base_part"), F.col("source").alias("base_source"), "queue", "base")
    if by_part.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = coded.join(base, (F.col("part") == F.col("base_part")) & F.col("source").eqNullSafe(F.col("base_source")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, source, ids, queue, first in zip(batch["doc_id"].astype("Int64"), batch["source"], batch["ids"], batch["queue"], batch["first"]):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                for start, length, at in layout.pieces(int(queue), int(first), len(ids), sequence):
                    rows.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), at // sequence, at % sequence, source))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]).astype({"doc_id": "Int64"})

    return placed.select("doc_id", "source", "ids", "queue", (F.col("base") + F.col("local")).alias("first")).mapInPandas(cut, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
