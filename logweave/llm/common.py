"""Shared folders, word hashing and shingles for the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words whose hash one worker remembers; other words are hashed again each time.
WORD_CACHE = 150_000
#: Characters of text that a task turns into Python words at once.
SLICE_CHARS = 2_000_000

#: Rows that a Python worker gets at once while a table is kept, and bytes that a Parquet writer gathers: rows are whole texts.
BATCH_ROWS, ROW_GROUP = 2000, 32 << 20
BATCH_OPTION = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Once a table is kept, nothing reads the shuffles again that made it.
CLEANUP_OPTION = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set (local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = tempfile.mkdtemp(prefix="spark-logweave-")
        atexit.register(shutil.rmtree, _own_dir["dir"], ignore_errors=True)
    return _own_dir["dir"]


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in the shared folder."""
    return f"{shared_dir(spark)}/logweave/{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there: lineage ends, lost executors cost nothing."""
    path = f"{scratch(df.sparkSession)}/{name}"
    put(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before, cleaned = spark.conf.get(BATCH_OPTION), spark.conf.get(CLEANUP_OPTION)
    spark.conf.set(BATCH_OPTION, BATCH_ROWS if int(before) <= 0 else min(BATCH_ROWS, int(before)))
    spark.conf.set(CLEANUP_OPTION, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(BATCH_OPTION, before)
        spark.conf.set(CLEANUP_OPTION, cleaned)


def id_crc(column: str) -> Column:
    """crc32 of the decimal text of an id, the value by which folds are cut."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hash_share(column: Column, share: float) -> Column:
    """A repeatable choice of about ``share`` of the ids in ``column``."""
    return F.pmod(F.xxhash64(column), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)


class WordHashes(dict):
    """Word to 64-bit hash, remembering at most WORD_CACHE words."""

    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


_hashes = WordHashes()


def word_hashes(words: list) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def forget() -> None:
    """Give back what a task that ends has remembered: its Python worker goes on to other tasks and stages."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` words; fewer words give none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + n]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of texts of about ``most`` characters; each text stays whole."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
