"""Micro-batch ingest of JSON bodies from files, and running counts of a stream."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.operators.aggregates import minute_deltas
from logweave.schema import ROLLUP
from logweave.sources.ingest import validated
from logweave.sources.snapshots import Conflict, Snapshots
from logweave.sources.storage import LogStore


def ingest_stream(spark: SparkSession, source: str, store: LogStore, checkpoint: str, max_files: int = 1000, max_age_days: int = 0) -> StreamingQuery:
    """Ingest every file of ``source`` (one body a file) once; no watermark, late rows count. A replayed batch is written once.

    Accepted rows, rejected entries and bodies that hold none are published in one commit a micro-batch.
    """
    bodies = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(source)

    def commit(batch: DataFrame, number: int) -> None:
        # the id of the checkpoint: numbers of other streams into the store, and of other checkpoints, are not its own
        writer = spark.read.text(f"{checkpoint}/metadata").first()[0]
        named = batch.select(F.xxhash64("value").alias("batch"), F.col("value").alias("body"))
        now = dt.datetime.now(dt.timezone.utc)
        store.append_once(writer, number, validated(named, now, max_age_days, bodies_too=True))

    return bodies.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minute_counts(logs: DataFrame) -> DataFrame:
    """Running counts by minute, service and level of a stream of logs, in complete or update mode."""
    at = F.window(F.col("timestamp").cast("timestamp"), "1 minute")["start"].alias("bucket_start")
    return logs.groupBy(at, "service", "level").agg(F.count("*").alias("count"))


class MinuteCounts:
    """Counts of a stream as deltas: a batch appends its own, so what it writes does not grow with what came before.

    Deltas have levels. As soon as ``FOLD`` of a level are there, they are summed up as one of the next, so a count is
    rewritten once a level and a read meets few folders at any time. A batch's number is published with its delta.
    """

    FOLD = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.snapshots = spark, path, Snapshots(spark, path)

    def add(self, logs: DataFrame, number: int) -> None:
        """Count a batch, unless it was counted before; batches come in order of their numbers."""
        if self.snapshots.latest()[1].get("last", -1) >= number:
            return
        folder = self.write(minute_deltas(logs))

        def put(seen: dict) -> dict | None:
            if seen.get("last", -1) >= number:
                return None
            return {"last": number, "deltas": [*seen.get("deltas", []), [0, folder]]}

        self.snapshots.change(put)
        self.fold()

    def fold(self) -> None:
        """Sum up deltas of which there are enough; also while batches are added by others."""
        level = 0
        while deltas := self.snapshots.latest()[1].get("deltas", []):
            own = [d for d in deltas if d[0] == level][: self.FOLD]
            if len(own) < self.FOLD:
                if level >= max(d[0] for d in deltas):
                    return
                level += 1
                continue
            folder = self.write(self.read([f for _, f in own]))

            def put(seen: dict, own: list = own, folder: str = folder, level: int = level) -> dict:
                if any(d not in seen["deltas"] for d in own):
                    raise Conflict("deltas were folded by others")
                return seen | {"deltas": [d for d in seen["deltas"] if d not in own] + [[level + 1, folder]]}

            try:
                self.snapshots.change(put)
            except Conflict:
                return

    def write(self, counts: DataFrame) -> str:
        folder = uuid.uuid4().hex
        counts.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in ROLLUP.split(", "))).write.parquet(f"{self.path}/deltas/{folder}")
        return folder

    def read(self, folders: list[str]) -> DataFrame:
        found = self.spark.read.schema(ROLLUP).parquet(*[f"{self.path}/deltas/{f}" for f in folders]) if folders else self.spark.createDataFrame([], ROLLUP)
        return found.groupBy("bucket_start", "service", "level").agg(F.sum("count").alias("count"))

    def vacuum(self, grace: float = 86_400) -> int:
        """Remove deltas older than ``grace`` seconds that were folded; their number."""
        named = {f for _, f in self.snapshots.latest()[1].get("deltas", [])}
        old = [n for n, changed in self.snapshots.files.listed("deltas") if n not in named and changed <= time.time() - grace]
        for name in old:
            self.snapshots.files.delete(f"deltas/{name}")
        return len(old)

    def counts(self) -> DataFrame:
        return self.read([f for _, f in self.snapshots.latest()[1].get("deltas", [])])
