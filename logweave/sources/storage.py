"""Logs, their rollup and rejected entries as Parquet, published by compare-and-set on a tree of manifests.

A snapshot names, for each month, a manifest of that month: the folders that hold its rows, with their numbers of rows and
first and last timestamps. A commit writes its rows under a fresh folder, a new manifest of each month that it
touches, and the next snapshot, which is created only if nobody else has created it; otherwise it is built anew on the
other's. So any number of engines, streams, retention and compaction passes may work on one store at once.

Retention drops whole months from the snapshot and rewrites the folders of the month that holds the cutoff, no other;
``vacuum`` removes folders and manifests that no snapshot names any more. A reader of an older snapshot sees it whole
until then. The rollup holds each commit's counts by minute, hour and day, so a range of time is read as a few whole cells.

Ids are reserved as a range by a commit of their own before rows are written, so they are unique whatever else is going
on. They follow the entries' order within each body without gaps within a batch: rows are numbered within the parts in which they were read, and
parts by the sums of those before, of which the driver holds one number a part.

A writer that may replay its batches names itself and its own number; the snapshot keeps each writer's last number.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.operators.aggregates import cells
from logweave.schema import LOGS, REJECTS, ROLLUP, month_of
from logweave.sources.snapshots import Conflict, Snapshots

WRITERS = "batch bigint, writer string, number bigint"
SCHEMAS = {"logs": LOGS, "rejects": REJECTS}


#: Bits of a file's signature, and the seed of the hash that places a run in it.
SIGNATURE, SEED = 32_768, 42
SIGNATURES = "file string, bits binary, month string"


def grams(text: Column, lengths: Iterable[int] = (1, 2, 3)) -> Column:
    """The distinct runs of so many characters of a text in lower case."""
    low = F.lower(text)

    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs, lengths)))


def bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SIGNATURE)).cast("long")


def bits_of(texts: list[str]) -> np.ndarray:
    """``bit`` of the distinct ``grams`` of texts that are in lower case already; only distinct runs are hashed."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    # characters from each place to the end of its text
    left, found = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)), []
    for n in (1, 2, 3):
        at = np.flatnonzero(left >= n)
        runs = sum(codes[at + i] << np.uint64(21 * i) for i in range(n))
        for run in pd.unique(runs).tolist() if len(at) else []:
            gram = "".join(chr(run >> 21 * i & 0x1FFFFF) for i in range(n))
            found.append(xxhash.xxh64_intdigest(gram.encode(), SEED) % SIGNATURE)
    return np.array(found, np.int64)


class LogStore:
    """promoted: attribute keys that get a column of their own with a Bloom filter (``attr_<key>``); folders written before keep the map.

    searchable: each file of logs gets a signature of the runs of up to three characters in its messages, so a search for a
    text reads only files whose signatures hold all runs of it. Folders written without one are always read.
    """

    def __init__(self, spark: SparkSession, path: str, promoted: Iterable[str] = (), searchable: bool = False):
        self.spark, self.path, self.promoted, self.searchable = spark, path, tuple(promoted), searchable
        self.snapshots = Snapshots(spark, path)
        self.files, self.known = self.snapshots.files, {}

    # what is published

    def snapshot(self, version: int | None = None) -> dict:
        return self.snapshots.latest()[1] if version is None else self.snapshots.at(version)

    def folders(self, seen: dict, table: str, month: str) -> list[dict]:
        """id, rows, first, last of each folder that holds rows of a month; manifests never change, so they are read once."""
        summary = seen.get(table, {}).get(month)
        if not summary:
            return []
        name = summary["manifest"]
        if name not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[name] = json.loads(self.files.read(f"_months/{name}.json"))
        return self.known[name]

    def months(self, table: str = "logs", version: int | None = None) -> list[str]:
        return sorted(self.snapshot(version).get(table, {}))

    def read(self, table: str, places: list[str], schema: str) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, commit string").option("basePath", f"{self.path}/{table}").parquet(*places).drop("commit")

    def published(self, table: str, seen: dict, months: Iterable[str] | None = None, ids: set[str] | None = None, needle: str | None = None) -> DataFrame:
        """Rows of some months and folders of a snapshot; given a needle, at least those whose messages hold it."""
        months = sorted(seen.get(table, {})) if months is None else months
        folders = [(m, f) for m in months for f in self.folders(seen, table, m) if ids is None or f["id"] in ids]
        signed = [(m, f) for m, f in folders if needle and f.get("signed")]
        places = [f"{self.path}/{table}/commit={f['id']}/month={m}" for m, f in folders if not (needle and f.get("signed"))] + self.holding(needle, signed)
        # a key that some folder was written without is left to the map
        keys = [k for k in self.promoted if all(k in f.get("keys", ()) for _, f in folders)] if table == "logs" else []
        columns = SCHEMAS[table] + "".join(f", `attr_{k}` string" for k in keys)
        return self.read(table, places, columns)

    def holding(self, needle: str | None, signed: list[tuple[str, dict]]) -> list[str]:
        """The files of some folders whose signatures hold all runs of a needle; by the longest runs, shorter ones are within."""
        if not signed:
            return []
        signatures = self.read("signatures", [f"{self.path}/signatures/commit={f['id']}/month={m}" for m, f in signed], SIGNATURES)
        own = grams(F.lit(needle), [max(1, min(3, len(needle)))])

        def has(gram: Column) -> Column:
            byte = F.conv(F.hex(F.substring("bits", (F.floor(bit(gram) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.floor(byte / F.pow(F.lit(2.0), bit(gram) % 8)) % 2 == 1

        found = signatures.where(F.forall(own, has)).select("file", "month").collect()  # one row a file
        at = {(r["file"].partition("/")[0], r["month"]): [] for r in found}
        for r in found:
            at[r["file"].partition("/")[0], r["month"]].append(r["file"])
        return [f"{self.path}/logs/{name}" for names in at.values() for name in names]

    def logs(self, version: int | None = None, months: Iterable[str] | None = None, needle: str | None = None) -> DataFrame:
        return self.published("logs", self.snapshot(version), months, needle=needle)

    def rejects(self, version: int | None = None) -> DataFrame:
        """writer, batch (the body), index (null: the body itself), reason of what was not accepted."""
        return self.published("rejects", self.snapshot(version))

    def rollup(self, unit: str = "1m", version: int | None = None, seen: dict | None = None) -> DataFrame:
        """bucket_start, service, level, count, month of whole minutes, hours (1h) or days (1d)."""
        seen = self.snapshot(version) if seen is None else seen
        places = [f"{self.path}/rollup/commit={f['id']}/unit={unit}/month={m}" for m in sorted(seen.get("logs", {})) for f in self.folders(seen, "logs", m)]
        deltas = self.read("rollup", places, f"{ROLLUP}, unit string, month string")
        return deltas.groupBy("bucket_start", "service", "level", "month").agg(F.sum("count").alias("count"))

    def every_commit(self) -> DataFrame:
        """The last batch of each writer that numbers its own."""
        version, seen = self.snapshots.latest()
        return self.spark.createDataFrame([(version, w, n) for w, n in seen.get("writers", {}).items()], WRITERS)

    def next_batch(self) -> int:
        return self.snapshots.latest()[0] + 1

    # commits

    def replaced(self, seen: dict, table: str, month: str, gone: set[str], new: list[dict]) -> dict:
        """The snapshot with other folders in a month."""
        folders = [f for f in self.folders(seen, table, month) if f["id"] not in gone] + new
        months = {m: s for m, s in seen.get(table, {}).items() if m != month}
        if folders:
            name = uuid.uuid4().hex
            self.files.write(f"_months/{name}.json", json.dumps(folders))
            months[month] = {"manifest": name, "folders": len(folders), "rows": sum(f["rows"] for f in folders), "first": min(f["first"] for f in folders), "last": max(f["last"] for f in folders)}
        return seen | {table: months}

    def reserve(self, count: int) -> int:
        """The first of so many ids that nobody else gets."""
        first = []

        def put(seen: dict) -> dict:
            first[:] = [seen.get("next_id", 1)]
            return seen | {"next_id": first[0] + count}

        self.snapshots.change(put)
        return first[0]

    def replayed(self, seen: dict, writer: str | None, number: int | None) -> bool:
        return writer is not None and seen.get("writers", {}).get(writer, -1) >= number

    def append_once(self, writer: str, number: int, rows: DataFrame) -> int:
        """Publish a writer's batch unless it was published before; a writer's numbers grow."""
        return 0 if self.replayed(self.snapshot(), writer, number) else self.append(None, rows, writer, number)

    def append(self, batch: int | None, rows: DataFrame, writer: str | None = None, number: int | None = None) -> int:
        """Publish what ``validated`` gives, all of it in one commit, and return the number of accepted rows.

        Rows with a reason are rejects; rows without the column are all accepted. The entries of a body have to lie in one
        part of ``rows``, as ``validated`` leaves them. ``batch`` is the number from which a commit is tried; one that is
        taken means the next.
        """
        for c in ("index", "batch"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("long"))
        if "reason" not in rows.columns:
            rows = rows.withColumn("reason", F.lit(None).cast("string"))
        # bodies are parsed once: everything below reads what this writes
        folder = uuid.uuid4().hex
        place = f"{self.path}/_staging/{folder}"
        staged = rows.withColumn("month", month_of(F.col("timestamp"))).withColumn("part", F.spark_partition_id())
        staged.write.parquet(place)
        staged = self.spark.read.schema(staged.schema).parquet(place)
        good, bad = staged.where("reason is null"), staged.where("reason is not null")
        try:
            total = 0
            new: dict[str, list[dict]] = {}
            parts = sorted((r["part"], r["count"]) for r in good.groupBy("part").count().collect())
            if total := sum(n for _, n in parts):
                first, bases = self.reserve(total), []
                for part, n in parts:
                    bases.append((part, first))
                    first += n
                base = F.broadcast(self.spark.createDataFrame(bases, "part int, base bigint"))  # one row a part
                nth = F.row_number().over(Window.partitionBy("part").orderBy("batch", "index")) - 1
                numbered = good.withColumn("nth", nth).join(base, "part").withColumn("id", F.col("base") + F.col("nth"))
                new = self.write(folder, numbered.withColumn("ingested_at", F.current_timestamp()), good)
            rejected = bad.groupBy().count().first()[0]
            if rejected:
                now = dt.datetime.now(dt.timezone.utc)
                bad.select(F.lit(writer).cast("string").alias("writer"), "batch", F.col("index").cast("bigint").alias("index"), "reason", F.lit(f"{now:%Y_%m}").alias("month")).write.partitionBy("month").parquet(f"{self.path}/rejects/commit={folder}")
            if total or rejected or writer is not None:

                def put(seen: dict) -> dict | None:
                    if self.replayed(seen, writer, number):
                        return None
                    for month, folders in new.items():
                        seen = self.replaced(seen, "logs", month, set(), folders)
                    if rejected:
                        us = int(now.timestamp() * 1_000_000)
                        seen = self.replaced(seen, "rejects", f"{now:%Y_%m}", set(), [{"id": folder, "rows": rejected, "first": us, "last": us}])
                    return seen | ({"writers": seen.get("writers", {}) | {writer: number}} if writer is not None else {})

                self.snapshots.change(put)
        finally:
            self.files.delete(f"_staging/{folder}")
        return total

    def load(self, rows: DataFrame) -> None:
        """Publish rows that have ids of their own: LOGS' columns but ``month`` and ``ingested_at``."""
        rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("month", month_of(F.col("timestamp"))).withColumn("ingested_at", F.current_timestamp())
        new, last = self.write(uuid.uuid4().hex, rows, rows), rows.agg(F.max("id")).first()[0]

        def put(seen: dict) -> dict:
            for month, folders in new.items():
                seen = self.replaced(seen, "logs", month, set(), folders)
            return seen | {"next_id": max(seen.get("next_id", 1), (last or 0) + 1)}

        self.snapshots.change(put)

    def write(self, folder: str, rows: DataFrame, counted: DataFrame) -> dict[str, list[dict]]:
        """Write rows and their cells as a folder that nothing names yet; its entry for each month. counted: the same rows, ids aside."""
        columns = [c.split()[0] for c in LOGS.split(", ")]
        keys = [F.try_element_at("attr_text", F.lit(k)).alias(f"attr_{k}") for k in self.promoted]
        out = rows.select(*columns, *keys).sortWithinPartitions("month", "timestamp", "id").write.partitionBy("month")
        for k in self.promoted:
            out = out.option(f"parquet.bloom.filter.enabled#attr_{k}", "true").option(f"parquet.enable.dictionary#attr_{k}", "false")
        out.parquet(f"{self.path}/logs/commit={folder}")
        if self.searchable:
            self.sign(folder)
        stored = cells(counted.select("timestamp", "service", "level")).withColumn("month", month_of(F.col("bucket_start")))
        stored.repartition("unit", "month").sortWithinPartitions("unit", "month", "bucket_start").write.partitionBy("unit", "month").parquet(f"{self.path}/rollup/commit={folder}")
        us = F.unix_micros("timestamp")
        found = counted.groupBy("month").agg(F.count("*").alias("rows"), F.min(us).alias("first"), F.max(us).alias("last")).collect()  # one row a month
        return {r["month"]: [{"id": folder, "rows": r["rows"], "first": r["first"], "last": r["last"], "signed": self.searchable, "keys": list(self.promoted)}] for r in found}

    def sign(self, folder: str) -> None:
        """Write the signatures of a folder's files: names below ``logs`` and bitmaps."""

        def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            marked: dict[tuple[str, str], np.ndarray] = {}  # one bitmap for each file of the task
            for batch in batches:
                for of, texts in batch.dropna(subset=["low"]).groupby(["name", "month"])["low"]:
                    marked.setdefault(of, np.zeros(SIGNATURE, bool))[bits_of(texts.unique().tolist())] = True
            yield pd.DataFrame([(*of, np.packbits(at, bitorder="little").tobytes()) for of, at in marked.items()], columns=["name", "month", "bits"])

        rows = self.spark.read.schema(LOGS).parquet(f"{self.path}/logs/commit={folder}").select(F.col("_metadata.file_name").alias("name"), "month", F.lower("message").alias("low"))
        bits = rows.mapInPandas(mark, "name string, month string, bits binary").groupBy("name", "month").agg(F.bitmap_or_agg("bits").alias("bits"))
        name = F.concat(F.lit(f"commit={folder}/month="), "month", F.lit("/"), "name")
        bits.select(name.alias("file"), "bits", "month").write.partitionBy("month").parquet(f"{self.path}/signatures/commit={folder}")

    # upkeep

    def rewrite(self, seen: dict, month: str, gone: set[str], kept: DataFrame) -> dict[str, list[dict]]:
        folder = uuid.uuid4().hex
        return self.write(folder, kept, kept)

    def retain(self, now: dt.datetime, days: int) -> None:
        """Drop rows older than ``days``: whole months by name, and of the cutoff's month the folders that hold older rows are rewritten."""
        cutoff = now - dt.timedelta(days=days)
        cutoff = cutoff.replace(tzinfo=dt.timezone.utc) if cutoff.tzinfo is None else cutoff
        least, edge = int(cutoff.timestamp()) * 1_000_000 + cutoff.microsecond, f"{cutoff:%Y_%m}"
        for _ in range(20):
            seen = self.snapshot()
            gone = {f["id"] for f in self.folders(seen, "logs", edge) if f["first"] < least}
            kept = self.published("logs", seen, [edge], gone).where(F.unix_micros("timestamp") >= least)
            new = self.rewrite(seen, edge, gone, kept).get(edge, []) if gone else []
            if not gone and all(m >= edge for table in SCHEMAS for m in seen.get(table, {})):
                return
            try:
                self.snapshots.change(lambda at: self.swapped({**at, **{t: {m: s for m, s in at.get(t, {}).items() if m >= edge} for t in SCHEMAS}}, edge, gone, new))
                return
            except Conflict:
                continue
        raise Conflict("other passes rewrite the same month")

    def swapped(self, seen: dict, month: str, gone: set[str], new: list[dict]) -> dict:
        """The snapshot with new folders in place of those that were read; what others have added meanwhile stays."""
        if gone - {f["id"] for f in self.folders(seen, "logs", month)}:
            raise Conflict(f"folders of {month} were replaced by others")
        return self.replaced(seen, "logs", month, gone, new) if gone or new else seen

    def compact(self, most: int = 16) -> None:
        """Rewrite as one folder the rows of each month that has more than ``most``; a month that others rewrite is left to them."""
        for month in self.months():
            seen = self.snapshot()
            gone = {f["id"] for f in self.folders(seen, "logs", month)}
            if len(gone) > most:
                rows = self.published("logs", seen, [month], gone)
                new = self.rewrite(seen, month, gone, rows.repartitionByRange("timestamp")).get(month, [])
                try:
                    self.snapshots.change(lambda at, m=month, g=gone, n=new: self.swapped(at, m, g, n))
                except Conflict:
                    continue

    def vacuum(self, keep: int = 1, grace: float = 86_400) -> list[str]:
        """Remove all but the last ``keep`` snapshots, and folders that none of these names and that are older than ``grace`` seconds."""
        versions = self.snapshots.versions()
        named, manifests = set(), set()
        for v in versions[-keep:]:
            seen = self.snapshots.at(v)
            for table in SCHEMAS:
                for month, summary in seen.get(table, {}).items():
                    manifests.add(f"{summary['manifest']}.json")
                    named |= {f"commit={f['id']}" for f in self.folders(seen, table, month)}
        for v in versions[:-keep]:
            self.files.delete(f"_snapshots/{v:020d}.json")
        removed = []
        for folder, wanted in (("logs", named), ("rollup", named), ("rejects", named), ("signatures", named), ("_months", manifests), ("_staging", set())):
            for name, changed in self.files.listed(folder):
                if name not in wanted and changed <= time.time() - grace:
                    self.files.delete(f"{folder}/{name}")
                    removed.append(f"{folder}/{name}")
        return removed


def retained(logs: DataFrame, now: dt.datetime, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``now``; whole months before are not read."""
    cutoff = now - dt.timedelta(days=days)
    kept = logs.where(F.col("timestamp") >= F.lit(cutoff).cast(dict(logs.dtypes)["timestamp"]))
    return kept.where(F.col("month") >= f"{cutoff:%Y_%m}") if "month" in logs.columns else kept
