"""One object for a caller: ingest, list, aggregate, retain."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logweave.config import EngineConfig
from logweave.errors import EngineError, guarded
from logweave.functions.text import iso_utc
from logweave.operators import aggregates, paging
from logweave.plans.requests import CursorCodec, filter_hash, one, parse_aggregate, parse_filters, parse_limit
from logweave.sources.ingest import rejected, validated
from logweave.sources.storage import LogStore


#: What a caller is told of a body that is refused as a whole.
TOO_LARGE, NOTHING_ACCEPTED = "request body is too large", "no log entry was accepted"


class Engine:
    """Errors are EngineErrors; reads and ingest are cancelled after ``config.deadline_seconds``."""

    def __init__(self, spark: SparkSession, config: EngineConfig):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.config = spark, config
        self.store, self.cursors = LogStore(spark, config.warehouse, config.promoted_attributes, config.searchable), CursorCodec(config.cursor_secret)

    def guarded(self):
        return guarded(self.spark.sparkContext, self.config.deadline_seconds)

    def ingest(self, body: str, now: dt.datetime | None = None) -> dict:
        """Publish a body's valid entries; rejects by index. A return means that they can be read.

        A body of which nothing is accepted is an error of status 400 that carries what would be returned.
        """
        if len(body.encode()) > self.config.body_limit:
            raise EngineError(413, TOO_LARGE)
        now = now or dt.datetime.now(dt.timezone.utc)
        with self.guarded():
            checked = validated(self.spark.createDataFrame([(0, body)], "batch long, body string"), now, self.config.max_log_age_days, bodies_too=True).persist()
            try:
                bad = [{"index": r["index"], "reason": r["reason"]} for r in rejected(checked).orderBy("index").collect()]  # one body's
                if bad and bad[0]["index"] is None:
                    raise EngineError(400, bad[0]["reason"])
                good = self.store.append(None, checked.where("reason is null"))
            finally:
                checked.unpersist()
        found = {"accepted": good, "rejected": bad}
        if not good:
            raise EngineError(400, NOTHING_ACCEPTED, body=found)
        return found

    def list_logs(self, query: Mapping[str, object]) -> dict:
        filters, limit = parse_filters(query), parse_limit(query)
        bound, cursor = filter_hash(filters), one(query, "cursor")
        after = self.cursors.decode(cursor, bound) if cursor is not None else None
        shown = lambda rows: rows.select("id", F.unix_micros("timestamp").alias("us"), iso_utc(F.col("timestamp")).alias("timestamp"), "level", "service", "message", F.to_json("attributes").alias("attributes"))
        with self.guarded():
            found = paging.newest(self.store, filters, limit + 1, after, shown)
        logs = [{"id": str(r["id"]), **{k: r[k] for k in ("timestamp", "level", "service", "message")}, "attributes": json.loads(r["attributes"])} for r in found[:limit]]
        last = found[limit - 1] if len(found) > limit else None
        return {"logs": logs, "next_cursor": self.cursors.encode(last["us"], last["id"], bound) if last else None}

    def aggregate(self, query: Mapping[str, object]) -> dict:
        filters, bucket, group = parse_aggregate(query)
        with self.guarded():
            seen = self.store.snapshot()
            counts = aggregates.ordered(aggregates.count_cells(self.store.published("logs", seen, needle=filters.q), lambda unit: self.store.rollup(unit, seen=seen), filters, bucket, group))
            rows = counts.select(iso_utc(F.col("start")).alias("start"), "group", "count").toLocalIterator()
            return {"buckets": [{"start": r["start"], "group": r["group"], "count": aggregates.safe_count(r["count"])} for r in rows]}

    def retain(self, now: dt.datetime | None = None) -> None:
        """Drop what is older than the retention, then what no snapshot names any more."""
        with guarded(self.spark.sparkContext):
            self.store.retain(now or dt.datetime.now(dt.timezone.utc), self.config.retention_days)
            self.store.compact()
            self.store.vacuum()
