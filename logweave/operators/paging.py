"""Newest-first pages by keyset."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from logweave.functions.text import iso_utc
from logweave.operators.filters import before, matching
from logweave.plans.requests import Filters, microseconds
from logweave.sources.storage import LogStore


def page(logs: DataFrame, filters: Filters, limit: int, after: tuple[int, int] | None = None) -> DataFrame:
    """At most ``limit`` rows in order of timestamp and id, both falling; a top-k, not a sort."""
    rows = matching(logs, filters)
    if after:
        rows = before(rows, *after)
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def newest(store: LogStore, filters: Filters, limit: int, after: tuple[int, int] | None = None, shown: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> list[Row]:
    """The rows of ``page`` over a store, month by month from the newest until the page is full.

    One month is read first, then twice as many each time, so a filter that few rows pass does not cost a job a month. Months
    outside the range or after the cursor are not read.
    """
    us = lambda text, name: None if text is None else microseconds(text, name)
    low, high = us(filters.since, "since"), us(filters.until, "until")
    month = lambda at: f"{dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=at):%Y_%m}"
    tops = [month(x) for x in (high, after and after[0]) if x is not None]
    seen = store.snapshot()
    left = [m for m in sorted(seen.get("logs", {}), reverse=True) if (low is None or m >= month(low)) and all(m <= t for t in tops)]
    found, take = [], 1
    while left and len(found) < limit:
        now, left, take = left[:take], left[take:], take * 2
        # at most ``limit`` rows come to the driver
        found += shown(page(store.published("logs", seen, now, needle=filters.q), filters, limit - len(found), after)).collect()
    return found


def rendered(rows: DataFrame) -> DataFrame:
    """The fields of a log record; ids become text only after they were ordered as numbers."""
    return rows.select(F.col("id").cast("string").alias("id"), iso_utc(F.col("timestamp")).alias("timestamp"), "level", "service", "message")
