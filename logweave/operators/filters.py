"""Row predicates. Ranges and keysets are written in the form that reaches the Parquet reader."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.plans.requests import Filters, microseconds

EPOCH = dt.datetime(1970, 1, 1)


def instant(us: int, zoned: bool) -> Column:
    """A literal of the column's own type, so that comparisons are pushed down."""
    at = F.lit(EPOCH + dt.timedelta(microseconds=us)).cast("timestamp_ntz")
    return at if not zoned else F.lit((EPOCH + dt.timedelta(microseconds=us)).replace(tzinfo=dt.timezone.utc))


def in_range(logs: DataFrame, since_us: int | None, until_us: int | None, column: str = "timestamp") -> DataFrame:
    """since <= column < until; months outside are not read where the table is partitioned by month."""
    zoned = dict(logs.dtypes).get(column) == "timestamp"
    for us, name in ((since_us, "since"), (until_us, "until")):
        if us is not None:
            at = EPOCH + dt.timedelta(microseconds=us)
            logs = logs.where(F.col(column) >= instant(us, zoned) if name == "since" else F.col(column) < instant(us, zoned))
            if "month" in logs.columns:
                logs = logs.where(F.col("month") >= f"{at:%Y_%m}" if name == "since" else F.col("month") <= f"{at:%Y_%m}")
    return logs


def in_ranges(logs: DataFrame, ranges: list[tuple[int, int]], column: str = "timestamp") -> DataFrame:
    """Rows in one of a few half-open ranges, read in one scan; months that none of them touches are not read."""
    if len(ranges) == 1:
        return in_range(logs, *ranges[0], column)
    zoned = dict(logs.dtypes).get(column) == "timestamp"
    inside, months = F.lit(False), F.lit(False)
    for since, until in ranges:
        inside |= (F.col(column) >= instant(since, zoned)) & (F.col(column) < instant(until, zoned))
        low, high = (f"{EPOCH + dt.timedelta(microseconds=us):%Y_%m}" for us in (since, until))
        months |= F.col("month").between(low, high) if "month" in logs.columns else F.lit(True)
    return logs.where(inside).where(months)


def matching(logs: DataFrame, filters: Filters) -> DataFrame:
    """Rows that pass all filters; an empty ``q`` passes all, an empty service none."""
    out = in_range(logs, *(microseconds(x, n) if x is not None else None for x, n in ((filters.since, "since"), (filters.until, "until"))))
    if filters.service is not None:
        out = out.where(F.col("service") == filters.service)
    if filters.level is not None:
        out = out.where(F.col("level") == filters.level)
    if filters.q is not None:
        out = out.where(F.contains(F.lower("message"), F.lower(F.lit(filters.q))))
    for key, value in filters.attributes.items():
        if f"attr_{key}" in logs.columns:  # a promoted key: reaches the reader's statistics and Bloom filter
            out = out.where(F.col(f"`attr_{key}`") == value)
        else:
            out = out.where(F.try_element_at("attr_text", F.lit(key)) == value)
    return out


def before(logs: DataFrame, timestamp_us: int, row_id: int) -> DataFrame:
    """Rows after (timestamp, id) on a newest-first page."""
    at = instant(timestamp_us, dict(logs.dtypes)["timestamp"] == "timestamp")
    return logs.where(F.col("timestamp") <= at).where((F.col("timestamp") < at) | (F.col("id") < row_id))
