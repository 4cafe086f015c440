"""Counts by time bucket, from rows or from the minute rollup with raw edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.errors import EngineError
from logweave.operators.filters import in_range, in_ranges, matching
from logweave.plans.requests import BUCKETS, Filters, edge_slices, microseconds, whole_cells

MOST = 2**53 - 1
#: Cells that a rollup holds, smallest first.
UNITS = {"1m": "minute", "1h": "hour", "1d": "day"}


def group_column(group: str | None) -> Column:
    return (F.col(group) if group else F.lit(None).cast("string")).alias("group")


def bucketed(rows: DataFrame, column: str, bucket: str, group: str | None, count: Column) -> DataFrame:
    start = F.window(column, f"{BUCKETS[bucket]} seconds")["start"].alias("start")
    return rows.where(F.col(column).isNotNull()).groupBy(start, group_column(group)).agg(count.cast("bigint").alias("count"))


def count_rows(logs: DataFrame, filters: Filters, bucket: str, group: str | None = None) -> DataFrame:
    """start, group, count over the rows themselves."""
    return bucketed(matching(logs, filters), "timestamp", bucket, group, F.count("*"))


def minute_deltas(logs: DataFrame) -> DataFrame:
    """bucket_start, service, level, count of a batch: what is appended to the rollup."""
    return logs.groupBy(F.date_trunc("minute", "timestamp").alias("bucket_start"), "service", "level").agg(F.count("*").alias("count"))


def cells(logs: DataFrame) -> DataFrame:
    """unit, bucket_start, service, level, count of the minutes, hours and days of a batch, larger cells from smaller ones."""
    starts = F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(part, "bucket_start").alias("start")) for u, part in UNITS.items()])
    each = minute_deltas(logs).select(F.explode(starts).alias("cell"), "service", "level", "count")
    return each.groupBy(F.col("cell.unit").alias("unit"), F.col("cell.start").alias("bucket_start"), "service", "level").agg(F.sum("count").alias("count"))


def count_cells(logs: DataFrame, rollup: Callable[[str], DataFrame], filters: Filters, bucket: str, group: str | None = None) -> DataFrame:
    """The counts of ``count_rows`` from few whole cells: days inside the range, hours and minutes at its ends, rows of its broken minutes.

    rollup gives the cells of a unit; cells larger than the bucket are not read, nor are units of which none is needed.
    """
    if filters.q is not None or filters.attributes:
        return count_rows(logs, filters, bucket, group)
    since, until = microseconds(filters.since, "since"), microseconds(filters.until, "until")
    exact, parts = Filters(filters.service, filters.level), []
    for unit, ranges in whole_cells(since, until, bucket, tuple(UNITS)):
        if unit is None:
            parts.append(bucketed(in_ranges(matching(logs, exact), ranges), "timestamp", bucket, group, F.count("*")))
        else:
            parts.append(bucketed(in_ranges(matching(rollup(unit), exact), ranges, "bucket_start"), "bucket_start", bucket, group, F.sum("count")))
    if not parts:
        return count_rows(logs, filters, bucket, group).where("false")
    return reduce(DataFrame.unionByName, parts).groupBy("start", "group").agg(F.sum("count").alias("count"))


def count_rollup(logs: DataFrame, rollup: DataFrame, filters: Filters, bucket: str, group: str | None = None) -> DataFrame:
    """The counts of ``count_rows``: whole minutes from the rollup, the range's edges from rows."""
    if filters.q is not None or filters.attributes:
        return count_rows(logs, filters, bucket, group)
    since, until = microseconds(filters.since, "since"), microseconds(filters.until, "until")
    first, last, left, right = edge_slices(since, until)
    if first >= last:
        return count_rows(logs, filters, bucket, group)
    exact = Filters(filters.service, filters.level)
    inner = matching(in_range(rollup, first, last, "bucket_start"), exact)
    # the rollup keeps its column's type, so edges are brought to it
    out = bucketed(inner, "bucket_start", bucket, group, F.sum("count"))
    for low, high, there in ((since, first, left), (last, until, right)):
        if there:
            out = out.unionByName(bucketed(in_range(matching(logs, exact), low, high), "timestamp", bucket, group, F.count("*")))
    return out.groupBy("start", "group").agg(F.sum("count").alias("count"))


def ordered(counts: DataFrame) -> DataFrame:
    return counts.orderBy("start", F.asc_nulls_first("group"))


def safe_count(value: int) -> int:
    if not 0 <= value <= MOST:
        raise EngineError(500, "count is out of range")
    return value
