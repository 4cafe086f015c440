"""Registered queries of the log operators, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import iso_utc, plain_number
from logweave.operators import aggregates, filters, paging
from logweave.plans.requests import BUCKETS, Filters
from logweave.schema import EVENT_LOGS_SQL, event_logs
from logweave.scratch import scratch
from logweave.sources.ingest import validated
from logweave.sources.storage import LogStore, retained
from logweave.streaming.ingest import MinuteCounts

SINCE, UNTIL = "2024-01-03T04:05:06.789Z", "2024-01-20T21:22:23.456789Z"
SQL_RANGE = """"timestamp" >= timestamp '2024-01-03 04:05:06.789' and "timestamp" < timestamp '2024-01-20 21:22:23.456789'"""
RANGE = {"since": SINCE, "until": UNTIL}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = build, sql


def counts_sql(bucket: str, group: str | None, where: str) -> str:
    key = group or "cast(null as varchar)"
    return f"""with {EVENT_LOGS_SQL} select time_bucket(interval '{BUCKETS[bucket]} seconds', "timestamp", timestamp '1970-01-01') as start, {key} as "group", count(*) as count from logs where {where} group by all"""


_stores: dict[tuple[str, str], LogStore] = {}


def stored(spark: SparkSession, sf_dir: str) -> LogStore:
    """``events`` as a store with its rollup, written once an application and input, in two commits."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = LogStore(spark, f"{scratch(spark)}/events", promoted=("k",), searchable=True)
        logs = event_logs(spark, sf_dir).withColumn("attributes", F.parse_json("props")).drop("props")
        early = F.col("timestamp") < F.lit("2024-01-12").cast("timestamp_ntz")
        for part in (logs.where(early), logs.where(~early)):
            store.load(part)
        _stores[key] = store
    return _stores[key]


def aggregate(name: str, bucket: str, group: str | None, where: str, rollup: bool = False, **given) -> None:
    asked = Filters(**(RANGE | given))

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        if rollup:
            store = stored(spark, sf_dir)
            counts = aggregates.count_cells(store.logs(), store.rollup, asked, bucket, group)
            return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))
        return aggregates.count_rows(event_logs(spark, sf_dir), asked, bucket, group)

    register(name, build, counts_sql(bucket, group, where))


for _bucket in BUCKETS:
    aggregate(f"agg_{_bucket}", _bucket, "service", SQL_RANGE)
    aggregate(f"rollup_{_bucket}", _bucket, "level", SQL_RANGE, rollup=True)
aggregate("agg_ungrouped", "1h", None, SQL_RANGE)
aggregate("agg_group_level", "1h", "level", SQL_RANGE)
aggregate("agg_service_filter", "1d", "level", f"{SQL_RANGE} and service = 'click'", service="click")
aggregate("agg_level_filter", "1d", "service", f"{SQL_RANGE} and level = 'warn'", level="warn")
aggregate("agg_search", "1d", "service", f"{SQL_RANGE} and contains(lower(message), 'user 14')", q="USER 14")
aggregate("agg_attribute", "1d", "service", f"{SQL_RANGE} and attr_k = '7'", attributes={"k": "7"})
aggregate("agg_unknown_service", "1d", None, f"{SQL_RANGE} and service = 'none'", service="none")
aggregate("agg_single_minute", "1m", "service", """"timestamp" >= timestamp '2024-01-05 10:00:10' and "timestamp" < timestamp '2024-01-05 10:00:50'""", since="2024-01-05T10:00:10Z", until="2024-01-05T10:00:50Z")
aggregate("agg_empty_range", "1m", None, "false", since="2024-01-05T10:00:10Z", until="2024-01-05T10:00:10Z")
aggregate("rollup_service_edges", "1h", None, f"{SQL_RANGE} and service = 'view'", rollup=True, service="view")
aggregate("rollup_search_falls_back", "1d", None, f"{SQL_RANGE} and contains(lower(message), 'user 9')", rollup=True, q="user 9")


def page(name: str, where: str, limit: int = 100, after: tuple[int, int] | None = None, ties: bool = False, **given) -> None:
    asked = Filters(**given)

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = event_logs(spark, sf_dir)
        if ties:
            logs = logs.withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
        return paging.rendered(paging.page(logs, asked, limit, after))

    at = "date_trunc('hour', \"timestamp\")" if ties else '"timestamp"'
    sql = f"""with {EVENT_LOGS_SQL}, seen as (select * replace (cast({at} as timestamp) as "timestamp") from logs)
select cast(id as varchar) as id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') as "timestamp", level, service, message from (select * from seen where {where} order by "timestamp" desc, id desc limit {limit})"""
    register(name, build, sql)


AFTER = (1705708800000000, 4000)  # 2024-01-20 00:00
page("page_first", "true")
page("page_service", "service = 'purchase'", service="purchase")
page("page_level", "level = 'info'", level="info")
page("page_range", SQL_RANGE, **RANGE)
page("page_search", "contains(lower(message), 'error user 3')", q="Error User 3")
page("page_search_literal", "contains(message, '%_')", q="%_")
page("page_attribute", "attr_k = '42'", attributes={"k": "42"})
page("page_attribute_missing", "false", attributes={"k": "42", "other": ""})
page("page_combined", f"{SQL_RANGE} and service = 'error' and level = 'error' and attr_k = '3'", service="error", level="error", attributes={"k": "3"}, **RANGE)
page("page_keyset", """("timestamp", id) < (timestamp '2024-01-20 00:00:00', 4000)""", after=AFTER)
page("page_ties", """("timestamp", id) < (timestamp '2024-01-20 00:00:00', 4000)""", limit=25, after=AFTER, ties=True)
page("page_no_rows_empty_service", "false", service="")

register(
    "minute_deltas",
    lambda spark, d: aggregates.minute_deltas(event_logs(spark, d)).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz")),
    f"""with {EVENT_LOGS_SQL} select cast(date_trunc('minute', "timestamp") as timestamp) as bucket_start, service, level, count(*) as count from logs group by all""",
)
register(
    "search_documents",
    lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").where(F.contains(F.lower("text"), F.lower(F.lit("LICENSE")))).groupBy("lang").agg(F.count("*").alias("count")),
    "select lang, count(*) as count from documents where contains(lower(text), 'license') group by lang",
)
register(
    "format_timestamp",
    lambda spark, d: event_logs(spark, d).select("id", iso_utc(F.col("timestamp")).alias("text")),
    f"""with {EVENT_LOGS_SQL} select id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') as text from logs""",
)
register(
    "attribute_numbers",
    lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", plain_number(F.col("l_quantity")).alias("quantity"), plain_number(F.col("l_discount")).alias("discount")),
    r"select l_orderkey, l_linenumber, regexp_replace(cast(l_quantity as varchar), '\.0$', '') as quantity, regexp_replace(cast(l_discount as varchar), '\.0$', '') as discount from lineitem",
)


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime as dt

    logs = retained(event_logs(spark, sf_dir), dt.datetime(2024, 2, 1, 10, 30, 30), 20)
    return aggregates.minute_deltas(logs).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


register(
    "retention_rollup",
    retention,
    f"""with {EVENT_LOGS_SQL} select cast(date_trunc('minute', "timestamp") as timestamp) as bucket_start, service, level, count(*) as count from logs where "timestamp" >= timestamp '2024-01-12 10:30:30' group by all""",
)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ingest bodies of one entry each; some levels, services and attributes are made invalid."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_id") % 10 == 3, "fatal").otherwise("info")
    service = F.when(F.col("event_id") % 10 == 5, "").otherwise(F.col("event_type"))
    attributes = F.when(F.col("event_id") % 10 == 7, '{"k":[1]}').otherwise(F.col("props"))
    body = F.format_string('{"logs":[{"timestamp":"%s","level":"%s","service":"%s","message":"m","attributes":%s}]}', iso_utc(F.col("ts")), level, service, attributes)
    return e.select(F.col("event_id").alias("batch"), body.alias("body"))


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime as dt

    # the table is one small file here: its bodies are dealt to all cores
    dealt = bodies(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    checked = validated(dealt, dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc))
    return checked.select("batch", "index", "reason", iso_utc(F.col("timestamp")).alias("timestamp"), "service", F.try_element_at("attr_text", F.lit("k")).alias("k"))


register(
    "ingest_validation",
    ingest,
    """select event_id as batch, 0::bigint as index,
       case event_id % 10 when 3 then 'invalid level: ''fatal''' when 5 then 'service must be a non-empty string' when 7 then 'attribute ''k'' must be a string, number, or boolean' end as reason,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as "timestamp", case when event_id % 10 = 5 then '' else event_type end as service,
       case when event_id % 10 = 7 then '[1]' else json_extract_string(props, '$.k') end as k from events""",
)


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute counts of ``events`` read as a stream, without a watermark: late rows count."""
    path, place = f"{sf_dir}/events.parquet", scratch(spark)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    logs = stream.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("service"), level.alias("level"))
    counts = MinuteCounts(spark, f"{place}/counts")
    logs.writeStream.foreachBatch(counts.add).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return counts.counts().withColumn("bucket_start", F.date_format("bucket_start", "yyyy-MM-dd HH:mm"))


register(
    "stream_minute_counts",
    streamed,
    "select strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') as bucket_start, event_type as service, case when event_type = 'error' then 'error' else 'info' end as level, count(*) as count from events group by all",
)


def stored_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page over the store, month by month, by a request with a cursor: parsed, signed and read back as a caller's."""
    from logweave.plans.requests import CursorCodec, filter_hash, one, parse_filters, parse_limit

    store, codec = stored(spark, sf_dir), CursorCodec(b"secret")
    request = {"service": "click", "limit": "50", "since": SINCE, "attr.k": "7", "unknown": "x"}
    request["cursor"] = codec.encode(*AFTER, filter_hash(parse_filters(request)))
    asked = parse_filters(request)
    rows = paging.newest(store, asked, parse_limit(request), codec.decode(one(request, "cursor"), filter_hash(asked)), paging.rendered)
    return spark.createDataFrame([tuple(r) for r in rows], "id string, timestamp string, level string, service string, message string")


register(
    "request_page",
    stored_page,
    f"""with {EVENT_LOGS_SQL} select cast(id as varchar) as id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') as "timestamp", level, service, message from (
    select * from logs where "timestamp" >= timestamp '2024-01-03 04:05:06.789' and service = 'click' and attr_k = '7' and ("timestamp", id) < (timestamp '2024-01-20 00:00:00', 4000) order by "timestamp" desc, id desc limit 50)""",
)
register(
    "page_with_attributes",
    lambda spark, d: paging.page(stored(spark, d).logs(), Filters(service="purchase", **RANGE), 100).select(F.col("id").cast("string").alias("id"), iso_utc(F.col("timestamp")).alias("timestamp"), "message", F.to_json("attributes").alias("attributes")),
    f"""with {EVENT_LOGS_SQL} select cast(id as varchar) as id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') as "timestamp", message, cast(json(props) as varchar) as attributes from logs join (select event_id, props from events) e on e.event_id = id
    where {SQL_RANGE} and service = 'purchase' order by logs."timestamp" desc, id desc limit 100""",
)
register(
    "attribute_promoted",
    lambda spark, d: filters.matching(stored(spark, d).logs(), Filters(attributes={"k": "42"})).select("id", "service", F.date_format("timestamp", "yyyy-MM").alias("month")),
    f"""with {EVENT_LOGS_SQL} select id, service, strftime("timestamp", '%Y-%m') as month from logs where attr_k = '42'""",
)
register(
    "stored_search",
    lambda spark, d: filters.matching(stored(spark, d).logs(needle="Error USER 3"), Filters(q="Error USER 3")).select("id", "message"),
    f"""with {EVENT_LOGS_SQL} select id, message from logs where contains(lower(message), 'error user 3')""",
)
for _unit, _part in aggregates.UNITS.items():
    register(
        f"stored_rollup_{_unit}",
        lambda spark, d, unit=_unit: stored(spark, d).rollup(unit).select(F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), "service", "level", "count"),
        f"""with {EVENT_LOGS_SQL} select cast(date_trunc('{_part}', "timestamp") as timestamp) as bucket_start, service, level, count(*) as count from logs group by all""",
    )


def retained_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of ``events``, a retention pass, a compaction and a vacuum: what is left of its rows and of its rollup, by minute."""
    import datetime as dt

    store, logs = LogStore(spark, f"{scratch(spark)}/events"), event_logs(spark, sf_dir).withColumn("attributes", F.parse_json("props"))
    for odd in (0, 1):
        store.load(logs.where(F.col("id") % 2 == odd))
    store.retain(dt.datetime(2024, 2, 1, 10, 30, 30), 20)
    store.compact(most=1)
    store.vacuum(grace=0)
    rows = aggregates.minute_deltas(store.logs()).withColumnRenamed("count", "rows")
    both = store.rollup().drop("month").join(rows, ["bucket_start", "service", "level"], "full")
    return both.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


register(
    "retention_store",
    retained_store,
    f"""with {EVENT_LOGS_SQL} select cast(date_trunc('minute', "timestamp") as timestamp) as bucket_start, service, level, count(*) as count, count(*) as rows from logs where "timestamp" >= timestamp '2024-01-12 10:30:30' group by all""",
)

#: What is wrong with an entry, by its event's id modulo their number: the field, its JSON, and what is said of it.
FAULTS = [
    ("level", '"info"', None), ("level", "7.50", "invalid level: '7.5'"), ("level", "null", "invalid level: 'null'"), ("level", '[null,"a[b]",[1,2]]', "invalid level: ',a[b],1,2'"), ("level", '{"a":1}', "invalid level: '[object Object]'"),
    ("timestamp", '"2024-01-01 00:00:00"', "timestamp must be a valid ISO 8601 value with an explicit timezone"), ("timestamp", "17", "timestamp must be a valid ISO 8601 value with an explicit timezone"),
    ("timestamp", '"2024-02-30T00:00:00Z"', "timestamp must be a valid ISO 8601 timestamp"), ("timestamp", '"2024-03-01T00:05:00.001Z"', "timestamp must not be more than five minutes in the future"),
    ("timestamp", '"2023-11-01T23:59:59Z"', "timestamp is older than the retention window"), ("service", '""', "service must be a non-empty string"), ("service", "true", "service must be a non-empty string"),
    ("service", f'"{"s" * 256}"', "service must be at most 255 characters"), ("service", '"a\\u0000"', "service contains an unsupported null character"), ("message", "[]", "message must be a non-empty string"),
    ("message", '"a\\u0000b"', "message contains an unsupported null character"), ("attributes", "null", "attributes must be a flat object"), ("attributes", '"x"', "attributes must be a flat object"),
    ("attributes", '{"k":{"x":1}}', "attribute 'k' must be a string, number, or boolean"), ("attributes", '{"k":null}', "attribute 'k' must be a string, number, or boolean"),
    ("attributes", '{"k":"\\u0000"}', "attribute 'k' contains an unsupported null character"), ("attributes", '{"a\\u0000":1}', "attribute keys cannot contain a null character"), ("attributes", "{}", None),
]


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an entry with one of FAULTS, twenty entries a body, published to a store: its rejects, and by service what was accepted."""
    import datetime as dt

    from functools import reduce

    e, plain = spark.read.parquet(f"{sf_dir}/events.parquet"), {"timestamp": '"2024-02-01T00:00:00Z"', "level": '"warn"', "service": '"api"', "message": '"m"', "attributes": '{"a":1}'}
    kind = F.col("event_id") % len(FAULTS)
    made = ["{" + ",".join(f'"{k}":{value if k == field else v}' for k, v in plain.items()) + "}" for field, value, _ in FAULTS]
    one = reduce(lambda found, i: found.when(kind == i, made[i]), range(1, len(made)), F.when(kind == 0, made[0]))
    body = F.concat(F.lit('{"logs":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("entry")))), lambda x: x["entry"]), ","), F.lit("]}"))
    bodies = e.groupBy(F.floor(F.col("event_id") / 20).alias("batch")).agg(body.alias("body"))
    store = LogStore(spark, f"{scratch(spark)}/reasons")
    store.append(None, validated(bodies, dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc), 120, bodies_too=True))
    good = store.logs().groupBy("service").count().select(F.lit(-1).cast("long").alias("batch"), F.lit(-1).cast("long").alias("index"), F.concat(F.lit("accepted of "), "service", F.lit(": "), F.col("count").cast("string")).alias("reason"))
    return store.rejects().select("batch", "index", "reason").unionByName(good)


def reasons_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cases = " ".join(f"when {i} then {quoted(reason)}" for i, (_, _, reason) in enumerate(FAULTS) if reason)
    return f"""with entries as (select event_id, event_id // 20 as batch, row_number() over (partition by event_id // 20 order by event_id) - 1 as index, case event_id % {len(FAULTS)} {cases} end as reason from events)
select batch, index, reason from entries where reason is not null
union all select -1, -1, 'accepted of api: ' || count(*) from entries where reason is null"""


register("ingest_reasons", reasons, reasons_sql())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rollup_1h"](spark, sf_dir)
