import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from logweave.config import EngineConfig, parse_byte_size
from logweave.engine import Engine
from logweave.errors import EngineError
from logweave.functions.text import plain_number
from logweave.operators import aggregates
from logweave.plans.requests import CursorCodec, Filters, edge_slices, filter_hash, microseconds, parse_aggregate, parse_filters, parse_limit
from logweave.sources.ingest import rejected, validated
from logweave.sources.storage import LogStore
from logweave.streaming.ingest import ingest_stream

NOW = dt.datetime(2024, 6, 1, 12, tzinfo=dt.timezone.utc)


def entry(**changes):
    out = {"timestamp": "2024-05-31T10:00:00.000Z", "level": "info", "service": "api", "message": "hello"} | changes
    return {k: v for k, v in out.items() if v is not ...}


def reasons(spark, entries, text=None):
    bodies = spark.createDataFrame([(1, text or json.dumps({"logs": entries}))], "batch long, body string")
    checked = validated(bodies, NOW)
    return {r["index"]: r["reason"] for r in checked.select("index", "reason").collect()}


def test_reasons_and_bounds(spark):
    cases = [
        (entry(attributes={"a": "x", "n": 1, "b": True}), None),
        (entry(level="fatal"), "invalid level: 'fatal'"),
        (None, "log entry must be an object"),
        (entry(service="s" * 256), "service must be at most 255 characters"),
        (entry(service="s" * 255), None),
        (entry(message="m" * 65_537), "message must be at most 65536 characters"),
        (entry(message="m" * 65_536), None),
        (entry(attributes={"k": {"x": 1}}), "attribute 'k' must be a string, number, or boolean"),
        (entry(attributes={"k": None}), "attribute 'k' must be a string, number, or boolean"),
        (entry(message="a\0b"), "message contains an unsupported null character"),
        (entry(timestamp="2024-06-01T12:05:00.001Z"), "timestamp must not be more than five minutes in the future"),
        (entry(timestamp="2024-06-01T12:05:00.000Z"), None),
        (entry(timestamp="2024-05-31 10:00:00"), "timestamp must be a valid ISO 8601 value with an explicit timezone"),
        (entry(timestamp="2024-02-30T10:00:00Z"), "timestamp must be a valid ISO 8601 timestamp"),
        (entry(timestamp=5), "timestamp must be a valid ISO 8601 value with an explicit timezone"),
        (entry(level=...), "invalid level: 'undefined'"),
        (entry(level=None), "invalid level: 'null'"),
        (entry(level=3), "invalid level: '3'"),
        (entry(service=7), "service must be a non-empty string"),
        (entry(message=""), "message must be a non-empty string"),
        (entry(attributes=None), "attributes must be a flat object"),
        (entry(attributes=[1]), "attributes must be a flat object"),
        (entry(attributes={"a\0": 1}), "attribute keys cannot contain a null character"),
        (entry(attributes={"a": "x\0"}), "attribute 'a' contains an unsupported null character"),
    ]
    found = reasons(spark, [c for c, _ in cases])
    assert [found[i] for i in range(len(cases))] == [r for _, r in cases]


def test_infinite_number_and_bad_bodies(spark):
    text = '{"logs":[' + json.dumps(entry())[:-1] + ',"attributes":{"k":1e999}}]}'
    assert reasons(spark, [], text)[0] in ("attribute 'k' must be a finite number", "attribute 'k' must be a string, number, or boolean")
    assert reasons(spark, [], "[]") == {}
    assert reasons(spark, [], "{") == {}


def test_attribute_text(spark):
    bodies = spark.createDataFrame([(1, json.dumps({"logs": [entry(attributes={"i": 1.0, "e": 1e-7, "big": 1e21, "t": True, "s": "1.0", "m": -2.5})]}))], "batch long, body string")
    got = validated(bodies, NOW).select("attr_text").first()[0]
    assert got == {"i": "1", "e": "0.0000001", "big": "1000000000000000000000", "t": "true", "s": "1.0", "m": "-2.5"}


@pytest.mark.parametrize("value, text", [(0.0, "0"), (-0.0, "0"), (12.5, "12.5"), (1e22, "10000000000000000000000"), (1.5e-9, "0.0000000015"), (123456789.25, "123456789.25"), (-3.0, "-3")])
def test_plain_number(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(plain_number(F.col("v"))).first()[0] == text


def test_plain_number_runs_no_pattern(spark):
    values = {0.002: "0.002", 0.001: "0.001", 1e7: "10000000", 9999999.0: "9999999", 100.0: "100", -0.05: "-0.05", 1e-5: "0.00001", 12345678.5: "12345678.5", 5e-324: "0." + "0" * 323 + "49", None: None}
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", plain_number(F.col("v")).alias("text"))
    assert {r["v"]: r["text"] for r in found.collect()} == values
    # six patterns a value took most of the time over a large table
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_parameters():
    assert parse_filters({"service": "", "attr.k": "", "junk": ["a"]}) == Filters(service="", attributes={"k": ""})
    assert parse_limit({}) == 100 and parse_limit({"limit": "1000"}) == 1000
    for query, message in [
        ({"service": ["a", "b"]}, "service must be specified once"), ({"level": "x"}, "unsupported log level"), ({"since": "now"}, "since must be a valid ISO 8601 timestamp"),
        ({"since": "2024-01-01T00:00:00.000000002Z", "until": "2024-01-01T00:00:00.000000001Z"}, "until must not be earlier than since"), ({"attr.": "v"}, "attribute filter key is invalid"),
    ]:
        with pytest.raises(EngineError, match=message):
            parse_filters(query)
    for query, message in [({}, "since and until are required"), ({"since": "2024-01-01T00:00:00Z", "until": "2024-01-01T00:00:00Z"}, "bucket must be one of")]:
        with pytest.raises(EngineError, match=message):
            parse_aggregate(query)
    assert microseconds("2024-01-01T00:00:00.0000005Z") % 10 == 0 and microseconds("2024-01-01T00:00:00.0000015Z") % 10 == 2
    assert edge_slices(90_000_000, 200_000_000) == (120_000_000, 180_000_000, True, True)
    assert parse_byte_size("4mb") == 4 * 1024**2
    with pytest.raises(ValueError):
        EngineConfig.from_env({"RETENTION_DAYS": "0"})


def test_cursor():
    codec, bound = CursorCodec(b"secret"), filter_hash(Filters(service="a"))
    text = codec.encode(1700000000123456, 9007199254740993, bound)
    assert codec.decode(text, bound) == (1700000000123456, 9007199254740993)
    for bad, message in [("x", "invalid cursor"), (text[:-1] + ("A" if text[-1] != "A" else "B"), "signature")]:
        with pytest.raises(EngineError, match=message):
            codec.decode(bad, bound)
    with pytest.raises(EngineError, match="active filters"):
        codec.decode(text, filter_hash(Filters(service="b")))


def test_rollup_with_edges_equals_rows(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(milliseconds=rng.choice([0, 59_999, 60_000, 120_000, rng.randrange(900_000)])), rng.choice("abc"), rng.choice(["info", "error"])) for i in range(400)]
    logs = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, service string, level string").cache()
    rollup = aggregates.minute_deltas(logs).cache()
    iso = lambda ms: (base + dt.timedelta(milliseconds=ms)).isoformat(timespec="milliseconds") + "Z"
    for _ in range(12):
        low, high = sorted(rng.choice([0, 60_000, 120_000, rng.randrange(-50_000, 950_000)]) for _ in range(2))
        asked = Filters(service=rng.choice([None, "a"]), since=iso(low), until=iso(high))
        group = rng.choice([None, "level"])
        pick = lambda df: sorted(map(str, df.collect()))
        assert pick(aggregates.count_rollup(logs, rollup, asked, "5m", group)) == pick(aggregates.count_rows(logs, asked, "5m", group))


def test_grouped_totals_equal_the_ungrouped_total(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=i * 37 % 4000), "abc"[i % 3], ["info", "error"][i % 2]) for i in range(200)]
    logs = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, service string, level string")
    asked = Filters(since="2024-01-01T00:00:30Z", until="2024-01-01T01:00:10Z")
    sums = [{r["start"]: r["n"] for r in aggregates.count_rows(logs, asked, "5m", group).groupBy("start").agg(F.sum("count").alias("n")).collect()} for group in (None, "level", "service")]
    assert sums[0] == sums[1] == sums[2] and sum(sums[0].values()) == sum(base + dt.timedelta(seconds=30) <= t < base + dt.timedelta(seconds=3610) for _, t, _, _ in rows)


def test_engine_ingest_walk_and_retention(spark, tmp_path):
    engine = Engine(spark, EngineConfig(warehouse=str(tmp_path / "w"), cursor_secret=b"s"))
    same = [entry(message=f"m{i} 100%_", attributes={"n": i}) for i in range(25)]
    assert engine.ingest(json.dumps({"logs": same + [entry(level="no")]}), NOW) == {"accepted": 25, "rejected": [{"index": 25, "reason": "invalid level: 'no'"}]}
    engine.ingest(json.dumps({"logs": [entry(timestamp="2024-01-01T00:00:30Z", message="old")]}), NOW)
    seen, cursor = [], None
    while True:
        page = engine.list_logs({"limit": "9", "q": "100%_"} | ({"cursor": cursor} if cursor else {}))
        seen += [int(x["id"]) for x in page["logs"]]
        cursor = page["next_cursor"]
        if not cursor:
            break
    assert seen == sorted(seen, reverse=True) and len(set(seen)) == 25
    asked = {"since": "2024-01-01T00:00:00Z", "until": "2024-06-01T00:00:00Z", "bucket": "1d", "group_by": "service"}
    assert [b["count"] for b in engine.aggregate(asked)["buckets"]] == [1, 25]
    engine.retain(NOW)
    assert [b["count"] for b in engine.aggregate(asked)["buckets"]] == [25]
    assert sorted(x["attributes"]["n"] for x in engine.list_logs({"q": "100%_"})["logs"]) == list(range(25))
    with pytest.raises(EngineError) as bad:
        engine.ingest("{", NOW)
    assert bad.value.status == 400
    for entries, rejected in (([], []), ([entry(level="no")], [{"index": 0, "reason": "invalid level: 'no'"}])):
        with pytest.raises(EngineError) as bad:
            engine.ingest(json.dumps({"logs": entries}), NOW)
        assert bad.value.status == 400 and bad.value.body == {"accepted": 0, "rejected": rejected}


def test_stream_commits_each_batch_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text(json.dumps({"logs": [entry(message=f"{i}"), entry(timestamp="2020-01-01T00:00:00Z")]}))
    store = LogStore(spark, str(tmp_path / "w"))
    ingest_stream(spark, str(source), store, str(tmp_path / "c")).awaitTermination()
    assert store.logs().count() == 6 and store.logs().select("id").distinct().count() == 6
    store.append(0, store.logs().limit(0).withColumn("batch", F.lit(1)).withColumn("index", F.lit(0)))
    assert store.rollup().agg(F.sum("count")).first()[0] == 6


def test_filters_reach_the_reader(spark, tmp_path):
    from logweave.operators.filters import matching

    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 5), "a", "info", "2024_01"), (2, dt.datetime(2024, 2, 5), "a", "info", "2024_02")], "id long, timestamp timestamp, service string, level string, month string")
    rows.write.partitionBy("month").parquet(str(tmp_path / "t"))
    found = matching(spark.read.parquet(str(tmp_path / "t")), Filters(service="a", since="2024-02-01T00:00:00Z"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "2024_02" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert rejected(validated(spark.createDataFrame([], "batch long, body string"), NOW)).count() == 0


def test_streams_and_engine_share_a_store(spark, tmp_path):
    engine = Engine(spark, EngineConfig(warehouse=str(tmp_path / "w")))
    now = dt.datetime.now(dt.timezone.utc)
    body = lambda name: json.dumps({"logs": [entry(service=name, timestamp=f"{now:%Y-%m-%dT%H:%M:%S}.000Z")]})
    seen = lambda: sorted(r["service"] for r in engine.store.logs().select("service").collect())

    def stream(name, *services):
        (tmp_path / name).mkdir(exist_ok=True)
        for s in services:
            (tmp_path / name / f"{s}.json").write_text(body(s))
        ingest_stream(spark, str(tmp_path / name), engine.store, str(tmp_path / f"{name}_checkpoint")).awaitTermination()

    engine.ingest(body("engine"))
    stream("one", "a")
    stream("two", "b")
    assert seen() == ["a", "b", "engine"]
    engine.retain(now)
    stream("one", "c")
    engine.ingest(body("late"))
    assert seen() == ["a", "b", "c", "engine", "late"]
    writer = engine.store.every_commit().where("writer is not null").orderBy("batch").first()
    engine.store.append_once(writer["writer"], writer["number"], None)  # a replay after retention
    assert seen() == ["a", "b", "c", "engine", "late"]
