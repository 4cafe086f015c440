"""The store: writers at once, retention by months, folded counts, cells, pages by months, promoted keys, errors."""

import datetime as dt
import json
import os
import random
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from logweave.config import EngineConfig
from logweave.engine import Engine
from logweave.errors import EngineError, guarded
from logweave.operators import aggregates, paging
from logweave.operators.filters import matching
from logweave.plans.requests import BUCKETS, Filters, whole_cells
from logweave.sources.ingest import entry_bytes, validated
from logweave.sources.snapshots import Conflict, Snapshots
from logweave.sources.storage import LogStore, bit, bits_of, grams
from logweave.streaming.ingest import MinuteCounts, ingest_stream

NOW = dt.datetime(2024, 6, 1, 12, tzinfo=dt.timezone.utc)


def entry(**changes):
    return {"timestamp": "2024-05-31T10:00:00.000Z", "level": "info", "service": "api", "message": "hello"} | changes


def checked(spark, bodies, both=True):
    frame = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps({"logs": b})) for i, b in enumerate(bodies)], "batch long, body string")
    return validated(frame, NOW, bodies_too=both)


def months_store(spark, path, months=4, days=(3, 20), **given):
    """A store of one commit a month, several rows a day."""
    store = LogStore(spark, path, **given)
    for m in range(1, months + 1):
        store.append(None, checked(spark, [[entry(timestamp=f"2024-{m:02d}-{d:02d}T0{h}:00:30.5Z", message=f"m{m} d{d}", attributes={"trace": f"t{m}-{d}-{h}"}) for d in days for h in range(3)]]))
    return store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_two_writers_a_stream_and_retention_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "w"), []
    old = LogStore(spark, path)
    old.append(None, checked(spark, [[entry(timestamp="2024-01-01T00:00:00Z", message="expired"), entry(timestamp="2024-05-02T00:00:00Z", message="expired too"), entry(message="stays")]]))

    def writer(name):
        try:
            store = LogStore(spark, path)
            for i in range(3):
                store.append(store.next_batch(), checked(spark, [[entry(service=name, message=f"{i}-{k}") for k in range(2 + i)]]))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    def keeper():
        try:
            for _ in range(3):
                LogStore(spark, path).retain(NOW, 10)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    def stream():
        try:
            (tmp_path / "in").mkdir()
            for i in range(3):
                (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"logs": [entry(service="stream", message=str(i))]}))
            ingest_stream(spark, str(tmp_path / "in"), LogStore(spark, path), str(tmp_path / "c"), max_files=1).awaitTermination()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=f, args=a) for f, a in ((writer, ("a",)), (writer, ("b",)), (keeper, ()), (stream, ()))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    store = LogStore(spark, path)
    counts = {r["service"]: r["count"] for r in store.logs().groupBy("service").count().collect()}
    assert counts == {"a": 9, "b": 9, "stream": 3, "api": 1}
    assert store.logs().select("id").distinct().count() == 22
    for unit in aggregates.UNITS:
        assert store.rollup(unit).agg(F.sum("count")).first()[0] == 22


def test_one_of_many_gets_a_number(spark, tmp_path):
    files, won = Snapshots(spark, str(tmp_path)).files, []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if files.create("x.json", str(i)) else None) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read("x.json") == str(won[0]) and os.listdir(tmp_path).count("x.json") == 1
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".part")]
    assert not files.create("x.json", "later") and files.read("x.json") == str(won[0])
    # the way of other file systems: renaming does not overwrite either
    files.fs = type("Other", (), {"getScheme": lambda self: "hdfs", "create": files.fs.create, "exists": files.fs.exists, "delete": files.fs.delete, "open": files.fs.open})()
    assert files.create("y.json", "first") and not files.create("y.json", "second") and files.read("y.json") == "first"


def test_retention_writes_one_month_and_vacuum_follows(spark, tmp_path):
    store = months_store(spark, str(tmp_path))
    before, version = store.logs().count(), store.snapshots.latest()[0]
    folders = set(os.listdir(tmp_path / "logs"))
    store.retain(dt.datetime(2024, 4, 10, 0, 0, 31, tzinfo=dt.timezone.utc), 36)  # cut in the third of its month March
    cut = dt.datetime(2024, 3, 5, 0, 0, 31)
    assert store.months() == ["2024_03", "2024_04"] and store.logs().where(F.col("timestamp") < F.lit(cut)).count() == 0
    assert store.logs().count() == 3 + 6 and store.rollup("1d").agg(F.sum("count")).first()[0] == 9
    written = set(os.listdir(tmp_path / "logs")) - folders
    assert len(written) == 1 and [d for d in os.listdir(tmp_path / "logs" / written.pop()) if d.startswith("month=")] == ["month=2024_03"]
    assert store.logs(version).count() == before  # an older snapshot is whole
    at = store.snapshots.latest()[0]
    store.retain(dt.datetime(2024, 4, 10, 0, 0, 31, tzinfo=dt.timezone.utc), 36)
    assert store.snapshots.latest()[0] == at  # nothing left to do, nothing written
    assert store.vacuum(grace=3600) == []
    gone = store.vacuum(grace=0)
    assert len([g for g in gone if g.startswith("logs/")]) == 3 and store.logs().count() == 9
    with pytest.raises(Exception):
        store.snapshots.at(version)
    with pytest.raises(Conflict):
        store.swapped(store.snapshot(), "2024_03", {"not there"}, [])


def test_compaction_keeps_rows_and_leaves_others_alone(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    for i in range(5):
        store.append(None, checked(spark, [[entry(message=str(i)), entry(timestamp="2024-04-01T00:00:00Z", message=f"april {i}")]]))
    rows = lambda: sorted(tuple(r) for r in store.logs().select("id", "message", "timestamp").collect())
    before = rows()
    store.compact(most=4)
    assert rows() == before and {len(store.folders(store.snapshot(), "logs", m)) for m in store.months()} == {1}
    assert store.rollup("1h").agg(F.sum("count")).first()[0] == 10
    store.compact(most=4)
    assert rows() == before


def test_ids_are_gapless_in_order_and_need_no_single_partition(spark, tmp_path):
    n = 1_000_000
    rows = spark.range(0, n, 1, 16).select(F.col("id").alias("batch"), F.lit(0).cast("long").alias("index"), F.timestamp_seconds(F.lit(1717149600) + F.col("id") % 1000).alias("timestamp"), F.lit("info").alias("level"), F.lit("s").alias("service"), F.col("id").cast("string").alias("message"), F.parse_json(F.lit("{}")).alias("attributes"), F.expr("cast(map() as map<string,string>)").alias("attr_text"))
    rows = rows.withColumn("reason", F.when(F.col("batch") % 7 == 0, "no"))
    store = LogStore(spark, str(tmp_path))
    good = store.append(None, rows)
    ids = store.logs().agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert good == n - len(range(0, n, 7)) and tuple(ids) == (1, good, good)
    # in order: an id is one more than the number of accepted bodies before
    number = F.col("message").cast("long")
    assert store.logs().where(F.col("id") != number - F.floor(number / 7)).count() == 0
    assert store.rejects().count() == n - good
    store.append(None, checked(spark, [[entry(message=str(i)) for i in range(300)]]))
    assert [int(r["message"]) for r in store.logs().where(F.col("id") > good).orderBy("id").collect()] == list(range(300))


def test_stream_rejects_are_kept_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    bodies = [json.dumps({"logs": [entry(message="fine"), entry(level="no"), entry(message="")]}), "{", '{"logs":3}', '{"logs":[]}', "[]", json.dumps({"logs": [entry(service="")]})]
    for i, b in enumerate(bodies):
        (source / f"{i}.json").write_text(b)
    store = LogStore(spark, str(tmp_path / "w"))
    ingest_stream(spark, str(source), store, str(tmp_path / "c")).awaitTermination()
    want = sorted([(1, "invalid level: 'no'"), (2, "message must be a non-empty string"), (-1, "malformed JSON"), (-1, "request body must be an object containing a logs array"), (-1, "request body must be an object containing a logs array"), (0, "service must be a non-empty string")])
    read = lambda: sorted((-1 if r["index"] is None else r["index"], r["reason"]) for r in store.rejects().collect())
    assert read() == want and store.logs().count() == 1
    assert store.rejects().where("writer is null").count() == 0 and store.rejects().select("batch").distinct().count() == 5
    writer = store.every_commit().first()
    # a replay of the batch writes neither rows nor rejects
    store.append_once(writer["writer"], writer["number"], checked(spark, bodies))
    ingest_stream(spark, str(source), store, str(tmp_path / "c")).awaitTermination()
    assert read() == want and store.logs().count() == 1
    # one commit for both
    assert set(store.snapshots.at(store.snapshots.latest()[0])) >= {"logs", "rejects", "writers"}


def test_running_counts_write_only_deltas(spark, tmp_path):
    counts, rng = MinuteCounts(spark, str(tmp_path)), random.Random(1)
    base, every, sizes = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), [], []
    for number in range(2 * MinuteCounts.FOLD + 3):
        rows = [(base + dt.timedelta(minutes=rng.randrange(200), seconds=rng.randrange(60)), rng.choice("ab"), "info") for _ in range(40)]
        every += rows
        seen = {f for f in os.listdir(tmp_path / "deltas")} if number else set()
        counts.add(spark.createDataFrame(rows, "timestamp timestamp, service string, level string"), number)
        counts.add(spark.createDataFrame(rows, "timestamp timestamp, service string, level string"), number)  # a replay
        deltas = counts.snapshots.latest()[1]["deltas"]
        assert len(deltas) <= 2 * MinuteCounts.FOLD
        sizes.append(len(set(os.listdir(tmp_path / "deltas")) - seen))
    assert sizes.count(1) == len(sizes) - 2  # a folded delta now and then, else a batch's own alone
    got = {(r["bucket_start"], r["service"]): r["count"] for r in counts.counts().collect()}
    want = {}
    for at, service, _ in every:
        key = (at.replace(second=0, tzinfo=None), service)
        want[key] = want.get(key, 0) + 1
    assert got == want
    assert counts.vacuum(grace=3600) == 0 and counts.vacuum(grace=0) == 2 * MinuteCounts.FOLD
    assert {(r["bucket_start"], r["service"]): r["count"] for r in counts.counts().collect()} == want
    assert MinuteCounts(spark, str(tmp_path / "none")).counts().collect() == []


def test_cells_make_up_the_range():
    rng = random.Random(2)
    for _ in range(300):
        low = rng.randrange(10 * 86_400_000_000)
        high = low + rng.choice([0, 1, 59_999_999, 60_000_000, rng.randrange(4 * 86_400_000_000)])
        if rng.random() < 0.4:
            low, high = low // 60_000_000 * 60_000_000, high // 3_600_000_000 * 3_600_000_000
        bucket = rng.choice(list(BUCKETS))
        parts = whole_cells(low, high, bucket, ("1m", "1h", "1d"))
        covered = sorted(r for _, ranges in parts for r in ranges)
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:])) and (not covered) == (low >= high)
        assert not covered or (covered[0][0], covered[-1][1]) == (low, high)
        for unit, ranges in parts:
            for a, b in ranges:
                if unit:
                    assert a % (BUCKETS[unit] * 1_000_000) == b % (BUCKETS[unit] * 1_000_000) == 0 and BUCKETS[bucket] % BUCKETS[unit] == 0
                else:
                    assert b - a < 120_000_000


def test_counts_of_cells_equal_rows_and_read_few(spark, tmp_path):
    rng, base = random.Random(3), dt.datetime(2024, 1, 20)
    rows = [(i, base + dt.timedelta(milliseconds=rng.choice([rng.randrange(30 * 86_400_000), rng.randrange(720) * 3_600_000, rng.randrange(30) * 86_400_000])), rng.choice("abc"), rng.choice(["info", "error"]), "m", "{}") for i in range(3000)]
    logs = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, service string, level string, message string, props string").withColumn("attributes", F.parse_json("props")).withColumn("attr_text", F.expr("cast(map() as map<string,string>)"))
    store = LogStore(spark, str(tmp_path))
    store.load(logs)
    pick = lambda df: sorted(map(str, df.collect()))
    iso = lambda ms: (base + dt.timedelta(milliseconds=ms)).isoformat(timespec="milliseconds") + "Z"
    for bucket in BUCKETS:
        for low, high in ((1, 29 * 86_400_000 + 7), (3_600_000, 7_200_000), (59_999, 60_001), (5, 5)):
            asked, group = Filters(service=rng.choice([None, "a"]), since=iso(low), until=iso(high)), rng.choice([None, "level"])
            assert pick(aggregates.count_cells(store.logs(), store.rollup, asked, bucket, group)) == pick(aggregates.count_rows(store.logs(), asked, bucket, group))
    month = Filters(since=iso(86_400_000), until=iso(20 * 86_400_000))
    units = []
    counts = aggregates.count_cells(store.logs(), lambda unit: units.append(unit) or store.rollup(unit), month, "1d")
    assert units == ["1d"] and all("/rollup/" in f for f in counts.inputFiles())
    days = store.rollup("1d").where("bucket_start is not null").count()
    assert days <= 31 * 6 < 3000


def read_files(spark, run):
    """Names of the month folders that the scans of a call name."""
    seen = []
    original = LogStore.read

    def spy(self, table, places, schema):
        seen.extend(p.rpartition("/month=")[2] for p in places)
        return original(self, table, places, schema)

    LogStore.read = spy
    try:
        return run(), seen
    finally:
        LogStore.read = original


def test_first_page_reads_one_month(spark, tmp_path):
    store = months_store(spark, str(tmp_path), months=5)
    ids = lambda rows: [r["id"] for r in rows]
    (rows, months) = read_files(spark, lambda: paging.newest(store, Filters(), 4))
    assert months == ["2024_05"] and ids(rows) == ids(paging.page(store.logs(), Filters(), 4).collect())
    (rows, months) = read_files(spark, lambda: paging.newest(store, Filters(), 20))
    assert set(months) == {"2024_02", "2024_03", "2024_04", "2024_05"} or len(months) == 5
    assert ids(rows) == ids(paging.page(store.logs(), Filters(), 20).collect()) and len(rows) == 20
    for asked in (Filters(q="m2"), Filters(q="nowhere"), Filters(since="2024-02-10T00:00:00Z", until="2024-04-05T00:00:00Z")):
        after = (int(dt.datetime(2024, 4, 3, 1, 0, 30, 500_000, dt.timezone.utc).timestamp() * 1e6), 20)
        for cursor in (None, after):
            assert ids(paging.newest(store, asked, 7, cursor)) == ids(paging.page(store.logs(), asked, 7, cursor).collect())
    (_, months) = read_files(spark, lambda: paging.newest(store, Filters(since="2024-02-10T00:00:00Z", until="2024-02-25T00:00:00Z"), 50))
    assert months == ["2024_02"]
    assert paging.newest(LogStore(spark, str(tmp_path / "none")), Filters(), 3) == []


def test_promoted_key_skips_row_groups_and_equals_the_map(spark, tmp_path):
    n = 40_000
    rows = spark.range(0, n, 1, 2).select(F.col("id"), F.timestamp_seconds(F.lit(1717149600) + F.col("id") % 997).alias("timestamp"), F.lit("info").alias("level"), F.lit("s").alias("service"), F.lit("m").alias("message"), F.sha2(F.col("id").cast("string"), 256).alias("trace"))
    rows = rows.withColumn("attr_text", F.create_map(F.lit("trace_id"), "trace")).withColumn("attributes", F.parse_json(F.lit("{}")))
    plain, promoted = LogStore(spark, str(tmp_path / "a")), LogStore(spark, str(tmp_path / "b"), promoted=("trace_id",))
    spark.conf.set("parquet.block.size", str(256 * 1024))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(256 * 1024))
    try:
        for store in (plain, promoted):
            store.load(rows)
    finally:
        spark.conf.unset("parquet.block.size")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    for value in (rows.where("id = 777").first()["trace"], "f" * 64):
        asked = Filters(attributes={"trace_id": value})
        by_map, by_column = matching(plain.logs(), asked), matching(promoted.logs(), asked)
        assert [r["id"] for r in by_map.collect()] == [r["id"] for r in by_column.collect()]
        assert "EqualTo(attr_trace_id" in plan(by_column)

        def scanned(df):
            df.collect()
            found = df._jdf.queryExecution().executedPlan()
            leaves = found.collectLeaves()
            return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

        assert scanned(matching(promoted.logs(), asked)) < scanned(matching(plain.logs(), asked)) / 2


def test_key_promoted_later_still_finds_older_rows(spark, tmp_path):
    path, asked = str(tmp_path), Filters(attributes={"a b": "1"})
    LogStore(spark, path).append(None, checked(spark, [[entry(message="old", attributes={"a b": 1})]]))
    later = LogStore(spark, path, promoted=("a b",))
    later.append(None, checked(spark, [[entry(message="new", attributes={"a b": 1.0}), entry(message="other", attributes={"a b": 2})]]))
    assert sorted(r["message"] for r in matching(later.logs(), asked).collect()) == ["new", "old"]
    assert "attr_a b" not in later.logs().columns
    later.compact(most=1)
    assert "attr_a b" in later.logs().columns and sorted(r["message"] for r in matching(later.logs(), asked).collect()) == ["new", "old"]


def test_search_reads_files_that_may_hold_the_text(spark, tmp_path):
    texts = [["Disk full on node 7", "straße", "日本語のログ"], ["disk ok", "A"], ["Ärger", "x" * 300], ["nothing to see", ""]]
    plain, signed = LogStore(spark, str(tmp_path / "a")), LogStore(spark, str(tmp_path / "b"), searchable=True)
    for store in (plain, signed):
        for i, own in enumerate(texts):
            store.append(None, checked(spark, [[entry(timestamp=f"2024-0{1 + i}-01T00:00:00Z", message=t) for t in own if t]]))
    files = lambda store, q: {f.rpartition("/commit=")[2] for f in store.logs(needle=q).inputFiles()}
    most = {"disk FULL": 1, "node 7": 1, "disk": 2, "ß": 1, "ÄRG": 1, "本": 1, "語の": 1, "xxxx": 1, "zq": 0, "7": 1, "": 4, "full disk": 0}
    for q, n in most.items():
        found = lambda store: sorted(r["message"] for r in matching(store.logs(needle=q), Filters(q=q)).collect())  # noqa: E731, B023
        assert found(signed) == found(plain) and len(files(plain, q)) == 4
        assert len(files(signed, q)) <= n + 1 and (n == 4 or len(files(signed, q)) < 4), q
        assert [r["id"] for r in paging.newest(signed, Filters(q=q), 5)] == [r["id"] for r in paging.newest(plain, Filters(q=q), 5)]
    signed.compact(most=0)
    assert found(signed) == found(plain) and signed.logs(needle="disk full").count() <= 3


def test_signatures_hash_each_distinct_run_once(spark):
    texts = ["", "a", "ab", "view user 12", "view user 12", "straße 日本語", "i\u0307 😀😀", "a\0", "x" * 50]
    runs = spark.createDataFrame([(t,) for t in texts], "message string").select(F.explode(grams(F.col("message"))).alias("gram"))
    assert set(bits_of(texts).tolist()) == {r[0] for r in runs.select(bit(F.col("gram"))).collect()}
    # what is hashed follows the runs that differ, not the rows
    assert len(bits_of(texts * 1000)) == runs.distinct().count()
    assert len(bits_of([])) == len(bits_of([""])) == 0


def test_deadline_and_storage_errors(spark, tmp_path):
    slow = F.udf(lambda x: __import__("time").sleep(0.05) or x, "long")
    with pytest.raises(EngineError) as late:
        with guarded(spark.sparkContext, 2):
            spark.range(0, 10_000, 1, 4).select(slow("id").alias("x")).agg(F.sum("x")).collect()
    assert late.value.status == 500 and late.value.retry_after is None
    assert spark.range(10).count() == 10  # later jobs are not cancelled
    engine = Engine(spark, EngineConfig(warehouse=str(tmp_path / "w"), deadline_seconds=600))
    assert engine.list_logs({}) == {"logs": [], "next_cursor": None}
    asked = {"since": "2024-05-01T00:00:00Z", "until": "2024-06-01T00:00:00Z", "bucket": "1d"}
    assert engine.aggregate(asked) == {"buckets": []}
    engine.ingest(json.dumps({"logs": [entry()]}), NOW)
    shutil.move(tmp_path / "w" / "logs", tmp_path / "away")
    for call in (lambda: engine.list_logs({}), lambda: engine.aggregate(asked | {"until": "2024-05-31T10:00:00.1Z"})):
        with pytest.raises(EngineError) as gone:
            call()
        assert (gone.value.status, gone.value.retry_after, gone.value.message) == (503, 1, "database is unavailable")
    shutil.move(tmp_path / "away", tmp_path / "w" / "logs")
    assert len(engine.list_logs({})["logs"]) == 1
    with pytest.raises(EngineError) as bad:
        engine.list_logs({"limit": "0"})
    assert bad.value.status == 400


@pytest.mark.parametrize("level, text", [([None, "a[b]"], ",a[b]"), ([], ""), ([[1, [2, None]], [], {"x": 1}, True, 1.5], "1,2,,,[object Object],true,1.5"), ({"a": 1}, "[object Object]"), (["", ""], ",")])
def test_values_inside_a_message(spark, level, text):
    assert [r["reason"] for r in checked(spark, [[entry(level=level)]]).select("reason").collect()] == [f"invalid level: '{text}'"]


def test_entries_older_than_the_window(spark):
    bodies = spark.createDataFrame([(0, json.dumps({"logs": [entry(timestamp=t) for t in ("2024-05-02T11:59:59.999Z", "2024-05-02T12:00:00.000Z", "2020-01-01T00:00:00+01:00")]}))], "batch long, body string")
    found = {r["index"]: r["reason"] for r in validated(bodies, NOW, 30).select("index", "reason").collect()}
    assert found == {0: "timestamp is older than the retention window", 1: None, 2: "timestamp is older than the retention window"}


def test_size_of_an_entry(spark):
    row = spark.createDataFrame([("2024-01-01T00:00:00Z", "info", "é", "hey", '{"a":1}')], "t string, l string, s string, m string, a string").withColumn("a", F.parse_json("a"))
    assert row.select(entry_bytes(F.col("t"), F.col("l"), F.col("s"), F.col("m"), F.col("a"))).first()[0] == 20 + 4 + 2 + 3 + 7 + 32
