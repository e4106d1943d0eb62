"""Streams over files that come one after another: results equal batch, state shrinks, reruns change nothing."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import TABLES, rows
from tidemark.plans import catalog
from tidemark.sources.tables import scratch
from tidemark.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    return ingest.landed(spark, SF, "events")


def wanted(name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return rows(con.execute(catalog.ORACLES[name]).df())


def state_rows(progress):
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress if p["stateOperators"]]


def test_files_come_in_order_of_time_with_late_rows(spark, folder):
    parts = spark.read.parquet(folder).withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).orderBy("b").collect()
    assert len(parts) == 3 and sum(p.n for p in parts) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert all(x.b > y.a for x, y in zip(parts, parts[1:]))  # some rows of a part come with the next one


def test_deduplication_drops_old_state(spark, folder):
    seen = []
    got = ingest.appended(ingest.dedup_buckets(ingest.open_stream(spark, folder)), seen)
    assert rows(got.toPandas()) == wanted("x1_stream_dedup")
    held = state_rows(seen)
    assert len([p for p in seen if p["numInputRows"]]) == 3 and held[-1] < max(held) < got.count()


@pytest.mark.parametrize("name, width", [("x3_six_hour_windows", "6 hours"), ("x4_daily_windows", "1 day")])
def test_windows_in_update_mode_drop_old_state(spark, folder, name, width):
    seen = []
    got = ingest.upserted(ingest.windowed(ingest.open_stream(spark, folder), width), ["event_key", "from_us"], mode="update", progress=seen)
    assert rows(got.withColumn("mean", F.round("mean", 6)).toPandas()) == wanted(name)
    held = state_rows(seen)
    assert held[-1] < max(held) < got.count()


def test_alerts_equal_a_batch_window_and_state_ends_with_the_event(spark):
    price = F.when(F.col("event_type") != "error", F.nanvl("value", F.lit(None).cast("double")))
    start = F.lit("2024-01-10 18:00:00").cast("timestamp") + F.make_interval(days=(F.col("user_id") % 40).cast("int"))
    stream = ingest.open_stream(spark, ingest.landed(spark, SF, "events", late=False))
    stream = stream.select(F.col("event_id").alias("snap_id"), F.col("user_id").alias("event_key"), "ts", price.alias("price"), start.alias("start_ts"))
    snapshots = spark.read.parquet(f"{SF}/events.parquet").withColumn("price", price)
    floors = snapshots.groupBy(F.col("user_id").alias("event_key")).agg((F.round(F.avg("price"), 2) / 2).alias("floor"))
    seen = []
    got = ingest.appended(ingest.price_alerts(stream, floors), seen).toPandas()
    assert rows(got) == wanted("x7_price_alerts") and got["at_floor"].any() and got["at_low"].any()
    held = state_rows(seen)
    assert held[-1] < max(held)


def files(spark, store):
    fs, place = store._files()
    found, out = fs.listFiles(place, True), {}
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().startswith("part-"):
            out[f.getPath().toString()] = f.getModificationTime()
    return out


def test_upserts_touch_only_their_buckets_and_may_be_repeated(spark):
    store = ingest.UpsertStore(spark, scratch(spark, "store"), "k long, at long, v string", ["k"], ["at", "v"], buckets=8)
    made = lambda *r: spark.createDataFrame(list(r), "k long, at long, v string")
    now = lambda: sorted(map(tuple, store.read().collect()))
    assert now() == []
    store.merge(made(*((k, 1, "a") for k in range(40))), 0)
    first = files(spark, store)
    store.merge(made((3, 2, "b"), (3, 1, "z"), (99, 1, "n")), 1)
    second = files(spark, store)
    assert all(second.get(f) == t for f, t in first.items())  # nothing of the first batch was touched
    assert 1 <= len(set(second) - set(first)) <= 2
    want = sorted([(k, 1, "a") for k in range(40) if k != 3] + [(3, 2, "b"), (99, 1, "n")])
    assert now() == want
    store.merge(made((3, 2, "b"), (3, 1, "z"), (99, 1, "n")), 1)
    assert now() == want and len(files(spark, store)) == len(second)
    store.merge(made((3, 0, "late"), (99, 5, None)), 2)
    assert now() == sorted([r for r in want if r[0] != 99] + [(99, 5, None)], key=lambda r: r[:2])
    store.merge(made((1, 9, "x")).where("false"), 3)
    assert len(now()) == 41


def test_a_batch_that_did_not_end_is_no_version(spark):
    store = ingest.UpsertStore(spark, scratch(spark, "store"), "k long, at long", ["k"], ["at"], buckets=2)
    store.merge(spark.createDataFrame([(1, 1), (2, 1)], "k long, at long"), 0)
    spark.createDataFrame([(1, 9)], "k long, at long").withColumn("bucket", F.lit(0)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("bucket").parquet(f"{store.path}/batch=1")
    assert {r.at for r in store.read().collect()} == {1}
