"""The batch operators as Structured Streaming jobs over files of observations; each equals its batch form on the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.times import micros
from tidemark.operators.dedupe import keep_last
from tidemark.sources.tables import scratch


LATENESS = "1 day"


def landed(spark: SparkSession, sf_dir: str, table: str, parts: int = 3, late: bool = True, ts: str = "ts") -> str:
    """The table as files that come in one after another, each with the rows of an equal part of its time; with late, rows of odd ids of a
    part's last six hours come with the next file. Returns their folder."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    at = F.unix_micros(ts)
    ends = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    path, width = scratch(spark, "landing"), (((ends.b or 0) - (ends.a or 0)) // parts) + 1
    part = F.coalesce(F.floor((at - (ends.a or 0)) / width), F.lit(0))
    if late:
        overdue = (F.col(rows.columns[0]) % 2 == 1) & ((part + 1) * width - (at - (ends.a or 0)) <= 6 * 3_600_000_000)
        part = F.when(overdue & (part < parts - 1), part + 1).otherwise(part)
    for k in range(parts):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return path


def open_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's files as a stream, one file a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(job: DataFrame, write: Callable[[DataFrame, int], None], mode: str, state: str | None = None) -> list[dict]:
    """Run a stream over all files there are now, batch by batch; returns the progress of its batches. State is kept by RocksDB."""
    spark = job.sparkSession
    state = state or scratch(spark, "state")
    # changes of the state are written with each batch, whole snapshots of it now and then
    settings = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.changelogCheckpointing.enabled": "true"}
    settings = {f"spark.sql.streaming.stateStore.{k}": v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = job.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).queryName(f"q{uuid.uuid4().hex}").start()
        query.awaitTermination()
        return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def appended(job: DataFrame, progress: list | None = None) -> DataFrame:
    """What a stream in append mode gives: each batch is a folder of its number, which a batch that is run again replaces."""
    path = scratch(job.sparkSession, "stream")
    seen = run(job, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), "append")
    if progress is not None:
        progress += seen
    return job.sparkSession.read.schema(job.schema).parquet(path).select(*job.columns)


class UpsertStore:
    """A table of the last row of each key, in buckets by the key's hash. Each batch writes new versions of the buckets that it
    touches (batch=n/bucket=k) and leaves the files of others alone; a bucket's rows are those of its highest version. A batch that is run again
    starts from the versions before it, so it changes nothing. Versions that no rerun of the last batch could need are removed."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, keys, order, buckets

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> dict[int, list[int]]:
        """Of each bucket the numbers of the batches that wrote it, in order."""
        fs, place = self._files()
        out: dict[int, list[int]] = {}
        if fs.exists(place):
            for batch in fs.listStatus(place):
                name = batch.getPath().getName()
                # what a batch left without ending it is no version
                if name.startswith("batch=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(batch.getPath(), "_SUCCESS")):
                    for bucket in fs.listStatus(batch.getPath()):
                        if bucket.getPath().getName().startswith("bucket="):
                            out.setdefault(int(bucket.getPath().getName()[7:]), []).append(int(name[6:]))
        return {k: sorted(v) for k, v in out.items()}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read([f"{self.path}/batch={v[-1]}/bucket={k}" for k, v in self.versions().items()])

    def merge(self, batch: DataFrame, number: int) -> None:
        """A foreachBatch function."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        # a row of each key is enough: the merge's input is summed before it is shuffled
        batch = keep_last(batch.select(*self._read([]).columns), self.keys, self.order).persist()
        try:
            touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # as many as buckets at most
            if not touched:
                return
            held = {k: [n for n in v if n < number] for k, v in self.versions().items()}
            before = self._read([f"{self.path}/batch={held[k][-1]}/bucket={k}" for k in touched if held.get(k)])
            rows = keep_last(before.unionByName(batch), self.keys, self.order).withColumn("bucket", bucket)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        finally:
            batch.unpersist()
        fs, _ = self._files()
        for k in touched:
            for old in held.get(k, [])[:-1]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={old}/bucket={k}"), True)


def upserted(job: DataFrame, keys: list[str], order: list[str] | None = None, mode: str = "append", progress: list | None = None) -> DataFrame:
    """A stream's rows in an upsert store. Without an order the row of the latest batch counts (update mode)."""
    spark, schema = job.sparkSession, ", ".join(f"`{c}` {t}" for c, t in job.dtypes)
    store = UpsertStore(spark, scratch(spark, "store"), schema if order else f"{schema}, __batch long", keys, order or ["__batch"])
    seen = run(job, lambda batch, n: store.merge(batch if order else batch.withColumn("__batch", F.lit(n).cast("long")), n), mode)
    if progress is not None:
        progress += seen
    return store.read().select(*job.columns)


def dedup_within(stream: DataFrame, keys: list[str], ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """The first row of each key within the lateness; state of older keys is dropped."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def dedup_buckets(stream: DataFrame) -> DataFrame:
    """One row for each event, kind and six hours, whatever rows it is seen in. Rows of a bucket lie within the lateness, so the state of a
    bucket may go when the watermark has passed it."""
    bucket = micros(F.window("ts", "6 hours")["start"])
    rows = stream.select(F.col("user_id").alias("event_key"), "event_type", bucket.alias("bucket_us"), "ts")
    return dedup_within(rows, ["event_key", "event_type", "bucket_us"]).select("event_key", "event_type", "bucket_us")


def windowed(stream: DataFrame, width: str) -> DataFrame:
    """Lowest, mean and count of each event in each window; in update mode a window's row comes with each batch that changes it, and
    its state goes when the watermark has passed it."""
    out = stream.withWatermark("ts", LATENESS).groupBy(F.col("user_id").alias("event_key"), F.window("ts", width)).agg(F.min("value").alias("low"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select("event_key", micros(F.col("window.start")).alias("from_us"), "low", "mean", "n")


def near_starts(stream: DataFrame) -> DataFrame:
    """A stream joined with its own purchases of the same user within minutes, both sides with a watermark."""
    a = stream.withWatermark("ts", "1 hour").select("event_id", "user_id", "ts")
    b = stream.withWatermark("ts", "1 hour").where("event_type = 'purchase'").select(F.col("event_id").alias("start_id"), F.col("user_id").alias("uid"), F.col("ts").alias("start"))
    near = F.col("ts").between(F.col("start") - F.expr("interval 30 minutes"), F.col("start") + F.expr("interval 15 minutes"))
    return a.join(b, (F.col("user_id") == F.col("uid")) & near).select("event_id", "start_id")


def running_min(stream: DataFrame) -> DataFrame:
    """The lowest price of each event so far, and how many observations there are; in update mode the rows that changed."""
    price = F.when(F.col("event_type") != "error", F.nanvl("value", F.lit(None).cast("double")))
    return stream.groupBy(F.col("user_id").alias("event_key")).agg(F.min(price).alias("low"), F.count(F.lit(1)).alias("n"))


class PriceAlerts(StatefulProcessor):
    """Of each event the lowest and the last price so far; a row where the price falls to or below the lowest one or the floor. A timer at
    the event's start drops its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "low double, last double")

    def handleInputRows(self, key, rows, timerValues):
        held = self.seen.get() if self.seen.exists() else None
        low, last = held if held else (None, None)
        batch = pd.concat(list(rows)).sort_values(["ts", "snap_id"])
        if held is None and batch["start_ts"].notna().any():
            self.handle.registerTimer(int(batch["start_ts"].dropna().iloc[0].timestamp() * 1000))
        out = []
        for snap, price, floor in batch[["snap_id", "price", "floor"]].itertuples(index=False):
            if last is not None and price < last and (price <= low or price <= floor):
                out.append((key[0], snap, price, low, bool(price <= low), bool(price <= floor)))
            low, last = price if low is None else min(low, price), price
        self.seen.update((low, last))
        if out:
            yield pd.DataFrame(out, columns=["event_key", "snap_id", "price", "low_before", "at_low", "at_floor"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def price_alerts(stream: DataFrame, floors: DataFrame) -> DataFrame:
    """Alerts on falling prices. stream: snap_id, event_key, ts, price, start_ts; floors: event_key, floor. Observations without a price
    or after the start don't count. Prices are judged in the order in which batches bring them and by time within a batch."""
    rows = stream.withWatermark("ts", LATENESS).where(F.col("price").isNotNull() & (F.col("start_ts").isNull() | (F.col("ts") <= F.col("start_ts"))))
    rows = rows.join(floors.select("event_key", "floor"), "event_key", "left").select("event_key", "snap_id", "ts", "price", "start_ts", "floor")
    schema = "event_key long, snap_id long, price double, low_before double, at_low boolean, at_floor boolean"
    return rows.groupBy("event_key").transformWithStateInPandas(PriceAlerts(), schema, "Append", "EventTime")


def before_start(stream: DataFrame) -> DataFrame:
    """Rows up to their event's start, which this domain's events have by their number; an unknown start keeps the row."""
    start = F.lit("2024-01-10 18:00:00").cast("timestamp") + F.make_interval(days=(F.col("user_id") % 40).cast("int"))
    return stream.where(start.isNull() | (F.col("ts") <= start)).select("event_id")
