"""Exact de-duplication as a stream: keyed state on disk, without expiry, holds for each digest of a normalised text the smallest
identifier, where that row's content lies, and how many rows came; hits are confirmed on full texts.

Only DataFrame functions. The state is Spark's own (RocksDB, checkpointed to the shared store), so a stream that stops goes on where
it was, and rows of one digest are summed before they are shuffled. The place of a content is its file and its row there, by which
the text of a kept row is fetched again for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import scratch, stored

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Input splits in a micro-batch for each task that can run at a time.
SPLITS = 4


def _bytes(size: str) -> int:
    """A size as Spark's settings write it."""
    digits = size.strip().lower().rstrip("bkmgt")
    return int(digits) << 10 * "bkmgt".find(size.strip().lower().removeprefix(digits)[:1] or "b")


def normal(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _located(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(normal(F.col(text_col)), 256).alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.col(text_col).alias("text"),
    )


def ingest(spark: SparkSession, path: str, state: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int | None = None) -> None:
    """Take in all files of the folder (or file) path that the stream has not seen yet; state is the stream's folder.

    Below state/changed each micro-batch leaves the digests it touched, with their state after it. Rows of a null id are kept in mind
    with a null identifier, which counts as smaller than any. A micro-batch takes batch_bytes of files; by default SPLITS splits for each
    task that can run at a time, so that the number of batches does not grow with a cluster that grows with its input.
    """
    from uuid import uuid4

    if batch_bytes is None:
        batch_bytes = SPLITS * spark.sparkContext.defaultParallelism * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))

    conf = {
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # many partitions with little state each: no room is taken on disk ahead of need
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(batch_bytes))
        if not _folder(spark, path):  # a stream watches folders
            path, _, name = path.rpartition("/")
            reader = reader.option("pathGlobFilter", name)
        rows = _located(reader.parquet(path), id_col, text_col)
        kept = rows.groupBy("digest").agg(
            F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "file", "row")).alias("first"), F.count(F.lit(1)).alias("n")
        )

        def write(batch: DataFrame, number: int) -> None:
            # a batch that is run again replaces what it had written
            batch.write.mode("overwrite").parquet(f"{state}/changed/batch={number}")

        query = kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).queryName(f"dedup-{uuid4().hex}").start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def known(spark: SparkSession, state: str) -> DataFrame:
    """The state after all batches so far: digest, first (doc_id, file, row), n."""
    changed = spark.read.schema("digest string, first struct<doc_id:long,file:string,row:long>, n long, batch int").parquet(f"{state}/changed")
    return changed.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", state: str | None = None) -> DataFrame:
    """One row per row of the Parquet folder (or file) path: doc_id, keep_id, group_size, kept, text_sha256.

    Rows whose normalised texts are equal form a group; the smallest doc_id stays. A null text counts as empty. Of rows with the same
    smallest doc_id (repeated rows) only the one whose file and row come first stays. A null doc_id stays null and counts as the
    smallest. An empty table gives no rows. Should two different texts ever have one digest, the comparison of full texts finds it and
    the row stays with a group of its own. Other columns are not read.
    """
    state = state or scratch(spark, "exact-dedup")
    ingest(spark, path, state, id_col, text_col)
    rows = _located(spark.read.parquet(path), id_col, text_col)
    groups = known(spark, state) if _folder(spark, f"{state}/changed") else None
    if groups is None:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    groups = stored(groups, "groups")
    several = groups.where("n > 1").select("digest", F.col("first.file").alias("file"), F.col("first.row").alias("row"))
    # texts that stay, fetched by place; then each text of a group against it
    stay = stored(rows.drop("digest").join(several, ["file", "row"]).select(F.col("digest").alias("__digest"), normal(F.col("text")).alias("__text")), "stay")
    # what is known of a digest, with the text that stays, is one row; so rows meet it in one join, whose hot digests Spark can split
    groups = groups.select(F.col("digest").alias("__of"), "first", "n").join(stay, F.col("__of") == F.col("__digest"), "left").drop("__digest")
    told = rows.join(stored(groups, "known"), F.col("digest") == F.col("__of"))
    told = told.withColumn("is_first", (F.col("first.file") == F.col("file")) & (F.col("first.row") == F.col("row")))
    told = told.withColumn("same", F.when(F.col("n") > 1, normal(F.col("text")) == F.col("__text")).otherwise(True))
    least = F.when(F.col("first.doc_id") != -(1 << 63), F.col("first.doc_id"))
    return told.select(
        "doc_id",
        F.when(F.col("same"), least).otherwise(F.col("doc_id")).alias("keep_id"),
        F.when(F.col("same"), F.col("n")).otherwise(1).alias("group_size"),
        (F.col("is_first") | ~F.col("same")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _folder(spark: SparkSession, path: str) -> bool:
    """Whether path is a folder in the store that it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(store.exists(place) and store.getFileStatus(place).isDirectory())


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""
