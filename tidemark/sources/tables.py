"""Reading, harmonizing and writing the domain's tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.dedupe import keep_last


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a master within one process (tests, one machine) gets a temporary
    folder, which goes when the process ends; a cluster has to name a folder that all its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting within a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared store and read again: iterations neither repeat it nor depend on the executors that made it.
    Nothing executes df again, so what it shuffled goes at once."""
    path = scratch(df.sparkSession, name)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(path_of: DataFrame | str, schema: str, spark: SparkSession | None = None) -> DataFrame:
    """A CSV table with a header by a given schema; no inference pass. What does not fit becomes null; NaN becomes null."""
    spark = spark or SparkSession.active()
    df = spark.read.schema(schema).option("header", True).csv(path_of)
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, kind in df.dtypes if kind == "double"})


def written_csv(df: DataFrame, name: str) -> str:
    """Where df now lies as CSV."""
    path = scratch(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


def read_json_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character of the first file."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    reader = spark.read.option("multiLine", bool(first and first[0].lstrip().startswith("[")))
    return (reader.schema(schema) if schema else reader).json(path)


def best_file_per_year(files: DataFrame, path: str = "path") -> DataFrame:
    """S3: year and path of the file of each year, those outside an archive folder first, then by name."""
    year = F.regexp_extract(path, r"(\d{4})(?=\D*$)", 1).try_cast("int")
    rows = files.withColumn("season_year", year).where("season_year is not null")
    order = F.struct(F.col(path).rlike("/archive/").alias("archived"), F.col(path).alias("p"))
    return rows.groupBy("season_year").agg(F.min(order).alias("o")).select("season_year", F.col("o.p").alias(path))


def nearest_year(df: DataFrame, year: str, wanted: int) -> DataFrame:
    """Rows of the year nearest to the wanted one, an earlier one before a later one."""
    best = df.agg(F.min(F.struct(F.abs(F.col(year) - wanted), F.col(year) > wanted, F.col(year).alias("y"))).alias("b"))
    return df.join(F.broadcast(best.select(F.col("b.y").alias(year))), year)


def latest_season(df: DataFrame, season: str, at_most: int) -> DataFrame:
    """Rows of the latest season up to a year; the filter on the season prunes partitions."""
    rows = df.where(F.col(season) <= at_most)
    return rows.join(F.broadcast(rows.agg(F.max(season).alias(season))), season)


def harmonize(df: DataFrame, names: dict[str, list[str]], types: dict[str, str] | None = None, rest: bool = False) -> DataFrame:
    """For each canonical name the first candidate that exists, else null; with rest, other columns follow."""
    there = set(df.columns)
    used, out = set(), []
    for canon, candidates in names.items():
        found = next((c for c in candidates if c in there), None)
        used.add(found)
        c = F.col(found) if found else F.lit(None)
        out.append((c.cast(types[canon]) if types and canon in types else c).alias(canon))
    return df.select(*out, *([c for c in df.columns if c not in used and c not in names] if rest else []))


def union_all_years(parts: list[DataFrame]) -> DataFrame:
    """S6"""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def ordered_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """Columns of a fixed prefix that exist, then the others as they come."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def write_partitioned(df: DataFrame, by: str, name: str, path: str | None = None) -> DataFrame:
    """The table written by partitions, only those that df has being replaced; Spark commits a job's files together. The stored table."""
    path = path or scratch(df.sparkSession, name)
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def append_dedup(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The union of a table and new rows with the last row of each key."""
    return keep_last(stored.unionByName(new, allowMissingColumns=True), keys, order)
