"""Health checks, profiles and status of tables: one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def health(df: DataFrame, parsed: dict[str, Column], day: Column, asof: str, days: int = 7, ratio: float = 0.95) -> DataFrame:
    """Rows, latest day and whether it is fresh, share of parsed values for each name and whether it is above the ratio, overall."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(day).alias("last_day"), *(F.avg(c.isNotNull().cast("double")).alias(f"{k}_ratio") for k, c in parsed.items()))
    fresh = F.coalesce(F.datediff(F.lit(asof).cast("date"), "last_day") <= days, F.lit(False))
    ok = fresh
    for k in parsed:
        ok = ok & F.coalesce(F.col(f"{k}_ratio") > ratio, F.lit(False))
    return out.withColumns({"fresh": fresh, "ok": ok})


def profile(df: DataFrame, key: str, fill: list[str], ts: str) -> DataFrame:
    """Rows, duplicate keys, fill rates, first and last time."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(key) - F.count_distinct(F.col(key))).alias("duplicate_keys"), *(F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_fill") for c in fill),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many rows of both differ in a column, and how many of these were filled."""
    b = before.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    both = after.join(b, F.col(key) == F.col("__key"))
    differs, filled = F.lit(False), F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        filled = filled | (F.col(f"__{c}").isNull() & F.col(c).isNotNull())
    return both.agg(F.count_if(differs).alias("n_changed"), F.count_if(filled).alias("n_filled"))


def numeric_share(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """For each text column the share of numbers among its values and whether it is mostly numeric."""
    out = None
    one = df.agg(*(F.try_divide(F.count(F.col(c).try_cast("double")), F.count(c)).alias(c) for c in columns))
    for c in columns:
        row = one.select(F.lit(c).alias("column_name"), F.col(c).alias("numeric_share"), F.coalesce(F.col(c) >= least, F.lit(False)).alias("mostly_numeric"))
        out = row if out is None else out.unionByName(row)
    return out


def as_numeric_or_category(c: Column, numeric: bool) -> Column:
    """Numbers where the column is mostly numeric, else its text with a word for missing values."""
    return c.try_cast("double") if numeric else F.coalesce(c, F.lit("__MISSING__"))


def latest_status(log: DataFrame, name: str = "name", ts: str = "updated_at", tie: str | None = None) -> DataFrame:
    """The last row of each job."""
    order = F.struct(ts, *([tie] if tie else []))
    return log.groupBy(name).agg(F.max_by(F.struct(*log.columns), order).alias("r")).select("r.*")


def ordered_status(log: DataFrame, order: list[str], name: str = "name", ts: str = "updated_at", tie: str | None = None) -> DataFrame:
    """The last rows of given jobs, numbered in the given order."""
    place = F.coalesce(*(F.when(F.col(name) == n, i) for i, n in enumerate(order)))
    return latest_status(log.where(F.col(name).isin(order)), name, ts, tie).withColumn("place", place)


def importance_by_base(importances: DataFrame, near_zero: float = 0.01) -> DataFrame:
    """Importances summed over a feature and its missing flag, and whether that is near zero."""
    base = F.regexp_replace("feature", "_missing$", "")
    return importances.groupBy(base.alias("base")).agg(F.sum("importance").alias("importance")).withColumn("near_zero", F.col("importance") < near_zero)
