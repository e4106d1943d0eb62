"""Back-testing predictions against what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.times import hours_between
from tidemark.operators.quantile import quantile

BUCKETS = [0, 20, 50, 100, 200]


def errors(df: DataFrame, predicted: str, actual: str, predicted_ts: str, actual_ts: str) -> DataFrame:
    """price error, relative error where the actual price is positive, and hours off, signed and not."""
    off = hours_between(F.col(predicted_ts), F.col(actual_ts))
    return df.withColumns(
        {
            "abs_error": F.abs(F.col(predicted) - F.col(actual)),
            "percent_error": F.when(F.col(actual) > 0, F.abs(F.col(predicted) - F.col(actual)) / F.col(actual) * 100),
            "timing_signed_hours": off,
            "timing_abs_hours": F.abs(off),
        }
    )


def regression_metrics(df: DataFrame, true: str, predicted: str, absolute: float, relative: float) -> DataFrame:
    """One row: n, mae, rmse, shares within an absolute and a relative tolerance."""
    off = F.abs(F.col(true) - F.col(predicted))
    rel = off / F.greatest(F.abs(F.col(true)), F.lit(1e-6))
    return df.where(off.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(off).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"),
        F.avg((off <= absolute).cast("double")).alias("within_abs"), F.avg((rel <= relative).cast("double")).alias("within_rel"),
    )


def bucket(c: Column, edges: list[int] = BUCKETS) -> Column:
    """Number of the bucket whose lower edge a value reaches, from 0; null below the first."""
    out = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        out = F.when(c >= e, i).otherwise(out)
    return out


def mae_by_bucket(df: DataFrame, true: str, predicted: str, edges: list[int] = BUCKETS) -> DataFrame:
    """A row for each bucket, empty ones with null."""
    every = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bucket"))
    found = df.groupBy(bucket(F.col(true), edges).alias("bucket")).agg(F.avg(F.abs(F.col(true) - F.col(predicted))).alias("mae"))
    return every.join(found, "bucket", "left")


def timing_metrics(df: DataFrame, signed: str = "timing_signed_hours") -> DataFrame:
    """Mean and median of hours off, counts within 6, 12 and 24 hours, bias, share of late ones."""
    h, df = F.abs(F.col(signed)), df.where(F.col(signed).isNotNull())
    middle = F.lit(quantile(df, h, 0.5)).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(h).alias("mean_abs_hours"), F.first(middle).alias("median_abs_hours"),
        *(F.count_if(h <= k).alias(f"within_{k}h") for k in (6, 12, 24)),
        F.avg(signed).alias("bias_hours"), F.avg((F.col(signed) > 0).cast("double")).alias("late_share"),
    )


def recent(df: DataFrame, ts: str, asof: str, days: int = 7) -> DataFrame:
    """Rows of the days before asof."""
    end = F.lit(asof).cast("timestamp")
    return df.where((F.col(ts) >= end - F.make_interval(days=F.lit(days))) & (F.col(ts) <= end))


def retrain_flags(df: DataFrame, percent: str = "percent_error", limit: float = 5.0, miss: float = 0.4, retrain: float = 0.5) -> DataFrame:
    """How many are off by more than the limit, their share, and whether that is too many."""
    out = df.where(F.col(percent).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(percent) > limit).alias("n_over"))
    share = F.try_divide(F.col("n_over"), F.col("n"))
    return out.withColumns({"share_over": share, "many_missed": F.coalesce(share > miss, F.lit(False)), "retrain": F.coalesce(share > retrain, F.lit(False))})


def not_logged(new: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the log."""
    return new.join(log.select(key).distinct(), key, "left_anti")


def gap_to_price(price: Column, predicted_log_gap: Column) -> Column:
    """the lowest price that a predicted log gap means."""
    return price * (1 - F.least(F.greatest(F.expm1(predicted_log_gap), F.lit(0.0)), F.lit(1.0)))


def clamp_horizon(hours: Column, most: float = 2500.0) -> Column:
    """F23"""
    return F.least(F.greatest(hours, F.lit(0.0)), F.lit(most))
