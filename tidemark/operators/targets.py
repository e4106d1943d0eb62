"""Labels and training tables without leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.times import hours_between
from tidemark.operators.history import EVENT, PRICE, TIE, TS, future_min, price_of
from tidemark.operators.quantile import quantile


def gap_targets(df: DataFrame, asof: str, price: str = PRICE, ts: str = TS, start: str = "start_ts", event: str = EVENT, tie: str = TIE) -> DataFrame:
    """W1-W4, A2, P14 on one shuffle by event: completed events use the event's lowest price, others the lowest to come.

    Adds event_min, event_min_ts, complete, future_min, hours_to_min, gap_pct (0 to 1, null for a price of 0) and past_min.
    """
    out = future_min(df, price, ts, event=event, tie=tie)
    whole = Window.partitionBy(event)
    best = F.min(F.when(price_of(price).isNotNull(), F.struct(price_of(price).alias("p"), F.col(ts).alias("t")))).over(whole)
    out = out.withColumns({"__event": best, "complete": F.coalesce(F.min(start).over(whole) < F.lit(asof).cast("timestamp"), F.lit(False))})
    out = out.withColumns({"event_min": F.col("__event.p"), "event_min_ts": F.col("__event.t")}).drop("__event")
    over = F.col("complete") & F.col("event_min").isNotNull()
    hours = F.greatest(hours_between(F.col("event_min_ts"), F.col(ts)), F.lit(0.0))
    out = out.withColumns({"future_min": F.when(over, F.col("event_min")).otherwise(F.col("future_min")), "hours_to_min": F.when(over, hours).otherwise(F.col("hours_to_min"))})
    gap = F.try_divide(F.greatest(price_of(price) - F.col("future_min"), F.lit(0.0)), price_of(price))
    gap = F.when((price_of(price) != 0) & F.col("future_min").isNotNull(), F.least(F.greatest(gap, F.lit(0.0)), F.lit(1.0)))
    return out.withColumns({"gap_pct": gap, "past_min": F.coalesce(F.col(ts) > F.col("event_min_ts"), F.lit(False))})


def clip_at_quantile(df: DataFrame, column: str, share: float = 0.995, approximate: bool = False) -> DataFrame:
    """Values above the quantile become the quantile (exact with linear interpolation, or, in one pass, a sketch's)."""
    limit = df.agg(F.percentile_approx(column, share, 10_000)).first()[0] if approximate else quantile(df, F.col(column), share)
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.least(F.col(column), F.lit(limit))))


def prune_by_importance(features: DataFrame, cutoff: float, pinned: list[str]) -> DataFrame:
    """Features in descending importance as long as the share before them is at most the cutoff; pinned ones always. The table has
    one row a feature of a model, so one partition orders it."""
    w = Window.orderBy(F.col("importance").desc(), "feature")
    total = F.sum("importance").over(Window.partitionBy())
    # the share up to the feature before, computed from sums up to it, so that rounding does not move the boundary
    before = F.coalesce(F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return features.withColumn("kept", (F.round(before / total, 9) <= cutoff) | F.col("feature").isin(pinned))


def group_time_split(df: DataFrame, share: float, event: str = EVENT, start: str = "start_ts") -> DataFrame:
    """The last share of events by their earliest start (one at least) are test, events without a start train; ties by id.

    How many events start on later days comes from a count by day, a table of days; only the day in which the split falls is decided by
    an order of its events. So no task and no driver orders all of them.
    """
    events = df.groupBy(event).agg(F.min(start).alias("__start")).where("__start is not null").withColumn("__day", F.to_date("__start"))
    days = events.groupBy("__day").agg(F.count(F.lit(1)).alias("__n"))
    days = days.withColumn("__later", F.sum("__n").over(Window.orderBy(F.col("__day").desc())) - F.col("__n"))
    wanted = events.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("__wanted"))
    place = F.row_number().over(Window.partitionBy("__day").orderBy(F.col("__start").desc(), F.col(event).desc()))
    chosen = events.withColumn("__place", place).join(days, "__day").join(F.broadcast(wanted), F.lit(True), "cross")
    chosen = chosen.where(F.col("__later") + F.col("__place") <= F.col("__wanted")).select(F.col(event).alias("__event"))
    return df.join(chosen, F.col(event) == F.col("__event"), "left").withColumn("is_test", F.col("__event").isNotNull()).drop("__event")


def event_weights(df: DataFrame, price: str = PRICE, event: str = EVENT, floor: float = 10.0, power: float = 1.5) -> DataFrame:
    """One over the event's rows, times a weight that falls with the price; a missing price counts as the median."""
    middle = F.lit(quantile(df, price_of(price), 0.5)).cast("double")
    n = df.groupBy(event).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(n, event).withColumn("weight", 1 / F.col("__n") * F.pow(1 / F.greatest(F.coalesce(price_of(price), middle), F.lit(floor)), F.lit(power))).drop("__n")
