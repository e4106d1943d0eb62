"""Price histories: windows over the observations of one event, and what they sum up to.

One shuffle by event serves all of the windows; the smallest price with its time is a minimum over (price, time), never a self-join.
Prices that are NaN count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.times import hours_between
from tidemark.sources.tables import stored

EVENT, TS, PRICE, TIE = "event_key", "snapshot_ts", "lowest_price", "snap_id"


def price_of(price: str = PRICE) -> Column:
    return F.nanvl(F.col(price), F.lit(None).cast("double"))


def ordered(event: str = EVENT, ts: str = TS, tie: str = TIE):
    return Window.partitionBy(event).orderBy(F.col(ts).asc_nulls_last(), F.col(tie).asc_nulls_last())


def future_min(df: DataFrame, price: str = PRICE, ts: str = TS, **keys) -> DataFrame:
    """The lowest price from each observation on, its first time, and the hours until then; observations without a price look ahead."""
    ahead = ordered(ts=ts, **keys).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    best = F.min(F.when(price_of(price).isNotNull(), F.struct(price_of(price).alias("p"), F.col(ts).alias("t")))).over(ahead)
    df = df.withColumn("__best", best)
    return df.withColumns({"future_min": F.col("__best.p"), "min_ts": F.col("__best.t"), "hours_to_min": hours_between(F.col("__best.t"), F.col(ts))}).drop("__best")


def history_features(df: DataFrame, price: str = PRICE, ts: str = TS, **keys) -> DataFrame:
    """Previous price, change, relative change, mean and deviation of the last three, number so far, hours since the last one."""
    w = ordered(ts=ts, **keys)
    last3 = w.rowsBetween(-2, 0)
    p = price_of(price)
    before = F.lag(p).over(w)
    return df.withColumns(
        {
            "prev_price": before,
            "delta": p - before,
            "pct_change": F.try_divide(p - before, before),
            "mean3": F.avg(p).over(last3),
            "std3": F.when(F.count(p).over(last3) >= 2, F.stddev_samp(p).over(last3)),
            "snapshot_number": F.row_number().over(w),
            "hours_since_prev": hours_between(F.col(ts), F.lag(ts).over(w)),
        }
    )


def observed_min(df: DataFrame, cutoff: str | None = None, price: str = PRICE, ts: str = TS, event: str = EVENT) -> DataFrame:
    """A1: the lowest price of each event, to cents, and its earliest time, at the cutoff at the latest."""
    if cutoff:
        df = df.where(F.col(ts) <= F.lit(cutoff).cast("timestamp"))
    best = F.min(F.when(price_of(price).isNotNull(), F.struct(price_of(price).alias("p"), F.col(ts).alias("t"))))
    return df.groupBy(event).agg(best.alias("b")).select(event, F.round("b.p", 2).alias("observed_min"), F.col("b.t").alias("observed_ts"))


def event_min(df: DataFrame, asof: str, price: str = PRICE, ts: str = TS, start: str = "start_ts", event: str = EVENT) -> DataFrame:
    """A2: lowest price, its earliest time, and whether the event has started."""
    best = F.min(F.when(price_of(price).isNotNull(), F.struct(price_of(price).alias("p"), F.col(ts).alias("t"))))
    out = df.groupBy(event).agg(best.alias("b"), F.min(start).alias("first_start"))
    return out.select(event, F.col("b.p").alias("event_min"), F.col("b.t").alias("event_min_ts"), F.coalesce(F.col("first_start") < F.lit(asof).cast("timestamp"), F.lit(False)).alias("complete"))


def min_near_prediction(snaps: DataFrame, predictions: DataFrame, price: str = PRICE, ts: str = TS, start: str = "start_ts", event: str = EVENT) -> DataFrame:
    """A3: the lowest price before the start; of equal ones that nearest to the predicted time, then the earliest."""
    rows = snaps.where((F.col(ts) < F.col(start)) & price_of(price).isNotNull()).join(predictions.select(event, "predicted_ts"), event, "left")
    far = F.coalesce(F.abs(hours_between(F.col(ts), F.col("predicted_ts"))), F.lit(float("inf")))
    best = rows.groupBy(event).agg(F.min(F.struct(price_of(price).alias("p"), far.alias("d"), F.col(ts).alias("t"))).alias("b"))
    return best.select(event, F.col("b.p").alias("actual_price"), F.col("b.t").alias("actual_ts"))


def daily_mean(df: DataFrame, price: str = PRICE, ts: str = TS, event: str = EVENT) -> DataFrame:
    """A4"""
    return df.groupBy(event, F.to_date(ts).alias("day")).agg(F.avg(price_of(price)).alias("mean_price"))


def latest(df: DataFrame, ts: str = TS, tie: str = TIE, event: str = EVENT) -> DataFrame:
    """The last observation of each event, all columns."""
    whole = F.struct(*df.columns)
    return df.groupBy(event).agg(F.max_by(whole, F.struct(ts, tie)).alias("r")).select("r.*")


def favourites(snaps: DataFrame, chosen: DataFrame, predictions: DataFrame, price: str = PRICE, ts: str = TS, tie: str = TIE, event: str = EVENT) -> DataFrame:
    """For chosen events the current price, the lowest so far and its time, the predicted one, whether to buy now and whether a
    cheaper price than predicted was seen already."""
    rows = snaps.join(chosen.select(event).distinct(), event, "left_semi")
    out = rows.groupBy(event).agg(
        F.max_by(F.struct(price_of(price).alias("p")), F.struct(ts, tie)).alias("now"),
        F.min(F.when(price_of(price).isNotNull(), F.struct(price_of(price).alias("p"), F.col(ts).alias("t")))).alias("low"),
    )
    out = out.join(predictions.select(event, "predicted_price"), event, "left")
    return out.select(
        event, F.col("now.p").alias("current_price"), F.col("low.p").alias("lowest_observed"), F.col("low.t").alias("lowest_ts"), "predicted_price",
        F.coalesce(F.col("now.p") <= F.col("predicted_price"), F.lit(False)).alias("buy_now"),
        F.coalesce(F.col("low.p") < F.col("predicted_price"), F.lit(False)).alias("cheaper_seen"),
    )


def previous_completed(team_games: DataFrame, value: str, partition: list[str], order: list[str], stretch: list[str], dealt: DataFrame | None = None) -> DataFrame:
    """The last value that is not null before each row, as prev_<value>.

    Two levels: within a stretch of time (columns that grow with the order, such as season and week) by a window over the stretch's rows, and
    from earlier stretches by a window over their last values, of which there is one a stretch. So no window orders all rows of a team.
    dealt: the same rows, if they are dealt out by stretch already (games before they become two rows each); the window then shuffles nothing.
    """
    asc = [F.col(c).asc_nulls_last() for c in order]
    place = F.struct(*(c for name in order for c in (F.col(name).isNull(), F.col(name))))
    within = Window.partitionBy(*partition, *stretch).orderBy(*asc).rowsBetween(Window.unboundedPreceding, -1)
    lasts = team_games.where(F.col(value).isNotNull()).groupBy(*partition, *stretch).agg(F.max_by(value, place).alias("__last"))
    stretches = team_games.select(*partition, *stretch).distinct().join(lasts, [*partition, *stretch], "left")
    before = Window.partitionBy(*partition).orderBy(*stretch).rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(stretches.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).drop("__last"), "carried")
    rows = team_games if dealt is None else dealt
    out = rows.withColumn("__within", F.last(value, ignorenulls=True).over(within)).join(carried, [*partition, *stretch], "left")
    return out.withColumn(f"prev_{value}", F.coalesce("__within", "__carried")).drop("__within", "__carried")


def record_before_week(team_games: DataFrame, season: str = "season", team: str = "team", week: str = "week") -> DataFrame:
    """Wins and losses before each week, for every team and week of a season; a tie counts half on both sides."""
    diff = F.col("point_diff")
    each = team_games.where(diff.isNotNull()).withColumns({"w": F.when(diff > 0, 1.0).when(diff == 0, 0.5).otherwise(0.0), "l": F.when(diff < 0, 1.0).when(diff == 0, 0.5).otherwise(0.0)})
    each = each.groupBy(season, team, week).agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    # teams and weeks of one season: an equi-join on the season of two short lists
    every = team_games.select(season, team).distinct().join(team_games.select(season, week).distinct(), season)
    before = Window.partitionBy(season, team).orderBy(week).rowsBetween(Window.unboundedPreceding, -1)
    rows = every.join(each, [season, team, week], "left")
    return rows.select(season, team, week, F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("wins"), F.coalesce(F.sum("l").over(before), F.lit(0.0)).alias("losses"))


def upcoming_else_first(df: DataFrame, pair: list[str], start: str, tie: str, asof: str) -> DataFrame:
    """For each pair the next event from asof on, or the first one if none is to come."""
    to_come = F.col(start) >= F.lit(asof).cast("timestamp")
    return df.groupBy(*pair).agg(F.min_by(F.struct(*[c for c in df.columns if c not in pair]), F.struct((~to_come).alias("past"), F.col(start), F.col(tie))).alias("r")).select(*pair, "r.*")


def worst_first(df: DataFrame, by: str, tie: str, limit: int | None = None) -> DataFrame:
    """Descending, nulls last; with a limit Spark keeps the top rows of each partition only."""
    out = df.orderBy(F.col(by).desc_nulls_last(), F.col(tie))
    return out.limit(limit) if limit else out
