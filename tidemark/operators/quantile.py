"""Exact quantiles without all values in one buffer: ranges of values are counted, and only the range that holds the rank is looked at again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.sources.tables import stored

#: Ranges that one pass counts.
RANGES = 4096


def _at_rank(values: DataFrame, rank: int, low: float, high: float) -> float:
    """The value of that rank (from 0) among values, all of which lie from low to high. Each pass over the values sums the counts of at most
    RANGES ranges before it shuffles them, and leaves those of one range; there the least and the largest value are the new bounds."""
    inside = values
    while low < high:
        if math.isinf(low) or math.isinf(high):  # finite numbers first, as one range
            part = F.when(F.abs("v") == math.inf, F.signum("v")).otherwise(0)
        elif high / 2 == low / 2:  # neighbours among the least numbers that there are
            part = F.col("v")
        else:  # halves, as the difference of the bounds could overflow
            part = F.least(F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * RANGES), F.lit(RANGES - 1))
        part = part.alias("part")
        for r in inside.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("part").collect():
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
        inside = inside.where(F.col("v").between(low, high))
    return low


def quantile(df: DataFrame, value: Column, share: float) -> float | None:
    """The quantile of a column's numbers, with linear interpolation, as ``percentile`` gives it. Nulls and NaN don't count; without numbers
    there is none."""
    values = df.select(F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("v")).where("v is not null")
    values = stored(values, "values")  # one column, read by each pass
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not whole.n:
        return None
    place = share * (whole.n - 1)
    a = _at_rank(values, math.floor(place), whole.low, whole.high)
    upto = values.agg(F.count_if(F.col("v") <= a).alias("n"), F.min(F.when(F.col("v") > a, F.col("v"))).alias("next")).first()
    b = a if math.ceil(place) < upto.n else upto.next
    return a if a == b else (math.ceil(place) - place) * a + (place - math.floor(place)) * b
