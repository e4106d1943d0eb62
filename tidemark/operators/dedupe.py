"""De-duplication with a stated order: which row stays never depends on how rows lie on disk.

Where one row of a group stays, it is an aggregate (the smallest or largest row by the order), summed before the shuffle, rather than a
window that sorts every group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def keep_by(df: DataFrame, keys: list[Column | str], order: list[Column], largest: bool = False) -> DataFrame:
    """The row of each key that comes first (or, with largest, last) by the order; a null in the order counts as smallest."""
    names = df.columns
    keys = [(F.col(k) if isinstance(k, str) else k).alias(f"__k{i}") for i, k in enumerate(keys)]
    pick = F.max_by if largest else F.min_by
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    return df.groupBy(*keys).agg(pick(F.struct(*names), rank).alias("__r")).select("__r.*").select(*names)


def _last_if_null(c: Column) -> tuple[Column, Column]:
    return c.isNull(), c


def best_offer(df: DataFrame, event: str, url: str, price: str, position: str) -> DataFrame:
    """Per event id, else link, the lowest price (missing ones last), then the first position; rows with neither are dropped."""
    key = F.coalesce(F.col(event).cast("string"), F.col(url).cast("string"))
    return keep_by(df.where(key.isNotNull()), [key], [*_last_if_null(F.col(price)), F.col(position)])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order; null keys are a key."""
    return keep_by(df, keys, [F.col(c) for c in order], largest=True)


def merge_latest(a: DataFrame, b: DataFrame, keys: list[str] | None, ts: str | None, tie: list[str]) -> DataFrame:
    """D3: the union with the latest row of each key; without keys, whole rows once; ordered."""
    both = a.unionByName(b, allowMissingColumns=True)
    out = keep_last(both, keys, [*([ts] if ts else []), *tie]) if keys else both.distinct()
    return out.orderBy(*(keys or []), *tie)


def distinct_by_cascade(df: DataFrame, candidates: list[list[str]], order: list[str]) -> DataFrame:
    """One row by the first candidate key whose columns all exist, else by all columns that can be compared."""
    keys = next((k for k in candidates if set(k) <= set(df.columns)), None)
    keys = keys or [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return keep_by(df, keys, [F.col(c) for c in order])


def earliest_start(df: DataFrame, event: str, start: str, tie: str) -> DataFrame:
    """One row an event, the earliest start (unknown ones last)."""
    return keep_by(df, [event], [*_last_if_null(F.col(start)), F.col(tie)])


def first_of_sorted(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the first by all columns."""
    return keep_by(df, [key], [F.col(c) for c in df.columns])


def undirected_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Different unordered pairs, without blanks and self pairs."""
    x, y = F.trim(a), F.trim(b)
    return df.where((x != "") & (y != "") & (x != y)).select(F.least(x, y).alias(a), F.greatest(x, y).alias(b)).distinct()


def adjacency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """For each node its sorted neighbours."""
    both = pairs.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(pairs.select(F.col(b).alias("node"), F.col(a).alias("other")))
    return both.groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("others"))


def opponents_in_order(df: DataFrame, home: str, away: str, start: str) -> DataFrame:
    """Each side's opponents by their first meeting."""
    first = df.groupBy(home, away).agg(F.min(start).alias("s"))
    return first.groupBy(home).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", away))), lambda x: x[away]).alias("opponents"))


def last_completed(team_games: DataFrame, team: str, start: str, tie: str, value: str, asof: str) -> DataFrame:
    """Each team's last completed game up to asof."""
    done = team_games.where(F.col(value).isNotNull() & (F.col(start) <= F.lit(asof).cast("timestamp")))
    return keep_by(done, [team], [F.col(start), F.col(tie)], largest=True)
