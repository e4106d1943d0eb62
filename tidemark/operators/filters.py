"""Which rows count: predicates and filters of the price-history domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import POSTSEASON, blank
from tidemark.functions.times import micros

TRUE, FALSE = ["true", "1", "yes", "y", "t"], ["false", "0", "no", "n", "f"]


def is_postseason(title: Column, known: Column | None = None) -> Column:
    """The known flag, else by words of the title."""
    by_title = F.coalesce(title.rlike(POSTSEASON), F.lit(False))
    return by_title if known is None else F.coalesce(known, by_title)


def undecided(*names: Column, url: Column | None = None) -> Column:
    """A name is missing or holds tbd or tba, or the link says so."""
    out = F.lit(False)
    for n in names:
        out = out | blank(n) | F.coalesce(F.lower(n).rlike("tbd|tba"), F.lit(False))
    return out if url is None else out | F.coalesce(F.lower(url).contains("-tbd"), F.lit(False))


def of_season(year: Column, season: int, postseason: Column) -> Column:
    """Of that year, of an unknown one, or after the regular season."""
    return year.isNull() | (year == season) | postseason


def not_started(start: Column, asof: str) -> Column:
    """From asof on, or unknown."""
    return start.isNull() | (start >= F.lit(asof).cast("timestamp"))


def in_season_window(ts: Column, season: int) -> Column:
    """P5: from March of the season to January after it."""
    return (ts >= F.lit(f"{season}-03-01").cast("timestamp")) & (ts < F.lit(f"{season + 1}-02-01").cast("timestamp"))


def near_kickoff(start: Column, at: Column, before: int = 30, after: int = 15) -> Column:
    """The start lies from before minutes before to after minutes after a time."""
    return start.between(at - F.make_interval(mins=F.lit(before)), at + F.make_interval(mins=F.lit(after)))


def completed(df: DataFrame, home: str, away: str, same: tuple[str, str] | None = None) -> DataFrame:
    """Games with both scores, if wanted with both sides of one class, and the signed differences."""
    out = df.where(F.col(home).isNotNull() & F.col(away).isNotNull())
    if same:
        out = out.where(F.col(same[0]) == F.col(same[1]))
    return out.withColumns({"home_point_diff": F.col(home) - F.col(away), "away_point_diff": F.col(away) - F.col(home)})


def future_or_all(df: DataFrame, start: str, asof: str) -> DataFrame:
    """Rows to come; all rows if none is to come. One aggregated row tells which."""
    ahead = F.coalesce(F.col(start) >= F.lit(asof).cast("timestamp"), F.lit(False))
    some = df.agg(F.coalesce(F.max(ahead), F.lit(False)).alias("__some"))
    return df.join(F.broadcast(some), F.lit(True), "cross").where(ahead | ~F.col("__some")).drop("__some")


def usable(df: DataFrame, target: str, horizon: str) -> DataFrame:
    """P9"""
    return df.where(F.col(target).isNotNull() & (F.col(horizon) > 0))


def several_completed(df: DataFrame, event: str, complete: str) -> DataFrame:
    """P10: rows of completed events with more than one observation. Counts are summed before the shuffle."""
    done = df.where(F.col(complete))
    return done.join(done.groupBy(event).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(event), event, "left_semi")


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """P12"""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def to_boolean(c: Column) -> Column:
    """True for the usual spellings, false for everything else and null."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(c.cast("string"), r"\.0$", ""))).isin(TRUE), F.lit(False))


def confidence(hours: Column, *signals: Column) -> Column:
    """By hours until the start and how many signals there are."""
    n = sum((s.isNotNull().cast("int") for s in signals), F.lit(0))
    return F.when((hours <= 168) & (n >= 3), "High").when((hours <= 336) & (n >= 2), "Medium").otherwise("Low")


def already_past(ts: Column, min_ts: Column) -> Column:
    """Whether an observation comes after its event's lowest price."""
    return F.coalesce(micros(ts) > micros(min_ts), F.lit(False))


def fill_defaults(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Missing columns by kind: false, 0.0 or an empty text."""
    empty = {"bool": F.lit(False), "num": F.lit(0.0), "cat": F.lit("")}
    return df.withColumns({c: empty[k] for c, k in required.items() if c not in df.columns})


def guess_kind(name: str) -> str:
    """The kind of a column by its name."""
    low = name.lower()
    if low.startswith(("is", "has")) or low.endswith(("site", "game", "_missing", "matchup")):
        return "bool"
    return "num" if any(x in low for x in ("price", "hours", "days", "rank", "diff", "capacity", "count", "week", "wins", "losses")) else "cat"


def reproducible_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """N rows, the same ones at every run."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def matched(home: Column, away: Column, *enriched: Column) -> Column:
    """Both sides are known and some enriched field is."""
    some = F.lit(False)
    for c in enriched:
        some = some | ~blank(c)
    return ~blank(home) & ~blank(away) & some
