"""Dates, times and horizons as column expressions. What can't be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE_FORMATS = ["M/d/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy"]
TIME_FORMATS = ["h:mm a", "h:mma", "H:mm:ss", "H:mm"]


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def parse_date(c: Column) -> Column:
    """the first of several formats that fits."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS)).cast("date")


def parse_time(c: Column) -> Column:
    """Time of day as HH:mm:ss text by the first format that fits."""
    x = F.upper(F.trim(c))
    return F.coalesce(*(F.date_format(F.try_to_timestamp(x, F.lit(f)), "HH:mm:ss") for f in TIME_FORMATS))


def display_time(c: Column) -> Column:
    """F8: ``h:mm AM``; text that is no time stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(parse_time(c), F.lit("HH:mm:ss")), "h:mm a"), c)


def snapshot_time(stamp: Column, date: Column, time: Column) -> Column:
    """the stamp, else date and time, else the date."""
    day = parse_date(date)
    both = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), parse_time(time)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(stamp, F.when(day.isNotNull() & parse_time(time).isNotNull(), both), day.cast("timestamp"))


def kickoff(date: Column, time: Column) -> Column:
    """date and, where it can be read, time."""
    return snapshot_time(F.lit(None).cast("timestamp"), date, time)


def placeholder_time(c: Column) -> Column:
    """blank, TBD, or one of the hours that stand for unknown (midnight and three at night)."""
    t = parse_time(c)
    return F.coalesce(F.trim(c) == "", F.lit(True)) | F.upper(F.trim(c)).isin("TBD", "TBA") | F.coalesce(t.isin("00:00:00", "03:00:00"), F.lit(False))


def eastern(c: Column) -> Column:
    """the wall clock in the east of the US of an instant kept in UTC."""
    return F.from_utc_timestamp(c.cast("timestamp"), "America/New_York")


def local_to_utc(c: Column, zone: str = "America/New_York") -> Column:
    """The instant of a wall-clock time; null where clocks leave it out or show it twice."""
    t = F.to_utc_timestamp(c, zone)
    hour = F.expr("interval 1 hour")
    missing = F.from_utc_timestamp(t, zone) != c
    twice = (F.from_utc_timestamp(t + hour, zone) == c) | (F.from_utc_timestamp(t - hour, zone) == c)
    return F.when(~missing & ~twice, t)


def part_of_day(hour: Column) -> Column:
    """F14"""
    return F.when(hour.between(6, 11), "Morning").when(hour.between(12, 17), "Afternoon").when(hour.between(18, 23), "Evening").otherwise("Night")


def season_state(date: Column) -> Column:
    """in season from August to January, before it from May on."""
    m = F.month(date)
    return F.when((m >= 8) | (m == 1), "In-season").when(m >= 5, "Pre-season").otherwise("Offseason")


def poll_date(month_day: Column, season: Column, asof: Column) -> Column:
    """``Jan 13`` within a season; January to March belong to the year after; a date after asof is null."""
    month = F.month(F.try_to_timestamp(F.concat(month_day, F.lit(" 2000")), F.lit("MMM d yyyy")))
    year = season + F.when(month <= 3, 1).otherwise(0)
    at = F.try_to_timestamp(F.concat_ws(" ", month_day, year.cast("string")), F.lit("MMM d yyyy")).cast("date")
    return F.when(at <= asof.cast("date"), at)


def hourly_grid(start: Column, days: int) -> Column:
    """the hours of the days before start, start included."""
    return F.sequence(start - F.make_interval(days=F.lit(days)), start, F.expr("interval 1 hour"))


def phased_grid(start: Column, end: Column) -> Column:
    """Mondays until August of the end's year, then days until a week before the end, then every six hours; start and end included."""
    season = F.make_date(F.year(end), F.lit(8), F.lit(1)).cast("timestamp")
    week = end - F.expr("interval 7 days")
    empty = F.array().cast("array<timestamp>")

    def steps(first: Column, last: Column, by: str) -> Column:
        return F.when(first <= last, F.sequence(first, last, F.expr(f"interval {by}"))).otherwise(empty)

    monday = F.date_trunc("day", start) + F.make_interval(days=F.pmod(7 - F.weekday(start), F.lit(7)))
    # a Monday grid keeps the start's time of day
    monday = monday + (start - F.date_trunc("day", start))
    one = F.when(start < F.least(season, end), steps(monday, F.least(season, end), "7 days")).otherwise(empty)
    two_from = F.greatest(start, season)
    two = F.when(two_from < F.least(week, end), steps(F.date_trunc("day", two_from), F.date_trunc("day", F.least(week, end)), "1 day")).otherwise(empty)
    three_from = F.greatest(start, week)
    three = F.when(three_from < end, steps(F.date_trunc("day", three_from), end, "6 hours")).otherwise(empty)
    return F.array_sort(F.array_distinct(F.concat(F.array(start, end), one, two, three)))
