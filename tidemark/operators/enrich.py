"""Dimensions joined to games and observations: ranks, records, capacities, conferences, rivalries, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.match import unique_containment


def team_games(games: DataFrame, keys: list[str], home: str = "home_team", away: str = "away_team", home_points: str = "home_points", away_points: str = "away_points") -> DataFrame:
    """One row a side: side, team, opponent, points for and against, their difference."""
    sides = F.array(
        F.struct(F.lit("H").alias("side"), F.col(home).alias("team"), F.col(away).alias("opponent"), F.col(home_points).alias("points_for"), F.col(away_points).alias("points_against")),
        F.struct(F.lit("A").alias("side"), F.col(away).alias("team"), F.col(home).alias("opponent"), F.col(away_points).alias("points_for"), F.col(home_points).alias("points_against")),
    )
    return games.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*").withColumn("point_diff", F.col("points_for") - F.col("points_against"))


def per_side(rows: DataFrame, game: str, value: str, to: str, along: list[str] | None = None) -> DataFrame:
    """A team-game value back on its game, as home_ and away_ columns: one grouping instead of two joins. along names columns that a game
    has one value of; rows that lie dealt out by them stay where they are."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col(value)))
    return rows.groupBy(game, *(along or [])).agg(side("H").alias(f"home_{to}"), side("A").alias(f"away_{to}")).drop(*(along or []))


def best_poll(rankings: DataFrame, preference: list[str], by: list[str]) -> DataFrame:
    """Rows of the most preferred poll that a week has; unknown polls come last."""
    rank = F.coalesce(*(F.when(F.col("poll") == p, i) for i, p in enumerate(preference)), F.lit(len(preference) + 1))
    ranked = rankings.withColumn("__pref", rank)
    best = ranked.groupBy(*by).agg(F.min("__pref").alias("__best"))
    return ranked.join(best, by).where("__pref = __best").drop("__pref", "__best")


def closest_poll(polls: DataFrame, by: list[str], date: str, week: str, asof: Column, preference: list[str]) -> DataFrame:
    """of each group's polls (poll, week, date) the one whose date is nearest to asof; a date after asof counts as none, and polls
    with a date come first. Of equally near ones, or where none has a date, the highest week, then the more preferred poll. asof may be made
    of the group's columns. Rows of one poll and week are one candidate."""
    rank = F.coalesce(*(F.when(F.col("poll") == p, i) for i, p in enumerate(preference)), F.lit(len(preference)))
    known = F.when(F.col(date) <= asof, F.col(date))
    order = F.struct(known.isNull().alias("undated"), F.abs(F.datediff(asof, known)).alias("off"), (-F.col(week)).alias("week"), rank.alias("rank"), F.col("poll"), known.alias("date"))
    best = polls.groupBy(*by).agg(F.min(order).alias("b"))
    return best.select(*by, "b.poll", (-F.col("b.week")).alias(week), F.col("b.date").alias(date))


def side_lookup(games: DataFrame, dim: DataFrame, keys: dict[str, Column], value: str, to: str, home: str = "home_team", away: str = "away_team") -> DataFrame:
    """A dimension's value for both sides: dim has team, value and the key columns; keys give what a game has for them."""
    for side, team in (("home", home), ("away", away)):
        d = dim.select(F.col("team").alias("__team"), *(F.col(k).alias(f"__{k}") for k in keys), F.col(value).alias(f"{side}_{to}"))
        cond = F.col(team) == F.col("__team")
        for k, c in keys.items():
            cond = cond & (c == F.col(f"__{k}"))
        games = games.join(d, cond, "left").drop("__team", *(f"__{k}" for k in keys))
    return games


def rank_by_week(games: DataFrame, rankings: DataFrame, asof: str, start: str = "start_ts") -> DataFrame:
    """Past games by their week's poll, others by the season's latest; whether both sides are ranked."""
    last = rankings.groupBy("season").agg(F.max("week").alias("__last"))
    g = games.join(last, "season", "left").withColumn("__poll_week", F.when(F.col(start) < F.lit(asof).cast("timestamp"), F.col("week")).otherwise(F.col("__last")))
    out = side_lookup(g, rankings, {"season": F.col("season"), "week": F.col("__poll_week")}, "rank", "rank").drop("__poll_week", "__last")
    return out.withColumn("ranked_matchup", F.col("home_rank").isNotNull() & F.col("away_rank").isNotNull())


def lagged_rank(games: DataFrame, rankings: DataFrame) -> DataFrame:
    """The poll of the week before (0 at least; 1 where the week is unknown), ranks 1 to 25 only."""
    week = F.coalesce(F.greatest(F.col("week") - 1, F.lit(0)), F.lit(1))
    return side_lookup(games, rankings.where(F.col("rank").between(1, 25)), {"season": F.col("season"), "week": week}, "rank", "rank")


def keep_previous(now: DataFrame, before: DataFrame, keys: list[str], columns: list[str], past: Column) -> DataFrame:
    """In past rows, what is missing comes from the table's previous version."""
    old = before.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__old_{c}") for c in columns))
    cond = [F.col(k) == F.col(f"__{k}") for k in keys]
    out = now.join(old, cond, "left")
    return out.withColumns({c: F.when(past, F.coalesce(F.col(c), F.col(f"__old_{c}"))).otherwise(F.col(c)) for c in columns}).select(*now.columns)


def unique_by(dim: DataFrame, key: Column, value: str) -> DataFrame:
    """Key and value where the key stands for one row only."""
    return dim.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("__n"), F.max(value).alias("__value")).where("__n = 1 and __key <> ''").drop("__n")


def capacity_cascade(
    games: DataFrame, venues: DataFrame, exact, loose, alternates: DataFrame | None = None, venue: str = "venue", school: str = "school", home: str = "home_team", away: str = "away_team",
    neutral: str = "neutral_site",
) -> DataFrame:
    """A venue's capacity by its key if that is unique, else by its loose key, else of the one venue whose words contain or are
    contained in the loose key's, else from the table of alternates by key and loose key, else, where the site is not neutral, the home
    side's largest, else the away side's. exact and loose make keys of a column; ``capacity_from`` tells which step it was, from 1 to 7.
    """
    words = lambda key: F.array_remove(F.split(key, " "), "")
    names = games.select(F.col(venue).alias("__venue")).distinct().withColumns({"__exact": exact(F.col("__venue")), "__loose": loose(F.col("__venue"))}).withColumn("__words", F.array_sort(F.array_distinct(words(F.col("__loose")))))
    tables = [venues, *([alternates] if alternates is not None else [])]
    found = {}
    for t, table in enumerate(tables):
        for make, key in ((exact, "__exact"), (loose, "__loose")):
            step = len(found) + 1 + (t > 0 and len(found) == 2)
            known = unique_by(table, make(F.col(venue)), "capacity").select(F.col("__key").alias(key), F.col("__value").alias(f"__c{step}"))
            names, found[step] = names.join(known, key, "left"), f"__c{step}"
        if t == 0:
            subset = unique_containment(names.select("__words"), table.select(words(exact(F.col(venue))).alias("__words"), "capacity"), "__words", "capacity")
            names, found[3] = names.join(subset.withColumnRenamed("capacity", "__c3"), "__words", "left"), "__c3"
    largest = venues.where(F.col(school).isNotNull()).groupBy(F.col(school).alias("__school")).agg(F.max("capacity").alias("__most"))
    out = games.join(names.select("__venue", *found.values()), F.col(venue).eqNullSafe(F.col("__venue")), "left").drop("__venue")
    for step, side in ((6, home), (7, away)):
        out = out.join(largest.select(F.col("__school").alias(f"__s{step}"), F.col("__most").alias(f"__c{step}")), (F.col(side) == F.col(f"__s{step}")) & ~F.col(neutral), "left").drop(f"__s{step}")
        found[step] = f"__c{step}"
    steps = [found[k] for k in sorted(found)]
    which = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(int(c[3:]))) for c in steps))
    return out.withColumns({"capacity": F.coalesce(*steps), "capacity_from": which}).drop(*steps)


def usual_conference(games: DataFrame, home: str = "home_team", away: str = "away_team", home_conf: str = "home_conf", away_conf: str = "away_conf") -> DataFrame:
    """A10: each team's most frequent conference over both sides, the smallest of equally frequent ones."""
    both = games.select(F.explode(F.array(F.struct(F.col(home).alias("team"), F.col(home_conf).alias("conf")), F.struct(F.col(away).alias("team"), F.col(away_conf).alias("conf")))).alias("s")).select("s.*")
    return both.where("conf is not null").groupBy("team").agg(F.mode("conf", True).alias("conf"))


def fix_conferences(games: DataFrame, usual: DataFrame, overrides: DataFrame | None = None, home: str = "home_team", away: str = "away_team", home_conf: str = "home_conf", away_conf: str = "away_conf") -> DataFrame:
    """Both sides' conferences set to the usual one (an override wins), unknown teams as they are, and whether both are the same."""
    if overrides is not None:
        usual = usual.join(overrides.withColumnRenamed("conf", "__o"), "team", "full").select("team", F.coalesce("__o", "conf").alias("conf"))
    out = games
    for side, conf in ((home, home_conf), (away, away_conf)):
        u = usual.select(F.col("team").alias("__team"), F.col("conf").alias("__conf"))
        out = out.join(u, F.col(side) == F.col("__team"), "left").withColumn(conf, F.coalesce("__conf", F.col(conf))).drop("__team", "__conf")
    return out.withColumn("conference_game", F.coalesce(F.col(home_conf) == F.col(away_conf), F.lit(False)))


def mark_rivalry(games: DataFrame, pairs: DataFrame, home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Whether the two sides, in either order, are a pair of (team, rival)."""
    p = pairs.select(F.least("team", "rival").alias("__x"), F.greatest("team", "rival").alias("__y")).distinct()
    out = games.join(p, (F.least(home, away) == F.col("__x")) & (F.greatest(home, away) == F.col("__y")), "left")
    return out.withColumn("rivalry", F.col("__x").isNotNull()).drop("__x", "__y")


def with_records(games: DataFrame, records: DataFrame) -> DataFrame:
    """Wins and losses before the week, both sides; the key has the season. One join a side brings both."""
    for side in ("home", "away"):
        r = records.select(F.col("season").alias("__season"), F.col("week").alias("__week"), F.col("team").alias("__team"), *(F.col(c).alias(f"{side}_{c}") for c in ("wins", "losses")))
        games = games.join(r, (F.col("season") == F.col("__season")) & (F.col("week") == F.col("__week")) & (F.col(f"{side}_team") == F.col("__team")), "left").drop("__season", "__week", "__team")
    return games


def labels_by_priority(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """One row a key: columns of the first source that has the key, nulls as they are."""
    union = None
    for i, s in enumerate(sources):
        part = s.select(key, *columns).withColumn("__from", F.lit(i))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).agg(F.min(F.struct("__from", *columns)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def game_label(title: Column, home: Column, away: Column, key: Column) -> Column:
    """Title, else both sides, else the one there is, else the id."""
    sides = F.when(home.isNotNull() & away.isNotNull(), F.concat_ws(" vs ", home, away)).otherwise(F.coalesce(home, away))
    return F.coalesce(F.when(F.trim(title) != "", title), sides, key.cast("string"))


def schedule_lookup(probes: DataFrame, games: DataFrame, key: str, home: str = "home_team", away: str = "away_team", date: str = "day", tie: str = "game_id") -> DataFrame:
    """A pair's game: the same date first, then the same way round, then by tie. Returns key, tie, same_date, swapped.

    A probe meets the first game of its pair, date and way round, and the first one of its pair and way round, not all games of its pair."""
    x, y = F.least(home, away), F.greatest(home, away)
    first = games.groupBy(x.alias("__x"), y.alias("__y"), F.col(home).alias("__home"), F.col(date).alias("__date")).agg(F.min(tie).alias("__tie")).where("__x <> __y")
    ever = first.groupBy("__x", "__y", "__home").agg(F.min("__tie").alias("__tie"))
    p = probes.select(key, x.alias("x"), y.alias("y"), F.col(home).alias("h"), F.col(date).alias("d"))
    pair = (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y"))
    order = lambda other: F.struct(F.lit(other).alias("other_date"), (F.col("h") != F.col("__home")).alias("swapped"), F.col("__tie").alias(tie)).alias("m")
    rows = p.join(first, pair & (F.col("d") == F.col("__date"))).select(key, order(False)).unionByName(p.join(ever, pair).select(key, order(True)))
    return rows.groupBy(key).agg(F.min("m").alias("m")).select(key, f"m.{tie}", (~F.col("m.other_date")).alias("same_date"), "m.swapped")


def clock_text(time: Column) -> Column:
    """An ``HH:mm`` text as 7:05 PM; null where it is none."""
    at = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), F.trim(time)), F.lit("yyyy-MM-dd H:mm"))
    return F.date_format(at, "h:mm a")


def clock_of(at: Column) -> Column:
    """The time of day of a timestamp; null at midnight and at 03:00, which stand for an unknown time."""
    return F.when(~F.date_format(at, "HH:mm").isin("00:00", "03:00"), F.date_format(at, "h:mm a"))


def kickoff_text(by_id: list[Column], by_match: list[Column], own: list[Column]) -> Column:
    """The time to show of a game: what the schedule has under its id, then under its sides and date, then what the row says itself, each a
    chain of clock_text and clock_of columns; TBD where none of them tells."""
    return F.coalesce(*by_id, *by_match, *own, F.lit("TBD"))
