"""Games that agree in all but their id: steps compare what differs, and make no rows for each pair of observation and game."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests import test_matching as plain
from tidemark.operators import enrich, history, match

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def steps(monkeypatch):
    """Rows of each stored step, by name."""
    made, stored = {}, match.stored

    def counted(df, name):
        out = stored(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(match, "stored", counted)
    return made


def test_fallback_pairs_follow_listings_not_copies_of_games(spark, steps):
    sides = [(["a"], ["b", "x"]), (["b"], ["a", "x"]), (["c"], ["d", "x"]), (["e"], ["f", "x"])]
    full = [(["a", "x"], ["b", "x"]), (["c", "x"], ["d", "x"]), (["e", "x"], ["f", "x"])]
    snaps = [(f"s{i}", "p", *x, DAY) for i, x in enumerate(sides)]
    games = [(f"g{k:02}{i}", "p", *x, DAY) for k in range(30) for i, x in enumerate(full)]
    got = match.fallback_match(spark.createDataFrame(snaps, "snap " + plain.NAMED), spark.createDataFrame(games, "game_id " + plain.NAMED), "snap", time=("start_ts", "start_ts"))
    assert sorted((r.snap, r.game_id, r["pass"]) for r in got.collect()) == [("s0", "g000", 2), ("s1", "g010", 2), ("s2", "g001", 2), ("s3", "g002", 2)]
    assert max(n for name, n in steps.items() if name in ("greedy", "pairs", "near")) < 30


def joined(df) -> int:
    """Rows that the largest join of df's own plan puts out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        rows = p.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if "Join" in p.nodeName() and rows.isDefined() else 0)
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def flipped(spark):
    """60 games and observations of the same two sides on one day, half of the games the other way round; some lack a value."""
    games = [(f"g{i:02}", "p", *("ab" if i % 2 else "ba"), float(i) if i > 10 else None, float(100 + i) if i > 5 else None) for i in range(60)]
    snaps = [(f"s{i:02}", "p", "a", "b", 7.0) for i in range(60)] + [("t", "q", "a", "b", 8.0)]
    how = {"key": "snap", "on": {"day": "day"}, "home": ("home", "home_team"), "away": ("away", "away_team"), "swapped": [("hp", "ap")], "tie": "game_id"}
    return spark.createDataFrame(snaps, "snap string, day string, home string, away string, hp double"), spark.createDataFrame(games, "game_id string, day string, home_team string, away_team string, hp double, ap double"), how


def test_flipped_match_meets_no_pairs_of_rows(spark):
    snaps, games, how = flipped(spark)
    out = match.match_flipped(snaps.drop("hp"), games, fields=["hp", "ap"], **how)
    assert joined(out) <= 61
    assert {(r.snap[0], r.matched, r.hp, r.ap) for r in out.collect()} == {("s", True, 11.0, 107.0), ("t", False, None, None)}
    none = match.match_flipped(snaps.drop("hp"), games.where("game_id = 'g06'"), fields=["hp", "ap"], **how)
    assert {(r.snap[0], r.hp, r.ap) for r in none.collect()} == {("s", 106.0, None), ("t", None, None)}


def test_overwriting_match_meets_no_pairs_of_rows(spark):
    snaps, games, how = flipped(spark)
    out = match.overwrite_flipped(snaps, games, ["hp"], **how)
    assert joined(out) <= 61
    assert {(r.snap[0], r.hp) for r in out.collect()} == {("s", 11.0), ("t", 8.0)}
    # a match without a value sets none
    empty = match.overwrite_flipped(snaps, games.withColumns({"hp": games.hp * None, "ap": games.ap * None}), ["hp"], **how)
    assert {(r.snap[0], r.hp) for r in empty.collect()} == {("s", None), ("t", 8.0)}


def same_games(spark, n=40):
    """n games each of two pairs of sides on one day at one time, and one of another day and pair."""
    rows = [(f"{p}{i:02}", day, p.upper(), "X", [p, "w"], ["x", "w"], DAY, f"at {p}{i}", i) for p, day in (("g", "2024-01-01"), ("h", "2024-01-03")) for i in range(n)]
    return spark.createDataFrame(rows, "game_id string, day string, home_team string, away_team string, home_tokens array<string>, away_tokens array<string>, start_ts timestamp, venue string, week int")


def same_probes(spark, n=40):
    """n observations each: the same day and sides turned; the same day and other sides of similar names; another day."""
    asks = [("a", "2024-01-01", "X", "G", ["x", "w"], ["g", "w"]), ("b", "2024-01-03", "Q", "X", ["h"], ["x", "w"]), ("c", "2024-01-05", "H", "X", ["h", "w"], ["x", "w"])]
    rows = [(f"{a[0]}{i:02}", *a[1:], DAY) for a in asks for i in range(n)]
    return spark.createDataFrame(rows, "snap string, day string, home_team string, away_team string, home_tokens array<string>, away_tokens array<string>, start_ts timestamp")

def test_cascade_asks_once_for_what_agrees(spark, steps):
    out = match.backfill_cascade(same_probes(spark), same_games(spark), "snap", fuzzy=("start_ts", "start_ts"))
    assert {(r.snap[0], r.game_id, r.how) for r in out.collect()} == {("a", "g00", "same day"), ("b", "h00", "fuzzy"), ("c", "h00", "nearest day")} and out.count() == 120
    assert steps["asks"] == 3 and steps["firsts"] == 2 and steps["same-day"] == 1 and joined(out) <= 120


def test_cascade_takes_the_first_pass_of_keys_seen_with_several_asks(spark):
    out = match.backfill_cascade(same_probes(spark, 2).withColumn("snap", F.substring("snap", 2, 2)), same_games(spark, 2), "snap", fuzzy=("start_ts", "start_ts"))
    assert sorted(tuple(r) for r in out.collect()) == [("00", "g00", "same day"), ("01", "g00", "same day")]

def test_fields_are_filled_without_joins_of_keys(spark, steps):
    snaps = same_probes(spark).withColumns({"venue": F.when(F.col("snap") == "a01", "own").cast("string"), "week": F.when(F.col("snap").isin("a01", "b01"), 99)})
    out = match.fill_fields(snaps, same_games(spark), "snap", ["venue", "week"])
    want = {(p, v, 0) for p, v in (("a", "at g0"), ("b", "at h0"), ("c", "at h0"))}
    assert {(r.snap[0], r.venue, r.week) for r in out.collect() if r.snap not in ("a01", "b01")} == want and out.columns == snaps.columns
    assert {(r.snap, r.venue, r.week) for r in out.collect() if r.snap in ("a01", "b01")} == {("a01", "own", 99), ("b01", "at h0", 99)}
    assert steps["asks"] == 3 and joined(out) <= 120


def test_fields_of_keys_seen_several_times(spark):
    snaps = same_probes(spark, 1).withColumns({"snap": F.lit("k"), "venue": F.lit(None).cast("string"), "week": F.lit(None).cast("int")})
    out = match.fill_fields(snaps, same_games(spark, 2), "snap", ["venue", "week"])
    assert sorted((r.day, r.venue, r.week) for r in out.collect()) == [(d, "at g0", 0) for d in ("2024-01-01", "2024-01-03", "2024-01-05")]

def test_fuzzy_match_asks_once_for_what_agrees(spark, steps):
    out = match.fuzzy_match(same_probes(spark), same_games(spark), "snap", "day")
    assert {(r.snap[0], r.game_id, r.score, r.flipped) for r in out.collect()} == {("a", "g00", 1.0, True), ("b", "h00", 0.7875, False)} and out.count() == 80
    assert steps["asks"] == 3 and steps["observations"] == 3 and steps["games"] == 2 and joined(out) <= 80

def test_nearest_meeting_asks_once_for_what_agrees(spark, steps):
    out = match.nearest_meeting(same_probes(spark), same_games(spark), "snap", ("home_team", "away_team"), "day", more=("week",))
    assert {(r.snap[0], r.days_off, r.matched_game_id, r.week) for r in out.collect()} == {("a", 0, "g00", 0), ("c", 2, "h00", 0)} and out.count() == 80
    assert steps["asks"] == 3 and steps["firsts"] == 2 and joined(out) <= 80


def test_nearest_meeting_of_keys_seen_with_several_days(spark):
    probes = same_probes(spark, 2).selectExpr("'k' as snap", "'X' as home_team", "'G' as away_team", "date_add(to_date(day), 3) as day")
    out = match.nearest_meeting(probes, same_games(spark, 2), "snap", ("home_team", "away_team"), "day")
    assert [tuple(r) for r in out.collect()] == [("k", 3, "g00")]


def exchanges(df) -> int:
    """Shuffles in df's plan."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def league(spark, n=60):
    rows = [(f"g{i:02}", 2024, i // 20, DAY + datetime.timedelta(days=i // 4), "AB"[i % 2], "BA"[i % 2], float(i) if i % 3 else None, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "game_id string, season int, week int, start_ts timestamp, home_team string, away_team string, home_points double, away_points double")


def before(spark, n=60):
    """Previous completed differences of a league's games, as told one after the other, and as found over games dealt out by week."""
    games, last, want = league(spark, n), {}, {}
    for r in sorted(games.collect(), key=lambda r: (r.start_ts, r.game_id)):
        want[r.game_id] = (last.get(r.home_team), last.get(r.away_team))
        if r.home_points is not None:
            last[r.home_team], last[r.away_team] = r.home_points - 1, 1 - r.home_points
    sides = lambda g: enrich.team_games(g, ["game_id", "season", "week", "start_ts"])
    return want, history.previous_completed(sides(games), "point_diff", ["team"], ["start_ts", "game_id"], ["season", "week"], dealt=sides(games.repartition("season", "week")))


def test_previous_completed_shuffles_games_once(spark):
    want, out = before(spark)
    assert {(r.game_id, r.side): r.prev_point_diff for r in out.collect()} == {(g, s): w[i] for g, w in want.items() for i, s in enumerate("HA")}
    assert exchanges(out) == 1


def test_both_sides_come_back_without_a_shuffle(spark):
    want, out = before(spark)
    both = enrich.per_side(out, "game_id", "prev_point_diff", "last", along=["season", "week"])
    assert {r.game_id: (r.home_last, r.away_last) for r in both.collect()} == want and both.columns == ["game_id", "home_last", "away_last"]
    assert exchanges(both) == 1


def test_records_come_by_one_join_a_side(spark):
    games = league(spark)
    out = enrich.with_records(games, history.record_before_week(enrich.team_games(games, ["season", "week"])))
    got = {r.game_id: (r.home_wins, r.home_losses, r.away_wins, r.away_losses) for r in out.collect()}
    won = lambda team, week: sum((h > 1) + 0.5 * (h == 1) if r.home_team == team else (h < 1) + 0.5 * (h == 1) for r in games.collect() if (h := r.home_points) is not None and r.week < week)
    wins = {(t, w): float(won(t, w)) for t in "AB" for w in range(3)}
    assert got == {r.game_id: (wins[r.home_team, r.week], wins[r.away_team, r.week], wins[r.away_team, r.week], wins[r.home_team, r.week]) for r in games.collect()}
    own = games.select("game_id", "season", "week", "home_team", "away_team")
    bare = enrich.with_records(own, spark.createDataFrame([], "season int, team string, week int, wins double, losses double"))
    assert bare._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") == 2
