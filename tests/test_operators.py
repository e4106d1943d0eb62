import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import text as x, times as tm
from tidemark.operators import dedupe, enrich, evaluate as ev, filters as p, history as h, match as m, model, quality as q, targets as t
from tidemark.sources import extract as ex, tables as io

T0 = dt.datetime(2024, 1, 1)


def at(k):
    return T0 + dt.timedelta(hours=k)


def snaps(spark, rows):
    return spark.createDataFrame([(i, e, at(k), price, start) for i, (e, k, price, start) in enumerate(rows)], "snap_id long, event_key long, snapshot_ts timestamp, lowest_price double, start_ts timestamp")


def test_future_min_with_nulls_nan_and_ties(spark):
    prices = [50.0, None, 40.0, 60.0, 40.0, 45.0]
    rows = [(1, k, v, None) for k, v in enumerate(prices)] + [(2, 0, None, None), (3, 0, float("nan"), None), (3, 1, 7.0, None), (4, 0, 5.0, None)]
    got = {r.snap_id: r for r in h.future_min(snaps(spark, rows)).collect()}
    assert [got[i].future_min for i in range(6)] == [40, 40, 40, 40, 40, 45]
    assert [got[i].hours_to_min for i in range(6)] == [2, 1, 0, 1, 0, 0]
    assert got[6].future_min is None and got[7].future_min == 7 and got[9].hours_to_min == 0


def test_targets(spark):
    rows = [(1, 0, 50.0, at(10)), (1, 1, 20.0, at(10)), (1, 2, 0.0, at(10)), (2, 0, 30.0, at(9000)), (2, 1, 10.0, at(9000)), (2, 2, 40.0, at(9000))]
    got = {r.snap_id: r for r in t.gap_targets(snaps(spark, rows), "2024-02-01 00:00:00").collect()}
    assert got[0].gap_pct == 1.0 and got[2].gap_pct is None and got[0].complete and not got[3].complete
    assert abs(got[3].gap_pct - 2 / 3) < 1e-12 and got[5].gap_pct == 0 and got[5].past_min


def test_split_has_no_event_on_both_sides(spark):
    rows = [(e, k, 1.0, at(100 + e) if e < 4 else None) for e in range(6) for k in range(2)]
    out = t.group_time_split(snaps(spark, rows), 0.5).select("event_key", "is_test").distinct().collect()
    assert len(out) == 6 and {r.event_key for r in out if r.is_test} == {2, 3}
    assert {r.event_key for r in t.group_time_split(snaps(spark, rows[:2]), 0.2).where("is_test").collect()} == {0}


def test_history_features(spark):
    got = h.history_features(snaps(spark, [(1, 0, 0.0, None), (1, 2, 10.0, None), (1, 3, 30.0, None)])).orderBy("snap_id").collect()
    assert [r.pct_change for r in got] == [None, None, 2.0] and [r.hours_since_prev for r in got] == [None, 2.0, 1.0]
    assert got[0].std3 is None and abs(got[1].std3 - 50**0.5) < 1e-9


def test_dedupe(spark):
    offers = spark.createDataFrame([("e", "u1", None, 0), ("e", "u2", 5.0, 1), ("e", "u3", 5.0, 2), (None, "u4", None, 3), (None, None, 1.0, 4)], "event string, url string, price double, pos int")
    assert sorted(r.pos for r in dedupe.best_offer(offers, "event", "url", "price", "pos").collect()) == [1, 3]
    a = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (None, "y", 1)], "k int, v string, ts int")
    once = dedupe.keep_last(a, ["k"], ["ts"])
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, dedupe.keep_last(once, ["k"], ["ts"]).collect()), key=repr) and once.count() == 2
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("", "c")], "x string, y string")
    assert [tuple(r) for r in dedupe.undirected_pairs(pairs, "x", "y").collect()] == [("a", "b")]


def games(spark, rows):
    return spark.createDataFrame(rows, "game_id string, day string, home_team string, away_team string, home_points double, away_points double").withColumn("day", F.to_date("day"))


def test_flipped_match_and_overwrite(spark):
    g = games(spark, [("g1", "2024-01-01", "A", "B", 1.0, None), ("g2", "2024-01-01", "B", "A", 7.0, 8.0), ("g3", "2024-01-01", "C", "D", None, None)])
    s = spark.createDataFrame([("s1", "2024-01-01", "A", "B", None), ("s2", "2024-01-01", "D", "C", 5.0), ("s3", "2024-01-01", "X", "C", 6.0)], "snap string, day string, home string, away string, home_points double").withColumn("day", F.to_date("day"))
    how = {"key": "snap", "on": {"day": "day"}, "home": ("home", "home_team"), "away": ("away", "away_team"), "swapped": [("home_points", "away_points")], "tie": "game_id"}
    got = {r.snap: r for r in m.match_flipped(s, g, fields=["home_points", "away_points"], **how).collect()}
    # direct wins by column; the flipped meeting fills what it lacks, with sides swapped
    assert (got["s1"].home_points, got["s1"].away_points) == (1.0, 7.0) and got["s2"].home_points == 5.0 and not got["s3"].matched
    over = {r.snap: r.home_points for r in m.overwrite_flipped(s, g, ["home_points"], **how).collect()}
    assert over == {"s1": 1.0, "s2": None, "s3": 6.0}


def test_as_of(spark):
    known = spark.createDataFrame([("A", 5, 1), ("A", 9, 2), ("A", 7, None)], "team string, ts int, rank int")
    probes = spark.createDataFrame([("p1", "A", 4), ("p2", "A", 5), ("p3", "A", 8), ("p4", "B", 9)], "k string, team string, ts int")
    assert {r.k: r.rank for r in m.as_of(probes, known, ["team"], "ts", "rank", "k").collect()} == {"p1": None, "p2": 1, "p3": 1, "p4": None}


def test_token_subset_does_not_depend_on_order(spark):
    names = spark.createDataFrame([("North Carolina Tar Heels",), ("Zzz",)], "n string")
    targets = spark.createDataFrame([("Carolina",), ("North Carolina",), ("Tar Pit",)], "t string")
    got = {r.n: r.resolved for r in m.token_subset(names, targets, "n", "t", x.tokens).collect()}
    assert got == {"North Carolina Tar Heels": "North Carolina", "Zzz": "Zzz"}
    assert got == {r.n: r.resolved for r in m.token_subset(names.repartition(7), targets.repartition(3), "n", "t", x.tokens).collect()}


def test_nearest_meeting_and_greedy(spark):
    g = games(spark, [("g1", "2024-01-05", "A", "B", None, None), ("g2", "2024-01-01", "B", "A", None, None)])
    probes = spark.createDataFrame([("p", "A", "B", "2024-01-03"), ("q", "A", "B", None)], "k string, home_team string, away_team string, day string").withColumn("day", F.to_date("day"))
    assert {r.k: (r.matched_game_id, r.days_off) for r in m.nearest_meeting(probes, g, "k", ("home_team", "away_team"), "day").collect()} == {"p": ("g1", 2), "q": ("g1", 9999)}
    c = spark.createDataFrame([(1, "a", "x", 0.9), (1, "b", "x", 0.95), (1, "a", "y", 0.5), (1, "b", "y", 0.1)], "d int, l string, r string, s double")
    assert sorted((r.l, r.r) for r in m.greedy_one_to_one(c, "d", "l", "r", "s").collect()) == [("a", "y"), ("b", "x")]


def test_conferences_rivalries_records(spark):
    g = spark.createDataFrame([("g1", "A", "B", "X", "Y", 2024, 1), ("g2", "A", "C", "Z", "Y", 2024, 3), ("g3", "D", "A", None, "X", 2024, 3)], "game_id string, home_team string, away_team string, home_conf string, away_conf string, season int, week int")
    fixed = {r.game_id: r for r in enrich.fix_conferences(g, enrich.usual_conference(g)).collect()}
    assert fixed["g2"].home_conf == "X" and fixed["g3"].home_conf is None and not fixed["g3"].conference_game
    riv = spark.createDataFrame([("B", "A")], "team string, rival string")
    assert [r.rivalry for r in enrich.mark_rivalry(g, riv).orderBy("game_id").collect()] == [True, False, False]
    tg = spark.createDataFrame([(2024, "A", 1, 3.0), (2024, "B", 1, 0.0), (2024, "A", 2, -1.0), (2024, "C", 3, None)], "season int, team string, week int, point_diff double")
    rec = {(r.team, r.week): (r.wins, r.losses) for r in h.record_before_week(tg).collect()}
    assert rec[("A", 3)] == (1.0, 1.0) and rec[("B", 2)] == (0.5, 0.5) and rec[("C", 3)] == (0.0, 0.0)


def test_names_links_and_times(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(x.normalize_name(F.lit("The Texas A&M St. (Football)"))) == "texas a m" and one(x.normalize_name(F.lit(None).cast("string"))) == ""
    assert one(x.matchup(x.clean_title(F.lit("Week 1: A  vs. B - ")), 2)) == "B" and one(x.matchup(F.lit("no sides"), 1)) is None
    url = F.lit("https://t.example/a-vs-b-9-12-25-12pm/1234567?x=1")
    assert (one(x.url_date(url)), one(x.url_time(url)), one(x.url_number(url))) == ("2025-09-12", "12:00", "1234567")
    assert [one(tm.placeholder_time(F.lit(v).cast("string"))) for v in ("TBD", "", "00:00", "3:00 AM", "3:30 PM", None)] == [True, True, True, True, False, True]
    assert [one(tm.local_to_utc(F.lit(v).cast("timestamp"))) for v in ("2026-03-08 02:30:00", "2026-11-01 01:30:00")] == [None, None]
    assert one(tm.local_to_utc(F.lit("2026-10-01 19:00:00").cast("timestamp"))) == dt.datetime(2026, 10, 1, 23)
    assert one(tm.poll_date(F.lit("Jan 13"), F.lit(2025), F.lit("2026-02-01"))) == dt.date(2026, 1, 13) and one(tm.poll_date(F.lit("Nov 3"), F.lit(2026), F.lit("2026-02-01"))) is None
    assert [one(p.to_boolean(F.lit(v))) for v in ("Yes", "1.0", "f", "maybe")] == [True, True, False, False]
    grid = one(tm.phased_grid(F.lit("2024-07-25 10:00:00").cast("timestamp"), F.lit("2024-08-20 19:00:00").cast("timestamp")))
    assert grid[0] == dt.datetime(2024, 7, 25, 10) and grid[-1] == dt.datetime(2024, 8, 20, 19) and dt.datetime(2024, 8, 5) in grid and dt.datetime(2024, 8, 19, 6) in grid


def test_evaluation_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (20.0, 25.0), (19.99, 20.0)], "y double, p double")
    got = {r.bucket: r.mae for r in ev.mae_by_bucket(df, "y", "p").collect()}
    assert abs(got[0] - 0.505) < 1e-9 and got[1] == 5.0 and got[4] is None
    assert ev.regression_metrics(df, "y", "p", 1.0, 0.05).first().n == 3
    assert [r.kept for r in t.prune_by_importance(spark.createDataFrame([("a", 60.0), ("b", 30.0), ("c", 10.0), ("d", 0.0)], "feature string, importance double"), 0.6, ["d"]).orderBy("feature").collect()] == [True, True, False, True]
    bad = q.health(spark.createDataFrame([("3:30 PM",)] * 19 + [("later",)], "t string"), {"time": tm.parse_time(F.col("t"))}, F.lit("2024-01-25").cast("date"), "2024-02-01").first()
    assert bad.fresh and abs(bad.time_ratio - 0.95) < 1e-12 and not bad.ok


def test_pages(spark):
    html = '<script type="application/ld+json">[{"@type":"SportsEvent","name":"A vs. B","url":"u","offers":[{"lowPrice":"12.5"},{"lowPrice":null,"highPrice":30}]}]</script><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"Event","name":"C","offers":{"lowPrice":3,"url":"w"}}</script>'
    rows = ex.offer_rows(ex.json_blocks(spark.createDataFrame([(1, html)], "page int, html string")), ["page"]).orderBy("block_no").collect()
    assert [(r.title, r.low_price, r.high_price, r.offer_url) for r in rows] == [("A vs. B", 12.5, 30.0, "u"), ("C", 3.0, None, "w")]
    text = F.lit("There are 1,234 tickets still available; average ticket price is $ 56.10")
    one = spark.range(1).select(ex.number_after(text, ex.AVAILABLE).alias("n"), ex.number_after(text, ex.AVERAGE).alias("a")).first()
    assert (one.n, one.a) == (1234.0, 56.1)
    s = ex.event_summary(spark.createDataFrame([(1, 0, None, None), (1, 1, 5.0, 9.0)], "page int, pos int, low_price double, high_price double"), "page", "pos").first()
    assert (s.low_price, s.average_price) == (5.0, 7.0)
    raw = spark.createDataFrame([([(2025, 1, [("AP", [(1, "A", None, 3), (None, "B", None, None), (2, None, "C", None)])])],)], "weeks array<struct<season:int,week:int,polls:array<struct<poll:string,ranks:array<struct<rank:int,school:string,team:string,firstPlaceVotes:int>>>>>>")
    assert [(r.rank, r.school, r.first_place_votes) for r in ex.flatten_rankings(raw).orderBy("rank").collect()] == [(1, "A", 3), (2, "C", 0)]
    st = ex.clean_stadiums(spark.createDataFrame([("Team[1]", "Big Field", "12,345[2] seats", "X", "YY")], "`Team name` string, Stadium string, Capacity string, City string, State string")).first()
    assert (st.school, st.capacity) == ("Team", 12345)
    rk = ex.clean_rankings(spark.createDataFrame([("T-2", "Beta (3-1)"), ("1", "Alpha [a] (12)"), ("x", "Gamma")], "rank string, team string")).collect()
    assert [(r.rank, r.school, r.first_place_votes) for r in rk] == [(1, "Alpha", 12), (2, "Beta", 0)]


def test_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert io.read_json_table(spark, str(tmp_path / "a.json")).count() == 2 and io.read_json_table(spark, str(tmp_path / "b.json")).count() == 3
    files = spark.createDataFrame([("/d/archive/p_2024.csv",), ("/d/p_2024.csv",), ("/d/p_2023.csv",), ("/d/other.csv",)], "path string")
    assert [(r.season_year, r.path) for r in io.best_file_per_year(files).orderBy("season_year").collect()] == [(2023, "/d/p_2023.csv"), (2024, "/d/p_2024.csv")]
    years = spark.createDataFrame([(2022,), (2026,)], "y int")
    assert io.nearest_year(years, "y", 2024).first().y == 2022


def test_model_pieces(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    vocab = model.vocabulary(df, "c")
    assert [(r.value, r["index"]) for r in vocab.orderBy("value").collect()] == [("a", 1), ("b", 2)]
    assert sorted(r.i for r in model.encode(df, "c", vocab, "i").collect()) == [0, 1, 2, 2]


def test_results_do_not_depend_on_partitions(spark):
    rows = snaps(spark, [(k % 5, k * 7 % 11, float(k * 13 % 17), at(50)) for k in range(60)])
    for op in (lambda d: h.future_min(d), lambda d: dedupe.keep_last(d, ["event_key"], ["snapshot_ts", "snap_id"]), lambda d: h.observed_min(d)):
        assert sorted(map(str, op(rows.repartition(1)).collect())) == sorted(map(str, op(rows.repartition(17)).collect()))
