"""Similarity joins, one-to-one matching, containment, quantiles and models against plain forms."""

import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import enrich, history, match, model, quantile
from tidemark.plans import catalog, misc_queries
from tidemark.plans.views import Views

SF = "/root/testdata/sf0.001"
NAMED = "string, day string, home_tokens array<string>, away_tokens array<string>, start_ts timestamp"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def score(s, g, timed):
    h, a, x, y = (set(v) for v in (s[2], s[3], g[2], g[3]))
    names = max(jaccard(h, x) + jaccard(a, y), jaccard(h, y) + jaccard(a, x)) / 2
    if not timed:
        return round(names, 9)
    near = math.exp(-abs((s[4] - g[4]).total_seconds() / 60) / 60) if s[4] and g[4] else 0.0
    return round(0.85 * names + 0.15 * near, 9)


def listings(seed, n=40):
    random.seed(seed)
    words, days = "a b c d e f g".split(), "p q r s t".split()
    names = lambda: random.sample(words, random.randrange(0 if seed else 1, 4))
    time = lambda: random.choice([None, datetime.datetime(2024, 1, 1, random.randrange(24), random.randrange(0, 60, 20))])
    rows = lambda c: [(f"{c}{i:02}", random.choice([*days, None]) if seed else random.choice(days), names(), names(), time()) for i in range(n)]
    games, snaps = rows("g"), rows("s")
    games.append(("gz", "alone", ["z"], ["y"], None))
    snaps += [("sz", "alone", ["x"], ["w"], None), *((f"t{i}", *snaps[i][1:]) for i in range(5))]
    return snaps, games


def check_fuzzy(spark, snaps, games):
    want = {}
    for s in snaps:
        scored = [(-score(s, g, True), g[0]) for g in games if s[1] is not None and g[1] == s[1] and max(jaccard(set(s[2]), set(g[2])) + jaccard(set(s[3]), set(g[3])), jaccard(set(s[2]), set(g[3])) + jaccard(set(s[3]), set(g[2]))) > 0]
        if scored and -min(scored)[0] >= 0.35:
            want[s[0]] = (min(scored)[1], -min(scored)[0])
    got = match.fuzzy_match(spark.createDataFrame(snaps, "snap " + NAMED), spark.createDataFrame(games, "game_id " + NAMED), "snap", "day")
    assert {r.snap: (r.game_id, r.score) for r in got.collect()} == want and want


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_fuzzy_match_against_all_pairs(spark, seed):
    check_fuzzy(spark, *listings(seed))


@pytest.mark.parametrize("missing", [0.0, 0.1])
def test_fuzzy_match_of_few_pairs_seen_often(spark, missing):
    """Pairs of sides with many observations and games of a day, at times near and far: bounds on time leave what can win."""
    rng = random.Random(4)
    sides = [["a"], ["a", "b"], ["a", "b", "c"], ["d", "e"]]
    time = lambda far: None if rng.random() < missing else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(far))
    rows = lambda c, n, far: [(f"{c}{i:03}", rng.choice("pq"), rng.choice(sides), rng.choice(sides), time(far)) for i in range(n)]
    for far in (30, 900):
        check_fuzzy(spark, rows("s", 150, far), rows("g", 30, far))


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample("abcdefghijkl", rng.randrange(7))) for _ in range(120)]
    df = spark.createDataFrame([(s,) for s in sets], "words array<string>")
    for least in (0.235, 0.5, 1.0):
        got = {(tuple(r.a), tuple(r.b)) for r in match.similar_sets(df.limit(60), df, least).collect()}
        assert got == {(tuple(a), tuple(b)) for a in sets[:60] for b in sets if a and b and jaccard(set(a), set(b)) >= least}


def one_by_one(pairs):
    left, right, out = set(), set(), []
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, -s))
    return sorted(out)


def test_rounds_of_best_pairs_equal_one_after_the_other(spark):
    rng = random.Random(4)
    pairs = [(f"l{a}", f"r{b}", rng.randrange(5) / 4) for a in range(25) for b in range(25) if rng.random() < 0.3]
    pairs += [(f"c{k}", f"d{k + j}", float(2 * k + j)) for k in range(12) for j in (0, 1)]  # a chain, which takes many rounds
    df = spark.createDataFrame([("x", *p) for p in pairs], "block string, l string, r string, s double")
    got = match.greedy_one_to_one(df, "block", "l", "r", "s")
    assert sorted((r.l, r.r, r.s) for r in got.collect()) == one_by_one(pairs)
    assert match.greedy_one_to_one(df.limit(0), "block", "l", "r", "s").count() == 0


@pytest.mark.parametrize("timed", [True, False])
def test_fallback_match_against_a_plain_form(spark, timed):
    snaps, games = listings(0)
    once = {}
    for s in snaps:
        k = (s[1], tuple(sorted(s[2])), tuple(sorted(s[3])), s[4] if timed else None)
        once[k] = min(once.get(k, s[0]), s[0])
    of, out = {s[0]: s for s in snaps}, {}
    for k in once.values():
        same = [(-score(of[k], g, timed), g[0]) for g in games if g[1] == of[k][1] and {frozenset(g[2]), frozenset(g[3])} == {frozenset(of[k][2]), frozenset(of[k][3])}]
        if same:
            out[k] = (min(same)[1], 0, -min(same)[0])
    taken = {v[0] for v in out.values()}
    rest, free = [k for k in once.values() if k not in out], [g for g in games if g[0] not in taken]
    for day in {of[k][1] for k in rest}:
        a, b = [k for k in rest if of[k][1] == day], [g for g in free if g[1] == day]
        if len(a) == len(b) == 1:
            out[a[0]] = (b[0][0], 1, None)
    taken = {v[0] for v in out.values()}
    pairs = [(k, g[0], score(of[k], g, timed)) for k in rest if k not in out for g in free if g[0] not in taken and g[1] == of[k][1] and {*g[2], *g[3]} & {*of[k][2], *of[k][3]}]
    out |= {k: (g, 2, s) for k, g, s in one_by_one(pairs)}
    want = sorted((s[0], *out[k]) for s in snaps if (k := once[(s[1], tuple(sorted(s[2])), tuple(sorted(s[3])), s[4] if timed else None)]) in out)
    time = ("start_ts", "start_ts") if timed else None
    got = match.fallback_match(spark.createDataFrame(snaps, "snap " + NAMED), spark.createDataFrame(games, "game_id " + NAMED), "snap", time=time)
    assert sorted(map(tuple, got.collect())) == want and {r[2] for r in want} == {0, 1, 2}


def test_each_step_of_the_capacity_cascade_decides(spark):
    steps = {r[0]: r[1] for r in catalog.QUERIES["j17_capacity_cascade"](spark, SF).groupBy("capacity_from").count().collect()}
    assert set(steps) == {1, 2, 3, 4, 5, 6, 7, None} and min(steps.values()) > 1


def test_containment_must_be_unique(spark):
    dims = spark.createDataFrame([("a b c", 1), ("a d", 2), ("e f", 3), ("f e", 4), ("g", 5), ("", 6)], "n string, v int").select(F.array_remove(F.split("n", " "), "").alias("words"), "v")
    names = [["a", "b"], ["a"], ["a", "d", "x"], ["e"], ["g", "h"], ["zz"], [], ["a", "zz"]]
    got = {tuple(r.words): r.v for r in match.unique_containment(spark.createDataFrame([(n,) for n in names], "words array<string>"), dims, "words", "v").collect()}
    assert got == {("a", "b"): 1, ("a", "d", "x"): 2, ("g", "h"): 5}


def test_branches_have_rows(spark):
    assert {r[0] for r in catalog.QUERIES["f16_poll_label"](spark, SF).select("label").distinct().collect()} > {"CFP", "AP", "Coaches", "Unknown"}
    prices = [r.lowest_price for r in catalog.QUERIES["s15_offers_to_snapshots"](spark, SF).collect()]
    assert None in prices and any(p is not None and p % 1 for p in prices)
    assert catalog.QUERIES["d9_last_completed"](spark, SF).count() > 0
    assert {r[0] for r in catalog.QUERIES["j24_kickoff_text"](spark, SF).select(F.substring("kickoff", -2, 2)).distinct().collect()} == {"AM", "PM", "BD"}


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(6)
    cases = [rng.lognormal(3, 2, 5000), rng.integers(0, 3, 1000), [7.0], [1.0, 2.0], [5e-324, 0.0, 1e308, -1e308, 1e308], [float("inf"), 1.0, 2.0, float("-inf"), 3.0], [2.0] * 9]
    for values in cases:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        for share in (0.0, 0.25, 0.5, 0.995, 1.0):
            want = df.where("not isnan(v)").agg(F.percentile("v", share)).first()[0]
            got = quantile.quantile(df, F.col("v"), share)
            assert got == want or math.isnan(got) and math.isnan(want) or got == pytest.approx(want, rel=1e-12), (share, got, want)
    assert quantile.quantile(spark.createDataFrame([(None,)], "v double"), F.col("v"), 0.5) is None


def test_previous_values_need_no_window_over_all_rows_of_a_team(spark):
    rows = [(t, s, w, k, None if (k + w) % 3 == 0 else 10 * s + w) for t in "ab" for s in (1, 2, 3) for w in (1, 2, 3) for k in (1, 2)]
    df = spark.createDataFrame(rows, "team string, season int, week int, k int, v int")
    out = history.previous_completed(df, "v", ["team"], ["season", "week", "k"], ["season", "week"])
    last, want = {}, {}
    for t, s, w, k, v in rows:
        want[t, s, w, k] = last.get(t)
        last[t] = v if v is not None else last.get(t)
    assert {(r.team, r.season, r.week, r.k): r.prev_v for r in out.collect()} == want
    text_ = out._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", text_)
    assert any("week" in w for w in windows)


def test_closest_poll(spark):
    rows = [(1, "AP", 3, "2024-01-20"), (1, "CFP", 3, "2024-01-20"), (1, "AP", 4, "2024-03-01"), (2, "AP", 5, None), (2, "CFP", 5, None), (2, "CFP", 4, "2025-01-01"), (3, "AP", 9, None), (3, "CFP", 1, "2023-01-01")]
    df = spark.createDataFrame(rows, "g int, poll string, week int, date string").withColumn("date", F.to_date("date"))
    got = enrich.closest_poll(df, ["g"], "date", "week", F.lit("2024-02-01").cast("date"), ["CFP", "AP"])
    assert sorted((r.g, r.poll, r.week, str(r.date)) for r in got.collect()) == [(1, "CFP", 3, "2024-01-20"), (2, "CFP", 5, "None"), (3, "CFP", 1, "2023-01-01")]


def test_clean_names_keep_what_stands_outside_brackets(spark):
    given = ["Ohio  State [1] (12)", "Miami (FL) (5-1).", "A–B—C", None, "Texas A&M (co) [b]", "x (open"]
    df = spark.createDataFrame([(g,) for g in given], "n string").select(text.clean_school(F.col("n")))
    assert [r[0] for r in df.collect()] == ["Ohio State", "Miami", "A B C", "", "Texas A&M", "x open"]


# models


@pytest.fixture(scope="module")
def examples(spark):
    return misc_queries._train_rows(Views(spark, SF))


def test_whole_gap_model(spark, examples):
    made = examples.withColumn("lowest_price", F.when(F.col("snap_id") % 5 != 0, F.col("lowest_price"))).withColumn("nothing", F.lit(1.0))
    fitted, kept = model.fit_gap_model(made.where("not is_test"), ["lowest_price", "hours_left", "nothing"], ["event_type"], "gap_log", pinned=("hours_left",), cutoff=0.8, maxIter=3, maxDepth=3)
    assert "hours_left" in kept and "nothing" not in kept
    learner = fitted.stages[-1]
    assert learner.getWeightCol() == "weight" and learner.getValidationIndicatorCol() == "is_validation"
    test, flags = model.with_missing_flags(made.where("is_test"), ["lowest_price", "hours_left", "nothing"])
    assert flags[0] == "lowest_price_missing" and test.agg(F.sum("lowest_price_missing")).first()[0] == test.where("lowest_price is null").count() > 0
    scored = model.monotone_by_event(fitted.transform(test), "event_key", "hours_left", "prediction").select("event_key", "hours_left", "prediction").collect()
    by = {}
    for r in scored:
        by.setdefault(r.event_key, []).append((r.hours_left, r.prediction))
    assert all(a[1] <= b[1] for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:]))


def test_importance_and_dependence_follow_the_data(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(a), float(b), 2.0 * float(a)) for k, (a, b) in enumerate(rng.random((400, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    fitted = model.gap_model(["a", "b"], [], "y").fit(df)
    found = {r.feature: r.importance for r in model.permutation_importance(fitted, df, ["a", "b"], "y", "k").collect()}
    assert found["a"] > 0.3 > 0.05 > abs(found["b"])
    curve = {r.a: r.mean_prediction for r in model.partial_dependence(fitted, df, "a", [0.1, 0.5, 0.9]).collect()}
    assert all(abs(curve[a] - 2 * a) < 0.3 for a in curve) and curve[0.1] < curve[0.5] < curve[0.9]
    runs = model.sweep(df.where("k < 300"), df.where("k >= 300"), {f"d{d}": model.gap_model(["a"], [], "y", maxDepth=d) for d in (1, 4)}, "y").collect()
    assert [r.run for r in runs] == ["d4", "d1"] and runs[0].mae < runs[1].mae
    report = model.training_report(fitted.transform(df), "y", "prediction").first()
    errors = [abs(r.y - r.prediction) for r in fitted.transform(df).collect()]
    assert report.n == 400 and report.mae == pytest.approx(sum(errors) / 400) and report.rmse == pytest.approx(math.sqrt(sum(e * e for e in errors) / 400))
