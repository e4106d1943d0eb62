"""Queries that once worked on a part of their tables or with small models."""

import pytest

from tidemark.operators import match
from tidemark.plans import catalog, misc_queries

SF = "/root/testdata/sf0.001"


def test_fallback_match_takes_observations_of_all_games(spark):
    from tidemark.plans.views import Views

    games = {f"s{r.game_id}" for r in Views(spark, SF).games.select("game_id").collect()}
    found = [r.snap for r in catalog.QUERIES["j7_fallback_match"](spark, SF).select("snap").collect()]
    assert len(found) == len(set(found)) > 0.9 * len(games) and set(found) <= games


@pytest.mark.parametrize("name", ["m1_gap_model", "m2_price_model", "m3_score_table", "m4_training_report", "m5_sweep", "a23_permutation_importance", "a24_partial_dependence"])
def test_models_have_their_default_size(spark, monkeypatch, name):
    class Made(Exception):
        pass

    def kept(make):
        def made(*args, **settings):
            raise Made(make(*args, **settings).getStages()[-1])

        return made

    for f in ("gap_model", "price_model"):
        monkeypatch.setattr(misc_queries.mo, f, kept(getattr(misc_queries.mo, f)))
    with pytest.raises(Made) as e:
        catalog.QUERIES[name](spark, SF)
    learner = e.value.args[0]
    if name == "m2_price_model":
        assert (learner.getNumTrees(), learner.getMaxDepth()) == (300, 5)
    else:
        assert learner.getMaxIter() == 10 and (name == "m5_sweep" or learner.getMaxDepth() == 4)


def test_backfill_cascade_has_a_fuzzy_pass(spark):
    def rows(key, *of):
        return spark.createDataFrame([(k, h, a, d, f"{d} 12:00:00", h.split(), a.split()) for k, h, a, d in of], f"{key} string, home_team string, away_team string, day string, start_ts string, home_tokens array<string>, away_tokens array<string>")

    games = rows("game_id", ("g1", "alpha tech", "beta", "2024-09-01"), ("g2", "gamma", "delta", "2024-09-01"), ("g3", "alpha", "beta", "2024-10-01"), ("g4", "gamma", "delta", "2024-09-20"))
    probes = rows("snap", ("same", "beta", "alpha tech", "2024-09-01"), ("spelt", "alpha", "beta", "2024-09-01"), ("moved", "delta", "gamma", "2024-09-18"), ("none", "x", "y", "2024-09-01"))
    got = {r.snap: (r.game_id, r.how) for r in match.backfill_cascade(probes, games, "snap", fuzzy=("start_ts", "start_ts")).collect()}
    assert got == {"same": ("g1", "same day"), "spelt": ("g1", "fuzzy"), "moved": ("g4", "nearest day")}
