"""Queries of price histories and of de-duplication."""

from pyspark.sql import functions as F

from tidemark.functions.times import hours_between, micros
from tidemark.operators import dedupe as d, enrich as e, evaluate as ev, filters as p, history as h, targets as t
from tidemark.plans.registry import query
from tidemark.plans.views import ASOF, Views
from tidemark.sources.tables import stored

HOURS = "(epoch_us({a}) - epoch_us({b})) / 3600000000.0"


def _h(a: str, b: str) -> str:
    return HOURS.replace("{a}", a).replace("{b}", b)


@query("w1_suffix_min", """
select snap_id, min(lowest_price) over (partition by event_key order by snapshot_ts, snap_id rows between current row and unbounded following) as future_min
from {snapshots}""")
def w1(v: Views):
    return h.future_min(v.snapshots).select("snap_id", "future_min")


_W2 = f"""
with a as (select *, min(case when lowest_price is not null then struct_pack(p := lowest_price, t := snapshot_ts) end)
             over (partition by event_key order by snapshot_ts, snap_id rows between current row and unbounded following) as best from {{snapshots}})
select snap_id, event_key, lowest_price, best.p as future_min, epoch_us(best.t) as min_us, round({_h("best.t", "snapshot_ts")}, 6) as hours_to_min,
       round(lowest_price - best.p, 6) as saving from a"""


@query("w2_time_to_future_min", _W2)
def w2(v: Views):
    out = h.future_min(v.snapshots)
    return out.select("snap_id", "event_key", "lowest_price", "future_min", micros(F.col("min_ts")).alias("min_us"), F.round("hours_to_min", 6).alias("hours_to_min"), F.round(F.col("lowest_price") - F.col("future_min"), 6).alias("saving"))


_TARGET = f"""
with a as (select *, min(case when lowest_price is not null then struct_pack(p := lowest_price, t := snapshot_ts) end)
             over (partition by event_key order by snapshot_ts, snap_id rows between current row and unbounded following) as best,
           min(case when lowest_price is not null then struct_pack(p := lowest_price, t := snapshot_ts) end) over (partition by event_key) as ev,
           coalesce(min(start_ts) over (partition by event_key) < timestamp '{ASOF}', false) as complete from {{snapshots}}),
b as (select *, case when complete and ev.p is not null then ev.p else best.p end as future_min,
             case when complete and ev.p is not null then greatest({_h("ev.t", "snapshot_ts")}, 0) else {_h("best.t", "snapshot_ts")} end as hours_to_min from a),
c as (select *, case when lowest_price is not null and future_min is not null and lowest_price <> 0 then least(greatest(greatest(lowest_price - future_min, 0) / lowest_price, 0), 1) end as gap_pct,
             coalesce(snapshot_ts > ev.t, false) as past_min from b)
"""


@query("w3_completion_override", _TARGET + "select snap_id, complete, future_min, round(hours_to_min, 6) as hours_to_min from c")
def w3(v: Views):
    return t.gap_targets(v.snapshots, ASOF).select("snap_id", "complete", "future_min", F.round("hours_to_min", 6).alias("hours_to_min"))


@query("w4_gap_target", _TARGET + ", q as (select quantile_cont(gap_pct, 0.995) as q from c) select snap_id, case when gap_pct is not null then round(least(gap_pct, q), 8) end as gap_pct, case when gap_pct is not null then round(ln(1 + least(gap_pct, q)), 8) end as gap_pct_log from c, q")
def w4(v: Views):
    out = t.clip_at_quantile(t.gap_targets(v.snapshots, ASOF), "gap_pct")
    return out.select("snap_id", F.round("gap_pct", 8).alias("gap_pct"), F.round(F.log1p("gap_pct"), 8).alias("gap_pct_log"))


@query("a17_quantile_clip", "with q as (select quantile_cont(lowest_price, 0.995) as q from {snapshots}) select snap_id, round(least(lowest_price, q), 6) as lowest_price from {snapshots}, q where lowest_price is not null union all select snap_id, null from {snapshots} where lowest_price is null")
def a17(v: Views):
    return t.clip_at_quantile(v.snapshots.select("snap_id", "lowest_price"), "lowest_price").withColumn("lowest_price", F.round("lowest_price", 6))


@query("p14_already_past", _TARGET + "select snap_id, past_min from c")
def p14(v: Views):
    return t.gap_targets(v.snapshots, ASOF).select("snap_id", p.already_past(F.col("snapshot_ts"), F.col("event_min_ts")).alias("past_min"))


_HIST = f"""
with a as (select *, lag(lowest_price) over w as prev_price, avg(lowest_price) over l3 as m, stddev_samp(lowest_price) over l3 as s, count(lowest_price) over l3 as n,
       row_number() over w as snapshot_number, {_h("snapshot_ts", "lag(snapshot_ts) over w")} as hs from {{snapshots}}
  window w as (partition by event_key order by snapshot_ts, snap_id), l3 as (partition by event_key order by snapshot_ts, snap_id rows between 2 preceding and current row))
"""


@query("w5_lag_delta_pct", _HIST + "select snap_id, prev_price, round(lowest_price - prev_price, 6) as delta, round(case when prev_price <> 0 then (lowest_price - prev_price) / prev_price end, 6) as pct_change from a")
def w5(v: Views):
    return h.history_features(v.snapshots).select("snap_id", "prev_price", F.round("delta", 6).alias("delta"), F.round("pct_change", 6).alias("pct_change"))


@query("w6_rolling_three", _HIST + "select snap_id, round(m, 6) as mean3, round(case when n >= 2 then s end, 5) as std3 from a")
def w6(v: Views):
    return h.history_features(v.snapshots).select("snap_id", F.round("mean3", 6).alias("mean3"), F.round("std3", 5).alias("std3"))


@query("w7_snapshot_number", _HIST + "select snap_id, cast(snapshot_number as int) as snapshot_number, round(hs, 6) as hours_since_prev from a")
def w7(v: Views):
    return h.history_features(v.snapshots).select("snap_id", F.col("snapshot_number").cast("int"), F.round("hours_since_prev", 6).alias("hours_since_prev"))


@query("a1_observed_min", "select event_key, round(min(lowest_price), 2) as observed_min, epoch_us(min(case when lowest_price is not null then struct_pack(p := lowest_price, t := snapshot_ts) end).t) as observed_us from {snapshots} where snapshot_ts <= timestamp '2024-01-20 00:00:00' group by event_key")
def a1(v: Views):
    return h.observed_min(v.snapshots, "2024-01-20 00:00:00").select("event_key", "observed_min", micros(F.col("observed_ts")).alias("observed_us"))


@query("a2_event_min_complete", f"with a as (select event_key, min(case when lowest_price is not null then struct_pack(p := lowest_price, t := snapshot_ts) end) as b, min(start_ts) as s from {{snapshots}} group by event_key) select event_key, b.p as event_min, epoch_us(b.t) as event_min_us, coalesce(s < timestamp '{ASOF}', false) as complete from a")
def a2(v: Views):
    return h.event_min(v.snapshots, ASOF).select("event_key", "event_min", micros(F.col("event_min_ts")).alias("event_min_us"), "complete")


_A3 = f"""
with r as (select s.event_key, lowest_price as p, abs({_h("snapshot_ts", "predicted_ts")}) as dist, snapshot_ts as ts
           from {{snapshots}} s left join {{predictions}} q on q.event_key = s.event_key where snapshot_ts < start_ts and lowest_price is not null),
k as (select *, row_number() over (partition by event_key order by p, coalesce(dist, 'inf'::double), ts) as n from r)
"""


@query("a3_min_near_prediction", _A3 + "select event_key, p as actual_price, epoch_us(ts) as actual_us from k where n = 1")
def a3(v: Views):
    return h.min_near_prediction(v.snapshots, v.predictions).select("event_key", "actual_price", micros(F.col("actual_ts")).alias("actual_us"))


@query("a4_daily_mean", "select event_key, strftime(cast(snapshot_ts as date), '%Y-%m-%d') as day, round(avg(lowest_price), 6) as mean_price from {snapshots} group by all")
def a4(v: Views):
    return h.daily_mean(v.snapshots).select("event_key", F.col("day").cast("string"), F.round("mean_price", 6).alias("mean_price"))


_A5 = """
with f as (select distinct user_id as event_key from {events} where event_type = 'purchase'),
r as (select s.* from {snapshots} s join f on f.event_key = s.event_key),
n as (select *, row_number() over (partition by event_key order by snapshot_ts desc, snap_id desc) as k from r),
m as (select event_key, min(case when lowest_price is not null then struct_pack(p := lowest_price, t := snapshot_ts) end) as low from r group by event_key)
"""


@query("a5_favourites", _A5 + "select n.event_key, n.lowest_price as current_price, low.p as lowest_observed, epoch_us(low.t) as lowest_us, predicted_price from n join m on m.event_key = n.event_key left join {predictions} q on q.event_key = n.event_key where k = 1")
def a5(v: Views):
    chosen = v.events.where("event_type = 'purchase'").select(F.col("user_id").alias("event_key"))
    return h.favourites(v.snapshots, chosen, v.predictions).select("event_key", "current_price", "lowest_observed", micros(F.col("lowest_ts")).alias("lowest_us"), "predicted_price")


@query("p16_price_hints", _A5 + "select n.event_key, coalesce(n.lowest_price <= predicted_price, false) as buy_now, coalesce(low.p < predicted_price, false) as cheaper_seen from n join m on m.event_key = n.event_key left join {predictions} q on q.event_key = n.event_key where k = 1")
def p16(v: Views):
    chosen = v.events.where("event_type = 'purchase'").select(F.col("user_id").alias("event_key"))
    return h.favourites(v.snapshots, chosen, v.predictions).select("event_key", "buy_now", "cheaper_seen")


@query("w15_latest_snapshot", "select event_key, snap_id, lowest_price from (select *, row_number() over (partition by event_key order by snapshot_ts desc, snap_id desc) as k from {snapshots}) where k = 1")
def w15(v: Views):
    return h.latest(v.snapshots).select("event_key", "snap_id", "lowest_price")


_TG = """
tg as (select game_id, season, week, start_ts, 'H' as side, home_team as team, away_team as opponent, home_points as points_for, away_points as points_against, home_points - away_points as point_diff from {games}
       union all select game_id, season, week, start_ts, 'A', away_team, home_team, away_points, home_points, away_points - home_points from {games})
"""


def _tg(v: Views):
    return e.team_games(v.games, ["game_id", "season", "week", "start_ts"])


_PREV = "last_value(point_diff ignore nulls) over (partition by team order by start_ts, game_id rows between unbounded preceding and 1 preceding) as prev_point_diff"


def _previous(v: Views):
    """W8 over stored games, which are dealt out by week as one row each."""
    games = v.kept_games("game_id", "season", "week", "start_ts", "home_team", "away_team", "home_points", "away_points")
    sides = lambda g: e.team_games(g, ["game_id", "season", "week", "start_ts"])
    return h.previous_completed(sides(games), "point_diff", ["team"], ["start_ts", "game_id"], ["season", "week"], dealt=sides(games.repartition("season", "week")))


@query("w8_previous_completed", f"with {_TG} select game_id, team, {_PREV} from tg")
def w8(v: Views):
    return _previous(v).select("game_id", "team", "prev_point_diff")


@query("j11_previous_diff_both_sides", f"with {_TG}, p as (select *, {_PREV} from tg) select game_id, max(case when side = 'H' then prev_point_diff end) as home_last_point_diff, max(case when side = 'A' then prev_point_diff end) as away_last_point_diff from p group by game_id")
def j11(v: Views):
    return e.per_side(_previous(v), "game_id", "prev_point_diff", "last_point_diff", along=["season", "week"])


_REC = f"""
{_TG}, each as (select season, team, week, sum(case when point_diff > 0 then 1.0 when point_diff = 0 then 0.5 else 0.0 end)::double as w,
                sum(case when point_diff < 0 then 1.0 when point_diff = 0 then 0.5 else 0.0 end)::double as l from tg where point_diff is not null group by all),
every as (select * from (select distinct season, team from tg) join (select distinct season, week from tg) using (season)),
rec as (select season, team, week, coalesce(sum(w) over b, 0.0) as wins, coalesce(sum(l) over b, 0.0) as losses from every left join each using (season, team, week)
        window b as (partition by season, team order by week rows between unbounded preceding and 1 preceding))
"""


@query("w9_record_before_week", f"with {_REC} select * from rec")
def w9(v: Views):
    return h.record_before_week(_tg(v))


@query("a12_win_loss_totals", f"with {_REC} select season, team, sum(w) as wins, sum(l) as losses from each group by all")
def a12(v: Views):
    diff = F.col("point_diff")
    half = F.when(diff == 0, 0.5).otherwise(0.0)
    return _tg(v).where(diff.isNotNull()).groupBy("season", "team").agg(F.sum(F.when(diff > 0, 1.0).otherwise(half)).alias("wins"), F.sum(F.when(diff < 0, 1.0).otherwise(half)).alias("losses"))


@query("j20_records_on_games", f"with {_REC} select g.game_id, a.wins as home_wins, a.losses as home_losses, b.wins as away_wins, b.losses as away_losses from {{games}} g left join rec a on a.season = g.season and a.week = g.week and a.team = home_team left join rec b on b.season = g.season and b.week = g.week and b.team = away_team")
def j20(v: Views):
    games = v.kept_games("game_id", "season", "week", "home_team", "away_team", "home_points", "away_points")
    records = stored(h.record_before_week(e.team_games(games, ["season", "week"])), "records")
    return e.with_records(games, records).select("game_id", "home_wins", "home_losses", "away_wins", "away_losses")


@query("w13_worst_first", "select game_id, round(abs(home_points - away_points), 6) as miss from {games} order by miss desc nulls last, game_id limit 50")
def w13(v: Views):
    return h.worst_first(v.games.select("game_id", F.round(F.abs(F.col("home_points") - F.col("away_points")), 6).alias("miss")), "miss", "game_id", 50)


@query("w14_upcoming_else_first", "with k as (select *, row_number() over (partition by home_team, away_team order by start_ts < timestamp '1998-06-01 00:00:00', start_ts, game_id) as n from {games}) select home_team, away_team, game_id from k where n = 1")
def w14(v: Views):
    games = v.games.select("home_team", "away_team", "start_ts", "game_id")
    return h.upcoming_else_first(games, ["home_team", "away_team"], "start_ts", "game_id", "1998-06-01 00:00:00").select("home_team", "away_team", "game_id")


@query("d1_best_offer", "with k as (select *, row_number() over (partition by event_key order by lowest_price is null, lowest_price, snap_id) as n from {snapshots}) select event_key, snap_id, lowest_price from k where n = 1")
def d1(v: Views):
    return d.best_offer(v.snapshots.withColumn("url", F.lit(None).cast("string")), "event_key", "url", "lowest_price", "snap_id").select("event_key", "snap_id", "lowest_price")


@query("d2_keep_last", "with k as (select *, row_number() over (partition by event_key, event_type order by snapshot_ts desc, snap_id desc) as n from {snapshots}) select event_key, event_type, snap_id from k where n = 1")
def d2(v: Views):
    return d.keep_last(v.snapshots, ["event_key", "event_type"], ["snapshot_ts", "snap_id"]).select("event_key", "event_type", "snap_id")


@query("d3_merge_latest", "with k as (select *, row_number() over (partition by event_key order by snapshot_ts desc, snap_id desc) as n from {snapshots}) select event_key, snap_id, lowest_price from k where n = 1")
def d3(v: Views):
    s = v.snapshots
    return d.merge_latest(s.where("snap_id % 2 = 0"), s, ["event_key"], "snapshot_ts", ["snap_id"]).select("event_key", "snap_id", "lowest_price")


@query("d4_key_cascade", "select game_id, home_team, start_us from (select game_id, home_team, epoch_us(start_ts) as start_us, row_number() over (partition by season, week, home_team order by start_ts, game_id) as n from {games}) where n = 1")
def d4(v: Views):
    out = d.distinct_by_cascade(v.games, [["id"], ["gameId"], ["season", "week", "home_team"]], ["start_ts", "game_id"])
    return out.select("game_id", "home_team", micros(F.col("start_ts")).alias("start_us"))


@query("d5_earliest_start", "select event_key, snap_id from (select *, row_number() over (partition by event_key order by start_ts, snap_id) as n from {snapshots}) where n = 1")
def d5(v: Views):
    return d.earliest_start(v.snapshots, "event_key", "start_ts", "snap_id").select("event_key", "snap_id")


@query("d6_first_of_sorted", "select venue_id, venue, school, capacity from (select *, row_number() over (partition by school order by venue_id, venue, capacity) as n from {venues}) where n = 1")
def d6(v: Views):
    return d.first_of_sorted(v.venues, "school")


@query("d7_undirected_pairs", "with p as (select distinct least(home_team, away_team) as home_team, greatest(home_team, away_team) as away_team from {games}), b as (select home_team as node, away_team as other from p union select away_team, home_team from p) select node, string_agg(other, ',' order by other) as others from b group by node")
def d7(v: Views):
    pairs = d.undirected_pairs(v.games, "home_team", "away_team")
    return d.adjacency(pairs, "home_team", "away_team").select("node", F.array_join("others", ",").alias("others"))


@query("d8_opponents_in_order", "with f as (select home_team, away_team, min(start_ts) as s from {games} group by all) select home_team, string_agg(away_team, ',' order by s, away_team) as opponents from f group by home_team")
def d8(v: Views):
    return d.opponents_in_order(v.games, "home_team", "away_team", "start_ts").select("home_team", F.array_join("opponents", ",").alias("opponents"))


@query("d9_last_completed", f"with {_TG} select team, game_id, point_diff from (select *, row_number() over (partition by team order by start_ts desc, game_id desc) as n from tg where point_diff is not null and start_ts <= timestamp '1996-06-01 00:00:00') where n = 1")
def d9(v: Views):
    return d.last_completed(_tg(v), "team", "start_ts", "game_id", "point_diff", "1996-06-01 00:00:00").select("team", "game_id", "point_diff")


@query("w11_group_time_split", "with e as (select event_key, min(start_ts) as s from {snapshots} group by event_key), n as (select greatest(1, cast(floor(count(*) * 0.2) as bigint)) as n from e where s is not null), k as (select event_key, row_number() over (order by s desc, event_key desc) as r from e where s is not null) select snap_id, r <= n as is_test from {snapshots} s join k on k.event_key = s.event_key, n")
def w11(v: Views):
    return t.group_time_split(v.snapshots, 0.2).select("snap_id", "is_test")


@query("w10_prune_importance", """
with f as (select event_type as feature, sum(value) as importance from {events} group by event_type),
w as (select *, coalesce(sum(importance) over (order by importance desc, feature rows between unbounded preceding and 1 preceding), 0) / sum(importance) over () as before from f)
select feature, round(before, 9) <= 0.5 or feature in ('error') as kept from w""")
def w10(v: Views):
    features = v.events.groupBy(F.col("event_type").alias("feature")).agg(F.sum("value").alias("importance"))
    return t.prune_by_importance(features, 0.5, ["error"]).select("feature", "kept")


@query("a13_event_weights", "with m as (select median(lowest_price) as m from {snapshots}) select snap_id, round(1.0 / count(*) over (partition by event_key) * pow(1.0 / greatest(coalesce(lowest_price, m), 10.0), 1.5), 9) as weight from {snapshots}, m")
def a13(v: Views):
    return t.event_weights(v.snapshots).select("snap_id", F.round("weight", 9).alias("weight"))


_EVAL = _A3 + f""", j as (select q.event_key, predicted_price, predicted_ts, p as actual_price, ts as actual_ts, abs(predicted_price - p) as abs_error,
  case when p > 0 then abs(predicted_price - p) / p * 100 end as percent_error, {_h("predicted_ts", "ts")} as signed from {{predictions}} q join k on k.event_key = q.event_key and n = 1)
"""


def evaluated(v: Views):
    actual = h.min_near_prediction(v.snapshots, v.predictions)
    return ev.errors(v.predictions.join(actual, "event_key"), "predicted_price", "actual_price", "predicted_ts", "actual_ts")


@query("f22_prediction_errors", _EVAL + "select event_key, round(abs_error, 6) as abs_error, round(percent_error, 4) as percent_error, round(signed, 6) as timing_signed_hours, round(abs(signed), 6) as timing_abs_hours from j")
def f22(v: Views):
    return evaluated(v).select("event_key", F.round("abs_error", 6).alias("abs_error"), F.round("percent_error", 4).alias("percent_error"), F.round("timing_signed_hours", 6).alias("timing_signed_hours"), F.round("timing_abs_hours", 6).alias("timing_abs_hours"))


@query("j21_prediction_actual", _EVAL + "select event_key, predicted_price, actual_price, epoch_us(predicted_ts) as predicted_us, epoch_us(actual_ts) as actual_us from j")
def j21(v: Views):
    return evaluated(v).select("event_key", "predicted_price", "actual_price", micros(F.col("predicted_ts")).alias("predicted_us"), micros(F.col("actual_ts")).alias("actual_us"))


@query("a6_regression_metrics", _EVAL + "select count(*) as n, round(avg(abs_error), 6) as mae, round(sqrt(avg(abs_error * abs_error)), 6) as rmse, round(avg(case when abs_error <= 40 then 1.0 else 0 end), 6) as within_abs, round(avg(case when abs_error / greatest(abs(actual_price), 1e-6) <= 2 then 1.0 else 0 end), 6) as within_rel from j where abs_error is not null")
def a6(v: Views):
    out = ev.regression_metrics(evaluated(v), "actual_price", "predicted_price", 40.0, 2.0)
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "within_abs", "within_rel")))


@query("a7_mae_by_bucket", "with g as (select case when home_points >= 200 then 4 when home_points >= 100 then 3 when home_points >= 50 then 2 when home_points >= 20 then 1 when home_points >= 0 then 0 end as bucket, abs(home_points - away_points) as err from {games}) select cast(b as int) as bucket, round(avg(err), 6) as mae from range(5) r(b) left join g on g.bucket = b group by b")
def a7(v: Views):
    return ev.mae_by_bucket(v.games, "home_points", "away_points").withColumn("mae", F.round("mae", 6))


@query("a8_timing_metrics", _EVAL + "select count(*) as n, round(avg(abs(signed)), 6) as mean_abs_hours, round(median(abs(signed)), 6) as median_abs_hours, count_if(abs(signed) <= 6)::bigint as within_6h, count_if(abs(signed) <= 12)::bigint as within_12h, count_if(abs(signed) <= 24)::bigint as within_24h, round(avg(signed), 6) as bias_hours, round(avg(case when signed > 0 then 1.0 else 0 end), 6) as late_share from j where signed is not null")
def a8(v: Views):
    out = ev.timing_metrics(evaluated(v))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_abs_hours", "median_abs_hours", "bias_hours", "late_share")})


@query("a18_recent_evaluation", _EVAL + ", late as (select * from j where actual_ts >= timestamp '2024-02-01 00:00:00' - interval 21 day and actual_ts <= timestamp '2024-02-01 00:00:00' and percent_error is not null) select count(*) as n, count_if(percent_error > 5)::bigint as n_over, round(count_if(percent_error > 5) / count(*), 6) as share_over, coalesce(count_if(percent_error > 5) / count(*) > 0.4, false) as many_missed, coalesce(count_if(percent_error > 5) / count(*) > 0.5, false) as retrain from late")
def a18(v: Views):
    return ev.retrain_flags(ev.recent(evaluated(v), "actual_ts", ASOF, 21)).withColumn("share_over", F.round("share_over", 6))


@query("j22_not_logged", "select event_key, predicted_price from {predictions} where event_key not in (select event_key from {predictions} where predicted_price > 50)")
def j22(v: Views):
    return ev.not_logged(v.predictions, v.predictions.where("predicted_price > 50"), "event_key").select("event_key", "predicted_price")


@query("s21_append_unlogged", "select event_key, predicted_price, predicted_price > 50 as logged_before from {predictions}")
def s21(v: Views):
    log = v.predictions.where("predicted_price > 50")
    new = ev.not_logged(v.predictions, log, "event_key").withColumn("logged_before", F.lit(False))
    return log.withColumn("logged_before", F.lit(True)).unionByName(new).select("event_key", "predicted_price", "logged_before")


@query("w12_grid_argmin", """
with g as (select event_key, start_ts, unnest(range(0, 73)) as k from (select event_key, min(start_ts) as start_ts from {snapshots} group by event_key)),
s as (select *, greatest(round(abs(((event_key * 7 + k * k * 3) % 101) - 40) * 1.0, 6), 0) as predicted from g)
select event_key, min(struct_pack(p := predicted, h := 72 - k)).p as best_price, cast(min(struct_pack(p := predicted, h := 72 - k)).h as bigint) as hours_before from s group by event_key""")
def w12(v: Views):
    from tidemark.operators.model import grid_argmin

    events = v.snapshots.groupBy("event_key").agg(F.min("start_ts").alias("start_ts"))
    k = 72 - F.col("hours_before")
    formula = F.round(F.abs((F.col("event_key") * 7 + k * k * 3) % 101 - 40) * 1.0, 6)
    return grid_argmin(events, "event_key", "start_ts", 3, lambda df: df.withColumn("predicted", formula)).select("event_key", "best_price", "hours_before")
