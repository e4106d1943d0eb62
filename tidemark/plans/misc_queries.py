"""Queries of text and time functions, sources and pages, quality, model tables and streams."""

from pyspark.sql import functions as F

from tidemark.functions import text as x, times as tm
from tidemark.functions.times import micros
from tidemark.operators import enrich as e, evaluate as ev, filters as p, model as mo, quality as q
from tidemark.plans.registry import query
from tidemark.plans.views import ASOF, Views
from tidemark.sources import extract as ex, tables as io
from tidemark.streaming import ingest as st

# text


@query("f3_matchup", "select p_partkey, p_brand as home, p_type as away from {part}")
def f3(v: Views):
    title = F.concat(F.lit("Week 1: "), "p_brand", F.lit(" VS. "), "p_type")
    clean = x.clean_title(title)
    return v.part.select("p_partkey", x.matchup(clean, 1).alias("home"), x.matchup(clean, 2).alias("away"))


@query("f3b_fill_from_title", "select p_partkey, case when p_partkey % 3 = 0 then p_name else p_brand end as home from {part}")
def f3b(v: Views):
    title = F.concat("p_brand", F.lit(" Football vs "), "p_type")
    known = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise("  ")
    return v.part.select("p_partkey", x.strip_suffix(F.coalesce(x.filled(known), x.matchup(title, 1))).alias("home"))


@query("f4_strip_suffix", "select p_partkey, p_name || ' ' || p_type as name from {part}")
def f4(v: Views):
    return v.part.select("p_partkey", x.strip_suffix(F.concat("p_name", F.lit("  "), "p_type", F.lit("  FOOTBALL "))).alias("name"))


@query("f5_url_parts", "select page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) as slug, nullif(regexp_extract(url, '/([0-9]+)(?:[/?#.].*)?$', 1), '') as number from {pages}")
def f5(v: Views):
    return v.pages.select("page_id", x.url_slug(F.col("url")).alias("slug"), x.url_number(F.col("url")).alias("number"))


@query("f5_url_time", "select p_partkey, '2025-' || lpad(cast(p_partkey % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast(p_size % 28 + 1 as varchar), 2, '0') as day, lpad(cast(case when p_partkey % 2 = 0 then (p_partkey % 12 + 1) % 12 + 12 else (p_partkey % 12 + 1) % 12 end as varchar), 2, '0') || ':00' as hour from {part}")
def f5t(v: Views):
    n = (F.col("p_partkey") % 12 + 1).cast("string")
    url = F.concat(F.lit("https://x.example/a-vs-b-"), n, F.lit("-"), (F.col("p_size") % 28 + 1).cast("string"), F.lit("-25-"), n, F.when(F.col("p_partkey") % 2 == 0, "pm").otherwise("am"), F.lit("/123"))
    return v.part.select("p_partkey", x.url_date(url).alias("day"), x.url_time(url).alias("hour"))


@query("f6_synthetic_id", "select snap_id, coalesce(cast(event_key as varchar), '') || '|' || event_type as sid from {snapshots}")
def f6(v: Views):
    return v.snapshots.select("snap_id", x.synthetic_id(F.col("event_key"), F.col("event_type")).alias("sid"))


#: Names of polls as sources spell them.
_POLLS = "case p_partkey % 7 when 0 then concat('Playoff committee ', p_type) when 1 then concat(p_type, ' CFP') when 2 then 'AP Top 25' when 3 then concat('USA coaches ', p_size) when 4 then '' when 5 then null else concat(' ', p_type, ' ') end"


@query("f16_poll_label", f"select p_partkey, case when coalesce(n, '') = '' then 'Unknown' when lower(n) like '%playoff%' or lower(n) like '%cfp%' then 'CFP' when lower(n) like '%ap%' then 'AP' when lower(n) like '%coaches%' then 'Coaches' else trim(n) end as label from (select p_partkey, {_POLLS} as n from {{part}})")
def f16(v: Views):
    return v.part.select("p_partkey", x.poll_label(F.expr(_POLLS)).alias("label"))


@query("f18_clean_school", "select p_partkey, p_name as school from {part}")
def f18(v: Views):
    return v.part.select("p_partkey", x.clean_school(F.concat("p_name", F.lit("[a] (12) (5-1) (co)."))).alias("school"))


@query("f20_normalize_id", "select event_id, cast(event_id as varchar) as id from {events}")
def f20(v: Views):
    return v.events.select("event_id", x.normalize_id(F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise(" "))).alias("id"))


@query("f21_formats", """
select p_partkey, format('${:,.2f}', p_retailprice) as money,
  trim(case when s >= 86400 then (s // 86400) || 'd ' else '' end || case when s >= 3600 then (s // 3600 % 24) || 'h ' else '' end || case when s >= 60 then (s // 60 % 60) || 'm ' else '' end || (s % 60) || 's') as delta
from (select *, p_partkey * 977 % 400000 as s from {part})""")
def f21(v: Views):
    return v.part.select("p_partkey", x.money(F.col("p_retailprice")).alias("money"), x.human_delta(F.col("p_partkey") * 977 % 400000).alias("delta"))


# times


@query("f7_parse_date", "select snap_id, strftime(cast(snapshot_ts as date), '%Y-%m-%d') as day from {snapshots}")
def f7(v: Views):
    odd = F.col("snap_id") % 3
    shown = F.when(odd == 0, F.date_format("snapshot_ts", "M/d/yyyy")).when(odd == 1, F.date_format("snapshot_ts", "yyyy-MM-dd")).otherwise(F.date_format("snapshot_ts", "MMM d, yyyy"))
    return v.snapshots.select("snap_id", tm.parse_date(shown).cast("string").alias("day"))


@query("f8_display_time", "select snap_id, ltrim(strftime(snapshot_ts, '%I:%M %p'), '0') as shown from {snapshots}")
def f8(v: Views):
    odd = F.col("snap_id") % 3
    raw = F.when(odd == 0, F.date_format("snapshot_ts", "H:mm")).when(odd == 1, F.date_format("snapshot_ts", "h:mma")).otherwise(F.date_format("snapshot_ts", "HH:mm:ss"))
    return v.snapshots.select("snap_id", tm.display_time(raw).alias("shown"))


@query("f9_snapshot_time", "select snap_id, epoch_us(case snap_id % 3 when 0 then snapshot_ts when 1 then date_trunc('minute', snapshot_ts) else date_trunc('day', snapshot_ts) end) as us from {snapshots}")
def f9(v: Views):
    odd = F.col("snap_id") % 3
    stamp = F.when(odd == 0, F.col("snapshot_ts"))
    return v.snapshots.select("snap_id", micros(tm.snapshot_time(stamp, F.date_format("snapshot_ts", "M/d/yyyy"), F.when(odd == 1, F.date_format("snapshot_ts", "H:mm")).otherwise("TBD"))).alias("us"))


@query("f10_kickoff", "select snap_id, epoch_us(start_ts) as us from {snapshots}")
def f10(v: Views):
    return v.snapshots.select("snap_id", micros(tm.kickoff(F.date_format("start_ts", "yyyy-MM-dd"), F.date_format("start_ts", "h:mm a"))).alias("us"))


@query("f11_placeholder", "select snap_id, snap_id % 4 < 3 as placeholder from {snapshots}")
def f11(v: Views):
    odd = F.col("snap_id") % 4
    raw = F.when(odd == 0, "TBD").when(odd == 1, "12:00 AM").when(odd == 2, "3:00").otherwise("3:30 PM")
    return v.snapshots.select("snap_id", tm.placeholder_time(raw).alias("placeholder"))


#: The year's days on which clocks change at 2 in the morning: the second Sunday of March and the first of November.
_EAST = "e as (select snap_id, t, t - case when t >= timestamp '2024-03-10 07:00:00' and t < timestamp '2024-11-03 06:00:00' then interval 4 hour else interval 5 hour end as e from (select snap_id, snapshot_ts + to_days(cast(snap_id % 330 as integer)) as t from {snapshots}))"


@query("f12_eastern", f"with {_EAST} select snap_id, epoch_us(e) as us, strftime(e, '%Y-%m-%d') as day, strftime(e, '%A') as name from e where t < timestamp '2025-01-01 00:00:00'")
def f12(v: Views):
    rows = v.snapshots.withColumn("t", F.col("snapshot_ts") + F.make_interval(days=(F.col("snap_id") % 330).cast("int"))).where("t < timestamp '2025-01-01 00:00:00'")
    e = tm.eastern(F.col("t"))
    return rows.select("snap_id", micros(e).alias("us"), F.date_format(e, "yyyy-MM-dd").alias("day"), F.date_format(e, "EEEE").alias("name"))


@query("f13_horizon", "select snap_id, round((epoch_us(start_ts) - epoch_us(snapshot_ts)) / 3.6e9, 6) as hours, cast(datediff('day', cast(snapshot_ts as date), cast(start_ts as date)) as int) as days, cast(hour(start_ts) as int) as kickoff_hour, cast(isodow(start_ts) - 1 as int) as weekday, round(hour(snapshot_ts) + minute(snapshot_ts) / 60.0, 6) as collected_hour from {snapshots}")
def f13(v: Views):
    s, t = F.col("snapshot_ts"), F.col("start_ts")
    return v.snapshots.select("snap_id", F.round(tm.hours_between(t, s), 6).alias("hours"), F.datediff(t, s).alias("days"), F.hour(t).alias("kickoff_hour"), F.weekday(t).alias("weekday"), F.round(F.hour(s) + F.minute(s) / 60.0, 6).alias("collected_hour"))


@query("f14_part_of_day", "select snap_id, case when hour(snapshot_ts) between 6 and 11 then 'Morning' when hour(snapshot_ts) between 12 and 17 then 'Afternoon' when hour(snapshot_ts) >= 18 then 'Evening' else 'Night' end as part from {snapshots}")
def f14(v: Views):
    return v.snapshots.select("snap_id", tm.part_of_day(F.hour("snapshot_ts")).alias("part"))


@query("f15_season_state", "select game_id, case when month(start_ts) >= 8 or month(start_ts) = 1 then 'In-season' when month(start_ts) >= 5 then 'Pre-season' else 'Offseason' end as state from {games}")
def f15(v: Views):
    return v.games.select("game_id", tm.season_state(F.col("start_ts")).alias("state"))


@query("f19_poll_date", "select game_id, strftime(case when cast(d as date) <= date '1998-06-01' then d end, '%Y-%m-%d') as poll_day from (select game_id, cast(start_ts as date) as d from {games})")
def f19(v: Views):
    season = F.when(F.month("start_ts") <= 3, F.year("start_ts") - 1).otherwise(F.year("start_ts"))
    return v.games.select("game_id", tm.poll_date(F.date_format("start_ts", "MMM d"), season, F.lit("1998-06-01")).cast("string").alias("poll_day"))


@query("f19_closest_poll", """
with c as (select distinct season, poll, week, case when week % 5 <> 0 then cast(make_date(season, 1, 1) + cast(week * 7 + 3 as int) as date) end as d, make_date(season, 7, 1) as a from {rankings}),
k as (select *, case when d <= a then d end as kd from c),
r as (select *, row_number() over (partition by season order by kd is null, abs(datediff('day', kd, a)), week desc, poll <> 'CFP') as n from k)
select season, poll, week, strftime(kd, '%Y-%m-%d') as poll_day from r where n = 1""")
def f19_closest(v: Views):
    date = F.when(F.col("week") % 5 != 0, F.date_add(F.make_date("season", F.lit(1), F.lit(1)), F.col("week") * 7 + 3))
    found = e.closest_poll(v.rankings.withColumn("date", date), ["season"], "date", "week", F.make_date("season", F.lit(7), F.lit(1)), ["CFP", "AP"])
    return found.select("season", "poll", "week", F.col("date").cast("string").alias("poll_day"))


@query("f23_gap_to_price", "select snap_id, round(lowest_price * (1 - least(greatest(exp(event_key % 10 / 10.0) - 1, 0), 1)), 6) as price, least(greatest((epoch_us(start_ts) - epoch_us(snapshot_ts)) / 3.6e9, 0), 500) as horizon from {snapshots} where lowest_price is not null")
def f23(v: Views):
    rows = v.snapshots.where("lowest_price is not null")
    return rows.select("snap_id", F.round(ev.gap_to_price(F.col("lowest_price"), F.col("event_key") % 10 / 10.0), 6).alias("price"), ev.clamp_horizon(tm.hours_between(F.col("start_ts"), F.col("snapshot_ts")), 500.0).alias("horizon"))


@query("f24_hourly_grid", "select event_key, count(*) as n, epoch_us(min(t)) as first_us, epoch_us(max(t)) as last_us from (select event_key, unnest(generate_series(start_ts - interval 2 day, start_ts, interval 1 hour)) as t from (select event_key, min(start_ts) as start_ts from {snapshots} group by 1)) group by 1")
def f24(v: Views):
    events = v.snapshots.groupBy("event_key").agg(F.min("start_ts").alias("start_ts"))
    grid = events.withColumn("t", F.explode(tm.hourly_grid(F.col("start_ts"), 2)))
    return grid.groupBy("event_key").agg(F.count(F.lit(1)).alias("n"), micros(F.min("t")).alias("first_us"), micros(F.max("t")).alias("last_us"))


# sources and pages


@query("s1_read_csv")
def s1(v: Views):
    return io.read_csv(io.written_csv(v.snapshots.select("snap_id", "event_type", "lowest_price"), "s1"), "snap_id long, event_type string, lowest_price double")


@query("s4_nearest_year", "select abs(y - 1994) as off, y from (select distinct cast(season as int) as y from {games}) order by abs(y - 1994), y > 1994 limit 1")
def s4(v: Views):
    years = v.games.select(F.col("season").alias("y")).distinct()
    return io.nearest_year(years, "y", 1994).select(F.abs(F.col("y") - 1994).alias("off"), "y")


@query("s5_latest_or_previous", "select game_id from {games} where season = (select max(season) from {games} where season <= 2050)")
def s5(v: Views):
    return io.latest_season(v.games, "season", 2050).select("game_id")


@query("s6_union_archives", "select game_id, home_points as score, cast(null as double) as extra from {games} where season < 1995 union all select game_id, home_points, away_points from {games} where season >= 1995")
def s6(v: Views):
    old = v.games.where("season < 1995").select(F.col("game_id").alias("gameId"), F.col("home_points").alias("homePoints"))
    new = v.games.where("season >= 1995").select("game_id", F.col("home_points").alias("score"), F.col("away_points").alias("extra"))
    names = {"game_id": ["game_id", "gameId"], "score": ["score", "homePoints"], "extra": ["extra"]}
    return io.union_all_years([io.harmonize(old, names), io.harmonize(new, names)]).select("game_id", "score", F.col("extra").cast("double"))


@query("s7_harmonize", "select c_custkey as id, c_name as team, cast(null as varchar) as venue, c_acctbal as price from {customer}")
def s7(v: Views):
    names = {"id": ["id", "c_custkey"], "team": ["team", "c_name", "name"], "venue": ["venue", "stadium"], "price": ["c_acctbal", "price"]}
    return io.harmonize(v.customer, names, {"venue": "string"}).select(*names)


_SAID = "p as (select page_id, html || case when page_id % 3 = 0 then '<p>There are ' || (page_id % 7) || ',250 tickets still available</p>' else '' end as html from {pages})"


@query("s11_page_metrics", f"with {_SAID} select page_id, case when page_id % 3 = 0 then cast((page_id % 7) * 1000 + 250 as double) end as tickets, length(html)::int as n from p")
def s11(v: Views):
    more = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<p>There are "), (F.col("page_id") % 7).cast("string"), F.lit(",250 tickets still available</p>"))).otherwise("")
    pages = v.pages.withColumn("html", F.concat("html", more))
    return pages.select("page_id", ex.number_after(F.col("html"), ex.AVAILABLE).alias("tickets"), F.length("html").alias("n"))


def _ld(v: Views):
    """A page of each part: one event with one offer, one with a list of offers, a list of two blocks of which one is an event, or text
    that is no JSON."""
    event = lambda *more: F.struct(F.lit("SportsEvent").alias("@type"), F.col("p_name").alias("name"), F.lit("2024-09-01").alias("startDate"), F.concat(F.lit("/e/"), F.col("p_partkey").cast("string")).alias("url"), *more)
    high = (F.col("p_retailprice") + F.col("p_size")).alias("highPrice")
    one = event(F.struct(F.col("p_retailprice").alias("lowPrice"), high, F.lit("/o").alias("url")).alias("offers"))
    two = event(F.array(F.struct(F.col("p_retailprice").alias("price"), F.lit(None).cast("double").alias("highPrice")), F.struct((F.col("p_retailprice") / 2).alias("price"), high)).alias("offers"))
    kind = F.col("p_partkey") % 4
    other = F.to_json(F.struct(F.lit("Place").alias("@type"), F.lit("hall").alias("name")))
    text = F.when(kind == 0, F.to_json(one)).when(kind == 1, F.to_json(two)).when(kind == 2, F.concat(F.lit("["), other, F.lit(","), F.to_json(one), F.lit("]"))).otherwise("{broken")
    html = F.concat(F.lit('<html><script type="application/ld+json">'), text, F.lit("</script><SCRIPT type='application/ld+json'>"), other, F.lit("</SCRIPT></html>"))
    return v.part.select(F.col("p_partkey").alias("page"), html.alias("html"))


_BLOCKS = """
b as (select p_partkey as page, 0 as no, 'SportsEvent' as kind, p_name as name from {part} where p_partkey % 4 < 2
      union all select p_partkey, 0, 'Place', 'hall' from {part} where p_partkey % 4 = 2 union all select p_partkey, 1, 'SportsEvent', p_name from {part} where p_partkey % 4 = 2
      union all select p_partkey, 10000, 'Place', 'hall' from {part})
"""
_OFFERS = """
o as (select p_partkey as page, case when p_partkey % 4 = 2 then 1 else 0 end as no, p_name as title, case when p_partkey % 4 = 1 then p_retailprice / 2 else p_retailprice end as low,
             p_retailprice + p_size as high, case when p_partkey % 4 = 1 then '/e/' || p_partkey else '/o' end as url from {part} where p_partkey % 4 < 3)
"""


@query("s9_json_blocks", f"with {_BLOCKS} select page, cast(no as int) as block_no, kind, name from b")
def s9(v: Views):
    get = lambda path: F.try_variant_get("block", path, "string")
    return ex.json_blocks(_ld(v)).select("page", F.col("block_no").cast("int").alias("block_no"), get("$['@type']").alias("kind"), get("$.name").alias("name"))


@query("s10_offer_rows", f"with {_OFFERS} select page, cast(no as int) as block_no, title, '2024-09-01' as start, round(low, 4) as low_price, round(high, 4) as high_price, url as offer_url from o")
def s10(v: Views):
    out = ex.offer_rows(ex.json_blocks(_ld(v)), ["page"])
    return out.withColumns({"block_no": F.col("block_no").cast("int"), "low_price": F.round("low_price", 4), "high_price": F.round("high_price", 4)})


@query("s13_event_summary", f"with {_OFFERS} select page, round(low, 4) as low_price, round(high, 4) as high_price, round(case when page % 3 = 0 then 77 else (low + high) / 2 end, 4) as average_price, case when page % 3 = 0 then 5.0 end as listing_count from o")
def s13(v: Views):
    offers = ex.offer_rows(ex.json_blocks(_ld(v)), ["page"])
    said = F.col("page") % 3 == 0
    out = ex.event_summary(offers, "page", "block_no", F.when(said, 77.0), F.when(said, 5.0))
    return out.withColumns({c: F.round(c, 4) for c in ("low_price", "high_price", "average_price")})


@query("s2_json_tables", "select p_partkey, p_name, 'array' as kind from {part} union all select p_partkey, p_name, 'lines' from {part}")
def s2(v: Views):
    rows = v.part.select("p_partkey", "p_name")
    lines, arrays = io.scratch(v.spark, "json-lines"), io.scratch(v.spark, "json-arrays")
    rows.write.json(lines)
    several = rows.groupBy(F.floor(F.col("p_partkey") / 1000).alias("k")).agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name"))).alias("value"))
    several.select("value").write.option("maxRecordsPerFile", 1).text(arrays)
    read = lambda path, kind: io.read_json_table(v.spark, path, "p_partkey long, p_name string").withColumn("kind", F.lit(kind))
    return read(arrays, "array").unionByName(read(lines, "lines"))


_FILES = "f as (select distinct 'data/' || case when (p_partkey + p_size) % 3 > 0 then '/archive/' else '' end || 'games_' || p_brand || '_' || (1990 + p_partkey % 40) || '.csv' as path, 1990 + p_partkey % 40 as y from {part})"


@query("s3_best_file_per_year", f"with {_FILES} select cast(y as int) as season_year, arg_min(path, (contains(path, '/archive/'), path)) as path from f group by y")
def s3(v: Views):
    key = F.col("p_partkey")
    path = F.concat(F.lit("data/"), F.when((key + F.col("p_size")) % 3 > 0, "/archive/").otherwise(""), F.lit("games_"), F.col("p_brand"), F.lit("_"), (1990 + key % 40).cast("string"), F.lit(".csv"))
    return io.best_file_per_year(v.part.select(path.alias("path")).distinct())


@query("s8_flatten_rankings", "select season, week, poll, rank, team as school, cast(case when rank < 3 then rank * 10 else 0 end as int) as first_place_votes from {rankings} where rank <> 7")
def s8(v: Views):
    rank = F.struct(F.when(F.col("rank") != 7, F.col("rank")).alias("rank"), F.when(F.col("rank") % 2 == 0, F.col("team")).alias("school"), F.col("team"), F.when(F.col("rank") < 3, F.col("rank") * 10).alias("firstPlaceVotes"))
    polls = v.rankings.groupBy("season", "week", "poll").agg(F.collect_list(rank).alias("ranks"))
    weeks = polls.groupBy("season", "week").agg(F.collect_list(F.struct("poll", "ranks")).alias("polls"))
    return ex.flatten_rankings(weeks.groupBy("season").agg(F.collect_list(F.struct("season", "week", "polls")).alias("weeks")).select("weeks"))


@query("s17_clean_stadiums", "select p_brand as school, trim(p_name) as stadium, cast(case when p_partkey % 9 > 0 then p_size * 1000 end as int) as capacity, p_type as city, cast(null as varchar) as state from {part}")
def s17(v: Views):
    raw = v.part.select(
        F.concat("p_brand", F.lit("[a]")).alias("Home team"), F.concat(F.lit(" "), "p_name", F.lit("[12] ")).alias("Stadium name"),
        F.when(F.col("p_partkey") % 9 > 0, F.concat(F.col("p_size").cast("string"), F.lit(",000[3]"))).otherwise("unknown").alias("Capacity (max)"), F.col("p_type").alias("City"),
    )
    return ex.clean_stadiums(raw)


@query("s18_clean_rankings", "select cast(s_suppkey as int) as rank, s_name as school, cast(case when s_suppkey % 2 = 0 then s_suppkey % 50 else 0 end as int) as first_place_votes from {supplier} where s_suppkey % 5 > 0 and s_suppkey > 0 order by s_suppkey, s_name limit 25")
def s18(v: Views):
    key = F.col("s_suppkey")
    raw = v.supplier.where(key > 0).select(
        F.when(key % 5 > 0, F.concat(key.cast("string"), F.lit("."))).otherwise("NR").alias("rank"),
        F.concat("s_name", F.when(key % 2 == 0, F.concat(F.lit(" ("), (key % 50).cast("string"), F.lit(")"))).otherwise("[b]")).alias("team"),
    )
    return ex.clean_rankings(raw)


@query("s12_first_offer_metrics", "select snap_id, case when row_number() over (partition by event_key order by snapshot_ts, snap_id) = 1 then 7 end as listing_count from {snapshots}")
def s12(v: Views):
    return ex.metrics_on_first(v.snapshots, "event_key", ["snapshot_ts", "snap_id"], {"listing_count": F.lit(7)}).select("snap_id", "listing_count")


#: A third of the pages has no title, another one no heading either.
_TITLED = "case page_id % 3 when 0 then html when 1 then regexp_replace(html, '<title>[^<]*</title>', '') else regexp_replace(html, '<title>[^<]*</title>|<h1[^>]*>[^<]*</h1>', '') end"


@query("s14_page_name", f"select page_id, coalesce(nullif(trim(split_part(regexp_extract(h, '<title>([^<]*)</title>', 1), ' | ', 1)), ''), nullif(trim(regexp_extract(h, '<h1[^>]*>([^<]*)</h1>', 1)), ''), '~') as name from (select page_id, {_TITLED} as h from {{pages}})".replace("regexp_replace(html, '<title>[^<]*</title>|<h1[^>]*>[^<]*</h1>', '')", "regexp_replace(html, '<title>[^<]*</title>|<h1[^>]*>[^<]*</h1>', '', 'g')"))
def s14(v: Views):
    # a page without title and heading is named by its link; here all links have the slug ~
    return v.pages.select("page_id", ex.page_name(F.lit(None).cast("string"), F.expr(_TITLED), F.lit("https://example.org/~")).alias("name"))


_OFFERED = "case page_id % 4 when 0 then 'n/a' when 1 then cast(page_id as string) when 2 then concat(page_id, '.25') end"


@query("s15_offers_to_snapshots", f"select page_id as offer_id, try_cast({_OFFERED} as double) as lowest_price, epoch_us(timestamp '2024-02-01 00:00:00') as collected_us from {{pages}}")
def s15(v: Views):
    offers = v.pages.select(F.col("page_id").alias("offer_id"), F.expr(_OFFERED).alias("low_price"))
    out = ex.offers_to_snapshots(offers, {"low_price": "lowest_price"}, ASOF)
    return out.select("offer_id", "lowest_price", micros(F.col("collected_at")).alias("collected_us"))


@query("s16_kickoff_rows", "select g.game_id, p.p_retailprice as lowest_price, true as is_kickoff_snapshot from {games} g left join (select p_name, min(p_retailprice) as p_retailprice from {part} group by p_name) p on p.p_name = g.venue")
def s16(v: Views):
    prices = v.part.groupBy(F.col("p_name").alias("venue")).agg(F.min("p_retailprice").alias("lowest_price"))
    return ex.kickoff_rows(v.games, prices, "venue").select("game_id", "lowest_price", "is_kickoff_snapshot")


@query("s19_write_atomic")
def s19(v: Views):
    return io.write_partitioned(v.games.select("game_id", "season", "home_points"), "season", "s19")


@query("s20_append_dedup", "select event_key, event_type, snap_id from (select *, row_number() over (partition by event_key, event_type order by snapshot_ts desc, snap_id desc) as n from {snapshots}) where n = 1")
def s20(v: Views):
    s = v.snapshots
    return io.append_dedup(s.where("snap_id % 3 > 0"), s.where("snap_id % 3 = 0"), ["event_key", "event_type"], ["snapshot_ts", "snap_id"]).select("event_key", "event_type", "snap_id")


@query("s22_status_upsert", "select event_type as name, snap_id, '{\"key\":\"' || event_key || '\"}' as extra from (select *, row_number() over (partition by event_type order by snapshot_ts desc, snap_id desc) as n from {snapshots}) where n = 1")
def s22(v: Views):
    log = v.snapshots.select(F.col("event_type").alias("name"), F.col("snapshot_ts").alias("updated_at"), "snap_id", F.to_json(F.create_map(F.lit("key"), F.col("event_key").cast("string"))).alias("extra"))
    return q.latest_status(log, tie="snap_id").select("name", "snap_id", "extra")


@query("a26_ordered_status", "select event_type as name, snap_id, cast(case event_type when 'purchase' then 0 when 'click' then 1 when 'view' then 2 end as int) as place from (select *, row_number() over (partition by event_type order by snapshot_ts desc, snap_id desc) as n from {snapshots} where event_type in ('purchase', 'click', 'view')) where n = 1")
def a26(v: Views):
    log = v.snapshots.select(F.col("event_type").alias("name"), F.col("snapshot_ts").alias("updated_at"), "snap_id")
    return q.ordered_status(log, ["purchase", "click", "view"], tie="snap_id").select("name", "snap_id", "place")


@query("s23_analysis_view", "select game_id, season, home_team from {games}")
def s23(v: Views):
    return v.games.select(*p.present(v.games, ["game_id", "season", "capacity", "home_team"]))


@query("s24_column_order", "select home_team, game_id, season, week from {games}")
def s24(v: Views):
    return io.ordered_columns(v.games.select("season", "game_id", "week", "home_team"), ["home_team", "missing", "game_id"])


# quality


@query("a14_health", "select count(*) as n_rows, strftime(max(cast(snapshot_ts as date)), '%Y-%m-%d') as last_day, round(avg(case when snap_id % 10 > 0 then 1.0 else 0 end), 6) as time_ratio, datediff('day', max(cast(snapshot_ts as date)), date '2024-02-01') <= 7 as fresh, false as ok from {snapshots}")
def a14(v: Views):
    shown = F.when(F.col("snap_id") % 10 > 0, "3:30 PM").otherwise("later")
    out = q.health(v.snapshots, {"time": tm.parse_time(shown)}, F.to_date("snapshot_ts"), ASOF)
    return out.select("n_rows", F.col("last_day").cast("string"), F.round("time_ratio", 6).alias("time_ratio"), "fresh", "ok")


@query("a15_profile", "select count(*) as n_rows, count(event_key) - count(distinct event_key) as duplicate_keys, round(avg(case when lowest_price is not null then 1.0 else 0 end), 6) as lowest_price_fill, epoch_us(min(snapshot_ts)) as first_us, epoch_us(max(snapshot_ts)) as last_us from {snapshots}")
def a15(v: Views):
    out = q.profile(v.snapshots, "event_key", ["lowest_price"], "snapshot_ts")
    return out.select("n_rows", "duplicate_keys", F.round("lowest_price_fill", 6).alias("lowest_price_fill"), micros(F.col("first_ts")).alias("first_us"), micros(F.col("last_ts")).alias("last_us"))


@query("a16_changed_rows", "select count_if(lowest_price is null or snap_id % 4 = 0)::bigint as n_changed, count_if(lowest_price is null)::bigint as n_filled from {snapshots}")
def a16(v: Views):
    after = v.snapshots.select("snap_id", F.when(F.col("lowest_price").isNull() | (F.col("snap_id") % 4 == 0), -1.0).otherwise(F.col("lowest_price")).alias("lowest_price"))
    return q.changed_rows(v.snapshots, after, "snap_id", ["lowest_price"])


@query("a19_importance_by_base", "select event_type as base, round(sum(value), 4) as importance, sum(value) < 20000 as near_zero from {events} group by event_type")
def a19(v: Views):
    rows = v.events.select(F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "_missing").otherwise("")).alias("feature"), F.col("value").alias("importance"))
    return q.importance_by_base(rows, 20000.0).withColumn("importance", F.round("importance", 4))


@query("a25_numeric_share", "select 'a' as column_name, round(avg(case when event_id % 20 > 0 then 1.0 else 0 end), 6) as numeric_share, avg(case when event_id % 20 > 0 then 1.0 else 0 end) >= 0.9 as mostly_numeric from {events} union all select 'b', 0.0, false")
def a25(v: Views):
    rows = v.events.select(F.when(F.col("event_id") % 20 > 0, F.col("value").cast("string")).otherwise("n/a").alias("a"), F.col("event_type").alias("b"))
    return q.numeric_share(rows, ["a", "b"]).withColumn("numeric_share", F.round("numeric_share", 6))


# model tables


@query("a20_sequences", "select event_key, count(*)::int as length, string_agg(cast(coalesce(cast(round(lowest_price * 100) as bigint), 0) as varchar), ',' order by snapshot_ts, snap_id) as cents, string_agg(case when lowest_price is null then '0' else '1' end, '' order by snapshot_ts, snap_id) as mask from {snapshots} group by event_key having count(*) >= 2")
def a20(v: Views):
    out = mo.event_sequences(v.snapshots, "event_key", "snapshot_ts", "snap_id", ["lowest_price"])
    cents = F.array_join(F.transform("features", lambda r: F.round(r[0] * 100).cast("long").cast("string")), ",")
    return out.select("event_key", "length", cents.alias("cents"), F.array_join(F.transform("masks", lambda r: r[0].cast("string")), "").alias("mask"))


@query("a21_vocabulary", "select p_type as value, row_number() over (order by p_type) as index from (select distinct p_type from {part})")
def a21(v: Views):
    return mo.vocabulary(v.part, "p_type")


@query("a22_rank_runs", "select event_type as run, round(avg(value), 6) as mae, round(avg(case when value < 20 then 1.0 else 0 end), 6) as within_rel from {events} group by 1")
def a22(v: Views):
    runs = v.events.groupBy(F.col("event_type").alias("run")).agg(F.round(F.avg("value"), 6).alias("mae"), F.round(F.avg((F.col("value") < 20).cast("double")), 6).alias("within_rel"))
    return mo.rank_runs(runs)


def _train_rows(v: Views):
    from tidemark.operators import targets as t

    rows = t.gap_targets(v.snapshots, ASOF)
    rows = rows.withColumns({"hours_left": tm.hours_between(F.col("start_ts"), F.col("snapshot_ts")), "weekday": F.weekday("snapshot_ts").cast("double"), "gap_log": F.log1p("gap_pct")})
    rows = t.group_time_split(p.usable(rows, "gap_pct", "hours_left"), 0.2)
    return io.stored(rows.select("snap_id", "event_key", "start_ts", "lowest_price", "hours_left", "weekday", "event_type", "gap_log", "is_test"), "examples")


@query("m1_gap_model")
def m1(v: Views):
    rows = _train_rows(v)
    model, _ = mo.fit_gap_model(rows.where("not is_test"), ["lowest_price", "hours_left", "weekday"], ["event_type"], "gap_log", pinned=("hours_left",))
    test, _ = mo.with_missing_flags(rows.where("is_test"), ["lowest_price", "hours_left", "weekday"])
    return mo.monotone_by_event(model.transform(test), "event_key", "hours_left", "prediction").select("snap_id", F.round("prediction", 6).alias("prediction"), F.round(ev.gap_to_price(F.col("lowest_price"), F.col("prediction")), 2).alias("predicted_price"))


@query("m2_price_model")
def m2(v: Views):
    train, test = _train_rows(v).randomSplit([0.8, 0.2], 1)
    model = mo.price_model(["hours_left", "weekday"], ["event_type"], "lowest_price").fit(train)
    return model.transform(test).select("snap_id", F.round("prediction", 6).alias("prediction"))


@query("m3_score_table")
def m3(v: Views):
    rows = _train_rows(v)
    model = mo.gap_model(["lowest_price", "hours_left"], [], "gap_log").fit(rows.where("not is_test"))
    return model.transform(rows).select("snap_id", ev.gap_to_price(F.col("lowest_price"), F.col("prediction")).alias("predicted_min"), ev.clamp_horizon(F.col("hours_left")).alias("horizon"))


@query("m4_training_report")
def m4(v: Views):
    rows = _train_rows(v)
    model = mo.gap_model(["lowest_price", "hours_left"], [], "gap_log").fit(rows.where("not is_test"))
    return mo.training_report(model.transform(rows.where("is_test")), "gap_log", "prediction")


@query("m5_sweep")
def m5(v: Views):
    rows = _train_rows(v)
    settings = {f"depth{k}": mo.gap_model(["lowest_price", "hours_left"], [], "gap_log", maxDepth=k) for k in (2, 3, 4)}
    return mo.sweep(rows.where("not is_test"), rows.where("is_test"), settings, "gap_log")


@query("a23_permutation_importance")
def a23(v: Views):
    rows = _train_rows(v)
    model = mo.gap_model(["lowest_price", "hours_left"], [], "gap_log").fit(rows.where("not is_test"))
    return mo.permutation_importance(model, rows.where("is_test"), ["lowest_price", "hours_left"], "gap_log", "snap_id")


@query("a24_partial_dependence")
def a24(v: Views):
    rows = _train_rows(v)
    model = mo.gap_model(["lowest_price", "hours_left"], [], "gap_log").fit(rows.where("not is_test"))
    return mo.partial_dependence(model, rows.where("is_test"), "hours_left", [24.0, 168.0, 500.0])


# streams over the events in several files, one micro-batch each, some rows of which come late


def _stream(v: Views, late: bool = True):
    return st.open_stream(v.spark, st.landed(v.spark, v.sf_dir, "events", late=late))


@query("x1_stream_dedup", "select distinct user_id as event_key, event_type, epoch_us(time_bucket(interval 6 hour, ts)) as bucket_us from {events}")
def x1(v: Views):
    return st.appended(st.dedup_buckets(_stream(v)))


@query("x2_stream_upsert", "select event_key, event_type, snap_id from (select *, row_number() over (partition by event_key, event_type order by snapshot_ts desc, snap_id desc) as n from {snapshots}) where n = 1")
def x2(v: Views):
    rows = _stream(v).select(F.col("event_id").alias("snap_id"), F.col("user_id").alias("event_key"), "event_type", F.col("ts").alias("snapshot_ts"))
    return st.upserted(rows, ["event_key", "event_type"], ["snapshot_ts", "snap_id"]).select("event_key", "event_type", "snap_id")


@query("x3_six_hour_windows", "select user_id as event_key, epoch_us(time_bucket(interval 6 hour, ts)) as from_us, min(value) as low, round(avg(value), 6) as mean, count(*) as n from {events} group by all")
def x3(v: Views):
    out = st.upserted(st.windowed(_stream(v), "6 hours"), ["event_key", "from_us"], mode="update")
    return out.withColumn("mean", F.round("mean", 6))


@query("x4_daily_windows", "select user_id as event_key, epoch_us(time_bucket(interval 1 day, ts)) as from_us, min(value) as low, round(avg(value), 6) as mean, count(*) as n from {events} group by all")
def x4(v: Views):
    out = st.upserted(st.windowed(_stream(v), "1 day"), ["event_key", "from_us"], mode="update")
    return out.withColumn("mean", F.round("mean", 6))


@query("x5_stream_enriched", "select event_id, c_name from {events} join {customer} on c_custkey = user_id")
def x5(v: Views):
    dim = v.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    return st.appended(_stream(v).join(dim, "user_id").select("event_id", "c_name"))


@query("x6_stream_interval_join", "select a.event_id, b.event_id as start_id from {events} a join {events} b on b.user_id = a.user_id and b.event_type = 'purchase' and a.ts between b.ts - interval 30 minute and b.ts + interval 15 minute")
def x6(v: Views):
    return st.appended(st.near_starts(_stream(v, late=False)))


@query("x7_running_min", "select user_id as event_key, min(case when event_type <> 'error' then value end) as low, count(*) as n from {events} group by user_id")
def x7(v: Views):
    return st.upserted(st.running_min(_stream(v)), ["event_key"], mode="update")


@query("x7_price_alerts", """
with p as (select event_id as snap_id, user_id as event_key, ts, value as price from {events} where event_type <> 'error' and value is not null and ts <= timestamp '2024-01-10 18:00:00' + to_days(cast(user_id % 40 as integer))),
f as (select event_key, predicted_price / 2 as floor from {predictions}),
w as (select p.*, floor, lag(price) over o as last, min(price) over (partition by p.event_key order by ts, snap_id rows between unbounded preceding and 1 preceding) as low_before from p left join f on f.event_key = p.event_key window o as (partition by p.event_key order by ts, snap_id))
select event_key, snap_id, price, low_before, price <= low_before as at_low, coalesce(price <= floor, false) as at_floor from w where price < last and (price <= low_before or coalesce(price <= floor, false))""")
def x7_alerts(v: Views):
    price = F.when(F.col("event_type") != "error", F.nanvl("value", F.lit(None).cast("double")))
    start = F.lit("2024-01-10 18:00:00").cast("timestamp") + F.make_interval(days=(F.col("user_id") % 40).cast("int"))
    rows = _stream(v, late=False).select(F.col("event_id").alias("snap_id"), F.col("user_id").alias("event_key"), "ts", price.alias("price"), start.alias("start_ts"))
    return st.appended(st.price_alerts(rows, v.predictions.select("event_key", (F.col("predicted_price") / 2).alias("floor"))))


@query("x8_late_rows", "select event_id from {events} where ts <= timestamp '2024-01-10 18:00:00' + to_days(cast(user_id % 40 as integer))")
def x8(v: Views):
    return st.appended(st.before_start(_stream(v)))
