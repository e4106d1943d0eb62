"""The domain's tables as views over the driver's tables, in SQL that both Spark and DuckDB run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.sources.tables import stored

ASOF = "2024-02-01 00:00:00"

_SNAPSHOTS = """
select event_id as snap_id, user_id as event_key, event_type, cast(ts as timestamp) as snapshot_ts,
       case when event_type = 'error' then null else value end as lowest_price,
       cast(timestamp '2024-01-10 18:00:00' + {days} as timestamp) as start_ts
from {events}
"""
_GAMES = """
select concat_ws('-', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string)) as game_id,
       cast(year(l_shipdate) as int) as season, cast(floor((extract(doy from l_shipdate) - 1) / 7) as int) + 1 as week,
       cast(l_shipdate as timestamp) as start_ts, ns.n_name as home_team, nc.n_name as away_team,
       ns.n_regionkey as home_conf, nc.n_regionkey as away_conf,
       case when l_linestatus = 'F' then l_quantity end as home_points,
       case when l_linestatus = 'F' then round(l_discount * 500) end as away_points,
       p.p_name as venue, l_returnflag = 'R' as neutral_site
from (select * from (select *, row_number() over (partition by l_orderkey, l_partkey, l_suppkey, l_linenumber
                    order by l_shipdate, l_quantity, l_extendedprice) as copy from {lineitem}) where copy = 1) l
join {orders} o on o.o_orderkey = l.l_orderkey
join {customer} c on c.c_custkey = o.o_custkey
join {supplier} s on s.s_suppkey = l.l_suppkey
join {nation} ns on ns.n_nationkey = s.s_nationkey
join {nation} nc on nc.n_nationkey = c.c_nationkey
join {part} p on p.p_partkey = l.l_partkey
where ns.n_nationkey <> nc.n_nationkey
"""
_PREDICTIONS = "select event_key, round(avg(lowest_price), 2) as predicted_price, min(snapshot_ts) as predicted_ts from {snapshots} group by event_key"
_RANKINGS = """
select season, week, poll, team, rank
from (select season, week, poll, home_team as team,
             cast(row_number() over (partition by season, week, poll
                  order by sum(case when poll = 'AP' then home_points else away_points end) desc, home_team) as int) as rank
      from {games} cross join (values ('AP'), ('CFP')) as p(poll)
      where home_points is not null and (poll = 'AP' or week % 3 = 0)
      group by season, week, poll, home_team) t
where rank <= 10
"""
_VENUES = "select p_partkey as venue_id, p_name as venue, p_brand as school, p_size * 1000 as capacity from {part}"
_RAW_NAMES = "select p_partkey as name_id, lower(p_type) || ' ' || p_name as raw_name, p_name as target_name from {part}"
_RIVALRIES = "select a.n_name as team, b.n_name as rival from {nation} a join {nation} b on a.n_nationkey < b.n_nationkey and (a.n_nationkey + b.n_nationkey) % 5 = 0"
_PAGE_META = "select page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from {pages}"

_TEXT = {
    "snapshots": _SNAPSHOTS, "games": _GAMES, "predictions": _PREDICTIONS, "rankings": _RANKINGS, "venues": _VENUES, "raw_names": _RAW_NAMES,
    "rivalries": _RIVALRIES, "page_meta": _PAGE_META,
}
_NEEDS = {"predictions": ["snapshots"], "rankings": ["games"]}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Suppliers of which each task can hold all, as two numbers each.
FEW = 1_000_000


class Views:
    """v.games, v.events, ...: a view or a table as a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in _TEXT:
            raise AttributeError(name)
        text = _TEXT[name].replace("{days}", "make_interval(0, 0, 0, cast(user_id % 40 as int))")
        return self.spark.sql(text, **{t: getattr(self, t) for t in [*TABLES, *_TEXT] if "{" + t + "}" in text})

    def kept_games(self, *columns: str) -> DataFrame:
        """Columns of games, for queries that read them more than once: rows as of the view, stored as numbers and put together when read.

        The view's plan shuffles the lines for copies, orders, customers, suppliers and parts in turn. Here lines go to their orders once, which
        is also where copies meet; orders have found their customers before. Parts only have to be there unless the venue is asked for, so only part
        numbers are compared with them.
        """
        lines = self.lineitem.where("l_partkey is not null")
        keys = [F.col(f"l_{k}") for k in ("orderkey", "partkey", "suppkey", "linenumber")]
        of = {"home_points": ["l_linestatus", "l_quantity"], "away_points": ["l_linestatus", "l_discount"], "neutral_site": ["l_returnflag"]}
        more = dict.fromkeys(c for name in columns for c in of.get(name, []))
        first = Window.partitionBy(*keys).orderBy("l_shipdate", "l_quantity", "l_extendedprice")
        lines = lines.select(*keys, *dict.fromkeys(["l_shipdate", "l_quantity", "l_extendedprice", *more])).repartition("l_orderkey")
        lines = lines.withColumn("copy", F.row_number().over(first)).where("copy = 1").select(*keys, *dict.fromkeys(["l_shipdate", *more]))
        away = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
        home = self.supplier.select("s_suppkey", "s_nationkey")
        home = F.broadcast(home) if home.count() <= FEW else home
        kept = lines.join(away, F.col("l_orderkey") == F.col("o_orderkey")).join(home, F.col("l_suppkey") == F.col("s_suppkey"))
        kept = stored(kept.where("s_nationkey <> c_nationkey").drop("o_orderkey", "s_suppkey"), "lines")
        if "venue" in columns:
            parts = self.part.select("p_partkey", F.struct("p_name").alias("p"))
            kept = stored(kept.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey"), "lines-of-parts")
        else:
            times = self.part.groupBy("p_partkey").agg(F.count(F.lit(1)).cast("int").alias("times"))
            odd = kept.select("l_partkey").distinct().join(times, F.col("l_partkey") == F.col("p_partkey"), "left").where("times is null or times > 1")
            odd = stored(odd.select(F.col("l_partkey").alias("odd"), F.coalesce("times", F.lit(0)).alias("times")), "odd-parts")
            if odd.take(1):
                kept = kept.join(odd, F.col("l_partkey") == F.col("odd"), "left").withColumn("times", F.coalesce("times", F.lit(1))).where("times > 0")
                kept = stored(kept.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("odd", "times", "time"), "lines-of-parts")
            kept = kept.withColumn("p", F.struct(F.lit(None).cast("string").alias("p_name")))
        for c in ("l_linestatus", "l_quantity", "l_discount", "l_returnflag"):
            kept = kept if c in kept.columns else kept.withColumn(c, F.lit(None).cast(self.lineitem.schema[c].dataType))
        names = "join {nation} ns on ns.n_nationkey = l.s_nationkey join {nation} nc on nc.n_nationkey = l.c_nationkey"
        return self.spark.sql(_GAMES[: _GAMES.index("from (select")] + "from {kept} l " + names, kept=kept, nation=self.nation).select(*columns)


def sql(query: str) -> str:
    """query with the views that it names as CTEs, for DuckDB; views are written {name}."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in _TEXT:
            if "{" + v + "}" in text and v not in need:
                add(_TEXT[v])
                need.append(v)

    add(query)
    text = query
    if need:
        inner = ", ".join(f"{v} as ({_TEXT[v]})" for v in need)
        text = f"with {inner}{',' if text.lstrip().startswith('with ') else ''} {text.lstrip().removeprefix('with ')}"
    text = text.replace("{days}", "to_days(cast(user_id % 40 as integer))")
    for name in [*TABLES, *_TEXT]:
        text = text.replace("{" + name + "}", name)
    return text
