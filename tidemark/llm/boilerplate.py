"""Line de-duplication by site-relative frequency: lines that many pages of one host share are boilerplate and go.

Only DataFrame functions. The lines of a host above a ratio r are at most (distinct lines of a mean page) / r in number, so a host's
list of them has a bound that does not grow with its pages; pages meet that list by a broadcast where all lists together are small,
else by a join that spreads each host over salts. Texts are never taken apart across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import stored

#: Up to so many boilerplate lines in all (16 bytes each) the lists are broadcast.
BROADCAST_LINES = 200_000
SALTS = 64
#: A line on more than this share of a host's pages is boilerplate. Lines that sites share stand on about a tenth of every host's pages;
#: half of that is more than five standard deviations below it on 500 pages, so chance does not decide on which hosts they go.
RATIO = 0.05


def _key(line: Column) -> Column:
    """96 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def line_dedup(df: DataFrame, host: str, page: str = "doc_id", text: str = "text", ratio: float = RATIO, min_pages: int = 5) -> DataFrame:
    """df with boilerplate lines taken out of its text, and the columns n_lines and n_dropped.

    A line is boilerplate on a host if at least min_pages pages and more than ratio of all the host's pages hold it, and goes from every
    page of the host. Pages of equal text count once, as holders of a line and among the host's pages, so that copies are no evidence of
    a template. Blank lines are neither counted nor dropped.
    Lines end at ``\\n`` and are compared as they are. Each row is a page, repeated rows too. A null text stays null with 0 lines; an
    empty text has one blank line; a null host is a host of its own; the page id only spreads rows. Columns named n_lines or n_dropped
    are replaced, others stay.
    """
    df = df.drop("n_lines", "n_dropped")
    site = F.coalesce(F.col(host).cast("string"), F.lit("\0"))
    rows = df.select(site.alias("host"), F.split(F.col(text), "\n", -1).alias("lines"), _key(F.col(text)).alias("content"))
    seen = rows.select("host", "content", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: ~_blank(x)), _key))).alias("key")).distinct()
    rows = rows.select("host", "content").distinct()
    often = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    pages = stored(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "pages")
    lists = often.join(pages, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("keys"))
    lists = stored(lists, "boilerplate").select(F.col("host").alias("__host"), F.col("keys").alias("__keys"))
    total = lists.agg(F.sum(F.size("__keys"))).first()[0] or 0
    df = df.withColumn("__site", site)
    if total <= BROADCAST_LINES:
        joined = df.join(F.broadcast(lists), F.col("__site") == F.col("__host"), "left")
    else:
        lists = lists.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = df.withColumn("__of", F.pmod(F.xxhash64(page, text), F.lit(SALTS)).cast("int")).join(lists, (F.col("__site") == F.col("__host")) & (F.col("__of") == F.col("__salt")), "left")
    lines = F.split(F.col(text), "\n", -1)
    # where a host has no list there is nothing to look at
    joined = joined.withColumn("__drop", F.when(F.col("__keys").isNotNull() & F.col(text).isNotNull(), F.transform(lines, lambda x: ~_blank(x) & F.array_contains(F.col("__keys"), _key(x)))))
    joined = joined.withColumn("__dropped", F.size(F.filter("__drop", lambda x: x)))
    takes = F.col("__drop").isNotNull() & (F.col("__dropped") > 0)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.col("__drop")[i]), "\n")
    out = joined.withColumns(
        {
            text: F.when(takes, kept).otherwise(F.col(text)),
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "n_dropped": F.when(takes, F.col("__dropped")).otherwise(0).cast("long"),
        }
    )
    return out.select(*df.drop("__site").columns, "n_lines", "n_dropped")


def boilerplate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the boilerplate lines of their source."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source").select("doc_id", "source", "n_lines", "n_dropped", "text")


SQL = rf"""
with d as (select doc_id, source, coalesce(source, chr(1)) as host, text, string_split(text, chr(10)) as lines from documents),
contents as (select distinct host, text, lines from d),
pages as (select host, count(*) as pages from contents group by host),
seen as (select host, unnest(list_distinct(lines)) as line from contents),
often as (select host, line, count(*) as n from seen where trim(line, ' ') <> '' group by host, line),
lists as (select o.host, list(line) as keys from often o join pages p on p.host = o.host where n >= 5 and n > {RATIO} * pages group by o.host),
marked as (
  select d.*, l.keys, case when l.keys is null then 0 else len(list_filter(lines, lambda x: trim(x, ' ') <> '' and list_contains(l.keys, x))) end as dropped
  from d left join lists l on l.host = d.host)
select doc_id, source, cast(coalesce(len(lines), 0) as bigint) as n_lines, cast(coalesce(dropped, 0) as bigint) as n_dropped,
       case when dropped > 0
            then array_to_string(list_filter(lines, lambda x: trim(x, ' ') = '' or not list_contains(keys, x)), chr(10)) else text end as text
from marked
"""
