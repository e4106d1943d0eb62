"""Offers, metrics and names out of pages: columns of HTML and JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import url_title

_BLOCK = r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"


def json_blocks(df: DataFrame, html: str = "html") -> DataFrame:
    """A row for each JSON-LD object of a page, in order: block (VARIANT) and block_no; lists give a row for each item, malformed
    blocks none."""
    texts = df.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1))).alias("__no", "__text"))
    parsed = texts.withColumn("__v", F.try_parse_json("__text")).where("__v is not null")
    as_list = F.coalesce(F.try_variant_get("__v", "$", "array<variant>"), F.array("__v"))
    out = parsed.select(*df.columns, "__no", F.posexplode(as_list).alias("__item", "block"))
    return out.withColumn("block_no", F.col("__no") * 10_000 + F.col("__item")).drop("__no", "__item")


def offer_rows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One row an Event block: low and high price (of a list of offers the last that are not null), link (the offer's, else the block's)."""
    get = lambda path, kind="string": F.try_variant_get("block", path, kind)
    single = F.array(F.struct(get("$.offers.lowPrice", "double").alias("low"), get("$.offers.highPrice", "double").alias("high"), get("$.offers.url").alias("url")))
    several = F.transform(
        F.try_variant_get("block", "$.offers", "array<variant>"),
        lambda o: F.struct(
            F.coalesce(F.try_variant_get(o, "$.lowPrice", "double"), F.try_variant_get(o, "$.price", "double")).alias("low"),
            F.try_variant_get(o, "$.highPrice", "double").alias("high"), F.try_variant_get(o, "$.url", "string").alias("url"),
        ),
    )
    rows = blocks.where(get("$['@type']").rlike("Event")).withColumn("__o", F.coalesce(several, single))
    last = lambda f: F.element_at(F.concat(F.array(F.lit(None)), F.filter(F.transform("__o", lambda o: o[f]), lambda x: x.isNotNull())), -1)
    return rows.select(*keys, "block_no", get("$.name").alias("title"), get("$.startDate").alias("start"), last("low").alias("low_price"), last("high").alias("high_price"), F.coalesce(last("url"), get("$.url")).alias("offer_url"))


def number_after(html: Column, pattern: str) -> Column:
    """The number that a pattern's group finds, without thousands separators."""
    return F.replace(F.regexp_extract(html, pattern, 1), F.lit(","), F.lit("")).try_cast("double")


# The wording of a foreign page.
AVERAGE = r"(?i)average ticket price is \$\s*([0-9][0-9,]*(?:\.\d{2})?)"
AVAILABLE = r"(?i)There are\s*([0-9][0-9,]*)\s*tickets still available"


def metrics_on_first(df: DataFrame, page: str, order: list[str], metrics: dict[str, Column]) -> DataFrame:
    """A page's metrics on its first offer only, unknown dates and times last."""
    first = F.row_number().over(Window.partitionBy(page).orderBy(*(F.col(c).asc_nulls_last() for c in order))) == 1
    return df.withColumns({k: F.when(first, c) for k, c in metrics.items()})


def event_summary(offers: DataFrame, page: str, order: str, page_average: Column | None = None, page_count: Column | None = None) -> DataFrame:
    """For each page the first low and high price that are not null, the page's own metrics before those."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c]
    out = offers.groupBy(page).agg(first("low_price").alias("low_price"), first("high_price").alias("high_price"), F.max(page_average if page_average is not None else F.lit(None).cast("double")).alias("__a"), F.max(page_count if page_count is not None else F.lit(None).cast("double")).alias("listing_count"))
    return out.select(page, "low_price", "high_price", F.coalesce("__a", (F.col("low_price") + F.col("high_price")) / 2).alias("average_price"), "listing_count")


def page_name(team: Column, html: Column, url: Column) -> Column:
    """A known team, else the title before a bar, else the first heading, else the link's slug."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    title = F.substring_index(F.regexp_extract(html, "<title>([^<]*)</title>", 1), " | ", 1)
    return F.coalesce(some(team), some(title), some(F.regexp_extract(html, "<h1[^>]*>([^<]*)</h1>", 1)), url_title(url))


def offers_to_snapshots(offers: DataFrame, prices: dict[str, str], collected: str) -> DataFrame:
    """Prices as numbers under their canonical names (what is no number becomes null), and when they were collected."""
    out = offers.withColumns({to: F.col(c).try_cast("double") for c, to in prices.items()}).drop(*[c for c, to in prices.items() if c != to])
    return out.withColumn("collected_at", F.lit(collected).cast("timestamp"))


def kickoff_rows(games: DataFrame, prices: DataFrame, on: str) -> DataFrame:
    """Games with what a price lookup has for them, marked as taken at kickoff."""
    return games.join(prices, on, "left").withColumn("is_kickoff_snapshot", F.lit(True))


def flatten_rankings(df: DataFrame) -> DataFrame:
    """Weeks of polls of ranks as rows; ranks without a number or a school are left out."""
    weeks = df.select(F.explode("weeks").alias("w"))
    polls = weeks.select("w.season", "w.week", F.explode("w.polls").alias("p"))
    ranks = polls.select("season", "week", F.col("p.poll").alias("poll"), F.explode("p.ranks").alias("r"))
    school = F.coalesce(F.col("r.school"), F.col("r.team"))
    return ranks.select("season", "week", "poll", F.col("r.rank").alias("rank"), school.alias("school"), F.coalesce(F.col("r.firstPlaceVotes"), F.lit(0)).alias("first_place_votes")).where("rank is not null and school is not null")


def clean_stadiums(df: DataFrame) -> DataFrame:
    """Columns found by a word of their name, footnotes off, the first whole number as capacity."""
    def like(part: str) -> Column:
        found = next((c for c in df.columns if part in re.split("[^a-z]+", c.lower())), None)
        return F.trim(F.regexp_replace(F.col(f"`{found}`").cast("string"), r"\[.*?\]", "")) if found else F.lit(None).cast("string")

    capacity = F.regexp_extract(F.replace(like("capacity"), F.lit(","), F.lit("")), r"(\d+)", 1).try_cast("int")
    return df.select(like("team").alias("school"), like("stadium").alias("stadium"), capacity.alias("capacity"), like("city").alias("city"), like("state").alias("state"))


def clean_rankings(df: DataFrame, rank: str = "rank", team: str = "team") -> DataFrame:
    """Rank as a number, first-place votes in parentheses behind the name, the name without them; the first 25 by rank."""
    votes = F.regexp_extract(team, r"\((\d+)\)\s*$", 1).try_cast("int")
    name = F.trim(F.regexp_replace(F.regexp_replace(team, r"\[.*?\]", ""), r"\s*\([^)]*\)", ""))
    rows = df.select(F.regexp_extract(F.col(rank).cast("string"), r"(\d+)", 1).try_cast("int").alias("rank"), name.alias("school"), F.coalesce(votes, F.lit(0)).alias("first_place_votes"))
    return rows.where("rank is not null and school <> ''").orderBy("rank", "school").limit(25)
