"""Names, titles, links and keys as column expressions. All of them give null for null unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that do not tell teams apart; words that do not tell venues apart.
TEAM_STOP_WORDS = ["university", "state", "college", "the", "of", "and", "at", "football", "st", "saint"]
VENUE_STOP_WORDS = ["stadium", "field", "complex", "memorial", "park", "center", "centre", "coliseum", "arena", "athletics", "athletic", "at", "the", "of"]
#: Words in the title of an event after the regular season.
POSTSEASON = r"(?i)\b(bowl|playoff|first round|quarterfinal|semifinal|final|championship|cfp)\b"


def words(c: Column, drop: list[str] | None = None, longer_than: int = 0) -> Column:
    """Words of a text between spaces, without those to drop and short ones."""
    return F.filter(F.split(c, " "), lambda w: (F.length(w) > longer_than) & ~w.isin(*(drop or [""])))


def normalize_name(c: Column) -> Column:
    """lower case, ampersand as a word, punctuation as spaces, stop words dropped, single spaces; null becomes empty."""
    x = F.lower(F.coalesce(c, F.lit("")))
    x = F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), r"[/.,\-()\[\]{}'’\s]", " ")
    return F.array_join(words(x, TEAM_STOP_WORDS), " ")


def tokens(c: Column) -> Column:
    """F2 after alias lookup: the different words of a normalized name, sorted."""
    return F.array_sort(F.array_distinct(words(normalize_name(c))))


def clean_title(c: Column) -> Column:
    """what stands behind the first colon, if anything does."""
    right = F.trim(F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1))
    return F.when(right != "", right).otherwise(F.trim(c))


def matchup(c: Column, side: int) -> Column:
    """the first (1) or second (2) side of ``A vs. B``; null if there are not two."""
    t = F.trim(F.replace(c, F.lit(" "), F.lit(" ")))
    both = [F.regexp_replace(F.regexp_extract(t, r"(?is)^(.*?)\s+vs\.?\s+(.*)$", k), r"^[ \t–—-]+|[ \t–—-]+$", "") for k in (1, 2)]
    return F.when((both[0] != "") & (both[1] != ""), both[side - 1])


def strip_suffix(c: Column, word: str = "Football") -> Column:
    """a word at the end of a name (or before another) taken out, spaces collapsed."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, rf"(?i)\s+{word}\b", "")), r"\s{2,}", " ")


def url_slug(c: Column) -> Column:
    """the last part of a link's path, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", ""), r"([^/]*)$", 1)


def url_title(c: Column) -> Column:
    """the slug as a title."""
    return F.initcap(F.replace(F.replace(url_slug(c), F.lit("-tickets"), F.lit("")), F.lit("-"), F.lit(" ")))


def url_number(c: Column) -> Column:
    """the number that ends a link's path; null if none does."""
    m = F.regexp_extract(c, r"/(\d+)(?:[/?#.].*)?$", 1)
    return F.when(m != "", m)


# Fixed value: how the links of listings end, month-day-year-hour.
_URL_TIME = r"(?i)-([1-9]|1[0-2])-([1-9]|[12]\d|3[01])-(\d{2})-([1-9]|1[0-2])(am|pm)"


def url_date(c: Column) -> Column:
    """yyyy-MM-dd from ``-month-day-yy-hour(am|pm)`` in a link."""
    part = [F.regexp_extract(c, _URL_TIME, k) for k in range(6)]
    return F.when(part[0] != "", F.concat(F.lit("20"), part[3], F.lit("-"), F.lpad(part[1], 2, "0"), F.lit("-"), F.lpad(part[2], 2, "0")))


def url_time(c: Column) -> Column:
    """HH:00 from the same place; 12am is 00, 12pm is 12."""
    hour = F.try_to_number(F.regexp_extract(c, _URL_TIME, 4), F.lit("99")).cast("int") % 12
    late = F.lower(F.regexp_extract(c, _URL_TIME, 5)) == "pm"
    return F.when(F.regexp_extract(c, _URL_TIME, 0) != "", F.concat(F.lpad((hour + F.when(late, 12).otherwise(0)).cast("string"), 2, "0"), F.lit(":00")))


def synthetic_id(*columns: Column) -> Column:
    """an id from several columns, joined by a bar, nulls as empty."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def poll_label(c: Column) -> Column:
    """F16: CFP, AP or Coaches by what the name contains, else the name; null or empty is Unknown."""
    low = F.lower(c)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "Unknown").when(low.contains("playoff") | low.contains("cfp"), "CFP")
        .when(low.contains("ap"), "AP").when(low.contains("coaches"), "Coaches").otherwise(F.trim(c))
    )


def venue_key(c: Column, strict_compat: bool = False) -> Column:
    """lower case letters, digits and single spaces; strict_compat drops the spaces."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[–—-]", " ")
    x = F.regexp_replace(x, r"[^a-z0-9\s]", "")
    return F.regexp_replace(x, r"\s+", "") if strict_compat else F.trim(F.regexp_replace(x, r"\s+", " "))


def venue_key_loose(c: Column) -> Column:
    """the key without words that most venues share and without short ones."""
    return F.array_join(words(venue_key(c), VENUE_STOP_WORDS, 2), " ")


def clean_school(c: Column) -> Column:
    """a school's name without footnotes, votes and parentheses; null becomes empty."""
    # one pass: what stands in brackets is read over, every other word is kept; long dashes part words
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[[^\]]*\]|\([^)]*\)|([^\s–—\[(]+)"), F.lit(1))
    return F.regexp_replace(F.array_join(F.array_remove(words, ""), " "), r"[\s.]+$", "")


def normalize_id(c: Column) -> Column:
    """an id as text without a trailing ``.0``; blank becomes null."""
    x = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(x != "", x)


def money(c: Column) -> Column:
    """dollars with thousands separators and two places; null is a dash."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(c, 2)), F.lit("—"))


def human_delta(seconds: Column) -> Column:
    """``1d 2h 3m 4s`` without leading zero parts; not positive is 0s."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    parts = [F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60]
    shown = [F.when((s >= least) | F.lit(unit == "s"), F.concat(p.cast("long").cast("string"), F.lit(unit))) for p, unit, least in zip(parts, "dhms", (86400, 3600, 60, 0), strict=True)]
    return F.concat_ws(" ", *shown)


def blank(c: Column) -> Column:
    """Null, empty or only spaces."""
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def filled(c: Column) -> Column:
    """The value, or null if it is blank."""
    return F.when(~blank(c), c)
