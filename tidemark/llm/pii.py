"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Only DataFrame functions. Where the matches of a pattern lie follows from the text between them: splitting a text at a pattern gives
the gaps, extracting it gives the matches, and their lengths add up to places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Patterns of the base kinds as their definition has them, in the order of kinds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches by patterns that neither go back nor start within a run that has failed as a whole, so that time follows length.
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE["phone"],
}
MORE = {
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
KINDS = [*BASE, *MORE]
#: Scores in hundredths: by the pattern (and its checksum) alone, and what a word nearby adds. Other kinds than the base ones need 50.
SCORE = {"email": 90, "ip": 60, "card": 80, "phone": 50, "iban": 85, "ssn": 30}
BONUS = {"email": 10, "ip": 20, "card": 20, "phone": 30, "iban": 15, "ssn": 40}
LEAST = 50
NEAR = 48
#: Whole words, with or without an s at their end, in lower case.
WORDS = {
    "email": "e-?mail|mail|contact|write|kontakt|correo|courriel",
    "ip": "address|server|host|login|adresse",
    "card": "card|credit|visa|karte|carte|tarjeta|payment",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer|insurance",
}
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_VALID = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def at(i: Column) -> Column:
        v = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + at(i)) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 when divided by 97."""

    def moved(r: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            c = F.ascii(F.substring(r, i, F.lit(1)))
            return F.when(c >= 65, (s * 100 + c - 55) % 97).otherwise((s * 10 + c - 48) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), step) == 1

    return let(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, F.lit(1), F.lit(4))), moved)


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(IP_VALID)
    if kind == "card":
        return F.when(n.between(13, 19), let(_digits(m), luhn)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), let(F.regexp_replace(m, " ", ""), mod97)).otherwise(False)
    return F.lit(True)


def _running(values: Column, whole, join) -> Column:
    """whole of the values up to each one (join puts two such results together), by blocks of about the root of the array's length, so
    that long arrays stay cheap."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))

    def blocks(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / w).cast("int"))
        return F.transform(starts, lambda b: whole(F.slice(values, b * w + 1, w)))

    def within(w: Column, before: Column) -> Column:
        of = lambda i: F.floor(i / w).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: join(F.get(before, of(i)), whole(F.slice(values, of(i) * w + 1, i - of(i) * w + 1))))

    def prefixed(w: Column, of_blocks: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(of_blocks) - 1), lambda b: whole(F.slice(of_blocks, F.lit(1), b))), lambda before: within(w, before))

    return let(width, lambda w: let(blocks(w), lambda x: prefixed(w, x)))


def _ends(sizes: Column) -> Column:
    """Running sums of an array."""
    return _running(sizes, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y), lambda s, y: s + y)


_SPAN = "array<struct<kind:string,start:int,end:int,score:int>>"


def spans(text: Column, whole: bool = True) -> Column:
    """All spans of a text that is not null: kind, start and end in code points (end exclusive) and score, by kind and start.

    Words nearby are those within the NEAR code points on either side of a span, whatever matches lie between: whole words, or also longer
    ones that begin with such a word."""
    return F.concat(*(_of_kind(text, kind, whole) for kind in KINDS))


#: From so many spans of a text on, pieces are cut from an array of its code points: counting them from the text's beginning takes time
#: in proportion to its length for each piece.
MANY = 64


def _cut(text: Column, points: Column, start: Column, n: Column) -> Column:
    """n code points from start on; points: the text's code points or null."""
    return F.when(points.isNull(), F.substring(text, start + 1, n)).otherwise(F.array_join(F.slice(points, start + 1, n), ""))


def _points(text: Column, spans: Column) -> Column:
    return F.when(F.size(spans) > MANY, F.split(text, ""))


def _beside(text: Column, points: Column, size: Column, start: Column, end: Column, more: int) -> Column:
    """The NEAR code points before start, with as many more ahead of them, and those from end on; a line end stands for the span and for an
    end of the text."""
    before = F.concat(F.when(start <= NEAR, "\n").otherwise(""), _cut(text, points, F.greatest(start - NEAR - more, F.lit(0)), F.least(start, F.lit(NEAR + more))))
    return F.concat(before, F.lit("\n"), _cut(text, points, end, F.lit(NEAR)), F.when(end + NEAR >= size, "\n").otherwise(""))


def _near(kind: str) -> str:
    return f"[^a-z0-9]({WORDS[kind]})s?[^a-z0-9]"


def _of_kind(text: Column, kind: str, whole: bool) -> Column:
    pattern = FAST.get(kind) or MORE[kind]
    # one code point more tells whether a word begins at the first of those that are near
    words, more = (_near(kind), 0) if whole else (f"[^a-z0-9]({WORDS[kind]})", 1)
    least = 1 if kind in BASE else LEAST

    def placed(matches: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            def with_ends(ends: Column, points: Column, size: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    end = F.get(ends, i)
                    near = F.lower(_beside(text, points, size, end - F.length(m), end, more)).rlike(words)
                    score = F.lit(SCORE[kind]) + F.when(near, BONUS[kind]).otherwise(0)
                    return F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), F.when(_valid(kind, m), score).otherwise(0).alias("score"))

                return F.filter(F.transform(matches, one), lambda s: s["score"] >= least)

            sizes = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.length(m) + F.length(g))
            return let(_ends(sizes), lambda ends: let(_points(text, matches), lambda points: let(F.length(text), lambda size: with_ends(ends, points, size))))

        return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(F.array().cast(_SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def find_pii(df: DataFrame, text: str = "text", to: str = "spans", whole: bool = True) -> DataFrame:
    """df with an array of the spans of its text. A null text counts as empty: no spans. A column of that name is replaced; other columns
    stay, nulls in them too; each repeated row has its spans; an empty table stays empty. whole: words nearby count as whole words only."""
    return df.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(to, spans(F.col("__text"), whole)).drop("__text")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of its text replaced by its kind in square brackets. Of spans that overlap, the one that starts first counts, of
    these the longest, and reaches to the last end of those that overlap it. A null or empty text stays. Longer words that begin with a
    context word count too, as a number that is missed would stay readable."""
    found = find_pii(df, text, "__spans", whole=False)

    def masked(spans: Column, reach: Column, points: Column) -> Column:
        # reach: how far the spans up to each one go; a span that starts there or later is not covered by those before it
        placed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.when(i > 0, F.get(reach, i - 1)).otherwise(0).alias("from"), s["kind"].alias("kind")))
        piece = lambda s: F.concat(_cut(F.col(text), points, s["from"], s["start"] - s["from"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        heads = F.transform(F.filter(placed, lambda s: s["start"] >= s["from"]), piece)
        return F.concat(F.array_join(heads, ""), F.substring(F.col(text), F.element_at(reach, -1) + 1, F.length(text)))

    def reaching(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: -s["back"])
        return let(_running(ends, lambda x: F.aggregate(x, F.lit(0), lambda s, y: F.greatest(s, y)), F.greatest), lambda reach: let(_points(F.col(text), spans), lambda points: masked(spans, reach, points)))

    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    return found.withColumn(text, F.when(F.size("__spans") > 0, let(ordered, reaching)).otherwise(F.col(text))).drop("__spans")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> numbers of base spans, their digest, all spans and their scores."""
    df = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return df.select(
        "doc_id",
        *(_count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when i % 2 = 1 then cast(substr({digits}, length({digits}) - i + 1, 1) as int) when cast(substr({digits}, length({digits}) - i + 1, 1) as int) > 4 then cast(substr({digits}, length({digits}) - i + 1, 1) as int) * 2 - 9 else cast(substr({digits}, length({digits}) - i + 1, 1) as int) * 2 end)) % 10 = 0"
    flat = "replace(m, ' ', '')"
    turned = f"(substr({flat}, 5) || substr({flat}, 1, 4))"
    number = f"cast(array_to_string(list_transform(string_split({turned}, ''), lambda c: case when ascii(c) >= 65 then cast(ascii(c) - 55 as varchar) else c end), '') as varchar)"
    # a number of up to 68 digits, nine at a time
    mod_sql = f"list_reduce(list_prepend(0::bigint, list_transform(string_split({number}, ''), lambda c: cast(c as bigint))), lambda s, c: (s * 10 + c) % 97) = 1"
    valid = {
        "email": "true",
        "ip": f"regexp_matches(m, '{IP_VALID}')",
        "card": f"length({digits}) between 13 and 19 and {luhn_sql}",
        "phone": f"length({digits}) between 9 and 15",
        "iban": f"length({flat}) between 15 and 34 and {mod_sql}",
        "ssn": "true",
    }
    parts = []
    for k, kind in enumerate(KINDS):
        pattern = BASE.get(kind) or MORE[kind]
        parts.append(f"""
select doc_id, {k} as k, '{kind}' as kind, gap_end as start, gap_end + length(m) as stop,
       case when {valid[kind]} then {SCORE[kind]} + case when regexp_matches(lower(near), '{_near(kind)}') then {BONUS[kind]} else 0 end else 0 end as score
from (select *, case when gap_end <= {NEAR} then chr(10) else '' end || substr(text, greatest(gap_end - {NEAR}, 0) + 1, least(gap_end, {NEAR})) || chr(10) ||
             substr(text, gap_end + length(m) + 1, {NEAR}) || case when gap_end + length(m) + {NEAR} >= length(text) then chr(10) else '' end as near
      from (select doc_id, text, unnest(ms) as m,
             unnest(list_transform(range(1, len(ms) + 1), lambda i: cast(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda q: length(q))), 0) as bigint))) as gap_end
      from (select doc_id, text, regexp_extract_all(text, '{pattern}') as ms, regexp_split_to_array(text, '{pattern}') as gs from d)))
""")
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(parts)}),
kept as (select *, kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint) as shown from found where score >= case when k < {len(BASE)} then 1 else {LEAST} end),
grouped as (
  select doc_id, {", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE)},
         string_agg(shown, ',' order by k, start) filter (where k < {len(BASE)}) as base,
         string_agg(shown, ',' order by k, start) as spans, string_agg(cast(score as varchar), ',' order by k, start) as scores
  from kept group by doc_id)
select d.doc_id, {", ".join(f"cast(coalesce(n_{k}, 0) as bigint) as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(scores, '') as scores
from d left join grouped g on g.doc_id = d.doc_id
"""


SQL = _sql()
