"""Removal of long repeated strings by a logarithmic family of suffix arrays.

A suffix array over every byte would take eight times the text, so the arrays here are sparse: suffixes begin at anchors that the text itself
chooses, the places where the hash of the next WIDTH bytes is least among all such places within a string of ``length`` bytes. Equal
strings choose the same anchor, so every string of that length belongs to exactly one anchor, and two equal ones to anchors whose suffixes
agree. An entry of the index is a suffix: the fingerprint of its first WIDTH bytes (the order of an array goes by it, which spreads the
suffixes over tasks evenly), that of the whole context in which strings of this anchor lie, and its place.

The index is a family of such arrays. A new batch gets an array, which is merge-scanned with those of all levels: one pass over their union
by fingerprints. Suffixes whose whole context is already there mark their strings in the batch, and, where a level held a context only once so
far, there. Levels of equal rank are then merged into one of the next rank. A level has one entry for each different context.

Suffixes that agree in their first WIDTH bytes but not in their context are what ends of repeats look like. Their text is fetched, and
suffix arrays over it, one of the text behind and one of the text before the anchors, with the common prefix of neighbours give for each
place whether a string of ``length`` bytes there has an equal. Where very many different contexts share one anchor (the ends of a passage that
stands in a third of all documents), they do not meet in a task; instead their strings are counted by fingerprint, summed before the shuffle,
blocks of strings first and single ones only where a block does not decide.

Defined results: texts are UTF-8 bytes, null is empty; matches never cross rows. Rows with equal ids and rows without an id are rows like all
others. Overlaps count, and strings are judged on the input. An empty table gives no rows. Texts below 2 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import _BYTE, _powers, binary_values, mix, prepare, stored, tidy

LENGTH = 400
#: Bytes worked off at a time; bits that hold a place among them.
RUN, PLACE_BITS = 2 << 20, 23
#: Batches that a table goes to the index in.
BATCHES = 4
#: Different contexts of one anchor that meet in one task, and contexts whose suffix arrays are made at once.
MEET, ABREAST = 1000, 8000
#: Distances from an anchor that are decided together where more contexts share it.
BLOCK = 16
#: A row is known by its id (that of its text where it has none) and a hash of its text; equal rows have equal results.
ROW = ["doc", "h"]
_SUFFIX = "key long, ctx long, doc long, h int, at int, lo int, hi int, n int"
_CONTEXT = "key long, n int, doc long, h int, at int, lo int, hi int, left binary, right binary"


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("doc"), F.hash(text).alias("h"), text.alias("text"))


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts as one string; for each part of it: which text, where it begins in the run, and where in its text.

    Parts of long texts overlap by length - 1 bytes, so that each string of that length lies in exactly one."""
    run, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), RUN):
            part = text[at : at + RUN + length - 1]
            if size and size + len(part) > RUN:
                yield _joined(run)
                run, size = [], 0
            run.append((k, at, part))
            size += len(part)
    if run:
        yield _joined(run)


def _joined(run):
    sizes = np.array([len(p) for _, _, p in run])
    return b"".join(p for _, _, p in run), np.array([k for k, _, _ in run]), np.cumsum(sizes) - sizes, np.array([at for _, at, _ in run])


def _sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def _window_hashes(total: np.ndarray, begin: np.ndarray, width) -> np.ndarray:
    """Mixed 64-bit hashes of the strings of width bytes that begin at those places."""
    return mix((total[begin + width] - total[begin]) * _powers(len(total))[1][begin])


def anchors(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a run: (part, anchor, first and last start of the strings that belong to it, hash at the anchor), places in the run."""
    width = length // 3
    many = length - width + 1
    total = _sums(np.frombuffer(data, np.uint8))
    n = len(data) - width + 1
    h = _window_hashes(total, np.arange(n), width)
    low = np.uint64((1 << PLACE_BITS) - 1)
    v = np.full(-(-n // many) * many, np.uint64(0xFFFFFFFFFFFFFFFF))
    v[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    # least of each window: of the rest of the block in which it begins, and of the beginning of the next one
    blocks = v.reshape(-1, many)
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    begin = np.minimum.accumulate(blocks, axis=1).ravel()
    least = (np.minimum(rest[: n - many + 1], begin[many - 1 : n]) & low).astype(np.int64)
    # starts of strings that do not cross the end of their part
    ends = np.append(starts[1:], len(data))
    part = np.repeat(np.arange(len(starts)), ends - starts)[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + length <= ends[part])
    at, part = least[inside], part[inside]
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    last = np.append(first[1:], len(at)) - 1
    return part[first], at[first], inside[first], inside[last], h[at[first]]


def _merged(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [lo, hi] of each of, those that touch made one; within one of they do not nest."""
    order = np.lexsort((lo, of))
    of, lo, hi = of[order], lo[order], hi[order]
    first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (lo > np.append(-2, hi[:-1]) + 1))
    return of[first], lo[first], np.maximum.reduceat(hi, first) if len(first) else hi


def suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Entries of docs' suffix array, n: 1 or, where a run of texts holds the context several times, 2. Those that it holds several times
    are marked there: rows without a key, with the first and last start of strings (lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), binary_values(batch.column(2))
            for data, of, begin, offset in _pieces(texts, length):
                part, at, lo, hi, key = anchors(data, begin, length)
                digest = hashlib.blake2b
                ctx = np.frombuffer(b"".join([digest(data[x : y + length], digest_size=8, salt=(a - x).to_bytes(4, "little")).digest() for a, x, y in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)]), "<i8")
                shift = offset[part] - begin[part]
                _, first, which, n = np.unique(ctx ^ key.view(np.int64), return_index=True, return_inverse=True, return_counts=True)
                again = n[which] > 1
                text, m_lo, m_hi = _merged(of[part[again]], (lo + shift)[again], (hi + shift)[again])
                one = of[part[first]]
                columns = [key.view(np.int64)[first], ctx[first], doc[one], h[one], (at + shift)[first], (lo + shift)[first], (hi + shift)[first], np.minimum(n, 2)]
                marks = [None, None, doc[text], h[text], None, m_lo, m_hi, np.full(len(text), 2)]
                kinds = [pa.int64()] * 3 + [pa.int32()] * 5
                names = [x.split()[0] for x in _SUFFIX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(text), k) if x is None else pa.array(x, k) for x, k in zip(marks, kinds, strict=True)], names=names)

    return docs.select(*ROW, "text").mapInArrow(tidy(run), _SUFFIX)


class SuffixIndex:
    """Levels of suffix arrays, each twice as many batches as the one before; ``marks`` has the found ranges of starts of repeated strings."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length, self.levels, self.marks = length, [], []

    def add(self, docs: DataFrame) -> None:
        """Make the suffix array of a batch (columns as numbered() gives), merge-scan it with all levels, and put it in."""
        entries = stored(suffixes(docs, self.length), "suffixes")
        place = F.struct(*ROW, "at", "lo", "hi")
        array = stored(_array(entries.where("key IS NOT NULL").select("key", "ctx", "n", place.alias("place"))), "level")
        both = array.select("*", F.lit(False).alias("old"))
        for _, level in self.levels:
            both = both.unionByName(level.select("*", F.lit(True).alias("old")))
        old, new = (F.coalesce(F.sum(F.when(F.col("old") == x, F.col("n"))), F.lit(0)) for x in (True, False))
        found = both.groupBy("key", "ctx").agg(old.alias("n_old"), new.alias("n_new"), F.min(F.when(F.col("old"), F.col("place"))).alias("place"))
        found = stored(found.where("n_new > 0 AND n_old + n_new > 1"), "matches")
        self.marks += [
            entries.where("key IS NULL").select(*ROW, "lo", "hi"),
            entries.where("key IS NOT NULL AND n = 1").join(found.select("key", "ctx"), ["key", "ctx"], "left_semi").select(*ROW, "lo", "hi"),
            found.where("n_old = 1").select("place.doc", "place.h", "place.lo", "place.hi"),
        ]
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            array, rank = stored(_array(array.unionByName(self.levels.pop()[1])), "level"), rank + 1
        self.levels.append((rank, array))

    def ends(self, docs: DataFrame) -> DataFrame:
        """Ranges of starts in contexts that stand in the index once, but share an anchor with others. docs: all that the index holds."""
        whole = self.levels[0][1]
        for _, level in self.levels[1:]:
            whole = whole.unionByName(level)
        whole = stored(_array(whole), "index") if len(self.levels) > 1 else whole
        shared = whole.groupBy("key").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 AND least = 1")
        wanted = whole.join(shared, "key").select(F.col("place.doc").alias("doc"), F.col("place.h").alias("h"), F.struct("key", "n", "place.at", "place.lo", "place.hi", "contexts").alias("x"))
        # the suffixes of a document: as many as its text has anchors
        texts = wanted.groupBy(*ROW).agg(F.collect_list("x").alias("x")).join(docs.select(*ROW, "text"), ROW)
        contexts = stored(_contexts(texts, self.length), "contexts")
        few, many = contexts.where(F.col("contexts") <= MEET), contexts.where(F.col("contexts") > MEET)
        return _by_suffix_arrays(few.drop("contexts"), self.length).unionByName(_by_counts(many, self.length))


def _array(entries: DataFrame) -> DataFrame:
    """A suffix array: each different context once, with the first of its places, in the order of fingerprints."""
    one = entries.groupBy("key", "ctx").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.min("place").alias("place"))
    return one.sortWithinPartitions("key", "ctx")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """For each wanted suffix: up to length bytes from its anchor on, and, backwards, those before it in which its strings begin."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(binary_values(batch.column("text"))):
                x = batch.column("x")[k].as_py()
                doc, h = batch.column("doc")[k].as_py(), batch.column("h")[k].as_py()
                columns = [[e[c] for e in x] for c in ("key", "n")] + [[doc] * len(x), [h] * len(x)] + [[e[c] for e in x] for c in ("at", "lo", "hi")]
                columns += [[text[e["lo"] : e["at"]][::-1] for e in x], [text[e["at"] : e["hi"] + length] for e in x], [e["contexts"] for e in x]]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
                for at in range(0, len(x), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 2000], t) for c, t in zip(columns, kinds, strict=True)], names=[*names, "contexts"])

    return texts.select(*ROW, "x", "text").mapInArrow(tidy(run), f"{_CONTEXT}, contexts long")


def _sorted_with_lcp(group: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then text; and how many bytes each shares with the one before it, -1 for the first of a group."""
    held = np.array(texts, f"S{max(1, width)}")
    size = np.array([len(x) for x in texts])
    order = np.lexsort((size, held, group))  # a text that another one continues with zero bytes stands before it
    rows, size = held.view(np.uint8).reshape(len(texts), -1)[order], size[order]
    same = rows[1:] == rows[:-1]
    shared = np.where(same.all(1), rows.shape[1], same.argmin(1))
    lcp = np.append(-1, np.minimum(shared, np.minimum(size[1:], size[:-1])))
    lcp[np.flatnonzero(np.diff(group[order], prepend=-1))] = -1
    return order, lcp


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """For each context and each distance s of a start before its anchor: whether another context of the group has an equal string there.

    lo, hi: the first and last start, relative to the anchor (not positive or, for hi, behind it never). Two suffix arrays, of
    the text from the anchors on and of the text before them backwards, give for each s the classes of equal right and left parts."""
    m, most = len(group), int((-lo).max(initial=0))
    by_right, lcp = _sorted_with_lcp(group, right, length)
    by_left, lcs = _sorted_with_lcp(group, left, most)
    out = np.zeros((m, most + 1), bool)
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for s in range(most + 1):
        right_class[by_right] = np.cumsum(lcp < length - s)
        left_class[by_left] = np.cumsum(lcs < s)
        here = np.flatnonzero((lo <= -s) & (hi >= -s))
        both = right_class[here] * (m + 1) + left_class[here]
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        out[here[order[1:][same]], s] = out[here[order[:-1][same]], s] = True
    return out


def _by_suffix_arrays(contexts: DataFrame, length: int) -> DataFrame:
    schema = "doc long, h int, lo int, hi int"

    def solved(rows: pa.Table) -> pa.RecordBatch:
        key, n, doc, h, at, lo, hi = (rows.column(k).to_numpy() for k in range(7))
        hit = repeated_starts(np.unique(key, return_inverse=True)[1], binary_values(rows.column(7).combine_chunks()), binary_values(rows.column(8).combine_chunks()), lo - at, hi - at, length)
        hit &= (n == 1)[:, None]
        edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
        (of, first), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pa.record_batch([pa.array(doc[of]), pa.array(h[of]), pa.array((at[of] - end + 1).astype(np.int32)), pa.array((at[of] - first).astype(np.int32))], names=["doc", "h", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            if held.num_rows >= ABREAST:  # all but the last key are complete
                key = held.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield solved(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solved(held)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), schema)


def _by_counts(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: their strings are counted by key, distance from the anchor and fingerprint.

    Distances go in blocks: all strings of a block share its core. Contexts with the same bytes under all their strings of a block are a class;
    where a class has several contexts, all of these strings have equals, and where a core is that of one class alone, no others
    do. Only classes that differ over one core (a repeat begins or ends there) are taken apart into single strings, each class once."""
    block = min(BLOCK, max(1, length // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, doc, h, at, lo, hi = (batch.column(k).to_numpy() for k in range(7))
            left, right = binary_values(batch.column(7)), binary_values(batch.column(8))
            parts = []
            for k in range(batch.num_rows):
                total = _sums(np.frombuffer(left[k][::-1] + right[k], np.uint8))
                near, far = int(at[k] - hi[k]), int(at[k] - lo[k])
                number = np.arange(near // block, far // block + 1)
                first, last = np.maximum(number * block, near), np.minimum(number * block + block - 1, far)
                core = _window_hashes(total, far - number * block, length - block + 1)
                parts.append((np.full(len(number), k), number, first, last, core, _window_hashes(total, far - last, length + last - first), _window_hashes(total, far - np.arange(near, far + 1), length)))
            if parts:
                of, number, first, last, core, whole, each = (np.concatenate(x) for x in zip(*parts, strict=True))
                each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(last - first + 1)), pa.int32()), pa.array(each.view(np.int64)))
                columns = [key[of], number, core.view(np.int64), first, last, whole.view(np.int64), each, n[of], doc[of], h[of], at[of]]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), None, pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.record_batch([x if t is None else pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["key", "block", "core", "first", "last", "whole", "each", "n", *ROW, "at"])

    schema = "key long, block int, core long, first int, last int, whole long, each array<long>, n int, doc long, h int, at int"
    blocks = stored(contexts.drop("contexts").mapInArrow(tidy(run), schema), "blocks")
    core = ["key", "block", "core"]
    same = [*core, "first", "last", "whole"]
    # what is asked of a class of one context is asked of its place
    classes = stored(blocks.groupBy(*same).agg(F.sum("n").alias("n"), F.first("each").alias("each"), F.first(F.struct(*ROW, "at")).alias("place")), "classes")
    covered = blocks.where("n = 1").join(classes.where("n > 1").select(*same), same, "left_semi").select(*ROW, F.expr("at - last").alias("lo"), F.expr("at - first").alias("hi"))
    unlike = classes.groupBy(*core).agg(F.count("*").alias("classes")).where("classes > 1").select(*core)
    strings = classes.join(unlike, core, "left_semi").select("key", "n", "place", "first", F.posexplode("each").alias("s", "x")).withColumn("s", F.col("first") + F.col("s"))
    strings = stored(strings.drop("first"), "strings")
    again = strings.groupBy("key", "s", "x").agg(F.sum("n").alias("n")).where("n > 1").select("key", "s", "x")
    start = F.col("place.at") - F.col("s")
    return covered.unionByName(strings.where("n = 1").join(again, ["key", "s", "x"], "left_semi").select("place.doc", "place.h", start.alias("lo"), start.alias("hi")))


def without_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Per row: its id, n_bytes, spans (begin, end of the removed runs of bytes, in order) and kept (the remaining bytes)."""
    spark = df.sparkSession
    prepare(spark)
    docs, index = numbered(df, id_col, text_col), SuffixIndex(length)
    for k in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64(*ROW), F.lit(batches)) == k))
    marks = index.ends(docs)
    for found in index.marks:
        marks = marks.unionByName(found)
    # as many as a document has anchors
    marks = marks.groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out, spans, sizes = [], [], []
            for text, found in zip(binary_values(batch.column("text")), batch.column("marks"), strict=True):
                runs = []
                if found.is_valid:
                    lo, hi = (found.values.field(k).to_numpy().astype(np.int64) for k in range(2))
                    order = np.argsort(lo, kind="stable")
                    lo, end = lo[order], np.maximum.accumulate(hi[order]) + length
                    first = np.flatnonzero(lo > np.append(-1, end[:-1]))
                    runs = list(zip(lo[first].tolist(), end[np.append(first[1:], len(lo)) - 1].tolist(), strict=True))
                edges = [0, *(x for r in runs for x in r), len(text)]
                out.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"begin": a, "end": b} for a, b in runs])
                sizes.append(len(text))
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(out, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    joined = docs.join(marks, ROW, "left").select("id", "text", "marks")
    return joined.mapInArrow(tidy(run), f"`{id_col}` long, n_bytes long, spans array<struct<begin: int, end: int>>, kept binary")


def repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without strings of 400 bytes that stand anywhere else."""
    done = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
