"""Hard negatives by exact integer scores: matrix products modulo small primes, Chinese remaindering, selection by windows.

Vectors become integers, floor(scale * x). The score of two rows is their integer inner product, far beyond what a float32 product
holds exactly; so both matrices are taken modulo several small primes, with residues around zero, multiplied in float32 without any
rounding (a sum of at most WIDTH products stays below 2**24), and the scores are put together from their residues (mixed-radix digits
around zero, in int64). How many primes that takes follows from the largest component of the data.

Every DIVISOR-th row is an anchor. Anchors are worked off in blocks of about BLOCK rows, a stated query set against all rows: a block is
broadcast (its size is bounded, whatever the table's), each task runs over its rows of the table in batches and keeps the best of each
anchor, and a window takes the best of all tasks. Nothing but those leaves a task.

Defined results: rows without an id, label or vector, or with a null or non-finite component take no part. Vectors of different lengths
count as filled up with zeros. Of several anchors of one id the one with the largest label, then vector, counts; other rows of one id
stand for themselves, but never for or against an anchor of the same id. Scores beyond 63 bits raise ValueError. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import batches_of, prepare, stored, tidy

#: Components in one float32 product; with residues below HALF its sums stay below 2**24.
WIDTH, HALF = 256, 255
#: Rows of a table's batch, anchors in one broadcast block, and anchors in one product.
ROWS, BLOCK, ABREAST = 4096, 8192, 256
DIVISOR, POSITIVES, NEGATIVES, LEAST, MOST = 100, 5, 10, 30, 90
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def primes(bound: int) -> list[int]:
    """The largest primes up to 2 * HALF + 1 whose product is above twice bound, so that residues tell all integers within bound apart."""
    out, product = [], 1
    for p in range(2 * HALF + 1, 2, -2):
        if all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
            if product > 2 * bound + 1:
                return out
    raise ValueError(f"scores up to {bound} do not fit")


def around_zero(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p, from -(p - 1) / 2 to (p - 1) / 2."""
    return (x + p // 2) % p - p // 2


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """The component matrices of an integer matrix, one float32 matrix for each prime."""
    return [around_zero(x, p).astype(np.float32) for p in moduli]


def exact_scores(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """All inner products of the rows of a and b, given by their residues, as int64."""
    out, digits, scale = None, [], 1
    for k, p in enumerate(moduli):
        r = np.zeros((a[k].shape[0], b[k].shape[0]), np.int32)
        for at in range(0, a[k].shape[1], WIDTH):
            r += around_zero((a[k][:, at : at + WIDTH] @ b[k][:, at : at + WIDTH].T).astype(np.int32), p)
        # the next digit: what is left of the residue once the digits so far are taken off, over the primes so far
        for q, d in zip(moduli[:k], digits, strict=True):
            r = around_zero((r - d) * np.int32(pow(q, -1, p)), p)
        digits.append(r := around_zero(r, p))
        out = r.astype(np.int64) if out is None else out + r.astype(np.int64) * np.int64((scale + (1 << 63)) % (1 << 64) - (1 << 63))
        scale *= p
    return out


class Best:
    """The k best (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: What a newcomer has to beat; before a slot is full, anything does.
        self.low, self.high_id = np.full(slots, np.iinfo(np.int64).min), np.full(slots, np.iinfo(np.int64).max)

    def beats(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> np.ndarray:
        low = self.low[slot]
        return (score > low) | ((score == low) & (id_ <= self.high_id[slot]))

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, id_ = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(first, append=len(slot)))
        order, slot, last = order[place < self.k], slot[place < self.k], place[place < self.k] == self.k - 1
        self.slot, self.score, self.id = slot, score[order], id_[order]
        self.low[slot[last]], self.high_id[slot[last]] = self.score[last], self.id[last]

    def batch(self, names: list[str], key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key[self.slot]), pa.array(self.slot), pa.array(self.id), pa.array(self.score)], names=names)


def usable(df: DataFrame, id_col: str, vector_col: str, label: F.Column, scale: float) -> DataFrame:
    """Rows that take part: vec_id, label and q, the vector as integers."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("v")).dropna()
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrow lists as rows of a matrix, filled up with zeros."""
    out, n = np.zeros((len(column), width), np.int64), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _scan(rows: DataFrame, anchors: dict, width: int, slots: int, k: int, names: list[str], wanted) -> DataFrame:
    """Each task's best rows of all slots. wanted: yields (slots, scores, ids) of what may be among the best of a batch."""
    schema = ", ".join(f"{x} long" for x in names)
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, best = sent.value, Best(slots, k)
        for b in batches:
            ids, labels = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            q = _matrix(b.column(2), width)
            for slot, score, id_ in wanted(a, ids, labels, q, best):
                best.add(slot, score, id_)
        yield best.batch(names, np.repeat(a["vec_id"], slots // max(1, len(a["vec_id"]))))

    with batches_of(rows.sparkSession, ROWS):
        return stored(rows.mapInArrow(tidy(run), schema), names[0])


def _same_label(moduli: list[int]):
    """Rows of the anchor's label, label by label."""

    def wanted(a, ids, labels, q, best):
        for label in np.intersect1d(a["label"], labels):
            of, rows = np.flatnonzero(a["label"] == label), np.flatnonzero(labels == label)
            right = residues(q[rows], moduli)
            for at in range(0, len(of), ABREAST):
                some = of[at : at + ABREAST]
                s = exact_scores(residues(a["q"][some], moduli), right, moduli)
                fit = (s >= best.low[some][:, None]) & (a["vec_id"][some][:, None] != ids[rows])
                i, j = np.nonzero(fit)
                yield some[i], s[i, j], ids[rows[j]]

    return wanted


def _in_window(moduli: list[int], positives: int, least: int, most: int):
    """Rows of other labels whose score lies in the window of one of the anchor's positives; a slot is an anchor and a positive's place."""

    def wanted(a, ids, labels, q, best):
        right = residues(q, moduli)
        for at in range(0, len(a["vec_id"]), ABREAST):
            some = np.arange(at, min(at + ABREAST, len(a["vec_id"])))
            s = exact_scores(residues(a["q"][some], moduli), right, moduli)
            other = (a["label"][some][:, None] != labels) & (a["vec_id"][some][:, None] != ids)
            for place in range(positives):
                slot, top = some * positives + place, a["high"][some, place]
                low = np.maximum(best.low[slot], a["low"][some, place])
                i, j = np.nonzero((s >= low[:, None]) & (s <= top[:, None]) & other)
                keep = best.beats(slot[i], s[i, j], ids[j])
                yield slot[i][keep], s[i, j][keep], ids[j][keep]

    return wanted


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: F.Column | str = "label", scale: float = 256, divisor: int = DIVISOR,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block: int = BLOCK,
) -> DataFrame:
    """For every row whose id divides by divisor and each of its best ``positives`` rows of the same label: the best ``negatives`` rows of other
    labels that score from least to most percent of the positive. Columns as RESULT."""
    spark = df.sparkSession
    prepare(spark)
    rows = usable(df, id_col, vector_col, F.col(label) if isinstance(label, str) else label, scale)
    chosen = rows.where(F.col("vec_id") % divisor == 0)
    size = rows.agg(F.max(F.size("q")).alias("width"), F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))).alias("most")).first()
    width, bound = size.width or 1, (size.width or 1) * (size.most or 0) ** 2
    if bound >= 1 << 63:
        raise ValueError(f"scores up to {bound} do not fit into 63 bits")
    moduli, out = primes(bound), []
    blocks = max(1, math.ceil(chosen.count() / block))
    for k in range(blocks):
        # about ``block`` rows, by their hash
        some = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).groupBy("vec_id").agg(F.max(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q").toArrow().combine_chunks()
        if some.num_rows:
            out.append(_of_block(spark, rows, some, moduli, width, positives, negatives, least, most))
    if not out:
        return spark.createDataFrame([], RESULT)
    made = out[0]
    for x in out[1:]:
        made = made.unionByName(x)
    return made


def _of_block(spark, rows, some, moduli, width, positives, negatives, least, most) -> DataFrame:
    anchors = {"vec_id": some.column("vec_id").to_numpy(), "label": some.column("label").to_numpy(), "q": _matrix(some.column("q").combine_chunks(), width)}
    n = len(anchors["vec_id"])
    near = _scan(rows, anchors, width, n, positives, ["anchor_id", "slot", "positive_id", "positive_score"], _same_label(moduli))
    first = Window.partitionBy("slot").orderBy(F.col("positive_score").desc(), "positive_id")
    near = near.withColumn("place", F.row_number().over(first) - 1).where(F.col("place") < positives)
    # a few rows for each anchor of the block
    held = near.select("slot", "place", "positive_score").toArrow()
    at, place, score = (held.column(k).to_numpy() for k in range(3))
    anchors["low"], anchors["high"] = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)  # no window where there is no positive
    # the whole numbers s with least * p <= 100 * s <= most * p, without products that overflow
    anchors["low"][at, place] = [-(-least * int(x) // 100) for x in score]
    anchors["high"][at, place] = [most * int(x) // 100 for x in score]
    far = _scan(rows, anchors, width, n * positives, negatives, ["anchor_id", "slot", "negative_id", "negative_score"], _in_window(moduli, positives, least, most))
    last = Window.partitionBy("slot").orderBy(F.col("negative_score").desc(), "negative_id")
    far = far.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives).drop("anchor_id")
    return near.withColumn("slot", F.col("slot") * positives + F.col("place")).join(far, "slot").select(*(x.split()[0] for x in RESULT.split(", ")))


def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with the labels of every seventh id moved on by one: five positives of each anchor, ten negatives of each positive."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
near AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
    SELECT near.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY near.anchor_id, positive_id ORDER BY score DESC, scored.vec_id) AS INTEGER) AS rank,
        scored.vec_id AS negative_id, positive_score, score AS negative_score
    FROM near JOIN scored ON near.anchor_id = scored.anchor_id
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM ranked WHERE rank <= 10
"""
