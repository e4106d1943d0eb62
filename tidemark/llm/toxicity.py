"""Toxicity as an ordinal grade: a cumulative-link regression over the words of a text.

One weight a word, shared by all thresholds: P(grade <= k) = logistic(threshold[k] - sum of weights). The expected severity is the sum
of P(grade > k). It is fitted on a bounded sample of labelled rows, the rows with the smallest hashes of their ids; every text is scored.

One rule counts: a text is toxic if its expected severity reaches the fitted cut. Its grade is 0 below the cut and the likeliest of the
grades above 0 from it on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import NOT_LETTERS, binary_values, prepare, release, stored, tidy, word_hashes

#: Labelled rows that a fit sees at most, and different words (8 bytes each) in all of these. They reach the driver as word hashes.
SAMPLE, SAMPLE_WORDS = 20_000, 10_000_000
#: Texts that are scored at a time.
ROWS = 512


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades
    cut: float  # rejects from this expected severity on

    def scores(self, row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.weights[column], n) if len(row) else np.zeros(n)

    def severity(self, scores: np.ndarray) -> np.ndarray:
        return np.round(_logistic(scores[:, None] - self.thresholds[None, :]).sum(1), 6)

    def judged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Severity and grade of each text."""
        out = []
        for at in range(0, len(texts), ROWS):
            part = binary_values(texts.slice(at, ROWS))
            s = self.scores(*features(part, self.words), len(part))
            below = np.concatenate([_logistic(self.thresholds[None, :] - s[:, None]), np.ones((len(s), 1))], 1)
            severity = self.severity(s)
            out.append((severity, np.where(severity >= self.cut, 1 + np.diff(below, axis=1).argmax(1), 0)))
        return np.concatenate([np.zeros(0), *(x[0] for x in out)]), np.concatenate([np.zeros(0, np.int64), *(x[1] for x in out)])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(texts: list[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in words) of each different word of each text that is in words."""
    h, starts = word_hashes(texts, parting=NOT_LETTERS)
    place = np.searchsorted(words, h)
    place[place == len(words)] = 0
    hit = words[place] == h if len(words) else np.zeros(len(h), bool)
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    both = np.unique(of[hit] * max(len(words), 1) + place[hit])
    return both // max(len(words), 1), both % max(len(words), 1)


def labelled(docs: DataFrame, labels: DataFrame, label, sample: int, id_col: str, text_col: str, words: int = SAMPLE_WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Word hashes and labels of the sample; rows without an id or a label are left out, of several labels of one id the largest counts.
    The sample ends where its texts would have more than ``words`` different words in all."""
    few = labels.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("grade")).where("id is not null and grade is not null")
    few = few.groupBy("id").agg(F.max("grade").alias("grade")).withColumn("at", F.xxhash64("id")).orderBy("at", "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id").select("at", "id", "grade", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, starts = word_hashes(binary_values(b.column(3)), parting=NOT_LETTERS)
            found = [np.unique(h[x:y]) for x, y in zip(starts, starts[1:])]
            data = [pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *data], names=["at", "id", "grade", "n", "words"])

    held = stored(rows.mapInArrow(tidy(hashed), "at long, id long, grade int, n long, words binary"), "labelled")
    sizes = sorted(tuple(r) for r in held.select("at", "id", "n").collect())
    over = np.flatnonzero(np.cumsum([n for _, _, n in sizes]) > words)
    if len(over):
        at, doc, _ = sizes[over[0]]
        held = held.where((F.col("at") < at) | ((F.col("at") == at) & (F.col("id") < doc)))
    got = held.select("id", "grade", "words").toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("words")], got.column("grade").to_numpy().astype(np.int64)


def _counted(texts: list[np.ndarray], run: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The different words and how many texts have each; a run of texts at a time, so that the driver holds little beside the sample."""
    words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(texts), run):
        more, m = np.unique(np.concatenate(texts[at : at + run]), return_counts=True)
        both, back = np.unique(np.concatenate([words, more]), return_inverse=True)
        words, n = both, np.bincount(back, np.concatenate([n, m]), len(both)).astype(np.int64)
    return words, n


def _telling(texts: list[np.ndarray], toxic: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words whose share of texts differs between toxic texts and others, and for each how many times larger it is in toxic ones."""
    words, n = _counted(texts)
    inside, k = _counted([t for t, x in zip(texts, toxic, strict=True) if x])
    bad = np.zeros(len(words))
    bad[np.searchsorted(words, inside)] = k
    share, every = toxic.mean(), len(texts)
    expected = n * share
    chi = (bad - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - n / every), 1e-9)
    times = ((bad + 0.5) / toxic.sum()) / ((n - bad + 0.5) / max(1, (~toxic).sum()))
    keep = (n >= least) & (chi >= 6.6)
    return words[keep], times[keep]


def graded(texts: list[np.ndarray], toxic: np.ndarray, times: float = 8.0, least: int = 3) -> np.ndarray:
    """Grades 0 to 3 for texts of which labels only say whether they are toxic: 0 if not; else by how many different words the text has
    that are at least ``times`` as common in toxic texts as in others, 1 to 3 by thirds of the toxic texts (ties go to the lower grade)."""
    grades = np.zeros(len(texts), np.int64)
    if not toxic.any() or toxic.all():
        return np.where(toxic, 1, 0)
    words, more = _telling(texts, toxic, least)
    words = words[more >= times]
    found = np.array([np.isin(t, words, assume_unique=True).sum() for t, x in zip(texts, toxic, strict=True) if x])
    limits = np.sort(found)[[len(found) // 3, 2 * len(found) // 3]]
    grades[toxic] = 1 + (found > limits[0]) + (found > limits[1])
    return grades


def fit(texts: list[np.ndarray], grades: np.ndarray, least: int = 3, rounds: int = 100, decay: float = 1.0, seed: int = 1, held_back: int = 5) -> Model:
    """Fit on sets of word hashes; words of fewer than least texts, or whose share does not differ
    between grades above 0 and grade 0 (chi-square below 6.6), are left out. One text in held_back (0: none) is held back: of the rounds (limited
    memory BFGS steps), the one with the best likelihood there counts, and the cut is the severity that gives the best F1 there for
    grades above 0.

    Without texts, or with one grade only, the model rejects nothing.
    """
    levels = int(grades.max(initial=0))
    if len(texts) == 0 or levels == 0 or len(set(grades.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([20.0]), float("inf"))
    train = np.random.default_rng(seed).permutation(len(texts)) % held_back > 0 if held_back else np.ones(len(texts), bool)
    words = _telling([texts[i] for i in np.flatnonzero(train)], grades[train] > 0, least)[0]
    words = np.append(words, np.uint64(2**64 - 1))  # the last one stands for whatever is not among them
    place = [p[words[p] == t].astype(np.int32) for t in texts for p in (np.searchsorted(words, t),)]
    row, column = np.repeat(np.arange(len(texts)), [len(p) for p in place]), np.concatenate(place).astype(np.int64)
    inside = train[row]
    r, c = row[inside], column[inside]
    n, at, count = len(texts), np.arange(len(texts)), int(train.sum())
    share = np.array([np.clip((grades[train] <= i).mean(), 1e-4, 1 - 1e-4) for i in range(levels)])
    start = np.log(share / (1 - share))

    def ordered(free: np.ndarray) -> np.ndarray:
        # a first threshold and positive gaps
        return free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray, float]:
        weights, free = x[:-levels], x[-levels:]
        score, thresholds = np.bincount(row, weights[column], n), ordered(free)
        below = np.concatenate([np.zeros((n, 1)), _logistic(thresholds[None, :] - score[:, None]), np.ones((n, 1))], 1)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        slope = below * (1 - below)
        up, down = slope[at, grades + 1] / p, slope[at, grades] / p
        by_threshold = np.array([np.sum((down * (grades == i + 1) - up * (grades == i))[train]) for i in range(levels)])
        by_free = np.array([np.exp(free[j] if j else 0) * by_threshold[j:].sum() for j in range(levels)])
        by_weight = np.bincount(c, (up - down)[r], len(words)) + decay * weights
        value = -np.log(p[train]).sum() + decay / 2 * (weights @ weights)
        return value / count, np.concatenate([by_weight, by_free]) / count, float(-np.log(p[~train] if (~train).any() else p).mean())

    x = np.concatenate([np.zeros(len(words)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    value, slope, held = loss(x)
    best, kept, idle, steps, turns = held, x, 0, [], []
    for _ in range(rounds):
        d, parts = slope.copy(), []
        for s, y in zip(reversed(steps), reversed(turns), strict=True):
            parts.append((s @ d) / (s @ y))
            d -= parts[-1] * y
        if steps:
            d *= (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
        for s, y, part in zip(steps, turns, reversed(parts), strict=True):
            d += (part - (y @ d) / (s @ y)) * s
        size = 1.0 if steps else 1 / max(1e-12, np.abs(slope).sum())
        for _ in range(20):
            new = loss(x - size * d)
            if new[0] <= value - 1e-4 * size * (slope @ d):
                break
            size /= 2
        else:
            break
        moved, turned = -size * d, new[1] - slope
        if moved @ turned > 1e-12:
            steps, turns = [*steps, moved][-8:], [*turns, turned][-8:]
        x, value, slope, held = x + moved, *new
        if held < best:
            best, kept, idle = held, x, 0
        else:
            idle += 1
            if idle >= 15:
                break
    kept = kept[:-levels], ordered(kept[-levels:])
    model = Model(words, kept[0], kept[1], 0.5)
    severity = model.severity(np.bincount(row, kept[0][column], n))
    test = ~train if ((grades > 0) & ~train).sum() >= 20 else np.ones(n, bool)
    order = np.argsort(-severity[test], kind="stable")
    true, values = (grades[test] > 0)[order].cumsum(), severity[test][order]
    f1 = 2 * true / (np.arange(1, len(true) + 1) + (grades[test] > 0).sum())
    i = int(np.argmax(f1))
    model.cut = float((values[i] + (values[i + 1] if i + 1 < len(values) else 0)) / 2)
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, rounded to 6 places), grade, toxic (severity reaches the model's cut; then, and only then, the grade
    is above 0).

    A null text counts as empty; an empty text has the severity of no words. A null id stays null. Repeated rows each give a row.
    """
    spark = df.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            severity, grade = sent.value.judged(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity), pa.array(grade.astype(np.int32)), pa.array(grade > 0)], names=["doc_id", "severity", "grade", "toxic"])

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, severity double, grade int, toxic boolean")


def without_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df without the rows whose severity reaches the model's cut; all columns stay as they are, and only the text passes Python. A null
    text counts as empty."""
    spark = df.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(batches):
            for b in batches:
                yield pa.array(sent.value.judged(b)[1] > 0)

        yield from tidy(run)(texts)

    return df.where(~toxic(F.col(text_col).cast("string")))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str, sample: int = SAMPLE) -> Model:
    prepare(spark)
    texts, toxic = labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("toxic"), sample, "doc_id", "text")
    try:
        return fit(texts, graded(texts, toxic > 0))
    finally:
        release()


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, trained(spark, docs, sf_dir))
