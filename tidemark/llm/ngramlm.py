"""Stupid-backoff language-model scores of documents against the n-gram counts of the whole corpus.

Documents are put into blocks, written once as a table (block, docs). From it come the n-grams of each block, a row for each block and
bucket of hashes with the different n-grams there and how often each occurs: a frequent n-gram is one entry a block, not one a document,
and no bucket is heavier than others. Grouped by bucket these are summed to counts, and each block is told what stands elsewhere.
Grouped by block, what it was told joins the table of blocks, and scores are summed per document.

A row holds many n-grams in columns of its own (hashes as compressed differences): as single rows of (hash, block, count) the n-grams of
order 3 take more than twice as much of shuffle and disk.

A document is scored against all others: its own occurrences are taken off each count. With c the counts left, N the words left, a word
w behind the words h has c(h w) / c(h) if c(h w) > 0, else 0.4 times the score of w behind h without its first word; down
to c(w) / N for a word alone, and 0.4 / N for one that occurs nowhere else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import binary_values, mix, prepare, stored, text_bytes, tidy, word_hashes

BACKOFF = 0.4
#: N-grams (with repeats) that a bucket has on average.
BUCKET = 2_000_000
#: Bytes of text in a block, but for a longer single text; words of history and the word itself.
BLOCK_BYTES = 4 << 20
ORDER = 3
#: N-grams are counted in so many passes, each over a part of the buckets, so that disk holds the n-grams of one part at a time.
PASSES = 2


def _pack(x: np.ndarray) -> bytes:
    """Integers as compressed columns of their bytes."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = pa.decompress(data, n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, n).T).view(kind).ravel()


def grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For k = 1 .. order: hash of the k words that end at each word, and whether the text has so many there; where each text begins."""
    words, starts = word_hashes(texts)
    within = np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))
    hashes, there, h = [], [], np.zeros(len(words), np.uint64)
    for k in range(order):
        h = mix(words + np.uint64(k)) if k == 0 else mix(np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + mix(words + np.uint64(k)))
        hashes.append(h)
        there.append(within >= k)
    return hashes, there, starts


def distinct(hashes: list[np.ndarray], there: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a block in hash order, and how often each occurs."""
    return np.unique(np.concatenate([h[t] for h, t in zip(hashes, there, strict=True)]), return_counts=True)


def _bucket_limits(keys: np.ndarray, buckets: int) -> np.ndarray:
    limits = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


def score_texts(texts: list[bytes], order: int, keys: np.ndarray, totals: np.ndarray, n_all: int) -> list[tuple[int, float, int]]:
    """Per text: words, sum of natural logarithms of the scores, words that backed off."""
    hashes, there, starts = grams(texts, order)
    n = len(hashes[0])
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    place = [np.searchsorted(keys, h) for h in hashes]
    left = []
    for p, t in zip(place, there, strict=True):
        # occurrences in the text itself, by (text, n-gram)
        own = np.zeros(n, np.int64)
        both = of[t] * (len(keys) + 1) + p[t]
        _, back, count = np.unique(both, return_inverse=True, return_counts=True)
        own[t] = count[back]
        c = np.zeros(n, np.int64)
        c[t] = totals[p[t]] - own[t]
        left.append(c)
    words = np.diff(starts)
    others = np.maximum(n_all - words[of], 1).astype(float)
    score = np.where(left[0] > 0, left[0], BACKOFF) / others
    backed = left[0] <= 0
    for k in range(1, order):
        # what is left of the words before, as the text itself counts them
        before = np.concatenate([[0], left[k - 1][:-1]])
        seen = there[k] & (left[k] > 0) & (before > 0)
        score = np.where(seen, left[k] / np.maximum(before, 1), np.where(there[k], BACKOFF * score, score))
        backed = np.where(there[k], ~seen, backed)
    sums = np.bincount(of, np.log(score), len(texts)).astype(float)  # of no words at all, bincount makes integers
    return list(zip(words.tolist(), sums.tolist(), np.bincount(of, backed, len(texts)).astype(int).tolist(), strict=True))


def blocks(df: DataFrame) -> DataFrame:
    """Rows (block, docs) of a DataFrame of ids and texts: a number and an Arrow stream of a few MB of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum([len(x) for x in binary_values(b.column(1))]) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(b.slice(x, y - x))
                    # written once: who reads it later finds the same number
                    yield pa.RecordBatch.from_arrays([pa.array([uuid4().int >> 65]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

    return df.mapInArrow(tidy(run), "block long, docs binary")


def _docs(data: bytes) -> tuple[pa.Array, list[bytes]]:
    table = pa.ipc.open_stream(data).read_all()
    return table.column(0).combine_chunks(), binary_values(table.column(1))


def asked(rows: DataFrame, order: int, buckets: int, part: int = 0, parts: int = 1) -> DataFrame:
    """For each block and each parts-th bucket: the different n-grams (n of them), how often each occurs there, and the words among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hashes, there, _ = grams(_docs(data)[1], order)
                keys, counts = distinct(hashes, there)
                single = np.isin(keys, hashes[0])
                limits = _bucket_limits(keys, buckets)
                out = [
                    (k, block, int(y - x), _pack(np.diff(keys[x:y], prepend=np.uint64(0))), _pack(counts[x:y].astype(np.uint32)), int(counts[x:y][single[x:y]].sum()))
                    for k, (x, y) in enumerate(zip(limits, limits[1:]))
                    if y > x and k % parts == part
                ]
                if out:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "block", "n", "keys", "counts", "words"])

    return rows.mapInArrow(tidy(run), "bucket int, block long, n long, keys binary, counts binary, words long")


def told(rows: DataFrame) -> DataFrame:
    """For each row of asked: how often its n-grams occur in other blocks."""

    def run(bucket: pa.Table) -> pa.Table:
        sizes = bucket.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(_unpack(k, n, np.uint64), dtype=np.uint64) for k, n in zip(bucket.column("keys").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([_unpack(c, n, np.uint32) for c, n in zip(bucket.column("counts").to_pylist(), sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        elsewhere = np.empty(len(keys), np.int64)
        elsewhere[order] = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))) - counts
        data = [_pack(x) for x in np.split(elsewhere, np.cumsum(sizes)[:-1])]
        return pa.table({"block": bucket.column("block"), "bucket": bucket.column("bucket"), "n": bucket.column("n"), "data": pa.array(data, pa.binary()), "words": bucket.column("words")})

    return rows.groupBy("bucket").applyInArrow(run, "block long, bucket int, n long, data binary, words long")


def lm_scores(df: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm of the product of the words' scores), mean_log_score, n_backoff.

    Words are runs without ASCII white space, A-Z in lower case. A null, empty or blank text has 0 words, a log_score of 0 and a null mean. A
    null id stays null; each repeated row counts as a document. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(text_bytes(rows) * order / 6 / bucket))
    # docs are compressed already
    held = stored(blocks(rows), "blocks", codec="uncompressed")
    answers = None
    for part in range(PASSES):
        found = stored(told(asked(held, order, buckets, part, PASSES).repartition(max(1, buckets // PASSES), "bucket")), "ngram-counts", codec="uncompressed")
        answers = found if answers is None else answers.unionByName(found)
    n_all = int(answers.agg(F.sum("words")).first()[0] or 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, texts = _docs(data)
                hashes, there, _ = grams(texts, order)
                keys, counts = distinct(hashes, there)
                totals = counts + np.concatenate([np.zeros(0, np.int64), *(_unpack(x["data"], x["n"], np.int64) for x in found or [])])
                words, total, backed = (np.array(x) for x in zip(*score_texts(texts, order, keys, totals, n_all), strict=True))
                mean = pa.array(np.round(total / np.maximum(words, 1), 9), mask=words == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(words, pa.int64()), pa.array(np.round(total, 6)), mean, pa.array(backed, pa.int64())], names=["doc_id", "n_words", "log_score", "mean_log_score", "n_backoff"]
                )

    by_block = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "data"))).alias("told"))
    # blocks of blank texts have asked nothing
    both = held.join(by_block, "block", "left").select("docs", "told")
    return both.mapInArrow(tidy(score), "doc_id long, n_words long, log_score double, mean_log_score double, n_backoff long")


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents scored by a trigram model of all other documents."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
