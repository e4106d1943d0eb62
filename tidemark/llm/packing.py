"""Packing of token sequences into as few fixed-size ones as possible by minimum bin slack.

How many sequences there are of each length is a table of at most ``capacity`` rows, whatever the corpus. On it, a bitset of reachable
sums finds the fullest combination of available lengths; the combination is taken as often as the counts allow. Each time, some length
falls below the number that the combination needs, so there are at most about capacity * ln(capacity) combinations. Sequences are
then numbered within their length, in parallel, and looked up in the table of combinations.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import ChunkEncoder, prepare, stored, tidy

Pattern = tuple[int, list[tuple[int, int]]]


def fill(counts: dict[int, int], capacity: int, seeded: bool = False) -> list[Pattern]:
    """Minimum bin slack over counts of lengths: (how many bins, [(length, how many in each bin), ...]) until nothing is left.

    Of equally full combinations the one with the longest sequences wins. seeded: each bin holds the longest that is left.
    """
    sizes = sorted(k for k, n in counts.items() if n > 0)
    left = [counts[k] for k in sizes]
    every = (1 << (capacity + 1)) - 1
    sums = [1]  # sums[k]: bit s is set if the first k lengths can make the sum s; only as far as not all sums are reachable
    out: list[Pattern] = []
    while sizes:
        while len(sums) <= len(sizes) and sums[-1] != every:
            k = len(sums) - 1
            bits, size, n, step = sums[-1], sizes[k], min(left[k], capacity // sizes[k]), 1
            while n:
                step = min(step, n)
                bits |= (bits << (size * step)) & every
                n -= step
                step *= 2
            sums.append(bits)

        def reach(k: int) -> int:
            return sums[min(k, len(sums) - 1)]

        used: list[tuple[int, int]] = []
        room, k = capacity, len(sizes)
        if seeded:
            top = len(sizes) - 1
            best = max((m * sizes[top] + (reach(top) & ((1 << (capacity - m * sizes[top] + 1)) - 1)).bit_length() - 1, m) for m in range(1, min(left[top], capacity // sizes[top]) + 1))
            room, k = best[0] - best[1] * sizes[top], top
            used.append((top, best[1]))
        else:
            room = reach(k).bit_length() - 1
        while room:
            k = min(k, bisect_right(sizes, room))
            m = min(left[k - 1], room // sizes[k - 1])
            while m and not reach(k - 1) >> (room - m * sizes[k - 1]) & 1:
                m -= 1
            if m:
                used.append((k - 1, m))
                room -= m * sizes[k - 1]
            k -= 1
        times = min(left[k] // m for k, m in used)
        out.append((times, [(sizes[k], m) for k, m in used]))
        lowest = len(sums) - 1
        for k, m in sorted(used, reverse=True):
            before = min(left[k], capacity // sizes[k])
            left[k] -= times * m
            if min(left[k], capacity // sizes[k]) != before:
                lowest = min(lowest, k)
            if not left[k]:
                del sizes[k], left[k]
        del sums[lowest + 1 :]
    return out


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """fill(); where that leaves more bins than the sum of lengths asks for, the seeded form too, and the better of both."""
    found = fill(counts, capacity)
    if sum(n for n, _ in found) > -(-sum(k * n for k, n in counts.items()) // capacity):
        found = min(found, fill(counts, capacity, seeded=True), key=lambda x: sum(n for n, _ in x))
    return found


def places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, how many in a bin, first bin, first offset), by length and rank."""
    rows, taken, bins = [], {}, 0
    for times, parts in patterns:
        at = 0
        for size, m in parts:
            rows.append((size, taken.get(size, 0), m, bins, at))
            taken[size] = taken.get(size, 0) + times * m
            at += size * m
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(df: DataFrame, order: list[str], length: str = "length", capacity: int = 4096, sequence: str = "sequence_id", offset: str = "offset") -> DataFrame:
    """df with the sequence that each row goes to and its place there; places of a sequence follow each other without gaps from 0.

    Rows with a null or non-positive length get nulls; a longer one than capacity raises ValueError. order: columns that number rows of
    one length (rows that are equal in them may change places). Other columns stay, also those that are named like the new ones: these
    are replaced. An empty table stays empty.
    """
    spark = df.sparkSession
    prepare(spark)
    size = F.col(length).cast("long")
    df = stored(df.drop(sequence, offset).withColumns({"__length": F.when(size > 0, size)}), "pack")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    # numbers within a length: those of the buckets before, and a number within the bucket; so no length is one task's work
    held = stored(df.where("__length is not null").groupBy("__length", "__bucket").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    counts = {r[0]: r[1] for r in held.groupBy("__length").agg(F.sum("n")).where(F.col("__length") <= capacity).collect()}
    if held.where(F.col("__length") > capacity).limit(1).collect():
        raise ValueError(f"a length is over {capacity}")
    table = places(plan(counts, capacity))
    before = Window.partitionBy("__length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = df.join(held, ["__length", "__bucket"], "left").withColumn(
        "__rank", F.col("__before") + F.row_number().over(Window.partitionBy("__length", "__bucket").orderBy(*order)) - 1
    )
    shift = 44
    keys = (table[:, 0] << shift) + table[:, 1]
    sent = spark.sparkContext.broadcast((keys, table))  # its size depends on the capacity alone

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = sent.value
        for b in batches:
            lengths = b.column("__length")
            known = lengths.is_valid().to_numpy(zero_copy_only=False)
            size, rank = lengths.fill_null(0).to_numpy(zero_copy_only=False), b.column("__rank").fill_null(0).to_numpy(zero_copy_only=False)
            seq, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            if len(keys):
                row = table[np.searchsorted(keys, (size << shift) + rank, side="right") - 1]
                k, m = rank - row[:, 1], np.maximum(row[:, 2], 1)
                seq, at = row[:, 3] + k // m, row[:, 4] + k % m * size
            keep = [n for n in b.schema.names if not n.startswith("__")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(seq, mask=~known), pa.array(at, mask=~known)], names=[*keep, sequence, offset])

    names = [c for c in df.columns if not c.startswith("__")]
    schema = df.select(*names, F.lit(0).cast("long").alias(sequence), F.lit(0).cast("long").alias(offset)).schema
    for f in schema.fields:
        f.nullable = True
    return ranked.select(*names, "__length", "__rank").mapInArrow(tidy(place), schema)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, remembered: int = 800_000) -> DataFrame:
    """Each text's ids and end_id as pieces of at most capacity ids; only longer ones are cut, and the last piece may be shorter.

    A null text counts as empty (one piece with end_id alone); a null id stays null. keep_ids adds the ids (little-endian unsigned 32-bit). remembered: chunks
    whose ids a worker keeps in mind.
    """
    prepare(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer, remembered)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].tobytes()
                    rows.append((doc, k, at, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(tidy(cut), PIECES + ", ids binary" * keep_ids)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, remembered: int = 800_000) -> DataFrame:
    return pack(pieces(docs, tokenizer, end_id, capacity, remembered=remembered), ["doc_id", "piece", "ids_crc32"], capacity=capacity)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> token pieces -> places in sequences of at most 4096 ids."""
    import public_tokenizers

    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1)
