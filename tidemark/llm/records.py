"""Token ids as length-delimited binary records with checksums, and an offset index beside them for shuffled reads.

A record file is a row of frames: length of the payload (unsigned 64-bit), masked checksum of those 8 bytes (unsigned 32-bit), the
payload, masked checksum of the payload, and one end byte 0x0A. All numbers are little-endian. The checksum is CRC-32, rotated and
shifted by a constant so that checksums of data that holds checksums stay sound. A payload: one byte with the width of a token id in
bytes (2 where all ids of the record are below 65536, else 4), to which 128 is added if there is a document id; that id (signed 64-bit);
the token ids. Spark's own writer makes the files, so a lost task is repeated without traces
and any store that Spark writes to will do; file k holds the k-th range of ids, each in ascending order.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import ChunkEncoder, batches_of, prepare, scratch, text_bytes, tidy

_HEAD, _SUM, _ID, _ID_SIZE = "<Q", "<I", "<Bq", 9
END = b"\n"
INDEX = "shard int, record long, offset long, frame_bytes long, doc_id long, shard_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """CRC-32 of data, rotated right by 15 bits, plus a constant."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame but for its end byte, which Spark's text writer puts after each value."""
    head = struct.pack(_HEAD, len(payload))
    return b"".join((head, struct.pack(_SUM, masked(head)), payload, struct.pack(_SUM, masked(payload))))


def payload(doc: int | None, ids: np.ndarray) -> bytes:
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return struct.pack(_ID, width | 128 * (doc is not None), doc or 0) + ids.astype(f"<u{width}").tobytes()


def content(payload: memoryview | bytes) -> tuple[int | None, np.ndarray]:
    """Document id and token ids (unsigned 32-bit) of a payload."""
    kind, doc = struct.unpack_from(_ID, payload)
    return (doc if kind & 128 else None), np.frombuffer(payload[_ID_SIZE:], f"<u{kind & 127}").astype("<u4")


def frames(data: bytes) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, frame length, payload) of each frame; ValueError where a length or checksum is wrong."""
    view, at = memoryview(data), 0
    while at < len(data):
        head = bytes(view[at : at + 8])
        if len(head) < 8 or struct.unpack_from(_SUM, data, at + 8)[0] != masked(head):
            raise ValueError(f"damaged length at byte {at}")
        n = struct.unpack_from(_HEAD, head)[0]
        payload = view[at + 12 : at + 12 + n]
        if len(payload) < n or len(data) < at + 17 + n or struct.unpack_from(_SUM, data, at + 12 + n)[0] != masked(payload) or view[at + 16 + n] != END[0]:
            raise ValueError(f"damaged record at byte {at}")
        yield at, 17 + n, payload
        at += 17 + n


def write_records(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20) -> None:
    """Encode every text, append end_id, and write the records in ascending id order.

    A null text counts as empty (its record holds end_id alone); a null id sorts first; rows of equal ids are ordered by text; an
    empty table leaves an empty folder. shard_bytes of text go to one file on average.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = max(1, math.ceil(text_bytes(rows) / shard_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer)
        for b in batches:
            ids = b.column(0).to_pylist()
            found = encoder.encode(b.column(1))
            for at in range(0, len(ids), 512):
                yield pa.record_batch({"value": pa.array([frame(payload(i, np.append(x, np.uint32(end_id)))) for i, x in zip(ids[at : at + 512], found[at : at + 512], strict=True)], pa.binary())})

    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(tidy(encode), "value binary").select(F.col("value").cast("string")).write.text(path)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """Read the record files, check every frame, and write one index row a record: its file, place, id, and what its ids are."""
    prepare(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard, rows, start = int(re.match(r"part-(\d+)", name.rpartition("/")[2])[1]), [], 0
                for k, (at, size, held) in enumerate(frames(data.as_buffer().to_pybytes())):
                    doc, ids = content(held)
                    rows.append((shard, k, at, size, doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], names=[x.split()[0] for x in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    # one file at a time: a batch of them has no bound in memory
    with batches_of(spark, 1):
        files.mapInArrow(tidy(scan), INDEX).write.parquet(index)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The index with ``start``: the ids of all records before it, over all files."""
    rows = spark.read.schema(INDEX).parquet(index)
    # one row a file: few, however large the files
    base = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(base, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def read_record(data: bytes, offset: int, size: int) -> tuple[int | None, np.ndarray]:
    """One record by its index row, as a shuffled reader fetches it: id and token ids."""
    return content(next(frames(bytes(data[offset : offset + size])))[2])


def records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> record files -> offset index, read back from the files."""
    import public_tokenizers

    path = scratch(spark, "records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{path}/data", public_tokenizers.path("word_bpe_49k.json"), 2)
    write_index(spark, f"{path}/data", f"{path}/index")
    return read_index(spark, f"{path}/index").select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "frame_bytes")
