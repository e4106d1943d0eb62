"""Telephony audio: mu-law and A-law by lookup tables, IMA ADPCM blocks decoded side by side with numpy, resampled to 16-bit PCM.

Media are WAV files in a binary column: format 7 (mu-law), 6 (A-law) or 17 (ADPCM, blocks of 64 bytes), one channel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import binary_values, prepare, stored, tidy

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
RATE, TARGET, BLOCK = 8000, 16000, 64
#: The rate of the PCM that the query returns.
QUERY_RATE = 4000
#: Payload that is decoded at a time.
RUN_BYTES = 2 << 20


def _mulaw() -> np.ndarray:
    """By rule: inverted bits; sign, three bits of exponent, four of mantissa, with a bias of 132."""
    u = ~np.arange(256, dtype=np.uint8)
    size = (((u & 15).astype(np.int32) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int32)


def _alaw() -> np.ndarray:
    """By rule: every other bit inverted; sign, three bits of exponent, four of mantissa, the lowest segment linear."""
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, size = ((a >> 4) & 7).astype(np.int32), ((a & 15).astype(np.int32) << 4) + 8
    size = np.where(exponent > 0, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int32)


EXPAND = {MULAW: _mulaw(), ALAW: _alaw()}
#: Fixed values of the IMA ADPCM format: step sizes, and what a nibble's lower three bits add to the place among them.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157,
        173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707,
        1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635,
        13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each place among the steps and each nibble: the change of the sample, and the next place."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    place = np.clip(np.arange(89)[:, None] + MOVES[nibble & 7], 0, 88)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), place.astype(np.int32).ravel()


CHANGE, NEXT = _adpcm_tables()


def adpcm_blocks(data: np.ndarray) -> np.ndarray:
    """Samples of blocks (one a row): a head of the first sample (signed 16-bit) and the place among the steps, then two nibbles a byte,
    the lower first. All blocks advance together, one nibble at a time. A place beyond the last step counts as the last."""
    nibbles = np.empty((2 * (data.shape[1] - 4), len(data)), np.int32)
    nibbles[0::2], nibbles[1::2] = data[:, 4:].T & 15, data[:, 4:].T >> 4
    value = (data[:, 0].astype(np.int32) | data[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    place = np.minimum(data[:, 2].astype(np.int32), 88)
    out = np.empty((len(nibbles) + 1, len(data)), np.int16)
    out[0] = value
    for k, n in enumerate(nibbles, 1):
        at = (place << 4) | n
        value = np.clip(value + CHANGE[at], -32768, 32767)
        place = NEXT[at]
        out[k] = value
    return out.T


def wav(data: bytes, kind: int, rate: int = RATE) -> bytes:
    """data in a WAV file of one channel."""
    align, bits = {PCM: (2, 16), ALAW: (1, 8), MULAW: (1, 8), ADPCM: (BLOCK, 4)}[kind]
    samples = {PCM: len(data) // 2, ADPCM: len(data) // BLOCK * (2 * BLOCK - 7)}.get(kind, len(data))
    extra = struct.pack("<H", 2 * BLOCK - 7) if kind == ADPCM else b""
    per_second = rate * align if kind != ADPCM else rate * BLOCK // (2 * BLOCK - 7)
    head = struct.pack("<HHIIHHH", kind, 1, rate, per_second, align, bits, len(extra)) + extra
    body = b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse(media: bytes) -> tuple[int, int, bytes]:
    """Format, sample rate and data of a WAV file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(data: list[bytes], kind: int) -> list[np.ndarray]:
    """Samples of each of data. ADPCM data ends with its last whole block."""
    if kind == ADPCM:
        whole = [len(x) // BLOCK for x in data]
        blocks = adpcm_blocks(np.frombuffer(b"".join(x[: n * BLOCK] for x, n in zip(data, whole, strict=True)), np.uint8).reshape(-1, BLOCK))
        return [x.ravel() for x in np.split(blocks, np.cumsum(whole)[:-1])]
    if kind == PCM:
        return [np.frombuffer(x[: len(x) // 2 * 2], "<i2") for x in data]
    flat = EXPAND[kind][np.frombuffer(b"".join(data), np.uint8)]
    return np.split(flat, np.cumsum([len(x) for x in data])[:-1])


def _taps(up: int, down: int, half: int = 6) -> np.ndarray:
    """A windowed sinc in 14-bit fixed point, a row for each phase; each row sums to one."""
    t = np.arange(-half, half)[None, :] + (1 - np.arange(up)[:, None] / up)
    width = min(1, up / down)
    h = width * np.sinc(width * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1)))
    fixed = np.round(h / h.sum(1, keepdims=True) * (1 << 14)).astype(np.int32)
    fixed[np.arange(up), np.abs(h).argmax(1)] += (1 << 14) - fixed.sum(1).astype(np.int32)
    return fixed


def resample(signals: list[np.ndarray], rate: int, target: int) -> list[np.ndarray]:
    """16-bit samples at the target rate, in integer arithmetic, so that equal signals give equal samples; silence is presumed around."""
    common = int(np.gcd(rate, target))
    up, down, half = target // common, rate // common, 6
    gap = np.zeros(2 * half, np.int32)
    parts = [gap]
    for s in signals:
        parts += [s.astype(np.int32), gap]
    flat = np.concatenate(parts)
    taps, n = _taps(up, down, half), len(flat) - 2 * half
    made = np.empty((n, up), np.int16)
    for p in range(up):
        total = np.full(n, 1 << 13, np.int32)
        for k in range(2 * half):
            if taps[p, k]:
                total += flat[1 + k : 1 + k + n] * taps[p, k]
        made[:, p] = np.clip(total >> 14, -32768, 32767)
    made = made.ravel()
    out, at = [], half
    for s in signals:
        out.append(made[at * up : (at + len(s)) * up : down])
        at += len(s) + 2 * half
    return out


def decode(media: list[bytes], target: int = TARGET) -> list[np.ndarray]:
    """Samples of WAV files at the target rate."""
    parsed = [parse(m) for m in media]
    out: list = [None] * len(media)
    for key in {(k, r) for k, r, _ in parsed}:
        of = [i for i, (k, r, _) in enumerate(parsed) if (k, r) == key]
        for i, x in zip(of, resample(expand([parsed[i][2] for i in of], key[0]), key[1], target), strict=True):
            out[i] = x
    return out


def runs(data: list[bytes]) -> Iterator[slice]:
    """Slices of about RUN_BYTES."""
    at = size = 0
    for i, x in enumerate(data):
        size += len(x)
        if size >= RUN_BYTES or i == len(data) - 1:
            yield slice(at, i + 1)
            at, size = i + 1, 0


def store_pcm(df: DataFrame, media: str = "media", to: str = "pcm", target: int = TARGET) -> DataFrame:
    """df with the media column decoded, resampled and stored as a 16-bit PCM WAV file in a binary column. A null medium gives null; what
    is not a WAV file of a known format raises ValueError. Other columns stay; one named like the new one is replaced."""
    prepare(df.sparkSession)
    df = df.drop(to) if to != media else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.column(media).is_valid().to_pylist()
            data = [x for x, known in zip(binary_values(b.column(media)), there, strict=True) if known]
            made = iter([wav(x.astype("<i2").tobytes(), PCM, target) for s in runs(data) for x in decode(data[s], target)])
            pcm = pa.array([next(made) if known else None for known in there], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pcm if n == to else b.column(n) for n in b.schema.names), *([] if to in b.schema.names else [pcm])], names=[*b.schema.names, *([] if to in b.schema.names else [to])])

    return df.mapInArrow(tidy(run), df.withColumn(to, F.lit(None).cast("binary")).schema)


def describe(pcm: np.ndarray) -> str:
    """samples : mean size : peak : changes of sign : CRC-32 of the samples."""
    size = np.abs(pcm.astype(np.int32))
    changes = np.count_nonzero(np.diff(pcm < 0)) if len(pcm) else 0
    return f"{len(pcm)}:{int(size.sum(dtype=np.int64)) // max(len(pcm), 1)}:{int(size.max(initial=0))}:{changes}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK or (BLOCK if not text else 0))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as mu-law samples in a WAV file. A null text counts as empty; a null id stays null."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = binary_values(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([wav(payload(x), MULAW) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


#: The sounds that a payload is: its bytes as mu-law, as A-law and as ADPCM blocks.
SOUNDS = {"pcm_mulaw": MULAW, "pcm_alaw": ALAW, "pcm_adpcm": ADPCM}
FACTS = FEATURES.rpartition(",")[0]


def sounds(df: DataFrame, target: int = TARGET) -> DataFrame:
    """What the media hold: digests of the payload and of the file, and the sounds that the payload is, each decoded, resampled and put
    into a 16-bit PCM WAV file in a binary column. The rows of a run of payloads leave together, so that few samples are held."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media, ids, sizes = binary_values(b.column("media")), b.column("doc_id"), b.column("n_bytes")
            for s in runs(media):
                data = [parse(m)[2] for m in media[s]]
                facts = [(len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest()) for m, d in zip(media[s], data, strict=True)]
                made = [pa.array([wav(x.astype("<i2").tobytes(), PCM, target) for x in resample(expand(data, kind), RATE, target)], pa.binary()) for kind in SOUNDS.values()]
                there = [c.slice(s.start, s.stop - s.start) for c in (ids, sizes)]
                yield pa.RecordBatch.from_arrays([*there, *(pa.array(x) for x in zip(*facts, strict=True)), *made], names=[*(x.split()[0] for x in FACTS.split(", ")), *SOUNDS])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), FACTS + "".join(f", {c} binary" for c in SOUNDS))


def described(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows of sounds with a feature of the samples in place of the sounds, or, with keep, before them."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feature = ["|".join(describe(np.frombuffer(parse(x.as_py())[2], "<i2")) for x in row) for row in zip(*(b.column(c) for c in SOUNDS), strict=True)]
            names = [x.split()[0] for x in FACTS.split(", ")]
            more = list(SOUNDS) if keep else []
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(feature, pa.string()), *(b.column(n) for n in more)], names=[*names, "feature", *more])

    return df.mapInArrow(tidy(run), FEATURES + "".join(f", {c} binary" for c in SOUNDS if keep))


def media_features(df: DataFrame) -> DataFrame:
    """What the stored media hold: digests of the payload and of the file, and features of the sounds that the payload is, each resampled."""
    return described(sounds(df))


def telephony_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> stored media -> read back -> features and the resampled PCM, which is stored where the result is.

    A text byte is four samples of the three sounds at the media's rate of 8 kHz. At half that rate they are eight bytes of PCM."""
    media = stored(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return described(sounds(media, QUERY_RATE), keep=True)
