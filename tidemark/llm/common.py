"""What the operators share: scratch folders on the cluster's shared store, Arrow batch sizes, cached tokenization, word hashes."""

from __future__ import annotations

import atexit
import codecs
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Texts in one Arrow batch; with very long texts the byte bound below holds instead.
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small, so that a task's memory has a bound."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session while the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of that many rows while the block runs."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a master within one process (tests) gets a temporary folder, which
    ends with the process; a cluster has to name a folder that all its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers that one task can well take; where a table's size is known, it is written by so many tasks.
TASK_ROWS = 200_000
#: Rows of a few numbers that one task takes at once, so that grouping and joining them needs no shuffle.
ONE_TASK = 50_000


def tasks(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Into how many tasks that many rows are merged."""
    return max(2 * spark.sparkContext.defaultParallelism, rows // each + 1)


def at_once(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many rows, in one task if these are few."""
    return df.coalesce(1) if rows <= ONE_TASK else df


def stored(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """df written as Parquet into the shared store and read again: later jobs neither repeat it nor depend on executors that made it.

    rows: a bound on the rows that df is made from, if it is known; shuffle partitions are merged into as many tasks as these rows need,
    so that many rounds over a table that is small by now do not each start hundreds of tasks."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // TASK_ROWS + 1))
    path = scratch(spark, name)
    # nothing executes df again, so what it shuffled can go
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes partitions and buckets."""
    return int(df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0)


def binary_values(column) -> list[bytes]:
    """An Arrow string or binary column as bytes; null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def release() -> None:
    """Give freed memory back to the machine: Python workers outlive tasks and stages, and what one of them holds adds up."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run):
    """run, a function over the Arrow batches of a task, followed by release() however the task ends."""

    def over(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return over


class Remembered:
    """A mapping of at most ``limit`` entries: when its newer half is full, the older half is forgotten and the newer one becomes it."""

    def __init__(self, limit: int) -> None:
        self.half, self.newer, self.older = max(1, limit // 2), {}, {}

    def __len__(self) -> int:
        return len(self.newer) + len(self.older)

    def find(self, keys: list) -> tuple[list, list[int]]:
        """What is known of each key (else None), and the places of those that are not known."""
        found = list(map(self.newer.get, keys))
        gone = [k for k, x in enumerate(found) if x is None]
        if self.older and gone:
            again = {}
            for k in gone:
                if (x := self.older.get(keys[k])) is not None:
                    found[k] = again[keys[k]] = x
            self.add(again)
            gone = [k for k in gone if found[k] is None]
        return found, gone

    def add(self, entries: dict) -> None:
        if len(self.newer) + len(entries) > self.half:
            self.older, self.newer = self.newer, {}
        self.newer.update(entries)
        while len(self.newer) > self.half:  # more than fits came at once
            self.newer.popitem()


#: Bytes of text whose chunks are numbered at a time.
SLICE = 4 << 20
#: A word of lower-case ASCII and Latin-1 letters.
_WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Bytes of ASCII marks, and those that a letter or digit of ASCII or Latin-1 ends with.
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


class ChunkEncoder:
    """Encodes texts with the tokenizers library, remembering the ids of chunks between ASCII white space.

    The tokenizer drops white space and none of its pieces crosses it, so the ids of a text are those of its chunks in a row. It
    lowers letters, and ASCII marks that end a chunk behind a letter or digit are a piece of their own; so a chunk of ASCII and Latin-1
    letters is looked up in lower case, and its closing marks apart. Arrow splits a batch and numbers its different chunks; the library sees
    each one that is not remembered once. Words of such letters are one piece as they stand, which the library's model takes without
    normalizing and matching them first. ``limit`` chunks are remembered at most.
    """

    _made: dict[str, ChunkEncoder] = {}

    def __init__(self, path: str, limit: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # a special token parts chunks that go to the library in one string
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.between = self.tokenizer.token_to_id(self.special[0])
        self.known = Remembered(limit)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # how the model spells a letter's bytes
        spelling = dict(zip(range(128), map(chr, range(128))))
        for k in range(0xDF, 0x100):
            spelling |= zip(chr(k).encode(), spelled.pre_tokenize_str(chr(k))[0][0], strict=True)
        self.spelling = "".join(spelling.get(b, "\ufffe") for b in range(256))  # U+FFFE: undefined
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = None  # which ids end a piece
        if suffix:
            self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str, limit: int = 400_000) -> ChunkEncoder:
        """The encoder that this worker has for path, from now on with that limit."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        made = cls._made[path]
        if made.known.half != max(1, limit // 2):
            made.known = Remembered(limit)
        return made

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _batch(self, tokenizer, runs: list[str]):
        return (np.array(e.ids, "<u4") for k in range(0, len(runs), 50) for e in tokenizer.encode_batch_fast(runs[k : k + 50], add_special_tokens=False))

    def _learned(self, chunks: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        words, others = [], []
        for c in chunks:
            if len(c) > 10_000 or "<|" in c or not c:
                out[c] = self._ids(c).tobytes()
            else:
                (words if self.closes is not None and (c.isalpha() if c.isascii() else _WORD(c)) else others).append(c)
        # a word is one piece, whose last token says that it ends; others get a special token between them
        for group, mark in ((words, " "), (others, f" {self.special[0]} ")):
            runs = [group[k : k + 200] for k in range(0, len(group), 200)]
            joined = [mark.join(r) for r in runs]
            found = self._batch(self.tokenizer, joined) if mark != " " else self._batch(self.words, [codecs.charmap_decode(x.encode(), "strict", self.spelling)[0] for x in joined])
            for run, ids in zip(runs, found, strict=True):
                cuts = 4 * (np.flatnonzero(self.closes[ids]) + 1 if mark == " " else np.flatnonzero(ids == self.between))
                skip, data = (0, ids.tobytes()) if mark == " " else (4, ids.tobytes())
                ends = cuts.tolist() if mark == " " else [*cuts.tolist(), len(data)]
                out.update(zip(run, [data[x:y] for x, y in zip([0, *(x + skip for x in ends[:-1])], ends, strict=True)], strict=True))
        return out

    def _chunks(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks (an Arrow array of different strings) in a row, and how many each has."""
        parts = _parted(words).dictionary_encode()
        names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, new = self.known.find(names)
        learned = self._learned([names[k] for k in new])
        for k in new:
            ids[k] = learned[names[k]]
        self.known.add({w: x for w, x in learned.items() if len(w) < 64})
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        starts = np.cumsum(sizes) - sizes
        of = parts.indices.to_numpy(zero_copy_only=False)
        return _gathered(np.frombuffer(b"".join(ids), "<u4"), starts[of], sizes[of]), sizes[of].reshape(-1, 2).sum(1)

    def encode(self, texts) -> list[np.ndarray]:
        """Per text of an Arrow string column its ids as little-endian unsigned 32-bit integers; a null text has none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[np.ndarray] = []
        if not len(texts):
            return out
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist(), len(texts)]
        for begin, end in zip(cuts, cuts[1:]):
            split = pc.ascii_split_whitespace(pc.fill_null(texts[begin:end], "").cast(pa.large_string()))
            chunks = split.flatten().dictionary_encode()
            index = chunks.indices.to_numpy(zero_copy_only=False)
            pool, lengths = self._chunks(chunks.dictionary)
            n = lengths[index]
            flat = _gathered(pool, (np.cumsum(lengths) - lengths)[index], n)
            of = split.offsets.to_numpy() - split.offsets[0].as_py()
            limits = np.concatenate([[0], np.cumsum(n)])[of]
            out += [flat[a:b] for a, b in zip(limits, limits[1:])]
        return out


def _parted(words):
    """Two strings for each of an Arrow array: it without ASCII marks that end it behind a letter or digit, and these marks.

    Strings of nothing but ASCII and Latin-1 letters and without "<|" come in lower case; all others stay as they are, with no marks.
    """
    import pyarrow as pa

    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begin, end = offsets[:-1], offsets[1:]
    before = np.concatenate([np.zeros(1, np.uint8), data])[: len(data)]
    letter = (before == 0xC3) & (data != 0x97) & (data != 0xB7)  # but for the signs of multiplication and division
    odd = np.concatenate([[0], np.cumsum((data >= 0x80) & (data != 0xC3) & ~letter | (before == ord("<")) & (data == ord("|")))])
    plain = odd[begin] == odd[end]
    upper = ((data >= ord("A")) & (data <= ord("Z")) | letter & (data < 0x9F)) & np.repeat(plain, end - begin)
    low = data + upper.astype(np.uint8) * np.uint8(32)
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(_MARK[low], -1, np.arange(len(low))))])[end]
    ended = plain & (last >= begin) & _LETTER[np.concatenate([low, np.zeros(1, np.uint8)])[last]]
    cuts = np.concatenate([np.stack([begin, np.where(ended, last + 1, end)], 1).ravel(), offsets[-1:]])
    return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(cuts), pa.py_buffer(low))


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at starts and have those sizes, in a row."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


#: A random odd multiplier, its inverse modulo 2**64, and a random 64-bit value for each byte: words hash as polynomials.
_RNG = np.random.default_rng(20240229)
_BASE = int(_RNG.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


#: For words of letters: whatever ASCII has besides letters parts words.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def word_hashes(texts: list[bytes], lower: bool = True, parting: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one entry more than texts).

    Words are runs of bytes that are not parting, as it stands ``[^\\x20\\x09-\\x0D]+``. With lower, A-Z count as a-z. Long inputs are worked off in runs of about 1 MB of whole texts.
    """
    hashes, counts, run, size = [], [], [], 0
    for k, text in enumerate(texts):
        run.append(text)
        size += len(text) + 1
        if size > 1_000_000 or k == len(texts) - 1:
            h, c = _word_hashes(run, lower, parting)
            hashes.append(h)
            counts.append(c)
            run, size = [], 0
    starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), starts.astype(np.int64)


def _word_hashes(texts: list[bytes], lower: bool, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    inside = ~parting[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    limits = np.cumsum([len(x) + 1 for x in texts])
    of = np.searchsorted(limits, begin, side="right")
    return h, np.bincount(of, minlength=len(texts))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words; with fewer words, of the whole sequence as one; none without words. Not made distinct."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return h
