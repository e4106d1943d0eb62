"""Alignment of two tokenizers' ids by lockstep merging of token ends, and statistics of linked ids over a corpus.

Tokenizer A is a byte-level BPE of the tokenizers library, B a BPE model of the sentencepiece library; both read a space and the text. Offsets
where a token of A and one of B both end cut the tokens into groups; within a group every id of A is linked with every id of B.

One state vector holds the two pointers of all documents of a batch. Each step compares the ends of the tokens that the pointers
are at, advances the one that ends first, or both where they end together, emits a cut for those, and compacts the vector when documents
are through. Long documents go in several slices, each of which begins with a space behind something other than white space: both
tokenizers cut there, so the vector stays wide and the number of steps does not follow the longest text.

Both libraries see each different chunk (white space and what follows up to the next space) of a batch once; what A's pattern and B's
pieces cannot cross parts chunks. How many documents hold a pair of ids linked is summed in tasks before it is shuffled; the table of
pairs, which the vocabularies bound but which may be large, is broadcast in blocks of at most about PAIRS rows, and each block adds its
share to the sums of each document.

Defined results: texts that are null or empty or that the tokens of A or B do not give back have no tokens, zeros, and '' for a digest.
Rows count as documents, repeated and null ids too. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import _gathered as gathered, binary_values, prepare, stored, tidy

#: Bytes of text aligned at a time, chunks in a slice of a document, and pairs in a broadcast block.
RUN, SLICE_CHUNKS, PAIRS = 4 << 20, 256, 2_000_000
#: Groups with more links than this are reduced to their different ids before links are spread out.
WIDE = 4096
#: White space beyond ASCII.
SPACES = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ENDS = [(b[-1], b[:-1]) for b in (c.encode() for c in SPACES)]


def _after_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space (or a control character)."""
    before = data[at - 1]
    out = before <= 32
    high = np.flatnonzero(before >= 128)
    for last, rest in _ENDS:
        hit = high[before[high] == last]
        for k, byte in enumerate(reversed(rest)):
            hit = hit[data[np.maximum(at[hit] - 2 - k, 0)] == byte]
        out[hit] = True
    return out


class Pair:
    """Both tokenizers, as one worker has them."""

    _made: dict[tuple[str, str], Pair] = {}

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        # each character of a byte-level entry stands for a byte
        self.a_size = np.zeros(self.a.get_vocab_size(), np.int64)
        for piece, k in self.a.get_vocab().items():
            self.a_size[k] = len(piece)
        self.b = SentencePieceProcessor(model_file=b)
        held = []
        for k in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(k)
            held.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) or self.b.is_unknown(k) else piece.replace("▁", " ").encode())
        if any(b" " in x.lstrip(b" ") for x in held):
            raise ValueError("pieces of B that go on after a space cannot be parted into chunks")
        self.b_size = np.array([len(x) for x in held], np.int64)
        self.b_bytes = pa.array(held, pa.large_binary())
        self.space = self.b.piece_to_id("▁")

    @classmethod
    def of(cls, a: str, b: str) -> Pair:
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(a, b)
        return cls._made[a, b]

    def _a_ids(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _b_ids(self, text: str) -> list[int]:
        """Ids of a text that begins with a space, which B adds itself."""
        return self.b.encode(text[1:]) if len(text) > 1 else [self.space]

    def chunks(self, names: list[bytes], alone: np.ndarray):
        """Of different chunks: all ids, where each chunk's begin and how many it has, for A and for B, and whether B gives the chunk back.

        Chunks go to the libraries in long rows, those that end with white space alone."""
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        rows, row, size = [], [], 0
        for k in np.flatnonzero(~alone):
            row.append(k)
            size += sizes[k]
            if size > 20_000:
                rows.append(row)
                row, size = [], 0
        order, found = [], ([], [])
        for row in [*rows, row, *([k] for k in np.flatnonzero(alone))]:
            if not row:
                continue
            text, ends = b"".join([names[k] for k in row]).decode(), np.cumsum(sizes[row])
            order += row
            for side, encode, held in ((0, self._a_ids, self.a_size), (1, self._b_ids, self.b_size)):
                ids = np.array(encode(text), np.int64)
                at = np.concatenate([[0], np.cumsum(held[ids])])
                cut = np.searchsorted(at, ends)
                if at[-1] == ends[-1] and (at[cut] == ends).all():
                    found[side].append((ids, np.diff(cut, prepend=0)))
                else:  # B's tokens do not give back some text of the row
                    each = [np.array(encode(names[k].decode()), np.int64) for k in row]
                    found[side].append((np.concatenate(each), np.array([len(x) for x in each])))
        held = []
        for side in found:
            pool, n = np.concatenate([x for x, _ in side]), np.concatenate([x for _, x in side])
            start, count = np.empty((2, len(names)), np.int64)
            start[order], count[order] = np.cumsum(n) - n, n
            held.append((pool, start, count))
        pool, start, count = held[1]
        back = self.b_bytes.take(pa.array(pool))
        text, at = np.frombuffer(back.buffers()[2] or b"", np.uint8), np.frombuffer(back.buffers()[1], np.int64)
        begin, end = at[start], at[start + count]
        whole = np.frombuffer(b"".join([names[k] for k in order]), np.uint8)
        fine = end - begin == sizes
        if not fine.all() or (text[: at[-1]] != whole).any():
            fine = np.array([text[x:y].tobytes() == name for x, y, name in zip(begin, end, names, strict=True)])
        return held[0], held[1], fine


def lockstep(end_a: np.ndarray, end_b: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
    """Cuts of many rows of tokens: columns first A, A after the last, first B, B after the last of each group, in order of A.

    end_a, end_b: where each token ends. rows_a, rows_b: the first token of each row, and the number of all; a row's ends agree at its end."""
    active = np.flatnonzero(np.diff(rows_a) > 0)
    a, b, stop = rows_a[active], rows_b[active], rows_a[active + 1]
    from_a, from_b, cuts = a.copy(), b.copy(), []
    while len(a):
        x, y = end_a[a], end_b[b]
        step_a, step_b = x <= y, y <= x
        a, b = a + step_a, b + step_b
        both = step_a & step_b
        cuts.append(np.stack([from_a[both], a[both], from_b[both], b[both]], 1))
        from_a, from_b = np.where(both, a, from_a), np.where(both, b, from_b)
        open_ = a < stop
        if not open_.all():
            a, b, stop, from_a, from_b = (v[open_] for v in (a, b, stop, from_a, from_b))
    found = np.concatenate(cuts) if cuts else np.zeros((0, 4), np.int64)
    return found[np.argsort(found[:, 0], kind="stable")]


def _aligned_run(pair: Pair, texts: list[bytes], width: str) -> list[tuple]:
    """Per text: ids of A and B, and how many of each every group has, as bytes; four empty values where there are no tokens."""
    data = np.frombuffer(b"".join([b" " + x for x in texts]), np.uint8)
    firsts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    begins = np.zeros(len(data), bool)
    begins[at[~_after_space(data, at)]] = begins[firsts[:-1]] = True
    starts = np.flatnonzero(begins)
    edges = np.append(starts, len(data))
    last = _after_space(data, edges[1:])
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    of, names = chunks.indices.to_numpy(zero_copy_only=False), chunks.dictionary.to_pylist()
    alone = np.zeros(len(names), bool)
    alone[of[last]] = True
    (pool_a, start_a, n_a), (pool_b, start_b, n_b), fine = pair.chunks(names, alone)
    doc = np.searchsorted(firsts, starts, side="right") - 1
    good = np.fromiter((len(x) > 0 for x in texts), bool, len(texts))
    good[doc[~fine[of]]] = False
    of, doc = of[good[doc]], doc[good[doc]]
    a, b = gathered(pool_a, start_a[of], n_a[of]), gathered(pool_b, start_b[of], n_b[of])
    # slices begin with a document, and with every SLICE_CHUNKS-th chunk behind its first
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    head = np.flatnonzero(place % SLICE_CHUNKS == 0)
    before_a, before_b = (np.concatenate([[0], np.cumsum(n[of])]) for n in (n_a, n_b))
    cuts = lockstep(np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b]), np.append(before_a[head], len(a)), np.append(before_b[head], len(b)))
    limits = np.searchsorted(doc, np.arange(len(texts) + 1))
    in_a, in_b = before_a[limits], before_b[limits]
    in_cuts = np.searchsorted(cuts[:, 0], in_a)
    sizes = (cuts[:, 1] - cuts[:, 0]).astype("<u4"), (cuts[:, 3] - cuts[:, 2]).astype("<u4")
    columns = ((a.astype(width), in_a), (b.astype(width), in_b), (sizes[0], in_cuts), (sizes[1], in_cuts))
    return [tuple(x[to[k] : to[k + 1]].tobytes() for x, to in columns) for k in range(len(texts))]


def _width(a: str, b: str) -> str:
    pair = Pair.of(a, b)
    return "<u2" if max(len(pair.a_size), len(pair.b_size)) <= 1 << 16 else "<u4"


def aligned(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row (its number), id, and in binary columns the ids of A (a) and B (b) and how many each group has of them (in_a, in_b, 32 bits).

    Ids have 16 bits where both vocabularies fit, else 32. Written to the shared store, as three passes read it."""
    prepare(df.sparkSession)
    width = _width(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(a, b)
        for batch in batches:
            texts, k = binary_values(batch.column(2)), 0
            while k < len(texts):
                m, size = k, 0
                while m < len(texts) and (m == k or size + len(texts[m]) < RUN):
                    size += len(texts[m])
                    m += 1
                found = _aligned_run(pair, texts[k:m], width)
                yield pa.record_batch([batch.column(0)[k:m], batch.column(1)[k:m], *(pa.array(x, pa.binary()) for x in zip(*found, strict=True))], names=["row", "id", "a", "b", "in_a", "in_b"])
                k = m

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(tidy(run), "row long, id long, a binary, b binary, in_a binary, in_b binary"), "aligned")


class Groups:
    """Rows of an aligned table, as arrays: ids a and b, the sizes of all groups, and where each row's begin."""

    def __init__(self, batch: pa.RecordBatch, width: str) -> None:
        def flat(name, kind):
            held = binary_values(batch.column(name))
            x = np.frombuffer(b"".join(held), kind)
            return x.astype(np.int64), np.cumsum([0, *(len(h) // x.itemsize for h in held)])

        (self.a, self.of_a), (self.b, self.of_b) = flat("a", width), flat("b", width)
        (self.n_a, self.of), (self.n_b, _) = flat("in_a", "<u4"), flat("in_b", "<u4")

    def links(self, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, pair (a * span + b) and count of all links; a pair may come several times."""
        first_a, first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        row = np.searchsorted(self.of, np.arange(len(self.n_a)), side="right") - 1
        n = self.n_a * self.n_b
        wide, some = np.flatnonzero(n > WIDE), np.flatnonzero(n <= WIDE)
        m = n[some]
        place = (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)).astype(np.uint16)  # below WIDE
        over = np.repeat(self.n_b[some].astype(np.uint16), m)
        a = self.a[np.repeat(first_a[some], m) + place // over]
        b = self.b[np.repeat(first_b[some], m) + place % over]
        rows, pairs, counts = [np.repeat(row[some], m)], [a * span + b], [np.ones(len(a), np.int64)]
        for g in wide:
            x, nx = np.unique(self.a[first_a[g] : first_a[g] + self.n_a[g]], return_counts=True)
            y, ny = np.unique(self.b[first_b[g] : first_b[g] + self.n_b[g]], return_counts=True)
            pairs.append((x[:, None] * span + y).ravel())
            counts.append((nx[:, None] * ny).ravel())
            rows.append(np.full(len(pairs[-1]), row[g]))
        return np.concatenate(rows), np.concatenate(pairs), np.concatenate(counts)

    def digests(self, spell) -> list[str]:
        """Lowercase hex of SHA-256 over a1,a2|b1;a3|b2 of each row; '' without tokens."""
        comma, bar, semicolon = (k * (len(spell) // 3) for k in range(3))
        end_a, end_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        a, b = self.a + comma, self.b + comma
        a[end_a - 1], b[end_b - 1] = self.a[end_a - 1] + bar, self.b[end_b - 1] + semicolon
        # ids in the order of the text: those of A and then those of B, group by group
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(end_b - self.n_b, self.n_a)] = a
        order[np.arange(len(b)) + np.repeat(end_a, self.n_b)] = b
        text = spell.take(pa.array(order))
        at, text = np.frombuffer(text.buffers()[1], np.int64)[self.of_a + self.of_b].tolist(), memoryview(text.buffers()[2] or b"")
        return [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]


def _spelling(n: int) -> pa.LargeBinaryArray:
    """All ids below n in decimal, followed by a comma, then by a bar, then by a semicolon."""
    return pa.array([b"%d%c" % (k, mark) for mark in b",|;" for k in range(n)], pa.large_binary())


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose arrays stay small."""
    size = np.cumsum(pa.compute.binary_length(batch.column("a")).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(size // RUN)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(x, y - x) for x, y in zip(cuts, cuts[1:]) if y > x)


def pair_counts(table: DataFrame, a: str, b: str) -> DataFrame:
    """pair (a * size of B + b), n (rows that hold it linked), best (no pair of its id of A has more): written to the shared store."""
    width, span = _width(a, b), len(Pair.of(a, b).b_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = [], []

        def summed():
            pair, of = np.unique(np.concatenate(held), return_inverse=True)
            return pair, np.bincount(of, np.concatenate(counts), len(pair)).astype(np.int64)

        for batch in batches:
            for part in _parts(batch):
                row, pair, _ = Groups(part, width).links(span)
                pair, n = np.unique(_different(row, pair), return_counts=True)
                held.append(pair)
                counts.append(n)
                if sum(map(len, held)) > PAIRS:
                    pair, n = summed()
                    held, counts = [pair], [n]
                    if len(pair) > PAIRS // 2:
                        yield pa.record_batch([pa.array(pair), pa.array(n)], names=["pair", "n"])
                        held, counts = [], []
        if held:
            pair, n = summed()
            yield pa.record_batch([pa.array(pair), pa.array(n)], names=["pair", "n"])

    counted = stored(table.mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    highest = counted.groupBy(F.floor(F.col("pair") / span).alias("id")).agg(F.max("n").alias("most"))
    return stored(counted.join(highest, F.floor(F.col("pair") / span) == F.col("id"), "left").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "best")


def _different(row: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The pairs of all rows, each once a row."""
    span = int(pair.max(initial=0)) + 1
    if span * (int(row.max(initial=0)) + 1) < 1 << 63:
        return np.unique(row * span + pair) % span
    return np.unique(np.stack([row, pair], 1), axis=0)[:, 1]


def link_sums(table: DataFrame, counts: DataFrame, a: str, b: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark, width, span, spelled = table.sparkSession, _width(a, b), len(Pair.of(a, b).b_size), max(len(Pair.of(a, b).b_size), len(Pair.of(a, b).a_size))
    blocks, out = max(1, math.ceil(counts.count() / PAIRS)), None
    for block in range(blocks):
        some = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).orderBy("pair").toArrow()
        sent = spark.sparkContext.broadcast((some.column("pair").to_numpy(), some.column("n").to_numpy(), some.column("best").to_numpy()))
        del some

        def run(batches: Iterator[pa.RecordBatch], sent=sent, whole=block == 0) -> Iterator[pa.RecordBatch]:
            (pairs, n, best), spell = sent.value, _spelling(spelled) if whole else None
            for batch in batches:
                for part in _parts(batch):
                    g, rows = Groups(part, width), part.num_rows
                    row, pair, count = g.links(span)
                    at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
                    known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                    row, count, at = row[known], count[known], at[known]
                    sums = np.zeros((3, rows), np.int64)
                    for k, x in enumerate((count, count * best[at], count * n[at])):
                        np.add.at(sums[k], row, x)  # whole numbers: weights of bincount would be floats
                    sizes = (np.diff(g.of_a), np.diff(g.of_b), np.diff(g.of)) if whole else [np.zeros(rows, np.int64)] * 3
                    yield pa.record_batch([part.column("row"), part.column("id"), *map(pa.array, sizes), *map(pa.array, sums), pa.array(g.digests(spell) if whole else [""] * rows, pa.string())], names=RESULT)

        found = table.mapInArrow(tidy(run), ", ".join(f"{x} {'string' if x == 'groups_sha256' else 'long'}" for x in RESULT))
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        out = out.groupBy("row", "id").agg(*(F.sum(x).alias(x) for x in RESULT[2:-1]), F.max(RESULT[-1]).alias(RESULT[-1]))
    return out.select(F.col("id").alias(id_col), *RESULT[2:])


RESULT = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents by the byte-level and the piece vocabulary: groups, links and what their counts sum up to."""
    import public_tokenizers

    names = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    table = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), *names)
    return link_sums(table, pair_counts(table, *names), *names)
