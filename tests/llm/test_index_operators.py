"""Repeated strings, aligned tokenizers and hard negatives against brute force."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, hardneg, registry, repeats

SF = "/root/testdata/sf0.001"


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


# strings of a given length that stand anywhere else


def without_repeats(rows, length):
    """(id, bytes, removed, runs, what is left) by counting all strings."""
    count = collections.Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for k, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone) if not y)))
    return in_order(out)


def found(df, length, **more):
    return in_order((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept)) for r in repeats.without_repeats(df, length, **more).collect())


def texts_with_repeats(alphabet, n, seed):
    random.seed(seed)
    rows = [(k, "".join(random.choices(alphabet, k=random.randrange(60)))) for k in range(n)]
    base = "".join(random.choices("abcdefgh", k=200))
    for k in range(n, n + 60):
        x = random.randrange(150)
        rows.append((k, "".join(random.choices("xyz", k=random.randrange(20))) + base[x : x + random.randrange(50)] + "".join(random.choices("xyz", k=random.randrange(20)))))
    return rows + [(None, "q" * 30), (3, "a text of its own"), (3, "a text of its own"), (5, None), (6, ""), (None, "w" * 8 + base[:30])]


@pytest.mark.parametrize("alphabet, length, meet, run", [("ab", 12, 1000, 2 << 20), ("abcdé\0", 7, 2, 2 << 20), ("a\0", 9, 2, 64)])
def test_repeats_against_counting_all_strings(spark, monkeypatch, alphabet, length, meet, run):
    monkeypatch.setattr(repeats, "MEET", meet)  # few contexts meet in a task, others are counted
    monkeypatch.setattr(repeats, "RUN", run)  # texts in several parts
    rows = texts_with_repeats(alphabet, 120, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(1), "key": F.lit("x"), "doc": F.lit(None).cast("string")})
    want = without_repeats(rows, length)
    assert found(df, length, batches=3) == want and 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_anchors_with_many_contexts_are_not_taken_apart_into_all_strings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MEET", 2)
    rows_of, whole = {}, repeats.stored

    def counted(df, name, *more):
        out = whole(df, name, *more)
        rows_of[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "stored", counted)
    random.seed(3)
    base, letters = "".join(random.choices("abcdefgh", k=300)), lambda n: "".join(random.choices("xyz", k=n))
    # a passage between words of each text's own, parts of it from any place on, and texts that agree in a few bytes more
    rows = [(k, letters(80) + base + letters(80)) for k in range(60)] + [(100 + k, letters(30) + base[3 * k :][:110] + "x" * (k % 4) + letters(30)) for k in range(60)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 80) == without_repeats(rows, 80)
    assert 0 < rows_of["strings"] + rows_of.get("blocks", 0) < 20 * rows_of["contexts"]


def test_repeats_of_an_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string"), 400) == []


def test_levels_grow_geometrically(spark):
    rows = [(k, f"{k} " * 300) for k in range(8)]
    docs = repeats.numbered(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    index, ranks = repeats.SuffixIndex(), []
    for k in range(4):
        index.add(docs.where(F.col("doc") % 4 == k))
        ranks.append([rank for rank, _ in index.levels])
    assert ranks == [[0], [1], [1, 0], [2]]


def test_repeats_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, repeats.repeats_query(spark, SF).collect()))
    assert got == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in without_repeats(rows, 400)]


# aligned tokenizers

NAMES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def alignments(rows):
    """By cutting at the ends that both tokenizers have, text by text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, pre_tokenizers

    a, b = Tokenizer.from_file(NAMES[0]), SentencePieceProcessor(model_file=NAMES[1])
    a.encode_special_tokens = True
    plain = {x: n for n in range(256) for x in [bytes([n])]}
    shown = {}
    for n in range(128):
        shown[pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(n))[0][0]] = plain[bytes([n])]
    for n in range(128, 0x500):
        for c, x in zip(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(n))[0][0], chr(n).encode()):
            shown[c] = x
    docs, count = [], collections.Counter()
    for k, text in rows:
        groups, sizes = [], (0, 0)
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts = [len(a.id_to_token(i)) for i in ids[0]], [b"?" if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
            back = b"".join(bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else p for i, p in zip(ids[1], parts[1]))
            if back == (" " + text).encode():
                sizes = tuple(map(len, ids))
                ends = np.cumsum(parts[0]).tolist(), np.cumsum([len(p) for p in parts[1]]).tolist()
                i = j = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                    groups.append((ids[0][i:x], ids[1][j:y]))
                    i, j = x, y
        count.update({(x, y) for p, q in groups for x in p for y in q})
        docs.append((k, *sizes, groups))
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for k, n_a, n_b, groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((k, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return in_order(out)


PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "\xa0", "　", "▁", "\U0001f600", "日本", "word", "the", " of", "'s", "12", "<|endoftext|>", "<s>", "\0", "...", "ﬁ", "Ж", " ", "\x1c", "́", "\x85"]


@pytest.mark.parametrize("pairs, wide, chunks", [(2_000_000, 4096, 256), (300, 3, 2)])
def test_alignment_against_common_ends(spark, monkeypatch, pairs, wide, chunks):
    for name, value in (("PAIRS", pairs), ("WIDE", wide), ("SLICE_CHUNKS", chunks)):  # several blocks of pairs, wide groups, short slices
        monkeypatch.setattr(alignment, name, value)
    random.seed(2)
    rows = [(k, "".join(random.choices(PARTS, k=random.randrange(14)))) for k in range(1000)]
    rows += [(None, "x y"), (7, "x y"), (7, "x y"), (8, None), (9, ""), (10, " "), (11, "a" * 3000), (12, "ab " * 3000), (13, "x" * 100 + " " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "a": F.lit("x"), "id": F.lit(None).cast("string")})
    table = alignment.aligned(df, *NAMES)
    got = in_order(map(tuple, alignment.link_sums(table, alignment.pair_counts(table, *NAMES), *NAMES).collect()))
    assert got == alignments(rows)


def test_alignment_of_an_empty_table(spark):
    table = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), *NAMES)
    assert alignment.link_sums(table, alignment.pair_counts(table, *NAMES), *NAMES).collect() == []


# hard negatives


@pytest.mark.parametrize("most", [3, 1000, 2**27])
def test_scores_from_residues_are_exact(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(-most, most + 1, (20, 300)), rng.integers(-most, most + 1, (30, 300))
    moduli = hardneg.primes(300 * most * most)
    assert (hardneg.exact_scores(hardneg.residues(a, moduli), hardneg.residues(b, moduli), moduli) == a.astype(object) @ b.T.astype(object)).all()


COLUMNS = "anchor_id positive_id rank negative_id positive_score negative_score".split()


@pytest.mark.parametrize("block, rows_at_once", [(8192, 4096), (2, 7)])
def test_hard_negatives_against_sql(spark, tmp_path, monkeypatch, block, rows_at_once):
    monkeypatch.setattr(hardneg, "ROWS", rows_at_once)
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(-2, 3, 4).astype(float).tolist(), int(rng.integers(0, 3))) for k in range(0, 600, 2)]  # many ties
    rows += [(700, [1.0, 2.0, 1.0, 0.0], None), (800, None, 1), (900, [1.0, None, 1.0, 1.0], 1), (1000, [float("nan")] * 4, 2), (1100, [float("inf"), 0.0, 0.0, 0.0], 2), (1, [0.3, -0.7, 0.1, 2.0], 1), (1200, [0.5, 0.25, 1.5, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"q": F.lit(1), "slot": F.lit("x")})
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(hardneg, "BLOCK", block)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted(map(tuple, hardneg.hard_negatives(df, label=label, block=block).select(*COLUMNS).collect()))
    sql = registry.ORACLES["op13_residue_hard_negatives"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(f"select {', '.join(COLUMNS)} from ({sql})").fetchall()) and got


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(empty).collect() == []
    none = spark.createDataFrame([(3, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(none).collect() == []
