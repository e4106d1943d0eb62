"""Small cases of the operators over texts: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import agree
from tidemark.llm import boilerplate, bpe, exactdedup, ngramlm, packing, pii, records, registry, telephony, toxicity
from tidemark.llm.common import ChunkEncoder

P = pytest.importorskip("public_tokenizers")
VOCAB = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def docs(spark, texts, ids=None, source="s"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, source, None) for i, t in zip(ids, texts)], SCHEMA)


ODD = ["Hello, wörld!", None, "", " \t\n", "x" * 5000, "it's 12 o'clock <|endoftext|> now", "日本語 text ﬁ Σς", "Hello, wörld!", "a b　c", "word " * 9000]


@pytest.fixture(scope="module")
def odd_ids():
    t = tokenizer()
    return [t.encode(x or "", add_special_tokens=False).ids for x in ODD]


def saved(df, tmp_path, name="documents.parquet"):
    df.write.parquet(str(tmp_path / name))
    return str(tmp_path)


def test_records_round_trip(spark, tmp_path, odd_ids):
    order = [5, 3, 9, 1, 0, 7, 2, 8, 6, 4]
    df = docs(spark, ODD, order).withColumn("value", F.lit("clash")).withColumn("shard", F.lit(1))
    records.write_records(df, str(tmp_path / "d"), VOCAB, 2, shard_bytes=20_000)
    records.write_index(spark, str(tmp_path / "d"), str(tmp_path / "i"))
    got = sorted(records.read_index(spark, str(tmp_path / "i")).collect(), key=lambda r: r.doc_id)
    start = 0
    files = {int(re.search(r"part-(\d+)", f.name)[1]): f.read_bytes() for f in (tmp_path / "d").glob("part-*")}
    assert len(files) > 1
    for r in got:
        ids = np.array(odd_ids[order.index(r.doc_id)] + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        doc, back = records.read_record(files[r.shard], r.offset, r.frame_bytes)
        assert doc == r.doc_id and back.tolist() == ids.tolist()
        start += len(ids)
    data = bytearray(next(iter(files.values())))
    data[-3] ^= 1
    with pytest.raises(ValueError):
        list(records.frames(bytes(data)))


def test_shard_numbers_come_from_file_names(spark, tmp_path):
    place = tmp_path / "part-7" / "d"
    records.write_records(docs(spark, [f"text {k}" for k in range(100)]), str(place), VOCAB, 2, shard_bytes=100)
    records.write_index(spark, str(place), str(tmp_path / "i"))
    rows = records.read_index(spark, str(tmp_path / "i"))
    assert rows.select("start").distinct().count() == 100 and rows.select("shard").distinct().count() > 3


def test_records_null_id_and_empty_table(spark, tmp_path):
    records.write_records(docs(spark, ["b", "a"], [None, 3]), str(tmp_path / "d"), VOCAB, 2)
    records.write_index(spark, str(tmp_path / "d"), str(tmp_path / "i"))
    assert [(r.doc_id, r.start) for r in sorted(records.read_index(spark, str(tmp_path / "i")).collect(), key=lambda r: r.start)] == [(None, 0), (3, 2)]
    records.write_records(docs(spark, []), str(tmp_path / "e"), VOCAB, 2)
    records.write_index(spark, str(tmp_path / "e"), str(tmp_path / "ei"))
    assert records.read_index(spark, str(tmp_path / "ei")).count() == 0


def test_bpe_equals_the_library(spark, odd_ids):
    t = tokenizer()
    df = docs(spark, ODD).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    for r in bpe.encode_decode(df, VOCAB, keep=True).collect():
        want = odd_ids[r.doc_id]
        assert r.ids == want and r.n_tokens == len(want)
        text = t.decode(want, skip_special_tokens=False)
        assert r.decoded == text and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(docs(spark, []), VOCAB).count() == 0


def test_bpe_stream_keeps_little_and_decodes_cut_characters(odd_ids):
    m = bpe.Transducer(VOCAB)
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abéthein"), 6000)) + " end"
    want = tokenizer().encode(text, add_special_tokens=False).ids
    for cut in (7, 501):
        assert list(m.encode_stream((text[i : i + cut] for i in range(0, len(text), cut)), hold=600)) == want
    for x, ids in zip(ODD, odd_ids):
        assert list(m.encode_stream([x or ""])) == ids
    d = bpe.Decoder(m, False)
    ids = m.encode("日本")
    pieces = [d.feed(i) for i in ids]
    assert "" in pieces and "".join(pieces) + d.end() == "日本 "


def test_lookahead_bounds_every_change():
    m = bpe.Transducer(VOCAB)
    rng = np.random.default_rng(4)
    for _ in range(50):
        word, more = ("".join(rng.choice(list("aeinrst"), n)).encode() for n in (60, 20))
        # as symbols within a word: no end is marked
        a, b = list(m.stable(word)), list(m.stable(word + more))
        ends_a, ends_b = np.cumsum([m.size[t] for t in a]), np.cumsum([m.size[t] for t in b])
        safe = len(word) - m.lookahead
        assert [e for e in ends_a if e <= safe] == [e for e in ends_b if e <= safe]
        machine, out = bpe.Machine(m), []
        for k, s in enumerate(word):
            out += machine.feed(s)
            # what was emitted never changes, and little is held
            assert out == b[: len(out)] and sum(m.size[t] for t in out) == k + 1 - machine.held and machine.held <= m.lookahead + m.longest


def test_tokens_are_emitted_before_a_word_ends():
    m = bpe.Transducer(VOCAB)
    early = 0
    for word in (b"understandably", b"thingerationblewh", b"internationalization", b"photosynthesizing"):
        machine, seen = bpe.Machine(m), []
        for s in bpe.marked(word):
            seen.append(machine.feed(s))
        early += any(seen[:-1])
        assert [t for x in seen for t in x] + machine.end() == m.encode(word.decode())
    assert early >= 3


def test_stream_holds_little_without_ascii():
    m, t = bpe.Transducer(VOCAB), tokenizer()
    rng = np.random.default_rng(6)
    for letters in ("日本語彙文字列処理", "αβγδεςσΣ", "ガギグゲ각간ê…!"):
        text = "".join(rng.choice(list(letters), 20_000))
        stream, ids, most = bpe.Stream(m, 64), [], 0
        for k in range(0, len(text), 50):
            ids += stream.feed(text[k : k + 50])
            most = max(most, stream.held)
        assert ids + list(stream.end()) == t.encode(text, add_special_tokens=False).ids and most <= 64 + 50 + 2 + m.lookahead


def test_words_side_by_side_equal_the_library():
    m, t = bpe.Transducer(VOCAB), tokenizer()
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("aaahheint"), n)) for n in rng.integers(1, 70, 2000)] + ["a" * n for n in range(1, 90)]
    flat, n = m.encode_all(pa.array(words))
    want = [t.encode(w, add_special_tokens=False).ids for w in words]
    assert flat.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


@pytest.mark.parametrize("seeded", [False, True])
def test_fill_is_feasible_and_fullest_first(seeded):
    rng = np.random.default_rng(7)
    for _ in range(100):
        cap = int(rng.integers(5, 60))
        counts = {int(k): int(rng.integers(1, 6)) for k in rng.integers(1, cap + 1, 8)}
        left = dict(counts)
        for times, parts in packing.fill(counts, cap, seeded):
            reach = {0}
            for k, n in left.items():
                reach = {s + k * j for s in reach for j in range(n + 1) if s + k * j <= cap}
            full = sum(k * m for k, m in parts)
            assert full <= cap and (seeded or full == max(reach)) and len({k for k, _ in parts}) == len(parts)
            for k, m in parts:
                left[k] -= times * m
                assert left[k] >= 0
        assert not any(left.values())


def test_packing_query_against_pieces(spark, tmp_path, odd_ids):
    df = docs(spark, ODD).withColumn("sequence_id", F.lit("clash"))
    got = packing.packed_documents(df, VOCAB, 1).collect()
    want = sorted((i, k, s, len(a[s : s + 4096])) for i, ids in enumerate(odd_ids) for a in [ids + [1]] for k, s in enumerate(range(0, len(a), 4096)))
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(r.length for r in got) // 4096)


def test_chunks_in_other_case_or_before_other_marks_are_one():
    words = [a + b for a in ("été", "straße", "word", "ñu", "x9") for b in ("", "s", "û")]
    texts = [" ".join(f(w) + m for w in words for f in (str, str.title) for m in ("", ".", ",", "!?", "###", ",%%%", "'"))]
    encoder = ChunkEncoder(VOCAB)
    assert encoder.encode(pa.array(texts))[0].tolist() == tokenizer().encode(texts[0], add_special_tokens=False).ids
    assert len(encoder.known) <= len(words) + 7  # 210 different chunks


def test_chunks_equal_the_library_on_odd_text():
    texts = ["dogs' it's' 's, 'S. 'start x'll-' DON'T!!! <|ENDOFTEXT|> abc<|endoftext|>d, a<| |b <|.", "e\u0301. E\u0301, e\u0338 =\u0338 ab<\u0338. a-\u0301-",
             "İstanbul, ΣΑΣ. ǅ ŉ, ﬁ. K. Å. ª. º, µ. ²., ½! ×, ÷. 3×. Þ×÷ «à» ¿Qué? Œuvre.", "a\x00. b\x01, \x7f. x\x1f, y\x85z. q\xa0r", "…a… …, a’s it’s, кот, КОТ! 中文。, e\u200d. 😀, a😀.",
             "é" * 11_000 + ", " + "x" * 12_000 + "."]
    rng, letters = np.random.default_rng(3), list("aAbZéÉßÿŸÀ×÷ñ0 9.,'’!-#<|>\t\u0301\u0338µªsStTlLΣкЖ中\x00\x7f\x85\xa0\xad")
    texts += ["".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 3000)]
    library = tokenizer()
    for text, ids in zip(texts, ChunkEncoder(VOCAB).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_pack_rows_without_length_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (2, None, "y"), (3, 0, "z"), (4, 3, "w")], "k int, length int, offset string")
    got = packing.pack(df, ["k"], capacity=8).collect()
    assert sorted((r.k, r.sequence_id is None) for r in got) == [(1, False), (1, False), (2, True), (3, True), (4, False)]
    assert len({r.sequence_id for r in got if r.length}) == 2
    assert packing.pack(df.limit(0), ["k"], capacity=8).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, ["k"], capacity=4)


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in telephony.media_features(telephony.media_column(docs(spark, ODD).withColumn("media", F.lit(1)))).collect()}
    for i, x in enumerate(ODD):
        data = telephony.payload((x or "").encode())
        assert len(data) % 64 == 0 and len(data) >= 64
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((x or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert got[0].feature == got[7].feature and got[1].feature == got[2].feature and got[0].feature != got[6].feature
    assert telephony.media_features(telephony.media_column(docs(spark, []))).count() == 0


def test_expansion_tables_and_adpcm_against_a_plain_decoder():
    # corner values of G.711
    assert telephony.EXPAND[telephony.MULAW][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.EXPAND[telephony.ALAW][[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]
    block = np.random.default_rng(1).integers(0, 256, (5, 64), dtype=np.uint8)
    for row, got in zip(block, telephony.adpcm_blocks(block)):
        value, place = int(np.array([int(row[0]) | int(row[1]) << 8]).astype(np.int16)[0]), min(int(row[2]), 88)
        want = [value]
        for byte in row[4:].tolist():
            for n in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[place])
                diff = (step >> 3) + (step >> 2) * (n & 1) + (step >> 1) * (n >> 1 & 1) + step * (n >> 2 & 1)
                value = max(-32768, min(32767, value - diff if n & 8 else value + diff))
                place = max(0, min(88, place + int(telephony.MOVES[n & 7])))
                want.append(value)
        assert got.tolist() == want


def test_resampling_keeps_a_tone_and_store_pcm(spark):
    t = np.arange(800)
    tone = np.round(8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    up = telephony.resample([tone, tone[:1], tone], 8000, 16000)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert np.abs(up[0][50:-50] - want[50:-50]).max() < 120 and len(up[1]) == 2 and up[0].tolist() == up[2].tolist()
    media = [telephony.wav(bytes(range(256)), k) for k in (telephony.MULAW, telephony.ALAW, telephony.ADPCM)]
    df = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(media)] + [(9, None)], "pcm int, media binary")
    out = {r.k: r.wave for r in telephony.store_pcm(df.withColumnRenamed("pcm", "k"), to="wave").collect()}
    assert out[9] is None and telephony.parse(bytes(out[0]))[:2] == (telephony.PCM, 16000) and len(telephony.parse(bytes(out[0]))[2]) == 1024


def test_line_dedup(spark):
    rows = [(i, f"unique {i}\nmenu\n\nbody {i}", None, "a", 1) for i in range(10)]
    rows += [(20, None, None, "a", None), (21, "", None, None, None), (22, "menu", None, "a", 4), (23, "menu\nx", None, "b", 1), (5, "unique 5\nmenu\n\nbody 5", None, "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_lines", F.lit("clash"))
    got = boilerplate.line_dedup(df, "source").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and by[3][0].text == "unique 3\n\nbody 3" and by[3][0].n_dropped == 1
    # a page of boilerplate alone is left empty; other hosts are untouched
    assert by[22][0].text == "" and by[22][0].n_dropped == 1 and by[23][0].text == "menu\nx" and by[20][0].text is None and by[20][0].n_lines == 0 and by[21][0].text == ""
    assert len(by[5]) == 2 and boilerplate.line_dedup(df.limit(0), "source").count() == 0
    small = boilerplate.BROADCAST_LINES
    try:
        boilerplate.BROADCAST_LINES = 0
        assert sorted(map(str, boilerplate.line_dedup(df, "source").collect())) == sorted(map(str, got))
    finally:
        boilerplate.BROADCAST_LINES = small


def test_pii(spark):
    iban, card = "DE89370400440532013000", "4111 1111 1111 1111"
    texts = [f"ä mail me: bob@x.org or 1.2.3.300, 10.0.0.1; card {card}, +49 (30) 1234-5678", f"IBAN {iban} and GB82 WEST 1234 5698 7654 32, DE89370400440532013001", None, "", "ssn 123-45-6789 but 987-65-4321", "1" * 20000 + "@" * 3000 + " a" * 50000, "a@b.c_d@e.f"]
    df = docs(spark, texts).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find_pii(df).collect()}
    assert got[0] == [("email", "bob@x.org"), ("ip", "10.0.0.1"), ("card", card), ("phone", "+49 (30) 1234-5678")]
    assert [g for g in got[1] if g[0] == "iban"] == [("iban", iban), ("iban", "GB82 WEST 1234 5698 7654 32")]
    assert got[2] == [] and got[3] == [] and [g for g in got[4] if g[0] == "ssn"] == [("ssn", "123-45-6789"), ("ssn", "987-65-4321")]
    assert got[6] == [("email", "a@b.c"), ("email", "_d@e.f")]
    masked = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert masked[0] == "ä mail me: [EMAIL] or 1.2.3.300, [IP]; card [CARD], [PHONE]" and masked[2] is None and masked[3] == "" and masked[6] == "[EMAIL][EMAIL]"


def test_pii_words_nearby_are_whole_words_and_odd_rows(spark):
    texts = ["insecurity 123-45-6789", "social: 123-45-6789", "123-45-6789 SSNs", "my insecurity" + "x" * 40 + " 123-45-6789", "hotel +49 30 1234-5678", "tel. +49 30 1234-5678"]
    got = {r.doc_id: [s.score for s in r.spans] for r in pii.find_pii(docs(spark, texts)).collect()}
    assert got == {0: [], 1: [70], 2: [70], 3: [], 4: [50], 5: [80]}
    again = pii.find_pii(docs(spark, ["a@b.org", "a@b.org"], [None, None])).collect()
    assert len(again) == 2 and all(r.doc_id is None and len(r.spans) == 1 for r in again)
    assert pii.find_pii(docs(spark, [])).count() == 0 and pii.redact(docs(spark, [])).count() == 0


def test_redact_joins_overlaps_and_is_quick_on_many(spark):
    import time

    card = "4111 1111 1111 1111"
    texts = [f"{card}@x.org +{card[:4]} 1111 1111", "é " + " ".join(f"u{k}@x.org" for k in range(8000))]
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in pii.find_pii(docs(spark, texts)).collect()}
    began = time.time()
    got = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert got[1] == "é " + " ".join(["[EMAIL]"] * 8000) and time.time() - began < 30
    merged = []
    for start, end in sorted(found[0]):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    assert re.sub(r"\[[A-Z]+\]", "#", got[0]) == "".join(texts[0][a:b] + "#" for a, b in zip([0, *(e for _, e in merged)], [s for s, _ in merged])) + texts[0][merged[-1][1] :]


def test_exact_dedup_null_ids_and_texts_that_only_share_a_digest(spark, tmp_path, monkeypatch):
    path = saved(docs(spark, ["a", "a", "b", None], [None, 3, 4, None]), tmp_path)
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_dedup(spark, f"{path}/documents.parquet").collect()}
    sha = [hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"")]
    # a null id counts as the smallest
    assert got == {(None, sha[0]): (None, 2, True), (3, sha[0]): (None, 2, False), (4, sha[1]): (4, 1, True), (None, sha[2]): (None, 1, True)}
    whole = exactdedup._located
    monkeypatch.setattr(exactdedup, "_located", lambda df, i, t: whole(df, i, t).withColumn("digest", F.lit("one")))
    path = saved(docs(spark, ["a", "a ", "b", "a"], [1, 2, 3, 5]), tmp_path / "same")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_dedup(spark, f"{path}/documents.parquet").collect()}
    assert got[2] == (2, 1, True) and got[3] == (3, 1, True) and got[1][0] == 1 and got[1][2] and got[5][0] == 1 and not got[5][2]


def test_micro_batches_follow_the_cluster():
    assert [exactdedup._bytes(x) for x in ("134217728b", "128m", "1g", "64K", "7", "16MB")] == [1 << 27, 1 << 27, 1 << 30, 1 << 16, 7, 1 << 24]


def test_exact_dedup(spark, tmp_path):
    texts = ["a  b", "a b", None, "", " ", "\t", "c", "a\nb", "x" * 100_000, "x" * 100_000]
    df = docs(spark, texts, [7, 3, 5, 9, 1, 2, 4, 3, 11, 10]).withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1))
    path = saved(df.repartition(3), tmp_path)
    got = sorted(exactdedup.exact_dedup(spark, f"{path}/documents.parquet").collect(), key=lambda r: (r.doc_id, not r.kept))
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [
        (1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (3, 3, 3, False), (4, 4, 1, True), (5, 5, 2, True), (7, 3, 3, False), (9, 5, 2, False), (10, 10, 2, True), (11, 10, 2, False)
    ]
    empty = saved(df.limit(0), tmp_path / "e")
    assert exactdedup.exact_dedup(spark, f"{empty}/documents.parquet").count() == 0


def test_exact_dedup_goes_on_where_it_was(spark, tmp_path):
    path, state = str(tmp_path / "t.parquet"), str(tmp_path / "state")
    docs(spark, ["a", "b"], [5, 6]).write.parquet(path)
    exactdedup.ingest(spark, path, state)
    docs(spark, ["a", "c"], [2, 7]).write.mode("append").parquet(path)
    exactdedup.ingest(spark, path, state)
    assert sorted((r["first"].doc_id, r.n) for r in exactdedup.known(spark, state).collect()) == [(2, 2), (6, 1), (7, 1)]
    assert spark.read.parquet(f"{state}/changed").select("batch").distinct().count() == 2


def test_language_model_edges(spark):
    got = {r.doc_id: r for r in ngramlm.lm_scores(docs(spark, ["a b c", "A b d", None, "", "  ", "a b c", "q"]).withColumn("n", F.lit(1)), order=3, bucket=2).collect()}
    assert len(got) == 7 and got[2].n_words == 0 and got[2].log_score == 0 and got[2].mean_log_score is None
    # others hold a b c once and a b twice: c(a) / N, then c(a b) / c(a), then c(a b c) / c(a b)
    assert abs(got[0].log_score - np.log(2 / 7 * 1 * 1 / 2)) < 1e-5 and got[6].n_backoff == 1
    assert ngramlm.lm_scores(docs(spark, [])).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_against_brute_force(spark, order):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", r.text)] for r in rows}
    own = {d: Counter(tuple(w[j - k + 1 : j + 1]) for k in range(1, order + 1) for j in range(k - 1, len(w))) for d, w in words.items()}
    every, n_all = sum(own.values(), Counter()), sum(map(len, words.values()))

    def word_score(d, w, j):
        weight = 1.0
        for k in range(min(order, j + 1), 0, -1):
            g = tuple(w[j - k + 1 : j + 1])
            left = every[g] - own[d][g]
            if k == 1:
                return weight * (left if left > 0 else 0.4) / (n_all - len(w))
            if left > 0:
                return weight * left / (every[g[:-1]] - own[d][g[:-1]])
            weight *= 0.4

    got = {r.doc_id: r for r in ngramlm.lm_scores(spark.read.parquet(f"{SF}/documents.parquet"), order=order, bucket=20_000).collect()}
    assert len(got) == len(rows)
    for d, w in words.items():
        assert got[d].n_words == len(w) and abs(got[d].log_score - sum(np.log(word_score(d, w, j)) for j in range(len(w)))) < 1e-4


def test_toxicity_held_out_and_edges(spark):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(300)]
    bad = ["nastyone", "nastytwo", "nastythree", "nastyfour", "nastyfive", "nastysix"]
    texts, toxic = [], []
    for i in range(800):
        t = list(rng.choice(words, 40))
        toxic.append(i % 5 == 0)
        if i % 5 == 0:
            t += list(rng.choice(bad, 1 + i % 6))
        texts.append(" ".join(t))
    df = docs(spark, texts).repartition(3)
    labels = spark.createDataFrame([(i, int(t), 1) for i, t in enumerate(toxic) if i < 500] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    toxicity.prepare(spark)
    model = toxicity.fit(*(lambda t, y: (t, toxicity.graded(t, y > 0)))(*toxicity.labelled(df, labels, F.col("toxic"), 1000, "doc_id", "text")))
    assert len(model.thresholds) >= 2 and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = range(500, 800)
    assert np.mean([got[i].toxic == toxic[i] for i in held]) > 0.97
    few, many = [[got[i].severity for i in held if toxic[i] and len(set(texts[i].split()) & set(bad)) in k] for k in ({1}, {4, 5, 6})]
    assert np.mean(many) > np.mean(few)
    odd = toxicity.score(docs(spark, [None, "", "nastyone " * 50_000], [None, 1, 2]), model).collect()
    assert len(odd) == 3 and not [r for r in odd if r.doc_id == 1][0].toxic
    kept = toxicity.without_toxic(docs(spark, [None, "fine", " ".join(bad)]).withColumn("toxic", F.lit("clash")), model).collect()
    assert [r.doc_id for r in kept] == [0, 1]
    assert all((r.grade > 0) == r.toxic == (r.severity >= model.cut) for r in got.values())
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(0))).unionByName(labels.withColumn("toxic", F.lit(-1)))
    assert toxicity.labelled(df, twice, F.col("toxic"), 1000, "doc_id", "text")[1].tolist() == toxicity.labelled(df, labels, F.col("toxic"), 1000, "doc_id", "text")[1].tolist()
    assert 0 < sum(map(len, toxicity.labelled(df, labels, F.col("toxic"), 1000, "doc_id", "text", words=2000)[0])) <= 2000
    none = toxicity.fit([], np.zeros(0, np.int64))
    assert not any(r.toxic for r in toxicity.score(docs(spark, ["nastyone"]), none).collect()) and toxicity.score(docs(spark, []), model).count() == 0


def test_fitted_likelihood_against_a_plain_gradient_method():
    rng = np.random.default_rng(8)
    texts = [np.unique(rng.choice(np.arange(1, 25, dtype=np.uint64), 6)) for _ in range(300)]
    grades = np.array([np.clip(int((t < 5).sum() - (t > 20).sum() + rng.integers(0, 2)), 0, 3) for t in texts])
    model = toxicity.fit(texts, grades, rounds=400, held_back=0)

    def loss(weights, cuts):
        score = np.array([sum(weights[w] for w in np.flatnonzero(np.isin(model.words, t))) for t in texts])
        below = np.concatenate([np.zeros((300, 1)), 1 / (1 + np.exp(-(cuts[None] - score[:, None]))), np.ones((300, 1))], 1)
        p = below[np.arange(300), grades + 1] - below[np.arange(300), grades]
        return -np.log(np.maximum(p, 1e-12)).sum() + weights @ weights / 2

    x = np.concatenate([np.zeros(len(model.words)), [-1.0, 0.0, 0.0]])  # weights, a first cut and logarithms of gaps
    value = lambda x: loss(x[:-3], x[-3] + np.concatenate([[0], np.cumsum(np.exp(x[-2:]))]))
    step, now = 0.02, value(x)
    for _ in range(150):
        slope = np.array([(value(x + e) - value(x - e)) / 2e-5 for e in np.eye(len(x)) * 1e-5])
        while (new := value(x - step * slope)) > now and step > 1e-9:
            step /= 2
        x, now, step = x - step * slope, min(new, now), step * 1.5
    assert loss(model.weights, model.thresholds) <= now + 0.01 * abs(now)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, name):
    agree(spark, registry.QUERIES[name], registry.ORACLES[name], SF)
