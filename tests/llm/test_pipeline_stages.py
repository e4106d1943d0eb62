"""What the pipeline's stages must take out, on planted cases; what a query must store."""

import math
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import telephony

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_line_shared_by_all_sources_goes_from_each(spark):
    shares = {"a": 17, "b": 20, "c": 26}  # of 200 pages: around a tenth, as shared lines have it by chance
    rows = [(k, f"body {s} {k}\nfoot" * (k < n) + f"\nown {s} {k}\nmore {k}" + "\noften" * (k < 8), None, s, 1) for s, n in shares.items() for k in range(200)]
    got = corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    lines = [line for r in got for line in r.text.split("\n")]
    assert len(got) == 600 and lines.count("foot") == 0 and lines.count("often") == 24
    assert all(f"own {r.source} {r.doc_id}" in r.text and r.n_chars == len(r.text) for r in got)


def test_boilerplate_goes_from_pages_of_any_share_and_copies_are_no_template(spark):
    texts = [f"menu\nbody {k}\nfoot\nlicence" for k in range(20)] + ["menu\nmenu\nshort", "menu"] + ["a copied page\nof two lines"] * 20
    rows = [(k, t, None, "a", 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert [got[k] for k in range(20)] == [f"body {k}" for k in range(20)] and got[20] == "short" and got[21] == ""
    assert all(got[k] == texts[k] for k in range(22, 42))


def test_words_on_either_side_of_a_number_count(spark):
    far = "x" * 48
    texts = ["123-45-6789 is my SSN", "ssn 123-45-6789 but 987-65-4321", f"ssn{far}123-45-6789{far}ssn", "ä ssn" + far[3:] + "123-45-6789", "no word 123-45-6789", None]
    rows = [(k, t, None, "a", 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in corpus_pipeline.mask_pii(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert [got[k] for k in range(6)] == ["[SSN] is my SSN", "ssn [SSN] but [SSN]", texts[2], "ä ssn" + far[3:] + "[SSN]", texts[4], None]


def test_telephony_query_returns_its_resampled_sounds(spark, tmp_path):
    texts = {1: "Hello", 2: None, 3: "wörld " * 400}
    spark.createDataFrame([(k, t, None, "a", 1) for k, t in texts.items()], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = telephony.telephony_query(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        data = telephony.payload((texts[r.doc_id] or "").encode())
        samples = [telephony.decode([telephony.wav(data, kind)], telephony.QUERY_RATE)[0] for kind in (telephony.MULAW, telephony.ALAW, telephony.ADPCM)]
        for x, kept in zip(samples, (r.pcm_mulaw, r.pcm_alaw, r.pcm_adpcm)):
            assert telephony.parse(bytes(kept)) == (telephony.PCM, telephony.QUERY_RATE, x.astype("<i2").tobytes())
        assert r.feature == "|".join(map(telephony.describe, samples))


def plain_resampled(signal, rate, target):
    """Sample by sample: for each place of the new rate a weighted sum of twelve samples around it, in whole numbers."""
    common = math.gcd(rate, target)
    up, down, half = target // common, rate // common, 6
    out = []
    for k in range(-(-len(signal) * up // down)):
        at, phase = divmod(k * down, up)
        weights = []
        for j in range(-half, half):
            t = j + 1 - phase / up
            width = min(1, up / down)
            x = width * t
            weights.append(width * (math.sin(math.pi * x) / (math.pi * x) if x else 1.0) * (0.5 + 0.5 * math.cos(math.pi * max(-1, min(1, t / half)))))
        fixed = [round(w / sum(weights) * 16384) for w in weights]
        fixed[max(range(2 * half), key=lambda j: abs(weights[j]))] += 16384 - sum(fixed)
        total = sum(w * (int(signal[at + 1 + j]) if 0 <= at + 1 + j < len(signal) else 0) for w, j in zip(fixed, range(-half, half)))
        out.append(max(-32768, min(32767, (total + 8192) >> 14)))
    return out


@pytest.mark.parametrize("target", [4000, 8000, 16000])
def test_resampling_against_a_plain_form(target):
    signals = [np.random.default_rng(k).integers(-32768, 32768, n).astype(np.int16) for k, n in enumerate((0, 1, 7, 64, 333))]
    for signal, made in zip(signals, telephony.resample(signals, 8000, target), strict=True):
        assert made.tolist() == plain_resampled(signal, 8000, target)


def test_feature_against_a_plain_form():
    for x in ([], [0], [-5, 3, 3, -1, 0, 7]):
        size, turns = [abs(v) for v in x], sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        want = f"{len(x)}:{sum(size) // max(1, len(x))}:{max(size, default=0)}:{turns}:{zlib.crc32(struct.pack(f'<{len(x)}h', *x)):08x}"
        assert telephony.describe(np.array(x, np.int16)) == want
