"""Rows without an id, extra columns with clashing names and very long texts in the queries of op2, op5, op6 and op8."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import registry
from tidemark.llm.bpe import Transducer


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("null-ids"))
    long = "\n".join(f"line {k % 977} of a long page {k}" for k in range(12_000))
    rows = [(1, "a text of some words"), (None, "a text of some words"), (None, None), (2, ""), (3, long), (4, "a text of some words\nline 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    df.withColumns({"n": F.lit(1), "bucket": F.lit("x"), "block": F.lit(None).cast("string"), "media": F.lit(1), "line": F.lit(0)}).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op2_telephony_media", "op5_site_line_dedup", "op6_bpe_transducer", "op8_backoff_lm"])
def test_rows_without_ids_and_long_texts(spark, folder, name):
    rows = registry.QUERIES[name](spark, folder).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 0, 1, 2, 3, 4]
    if name in ("op2_telephony_media", "op6_bpe_transducer"):  # equal texts, equal values
        same = [tuple(v for k, v in r.asDict().items() if k != "doc_id") for r in rows if r.doc_id in (1, None)]
        assert len(same) == 3 and len(set(same)) == 2


def test_transducer_parts_words_at_ascii_white_space_only():
    transducer = Transducer.of(public_tokenizers.path("word_bpe_49k.json")) if hasattr(Transducer, "of") else Transducer(public_tokenizers.path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    parts = ["a", "word", " ", "\t", "\x1c", "\x1f", " ", " ", "é", "12", ",", "Ж"]
    for _ in range(200):
        text = "".join(rng.choice(parts, 8))
        assert transducer.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)
