"""The corpus pipeline: documents without toxic ones, boilerplate lines and near copies, personal data masked, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, the last one the pieces and their places.
The result of each is written as Parquet to the cluster's shared store and read again. The order puts what drops whole documents at little
cost first; near copies are sought after boilerplate is gone. Stages keep rows with nulls: a null text counts as empty where it is
judged and stays null, a row without an id is never a near copy. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import boilerplate, neardup, packing, pii, toxicity
from tidemark.llm.common import stored

#: The pipeline ends with token ids of this vocabulary (a path of the tokenizer package), each document ending with this id.
VOCABULARY, END_ID, SEQUENCE = "word_bpe_49k.json", 1, 4096
#: Chunks whose ids a worker keeps in mind: the workers of all stages live side by side in an executor's memory.
REMEMBERED = 60_000
#: A line on more than this share of a source's pages is boilerplate: shared lines stand on about a tenth of every source's pages, and
#: chance must not decide on which sources they go (on 500 pages half the share is more than five standard deviations below it).
LINE_RATIO = 0.05


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars brought up to date where there is such a column."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the fitted cut."""
    return toxicity.without_toxic(docs, toxicity.trained(spark, docs, sf_dir))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than LINE_RATIO of their source's different texts share."""
    return _measured(boilerplate.line_dedup(docs, "source", ratio=LINE_RATIO), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8."""
    return neardup.without_near_duplicates(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _measured(pii.redact(docs), docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path(VOCABULARY), END_ID, SEQUENCE, REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", mask_pii),
    ("best_fit_packing", pack_tokens),
]

#: SQL can express neither the fitted model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
