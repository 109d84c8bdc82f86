"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns the columns of documents; the last one returns each document's tokens. Between
stages the documents are written as Parquet and read again, so a lost executor
repeats one stage's tasks at most. Nulls, empty texts, repeated rows and empty tables
are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm import bpe, line_dedup, mixing, near_dup, quality
from duecall.llm.common import documents, written

#: SQL can't express byte-pair merges: the whole pipeline is tested against its stages in plain Python.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars anew, as the text may be shorter."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the rules, without boilerplate lines."""
    return _sized(quality.cleaned(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later runs of lines; documents of which nothing but white space is left go."""
    return _sized(line_dedup.cleaned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 of five-word shingles."""
    return near_dup.representatives(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order."""
    return mixing.training_order(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row."""
    return bpe.tokenised(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-dedup", near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
