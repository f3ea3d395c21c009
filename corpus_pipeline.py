"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing and tokens, one operator a stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet in the shared folder and read again as the next one's docs.

Defined results: a null or empty text has the bias's score, no near-duplicates, no secrets and no
tokens, and stays until the mix takes or leaves it; a row with a null doc_id is scored, never a
near-duplicate's representative, and kept; rows that share a doc_id (repeated rows among them) are
kept or dropped together by near-dedup and the mix; null lang or source is a branch `(none)`; extra
columns of documents end with the first stage (COLUMNS go on); empty tables give empty tables; a
document that the mix takes in two epochs comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import mixing, near_dedup, secrets_scan, sentencepiece_table, toxicity
from vellum.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < 0.5).select(*COLUMNS)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id. Ids go through the operator, texts are read once more to keep the rest."""
    dropped = near_dedup.near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; no document goes. n_chars follows the text."""
    return secrets_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The budget's share of each leaf; a document of two epochs comes twice."""
    return mixing.select(docs, mixing.TARGET).select(*COLUMNS)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token count and digests."""
    return sentencepiece_table.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _toxicity),
    ("near_dedup", _near_dedup),
    ("secrets", _secrets),
    ("mixing", _mixing),
    ("tokens", _tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the learner, the signatures or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
