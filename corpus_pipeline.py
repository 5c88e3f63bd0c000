"""The corpus pipeline: toxic documents go, one document of each near-duplicate
group stays, repeated passages are cut, documents with benchmark items go, and what
is left is encoded into pieces.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm import decontaminate, jaccard, pieces, suffix, toxicity
from hopweave.llm.common import table, written
from hopweave.llm.queries import PIECES

#: Near-duplicates: word shingles of five words, a similarity of 80 percent or more.
WIDTH, PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Null and empty texts stay."""
    model = toxicity.chain_of(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(~toxicity.rejected(F.col("text"), F.col("p_toxic"))).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; documents without a word all stay."""
    return jaccard.keep_one(docs, WIDTH, PERCENT)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a repeated 200-byte string covers are cut from ``text``; ``n_chars`` follows. All documents stay."""
    return suffix.deduplicate(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, best_score, n_best and alternatives of each document."""
    return pieces.encode(docs.select("doc_id", "text"), PIECES, 4).select("doc_id", "ids", "best_score", "n_best", "alternatives")


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", pieces_stage),
]

#: The classifier and the piece lattice are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
