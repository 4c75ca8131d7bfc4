"""Corpus pipeline: quality, exact dedup, near dedup, decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each
stage's rows to the shared folder and rereads them, and drops what no stage reads any more. All but the last return
the columns of documents.

Edge cases, in every stage: a null text counts as empty; repeated rows of one id and text are one document from exact dedup
on; ties go to the smallest id; rows without id are judged by their text and are never linked or found contaminated;
an empty table gives an empty result; extra columns are kept, whatever their names, except in the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from bitweft.session import Workspace, table, without


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the rated documents among docs and keeps rows with P(grade = good) >= 0.5."""
    return quality.select(docs, quality.fit(docs, quality.ratings(spark, sf_dir), 3), least_grade=2)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents with a similarity of 0.8 or more on five-word shingles stays (five words is
    the rule for stages on shingles; the query on near duplicates has a contract of its own, with four)."""
    return near_dedup.survivors(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, a passage or an edited copy of one go."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, "doc_id", Workspace(spark, "leaks").put(found.select("id").distinct(), "gone"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return bpe.roundtrip(docs, bpe.vocabulary()).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("bpe encoding and decoding", tokenize),
]

#: The classifier and the tokenizer have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, ws.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        ws.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
