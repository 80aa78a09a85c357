"""Cleaning a text corpus for training: quality rules, near-duplicates, shared passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it
again as the next one's docs, and deletes what was written before.

Cases, in all stages: null and empty texts, and texts without words, fail the quality rules and
go there; in the later stages they are documents like any other, but have no shingles or words
to share (texts without any are near-duplicates of each other) and pack as an end id. Ties go to the smallest doc_id.
A row repeated with id and text is kept once by near_duplicates; rows without an id are never
dropped there, and rows that share one are judged by their own texts. Empty tables give no rows.
Columns besides doc_id and text pass through, whatever their names; n_chars, if there, is
counted anew where a text is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockframe.llm.common import discard, table, written
from blockframe.llm.decontamination import drop_contaminated
from blockframe.llm.fertility import keep_quality
from blockframe.llm.packing import pack
from blockframe.llm.simhash import keep_similar
from blockframe.llm.substrings import cut_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id: five-word shingles, a similarity of 0.8 or more."""
    return keep_similar(docs, similarity=0.8, n=5)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in a document with a smaller id."""
    return cut_texts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item: here one leaked passage is one too many."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("packing", packing)]

#: tokenisers and fingerprints are beyond SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir))
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
