"""From raw documents to packed sequences: quality rules, line and near-duplicate removal, decontamination, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Every stage reads all
that the one before has written. Texts are read whole, further columns are kept by all but the last whatever their names, and an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, lines, packing, quality, similar
from tallyframe.llm.common import table, written
from tallyframe.shared import reach_workers


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules. A null, empty or short text is rejected; a null doc_id is no reason. Equal rows are judged alike."""
    reach_workers(spark)
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, n_chars follows; a document without a word left goes as a whole, so one with a null or empty text does.
    A null doc_id comes after all others. Equal rows are one document, in as many rows."""
    reach_workers(spark)
    kept = lines.without_repeats(docs).select(*docs.columns).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more. The smallest doc_id stays, null last; of rows
    equal in id and text one. Documents without words are in no group and stay."""
    reach_workers(spark)
    return similar.one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window occurs in. A null or empty text holds none and stays; equal rows stay or go together."""
    reach_workers(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens at most. A null or empty text is a document of its end token; each of equal rows is packed."""
    reach_workers(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("retrieval_packing", retrieval_packing)]

#: Suffix arrays, components and retrieval are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
