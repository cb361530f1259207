"""A corpus from `documents`: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all rows that the one before kept. The last returns each document as often as the mix takes it.

A null text is an empty text: the classifier scores it like any other, and the mix never takes it. A null id is kept by
every stage, and a null source is a source of its own. Rows that repeat an id: one of them stays, the one with the least
text, in near_duplicates. Ties: the least id of a group stays, and of a shared line's holders the least id keeps it. Long
texts are worked on whole. Empty tables give an empty table. Further columns are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common, decontaminate, fm_quality, line_dedup, mixing, near_copies


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its cutoff or above."""
    machine = fm_quality.train(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "quality", ("n_chars",))
    return fm_quality.keep_good(docs, machine, "text", ("n_chars",))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    return line_dedup.drop_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_copies.keep_first(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for, with copy_number."""
    return mixing.mixed_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("mixture", mixture)]

#: The classifier and the shingles have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the table `documents`."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs)
    return docs
