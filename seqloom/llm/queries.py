"""Queries over the whole tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, fm_quality, html_extract, line_dedup, mixing, pii, quality_rules, quotes, simhash, token_count
from seqloom.llm import oracles as sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sha(text: Column | str) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", _sha(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha(F.col("text")).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    machine = fm_quality.train(docs, _read(spark, sf_dir, "labels"), "doc_id", "text", "quality", ("n_chars",))
    return fm_quality.score_documents(docs, machine, metadata=("n_chars",))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(_read(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in pii.BASE]
    return out.select("doc_id", *counts, _sha(pii.listed(F.col("base"))).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.link_quotes(_read(spark, sf_dir, "conversations"))
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.train(pages))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_quotes": op5_quotes,
    "op6_simhash": op6_simhash,
    "op7_html_text": op7_html_text,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": sql.DECONTAMINATE,
    "op2_line_dedup": sql.LINE_DEDUP,
}
