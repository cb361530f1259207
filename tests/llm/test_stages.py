"""Stages that hand on documents: clashing names, repeated rows, nulls, empty tables, very long texts."""

import os

import pytest
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, fm_quality, line_dedup, mixing, near_copies, quality_rules, simhash
from tests.llm.test_operators import docs, sentence

CLASH = "__id __hash __lines __text __drop __kept __own __again __row __size __copies row key hash id text2 copy src own words size c0 component_id fp hits spans items place a.b `x`".split()
STAGES = {
    "lines": lambda df, bench: line_dedup.drop_shared_lines(df),
    "near": lambda df, bench: near_copies.keep_first(df),
    "simhash": lambda df, bench: simhash.keep_first(df),
    "clean": lambda df, bench: decontaminate.clean_documents(df, bench),
    "mix": lambda df, bench: mixing.mixed_documents(df).drop("copy_number"),
    "good": lambda df, bench: fm_quality.keep_good(df, fm_quality.train(df, df.selectExpr("doc_id", "1 AS quality"), "doc_id", "text", "quality", ("n_chars",)), "text", ("n_chars",)),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_leave_other_columns_alone(spark, name):
    import random

    r = random.Random(1)
    texts = [None, "", "one\n" + "x " * 60_000, *[sentence(r, 30, 400) for _ in range(12)]]
    bench = spark.createDataFrame([(1, sentence(r, 20, 400)), (2, None)], "item_id long, text string")
    plain = docs(spark, texts)
    plain = plain.union(plain.where("doc_id = 5"))  # a repeated row
    wide = plain.select("*", *[F.concat(F.lit(c + "="), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in CLASH])
    got = STAGES[name](wide, bench)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(x[c] == f"{c}={x.doc_id}" for x in rows for c in CLASH)
    want = STAGES[name](plain, bench).collect()
    assert sorted(repr(tuple(x)[:5]) for x in rows) == sorted(repr(tuple(x)) for x in want)
    assert STAGES[name](wide.limit(0), bench.limit(0)).count() == 0


def test_mix_of_equal_ids_in_several_sources(spark):
    rows = [(i % 40, "w " * (1 + i % 7), f"s{i // 40}") for i in range(200)] + [(None, "a b c", None), (None, "a b c", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = mixing.mix(df).agg(F.sum("copies")).first()[0]
    got = mixing.mixed_documents(df.withColumn("copy_number", F.lit("old")))
    assert got.count() == want and got.columns == ["doc_id", "text", "source", "copy_number"]
    counts = {(x.doc_id, x.text, x.source): x.n for x in got.groupBy("doc_id", "text", "source").agg(F.count("*").alias("n")).collect()}
    size = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    for x in mixing.mix(df.withColumn("text", F.concat("text", F.lit("")))).collect():
        assert x.copies <= 2
    by_source = {x.source: x.n for x in got.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    told = mixing.mix(df).join(df.select("source", F.col("doc_id"), size.alias("n")).distinct(), F.lit(False), "left").agg(F.sum("taken")).first()[0]
    assert sum(by_source.values()) == told and max(counts.values()) <= 2


def test_unsettled_sources_are_told(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    df = spark.createDataFrame([(i, "w " * (1 + i * i), f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    with pytest.warns(UserWarning, match="not settled"):
        mixing.mix(df).count()


def test_a_repeated_id_trains_once(spark):
    df = docs(spark, ["good text here", "bad bad bad"])
    many = df.union(df).union(df)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    a, b = (fm_quality.train(x, labels, "doc_id", "text", "quality") for x in (df, many))
    assert (a.w == b.w).all() and a.bias == b.bias


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    from seqloom.llm.queries import op3_quality

    rows = op3_quality(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = ([x.score for x in rows if x.quality == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert len(good) > 50 and len(bad) > 5 and wins / (len(good) * len(bad)) > 0.97


def test_long_texts_in_rules(spark):
    df = docs(spark, ["#" * 500_000, "line\n" * 50_000])
    got = quality_rules.stats(df, "text", ("doc_id",)).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got] == [(1, 500_000, 0, 0), (50_000, 0, 49_999, 50_000)]
