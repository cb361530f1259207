"""Writers and row numbers: no task and no folder gets more than its share."""

import gzip

import pytest
from pyspark.sql import functions as F

from seqloom import registry, registry_files
from seqloom.operators import matches
from seqloom.sources import readers, writers
from seqloom.util import row_numbers
from tests.test_matches import frame, make, rows

PLACE = ["seq1", "pos1", "seq2", "pos2", "len1"]


def test_compressed_xml(spark, tmp_path):
    found = matches.self_matches(frame(spark, make(3)), 3).withColumnRenamed("len", "len1")
    writers.write_xml(found, str(tmp_path / "x"), "gzip")
    files = list((tmp_path / "x").glob("part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    back = spark.read.format("xml").option("rowTag", "match").schema(", ".join(f"{c} long" for c in PLACE)).load(str(tmp_path / "x"))
    assert rows(back, PLACE) == rows(found, PLACE)


def test_every_file_of_matches_begins_with_the_arguments(spark, tmp_path, monkeypatch):
    # some tasks have no row
    found = spark.range(0, 60, 1, 6).where("id < 20 OR id >= 30").select(*[F.col("id").alias(c) for c in ("len1", "seq1", "pos1", "len2", "seq2", "pos2", "score")], F.lit("D").alias("mode"), F.lit(0).cast("long").alias("distance"), F.lit(0.5).alias("evalue"), F.lit(100.0).alias("identity"))
    monkeypatch.setattr(registry_files, "_full", lambda spark, d: found)
    monkeypatch.setattr(registry_files, "_folder", lambda spark, name: str(tmp_path / name))
    assert registry.QUERIES["sink_match_arguments"](spark, "").first()[0] == "-l 30"
    texts = [t for f in (tmp_path / "arguments").glob("part-*") if (t := gzip.open(f, "rt").read())]
    assert len(texts) == 5  # each task writes what it has
    assert all(t.startswith("# args=-l 30\n") and t.count("#") == 1 for t in texts)
    assert rows(readers.read_matches(spark, str(tmp_path / "arguments")), ["seq1"]) == rows(found, ["seq1"])


def test_row_numbers_without_a_second_shuffle(spark):
    df = spark.range(0, 1000, 1, 5).select((F.col("id") * 7919 % 1000).alias("a"), F.col("id").alias("b"))
    out = row_numbers(df, ["a", "b"])
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(__part") == 1  # of the counts
    assert {(r.a, r.before) for r in out.collect()} == {(i, i) for i in range(1000)}
    sums = row_numbers(df, ["a", "b"], F.lit(3), parts=4).collect()
    assert {(r.a, r.before) for r in sums} == {(i, 3 * i) for i in range(1000)}


@pytest.mark.parametrize("name", ["match_orders"])
def test_orders_are_written_once_for_each_key(spark, tmp_path, monkeypatch, name):
    from seqloom import util

    calls, own = [], util.row_numbers
    monkeypatch.setattr(util, "row_numbers", lambda df, *a, **b: calls.append(1) or own(df, *a, **b))
    text = "abcdefghijklmnopqrstuvwxyz0123456789"
    spark.createDataFrame([(1, i, "u", t) for i, t in enumerate([text, "x" + text, text[2:] + "y"])], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(calls) == 7
    assert len({r.sorting for r in got}) == 12 and all(sorted(r.place for r in got if r.sorting == s) == [1, 2, 3] for s in {r.sorting for r in got})
