import gzip

import pytest
from pyspark.sql import functions as F

from seqloom.plans.task import Errors, MatchTask, run
from seqloom.sources import readers, writers
from seqloom.streaming import live
from seqloom.operators import matches, postings
from tests.test_matches import MATCH, frame, make, rows


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nAC GT\nacg\n>two\n\n>three\nttt\n")
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">four\r\naa\r\ncc\r\n"))
    got = readers.read_sequences(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")]).orderBy("seqnum").collect()
    assert [(r.seqnum, r.file_no, r.description, r.seq) for r in got] == [(0, 0, "one first", "ACGTacg"), (1, 0, "two", ""), (2, 0, "three", "ttt"), (3, 1, "four", "aacc")]


def test_flat_files_and_plain(spark, tmp_path):
    embl = tmp_path / "x.embl"
    embl.write_text("ID   E1 standard\nDE   some protein\nSQ   sequence 8 bp\n     acgt acgt   8\n//\nID   E2\nDE   other\nSQ   x\n     tt\n//\n")
    bank = tmp_path / "x.gb"
    bank.write_text("LOCUS  G1 8 bp\nDEFINITION  a gene\nORIGIN\n    1 acgtac gt\n//\n")
    plain = tmp_path / "x.txt"
    plain.write_text("some text\nhere")
    got = readers.read_sequences(spark, str(embl)).orderBy("seqnum").collect()
    assert [(r.description, r.seq) for r in got] == [("E1 standard some protein", "acgtacgt"), ("E2 other", "tt")]
    assert [(r.description, r.seq) for r in readers.read_sequences(spark, str(bank)).collect()] == [("G1 8 bp a gene", "acgtacgt")]
    assert [r.seq for r in readers.read_sequences(spark, str(plain)).collect()] == ["some text\nhere"]
    with pytest.raises(ValueError, match="different formats"):
        readers.read_sequences(spark, [str(embl), str(plain)])


def test_match_file_round_trip(spark, tmp_path):
    db = frame(spark, make(1))
    found = run(MatchTask(length=3, symbols=4), db)
    writers.write_matches(found, str(tmp_path / "m"), "-l 3")
    back = readers.read_matches(spark, str(tmp_path / "m"))
    names = ["len1", "seq1", "pos1", "mode", "len2", "seq2", "pos2", "distance", "score"]
    assert rows(back, names) == rows(found, names)
    part = sorted((tmp_path / "m").glob("part-*"))
    assert any(readers.match_file_arguments(spark, str(p)) == "-l 3" for p in part)
    assert spark.range(1).select(F.lit(1)).count() == 1 and "<match>" in found.select(writers.xml_record()).first()[0]


def test_fragments_and_matrix(spark, tmp_path):
    (tmp_path / "f").write_text("# x\n1 5 2 6\n3 4 5 6 9\n")
    got = sorted((r.start1, r.weight) for r in readers.read_fragments(spark, str(tmp_path / "f")).collect())
    assert got == [(1, None), (3, 9.0)]
    assert readers.read_score_matrix("# m\n  A C\nA 2 -1\nC -1 3\n")["A", "C"] == -1


def test_database_ranges(spark):
    df = spark.createDataFrame([("q @ 3 9",), ("q",)], "description string")
    assert {(r["from"], r["to"]) for r in readers.database_ranges(df.where("description LIKE '%@%'")).collect()} == {(3, 9)}
    assert {(r["from"], r["to"]) for r in readers.database_ranges(df).collect()} == {(None, None)}  # all descriptions or none


@pytest.mark.parametrize(
    "options",
    [
        {"length": None}, {"length": 0}, {"kind": "complete", "length": 5}, {"length": 5, "mismatches": Errors(1), "drop": 3}, {"length": 5, "drop": 300},
        {"length": 5, "direct": False}, {"length": 5, "order": "la"}, {"length": 5, "order": "xx", "best": 3}, {"length": 5, "identity": 101}, {"length": 5, "kind": "tandem", "palindromic": True}, {"length": 5, "mismatches": Errors(5, "p")},
    ],
)
def test_task_rules(options):
    with pytest.raises(ValueError):
        MatchTask(**options)


def test_errors():
    assert Errors.parse("10p") == Errors(10, "p")
    for bad in ("0", "101b"):
        with pytest.raises(ValueError):
            Errors.parse(bad)


def test_tasks(spark):
    a, b = make(3), make(4)
    db, query = frame(spark, a), frame(spark, b)
    plain = rows(matches.query_matches(db, query, 4), MATCH)
    got = run(MatchTask(length=4), db, query)
    assert {(r.seq1, r.pos1, r.seq2, r.pos2, r.len1) for r in got.collect()} == plain
    best = run(MatchTask(length=4, best=2, order="la"), db, query).collect()
    assert len(best) <= 2 and [r.len1 for r in best] == sorted(r.len1 for r in best)
    both = run(MatchTask(length=4, palindromic=True), db).groupBy("mode").count().collect()
    assert {r.mode for r in both} <= {"D", "P"}
    pat = frame(spark, {0: "acg", 1: "ttgac"})
    assert all(r.len1 == r.len2 for r in run(MatchTask(kind="complete", mismatches=Errors(1)), db, pat).collect())
    chosen = run(MatchTask(length=4, select=lambda m: m.where("len1 = 4")), db, query)
    assert all(r.len1 == 4 for r in chosen.collect())
    assert run(MatchTask(length=12, mismatches=Errors(2), score=5), db).count() >= 0


def test_stream(spark, tmp_path):
    db = frame(spark, make(3))
    stored = tmp_path / "postings"
    readers.write_postings(postings.postings(db, 4), str(stored), 3)
    queries = make(4)
    source = tmp_path / "in"
    frame(spark, queries).select("seqnum", "seq").write.parquet(str(source))
    stream = spark.readStream.schema("seqnum long, seq string").parquet(str(source))
    out = []
    q = live.match_stream(readers.read_postings(spark, [str(stored)]), stream, 4, lambda df, n: out.extend(tuple(r) for r in df.select(*MATCH).collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert set(out) == rows(matches.query_matches(db, frame(spark, queries), 4), MATCH)
