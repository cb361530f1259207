"""The queries, and the pipeline with its stages, on a small copy of the tables."""

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from seqloom.llm import queries
from tests.llm.test_units import brute_marks, slow_fingerprint


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    r = random.Random(5)
    text = lambda n: " ".join("w%d" % r.randrange(400) for _ in range(n)) + "."
    items = [(i, text(25)) for i in range(6)]
    texts = []
    for i in range(240):
        t = "\n".join(text(r.randint(8, 30)) for _ in range(r.randint(2, 6)))
        texts.append("BUY NOW!! | " * 25 if i % 6 == 5 else t)
    texts[20] = texts[10]
    texts[31] = texts[30].replace(" w1", " w2", 1)
    texts[40] += "\n" + items[2][1]
    texts[50] += "\n" + texts[49].split("\n")[0]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)] + [(240, None, None, None, None), (241, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, 0, "u", "hello there"), (0, 1, "a", "> hello there\nhi")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(0, "u", "<article><p>a b</p></article>")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d), dict((r[0], r[1]) for r in rows), items


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    got = queries.QUERIES[name](spark, tables[0])
    key = {"op5_quotes": "conv_id", "op7_html_text": "page_id"}.get(name, "doc_id")
    assert key in got.columns
    assert got.count() == {"op5_quotes": 2, "op7_html_text": 1}.get(name, len(tables[1]))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables[0]}/{t}.parquet/*.parquet')")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, tables[0]).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").reset_index(drop=True).equals(want.sort_values("doc_id").reset_index(drop=True).astype(got.dtypes))


def test_pipeline(spark, tables):
    d, texts, items = tables
    frame = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "benchmarks", "mixture"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, d)
        rows = seen[name] = [r.asDict() for r in frame.collect()]
        frame = spark.createDataFrame([tuple(r[c] for c in frame.columns) for r in rows], frame.schema)
        if k < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {r["doc_id"] for r in seen["quality"]}
    assert not any(i % 6 == 5 for i in good if i < 240) and len(good) > 190
    kept = {r["doc_id"]: r["text"] for r in seen["lines"]}
    assert set(kept) == good and texts[49].split("\n")[0] not in kept.get(50, "")
    left = {r["doc_id"]: r["text"] for r in seen["near_duplicates"]}
    prints = {i: slow_fingerprint((t or "").encode()) for i, t in kept.items()}
    for i in kept:
        near = [j for j in kept if j < i and (prints[i] ^ prints[j]).bit_count() <= 2]
        assert (i in left) == (not near)
    known = [(str(i), t) for i, t in items]
    assert {r["doc_id"] for r in seen["benchmarks"]} == {i for i, t in left.items() if not brute_marks(t, known)[1]}
    assert 40 not in {r["doc_id"] for r in seen["benchmarks"]}
    copies = {}
    for r in seen["mixture"]:
        copies.setdefault(r["doc_id"], []).append(r["copy_number"])
    assert all(sorted(c) in ([1], [1, 2]) for c in copies.values())
    assert corpus_pipeline.run(spark, d).count() == len(seen["mixture"])
