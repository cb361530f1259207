"""Near copies by shingles against brute force."""

import random

import pytest

import corpus_pipeline
from seqloom.llm import near_copies

SCHEMA = "doc_id long, text string, extra string"


def slow_set(text):
    words = (text or "").lower().split()
    n = len(words)
    return {tuple(words[i : i + 5]) for i in range(n - 4)} if n > 5 else {tuple(words)} if n else set()


def slow_least(texts):
    sets = [slow_set(t) for t in texts]
    least = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    return least


def planted(r):
    """Groups of texts with some changed words, around a similarity of 0.8, and one large group."""
    out = []
    common = " ".join("c%d" % i for i in range(12))
    for size in [2] * 10 + [3] * 5 + [40]:
        base = ["w%d" % r.randrange(400) for _ in range(r.randint(40, 200))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, len(base) // 35)):
                own[r.randrange(len(base))] = "w%d" % r.randrange(400)
            out.append(" ".join(own) + (" " + common if r.random() < 0.5 else ""))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"max_group": 3, "block": 4}])
def test_components(spark, options):
    texts = [None, "", " \n", *planted(random.Random(8)), "a b", "A  b", "a b c", "a b c d e", "a b c d e", "a b c d e f"]
    least = slow_least(texts)
    assert 10 < len(set(least)) < len(texts) - 20
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {x.doc_id: x.component_id for x in near_copies.near_copy_components(df, **options).collect()}
    assert got == dict(enumerate(least))
    kept = near_copies.keep_first(df, **options)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(least))


def test_odd_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "something else entirely here"), (None, "a b c d"), (None, "q"), (3, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_copies.near_copy_components(df).count() == len(rows)
    assert sorted((x.doc_id or 0, x.text) for x in near_copies.keep_first(df).collect()) == [(0, "a b c d"), (0, "q"), (1, "a b c d")]
    assert near_copies.keep_first(df.limit(0)).count() == 0


def test_pipeline_stage(spark):
    r = random.Random(3)
    rows = []
    for g in range(6):
        base = ["w%d" % r.randrange(5000) for _ in range(300)]
        other = list(base)
        for k in (40, 120, 200, 260):
            other[k] = "changed"
        rows += [(2 * g, " ".join(base), ""), (2 * g + 1, " ".join(other), "")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(x.doc_id for x in kept.collect()) == [0, 2, 4, 6, 8, 10]
