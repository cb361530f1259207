import random

import pytest
from pyspark.sql import functions as F

from seqloom import registry
from seqloom.operators import mass, matches, unique, userfunctions
from tests import brute
from tests.test_matches import frame, make, rows


def test_minimum_unique_prefixes(spark):
    a, b = make(41, n=3, size=60, symbols="ab#"), make(42, n=3, size=30, symbols="ab#")
    got = {(r.seqnum, r.pos): r.length for r in unique.minimum_unique_prefixes(frame(spark, a), frame(spark, b), 2, 7).collect()}
    want = {}
    for k, s in b.items():
        for i in range(len(s)):
            for n in range(1, 8):
                w = s[i : i + n]
                if len(w) == n and "#" not in w and brute.count(a, w) == 1:
                    if n >= 2:
                        want[k, i] = n
                    break
    assert got == want


def test_profile(spark):
    a = make(43, symbols="acgt#")
    profile = [{"a": 1.0, "c": 2.0, "g": 0.0, "t": -1.0}, {"a": 0.5, "c": 0.0, "g": 3.0, "t": 1.0}]
    got = rows(unique.profile_search(frame(spark, a), profile, 2.0))
    assert got == {(k, i, sum(p[c] for p, c in zip(profile, s[i : i + 2], strict=True))) for k, s in a.items() for i in range(len(s) - 1) if "#" not in s[i : i + 2] and sum(p[c] for p, c in zip(profile, s[i : i + 2], strict=True)) >= 2.0}


@pytest.mark.parametrize("text", ["", "a", "banana", "mississippi", "aaaa"])
def test_burrows_wheeler(text):
    last, row = unique.burrows_wheeler(text)
    assert unique.burrows_wheeler_back(last, row) == text


def test_mass_search(spark):
    r = random.Random(3)
    data = {k: [r.randint(1, 9) for _ in range(12)] for k in range(4)}
    df = spark.createDataFrame([(k, i, m) for k, ms in data.items() for i, m in enumerate(ms)], "k long, i long, m long")
    got = rows(mass.mass_search(df, "k", "i", "m", 15))
    assert got == {(k, i, j) for k, ms in data.items() for i in range(12) for j in range(i, 12) if sum(ms[i : j + 1]) == 15}


def test_user_functions(spark):
    a, b = make(51, size=50, symbols="acgt"), make(52, size=50, symbols="acgt")
    db, query = frame(spark, a), frame(spark, b)
    found = matches.query_matches(db, query, 3).withColumns({"len1": F.col("len"), "len2": F.col("len")}).select("seq1", "pos1", "len1", "seq2", "pos2", "len2")
    every = rows(found)
    assert rows(userfunctions.touching_an_end(found, db)) == {m for m in every if m[1] == 0 or m[1] + m[2] == len(a[m[0]])}
    left = lambda m, k: (m[1] > k and m[4] > k) or (len(a[m[0]]) - m[1] - m[2] > k and len(b[m[3]]) - m[4] - m[5] > k)
    assert rows(userfunctions.end_to_end(found, db, query, 10)) == {m for m in every if not left(m, 10)}
    merged = userfunctions.merged_matches(found, 10).collect()
    assert all(any(x.seq1 == m[0] and x.seq2 == m[3] and x.pos1 <= m[1] and m[1] + m[2] <= x.pos1 + x.len1 for x in merged) for m in every)
    bundle = userfunctions.Bundle(keep=lambda m, most: userfunctions.at_most(m, most), prepare=lambda d, q: 3, finish=lambda m, _: m.groupBy("seq1").count())
    assert sum(r["count"] for r in bundle.apply(found, db, query).collect()) == sum(m[2] <= 3 for m in every)


def test_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.ORACLES) > 60
