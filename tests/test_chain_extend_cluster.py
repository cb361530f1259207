import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import chain, cluster, matches
from tests import brute
from tests.test_matches import frame, make, rows


def fragments(seed, n=7):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, k = r.randrange(30), r.randrange(30), r.randint(1, 6)
        out.append((a, a + k - 1, b, b + k - 1, float(k)))
    return out


def best_total(fr, kind):
    best = None
    lo1, lo2, hi1, hi2 = min(f[0] for f in fr), min(f[2] for f in fr), max(f[1] for f in fr), max(f[3] for f in fr)
    for n in range(1, len(fr) + 1):
        for c in itertools.permutations(fr, n):
            total, ok = c[0][4], True
            for x, y in itertools.pairwise(c):
                if kind == "overlaps":
                    ok &= x[0] < y[0] and x[1] < y[1] and x[2] < y[2] and x[3] < y[3]
                    total -= max(0, x[1] - y[0] + 1) + max(0, x[3] - y[2] + 1)
                else:
                    ok &= x[1] < y[0] and x[3] < y[2]
                    if kind in ("gap_cost", "local"):
                        total -= y[0] - x[1] + y[2] - x[3]
                total += y[4]
                if not ok:
                    break
            if ok:
                if kind == "gap_cost":
                    total -= c[0][0] - lo1 + c[0][2] - lo2 + hi1 - c[-1][1] + hi2 - c[-1][3]
                best = total if best is None else max(best, total)
    return best


@pytest.mark.parametrize("kind", chain.KINDS)
@pytest.mark.parametrize("seed", range(4))
def test_best_chain(kind, seed):
    fr = fragments(seed, 6)
    score, path = chain.best_chains(*zip(*fr, strict=True), chain.ChainMode(kind))[0]
    assert score == best_total(fr, kind)
    assert [fr[i][0] for i in path] == sorted(fr[i][0] for i in path)


def test_chain_groups(spark):
    data = [(g, 0, *f) for g in range(40) for f in fragments(g, 5)]
    df = spark.createDataFrame(data, "seq1 long, seq2 long, start1 long, end1 long, start2 long, end2 long, weight double")
    got = chain.chains(df, ["seq1", "seq2"], chain.ChainMode("global")).groupBy("seq1").agg(F.max("score").alias("s")).collect()
    assert {r.seq1: r.s for r in got} == {g: best_total(fragments(g, 5), "global") for g in range(40)}


def test_mode_checks():
    with pytest.raises(ValueError):
        chain.ChainMode("other")
    with pytest.raises(ValueError):
        chain.ChainMode("global", weight_factor=2.0)


def closure(n, edges):
    at = list(range(n))
    for _ in range(n):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    return at


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(60, 90)]
    want = closure(91, edges)
    got = rows(cluster.components(spark.createDataFrame(edges, "a long, b long")))
    assert got == {(i, want[i]) for e in edges for i in e if e[0] != e[1]} 


def test_match_clusters(spark):
    r = random.Random(2)
    a = {i: "".join(r.choices("ab", k=80)) for i in range(3)}
    spans = [(i, r.randrange(3), r.randrange(60), r.randint(6, 20), r.randrange(3), r.randrange(60), r.randint(6, 20)) for i in range(25)]
    df = spark.createDataFrame(spans, "match_id long, seq1 long, pos1 long, len1 long, seq2 long, pos2 long, len2 long")
    ends = {m: ((s, p, p + n), (t, q, q + k)) for m, s, p, n, t, q, k in spans}

    def check(got, linked):
        want = closure(25, [(x, y) for x in ends for y in ends if x < y and linked(x, y)])
        assert rows(got) == set(enumerate(want))

    near = lambda u, v: u[0] == v[0] and max(u[1], v[1]) - min(u[2], v[2]) <= 1
    check(cluster.clusters_by_gap(df, 1), lambda x, y: any(near(u, v) for u in ends[x] for v in ends[y]))
    over = lambda u, v: u[0] == v[0] and min(u[2], v[2]) > max(u[1], v[1]) and 100 * (min(u[2], v[2]) - max(u[1], v[1])) >= 70 * max(u[2] - u[1], v[2] - v[1])
    check(cluster.clusters_by_overlap(df, 70), lambda x, y: any(over(u, v) for u in ends[x] for v in ends[y]))
    text = lambda u: a[u[0]][u[1] : u[2]]
    least = lambda x: min(len(text(u)) for u in ends[x])
    real = {m: tuple((s, p, min(e, 80)) for s, p, e in x) for m, x in ends.items()}
    assert real == ends
    check(cluster.clusters_by_similarity(df, frame(spark, a), 25), lambda x, y: any(brute.edit_distance(text(u), text(v)) <= min(least(x), least(y)) * 25 // 100 for u in ends[x] for v in ends[y]))


def test_threaded(spark):
    a, b = {0: "aaaaccccggggtttt"}, {0: "aaaacxccgggtttt"}
    fr = [(0, 0, 0, 3, 0, 3, 4.0), (0, 0, 12, 15, 11, 14, 4.0)]
    df = spark.createDataFrame(fr, "seq1 long, seq2 long, start1 long, end1 long, start2 long, end2 long, weight double")
    chained = chain.chains(df, ["seq1", "seq2"], chain.ChainMode("global"))
    got = chain.threaded(chained, frame(spark, a), frame(spark, b)).collect()
    assert [tuple(r) for r in got] == [(0, 0, 16, 0, 0, 15, brute.edit_distance("ccccgggg", "cxccggg"))]
    assert chain.threaded(chained, frame(spark, a), frame(spark, b), max_errors=1).count() == 2
