import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import alignment, extend, matches
from tests import brute
from tests.test_matches import frame, make

BIG = 10**6


def differ(a, b):
    return a != b or a == "#"


def evalue(n, d, symbols=4):
    k, p = abs(d), 1 / symbols
    return math.comb(n, k) * p ** (n - k) * (1 - p) ** (k + 2)


def ways(a, b, errors, longest):
    """(length, mismatches) from the start of a and b that end before a mismatch or with a string."""
    out, n = [], min(len(a), len(b))
    for i in range(n + 1):
        off = [j for j in range(i) if differ(a[j], b[j])]
        runs = [y - x - 1 for x, y in zip(off, [*off[1:], i], strict=False)]
        if (i == n or differ(a[i], b[i])) and len(off) <= errors and not any(r >= longest for r in runs):
            out.append((i, len(off)))
    return out


def hamming_extension(s, m, least, errors, seed):
    p, q, n = m[1], m[3], m[4]
    a, b = s[m[0]], s[m[2]]
    left, right = ways(a[:p][::-1], b[:q][::-1], errors, seed), ways(a[p + n :], b[q + n :], errors, BIG)
    return [(i, j, x + y) for i, x in left for j, y in right if x + y <= errors and i + n + j >= least]


@pytest.mark.parametrize("number", range(3))
def test_hamming_is_the_best_way(spark, number):
    s = make(31 + number, n=6, size=70, symbols="acgt#")
    s[6] = s[0][:30] + "t" + s[0][31:]
    df = frame(spark, s)
    want, every = set(), set()
    for m in brute.self_matches(s, 4):
        found = hamming_extension(s, m, 9, 2, 4)
        every |= {(m[0], m[1] - i, i + m[4] + j, m[2], m[3] - i, i + m[4] + j) for i, j, _ in found}
        if found:
            i, j, d = min(found, key=lambda w: (evalue(w[0] + m[4] + w[1], w[2]), w[2] / (w[0] + m[4] + w[1]), -w[0]))
            want.add((m[0], m[1] - i, i + m[4] + j, m[2], m[3] - i, i + m[4] + j, -d, -(2 * (i + m[4] + j) - 3 * d) if d else 2 * (i + m[4] + j)))
    seeds = matches.self_matches(df, 4)
    got = {tuple(r) for r in extend.extend_hamming(seeds, df, df, 9, 2, seed=4).collect()}
    assert got == want and any(x[6] for x in want)
    inside = lambda x, y: x != y and (x[0], x[3]) == (y[0], y[3]) and y[1] <= x[1] and x[1] + x[2] <= y[1] + y[2] and y[4] <= x[4] and x[4] + x[5] <= y[4] + y[5]
    whole = {tuple(r)[:6] for r in extend.extend_all(seeds, df, df, 9, 2, seed=4).collect()}
    assert whole == {x for x in every if not any(inside(x, y) for y in every)}


def test_one_long_match_beats_bare_seeds(spark):
    r = random.Random(1)
    a = "".join(r.choices("acgt", k=60))
    b = a[:30] + ("a" if a[30] != "a" else "c") + a[31:]
    db, query = frame(spark, {0: a}), frame(spark, {0: b})
    found = extend.extend_hamming(matches.query_matches(db, query, 18), db, query, 18, 2, seed=18)
    assert {(x.len1, x.distance) for x in found.collect()} == {(60, -1), (29, 0)}  # the second seed leaves its left to the first


def edit_points(a, b, errors):
    """Furthest prefixes (x, y) on each diagonal within each number of edits, with that number."""
    table = {(x, y): brute.edit_distance(a[:x], b[:y]) for x in range(len(a) + 1) for y in range(max(0, x - errors), min(len(b), x + errors) + 1)}
    out = set()
    for p in range(errors + 1):
        far = {}
        for (x, y), d in table.items():
            if d <= p:
                far[y - x] = max(far.get(y - x, -1), x)
        out |= {(x, x + k, p) for k, x in far.items()}
    return out


@pytest.mark.parametrize("number", range(2))
def test_edit_is_the_best_way(spark, number):
    a, b = make(71 + number, n=3, size=26), make(81 + number, n=3, size=26)
    b[3] = a[0][:8] + a[0][9:] if len(a[0]) > 12 else "acgt"
    db, query = frame(spark, a), frame(spark, b)
    got = {}
    for r in extend.extend_edit(matches.query_matches(db, query, 3), db, query, 7, 2, seed=BIG).collect():
        x, y = a[r.seq1][r.pos1 : r.pos1 + r.len1], b[r.seq2][r.pos2 : r.pos2 + r.len2]
        assert brute.edit_distance(x, y) <= r.distance <= 2 and min(r.len1, r.len2) >= 7
        got[r.seq1, r.seq2, r.pos1, r.len1, r.pos2, r.len2] = r.distance
    keys = {(k[0], k[1], round(extend.log_evalue(max(k[3], k[5]), d, 4), 9)) for k, d in got.items()}
    want = set()
    for s, p, t, q, n in brute.query_matches(a, b, 3):
        found = []
        for x, y, i in edit_points(a[s][:p][::-1], b[t][:q][::-1], 2):
            for u, v, j in edit_points(a[s][p + n :], b[t][q + n :], 2 - i):
                if min(x + u, y + v) + n >= 7:
                    found.append(extend.log_evalue(n + max(x + u, y + v), i + j, 4))
        if found:
            want.add((s, t, round(min(found), 9)))
    assert keys == want


def test_far_extensions_are_whole(spark):
    r = random.Random(4)
    a = "".join(r.choices("acgt", k=14_000))
    b = list(a)
    for i in range(500, 14_000, 1000):
        b[i] = "a" if b[i] != "a" else "c"
    b = "".join(b)
    db, query = frame(spark, {0: a}), frame(spark, {0: b})
    seeds = matches.query_matches(db, query, 200).where("pos1 > 6000 AND pos1 < 7000")
    by_hamming = extend.extend_hamming(seeds, db, query, 13_990, 20, seed=2000, first=64).collect()
    assert [(x.pos1, x.len1, x.distance) for x in by_hamming] == [(0, 14_000, -14)]
    by_edits = extend.extend_edit(seeds, db, query, 13_990, 15, seed=2000, first=256).collect()
    assert [(x.pos1, x.len1, x.distance) for x in by_edits] == [(0, 14_000, 14)]
    for edits in (False, True):
        found = extend.extend_xdrop(seeds, db, query, 20, edits=edits, seed=2000, first=128).collect()
        assert [(x.pos1, x.len1, abs(x.distance)) for x in found] == [(0, 14_000, 14)]


def test_xdrop_meets_another_seed(spark):
    a = "acgtacgtccacgtgaacgtta"
    b = a[:9] + "t" + a[10:]
    db, query = frame(spark, {0: a}), frame(spark, {0: b})
    found = extend.extend_xdrop(matches.query_matches(db, query, 8), db, query, 5, seed=8).collect()
    assert [(x.pos1, x.len1, x.distance, x.score) for x in found] == [(0, 22, -1, -41)]


def test_xdrop():
    assert extend.xdrop_hamming("aaaa", "aaca", 5) == (4, 5, True)
    assert extend.xdrop_hamming("accccca", "agggggg", 2) == (1, 2, False)
    assert extend.xdrop_hamming("aaaccc", "taaccc", 5, 6) == (6, 9, True)
    assert extend.xdrop_hamming("caaccc", "taaccc", 5, 4) is None
    assert extend.xdrop_edit("acgtacgt", "acgacgt", 6)[:3] == (8, 7, 1)


@pytest.mark.parametrize("seed", range(8))
def test_xdrop_with_indels_finds_the_best_score(seed):
    r = random.Random(seed)
    a, b = ("".join(r.choices("ac#" if seed % 2 else "acgt", k=r.randint(0, 14))) for _ in range(2))
    best = max(x + y - 3 * brute.edit_distance(a[:x], b[:y]) for x in range(len(a) + 1) for y in range(len(b) + 1))
    x, y, edits, score, _ = extend.xdrop_edit(a, b, 255)
    assert score == best == x + y - 3 * edits and brute.edit_distance(a[:x], b[:y]) == edits


def test_no_match_with_itself(spark):
    df = frame(spark, {0: "acacacacacacgtgtgt"})
    for r in extend.extend_edit(matches.self_matches(df, 4), df, df, 5, 1).collect():
        assert r.pos1 < r.pos2 and (r.pos1 + r.len1 <= r.pos2 or r.pos1 + r.len1 < r.pos2 + r.len2)


@pytest.mark.parametrize("seed", range(5))
def test_edit_script(seed):
    r = random.Random(seed)
    a, b = ("".join(r.choices("acg", k=r.randint(0, 15))) for _ in range(2))
    script = alignment.edit_script(a, b)
    assert sum(n for op, n in script if op != "=") == brute.edit_distance(a, b)
    assert sum(n for op, n in script if op != "I") == len(a) and sum(n for op, n in script if op != "D") == len(b)


def local_by_table(a, b, score, gap):
    """The definition over the whole table, start of each cell kept as the latest one."""
    h = {(i, j): (0, i, j) for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            for v, cell in ((h[i - 1, j - 1][0] + score(a[i - 1], b[j - 1]), h[i - 1, j - 1]), (h[i - 1, j][0] + gap, h[i - 1, j]), (h[i, j - 1][0] + gap, h[i, j - 1])):
                if v > 0 and (v, cell[1], cell[2]) > h[i, j] or (v > h[i, j][0]):
                    h[i, j] = (v, cell[1], cell[2])
    (i, j), (v, p, q) = min(h.items(), key=lambda x: (-x[1][0], x[0]))
    return (v, p, i, q, j) if v else (0, 0, 0, 0, 0)


@pytest.mark.parametrize("seed", range(8))
def test_local_alignment(seed):
    assert alignment.local_alignment("ttacgtacgtt", "ggacgtccg") == (11, 2, 9, 2, 9)
    r = random.Random(seed)
    a, b = ("".join(r.choices("acg", k=r.randint(0, 12))) for _ in range(2))
    matrix = {(x, y): r.randint(-3, 3) for x in "acg" for y in "acg"}
    assert alignment.local_alignment(a, b) == local_by_table(a, b, lambda x, y: 2 if x == y else -1, -2)
    got = alignment.local_alignment(a, b, gap=-3, matrix=matrix)
    want = local_by_table(a, b, lambda x, y: matrix[x, y], -3)
    assert got[0] == want[0] and (got[2], got[4]) == (want[2], want[4])


def test_local_alignments(spark):
    df = spark.createDataFrame([(1, 2, "acgt", "ttacgtt"), (3, 4, "", "a")], "seq1 long, seq2 long, text1 string, text2 string")
    assert sorted(tuple(r) for r in alignment.local_alignments(df).collect()) == [(1, 2, 8, 0, 4, 2, 6), (3, 4, 0, 0, 0, 0, 0)]


def test_log_evalue_is_the_column(spark):
    from seqloom.functions import scores

    df = spark.createDataFrame([(20, 0), (30, -3), (40, 5), (60, 25), (2000, 0), (50, 130)], "n long, d long").select("n", "d", scores.log_evalue(F.col("n"), F.col("d"), F.lit(1.0), 4).alias("e"))
    for r in df.collect():
        assert (r.e is None) == (extend.log_evalue(r.n, r.d, 4) == -math.inf) and (r.e is None or abs(r.e - extend.log_evalue(r.n, r.d, 4)) < 1e-9)
