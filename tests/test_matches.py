import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import alphabet, scores
from seqloom.operators import complete, filters, intervals, matches, postings, select, tandem
from tests import brute

MATCH = ["seq1", "pos1", "seq2", "pos2", "len"]


def frame(spark, seqs):
    return spark.createDataFrame(sorted(seqs.items()), "seqnum long, seq string").withColumn("len", F.length("seq").cast("long"))


def rows(df, columns=None):
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def make(seed, n=4, size=40, symbols="acgt#"):
    r = random.Random(seed)
    return {i: "".join(r.choices(symbols, weights=[5] * (len(symbols) - 1) + [1], k=r.randint(0, size))) for i in range(n)}


@pytest.mark.parametrize("seed", range(3))
def test_self_and_query_matches(spark, seed):
    a, b = make(seed), make(seed + 100, symbols="acg#")
    assert rows(matches.self_matches(frame(spark, a), 3), MATCH) == brute.self_matches(a, 3)
    assert rows(matches.query_matches(frame(spark, a), frame(spark, b), 3), MATCH) == brute.query_matches(a, b, 3)


@pytest.mark.parametrize("seed", range(2))
def test_repeat_kinds(spark, seed):
    a = make(seed, symbols="ab#")
    df = frame(spark, a)
    assert rows(matches.supermaximal_repeats(df, 2), MATCH) == brute.supermaximal(a, 2)
    assert rows(tandem.tandem_repeats(df, 2), ["seqnum", "pos", "period"]) == brute.tandems(a, 2)


@pytest.mark.parametrize("symbols", ["acg#", "ab#"])
def test_mums(spark, symbols):
    a, b = make(7, symbols=symbols), make(8, symbols=symbols)
    got = rows(matches.mum_candidates(frame(spark, a), frame(spark, b), 3), MATCH)
    every = brute.query_matches(a, b, 3)
    word = lambda m: a[m[0]][m[1] : m[1] + m[4]]
    assert got == {m for m in every if brute.count(a, word(m)) == 1}
    assert rows(matches.mums(frame(spark, a), frame(spark, b), 3), MATCH) == {m for m in got if brute.count(b, word(m)) == 1}


def test_small_mum(spark):
    found = matches.mums(frame(spark, {0: "gattcttcgt"}), frame(spark, {0: "cctcgtgtcg"}), 2)
    assert {(r["len"], r.pos1, r.pos2) for r in found.collect()} == {(2, 4, 1), (4, 6, 2)}


def test_palindromic(spark):
    a = make(5, symbols="acgt#")
    back = {k: s[::-1].translate(str.maketrans("acgt", "tgca")) for k, s in a.items()}
    want = {(s, p, t, len(a[t]) - q - n, n) for s, p, t, q, n in brute.query_matches(a, back, 3)}
    assert rows(matches.palindromic_query_matches(frame(spark, a), frame(spark, a), 3), MATCH) == want
    assert rows(matches.palindromic_self_matches(frame(spark, a), 3), MATCH) == {m for m in want if m[:2] <= m[2:4]}


def test_long_sequences_are_cut_right(spark):
    r = random.Random(1)
    text = "".join(r.choices("abc", k=40_000))
    got = postings.windows(frame(spark, {0: text}), 7)
    assert got.count() == len(text) - 6
    assert {(x.pos, x.kmer) for x in got.where("pos % 997 = 0 OR pos > 39980 OR pos BETWEEN 16370 AND 16390").collect()} == {(i, text[i : i + 7]) for i in range(len(text) - 6) if i % 997 == 0 or i > 39980 or 16370 <= i <= 16390}


def test_absolute_and_gap(spark):
    a = make(9, n=30)
    got = {r.seqnum: r.abs_start for r in matches.absolute(frame(spark, a)).collect()}
    at, want = 0, {}
    for k, s in sorted(a.items()):
        want[k] = at
        at += len(s) + 1
    assert got == want
    for r in matches.with_gap(matches.self_matches(frame(spark, a), 5), frame(spark, a)).collect():
        assert r.gap == want[r.seq2] + r.pos2 - want[r.seq1] - r.pos1 - r["len"]


def test_no_sequences(spark):
    empty = frame(spark, {0: ""}).where("false")
    assert matches.self_matches(empty, 3).count() == 0
    assert matches.absolute(empty).count() == 0
    assert intervals.merged(intervals.marked(matches.self_matches(empty, 3))).count() == 0


def test_complete(spark):
    a, p = make(11, n=5, size=60, symbols="ac#"), {0: "acca", 1: "aaccaa", 2: "caca"}
    df, pat = frame(spark, a), frame(spark, p).drop("len")
    got = rows(complete.exact(df, pat), ["seq1", "pos1", "seq2"])
    assert got == {(k, i, j) for j, w in p.items() for k, i in brute.occurrences(a, w)}
    off = lambda x, y: sum(c != d or c == "#" for c, d in zip(x, y, strict=True))
    got = rows(complete.hamming(df, pat, 1), ["seq1", "pos1", "seq2", "distance"])
    assert got == {(k, i, j, -off(s[i : i + len(w)], w)) for j, w in p.items() for k, s in a.items() for i in range(len(s) - len(w) + 1) if off(s[i : i + len(w)], w) <= 1}


def test_complete_edit(spark):
    a, p = make(12, n=4, size=40, symbols="acg#"), {0: "accag", 1: "gacca"}
    want = {}
    for j, w in p.items():
        for k, s in a.items():
            for i in range(len(s)):
                d, n = min(((brute.edit_distance(w, s[i : i + n]), -n) for n in range(min(len(w) + 1, len(s) - i) + 1)))
                if d <= 1:
                    want[k, i, j] = (-n, d)
    got = {(r.seq1, r.pos1, r.seq2): (r.len1, r.distance) for r in complete.edit(frame(spark, a), frame(spark, p).drop("len"), 1).collect()}
    assert got == want
    kept = complete.without_redundant(complete.edit(frame(spark, a), frame(spark, p).drop("len"), 1))
    places = {(r.seq1, r.seq2, r.pos1) for r in kept.collect()}
    assert all((s, q, p + 1) not in places for s, q, p in places)


def test_as_many_errors_as_characters(spark):
    with pytest.raises(Exception, match="as many errors"):
        complete.hamming(frame(spark, {0: "acgt"}), frame(spark, {0: "ac"}).drop("len"), 2).collect()


def test_score_values(spark):
    one = spark.range(1)
    lit = lambda x: F.lit(x).cast("long")
    got = one.select(
        scores.score(lit(16), lit(16), lit(2)).alias("a"),
        scores.identity(lit(16), lit(16), lit(2)).alias("b"),
        scores.evalue(lit(16), lit(2), scores.multiplier_complete(315339), 4).alias("c"),
        scores.score(lit(4), lit(4), lit(-1)).alias("d"),
        scores.evalue(lit(203), lit(0), scores.multiplier_self(315339), 4).alias("e"),
        scores.score(lit(68), lit(78), lit(10)).alias("f"),
        scores.identity(lit(68), lit(78), lit(10)).alias("g"),
        scores.evalue(lit(517), lit(0), scores.multiplier_self(401976), 4).alias("h"),
    ).first()
    assert (got.a, got.b, got.d, got.f, round(got.g, 2), got.h) == (26, 87.5, -5, 116, 87.18, 0.0)
    assert f"{got.c:.2e}" == "5.71e-01" and f"{got.e:.2e}" == "1.69e-112"


def test_intervals(spark):
    a = make(3, n=6, size=50)
    r = random.Random(4)
    spans = [(k, p, min(len(s), p + r.randint(1, 9))) for k, s in a.items() for p in [r.randrange(len(s)) for _ in range(3)] if s]
    df = spark.createDataFrame(spans, "seqnum long, start long, end long")
    cover = {(k, i) for k, p, e in spans for i in range(p, e)}
    seqs = frame(spark, a)
    got = {(k, i) for k, p, e in rows(intervals.merged(df), ["seqnum", "start", "end"]) for i in range(p, e)}
    assert got == cover
    free = {(k, i) for k, p, n in rows(intervals.unmatched(seqs, df, 1), ["seqnum", "start", "len"]) for i in range(p, p + n)}
    assert free == {(k, i) for k, s in a.items() for i in range(len(s))} - cover
    for how, change in (("X", lambda c: "X"), ("toupper", str.upper)):
        got = {x.seqnum: (x.seq, x.masked) for x in intervals.masked(seqs, df, how).collect()}
        assert got == {k: ("".join(change(c) if (k, i) in cover else c for i, c in enumerate(s)), sum(j == k for j, _ in cover)) for k, s in a.items()}


def test_contained_and_best(spark):
    found = [(0, 5, 10, 1, 5, 10), (0, 6, 4, 1, 6, 4), (0, 6, 4, 1, 60, 4), (0, 6, 4, 1, 60, 4), (2, 6, 4, 1, 6, 4)]
    df = spark.createDataFrame(found, "seq1 long, pos1 long, len1 long, seq2 long, pos2 long, len2 long")
    assert rows(filters.without_contained(df)) == {found[0], found[2], found[4]}
    scored = filters.score_columns(df.withColumn("distance", F.lit(0).cast("long")), F.lit(1e3), 4)
    assert [r.pos2 for r in filters.best(scored, 2).collect()] == [5, 6]
    assert [r.len1 for r in filters.ordered(scored, "ld").collect()][0] == 10


def test_selection(spark):
    a = make(21, n=20)
    seqs = frame(spark, a)
    assert select.random_sequences(seqs, 5).count() == 5
    whole = "|".join(s for _, s in sorted(a.items()))
    parts = {r.seqnum: (r.start, r.seq) for r in select.absolute_range(seqs, 30, 90).collect()}
    assert "|".join(p for _, (_, p) in sorted(parts.items())).strip("|") == whole[30:91].strip("|")
    for r in select.random_substrings(seqs, 30, 2, 5).collect():
        part = a[r.seqnum][r.start : r.start + len(r.seq)]
        assert r.seq == (part[::-1] if r.id % 2 else part)
    taken = select.random_until(seqs, 100).agg(F.sum("len")).first()[0]
    assert taken >= 100


def test_alphabets(spark):
    one = spark.range(1)
    assert one.select(alphabet.DNA.apply(F.lit("ACGTnU"))).first()[0] == "acgt#t"
    with pytest.raises(Exception, match="outside the alphabet"):
        one.select(alphabet.DNA.apply(F.lit("acgx!"))).collect()
    assert one.select(alphabet.DNA.apply(F.lit("ac!"), strict=False)).first()[0] == "ac#"
    assert alphabet.SymbolMap.parse("ab x\ncd\nn\n").pairs() == ("abcdn", "xxcc#")
    assert one.select(alphabet.translate_frame(F.lit("atgaaatagnnncc"), 0)).first()[0] == "MK*X"
    assert alphabet.codon_table(2)["tga"] == "W"
    assert alphabet.all_strings(spark, "ab", 3).count() == 8
    code = alphabet.kmer_code(F.lit("gatta"))
    assert one.select(alphabet.kmer_text(code, 5)).first()[0] == "gatta"


def test_frames_map_back(spark):
    seq = "atgaaacgcttagcgtacgatcgatcgtagc"
    six = {r.frame: r for r in alphabet.six_frames(frame(spark, {0: seq})).collect()}
    back = seq[::-1].translate(str.maketrans("acgt", "tgca"))
    code = alphabet.codon_table()
    for f, r in six.items():
        for pos, n in ((0, 2), (3, 4), (5, 1)):
            start = spark.range(1).select(alphabet.frame_to_dna(F.lit(f), F.lit(pos), F.lit(n), F.lit(len(seq)))).first()[0]
            dna = seq[start : start + 3 * n]
            dna = dna if f < 3 else dna[::-1].translate(str.maketrans("acgt", "tgca"))
            assert "".join(code[dna[i : i + 3]] for i in range(0, 3 * n, 3)) == r.seq[pos : pos + n]
    assert len(back) == len(seq)
