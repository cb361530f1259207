"""Operators against brute force, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import components, decontaminate, fm_quality, html_extract, line_dedup, mixing, pii, quality_rules, quotes, simhash, token_count
from tests.llm.test_units import brute_marks, slow_fingerprint, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=""):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *extra.split(";")) if extra else df


def sentence(r, n, kinds=30):
    return " ".join("w%d" % r.randrange(kinds) for _ in range(n))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1


@pytest.mark.parametrize("bits", [decontaminate.BITS, 2])
def test_decontaminate(spark, bits):
    r = random.Random(1)
    items = [(i, sentence(r, n)) for i, n in enumerate([0, 1, 4, 10, 25, 30])] + [(6, None), (None, "w1 w2"), (4, "w1 w1 w1")]
    texts = [None, "", *[sentence(r, 40) for _ in range(5)], sentence(r, 9) + " " + items[4][1].upper() + " " + sentence(r, 30), items[5][1], items[5][1]]
    df = docs(spark, texts, "1 AS n_words;'x' AS items;3 AS key;4 AS hash;5 AS row;'y' AS hits")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df.union(df.limit(0)), bench, bits=bits)
    known = [(str(i), t) for i, t in items if i is not None]
    want = {i: brute_marks(t, known) for i, t in enumerate(texts)}
    assert {k: (x.n_words, x.n_hit, sorted(x["items"])) for k, x in by_id(got).items()} == want
    clean = decontaminate.clean_documents(df, bench, bits=bits)
    assert clean.columns == df.columns
    assert {x.doc_id for x in clean.collect()} == {i for i, x in want.items() if not x[1]}
    assert decontaminate.decontaminate(df.limit(0), bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(df.union(df), bench, bits=bits).count() == 2 * len(texts)


def test_items_that_share_their_first_words(spark):
    r = random.Random(3)
    head = "these are the first twelve words that all of the items share"
    bench = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat(F.lit(head + " "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda j: F.concat(F.lit("x"), F.xxhash64("id", j).cast("string"))), " ")).alias("text"))
    texts = [head + " " + sentence(r, 150) for _ in range(20)] + ["the first twelve words " + sentence(r, 150)]
    began = time.time()
    got = by_id(decontaminate.decontaminate(docs(spark, texts), bench))
    assert time.time() - began < 120
    assert [(got[i].n_hit, got[i].n_items) for i in range(21)] == [(12, 20_000)] * 20 + [(0, 0)]


def test_long_texts_and_hits(spark):
    r = random.Random(4)
    item = sentence(r, 400)
    long = " ".join([item] * 200 + [sentence(r, 5000, 5000)])
    got = by_id(decontaminate.decontaminate(docs(spark, [long, "z" * 1_000_000]), spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert (got[0].n_words, got[0].n_hit) == (85_000, 80_000) and (got[1].n_words, got[1].n_hit) == (1, 0)


# --- 2


def brute_lines(texts, min_chars=10, min_docs=2):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(low)
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and min(holders[key(x)]) != i)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, min_docs):
    r = random.Random(2)
    pool = ["short", "a shared line here", "  A SHARED line here\t", "another shared line", "ÉTÉ ligne partagée", "été ligne partagée", "", "exactly10c", "nine char"]
    texts = [None, "", "\n\n"] + ["\n".join(r.choice(pool) for _ in range(r.randint(1, 8))) for _ in range(30)]
    df = docs(spark, texts, "'z' AS __kept_by;3 AS n_lines")
    got = line_dedup.line_dedup(df, min_docs=min_docs)
    assert {k: (x.text, x.n_lines, x.n_dropped) for k, x in by_id(got).items()} == brute_lines(texts, min_docs=min_docs)
    out = by_id(line_dedup.drop_shared_lines(df, min_docs=min_docs))
    assert out[0].text is None and all(out[i].text == brute_lines(texts, min_docs=min_docs)[i][0] for i in range(1, len(texts)))
    assert line_dedup.drop_shared_lines(df).columns == df.columns
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_repeated_and_null_ids(spark):
    rows = [(1, "one shared line"), (1, "one shared line"), (None, "one shared line\nown"), (2, "One Shared Line")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.text) for x in got) == [(0, "own"), (1, "one shared line"), (1, "one shared line"), (2, "")]


# --- 3


def test_quality(spark):
    r = random.Random(3)
    texts = [sentence(r, 30) + "." if i % 3 else "!! ".join(["BUY"] * 20) for i in range(300)] + [None, ""]
    df = docs(spark, texts, "0.5 AS score")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(5, None), (7, 1), (None, 0)], "doc_id long, quality int")
    m = fm_quality.train(df, labels, "doc_id", "text", "quality", ("n_chars",))
    got = by_id(fm_quality.score_documents(df, m, metadata=("n_chars",)))
    held = [i for i in range(300) if got[i].held_out]
    assert 40 < len(held) < 110 and all(got[i].predicted == int(i % 3 > 0) for i in held)
    assert len(got) == len(texts) and all(0 <= x.score <= 1 for x in got.values())
    # a label of the held-out fold changes nothing
    other = labels.withColumn("quality", F.when(fm_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = fm_quality.train(df, other, "doc_id", "text", "quality", ("n_chars",))
    assert np.allclose(again.w, m.w) and again.bias == m.bias
    kept = fm_quality.keep_good(df, m, metadata=("n_chars",))
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.predicted}
    none = fm_quality.train(df, labels.limit(0), "doc_id", "text", "quality")
    assert {x.score for x in fm_quality.score_documents(df, none).collect()} == {0.5}
    assert fm_quality.score_documents(df.limit(0), m, metadata=("n_chars",)).count() == 0


# --- 4

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for k, rx in BASE.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if k == "ip" else True, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_pii(spark):
    r = random.Random(4)
    parts = ["a@b.c", "x.y@z-1.co.uk", "_d@e.f", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (509) 555-6973", "+12", "é", "日", "😀", " ", ".", "@", "-", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "call 555-123-4567", "bob (at) x (dot) com", "\n", "x" * 30, "0005.06.07.08"]
    texts = [None, ""] + ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(250)] + ["1.2.3.4 " * 700, "a" * 2000 + "@", "a@b.c " * 3000]
    got = by_id(pii.find_pii(docs(spark, texts, "1 AS base;2 AS added")))
    assert {k: [tuple(s) for s in x.base] for k, x in got.items()} == {i: brute_pii(t) for i, t in enumerate(texts)}
    secrets = [texts[i][s.begin : s.end] for i, x in got.items() for s in x.added if s.kind == "secret"]
    assert "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" in secrets and "x" * 30 not in secrets
    plain = by_id(pii.find_pii(docs(spark, ["nothing here", None])))
    assert all(not x.base and not x.added for x in plain.values())
    assert pii.find_pii(docs(spark, texts).limit(0)).count() == 0


# --- 5


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there everybody.\nHow are you today?"), (1, 1, "a", "Bob wrote:\n> How are you today?\nI am fine, thanks."),
        (1, 2, "u", "> I am fine, thanks.\n>> how  are you TODAY?\nGood to hear that."), (1, 3, "a", "> Hello there everybody.\nHi yourself, friend"),
        (1, 4, "u", "> good to hear that.\n\n\nyes indeed it is"), (2, 0, "u", None), (2, 1, "u", "> I am fine, thanks.\nother"), (None, 0, "u", "x"),
        (3, None, "u", "> q"), (4, 5, "u", ""), (4, 5, "u", ""), (5, 0, "u", "first line of two\nsecond line of two"), (5, 1, "a", "> first line of two second line of two\nok"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert quotes.link_quotes(df).count() == len(rows)
    path = lambda c, t: list(got[c, t].path)
    assert [path(1, t) for t in range(5)] == [[0], [0, 1], [0, 1, 2], [0, 3], [0, 1, 2, 4]]
    assert got[1, 1].text == "I am fine, thanks." and got[1, 4].text == "yes indeed it is" and got[2, 0].text == ""
    assert (got[1, 2].n_quoted, got[1, 2].n_linked, got[1, 2].reply_to) == (2, 2, 1)
    assert got[2, 1].reply_to is None and path(3, None) == [] and path(5, 1) == [0, 1]
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, i, "u", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(40)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.turn: list(r.path) for r in got.collect()} == {i: list(range(i + 1)) for i in range(40)}


# --- 6


def near_texts(r):
    out = []
    for _ in range(12):
        base = [("w%d" % r.randrange(500)) for _ in range(150)]
        for k in range(r.randint(1, 5)):
            own = list(base)
            for _ in range(k):
                own[r.randrange(150)] = "w%d" % r.randrange(500)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("max_group", [simhash.MAX_GROUP, 4])
def test_simhash(spark, max_group):
    r = random.Random(6)
    texts = [None, "", " \n", *near_texts(r), "a", "A", "a b", "a b"]
    prints = [slow_fingerprint((t or "").encode()) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    least[i] = least[j] = min(least[i], least[j])
    df = docs(spark, texts, "7 AS fp;'x' AS component_id")
    got = by_id(simhash.simhash_components(df.drop("component_id"), max_group=max_group))
    assert {k: (x.fp % 2**64, x.component_id) for k, x in got.items()} == {i: (prints[i], least[i]) for i in range(len(texts))}
    kept = simhash.keep_first(df, max_group=max_group)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(least))


def test_simhash_odd_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "something else entirely here"), (None, "a b c d"), (None, "q"), (3, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.simhash_components(df).count() == len(rows)
    assert sorted((x.doc_id or 0, x.text) for x in simhash.keep_first(df).collect()) == [(0, "a b c d"), (0, "q"), (1, "a b c d")]
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 420)] + [(500, 500 + i) for i in range(100)] + [(7, 7), (None, 3)]
    at = {i: i for e in edges if None not in e and e[0] != e[1] for i in e}
    for _ in range(130):
        for a, b in edges:
            if None not in (a, b) and a != b:
                at[a] = at[b] = min(at[a], at[b])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == at and got.count() == len(at)


# --- 7


def test_pages(spark):
    page = "<body><nav>menu of links</nav><article><h1>T</h1><p>words of {} here</p></article><footer>foot</footer></body>"
    rows = [(i, f"u{i}", page.format(i)) for i in range(20)] + [(20, None, None), (21, "u", ""), (1, "u1", page.format(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = html_extract.main_text(df, html_extract.train(df)).collect()
    assert len(got) == len(rows)
    assert all(x.text == (f"T words of {x.page_id} here" if x.page_id < 20 else "") and x.n_chars == len(x.text) for x in got)
    assert html_extract.main_text(df.limit(0), html_extract.train(df.limit(0))).count() == 0


# --- 8


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    target, free = {}, sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(free)}
    left = share * sum(sizes.values())
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mixing(spark):
    r = random.Random(8)
    texts = [sentence(r, int(r.paretovariate(1.1) * 12)) for _ in range(600)] + [None, "", " \t "]
    df = docs(spark, texts, "1 AS size;2 AS target;9 AS copy_number")
    got = by_id(mixing.mix(df))
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[f"s{i % 3}" if i % 4 else None] += len((t or "").split())
    want = brute_targets(sizes)
    taken = Counter()
    for i, x in got.items():
        s = f"s{i % 3}" if i % 4 else None
        assert x.size == len((texts[i] or "").split()) and x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 * want[s]
        assert 0 <= x.taken <= 2 * x.size and x.taken == x.copies * x.size
        taken[s] += x.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t
    again = by_id(mixing.mix(df.repartition(7)))
    assert {i: x.taken for i, x in again.items()} == {i: x.taken for i, x in got.items()}
    rows = mixing.mixed_documents(df)
    assert rows.columns == [*[c for c in df.columns if c != "copy_number"], "copy_number"]
    assert Counter(x.doc_id for x in rows.collect()) == Counter({i: x.copies for i, x in got.items() if x.copies})


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, ["a"]).limit(0)).count() == 0
    assert [x.taken for x in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]
    same = docs(spark, ["a b c", "a b c"]).withColumn("source", F.lit("x"))
    assert mixing.mix(same.union(same)).count() == 4


# --- 9


def test_token_counts(spark):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(9)
    texts = [None, "", " ", "a  b\n", "é" * 3000, "word " * 5000] + [sentence(r, 50) for _ in range(20)]
    got = by_id(token_count.token_counts(docs(spark, texts, "1 AS n_tokens"), model_path=path, slice_bytes=300))
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert token_count.token_counts(docs(spark, texts).limit(0)).count() == 0


# --- 10


def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_stats(spark):
    r = random.Random(10)
    texts = [None, "", " \n ", "a", "x y " * 30, "\xa0 a b"] + [" ".join(r.choice(["a", "b", "#é", "<c>\n"]) for _ in range(r.randint(1, 60))) for _ in range(80)]
    got = by_id(quality_rules.judge(docs(spark, texts, "1 AS n_words;true AS kept"), docs(spark, []).selectExpr("doc_id", "1 AS quality")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, t in enumerate(texts):
        want = brute_stats(t)
        assert tuple(got[i][c] for c in names) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert (got[i].base_failed, got[i].kept) == (failed, not failed)


def tail(k, n, p):
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0


def test_exact_tail(spark):
    cases = [(0, 50, 0.05), (3, 200, 0.05), (9, 100, 0.2), (20, 100, 0.1), (1, 1, 0.5), (0, 1, 0.02), (900, 60_000, 0.02)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for p in {c[2] for c in cases}:
        for r in df.where(F.col("p") == p).select("k", "n", quality_rules.log_tail(F.col("k"), F.col("n"), p).alias("t")).collect():
            assert -60 < r.t < -30 if r.k == 900 else abs(np.exp(r.t) - tail(r.k, r.n, p)) < 1e-9
    # beyond TERMS the bound is on the safe side
    far = spark.sql("SELECT 19500L AS k, 1000000L AS n").select(quality_rules.log_tail(F.col("k"), F.col("n"), 0.02).alias("t")).first().t
    assert -7 < far < -5  # the tail itself is about exp(-8.5)


def brute_cutoffs(good, folds, strata, risk, error, share):
    rules, out = len(quality_rules.RULES), {}
    for s in {x[1] for x in good}:
        fit = [x[2] for x in good if x[1] == s and folds[x[0]] == 0]
        held = [x[2] for x in good if x[1] == s and folds[x[0]] != 0]
        if not fit or not held:
            continue
        best = None
        for j in range(quality_rules.LEVELS):
            cut = [max(t for t in range(quality_rules.STEPS + 1) if sum(x[r] <= t for x in fit) <= j * share * len(fit)) for r in range(rules)]
            rejected = sum(any(x[r] <= cut[r] for r in range(rules)) for x in held)
            if tail(rejected, len(held), risk) > error / strata:
                break
            best = (cut, j, len(held), rejected)
        if best:
            out[s] = best
    return out


def test_cutoffs_by_definition(spark):
    r = random.Random(12)
    top = quality_rules.STEPS + 1
    good = [(i, [None, "a", "b", "few"][3 if i < 5 else r.randrange(3)], [min(top, max(1, int(r.expovariate(1 / 900)))) for _ in quality_rules.RULES]) for i in range(1200)]
    df = spark.createDataFrame(good, "id long, s string, steps array<int>")
    folds = {x.id: x.f for x in df.select("id", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(quality_rules.FIT)).alias("f")).collect()}
    got = {x.s: (list(x.cutoffs), x.level, x.n, x.rejected) for x in quality_rules.cutoffs(df, "id", "s", "steps", 4, risk=0.2, error=0.2, share=0.004).collect()}
    want = brute_cutoffs(good, folds, 4, 0.2, 0.2, 0.004)
    assert got == want and 0 < max(x[1] for x in want.values())
    assert quality_rules.cutoffs(df.limit(0), "id", "s", "steps", 0).count() == 0


def test_the_bound_holds(spark):
    """Each stratum is a draw of its own, of documents that a cutoff of t rejects with chance t / STEPS."""
    strata, risk, level = 300, 0.05, 0.05
    step = (F.floor(F.rand(5) * quality_rules.STEPS) + 1).cast("int")
    others = [F.lit(quality_rules.STEPS + 1)] * (len(quality_rules.RULES) - 1)
    df = spark.range(strata * 500).select("id", (F.col("id") % strata).cast("string").alias("s"), F.array(step, *others).alias("steps"))
    found = quality_rules.cutoffs(df, "id", "s", "steps", strata, risk=risk, error=level * strata, share=0.005).collect()
    wrong = sum(x.cutoffs[0] / quality_rules.STEPS > risk for x in found)
    assert len(found) > 250 and wrong <= 300 * level + 3 * (300 * level * (1 - level)) ** 0.5
    assert sum(x.cutoffs[0] for x in found) / len(found) / quality_rules.STEPS > 0.4 * risk  # and it is put to use


def test_judge(spark):
    r = random.Random(11)
    texts = [sentence(r, 30, 300) for _ in range(3000)] + [" ".join(f"w{r.randrange(300)}###" for _ in range(30)) for _ in range(200)] + [None, "", "a"]
    df = docs(spark, texts).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3200)] + [(0, None), (1, 0), (1, 1), (1, 1)], "doc_id long, quality int")
    got = by_id(quality_rules.judge(df.union(df.where("doc_id = 3")), labels))
    assert not any(got[i].kept for i in range(3000, 3200))
    assert sum(not got[i].kept for i in range(3000)) <= 0.02 * 3000 and not got[3200].kept
    few = by_id(quality_rules.judge(df.where("doc_id < 100"), labels))
    assert all(x.kept for x in few.values())
    assert quality_rules.judge(df.limit(0), labels).count() == 0
    long = docs(spark, ["word and others " * 30_000, "a " * 100_000])
    assert [(x.n_words, x.base_failed) for x in quality_rules.judge(long, labels).orderBy("doc_id").collect()] == [(90_000, True), (100_000, True)]
