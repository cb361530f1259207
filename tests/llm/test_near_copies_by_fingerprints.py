"""The pipeline's near copies come through op6's fingerprints and trie first; an exact comparison and search follow."""

import random

import corpus_pipeline
from seqloom.llm import near_copies, simhash


def lists(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words(r, n):
    return ["w%d" % r.randrange(5000) for _ in range(n)]


def planted(r):
    """Texts, each with a copy that has one changed word (near in fingerprint) and one with many (similar, but far in it)."""
    out = []
    for _ in range(12):
        base = words(r, 600)
        one, many = list(base), list(base)
        one[599] = "changed"
        for k in range(20, 600, 60):
            many[k] = "changed"
        out += [" ".join(base), " ".join(one), " ".join(many)]
    return out


def test_links_are_those_of_fingerprints(spark):
    texts = [None, "", "a b", "A  b", *planted(random.Random(4))]
    entries = near_copies.set_keys(lists(spark, texts), "doc_id", "text").selectExpr("key", "fp").distinct()
    prints = {x.key: x.fp for x in entries.collect()}
    # one more entry with a fingerprint that another has
    twin = (max(prints) - 1, prints[max(prints)])
    prints[twin[0]] = twin[1]
    assert {x % 2**64 for x in prints.values()} == {simhash.fingerprint((t or "").encode(), 5) for t in texts}
    least = {k: k for k in prints}
    near = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) % 2**64).bit_count() <= simhash.BUDGET]
    for found in (least, got := dict(least)):
        links = near if found is least else [(x.a, x.b) for x in near_copies.fingerprint_links(entries.union(spark.createDataFrame([twin], "key long, fp long"))).collect()]
        for _ in prints:
            for a, b in links:
                found[a] = found[b] = min(found[a], found[b])
    assert got == least and 10 < len(set(least.values())) < len(least) - 5


def test_stage_goes_through_the_trie(spark, monkeypatch):
    """The trie gets every fingerprint; the exact search compares what it left apart only; no pair is lost, none is made up."""
    texts = planted(random.Random(5))
    # one shingle outweighs all others, so fingerprints are equal, but little is shared
    r = random.Random(6)
    made_up = [" ".join(["a b c d e"] * 400 + words(r, 60)) for _ in range(2)]
    assert len({simhash.fingerprint(t.encode(), 5) for t in made_up}) == 1
    texts += made_up
    seen, compared = [], []
    near_links, verified = near_copies.near_links, near_copies._verified
    monkeypatch.setattr(near_copies, "near_links", lambda entries, **o: (seen.append({x.fp % 2**64 for x in entries.collect()}), near_links(entries, **o))[1])
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, sets: (compared.append({frozenset(x) for x in pairs.collect()}), verified(pairs, sets))[1])
    kept = corpus_pipeline.near_duplicates(spark, lists(spark, texts), "")
    assert sorted(x.doc_id for x in kept.collect()) == [*range(0, 36, 3), 36, 37]
    assert seen == [{simhash.fingerprint(t.encode(), 5) for t in texts}]
    by_prints, left = compared
    assert len(by_prints) >= 8 and left and not by_prints & left
