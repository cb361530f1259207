"""Definitions of the matches, as slow and plain as they are."""

from __future__ import annotations


def _equal(a: str, b: str) -> bool:
    return a == b and a != "#"


def self_matches(seqs: dict[int, str], least: int) -> set[tuple]:
    places = [(s, p) for s in sorted(seqs) for p in range(len(seqs[s]))]
    return {(*x, *y, n) for i, x in enumerate(places) for y in places[i + 1 :] if (n := _run(seqs[x[0]], x[1], seqs[y[0]], y[1])) >= least}


def query_matches(db: dict[int, str], query: dict[int, str], least: int) -> set[tuple]:
    return {(s, p, t, q, n) for s, a in db.items() for p in range(len(a)) for t, b in query.items() for q in range(len(b)) if (n := _run(a, p, b, q)) >= least}


def _run(a: str, p: int, b: str, q: int) -> int:
    """Length of the common run from here, 0 if it goes on to the left."""
    if p and q and _equal(a[p - 1], b[q - 1]):
        return 0
    n = 0
    while p + n < len(a) and q + n < len(b) and _equal(a[p + n], b[q + n]):
        n += 1
    return n


def count(seqs: dict[int, str], w: str) -> int:
    return sum(s[i : i + len(w)] == w for s in seqs.values() for i in range(len(s) - len(w) + 1))


def occurrences(seqs: dict[int, str], w: str) -> list[tuple[int, int]]:
    return [(k, i) for k, s in seqs.items() for i in range(len(s) - len(w) + 1) if s[i : i + len(w)] == w]


def supermaximal(seqs: dict[int, str], least: int) -> set[tuple]:
    found = self_matches(seqs, least)
    words = {seqs[a][p : p + n] for a, p, _, _, n in found}
    good = {w for w in words if not any(w != v and w in v for v in words)}
    return {m for m in found if seqs[m[0]][m[1] : m[1] + m[4]] in good}


def tandems(seqs: dict[int, str], least: int) -> set[tuple]:
    out = set()
    for k, s in seqs.items():
        for p in range(len(s)):
            for h in range(least, (len(s) - p) // 2 + 1):
                if s[p : p + h] == s[p + h : p + 2 * h] and "#" not in s[p : p + h] and (p + 2 * h >= len(s) or not _equal(s[p], s[p + 2 * h])):
                    out.add((k, p, h))
    return out


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (not _equal(c, d)), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]
