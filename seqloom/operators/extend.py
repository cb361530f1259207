"""Extension of exact seeds to matches with mismatches, edits or by X-drop.

Seeds are maximal exact matches (seq1, pos1, seq2, pos2, len). Each meets the blocks of text around it, one block to either
side, and is extended in an Arrow function. A seed whose extension comes to the edge of its text before its sequence
ends is taken up again with blocks four times as long, until none is left. Rows are sequences, so nothing crosses a boundary.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import scores
from seqloom.functions.alphabet import WILDCARD
from seqloom.operators.filters import without_contained
from seqloom.util import written

MATCH, MISMATCH, INDEL = 2, -1, -2
DEFAULT_XDROP_SEED = 30
#: Characters of the first text on either side of a seed.
FIRST_BLOCK = 1024


def seed_length(least: int, errors: int | None, seed: int | None = None) -> int:
    """Length of the exact seeds for matches of `least` characters with `errors`; without errors, X-drop, a fixed one."""
    if errors is None:
        return seed or DEFAULT_XDROP_SEED
    return max(seed or 0, least // (errors + 1), 1)


@lru_cache(maxsize=1 << 16)
def log_evalue(length: int, distance: int, symbols: int) -> float:
    """Natural logarithm of the E-value of scores.evalue() for a multiplier of 1; minus infinity where that is 0."""
    k, p = abs(distance), 1.0 / symbols
    if k > length:  # no way to choose them, and lgamma() has a pole there
        return -math.inf
    log_p = math.lgamma(length + 1) - math.lgamma(k + 1) - math.lgamma(length - k + 1) + (length - k) * math.log(p) + (k + 2) * math.log1p(-p)
    if log_p <= math.log(scores.FLOOR) or distance > scores.MAX_EDIT:
        return -math.inf
    if distance <= 0:
        return log_p
    last = len(scores.EDIT_FACTORS)
    return log_p + math.log(scores.EDIT_FACTORS[min(distance, last) - 1]) + max(0, distance - last) * math.log(2.0)


def rank(length: int, distance: int, symbols: int) -> tuple[float, float, int]:
    """The lower, the better: E-value, then identity, then length."""
    return log_evalue(length, distance, symbols), abs(distance) / length, -length


def _codes(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Where a and b differ, over the shorter one; a wildcard equals nothing."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s[:n].encode("utf-32-le"), dtype=np.uint32) for s in (a, b))
    return (x != y) | (x == ord(WILDCARD))


def hamming_steps(a: str, b: str, errors: int, longest: int | None = None) -> list[int]:
    """[i]: characters from the start with just i mismatches, up to the next one; shorter where the strings end first.

    longest: from a run of that many equal characters after a mismatch on, the way is another seed's; it ends before that mismatch.
    """
    off = np.flatnonzero(_codes(a, b))
    steps = [int(x) for x in off[: errors + 1]]
    if len(steps) <= errors:
        steps.append(min(len(a), len(b)))
    if longest is not None:
        for i in range(1, len(steps)):
            if steps[i] - steps[i - 1] > longest:
                return steps[:i]
    return steps


def _common(a: str, i: int, b: str, j: int) -> int:
    """Equal characters of a from i and b from j; both without wildcards."""
    n, size = 0, 16
    while True:
        x, y = a[i + n : i + n + size], b[j + n : j + n + size]
        if x != y or not x:
            break
        n, size = n + len(x), size * 2
    for c, d in zip(x, y, strict=False):
        if c != d:
            break
        n += 1
    return n


def _apart(a: str, b: str) -> tuple[str, str]:
    """Both strings with wildcards that equal nothing."""
    return a.replace(WILDCARD, "\x00"), b.replace(WILDCARD, "\x01")


def edit_fronts(a: str, b: str, errors: int, longest: int | None = None) -> list[dict[int, int]]:
    """[p]: for each diagonal, the characters that b is ahead, how far into a one gets with p edits along it.

    A diagonal is left out where that is beyond either string. longest: as in hamming_steps(); such a diagonal is left
    out, and there are no further fronts.
    """
    a, b = _apart(a, b)
    never = -len(a) - len(b) - errors - 2
    fronts: list[dict[int, int]] = [{0: 0}]
    while len(fronts) <= errors and (a or b):
        last, new, owned, p = fronts[-1], {}, False, len(fronts)
        for k in range(-p, p + 1):
            i = max(last.get(k, never) + 1, last.get(k - 1, never), last.get(k + 1, never) + 1)
            if not (0 <= i <= len(a) and 0 <= i + k <= len(b)):
                continue
            n = _common(a, i, b, i + k)
            if longest is not None and n >= longest:
                owned = True
            else:
                new[k] = i + n
        if not new:
            break
        fronts.append(new)
        if owned:
            break
    return fronts


def xdrop_hamming(a: str, b: str, drop: int, longest: int | None = None) -> tuple[int, int, bool] | None:
    """(characters, score, whether the strings ended first) of the best prefix before the score falls `drop` below the best so far.

    longest: None comes back where that many characters in a row are equal on the way, as another seed is met.
    """
    wrong = _codes(a, b)
    total = np.cumsum(np.where(wrong, MISMATCH, MATCH))
    below = np.flatnonzero(total < np.maximum(0, np.maximum.accumulate(total)) - drop) if len(total) else total
    ended = not len(below)
    scanned = len(total) if ended else int(below[0])
    if longest is not None:
        marks = np.r_[-1, np.flatnonzero(wrong[:scanned]), scanned]
        if (np.diff(marks) > longest).any():
            return None
    total = total[:scanned]
    if not len(total) or total.max() <= 0:
        return 0, 0, ended
    at = int(np.argmax(total))
    return at + 1, int(total[at]), ended


def xdrop_edit(a: str, b: str, drop: int) -> tuple[int, int, int, int, bool]:
    """(characters of a, of b, edits, score, whether a string's end was met) of the best extension with indels.

    Fronts as in edit_fronts(): with p edits and i + j characters the score is i + j - 3p. A diagonal is given up
    where the score is more than `drop` below the best that fewer edits could have had by then.
    """
    a, b = _apart(a, b)
    step, lag = MATCH - MISMATCH, (drop + 1) // (MATCH - MISMATCH)
    i = _common(a, 0, b, 0)
    best, front, bests = (i, i, 0, 2 * i), {0: i}, [2 * i]
    met = i in (len(a), len(b))
    p = 0
    while front:
        p += 1
        bound = (bests[p - 1 - lag] if p - 1 - lag >= 0 else 0) - drop
        new = {}
        for k in range(min(front) - 1, max(front) + 2):
            ways = []
            if k in front:
                ways.append(front[k] + 1)
            if k - 1 in front:
                ways.append(front[k - 1])
            if k + 1 in front:
                ways.append(front[k + 1] + 1)
            i = max(ways, default=-1)
            if not (0 <= i <= len(a) and 0 <= i + k <= len(b)) or 2 * i + k - step * p < bound:
                continue
            i += _common(a, i, b, i + k)
            new[k] = i
            met = met or i == len(a) or i + k == len(b)
            value = 2 * i + k - step * p
            if value > best[3]:
                best = (i, i + k, p, value)
        bests.append(best[3])
        front = new
    return *best, met


def _blocks(seqs: DataFrame, size: int) -> DataFrame:
    """Rows (seqnum, block, text): each sequence in blocks, cut in one scan."""
    return seqs.select("seqnum", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("block", "text"))


def contexts(seeds: DataFrame, db: DataFrame, query: DataFrame, size: int, own: bool) -> DataFrame:
    """Seeds with `size` characters left of them (reversed) and right of them, on both sides.

    A seed asks for four blocks of each sequence at most, so what is shuffled doesn't grow with the sequences.
    """
    key = ["seq1", "pos1", "seq2", "pos2", "len"]

    def wanted(i: int):
        before, after = F.floor((F.col(f"pos{i}") - 1) / size), F.floor((F.col(f"pos{i}") + F.col("len")) / size)
        return F.transform(
            F.filter(F.array_distinct(F.array(before - 1, before, after, after + 1)), lambda x: x >= 0),
            lambda x: F.struct(F.lit(i).alias("side"), F.lit(1 if own else i).alias("table"), F.col(f"seq{i}").alias("seqnum"), x.cast("int").alias("block")),
        )

    blocks = _blocks(db, size).withColumn("table", F.lit(1))
    if not own:
        blocks = blocks.unionByName(_blocks(query, size).withColumn("table", F.lit(2)))
    asked = seeds.select(*key, F.explode(F.concat(wanted(1), wanted(2))).alias("w")).select(*key, "w.*")
    held = asked.join(blocks, ["table", "seqnum", "block"]).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("side", "block").alias("at"), "text"))).alias("texts"))
    out = held
    for i in (1, 2):
        start, end = F.col(f"pos{i}"), F.col(f"pos{i}") + F.col("len")
        before, after = F.floor((start - 1) / size), F.floor(end / size)
        part = lambda block, i=i: F.coalesce(F.element_at("texts", F.struct(F.lit(i).alias("side"), block.cast("int").alias("block"))), F.lit(""))
        low = F.greatest(start - size, F.lit(0))
        left = F.substr(F.concat(part(before - 1), part(before)), (low - F.greatest(before - 1, F.lit(0)) * size + 1).cast("int"), (start - low).cast("int"))
        right = F.substr(F.concat(part(after), part(after + 1)), (end - after * size + 1).cast("int"), F.lit(size))
        out = out.withColumns({f"left{i}": F.reverse(left), f"right{i}": right})
    return out.drop("texts")


_COLUMNS = ["seq1", "pos1", "len1", "seq2", "pos2", "len2", "distance", "score"]
_SCHEMA = ", ".join(f"{c} long" for c in _COLUMNS) + ", open boolean"


class _Cut:
    """Tells whether an end of the text is a cut rather than the end of a sequence."""

    def __init__(self, size: int):
        self.size = size

    def both(self, a: str, b: str) -> bool:
        return min(len(a), len(b)) == self.size

    def either(self, a: str, b: str) -> bool:
        return self.size in (len(a), len(b))


def _extended(seeds: DataFrame, db: DataFrame, query: DataFrame, one: Callable, first: int) -> DataFrame:
    """one(seed with its texts, cut) -> rows (left1, left2, right1, right2, distance), or None if the text was too short."""
    own, todo, size, done = query is db, seeds.select("seq1", "pos1", "seq2", "pos2", "len"), first, None

    def run_with(size: int):
        cut = _Cut(size)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for r in b.itertuples(index=False):
                    found = one(r, cut)
                    if found is None:
                        rows.append((r.seq1, r.pos1, r.len, r.seq2, r.pos2, r.len, 0, 0, True))
                        continue
                    for l1, l2, r1, r2, d in found:
                        n1, n2 = l1 + r.len + r1, l2 + r.len + r2
                        score = n1 + n2 - 3 * abs(d)
                        rows.append((r.seq1, r.pos1 - l1, n1, r.seq2, r.pos2 - l2, n2, d, -score if d < 0 else score, False))
                yield pd.DataFrame(rows, columns=[*_COLUMNS, "open"])

        return run

    while True:
        rows = written(contexts(todo, db, query, size, own).mapInPandas(run_with(size), _SCHEMA))
        part = rows.where("NOT open").drop("open")
        done = part if done is None else done.unionByName(part)
        todo = rows.where("open").select("seq1", "pos1", "seq2", "pos2", F.col("len1").alias("len"))
        if todo.isEmpty():
            return done.distinct()
        size *= 4


def _accepted(r, l1: int, l2: int, r1: int, r2: int, d: int, spare: bool) -> bool:
    """Whether a match within one table is no match with itself: the second instance begins later, and doesn't lie in the first.

    spare: what doesn't overlap must be more than the errors.
    """
    if r.seq1 != r.seq2:
        return True
    p, n, q, m = r.pos1 - l1, l1 + r.len + r1, r.pos2 - l2, l2 + r.len + r2
    if p > q:
        p, n, q, m = q, m, p, n
    if p == q:
        return False
    if p + n <= q:
        return True
    return p + n < q + m and (not spare or (q - p) + (q + m) - (p + n) > d)


def _splits(left: int, right: int, errors: int) -> Iterator[tuple[int, int]]:
    """Errors to the left and to the right, fewest in all first, then fewest to the left."""
    for d in range(min(errors, left + right) + 1):
        for i in range(max(0, d - right), min(d, left) + 1):
            yield i, d - i


def _hamming_ways(r, cut: _Cut, least: int, errors: int, seed: int) -> list[tuple[int, int, int]] | None:
    """All (left, right, mismatches) that make `least` characters, in the order of _splits()."""
    left, right = hamming_steps(r.left1, r.left2, errors, seed), hamming_steps(r.right1, r.right2, errors)
    for steps, a, b in ((left, r.left1, r.left2), (right, r.right1, r.right2)):
        # the last step is where the texts end, rather than a mismatch
        if cut.both(a, b) and steps[-1] == cut.size:
            return None
    return [(left[i], right[j], i + j) for i, j in _splits(len(left) - 1, len(right) - 1, errors) if left[i] + r.len + right[j] >= least]


def _edit_ways(r, cut: _Cut, least: int, errors: int, seed: int, own: bool) -> list[tuple[int, int, int, int, int]] | None:
    """All (left1, left2, right1, right2, edits) that make `least` characters on both sides, by _splits(), then by diagonals."""
    left, right = edit_fronts(r.left1, r.left2, errors, seed), edit_fronts(r.right1, r.right2, errors)
    for fronts, a, b in ((left, r.left1, r.left2), (right, r.right1, r.right2)):
        if any((i == len(a) == cut.size) or (i + k == len(b) == cut.size) for f in fronts for k, i in f.items()):
            return None
    return [
        (i, i + k, j, j + m, x + y)
        for x, y in _splits(len(left) - 1, len(right) - 1, errors)
        for k, i in left[x].items()
        for m, j in right[y].items()
        if min(i + j, i + k + j + m) + r.len >= least and (not own or _accepted(r, i, i + k, j, j + m, x + y, True))
    ]


def extend_hamming(seeds: DataFrame, db: DataFrame, query: DataFrame, least: int, errors: int, *, seed: int | None = None, symbols: int = 4, first: int = FIRST_BLOCK) -> DataFrame:
    """Of the ways to share `errors` mismatches between both ends the one with the best E-value, then identity, then length.

    To the left no way goes through a run of `seed` characters, since the match belongs to that seed then. Where `query`
    is `db` itself, seeds are repeats. distance is minus the mismatches. symbols: classes of the alphabet.
    """
    seed = seed_length(least, errors, seed)

    def one(r, cut):
        ways = _hamming_ways(r, cut, least, errors, seed)
        if ways is None:
            return None
        best = min(reversed(ways), key=lambda w: rank(w[0] + r.len + w[1], -w[2], symbols), default=None)
        return [] if best is None else [(best[0], best[0], best[1], best[1], -best[2])]

    return _extended(seeds, db, query, one, first)


def extend_edit(seeds: DataFrame, db: DataFrame, query: DataFrame, least: int, errors: int, *, seed: int | None = None, symbols: int = 4, first: int = FIRST_BLOCK) -> DataFrame:
    """As extend_hamming() with edits; both instances have `least` characters at least, and the longer one counts for the choice."""
    seed, own = seed_length(least, errors, seed), query is db

    def one(r, cut):
        ways = _edit_ways(r, cut, least, errors, seed, own)
        if ways is None:
            return None
        best = min(reversed(ways), key=lambda w: rank(r.len + max(w[0] + w[2], w[1] + w[3]), w[4], symbols), default=None)
        return [] if best is None else [best]

    return _extended(seeds, db, query, one, first)


def extend_all(seeds: DataFrame, db: DataFrame, query: DataFrame, least: int, errors: int, *, edits: bool = False, seed: int | None = None, first: int = FIRST_BLOCK) -> DataFrame:
    """All ways to share up to `errors` errors between both ends, without matches that lie in others of the two sequences."""
    seed, own = seed_length(least, errors, seed), query is db

    def one(r, cut):
        if edits:
            return _edit_ways(r, cut, least, errors, seed, own)
        ways = _hamming_ways(r, cut, least, errors, seed)
        return None if ways is None else [(i, i, j, j, -d) for i, j, d in ways]

    found = _extended(seeds, db, query, one, first).drop("score")
    # one place may be reached with more errors than it takes
    place = ["seq1", "pos1", "len1", "seq2", "pos2", "len2"]
    fewest = found.groupBy(*place).agg(F.min(F.struct(F.abs("distance").alias("n"), "distance")).alias("__d")).select(*place, F.col("__d.distance").alias("distance"))
    return without_contained(fewest)


def extend_xdrop(seeds: DataFrame, db: DataFrame, query: DataFrame, drop: int, *, edits: bool = False, seed: int | None = None, first: int = FIRST_BLOCK) -> DataFrame:
    """Both ends extended while the score stays within `drop` of the best. drop: 1 to 255.

    Without indels, a seed that meets another one of `seed` characters to its left is left out, as that one gives the match.
    """
    if not 1 <= drop <= 255:
        raise ValueError("drop must be from 1 to 255")
    seed, own = seed_length(0, None, seed), query is db

    def one(r, cut):
        if not edits:
            left, right = xdrop_hamming(r.left1, r.left2, drop, seed), xdrop_hamming(r.right1, r.right2, drop)
            if left is None:
                return []
            if (left[2] and cut.both(r.left1, r.left2)) or (right[2] and cut.both(r.right1, r.right2)):
                return None
            (n, s, _), (m, t, _) = left, right
            return [(n, n, m, m, -((2 * n - s) // 3 + (2 * m - t) // 3))]
        l1, l2, e, _, met = xdrop_edit(r.left1, r.left2, drop)
        r1, r2, f, _, also = xdrop_edit(r.right1, r.right2, drop)
        if (met and cut.either(r.left1, r.left2)) or (also and cut.either(r.right1, r.right2)):
            return None
        return [(l1, l2, r1, r2, e + f)] if not own or _accepted(r, l1, l2, r1, r2, e + f, False) else []

    return _extended(seeds, db, query, one, first)
