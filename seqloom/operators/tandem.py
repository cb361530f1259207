"""Tandem repeats without pairs of equal k-mers.

A run of period p is a maximal stretch that equals itself shifted by p; one as long as p at least ends in a square. Short
periods are compared place by place. For periods from 2k to 4k, a run of 2k characters holds a block of k that starts at a
multiple of k, and the block stands again p places on: so only blocks, of which there is one for k characters, look for
their equals, and only that far. Blocks are equal if their 64-bit hashes are; hashes of 2k characters are made of two of k.
A batch of sequences is worked on as one text whose separators and wildcards are all different. Work and memory grow with
the text's length times the logarithm of the longest period, and with the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.functions.alphabet import WILDCARD
from seqloom.operators.postings import spread

#: Periods below this are compared place by place.
DIRECT = 32
#: Characters of a batch; a longer sequence is a batch of its own.
BATCH = 1 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_SHIFT = np.uint64(32)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair; the order of the two counts."""
    h = a * _ODD[0] + (b ^ (b >> _SHIFT)) * _ODD[1]
    h ^= h >> _SHIFT
    h *= _ODD[2]
    return h ^ (h >> _SHIFT)


def _short_runs(codes: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of one period."""
    same = np.concatenate(([False], codes[:-period] == codes[period:], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, end = edges[::2], edges[1::2]
    long = end - start >= period
    return start[long], end[long]


def _equal_blocks(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the blocks at multiples of k that stand again 2k to 4k - 1 places on. h: hashes of k characters."""
    low, high = 2 * k, 4 * k
    at = np.arange(0, len(h), k)
    bucket = at // high
    # the other place lies in the block's own stretch of `high` places or in the next; both are part of the key
    keys = np.concatenate([h[at] + (bucket + i).astype(np.uint64) * _ODD[1] for i in (0, 1)])
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], np.concatenate([at, at])[order]
    bits = np.uint64(64 - (4 * len(keys)).bit_length())
    marked = np.zeros(1 << (64 - int(bits)), dtype=bool)
    marked[((keys * _ODD[0]) >> bits).astype(np.int64)] = True
    own = h + (np.arange(len(h)) // high).astype(np.uint64) * _ODD[1]
    other = np.flatnonzero(marked[((own * _ODD[0]) >> bits).astype(np.int64)])
    first, last = (np.searchsorted(keys, own[other], side) for side in ("left", "right"))
    n = last - first
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, y = at[np.repeat(first, n) + step], np.repeat(other, n)
    good = (y - x >= low) & (y - x < high) & (h[x] == h[y])
    return x[good], (y - x)[good]


def _long_runs(codes: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of the periods from 2k to 4k - 1."""
    x, p = _equal_blocks(h, k)
    order = np.lexsort((x, p))
    x, p = x[order], p[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (x[1:] - x[:-1] != k)
    begins = np.flatnonzero(new)
    start, p = x[begins], p[begins]
    end = x[np.append(begins[1:], len(x)) - 1] + k if len(x) else x
    # the blocks before and behind differ, so either end moves by less than k
    todo = np.flatnonzero(start > 0)
    while len(todo):
        todo = todo[codes[start[todo] - 1] == codes[start[todo] - 1 + p[todo]]]
        start[todo] -= 1
        todo = todo[start[todo] > 0]
    todo = np.flatnonzero(end + p < len(codes))
    while len(todo):
        todo = todo[codes[end[todo]] == codes[end[todo] + p[todo]]]
        end[todo] += 1
        todo = todo[end[todo] + p[todo] < len(codes)]
    long = end - start >= p
    return start[long], end[long], p[long]


def squares(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, period) of the last square of every run with a period of `least` or more, texts counted from 0."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer("".join(t + WILDCARD for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    single = np.flatnonzero(codes == ord(WILDCARD))
    codes[single] = 0x110000 + np.arange(len(single))
    longest = int(sizes.max(initial=0)) // 2
    found = []
    for period in range(max(least, 1), min(DIRECT - 1, longest) + 1):
        start, end = _short_runs(codes, period)
        found.append((start, end, np.full(len(start), period)))
    h, k = _mixed(codes.astype(np.uint64), np.zeros(1, dtype=np.uint64)), 1
    while 2 * k <= longest:
        if 2 * k >= DIRECT and 4 * k > least:
            start, end, p = _long_runs(codes, h, k)
            found.append(tuple(a[p >= least] for a in (start, end, p)))
        h, k = _mixed(h[:-k], h[k:]), 2 * k
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    _, end, period = (np.concatenate(a).astype(np.int64) for a in zip(*found, strict=True))
    place = end - period
    text = np.searchsorted(begins, place, "right") - 1
    return text, place - begins[text], period


def tandem_repeats(seqs: DataFrame, least: int) -> DataFrame:
    """Branching tandem repeats (seqnum, pos, period) with periods of `least` or more: the last square of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            text, place, period = squares(texts, least)
            return pa.record_batch([np.array(ids, dtype=np.int64)[text], place, period], names=["seqnum", "pos", "period"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for seqnum, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                if ids and size + len(text) > BATCH:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(seqnum)
                texts.append(text)
                size += len(text)
            if ids:
                yield done(ids, texts)

    return spread(seqs.select("seqnum", "seq")).mapInArrow(run, "seqnum long, pos long, period long")
