"""Alignments of matches and of sequences, as scripts and as text."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edit_script(a: str, b: str) -> list[tuple[str, int]]:
    """An optimal alignment as runs: '=' equal, 'X' unequal, 'D' only in a, 'I' only in b."""
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    table[:, 0], table[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    y = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    for i, c in enumerate(a, 1):
        row = np.minimum(table[i - 1, :-1] + (y != ord(c)), table[i - 1, 1:] + 1)
        row = np.r_[i, row] - np.arange(len(b) + 1)
        table[i] = np.minimum.accumulate(row) + np.arange(len(b) + 1)
    i, j, ops = len(a), len(b), []
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            ops.append("=" if a[i - 1] == b[j - 1] else "X")
            i, j = i - 1, j - 1
        elif i and table[i, j] == table[i - 1, j] + 1:
            ops.append("D")
            i -= 1
        else:
            ops.append("I")
            j -= 1
    out: list[tuple[str, int]] = []
    for op in reversed(ops):
        if out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + 1)
        else:
            out.append((op, 1))
    return out


def render(a: str, b: str, width: int = 60) -> str:
    """Both strings under each other with gaps, unequal places marked '!'."""
    top, mid, low, i, j = [], [], [], 0, 0
    for op, n in edit_script(a, b):
        x = a[i : i + n] if op != "I" else "-" * n
        y = b[j : j + n] if op != "D" else "-" * n
        i, j = i + (op != "I") * n, j + (op != "D") * n
        top.append(x)
        low.append(y)
        mid.append((" " if op == "=" else "!") * n)
    lines = ["".join(x) for x in (top, mid, low)]
    return "\n\n".join("\n".join(x[k : k + width].rstrip() for x in lines) for k in range(0, len(lines[0]), width))


def align(matches: DataFrame, db: DataFrame, query: DataFrame, width: int = 60) -> DataFrame:
    """Matches (seq1, pos1, len1, seq2, pos2, len2) with their texts, script ('12=1X...') and rendering."""
    rows = matches.join(db.select(F.col("seqnum").alias("seq1"), F.col("seq").alias("__s1")), "seq1").join(query.select(F.col("seqnum").alias("seq2"), F.col("seq").alias("__s2")), "seq2")
    rows = rows.select("seq1", "pos1", "len1", "seq2", "pos2", "len2", *[F.substr(F.col(f"__s{i}"), (F.col(f"pos{i}") + 1).cast("int"), F.col(f"len{i}").cast("int")).alias(f"text{i}") for i in (1, 2)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b["script"] = ["".join(f"{n}{op}" for op, n in edit_script(x, y)) for x, y in zip(b.text1, b.text2, strict=True)]
            b["alignment"] = [render(x, y, width) for x, y in zip(b.text1, b.text2, strict=True)]
            yield b

    return rows.mapInPandas(run, "seq1 long, pos1 long, len1 long, seq2 long, pos2 long, len2 long, text1 string, text2 string, script string, alignment string")


Matrix = Mapping[tuple[str, str], int]


def _rows(a: str, b: str, match: int, mismatch: int, matrix: Matrix | None) -> Iterator[np.ndarray]:
    """For each character of a its scores against all of b; a pair that `matrix` lacks scores as its least."""
    y = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    least = min(matrix.values()) if matrix else 0
    known: dict[str, np.ndarray] = {}
    for c in a:
        if c not in known:
            if matrix is None:
                known[c] = np.where(y == ord(c), match, mismatch).astype(np.int64)
            else:
                score = {ord(d): matrix.get((c, d), least) for d in set(b)}
                known[c] = np.array([score[x] for x in y.tolist()], dtype=np.int64)
        yield known[c]


def local_alignment(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2, matrix: Matrix | None = None) -> tuple[int, int, int, int, int]:
    """(score, start in a, end in a, start in b, end in b) of the best local alignment; all 0 if none scores above 0.

    Of several the one that ends first in a, then in b, and of those the one that begins last in a, then in b. One row of
    the table is kept at a time: a pass forward finds the end, one backward from there the start.
    """
    if gap >= 0:
        raise ValueError("a gap must cost something")
    score, i, j = _best_end(a, b, match, mismatch, gap, matrix, 0)
    if not score:
        return 0, 0, 0, 0, 0
    again, m, n = _best_end(a[:i][::-1], b[:j][::-1], match, mismatch, gap, matrix, None)
    assert again == score
    return score, i - m, i, j - n, j


def _best_end(a: str, b: str, match: int, mismatch: int, gap: int, matrix: Matrix | None, floor: int | None) -> tuple[int, int, int]:
    """(score, end in a, end in b) of the best alignment, the first of several; it begins anywhere, or at 0 without a floor."""
    slope = gap * np.arange(len(b) + 1, dtype=np.int64)
    row = slope.copy() if floor is None else np.zeros(len(b) + 1, dtype=np.int64)
    best = (0, 0, 0)
    for i, scores in enumerate(_rows(a, b, match, mismatch, matrix), 1):
        new = row + gap
        np.maximum(new[1:], row[:-1] + scores, out=new[1:])
        if floor is not None:
            np.maximum(new, floor, out=new)
        # a gap in a run of any length: the best of all places before, less what the way from there costs
        row = np.maximum.accumulate(new - slope) + slope
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), i, top)
    return best


def local_alignments(pairs: DataFrame, match: int = 2, mismatch: int = -1, gap: int = -2, matrix: Matrix | None = None) -> DataFrame:
    """Rows (seq1, seq2, score, begin1, end1, begin2, end2) of pairs (seq1, seq2, text1, text2), whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [local_alignment(x, y, match, mismatch, gap, matrix) for x, y in zip(b.text1, b.text2, strict=True)]
            yield b[["seq1", "seq2"]].assign(**{c: [f[i] for f in found] for i, c in enumerate(("score", "begin1", "end1", "begin2", "end2"))})

    return pairs.select("seq1", "seq2", "text1", "text2").mapInPandas(run, "seq1 long, seq2 long, score long, begin1 long, end1 long, begin2 long, end2 long")
