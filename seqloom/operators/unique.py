"""Shortest unique prefixes, and profile search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.alphabet import WILDCARD
from seqloom.operators.postings import windows
from seqloom.util import written


def minimum_unique_prefixes(db: DataFrame, query: DataFrame, least: int, most: int) -> DataFrame:
    """Rows (seqnum, pos, length): from each place of the query the shortest string that occurs once in the database, if it has `least` to `most` characters.

    A string occurs no more often than one it begins with, so places whose string of least - 1 characters doesn't occur
    several times are out. Lengths go up from there; only places whose string still occurs several times go on, and
    the database is cut to their strings.
    """
    out, open_ = None, None
    for k in range(max(1, least - 1), most + 1):
        at = windows(query, k).where(~F.contains("kmer", F.lit(WILDCARD)))
        if open_ is not None:
            at = at.join(open_, ["seqnum", "pos"], "left_semi")
        counts = windows(db, k).join(at.select("kmer").distinct(), "kmer", "left_semi").groupBy("kmer").agg(F.count("*").alias("n"))
        known = written(at.join(counts, "kmer").select("seqnum", "pos", "n"))
        if k >= least:
            found = known.where("n = 1").select("seqnum", "pos", F.lit(k).cast("long").alias("length"))
            out = found if out is None else out.unionByName(found)
        open_ = known.where("n > 1").select("seqnum", "pos")
        if open_.isEmpty():
            break
    empty = query.select("seqnum", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("length")).where("false")
    return empty if out is None else out


def profile_score(kmer: Column, profile: list[dict[str, float]]) -> Column:
    """The sum of a position-specific profile's scores of a string; null with a symbol that the profile lacks."""
    out = F.lit(0.0)
    for i, column in enumerate(profile):
        c = F.substr(kmer, F.lit(i + 1), F.lit(1))
        term = F.lit(None).cast("double")
        for symbol, value in column.items():
            term = F.when(c == symbol, F.lit(float(value))).otherwise(term)
        out = out + term
    return out


def profile_search(seqs: DataFrame, profile: list[dict[str, float]], threshold: float) -> DataFrame:
    """Rows (seqnum, pos, score) of the places whose score reaches the threshold."""
    return windows(seqs, len(profile)).withColumn("score", profile_score(F.col("kmer"), profile)).where(F.col("score") >= threshold).select("seqnum", "pos", "score")


def burrows_wheeler(text: str) -> tuple[str, int]:
    """The last column of the sorted rotations of `text` and the row of `text` itself; for short texts."""
    rows = sorted(range(len(text)), key=lambda i: text[i:] + text[:i])
    return "".join(text[i - 1] for i in rows), rows.index(0) if text else 0


def burrows_wheeler_back(last: str, row: int) -> str:
    order = sorted(range(len(last)), key=lambda i: (last[i], i))
    out, at = [], row
    for _ in last:
        at = order[at]
        out.append(last[at])
    return "".join(out)
