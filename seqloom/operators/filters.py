"""Filters, orders and best matches. Matches have len1, len2, distance and what score_columns() adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import scores

#: Orders by name: column and direction.
ORDERS = {
    "la": ("len1", True), "ld": ("len1", False), "ia": ("pos1", True), "id": ("pos1", False),
    "ja": ("pos2", True), "jd": ("pos2", False), "ea": ("evalue", True), "ed": ("evalue", False),
    "sa": ("score", True), "sd": ("score", False), "ida": ("identity", True), "idd": ("identity", False),
}
TIES = ("seq1", "pos1", "seq2", "pos2")


def score_columns(matches: DataFrame, multiplier: Column, symbols: int, complete: bool = False) -> DataFrame:
    """Matches with score, identity and evalue."""
    n1, n2, d = F.col("len1"), F.col("len2"), F.col("distance")
    return matches.withColumns({"score": scores.score(n1, n2, d), "identity": scores.identity(n1, n2, d), "evalue": scores.evalue(scores.match_length(n1, n2, d, complete), d, multiplier, symbols)})


def exact_columns(matches: DataFrame) -> DataFrame:
    """Exact matches (len) with len1, len2 and distance 0."""
    return matches.withColumns({"len1": F.col("len"), "len2": F.col("len"), "distance": F.lit(0).cast("long")})


def keep(matches: DataFrame, *, length: int | None = None, identity: float | None = None, score: int | None = None, evalue: float | None = None, gap: tuple[int | None, int | None] | None = None, modes: str | None = None) -> DataFrame:
    """Matches within all bounds that are given. A least score holds for mismatches by its size."""
    out = matches
    if length is not None:
        out = out.where((F.col("len1") >= length) & (F.col("len2") >= length))
    if identity is not None:
        out = out.where(F.col("identity") >= identity)
    if score is not None:
        out = out.where(F.abs("score") >= score)
    if evalue is not None:
        out = out.where(F.col("evalue") <= evalue)
    if gap is not None:
        low, high = gap
        out = out if low is None else out.where(F.col("gap") >= low)
        out = out if high is None else out.where(F.col("gap") <= high)
    if modes is not None:
        out = out.where(F.col("mode").isin(list(modes)))
    return out


def ordered(matches: DataFrame, order: str) -> DataFrame:
    """Matches in one of ORDERS, ties by place."""
    column, up = ORDERS[order]
    key = F.abs(column) if column == "score" else F.col(column)
    return matches.orderBy(key.asc() if up else key.desc(), *TIES)


def by_diagonal(matches: DataFrame) -> DataFrame:
    """Matches by diagonal, the greatest pos2 - pos1 first, then by pos2."""
    return matches.orderBy((F.col("pos2") - F.col("pos1")).desc(), "pos2", *TIES)


def best(matches: DataFrame, n: int) -> DataFrame:
    """The n best different matches: E-value, then longer and further left first."""
    keys = ["evalue", F.col("len1").desc(), "seq1", "pos1", F.col("len2").desc(), "seq2", "pos2"]
    mode = ["mode"] if "mode" in matches.columns else []
    return matches.dropDuplicates(["len1", "seq1", "pos1", "len2", "seq2", "pos2", *mode]).orderBy(*keys, *mode).limit(n)


def without_contained(matches: DataFrame, *, bin_size: int = 1 << 14) -> DataFrame:
    """Matches that lie in no other in both dimensions; equal ones stay once.

    Pairs of one (seq1, seq2) are compared only where the other starts in the same bin of side 1 or in one it
    reaches over, so that no two far matches meet.
    """
    rows = matches.dropDuplicates(["seq1", "pos1", "len1", "seq2", "pos2", "len2"])
    outer = rows.select(F.col("seq1").alias("o_seq1"), F.col("seq2").alias("o_seq2"), F.col("pos1").alias("o_pos1"), (F.col("pos1") + F.col("len1")).alias("o_end1"), F.col("pos2").alias("o_pos2"), (F.col("pos2") + F.col("len2")).alias("o_end2"))
    outer = outer.withColumn("o_bin", F.explode(F.sequence(F.floor(F.col("o_pos1") / bin_size), F.floor(F.col("o_end1") / bin_size))))
    inner = rows.withColumn("__bin", F.floor(F.col("pos1") / bin_size))
    inside = (
        (F.col("o_seq1") == F.col("seq1")) & (F.col("o_seq2") == F.col("seq2")) & (F.col("o_bin") == F.col("__bin"))
        & (F.col("o_pos1") <= F.col("pos1")) & (F.col("o_end1") >= F.col("pos1") + F.col("len1"))
        & (F.col("o_pos2") <= F.col("pos2")) & (F.col("o_end2") >= F.col("pos2") + F.col("len2"))
        & ~((F.col("o_pos1") == F.col("pos1")) & (F.col("o_end1") == F.col("pos1") + F.col("len1")) & (F.col("o_pos2") == F.col("pos2")) & (F.col("o_end2") == F.col("pos2") + F.col("len2")))
    )
    return inner.join(outer, inside, "left_anti").drop("__bin")
