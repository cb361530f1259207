"""Intervals (seqnum, start, end), half open: union, gaps, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marked(matches: DataFrame, keep: str = "both") -> DataFrame:
    """The instances to mark. keep: both, left, right, left_same or right_same (the last two only where both lie in one sequence)."""
    rows = matches.where("seq1 = seq2") if keep.endswith("_same") else matches
    left = rows.select(F.col("seq1").alias("seqnum"), F.col("pos1").alias("start"), (F.col("pos1") + F.col("len")).alias("end"))
    right = rows.select(F.col("seq2").alias("seqnum"), F.col("pos2").alias("start"), (F.col("pos2") + F.col("len")).alias("end"))
    return {"both": left.unionByName(right), "left": left, "right": right}[keep.split("_")[0]]


def merged(intervals: DataFrame, gap: int = 0) -> DataFrame:
    """Disjoint intervals that cover the same; those `gap` or less apart become one."""
    w = Window.partitionBy("seqnum").orderBy("start", "end")
    rows = intervals.withColumn("__reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__run", F.sum(F.when(F.col("start") <= F.col("__reach") + gap, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("seqnum", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def unmatched(seqs: DataFrame, intervals: DataFrame, least: int) -> DataFrame:
    """Rows (seqnum, start, len): longest parts of `least` characters or more that no interval touches."""
    covered = merged(intervals).select("seqnum", "start", "end")
    ends = seqs.select("seqnum", F.col("len").alias("start"), F.col("len").alias("end"))
    w = Window.partitionBy("seqnum").orderBy("start", "end")
    gaps = covered.join(seqs.select("seqnum"), "seqnum", "left_semi").unionByName(ends).withColumn("__from", F.coalesce(F.lag("end").over(w), F.lit(0).cast("long")))
    return gaps.where(F.col("start") - F.col("__from") >= max(1, least)).select("seqnum", F.col("__from").alias("start"), (F.col("start") - F.col("__from")).alias("len"))


def with_text(parts: DataFrame, seqs: DataFrame) -> DataFrame:
    return parts.join(seqs.select("seqnum", "seq"), "seqnum").withColumn("text", F.substr(F.col("seq"), (F.col("start") + 1).cast("int"), F.col("len").cast("int"))).drop("seq")


def masked(seqs: DataFrame, intervals: DataFrame, how: str = "X") -> DataFrame:
    """Rows (seqnum, seq, masked): covered characters as `how`, one character, or by tolower or toupper in that case.

    The disjoint intervals of a sequence are fewer than its characters, so a sequence's are put on one row.
    """
    spans = merged(intervals).groupBy("seqnum").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))

    def change(text: Column) -> Column:
        if how in ("tolower", "toupper"):
            return F.lower(text) if how == "tolower" else F.upper(text)
        return F.repeat(F.lit(how), F.length(text))

    part = lambda a, b: F.substr(F.col("seq"), (a + 1).cast("int"), (b - a).cast("int"))
    rows = seqs.select("seqnum", "seq").join(spans, "seqnum", "left").withColumn("__spans", F.coalesce("__spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("__spans"), i - 1)["end"])
    pieces = F.transform("__spans", lambda s, i: F.concat(part(before(i), s["start"]), change(part(s["start"], s["end"]))))
    tail = F.when(F.size("__spans") > 0, F.element_at("__spans", -1)["end"]).otherwise(F.lit(0).cast("long"))
    covered = F.aggregate("__spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return rows.select("seqnum", F.concat(F.array_join(pieces, ""), part(tail, F.length("seq").cast("long"))).alias("seq"), covered.alias("masked"))


def character_shares(parts: DataFrame, symbols: str) -> DataFrame:
    """`parts` (with text) and the share of each symbol."""
    count = lambda c: (F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))) / F.length("text")
    return parts.withColumns({f"share_{c}": count(c) for c in symbols})
