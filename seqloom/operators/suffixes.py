"""All suffixes of all sequences in lexicographic order, and what follows from it.

A place's end is greater than any character, so a string comes after those that it begins; suffixes that are equal up to
the ends come by seqnum and place. Order by prefix doubling: after a round with prefixes of n characters, a suffix's rank
and that of the suffix n further on give the rank for 2n. Every round is a distributed sort of numbers; no suffix is
written out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.postings import pieces, windows
from seqloom.util import row_numbers, written

#: Characters that the first round compares; greater than any character of a sequence.
FIRST, END = 16, "\U0010ffff"


def prefix_length(total: int, symbols: int, most: bool = False) -> int:
    """Characters by which suffixes are dealt into buckets: about 8 places to a bucket, or 2 at most."""
    return max(1, int(math.log(max(symbols, total * (4 if most else 1) / 8)) / math.log(symbols) + 1e-9))


def _first_keys(seqs: DataFrame) -> DataFrame:
    """Rows (seqnum, pos, key): the first characters of every suffix, filled up at the sequence's end."""
    padded = seqs.where(F.length("seq") > 0).select("seqnum", F.concat(F.col("seq"), F.lit(END * (FIRST - 1))).alias("seq"))
    cut = pieces(padded, FIRST)
    at = F.sequence(F.lit(0), F.length("part") - FIRST)
    return cut.select("seqnum", "start", "part", F.explode(at).alias("i")).select("seqnum", (F.col("start") + F.col("i")).alias("pos"), F.substr(F.col("part"), F.col("i") + 1, F.lit(FIRST)).alias("key"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with rank, the number of rows whose keys are less."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    ranks = row_numbers(counts, keys, F.col("__n")).select(*keys, F.col("before").alias("rank"), F.col("__n").alias("same"))
    return rows.join(written(ranks), keys)


def suffix_order(seqs: DataFrame, depth: int | None = None) -> DataFrame:
    """Rows (rank, seqnum, pos): the place of each suffix in the order, from 0. depth: compare so many characters only (rounded up to 16 times a power of two)."""
    now = written(_ranked(_first_keys(seqs), ["key"]).select("seqnum", "pos", "rank", "same"))
    n = FIRST
    while (depth is None or n < depth) and not now.where("same > 1").isEmpty():
        ahead = now.select("seqnum", (F.col("pos") - n).alias("pos"), F.col("rank").alias("next"))
        # where nothing follows the end decides, which is greater than any rank
        both = now.join(ahead, ["seqnum", "pos"], "left").select("seqnum", "pos", F.col("rank").alias("first"), F.coalesce("next", F.lit(2**62)).alias("next"), F.col("same").alias("were"))
        new = written(_ranked(both, ["first", "next"]).select("seqnum", "pos", "rank", "same", "were"))
        n *= 2
        if new.where("same != were").isEmpty() and new.where("same > 1").join(new.select("seqnum", (F.col("pos") - n // 2).alias("pos")), ["seqnum", "pos"], "left_semi").isEmpty():
            now = new
            break
        now = new.select("seqnum", "pos", "rank", "same")
    return row_numbers(now, ["rank", "seqnum", "pos"]).select(F.col("before").alias("rank"), "seqnum", "pos")


def neighbours(order: DataFrame, seqs: DataFrame) -> DataFrame:
    """`order` with lcp, the characters that a suffix shares with the one before it, and bwt, the character left of it.

    lcp is null for the first suffix, bwt at a sequence's start. Neighbours meet by rank, not in a window.
    """
    before = order.select((F.col("rank") + 1).alias("rank"), F.col("seqnum").alias("s"), F.col("pos").alias("p"))
    own = seqs.select("seqnum", "seq")
    text = lambda c, p: F.substr(c, (p + 1).cast("int"), F.lit(2**31 - 1))
    rows = order.join(before, "rank", "left").join(own, "seqnum").join(own.select(F.col("seqnum").alias("s"), F.col("seq").alias("seq_s")), "s", "left")
    a, b = text(F.col("seq"), F.col("pos")), text(F.col("seq_s"), F.col("p"))
    same = F.zip_with(F.split(F.left(a, F.length(b)), ""), F.split(F.left(b, F.length(a)), ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    off = F.array_position(same, False)
    lcp = F.when(F.col("s").isNotNull(), F.when(off == 0, F.least(F.length(a), F.length(b))).otherwise(off - 1)).cast("long")
    return rows.select("rank", "seqnum", "pos", lcp.alias("lcp"), F.when(F.col("pos") > 0, F.substr(F.col("seq"), F.col("pos").cast("int"), F.lit(1))).alias("bwt"))


def buckets(order: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """Rows (prefix, first, cnt): for each prefix of k characters the rank of its first suffix and how many there are."""
    rows = windows(seqs, k).join(order, ["seqnum", "pos"])
    return rows.groupBy(F.col("kmer").alias("prefix")).agg(F.min("rank").alias("first"), F.count("*").alias("cnt"))
