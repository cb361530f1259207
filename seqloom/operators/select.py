"""Selection of sequences (seqnum, seq, len, description)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.alphabet import WILDCARD
from seqloom.operators.matches import absolute
from seqloom.operators.postings import with_text
from seqloom.util import row_numbers


def length_statistics(seqs: DataFrame) -> DataFrame:
    """One row: number, least, most and average length, all characters."""
    return seqs.agg(F.count("*").alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.avg("len").alias("average"), F.sum("len").alias("total"))


def length_distribution(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("len").agg(F.count("*").alias("cnt"))


def by_length(seqs: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    out = seqs.where(F.col("len") >= least)
    return out if most is None else out.where(F.col("len") <= most)


def by_number(seqs: DataFrame, numbers: DataFrame) -> DataFrame:
    """The sequences whose number is in `numbers` (seqnum)."""
    return seqs.join(numbers, "seqnum", "left_semi")


def by_description(seqs: DataFrame, pattern: str) -> DataFrame:
    return seqs.where(F.col("description").rlike(pattern))


def draw(seed: int, *columns: str) -> Column:
    """A number below 2**48 that depends on the seed and the columns' values only."""
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *columns)), F.lit(12)), 16, 10).cast("long")


def random_sequences(seqs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n sequences in an order that depends on number and seed only."""
    return seqs.orderBy(draw(seed, "seqnum"), "seqnum").limit(n)


def random_until(seqs: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """Sequences in random order until their lengths reach `total`; the sum runs in two levels, see util.row_numbers()."""
    rows = row_numbers(seqs.withColumn("__draw", draw(seed, "seqnum")), ["__draw", "seqnum"], F.col("len"))
    return rows.where(F.col("before") < total).drop("__draw", "before")


def substring(seqs: DataFrame, seqnum: int, start: int, length: int) -> DataFrame:
    return seqs.where(F.col("seqnum") == seqnum).select("seqnum", F.substr(F.col("seq"), F.lit(start + 1), F.lit(length)).alias("seq"))


def absolute_range(seqs: DataFrame, first: int, last: int) -> DataFrame:
    """Rows (seqnum, start, seq): the parts of sequences from absolute place `first` to `last`, both included."""
    at = absolute(seqs).select("seqnum", "abs_start")
    rows = seqs.join(at, "seqnum").where((F.col("abs_start") <= last) & (F.col("abs_start") + F.col("len") > first))
    low = F.greatest(F.lit(0).cast("long"), first - F.col("abs_start"))
    high = F.least(F.col("len"), last + 1 - F.col("abs_start"))
    return rows.select("seqnum", low.alias("start"), F.substr(F.col("seq"), (low + 1).cast("int"), (high - low).cast("int")).alias("seq"))


def random_substrings(seqs: DataFrame, n: int, least: int, most: int, seed: int = 42, *, tries: int = 20, bin_size: int = 1 << 16) -> DataFrame:
    """n substrings (id, seqnum, start, seq) of uniform lengths from random places; every second one is reversed.

    The places are drawn over all characters, so that a sequence is hit in proportion to its length. A substring that
    goes beyond its sequence or holds a wildcard is drawn again, `tries` times in all; what still fails is left out.
    """
    at = absolute(seqs)
    whole = at.agg(F.max(F.col("abs_start") + F.col("len"))).first()[0] or 0
    draws = seqs.sparkSession.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    unit = lambda k: draw(seed + k, "id", "try") / float(1 << 48)
    draws = draws.select("id", "try", F.floor(unit(1) * whole).alias("at"), (least + F.floor(unit(2) * (most - least + 1))).alias("n"))
    # draws meet the sequences whose absolute range covers their bin
    binned = at.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("abs_start") / bin_size), F.floor((F.col("abs_start") + F.col("len")) / bin_size))))
    met = draws.withColumn("__bin", F.floor(F.col("at") / bin_size)).join(binned, "__bin")
    met = met.where((F.col("at") >= F.col("abs_start")) & (F.col("at") + F.col("n") <= F.col("abs_start") + F.col("len"))).select("id", "try", "seqnum", (F.col("at") - F.col("abs_start")).alias("start"), "n")
    good = with_text(met, seqs, "seqnum", F.col("start"), F.col("n"), "text").where(~F.contains("text", F.lit(WILDCARD)))
    best = good.groupBy("id").agg(F.min(F.struct("try", "seqnum", "start", "text")).alias("m"))
    text = F.col("m.text")
    return best.select("id", "m.seqnum", "m.start", F.when(F.col("id") % 2 == 1, F.reverse(text)).otherwise(text).alias("seq"))


def longest(seqs: DataFrame, n: int = 2) -> DataFrame:
    return seqs.orderBy(F.col("len").desc(), "seqnum").limit(n)


def rightmost(matches: DataFrame) -> DataFrame:
    """For each database sequence the match furthest right; of several that with the least seq2 and pos2."""
    w = Window.partitionBy("seq1").orderBy(F.col("pos1").desc(), "seq2", "pos2", F.col("len").desc())
    return matches.withColumn("__row", F.row_number().over(w)).where("__row = 1").drop("__row")


def hit_by_several(matches: DataFrame, least: int = 2) -> DataFrame:
    """Database sequences that `least` different queries hit, and by how many."""
    return matches.groupBy("seq1").agg(F.count_distinct("seq2").alias("queries")).where(F.col("queries") >= least)
