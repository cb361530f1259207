"""Ready-made selections and projections of matches (seq1, pos1, len1, seq2, pos2, len2), and the contract for own ones.

An own function is any DataFrame -> DataFrame; a task applies it before its bounds. `Bundle` adds a
preparation and a result at the end, for functions that return something else than the matches they keep.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.postings import with_text
from seqloom.util import written


@dataclass(frozen=True)
class Bundle:
    """prepare: (db, query) -> anything; keep: (matches, prepared) -> matches; finish: (matches, prepared) -> result or None."""

    keep: Callable[[DataFrame, object], DataFrame]
    prepare: Callable[[DataFrame, DataFrame | None], object] = lambda db, query: None
    finish: Callable[[DataFrame, object], DataFrame] | None = None

    def apply(self, matches: DataFrame, db: DataFrame, query: DataFrame | None = None) -> DataFrame:
        ready = self.prepare(db, query)
        kept = self.keep(matches, ready)
        return kept if self.finish is None else self.finish(kept, ready)


def at_most(matches: DataFrame, most: int = 392) -> DataFrame:
    """Matches of `most` characters or fewer."""
    return matches.where(F.col("len1") <= most)


def _with_side(matches: DataFrame, seqs: DataFrame, side: int, names: tuple[str, ...]) -> DataFrame:
    return matches.join(seqs.select(F.col("seqnum").alias(f"seq{side}"), *[F.col(n).alias(f"__{n}{side}") for n in names]), f"seq{side}")


def _plain(found: DataFrame, matches: DataFrame) -> DataFrame:
    return found.select(*matches.columns)


def touching_an_end(matches: DataFrame, db: DataFrame) -> DataFrame:
    """Matches that touch the first or the last character of their database sequence."""
    found = _with_side(matches, db, 1, ("len",))
    return _plain(found.where((F.col("pos1") == 0) | (F.col("pos1") + F.col("len1") == F.col("__len1"))), matches)


def ending_at_the_end(matches: DataFrame, db: DataFrame) -> DataFrame:
    """Matches that end with their database sequence."""
    found = _with_side(matches, db, 1, ("len",))
    return _plain(found.where(F.col("pos1") + F.col("len1") == F.col("__len1")), matches)


def end_to_end(matches: DataFrame, db: DataFrame, query: DataFrame, most: int) -> DataFrame:
    """Matches without more than `most` characters left over on the same side of both sequences; mode 'P' turns side 2 round."""
    found = _with_side(_with_side(matches, db, 1, ("len",)), query, 2, ("len",))
    left1, right1 = F.col("pos1"), F.col("__len1") - F.col("pos1") - F.col("len1")
    left2, right2 = F.col("pos2"), F.col("__len2") - F.col("pos2") - F.col("len2")
    if "mode" in matches.columns:
        turned = F.col("mode") == "P"
        left2, right2 = F.when(turned, right2).otherwise(left2), F.when(turned, left2).otherwise(right2)
    return _plain(found.where(~(((left1 > most) & (left2 > most)) | ((right1 > most) & (right2 > most)))), matches)


def _text(seq: Column, start: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.substr(seq, (start + 1).cast("int"), n.cast("int"))


def starting_and_ending(matches: DataFrame, db: DataFrame, start: str = "ac", end: str = "gt") -> DataFrame:
    """Matches whose left instance starts and ends with the given strings and holds both."""
    found = _with_side(matches, db, 1, ("seq",))
    text = _text(F.col("__seq1"), F.col("pos1"), F.col("len1"))
    return _plain(found.where((F.col("len1") >= len(start) + len(end)) & text.startswith(start) & text.endswith(end)), matches)


def between_sites(matches: DataFrame, query: DataFrame, before: str = "ag", after: str = "gt") -> DataFrame:
    """Matches whose right instance stands between the given strings."""
    found = _with_side(matches, query, 2, ("seq",))
    seq = F.col("__seq2")
    left = F.when(F.col("pos2") >= len(before), _text(seq, F.col("pos2") - len(before), len(before)))
    right = _text(seq, F.col("pos2") + F.col("len2"), len(after))
    return _plain(found.where((left == before) & (right == after)), matches)


def after_symbol(matches: DataFrame, db: DataFrame, symbol: str) -> DataFrame:
    """Matches whose left instance begins with the symbol."""
    found = _with_side(matches, db, 1, ("seq",))
    return _plain(found.where(_text(F.col("__seq1"), F.col("pos1"), 1) == symbol), matches)


def context_windows(matches: DataFrame, db: DataFrame, width: int = 17, wildcard: str = "#") -> DataFrame:
    """Rows (seq1, start, text): windows of `width` characters that begin with the left instance; those with a wildcard are left out."""
    found = _with_side(matches, db, 1, ("seq", "len"))
    out = found.where(F.col("pos1") + width <= F.col("__len1")).select("seq1", F.col("pos1").alias("start"), _text(F.col("__seq1"), F.col("pos1"), width).alias("text"))
    return out.where(~F.contains("text", F.lit(wildcard)))


def shorter_than_sequence(matches: DataFrame, db: DataFrame) -> DataFrame:
    """Matches whose right instance is shorter than the database sequence."""
    found = _with_side(matches, db, 1, ("len",))
    return _plain(found.where(F.col("len2") < F.col("__len1")), matches)


def qgram_places(matches: DataFrame, q: int) -> DataFrame:
    """Rows (seq1, pos1, seq2, pos2) for each q-gram of a match."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("len1") - q))
    return matches.where((F.col("len1") >= q) & (F.col("len2") >= q)).withColumn("__at", at).select("seq1", (F.col("pos1") + F.col("__at")).alias("pos1"), "seq2", (F.col("pos2") + F.col("__at")).alias("pos2"))


def query_qgrams(matches: DataFrame, q: int) -> DataFrame:
    """Rows (seq2, pos2) for each q-gram of the right instance."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("len2") - q))
    return matches.where(F.col("len2") >= q).withColumn("__at", at).select("seq2", (F.col("pos2") + F.col("__at")).alias("pos2"))


def by_sequence(matches: DataFrame) -> DataFrame:
    """Rows (seqnum, other, len, start, other_start): matches between different sequences, listed for both."""
    rows = matches.where("seq1 != seq2")
    one = rows.select(F.col("seq1").alias("seqnum"), F.col("seq2").alias("other"), F.col("len1").alias("len"), F.col("pos1").alias("start"), F.col("pos2").alias("other_start"))
    return one.unionByName(rows.select(F.col("seq2").alias("seqnum"), F.col("seq1").alias("other"), F.col("len2").alias("len"), F.col("pos2").alias("start"), F.col("pos1").alias("other_start")))


def merged_matches(matches: DataFrame, percent: float, *, bin_size: int = 1 << 12) -> DataFrame:
    """Matches of one pair of sequences merged to their bounding boxes where they overlap enough.

    Two matches are linked if their overlaps in both dimensions, negative for gaps, add up to `percent` of the smaller
    one's lengths or more; matches that hang together by such links become one. An overlap that counts is positive in one
    dimension at least, so matches meet in the bins that they cover in either.
    """
    from seqloom.operators.cluster import components

    if percent <= 0:
        raise ValueError("the percentage must be positive")
    place = ["seq1", "pos1", "len1", "seq2", "pos2", "len2"]
    rows = written(matches.select(*place).distinct().withColumn("__id", F.struct("seq1", "seq2", "pos1", "pos2", "len1", "len2")))

    def met(i: int) -> DataFrame:
        start, end = F.col(f"pos{i}"), F.col(f"pos{i}") + F.col(f"len{i}")
        binned = rows.withColumn("__bin", F.explode(F.sequence(F.floor(start / bin_size), F.floor((end - 1) / bin_size))))
        a, b = binned.alias("a"), binned.alias("b")
        over = [F.least(F.col(f"a.pos{k}") + F.col(f"a.len{k}"), F.col(f"b.pos{k}") + F.col(f"b.len{k}")) - F.greatest(f"a.pos{k}", f"b.pos{k}") for k in (1, 2)]
        enough = over[0] + over[1] >= F.least(F.col("a.len1") + F.col("a.len2"), F.col("b.len1") + F.col("b.len2")) * percent / 100
        same = (F.col("a.seq1") == F.col("b.seq1")) & (F.col("a.seq2") == F.col("b.seq2")) & (F.col("a.__bin") == F.col("b.__bin"))
        return a.join(b, same & (F.col("a.__id") < F.col("b.__id")) & enough).select(F.col("a.__id").alias("a"), F.col("b.__id").alias("b"))

    found = components(met(1).unionByName(met(2)).distinct())
    own = rows.join(found, rows["__id"] == found["elem"], "left").withColumn("__of", F.coalesce("cluster", "__id"))
    box = own.groupBy("__of").agg(F.min("seq1").alias("seq1"), F.min("seq2").alias("seq2"), *[f for i in (1, 2) for f in (F.min(f"pos{i}").alias(f"pos{i}"), F.max(F.col(f"pos{i}") + F.col(f"len{i}")).alias(f"__e{i}"))])
    return box.select("seq1", "pos1", (F.col("__e1") - F.col("pos1")).alias("len1"), "seq2", "pos2", (F.col("__e2") - F.col("pos2")).alias("len2"))


def tag_ends(matches: DataFrame, db: DataFrame, query: DataFrame, least: int = 20) -> DataFrame:
    """Matches of `least` characters or more that end with their database sequence where the query goes on with gc or gt.

    A match of mode 'P' must begin with its database sequence, and the query's letters before it must be ac or gc.
    """
    found = _with_side(matches, db, 1, ("len",)).where(F.col("len1") >= least)
    found = found if "mode" in matches.columns else found.withColumn("mode", F.lit("D"))
    found = with_text(found.withColumn("__at", F.when(F.col("mode") == "P", F.col("pos2") - 2).otherwise(F.col("pos2") + F.col("len2"))), query, "seq2", F.col("__at"), F.lit(2), "__text")
    forward = (F.col("pos1") + F.col("len1") == F.col("__len1")) & F.col("__text").isin("gc", "gt")
    backward = (F.col("pos1") == 0) & (F.col("__at") >= 0) & F.col("__text").isin("ac", "gc")
    return _plain(found.where(F.when(F.col("mode") == "P", backward).otherwise(forward)), matches)


def length_and_places(matches: DataFrame) -> DataFrame:
    """Rows (len, pos1, pos2)."""
    return matches.select(F.col("len1").alias("len"), "pos1", "pos2")


def none(matches: DataFrame) -> DataFrame:
    """No match at all."""
    return matches.where("false")


def not_in(matches: DataFrame, others: DataFrame) -> DataFrame:
    """Matches that aren't among the others, by place and lengths; no rows tell that one set holds the other."""
    place = ["seq1", "pos1", "len1", "seq2", "pos2", "len2"]
    return matches.select(*place).join(others.select(*place), place, "left_anti")


def as_fasta(matches: DataFrame, db: DataFrame, query: DataFrame) -> DataFrame:
    """Rows (value): both instances as FASTA records."""
    found = _with_side(_with_side(matches, db, 1, ("seq",)), query, 2, ("seq",))
    record = lambda i: F.concat(F.lit(">"), F.concat_ws(" ", f"seq{i}", f"pos{i}", f"len{i}"), F.lit("\n"), _text(F.col(f"__seq{i}"), F.col(f"pos{i}"), F.col(f"len{i}")))
    return found.select(F.explode(F.array(record(1), record(2))).alias("value"))
