"""A matching task: what to match, how, within which bounds, and what to do with the matches.

A task is checked when it is made; run() puts the lazy DataFrames together, so that Spark plans the whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import scores
from seqloom.functions.alphabet import reverse_complement
from seqloom.operators import complete, extend, filters, matches, tandem

KINDS = ("maximal", "supermaximal", "tandem", "mum", "mum_candidates", "complete")


@dataclass(frozen=True)
class Errors:
    """A number of errors: as given, percent of the pattern, or the least up to that percentage."""

    value: int
    mode: str = ""

    @classmethod
    def parse(cls, text: str) -> Errors:
        """'3', '10p' or '10b'."""
        mode = text[-1] if text[-1] in "pb" else ""
        value = int(text.rstrip("pb"))
        if value < 1 or (mode and value > 100):
            raise ValueError(f"not a number of errors: {text}")
        return cls(value, mode)


@dataclass(frozen=True)
class MatchTask:
    """length: least length. mismatches, edits, drop: at most one of them. select: DataFrame -> DataFrame, before the bounds."""

    kind: str = "maximal"
    length: int | None = None
    direct: bool = True
    palindromic: bool = False
    mismatches: Errors | None = None
    edits: Errors | None = None
    drop: int | None = None
    drop_edits: bool = False
    seed: int | None = None
    symbols: int = 4
    identity: int | None = None
    score: int | None = None
    evalue: float | None = None
    gap: tuple[int | None, int | None] | None = None
    select: Callable[[DataFrame], DataFrame] | None = None
    best: int | None = None
    order: str | None = None

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.kind in KINDS, f"kind must be one of {KINDS}")
        need((self.length is not None) != (self.kind == "complete"), "a least length is for all kinds but whole patterns")
        need(self.length is None or self.length > 0, "the least length must be positive")
        need(sum(x is not None for x in (self.mismatches, self.edits, self.drop)) <= 1, "mismatches, edits and drop exclude each other")
        need(self.kind in ("maximal", "complete") or (self.mismatches is self.edits is self.drop is None), "errors are for maximal and whole-pattern matches")
        need(self.kind != "complete" or self.drop is None, "whole patterns take no drop")
        need(self.drop is None or 1 <= self.drop <= 255, "drop must be from 1 to 255")
        need(self.identity is None or 1 <= self.identity <= 100, "identity must be from 1 to 100")
        need(self.evalue is None or self.evalue == 0 or self.evalue >= scores.FLOOR, "evalue is too small")
        need(self.order is None or self.order in filters.ORDERS, f"order must be one of {sorted(filters.ORDERS)}")
        need(self.order is None or self.best is not None, "an order needs a number of best matches")
        need(self.direct or self.palindromic, "no direction")
        need(self.kind not in ("tandem", "supermaximal") or not self.palindromic, "this kind is direct only")
        for e in (self.mismatches, self.edits):
            need(e is None or not e.mode or self.kind == "complete", "percentages are for whole patterns")


def _exact(task: MatchTask, db: DataFrame, query: DataFrame | None) -> DataFrame:
    least = task.length
    if query is None:
        found = {
            "maximal": lambda: matches.self_matches(db, least),
            "supermaximal": lambda: matches.supermaximal_repeats(db, least),
            "tandem": lambda: tandem.tandem_repeats(db, least).select(F.col("seqnum").alias("seq1"), F.col("pos").alias("pos1"), F.col("seqnum").alias("seq2"), (F.col("pos") + F.col("period")).alias("pos2"), F.col("period").alias("len")),
        }
        back = matches.palindromic_self_matches
    else:
        found = {"maximal": lambda: matches.query_matches(db, query, least), "mum": lambda: matches.mums(db, query, least), "mum_candidates": lambda: matches.mum_candidates(db, query, least)}
        back = lambda d, n: matches.palindromic_query_matches(d, query, n)
    if task.kind not in found:
        raise ValueError(f"{task.kind} needs {'a query' if query is None else 'no query'}")
    parts = [found[task.kind]().withColumn("mode", F.lit("D"))] if task.direct else []
    if task.palindromic:
        parts.append(back(db, least).withColumn("mode", F.lit("P")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _extended(task: MatchTask, db: DataFrame, other: DataFrame, seeds: DataFrame) -> DataFrame:
    if task.mismatches:
        return extend.extend_hamming(seeds, db, other, task.length, task.mismatches.value, seed=task.seed, symbols=task.symbols)
    if task.edits:
        return extend.extend_edit(seeds, db, other, task.length, task.edits.value, seed=task.seed, symbols=task.symbols)
    return extend.extend_xdrop(seeds, db, other, task.drop, edits=task.drop_edits, seed=task.seed)


def _with_errors(task: MatchTask, db: DataFrame, query: DataFrame | None) -> DataFrame:
    """Extended matches of both directions; palindromic ones are extended along the other strand, and side 2 is turned back."""
    errors = (task.mismatches or task.edits).value if task.mismatches or task.edits else None
    least = extend.seed_length(task.length, errors, task.seed)
    other, parts = db if query is None else query, []
    if task.direct:
        seeds = matches.self_matches(db, least) if query is None else matches.query_matches(db, query, least)
        parts.append(_extended(task, db, other, seeds).withColumn("mode", F.lit("D")))
    if task.palindromic:
        back = other.withColumn("seq", reverse_complement(F.col("seq")))
        found = _extended(task, db, back, matches.query_matches(db, back, least)).join(other.select(F.col("seqnum").alias("seq2"), F.length("seq").cast("long").alias("__n")), "seq2")
        found = found.withColumn("pos2", F.col("__n") - F.col("pos2") - F.col("len2")).drop("__n").withColumn("mode", F.lit("P"))
        if query is None:
            found = found.where((F.col("seq1") < F.col("seq2")) | ((F.col("seq1") == F.col("seq2")) & (F.col("pos1") <= F.col("pos2"))))
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("score")


def run(task: MatchTask, db: DataFrame, query: DataFrame | None = None) -> DataFrame:
    """Matches (seq1, pos1, len1, seq2, pos2, len2, mode, distance, score, identity, evalue) of the task."""
    n = db.agg((F.sum(F.col("len") + 1) - 1).cast("double").alias("__n"))
    if task.kind == "complete":
        if query is None:
            raise ValueError("whole patterns need a query")
        e = task.mismatches or task.edits
        options = {"percent": bool(e.mode), "best": e.mode == "b"} if e else {}
        search = complete.exact if e is None else (lambda d, q: complete.hamming(d, q, e.value, **options)) if task.mismatches else (lambda d, q: complete.edit(d, q, e.value, **options))
        parts = [search(db, query).withColumn("mode", F.lit("D"))] if task.direct else []
        if task.palindromic:
            parts.append(complete.palindromic(search, db, query).withColumn("mode", F.lit("P")))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.join(query.select(F.col("seqnum").alias("seq2"), F.length("seq").cast("long").alias("len2")), "seq2").withColumn("pos2", F.lit(0).cast("long"))
    else:
        found = _with_errors(task, db, query) if task.mismatches or task.edits or task.drop is not None else filters.exact_columns(_exact(task, db, query))
    found = found.crossJoin(F.broadcast(n))
    size = F.col("__n")
    if task.kind == "complete":
        factor = scores.multiplier_complete(size)
    elif query is None:
        factor = scores.multiplier_self(size)
    else:
        found = found.join(query.select(F.col("seqnum").alias("seq2"), F.length("seq").cast("double").alias("__m")), "seq2")
        factor = scores.multiplier_query(size, F.col("__m"))
    found = filters.score_columns(found, factor, task.symbols, task.kind == "complete").drop("__n", "__m")
    if task.select is not None:
        found = task.select(found)
    if task.gap is not None:
        found = matches.with_gap(found.withColumn("len", F.col("len1")), db).drop("len")
    found = filters.keep(found, length=task.length, identity=task.identity, score=task.score, evalue=task.evalue, gap=task.gap)
    if task.order is not None:
        found = filters.without_contained(found)
    if task.best is not None:
        found = filters.best(found, task.best)
    return found if task.order is None else filters.ordered(found, task.order)
