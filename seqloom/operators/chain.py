"""Chains of colinear fragments (start1, end1, start2, end2, weight), ends included, in each group.

A group, a pair of sequences as a rule, is chained in one task: its fragments are what two sequences share, and
chaining is sequential by nature. Groups come sorted, many to an Arrow batch; those of one size
are chained together. Every fragment looks at all its possible predecessors, vectorised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("global", "gap_cost", "overlaps", "local")


@dataclass(frozen=True)
class ChainMode:
    """kind: one of KINDS. cost: what a gap costs, 'sum' of both sides or 'max' of them. best: which local chains count: ('max', 0), ('score', least), ('best', k scores), ('percent', below the greatest)."""

    kind: str = "global"
    best: tuple[str, float] = ("max", 0)
    weight_factor: float = 1.0
    max_gap: int | None = None
    cost: str = "sum"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if self.cost not in ("sum", "max") or (self.cost == "max" and self.kind not in ("gap_cost", "local")):
            raise ValueError("the cost must be sum or max, and max needs gap costs")
        if self.weight_factor != 1.0 and self.kind not in ("gap_cost", "local"):
            raise ValueError("a weight factor needs gap costs")
        if self.best[0] not in ("max", "score", "best", "percent"):
            raise ValueError("unknown choice of local chains")


def default_weight(fragments: DataFrame) -> DataFrame:
    """`fragments` with the weight of those that have none: 2 for each paired character, 1 off for each unpaired one."""
    n1, n2 = F.col("end1") - F.col("start1") + 1, F.col("end2") - F.col("start2") + 1
    own = 2 * F.least(n1, n2) - F.abs(n1 - n2)
    return fragments.withColumn("weight", F.coalesce("weight", own) if "weight" in fragments.columns else own)


def best_chains(s1, e1, s2, e2, weight, mode: ChainMode) -> list[tuple[float, list[int]]]:
    """(score, fragments in order) of the chains that count; fragments are numbered as given."""
    s1, e1, s2, e2 = (np.asarray(x, dtype=np.int64) for x in (s1, e1, s2, e2))
    weight = np.asarray(weight, dtype=np.float64) * mode.weight_factor
    n = len(s1)
    if not n:
        return []
    order = np.lexsort((np.arange(n), s2, s1))
    s1, e1, s2, e2, weight = (x[order] for x in (s1, e1, s2, e2, weight))
    both = np.add if mode.cost == "sum" else np.maximum
    first_gap = both(s1 - s1.min(), s2 - s2.min()) if mode.kind == "gap_cost" else np.zeros(n)
    last_gap = both(e1.max() - e1, e2.max() - e2) if mode.kind == "gap_cost" else np.zeros(n)
    total = weight - first_gap
    before = np.full(n, -1)
    head = np.arange(n)
    for j in range(n):
        if mode.kind == "overlaps":
            fits = (s1[:j] < s1[j]) & (e1[:j] < e1[j]) & (s2[:j] < s2[j]) & (e2[:j] < e2[j])
        else:
            fits = (e1[:j] < s1[j]) & (e2[:j] < s2[j])
        if mode.max_gap is not None:
            fits &= (s1[j] - e1[:j] - 1 <= mode.max_gap) & (s2[j] - e2[:j] - 1 <= mode.max_gap)
        i = np.flatnonzero(fits)
        if not len(i):
            continue
        cost = np.zeros(len(i))
        if mode.kind in ("gap_cost", "local"):
            cost = (s1[j] - e1[i]) + (s2[j] - e2[i]) if mode.cost == "sum" else np.maximum(s1[j] - e1[i], s2[j] - e2[i]) - 1
        elif mode.kind == "overlaps":
            cost = np.maximum(0, e1[i] - s1[j] + 1) + np.maximum(0, e2[i] - s2[j] + 1)
        value = total[i] - cost
        k = int(np.argmax(value))
        alone = 0.0 if mode.kind in ("local", "global", "overlaps") else -np.inf
        if value[k] > alone or mode.kind == "gap_cost":
            total[j], before[j], head[j] = value[k] + weight[j], i[k], head[i[k]]
    final = total - last_gap
    if mode.kind != "local":
        ends = [int(np.argmax(final))]
    else:
        grown = np.zeros(n, dtype=bool)  # a chain that goes on with a higher score is not an end
        for j in range(n):
            if before[j] >= 0 and total[j] >= total[before[j]]:
                grown[before[j]] = True
        top: dict[int, int] = {}  # one chain for each first fragment
        for j in np.flatnonzero(~grown).tolist():
            if head[j] not in top or final[j] > final[top[head[j]]]:
                top[head[j]] = j
        ends = sorted(top.values(), key=lambda j: (-final[j], j))
        how, limit = mode.best
        scores = sorted({final[j] for j in ends}, reverse=True)
        least = {"max": scores[0], "score": limit, "best": scores[min(len(scores), max(1, int(limit))) - 1], "percent": scores[0] * (1 - limit / 100)}[how]
        ends = [j for j in ends if final[j] >= least]
    out = []
    for j in ends:
        path, k = [], j
        while k >= 0:
            path.append(int(order[k]))
            k = before[k]
        out.append((float(final[j]), path[::-1]))
    return out


def _chain_step(s1, e1, s2, e2, total, j: int, mode: ChainMode):
    """For fragment j of each group (a row): its best predecessor, that one's value, and whether there is any."""
    at = lambda x: x[:, j : j + 1]
    if mode.kind == "overlaps":
        fits = (s1[:, :j] < at(s1)) & (e1[:, :j] < at(e1)) & (s2[:, :j] < at(s2)) & (e2[:, :j] < at(e2))
        cost = np.maximum(0, e1[:, :j] - at(s1) + 1) + np.maximum(0, e2[:, :j] - at(s2) + 1)
    else:
        d1, d2 = at(s1) - e1[:, :j], at(s2) - e2[:, :j]
        fits = (d1 > 0) & (d2 > 0)
        cost = 0 if mode.kind == "global" else d1 + d2 if mode.cost == "sum" else np.maximum(d1, d2) - 1
    if mode.max_gap is not None:
        fits &= (at(s1) - e1[:, :j] - 1 <= mode.max_gap) & (at(s2) - e2[:, :j] - 1 <= mode.max_gap)
    value = np.where(fits, total[:, :j] - cost, -np.inf)
    k = value.argmax(axis=1)
    return k, value[np.arange(len(k)), k], fits.any(axis=1)


def equal_groups(s1, e1, s2, e2, weight, mode: ChainMode):
    """(score, group, step, fragment) as columns: the best chain of each of many groups of equal size, as best_chains() finds it.

    Arrays have a row for each group, its fragments sorted by start1 and start2. Not for local chains, of which there can be several.
    """
    weight = weight * mode.weight_factor
    n = s1.shape[1]
    both = np.add if mode.cost == "sum" else np.maximum
    gaps = mode.kind == "gap_cost"
    total = weight - both(s1 - s1.min(axis=1, keepdims=True), s2 - s2.min(axis=1, keepdims=True)) if gaps else weight.copy()
    before = np.full(s1.shape, -1)
    for j in range(1, n):
        k, value, some = _chain_step(s1, e1, s2, e2, total, j, mode)
        taken = some if gaps else some & (value > 0)
        total[taken, j], before[taken, j] = value[taken] + weight[taken, j], k[taken]
    final = total - both(e1.max(axis=1, keepdims=True) - e1, e2.max(axis=1, keepdims=True) - e2) if gaps else total
    rows = np.arange(len(s1))
    at = final.argmax(axis=1)
    score, groups, found = final[rows, at], [], []
    while len(rows):
        groups.append(rows)
        found.append(at)
        at = before[rows, at]
        rows, at = rows[at >= 0], at[at >= 0]
    depth = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    of, found = np.concatenate(groups), np.concatenate(found)
    return score[of], of, np.bincount(of)[of] - 1 - depth, found


def chains(fragments: DataFrame, group: list[str], mode: ChainMode) -> DataFrame:
    """Rows (group, chain, score, step, start1, end1, start2, end2, weight): the fragments of each chain in order."""
    types = {f.name: f.dataType.simpleString() for f in fragments.schema.fields}
    schema = ", ".join(f"`{g}` {types[g]}" for g in group) + ", chain long, score double, step long, start1 long, end1 long, start2 long, end2 long, weight double"

    places = ["start1", "start2", "end1", "end2", "weight"]
    names = [*group, "chain", "score", "step", "start1", "end1", "start2", "end2", "weight"]

    def one(pdf: pd.DataFrame) -> list[tuple]:
        key = tuple(pdf[g].iloc[0] for g in group)
        s1, e1, s2, e2, w = (pdf[c].to_numpy() for c in ("start1", "end1", "start2", "end2", "weight"))
        found = best_chains(s1, e1, s2, e2, w, mode)
        return [(*key, c, score, step, int(s1[i]), int(e1[i]), int(s2[i]), int(e2[i]), float(w[i])) for c, (score, path) in enumerate(found) for step, i in enumerate(path)]

    def many(held: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """The chains of whole groups, which begin at `starts`; groups of one size are chained together."""
        if mode.kind == "local":
            return pd.DataFrame([row for a, b in zip(starts, [*starts[1:], len(held)], strict=True) for row in one(held.iloc[a:b])], columns=names)
        sizes, parts = np.diff([*starts, len(held)]), []
        s1, e1, s2, e2 = (held[c].to_numpy(dtype=np.int64) for c in ("start1", "end1", "start2", "end2"))
        weight = held["weight"].to_numpy(dtype=np.float64)
        for n in np.unique(sizes):
            at = starts[sizes == n][:, None] + np.arange(n)
            score, of, step, k = equal_groups(s1[at], e1[at], s2[at], e2[at], weight[at], mode)
            part = held.iloc[at[of, k]]
            parts.append(part.assign(chain=0, score=score, step=step)[names])
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            held = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            change = (held[group] != held[group].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(change)
            if len(starts) > 1:
                yield many(held.iloc[: starts[-1]], starts[:-1])
            rest = held.iloc[starts[-1] :] if len(starts) else held  # the last group may go on
        if rest is not None and len(rest):
            yield many(rest, np.zeros(1, dtype=np.int64))

    dealt = fragments.select(*group, *places).repartition(*group).sortWithinPartitions(*group, *places)
    return dealt.mapInPandas(run, schema)


def match_fragments(matches: DataFrame) -> DataFrame:
    """Matches (seq1, pos1, len1, seq2, pos2, len2, score) as fragments."""
    return matches.select("seq1", "seq2", F.col("pos1").alias("start1"), (F.col("pos1") + F.col("len1") - 1).alias("end1"), F.col("pos2").alias("start2"), (F.col("pos2") + F.col("len2") - 1).alias("end2"), F.col("score").cast("double").alias("weight"))


def threaded(chained: DataFrame, db: DataFrame, query: DataFrame, group: tuple[str, str] = ("seq1", "seq2"), *, max_gap: int = 1000, max_errors: int | None = None) -> DataFrame:
    """Rows (seq1, pos1, len1, seq2, pos2, len2, distance): fragments of each chain joined where the texts between them are alike.

    Between neighbours the edit distance of both gaps is taken; a gap of more than `max_gap` characters on a side, or of
    more than `max_errors` edits, ends the match. Expects exact fragments.
    """
    w = Window.partitionBy(*group, "chain").orderBy("step")
    rows = chained.withColumns({"__e1": F.lag("end1").over(w), "__e2": F.lag("end2").over(w)})
    rows = rows.withColumns({"__g1": F.greatest(F.lit(0).cast("long"), F.col("start1") - F.col("__e1") - 1), "__g2": F.greatest(F.lit(0).cast("long"), F.col("start2") - F.col("__e2") - 1)})
    close = F.col("__e1").isNotNull() & (F.col("__g1") <= max_gap) & (F.col("__g2") <= max_gap)
    for i, seqs in ((1, db), (2, query)):
        own = seqs.select(F.col("seqnum").alias(group[i - 1]), F.col("seq").alias(f"__s{i}"))
        text = F.substr(F.col(f"__s{i}"), (F.col(f"__e{i}") + 2).cast("int"), F.col(f"__g{i}").cast("int"))
        rows = rows.join(own, group[i - 1]).withColumn(f"__t{i}", F.when(close, text)).drop(f"__s{i}")
    rows = rows.withColumn("__off", F.levenshtein("__t1", "__t2"))
    joined = F.col("__off").isNotNull() & (F.lit(True) if max_errors is None else F.col("__off") <= max_errors)
    rows = rows.withColumn("__new", F.when(joined, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    out = rows.groupBy(*group, "chain", "__run").agg(
        F.min("start1").alias("pos1"), F.max("end1").alias("__e1"), F.min("start2").alias("pos2"), F.max("end2").alias("__e2"), F.sum(F.when(F.col("__new") == 0, F.col("__off")).otherwise(0)).cast("long").alias("distance")
    )
    return out.select(group[0], "pos1", (F.col("__e1") - F.col("pos1") + 1).alias("len1"), group[1], "pos2", (F.col("__e2") - F.col("pos2") + 1).alias("len2"), "distance")
