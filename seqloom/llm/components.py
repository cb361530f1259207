"""Connected components of a graph given by its edges, with no component gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import written

MAX_ROUNDS = 100


def _least(edges: DataFrame) -> DataFrame:
    """For each u the least of its neighbours v; pre-aggregated, so a star's centre is no hot key."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for each node of `edges`; root is the least node of its component.

    Alternating stars: each round hangs every node's larger neighbours, then its smaller ones, on the
    least node near it, until nothing moves; rounds grow with the logarithm of the longest path. Each
    round is written to the shared folder, which cuts the lineage, and so are the minima that edges are joined with:
    a table that was written is a plain side of a join, which Spark can split where one node has very many edges. Loops and repeated edges do no harm; rows
    with a null end are left out; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(_least(both).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large)
        # every edge now points from the larger node u to a smaller v
        least = written(_least(large))
        hung = large.join(least, "u")
        now = written(hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
