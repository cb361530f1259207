"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Each document gets the rate 2 / (1 + exp(-a * size / scale)) with one multiplier a for each source: of all
rates between 0 and 2 that give the source its target of words, those nearest to 1 in relative entropy. The
multipliers are the optimum of a convex dual that falls apart by source. Newton's method finds them, kept
inside a bracket; each iteration is one aggregation over the (source, size) counts, so that it costs no
more than the different sizes. A source that must shrink gives up its long documents first, one that must
grow repeats those first.

Rates are rounded into 0, 1 or 2 copies: the whole part, and one more where the rest exceeds a draw that
depends on the document's id only, plus a shift for each source. The shift is looked up in two histograms
and among the few documents of one bin, such that the copies' words come near the target; up to
three documents of each source that are no larger than what is still off are then turned. No step gathers a source: sums are pre-aggregated and the table of sources is
broadcast while it has SENT rows or fewer.

A null text has size 0 and is never taken. A null source is a source of its own that comes last. Repeated
rows and ids each give a row; equal ids of equal size and source are taken alike. An empty table gives no rows. Extra columns
are ignored by mix() and kept by mixed_documents().
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import packed, quoted, unpacked, written

#: Weights of the sources in their order, repeating; words of the mix for each word there is; copies at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORDS = r"[^\x20\x09-\x0D]++"
ROUNDS, CLOSE = 60, 1e-6
BINS = 4096
REPAIRS = 3
#: Sources, of about 100 bytes each, up to which their table is broadcast.
SENT = 100_000


def _per_source(table: DataFrame, sources: int) -> DataFrame:
    """A table of one row for each source, sent to all tasks while there are SENT sources or fewer, so that no join deals rows out by source."""
    return F.broadcast(table) if sources <= SENT else table


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows (src, source_size, scale, target) from rows (src, size).

    Targets share `share` of all words by weight and stop at `most` times a source's size; what is over
    is shared again by weight. The level at which it all comes out is found by sorting the sources by
    limit over weight.
    """
    own = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.try_divide(F.sum(F.col("size").cast("double") * F.col("size")), F.sum("size")).alias("scale"))
    order = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * most)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    whole = Window.partitionBy()
    rest = Window.orderBy(F.col("limit") / F.col("weight"), "src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = own.withColumns(
        {
            "below": F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "left": F.sum("weight").over(rest),
            "all": F.sum("source_size").over(whole) * share,
        }
    )
    ratio, level = F.col("limit") / F.col("weight"), (F.col("all") - F.col("below")) / F.col("left")
    first = F.min(F.when(level <= ratio, F.struct(ratio.alias("ratio"), F.col("src"), level.alias("level")))).over(whole)
    own = own.withColumn("level", first["level"])
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("level")))
    return own.select("src", "source_size", "scale", target.alias("target"))


def _rate(most: int) -> Column:
    """0 and `most` where the target asks for nothing or for all; else the tilted rate."""
    return F.when(F.col("full"), F.lit(float(most))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(most / (1 + F.exp(-F.col("a") * F.col("size") / F.col("scale"))))


def multipliers(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """`targets` with the multiplier a of each source and full, true where every document has `most` copies.

    The dual's gradient is the words that the rates give less the target; its curvature the sum of
    size * rate * (1 - rate / most) * size / scale.
    """
    sources = targets.count()
    counts = written(sizes.where("size > 0").groupBy("src", "size").agg(F.count("*").cast("double").alias("n")))
    # right if all documents were of one size
    part = F.try_divide(F.col("target"), F.col("source_size") * float(most))
    start = F.when((part > 0) & (part < 1), F.log(part / (1 - part))).otherwise(0.0)
    now = written(
        targets.withColumns({"full": F.col("target") >= F.col("source_size") * float(most) * (1 - 1e-12), "a": start, "low": F.lit(-1e6), "high": F.lit(1e6), "off": F.lit(1.0)})
    )
    for _ in range(ROUNDS):
        open_ = now.where(~F.col("full") & (F.col("target") > 0) & (F.col("off") > CLOSE)).select("src", "source_size", "scale", "target", "full", "a")
        if open_.isEmpty():
            break
        rate = _rate(most)
        sums = (
            counts.join(_per_source(open_, sources), "src")
            .withColumn("r", rate)
            .groupBy("src")
            .agg(
                F.sum(F.col("n") * F.col("size") * F.col("r")).alias("got"),
                F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("scale") * F.col("r") * (1 - F.col("r") / most)).alias("slope"),
            )
        )
        over = F.col("got") > F.col("target")
        both = now.join(sums, "src", "left").withColumns({"low": F.when(F.col("got").isNotNull() & ~over, F.col("a")).otherwise(F.col("low")), "high": F.when(over, F.col("a")).otherwise(F.col("high"))})
        newton = F.col("a") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        # from a bracket that is open on one side, steps go no further than 4 at a time
        newton = F.greatest(F.least(newton, F.col("a") + 4), F.col("a") - 4)
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False)) & (F.col("slope") > 0)
        step = F.when(inside, newton).when((F.col("low") > -1e6) & (F.col("high") < 1e6), (F.col("low") + F.col("high")) / 2).otherwise(F.col("a") + F.when(over, -4.0).otherwise(4.0))
        off = F.try_divide(F.abs(F.col("got") - F.col("target")), F.col("target"))
        now = written(
            both.select(
                "src", "source_size", "scale", "target", "full",
                F.when(F.col("got").isNull() | (off <= CLOSE), F.col("a")).otherwise(step).alias("a"),
                "low", "high", F.coalesce(off, "off").alias("off"),
            )
        )
    else:
        left = now.where(~F.col("full") & (F.col("target") > 0) & (F.col("off") > CLOSE)).agg(F.count("*"), F.max("off")).first()
        if left[0]:
            warnings.warn(f"{left[0]} sources are not settled after {ROUNDS} rounds; the farthest is off its target by {left[1]:.2g} of it", stacklevel=2)
    return now.drop("low", "high", "off")


def _cuts(rated: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (src, cut): a document gets one copy more if its key is `cut` or more."""
    wanted = targets.select("src", "target").join(rated.groupBy("src").agg(F.sum(F.floor("rate") * F.col("size")).alias("whole")), "src", "left").select("src", (F.col("target") - F.coalesce("whole", F.lit(0))).alias("need"))
    rows, sources = rated.where((F.col("rest") > 0) & (F.col("size") > 0)), targets.count()
    down = Window.partitionBy("src").orderBy(F.col("bin").desc())
    bin_of = lambda lo, width: F.least(F.lit(BINS - 1), F.floor((F.col("key") - lo) / width * BINS)).cast("long")
    found = wanted.withColumns({"lo": F.lit(-1.0), "width": F.lit(2.0), "above": F.lit(0.0)})
    for _ in range(2):
        near = rows.join(_per_source(found, sources), "src").where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("lo") + F.col("width")))
        bins = near.groupBy("src", "need", "lo", "width", "above", bin_of(F.col("lo"), F.col("width")).alias("bin")).agg(F.sum("size").alias("s"))
        bins = bins.withColumn("upto", F.sum("s").over(down) + F.col("above"))
        # the first bin from above that reaches the need; the lowest if none does
        crossing = bins.withColumn("reach", F.col("upto") >= F.col("need")).withColumn("row", F.row_number().over(Window.partitionBy("src").orderBy(F.col("reach").desc(), F.when(F.col("reach"), -F.col("bin")).otherwise(F.col("bin"))))).where("row = 1")
        found = written(crossing.select("src", "need", (F.col("lo") + F.col("bin") * F.col("width") / BINS).alias("lo"), (F.col("width") / BINS).alias("width"), (F.col("upto") - F.col("s")).alias("above")))
    few = rows.join(_per_source(found, sources), "src").where((F.col("key") >= F.col("lo") - 1e-12) & (F.col("key") < F.col("lo") + F.col("width") + 1e-12))
    few = few.groupBy("src", "need", "above", "lo", "key").agg(F.sum("size").alias("s"))
    few = few.withColumn("upto", F.sum("s").over(Window.partitionBy("src").orderBy(F.col("key").desc())) + F.col("above"))
    # to stop before this key leaves upto - s words, to stop after it upto
    choice = few.select("src", F.explode(F.array(F.struct(F.abs(F.col("upto") - F.col("need")).alias("off"), F.col("key").alias("cut")), F.struct(F.abs(F.col("upto") - F.col("s") - F.col("need")).alias("off"), (F.col("key") + 1e-13).alias("cut")))).alias("x"))
    return wanted.join(choice.groupBy("src").agg(F.min("x").alias("x")).select("src", F.col("x.cut").alias("cut")), "src", "left")


def _repaired(rated: DataFrame, cuts: DataFrame) -> DataFrame:
    """`cuts` with flip: ids of up to REPAIRS documents whose last copy is given or taken after all.

    Each round turns the largest document that is no larger than what is still off.
    """
    rows = rated.where((F.col("rest") > 0) & (F.col("size") > 0)).select("src", "id", "size", "key")
    sources = cuts.count()
    now = written(cuts.withColumn("flip", F.array().cast("array<bigint>")))
    for _ in range(REPAIRS):
        more = (F.col("key") >= F.col("cut")) != F.array_contains("flip", F.col("id"))
        state = rows.join(_per_source(now, sources), "src").withColumn("more", more)
        gap = state.groupBy("src").agg(F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).alias("got"))
        gap = now.join(gap, "src").select("src", (F.col("need") - F.col("got")).alias("gap"))
        fits = (F.when(F.col("gap") > 0, ~F.col("more")).otherwise(F.col("more"))) & (F.col("size") <= F.abs("gap")) & F.col("id").isNotNull() & ~F.array_contains("flip", F.col("id"))
        best = state.join(_per_source(gap, sources), "src").where(fits).groupBy("src").agg(F.max(F.struct("size", "id")).alias("best"))
        now = written(now.join(best, "src", "left").select("src", "need", "cut", F.when(F.col("best").isNull(), F.col("flip")).otherwise(F.concat("flip", F.array("best.id"))).alias("flip")))
    return now


def _source(source_col: str) -> Column:
    """The source as a text that sorts null last; the first letter keeps the order of the others."""
    source = F.col(quoted(source_col)).cast("string")
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _rated(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    sizes = written(docs.select(F.col(quoted(id_col)).cast("long").alias("id"), word_count(F.col(quoted(text_col)).cast("string")).alias("size"), _source(source_col).alias("src")))
    targets = multipliers(sizes, written(source_targets(sizes, weights, share, most)), most)
    draw = F.pmod(F.xxhash64("id", "size"), F.lit(1 << 40)) / float(1 << 40)
    rated = sizes.join(_per_source(targets, targets.count()), "src").withColumn("rate", _rate(most)).withColumn("rest", F.col("rate") - F.floor("rate")).withColumn("key", F.col("rest") - draw)
    return rated, targets


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Rows (src, id, size, source_size, target, rate, copies) for each row of `docs`; the first three decide on the others."""
    rated, targets = _rated(docs, id_col, text_col, source_col, weights, share, most)
    more = (F.col("rest") > 0) & F.col("cut").isNotNull() & ((F.col("key") >= F.col("cut")) != F.coalesce(F.array_contains("flip", F.col("id")), F.lit(False)))
    copies = F.least(F.lit(most), F.floor("rate") + more.cast("int")).cast("long")
    cuts = _repaired(rated, written(_cuts(rated, targets)))
    return rated.join(_per_source(cuts.drop("need"), targets.count()), "src", "left").withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows (id, size, source_size, target, taken, copies, rate) for each row of `docs`."""
    out = _mixed(docs, id_col, text_col, source_col, weights, share, most)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`docs` with each row as often as the mix takes it, and copy_number, from 1, in place of a column of that name.

    Rows meet their copies by source, id and size, on which alone these depend; null ids and sources meet as well.
    """
    found = _mixed(docs, id_col, text_col, source_col, weights, share, most).where("copies > 0").select("src", "id", "size", "copies").distinct()
    own = packed(docs, src=_source(source_col), own=F.col(quoted(id_col)).cast("long"), words=word_count(F.col(quoted(text_col)).cast("string")))
    met = (own["src"] == found["src"]) & own["own"].eqNullSafe(found["id"]) & (own["words"] == found["size"])
    out = own.join(found, met).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return unpacked(out, [c for c in docs.columns if c != "copy_number"], copy_number=F.col("copy"))
