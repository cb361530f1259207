"""Quality rules whose thresholds are controlled for risk; DataFrame operations only.

A rule rejects a document when a statistic of its text is beyond a cutoff. Labelled good documents are dealt into
two folds by a hash of the id. The first one (1 of FIT) sets a path of combined cutoffs for each stratum, from lenient to
strict: at level j every rule's cutoff is the strictest one of its grid that rejects no more than a share of j steps of
the fold's good documents. The second one, the holdout, tests the path: at each level the good documents that any rule
would reject are counted, and the level holds if the exact binomial upper bound of that rate is at most `risk`, at the
level `error` divided by the number of strata (Bonferroni). Levels are tested in their order up to the first that fails,
which needs no further correction (fixed sequence); the last that holds gives the stratum's cutoffs. So with probability
1 - error no stratum loses more than `risk` of its good documents to all these rules together. A stratum with too few
labels gets no cutoffs and loses nothing.

Everything is counted by stratum in DataFrames; nothing goes to the driver but the number of strata. Texts are read once
and never shuffled.

A null or empty text has no words and fails the base rule. A null stratum is a stratum. A document with
several labels is good if most of them are; null labels are left out. Repeated rows and ids each give a
row. Extra columns are ignored by judge().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SPACES, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
WORDS = r"[^\x20\x09-\x0D]++"
RISK, ERROR = 0.02, 0.05
#: Steps of a rule's grid, levels of the path, and the share of the first fold that one level adds for each rule.
STEPS, LEVELS, SHARE = 200, 20, 0.00025
#: One in FIT good documents sets the path.
FIT = 4
#: Rejections up to which log_tail() sums term by term; beyond, Chernoff's bound stands for it, which is never less.
TERMS = 10_000
#: Stirling's error, ln z! - ln(sqrt(2 pi z) (z / e)^z), below where its series is exact to a double; 0 has no use.
STIRLING = [0.0, *[math.lgamma(z + 1) - (z + 0.5) * math.log(z) + z - 0.5 * math.log(2 * math.pi) for z in range(1, 16)]]
#: Strata, of about 300 bytes each, up to which their table is broadcast.
SENT = 100_000

#: Rule: (statistic over the columns of stats(), cutoff of the most lenient step, of the strictest one). A
#: document is rejected beyond the cutoff, in the direction from strict to lenient. Fixed values.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("try_divide(n_symbols, word_chars)", 1.0, 0.0),
    "repeats": ("try_divide(n_repeat_words, n_words)", 1.0, 0.0),
    "equal_lines": ("try_divide(n_dup_lines, n_lines)", 1.0, 0.0),
    "word_chars_high": ("try_divide(word_chars, n_words)", 40.0, 0.0),
    "word_chars_low": ("try_divide(word_chars, n_words)", 0.0, 10.0),
    "capitals": ("try_divide(n_capitals, word_chars)", 1.0, 0.0),
    "marks": ("try_divide(n_marks, word_chars)", 1.0, 0.0),
    "variety": ("try_divide(n_kinds, sqrt(n_words))", 0.0, 8.0),
}


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and the counts of each text; all counts are long."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(*keep, text.alias("__text"))
    out = out.select(*keep, "__text", F.regexp_extract_all("__text", F.lit(WORDS), F.lit(0)).alias("__words"), F.filter(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("__lines"), F.size(F.split("__text", "\n")).alias("n_lines"))
    # a word is its hash from here on
    out = out.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    out = out.select(
        *keep,
        F.size("__hashes").alias("n_words"),
        _without(F.col("__text"), SPACES).alias("__spaces"),
        F.length("__text").alias("__chars"),
        _without(F.col("__text"), SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        "n_lines",
        F.size(F.array_distinct("__hashes")).alias("n_kinds"),
        F.regexp_count("__text", F.lit("[A-Z]")).alias("n_capitals"),
        F.regexp_count("__text", F.lit("[!?;|=]")).alias("n_marks"),
        F.when(
            F.size("__hashes") >= WINDOW + 1,
            F.transform(F.sequence(F.lit(1), F.size("__hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__hashes", i, WINDOW))),
        ).alias("__windows"),
    )
    # only where some window comes again: windows in the order of their hashes, each with its place
    again = F.col("__windows").isNotNull() & (F.size(F.array_distinct("__windows")) < F.size("__windows"))
    out = out.withColumn("__sorted", F.when(again, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__windows")
    near = lambda j: F.get(F.col("__sorted"), j)["h"]
    twice = F.filter("__sorted", lambda x, j: F.coalesce(x["h"] == near(j - 1), F.lit(False)) | F.coalesce(x["h"] == near(j + 1), F.lit(False)))
    out = out.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__sorted")
    # a window's words up to the next one's first
    parts = F.transform("__places", lambda p, j: F.coalesce(F.least(F.lit(WINDOW), F.get(F.col("__places"), j + 1) - p), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(parts, F.lit(0), lambda s, x: s + x), F.lit(0))
    return out.select(
        *keep,
        *[F.col(c).cast("long").alias(c) for c in ("n_words", "n_symbols", "n_dup_lines", "n_lines", "n_kinds", "n_capitals", "n_marks")],
        (F.col("__chars") - F.col("__spaces")).cast("long").alias("word_chars"),
        repeated.cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _step(rule: str) -> Column:
    """The first step of the rule's grid that rejects the document; STEPS + 1 if none does.

    The cutoff of step t lies t / STEPS of the way from the lenient to the strict end.
    """
    value, lenient, strict = RULES[rule]
    way = (F.coalesce(F.expr(value), F.lit(lenient)) - lenient) / (strict - lenient)
    # beyond the cutoff: way < t / STEPS
    return F.least(F.greatest(F.floor(way * STEPS) + 1, F.lit(1)), F.lit(STEPS + 1)).cast("int")


def log_tail(k: Column, n: Column, p: float) -> Column:
    """Natural logarithm of P[Bin(n, p) <= k], or for k > TERMS of a bound of it; 0 for k >= n * p. cutoffs() goes by exact_log_tail()."""
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    none = n * F.log1p(F.lit(-p))
    # each term from the one before; the sum is kept as its logarithm
    start = F.struct(none.alias("term"), none.alias("total"))

    def more(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, s["total"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(s["total"] - top))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    exact = F.aggregate(F.when(k <= TERMS, steps), start, more, lambda s: s["total"])
    q = k / n
    chernoff = -n * (q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p)))
    return F.when(k >= n * p, F.lit(0.0)).when(k <= TERMS, exact).otherwise(chernoff)


def _stirling(z: Column) -> Column:
    y = 1 / (z * z)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / z
    return F.when(z < len(STIRLING), F.get(F.array(*[F.lit(x) for x in STIRLING]), z.cast("int"))).otherwise(series)


def exact_log_tail(k: Column, n: Column, p: float) -> Column:
    """Natural logarithm of P[Bin(n, p) <= k], by one formula for all k and n; 0, that is no proof of anything, for k >= n * p.

    The last term comes from Loader's form of it. Below it each term is less than the one after, the one j places down at
    most exp(-j * (j - 1) / (2 * n * p)) of the last. So beyond sqrt(120 * n * p) places what is left is less than the
    rounding of a double, and the sum ends there.
    """
    n, k = n.cast("double"), k.cast("double")
    mean, rest = n * p, n - k
    short = mean - k
    deviance = k * F.log1p(-short / mean) + rest * F.log1p(short / (n * (1 - p)))
    last = _stirling(n) - _stirling(k) - _stirling(rest) - deviance - 0.5 * F.log(2 * math.pi * k * (rest / n))
    places = F.least(k, F.ceil(F.sqrt(120 * mean)) + 1).cast("long")

    def more(s: Column, j: Column) -> Column:
        term = s["term"] * ((k - j + 1) * (1 - p)) / ((rest + j) * p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(places, F.lit(1))), start, more, lambda s: s["total"])
    return F.when(k >= mean, F.lit(0.0)).when(k <= 0, n * F.log1p(F.lit(-p))).otherwise(last + F.log(total))


def _steps() -> Column:
    return F.array(*[_step(r) for r in RULES])


def path(fitting: DataFrame, stratum: str, steps: str, share: float = SHARE) -> DataFrame:
    """Rows (stratum, path): for each rule the cutoff of each level, 0 for none; `fitting` has the good documents of the first fold.

    Counts go by (stratum, rule, step), pre-aggregated, so that no stratum is gathered.
    """
    counts = fitting.select(stratum, F.posexplode(steps).alias("rule", "step")).groupBy(stratum, "rule", "step").agg(F.count("*").alias("n"))
    whole = fitting.groupBy(stratum).agg(F.count("*").alias("__whole"))
    by_rule = counts.groupBy(stratum, "rule").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("n")).join(whole.withColumnRenamed(stratum, "__s"), F.col(stratum).eqNullSafe(F.col("__s"))).drop("__s")
    upto = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.lit(0).cast("long").alias("k"), F.array().cast("array<bigint>").alias("all")),
        lambda s, t: F.struct((s["k"] + F.coalesce(F.element_at("n", t), F.lit(0))).alias("k"), F.concat(s["all"], F.array(s["k"] + F.coalesce(F.element_at("n", t), F.lit(0)))).alias("all")),
        lambda s: s["all"],
    )
    cutoffs = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda j: F.size(F.filter("upto", lambda k: k <= j * share * F.col("__whole"))))
    rows = by_rule.withColumn("upto", upto).select(stratum, F.struct("rule", cutoffs.alias("cutoffs")).alias("r"))
    return rows.groupBy(stratum).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cutoffs"]).alias("path"))


def _level(steps: str, found: str) -> Column:
    """The first level whose cutoffs reject a document; LEVELS if none does."""
    return F.array_min(F.zip_with(found, steps, lambda cutoffs, step: F.size(F.filter(cutoffs, lambda c: c < step))))


def cutoffs(good: DataFrame, id_col: str, stratum: str, steps: str, strata: int, *, risk: float = RISK, error: float = ERROR, share: float = SHARE) -> DataFrame:
    """Rows (stratum, cutoffs: the step of each rule, level, n, rejected) for the strata that have a level that holds."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(FIT))
    paths = written(path(good.where(fold == 0), stratum, steps, share))
    held = good.where(fold != 0).select(F.col(stratum).alias("__of"), steps)
    near = held.join(F.broadcast(paths) if strata <= SENT // 10 else paths, F.col("__of").eqNullSafe(F.col(stratum)))
    at = near.groupBy(stratum, _level(steps, "path").alias("level")).agg(F.count("*").alias("n"))
    by = at.groupBy(stratum).agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("by"), F.sum("n").alias("n"))
    by = by.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    rejected = F.aggregate(F.sequence(F.lit(0), F.col("j")), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.element_at("by", i), F.lit(0)))
    tested = by.withColumn("rejected", rejected).withColumn("holds", exact_log_tail(F.col("rejected"), F.col("n"), risk) <= F.log(F.lit(error / max(1, strata))))
    # the levels before the first that fails
    last = tested.groupBy(stratum).agg(F.coalesce(F.min(F.when(~F.col("holds"), F.col("j"))), F.lit(LEVELS)).alias("stop"), F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("j", "rejected"))).alias("by"))
    last = last.where("stop > 0").select(F.col(stratum).alias("__s"), (F.col("stop") - 1).alias("level"), "n", F.element_at("by", F.col("stop") - 1).alias("rejected"))
    both = paths.join(last, F.col(stratum).eqNullSafe(F.col("__s")))
    return both.select(stratum, F.transform("path", lambda c: F.get(c, F.col("level"))).alias("cutoffs"), "level", "n", "rejected")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", *, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Rows (id, the counts of stats(), base_failed, kept, failed_rules) for each row of `docs`."""
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(stratum_col).cast("string").alias("__stratum"), F.col(text_col))
    measured = written(stats(own, text_col, ("__id", "__stratum")))
    marked = labels.select(F.col(id_col).cast("long").alias("__of_id"), F.col(label_col).cast("double").alias("__label")).where("__label IS NOT NULL")
    good = marked.groupBy("__of_id").agg(F.avg("__label").alias("__label")).where("__label > 0.5").select("__of_id")
    held = written(measured.where(~base_failed()).join(good, F.col("__id") == F.col("__of_id"), "left_semi").select("__id", "__stratum", _steps().alias("__steps")))
    strata = measured.select("__stratum").distinct().count()
    found = written(cutoffs(held, "__id", "__stratum", "__steps", strata, risk=risk, error=error).select(F.col("__stratum").alias("__s"), F.col("cutoffs").alias("__cutoffs")))
    out = measured.withColumn("base_failed", base_failed()).join(F.broadcast(found) if strata <= SENT else found, F.col("__stratum").eqNullSafe(F.col("__s")), "left")
    failed = F.filter(F.array(*[F.when(_step(r) <= F.get(F.col("__cutoffs"), F.lit(i)), F.lit(r)) for i, r in enumerate(RULES)]), lambda x: x.isNotNull())
    out = out.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("__stratum", "__s", "__cutoffs").withColumnRenamed("__id", id_col)
