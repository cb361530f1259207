"""The binomial test of op10's cutoffs, on both sides of log_tail()'s switch."""

from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from seqloom.llm import quality_rules


def slow_log_tail(k, n, p):
    if k >= n * p:
        return 0.0
    with localcontext() as c:
        c.prec = 40
        odds = Decimal(p) / (1 - Decimal(p))
        term = total = Decimal(1)
        for i in range(1, k + 1):
            term *= Decimal(n - i + 1) / i * odds
            total += term
        return float(total.ln() + n * (1 - Decimal(p)).ln())


def test_exact_log_tail(spark):
    cases = {
        0.02: [(0, 1), (0, 50), (1, 51), (1, 50), (14, 1000), (15, 1000), (16, 1000), (17, 1000), (9_999, 520_000), (10_000, 520_000), (10_001, 520_000), (19_500, 1_000_000), (19_999, 1_000_000), (20_000, 1_000_000)],
        0.5: [(0, 1), (1, 1), (7, 15), (7, 16), (8, 17), (300, 1000)],
        0.9: [(0, 3), (17, 20), (18, 20), (85, 100)],
    }
    for p, rows in cases.items():
        df = spark.createDataFrame(rows, "k long, n long")
        for r in df.select("k", "n", quality_rules.exact_log_tail(F.col("k"), F.col("n"), p).alias("t")).collect():
            want = slow_log_tail(r.k, r.n, p)
            assert abs(r.t - want) <= 1e-11 * max(1, abs(want)), (r.k, r.n, p)


def test_cutoffs_of_a_large_stratum(spark):
    """The most rejections that the exact test allows, more than TERMS, hold; one more does not."""
    risk, error = 0.42, 0.05
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(quality_rules.FIT))
    ids = [(x.id, x.f) for x in spark.range(40_000).select("id", fold.alias("f")).collect()]
    held = [i for i, f in ids if f != 0]
    limit = Decimal(error).ln()
    low, high = 0, int(len(held) * risk)
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if slow_log_tail(k, len(held), risk) <= limit else (low, k)
    assert low > quality_rules.TERMS
    top = quality_rules.STEPS + 1
    others = [F.lit(top)] * (len(quality_rules.RULES) - 1)
    fit = [i for i, f in ids if f == 0]
    for rejected, level in ((low, quality_rules.LEVELS - 1), (low + 1, 0)):
        # from level 1 on the first rule may reject half of the first fold, so all with step 100
        out = spark.createDataFrame([(i,) for i in held[:rejected] + fit[: len(fit) * 2 // 5]], "out long")
        good = spark.range(40_000).join(out, F.col("id") == F.col("out"), "left").select("id", F.lit("a").alias("s"), F.array(F.when(F.col("out").isNotNull(), 100).otherwise(top), *others).alias("steps"))
        found = quality_rules.cutoffs(good, "id", "s", "steps", 1, risk=risk, error=error, share=0.5).collect()
        assert [(x.level, x.n, x.rejected) for x in found] == [(level, len(held), rejected if level else 0)]
