"""Scalar functions of a match. A distance is 0 for exact matches, negative for mismatches, positive for edits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least probability that counts.
FLOOR = 1e-300
#: Quotient of the E-values of edits and of mismatches for 1 to 20 differences; from there it doubles with
#: each, up to 120, and is 0 beyond. Fixed values.
EDIT_FACTORS = (3.97, 12.8, 32.6, 76.0, 171.0, 377.0, 822.0, 1780.0, 3910.0, 8500.0, 17600.0, 37800.0, 79800.0, 166000.0, 358000.0, 744000.0, 1520000.0, 3200000.0, 6400000.0, 13100000.0)
MAX_EDIT = 120


def score(len1: Column, len2: Column, distance: Column) -> Column:
    """Lengths less 3 for each difference; the sign of the distance goes over to the score of mismatches."""
    plain = len1 + len2 - 3 * F.abs(distance)
    return F.when(distance < 0, -plain).otherwise(plain).cast("long")


def distance_of_score(len1: Column, len2: Column, value: Column) -> Column:
    return F.floor((len1 + len2 - value) / 3).cast("long")


def identity(len1: Column, len2: Column, distance: Column) -> Column:
    """Percent."""
    return 100.0 * (1.0 - F.abs(distance) / F.greatest(len1, len2))


def match_length(len1: Column, len2: Column, distance: Column, complete: bool = False) -> Column:
    """The length that goes into the E-value."""
    return len2 if complete else F.when(distance == 0, len2).otherwise(F.greatest(len1, len2))


def log_choose(n: Column, k: Column) -> Column:
    """Natural logarithm of n over k."""
    return F.when(k <= 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i)))


def log_edit_factor(distance: Column) -> Column:
    """Natural logarithm of the factor for edits; 0 for mismatches, null beyond MAX_EDIT."""
    table, last = F.array(*[F.lit(math.log(x)) for x in EDIT_FACTORS]), len(EDIT_FACTORS)
    far = math.log(EDIT_FACTORS[-1]) + (distance - last) * math.log(2.0)
    return F.when(distance <= 0, 0.0).when(distance <= last, F.element_at(table, F.greatest(distance, F.lit(1)).cast("int"))).when(distance <= MAX_EDIT, far)


def log_evalue(length: Column, distance: Column, multiplier: Column, symbols: int) -> Column:
    """Natural logarithm of the E-value; null where it is 0, as the probability is below FLOOR.

    symbols: classes of the alphabet without the wildcard.
    """
    k = F.abs(distance)
    p = 1.0 / symbols
    log_p = log_choose(length, k) + (length - k) * math.log(p) + (k + 2) * math.log1p(-p)
    return F.when(log_p > math.log(FLOOR), log_p + log_edit_factor(distance) + F.log(multiplier))


def evalue(length: Column, distance: Column, multiplier: Column, symbols: int) -> Column:
    return F.coalesce(F.exp(log_evalue(length, distance, multiplier, symbols)), F.lit(0.0))


def multiplier_self(n: int | Column) -> Column:
    """n: symbols of all sequences and one separator between neighbours."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    return 0.5 * n * n


def multiplier_query(n: int | Column, query_len: Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(float(n))
    return n * query_len


def multiplier_complete(n: int | Column) -> Column:
    return n if isinstance(n, Column) else F.lit(float(n))


def karlin_lambda(chances: dict[int, float], steps: int = 200) -> float:
    """The positive root of the sum of chance * exp(root * score) - 1, by halving; scores by their chances, negative on average."""
    if sum(s * p for s, p in chances.items()) >= 0 or max(chances) <= 0:
        raise ValueError("the mean score must be negative and some score positive")
    low, high = 0.0, 1.0
    value = lambda x: sum(p * math.exp(x * s) for s, p in chances.items()) - 1
    while value(high) < 0:
        high *= 2
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ; null for different lengths."""
    parts = lambda s: F.split(s, "")
    return F.when(F.length(a) != F.length(b), F.lit(None).cast("int")).when(F.length(a) == 0, F.lit(0)).otherwise(F.aggregate(F.zip_with(parts(a), parts(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x))


def abbreviated(a: Column, b: Column, iub: bool = False) -> Column:
    """Two strings of one length as one, differences as [xy], or for DNA as the code of the pair."""
    codes = {"ac": "m", "ag": "r", "at": "w", "cg": "s", "ct": "y", "gt": "k"}
    lookup = F.create_map(*[x for pair in codes.items() for x in (F.lit(pair[0]), F.lit(pair[1]))])

    def place(x: Column, y: Column) -> Column:
        other = F.coalesce(F.element_at(lookup, F.concat(F.least(x, y), F.greatest(x, y))), F.lit("n")) if iub else F.concat(F.lit("["), x, y, F.lit("]"))
        return F.when(x == y, x).otherwise(other)

    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), place), "")


def low_complexity(text: Column, symbols: str = "acgt") -> Column:
    """The product of the shares of the symbols."""
    out = F.lit(1.0)
    for c in symbols:
        out = out * (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / F.length(text)
    return out


def formatted_description(text: Column, skip: int = 0, most: int | None = None, to_blank: bool = False) -> Column:
    """A description for output: without a prefix, cut, blanks as underscores."""
    out = F.substring(text, skip + 1, 2**31 - 1)
    if to_blank:
        out = F.regexp_extract(out, r"^\S*", 0)
    if most is not None:
        out = F.left(out, F.lit(most))
    return F.translate(out, " ", "_")
