"""Lines that several documents share.

Lines are exploded, normalised and hashed to 128 bits; documents are counted per hash; lines at or over
the threshold go, except in the smallest id that holds them; the others are put together again in
their order. What is shuffled for counting is hashes, pre-aggregated on each side; texts move once.

A null text is one empty line. A null id counts as one document that comes after all others. Repeated
rows with one id are one document to the count and give a row each. Extra columns are ignored by
line_dedup() and kept by drop_shared_lines().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import NULL_ID, SPACES, field, lower_ascii, packed, quoted, unpacked, written


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (row, __id, __hash, __lines) of `docs`; __id and __hash tell rows apart up to those that are equal."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return packed(docs, __id=F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NULL_ID)), __hash=F.xxhash64(text), __lines=F.split(text, "\n"))


def _dropped(keyed: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Rows (__id, __hash, __drop: places of the lines that go, ascending)."""
    key = line_key(F.col("__line"))
    lines = (
        keyed.select("__id", "__hash", F.posexplode("__lines").alias("__at", "__line"))
        .where(F.length(F.btrim("__line", F.lit(SPACES))) >= min_chars)
        .select("__id", "__hash", "__at", F.xxhash64(key).alias("__k1"), F.xxhash64(F.lit(1), key).alias("__k2"))
    )
    found = lines.groupBy("__k1", "__k2").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"), *([F.count_distinct("__id").alias("__docs")] if min_docs > 2 else []))
    shared = found.where(F.col("__first") != F.col("__last")).where(F.col("__docs") >= min_docs if min_docs > 2 else F.lit(True)).select("__k1", "__k2", "__first")
    # written, it is a side that a skewed join can split the other one against; a line in every document loads no one task
    gone = lines.join(written(shared), ["__k1", "__k2"]).where(F.col("__id") != F.col("__first"))
    return gone.groupBy("__id", "__hash").agg(F.array_sort(F.collect_set("__at")).alias("__drop"))


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """Rows (row, __lines, __drop, __kept) of `docs`."""
    drop = _dropped(_keyed(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col), min_chars, min_docs)
    both = _keyed(docs, id_col, text_col).join(drop, ["__id", "__hash"], "left")
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    left = F.transform(F.array_except(places, F.col("__drop")), lambda i: F.get(F.col("__lines"), i))
    return both.withColumn("__kept", F.when(F.col("__drop").isNull(), F.coalesce(field("row", text_col).cast("string"), F.lit(""))).otherwise(F.array_join(left, "\n")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Rows (id, text: what is left, n_lines, n_dropped) for each row of `docs`.

    min_docs = 2 needs no count of distinct documents: a hash's smallest and largest id differ.
    """
    out = _deduplicated(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col, min_chars, min_docs)
    dropped = F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop"))
    return out.select(field("row", id_col).alias(id_col), F.col("__kept").alias(text_col), F.size("__lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """`docs` with the text that is left and all its columns, whatever their names; a null text stays null."""
    out = _deduplicated(docs, id_col, text_col, min_chars, min_docs)
    return unpacked(out, docs.columns, **{text_col: F.when(field("row", text_col).isNotNull(), F.col("__kept"))})
