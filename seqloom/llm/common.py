"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import util

#: Rows of one Arrow batch at most; texts may be long, so a batch is kept small.
ARROW_ROWS = 1024
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
NULL_ID = 2**63 - 1


def small_arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep the session's Arrow batches at `rows` rows or fewer, so that long texts don't pile up in one batch.

    The setting stays: plans are lazy and read it when they run. A session that has it lower keeps its own.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, with its lineage cut; a lost executor costs nothing but its running tasks."""
    return util.written(df)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Rows (row: all columns of `docs` as a structure, and `columns`), so that no name of theirs can clash with ours."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[x.alias(c) for c, x in columns.items()])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(row: str, name: str) -> Column:
    """A column out of the structure that packed() made."""
    return F.col(f"{row}.{quoted(name)}")


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that packed() put into row, those of `new` in place of them or after them."""
    own = [new.pop(c).alias(c) if c in new else field("row", c).alias(c) for c in columns]
    return rows.select(*own, *[x.alias(c) for c, x in new.items()])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def byte_slices(sizes: list[int], limit: int):
    """Ranges (from, to) of consecutive items of `limit` bytes or fewer in all, or of one item that is larger."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def utf8_column(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table over bytes that is True in the inclusive `ranges`."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of digits, lower-case letters and all that isn't ASCII.
WORD_BYTES = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes that aren't white space.
SOLID_BYTES = ~table((0x20, 0x20), (0x09, 0x0D))

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F | 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of several texts at once: data (the bytes in lower case), begin and end of each word, and the text it is in."""

    def __init__(self, texts: list[bytes], member: np.ndarray):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.data = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[sizes > 0]
        inside = member[self.data]
        first, last = inside.copy(), inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            first[begins] = inside[begins]
            last[ends[sizes > 0] - 1] = inside[ends[sizes > 0] - 1]
        self.begin = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.text = np.searchsorted(ends, self.begin, side="right")
        self.counts = np.bincount(self.text, minlength=len(texts)) if len(texts) else np.zeros(0, dtype=np.int64)
        #: Number of the first word of each text.
        self.offset = np.cumsum(self.counts) - self.counts

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same for equal words."""
        if not len(self.begin):
            return np.zeros(0, dtype=np.uint64)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(self.data)), out=sums[1:])
        return mix((sums[self.end] - sums[self.begin]) * _powers(_P_INV, len(self.data))[self.begin])

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _Q + words[j : j + n]
    return mix(out)
