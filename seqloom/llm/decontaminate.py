"""Benchmark decontamination by winnowing.

Of the hashes of GRAM consecutive words, the rightmost minimum of each SPAN - GRAM + 1 in a row is kept, in
documents and in benchmark items: their fingerprints. Any SPAN words in a row that both hold leave a kept hash in both,
at the same place of the span: this is winnowing's guarantee. A document's fingerprint that the items have, too, is a
hit; it is extended to all windows of SPAN words that hold it, and the hashes of these (128 bits) are joined with the
windows of the items. What joins marks its words; overlapping windows give the longest common spans. An item of fewer
words must occur as a whole; for each such length all word groups of that length are windows.

So that a scan of the documents sends on next to nothing but real hits, the items' fingerprints and windows go to the
tasks as two bitmaps of 2**BITS bits at most, whatever the size of the benchmark; a bit that is set by chance costs a row in
the join and nothing else. In the join each different window of the benchmark is one row, however many items or
documents hold it; windows that the same items hold are one class, and items are listed for each document from its
classes. The tables of both sides are written, so that Spark splits a window that very many documents hold.

A null or empty text has no words; an item without words, or with a null id, is in no document. Equal
item ids are one item. Repeated documents and ids give a row each. Extra columns are ignored by
decontaminate() and kept by clean_documents(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import NULL_ID, WORD_BYTES, Words, byte_slices, gram_hashes, mix, packed, quoted, small_arrow_batches, unpacked, utf8_column, written

SPAN, GRAM = 10, 5
#: Logarithm of the bits of a bitmap at most (16 MB), and of its bits for each entry.
BITS, SPARE = 27, 4
SLICE_BYTES = 2 << 20
_SECOND = np.uint64(0x9FB21C651E98DF25 | 1)


def winnow(grams: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost minimum of each `window` hashes in a row that lie in one text.

    text[i] tells the text of word i; a window spans its grams' words.
    """
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window):
        other = grams[j : j + n]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + j
    span = len(text) - n
    return np.unique(at[text[:n] == text[span : span + n]])


def window_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the n words from each start."""
    first, second = np.full(len(starts), n, dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64)
    for j in range(n):
        w = words[starts + j]
        first = first * _SECOND + w
        second = second * np.uint64(0x100000001B3) + mix(w)
    return mix(first), mix(second)


@dataclass
class Bitmap:
    """A set of 64-bit hashes by their highest `bits` bits; it may hold more than it should, never less."""

    bits: int
    held: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@dataclass
class Index:
    """What the tasks know of the items: fingerprints, windows, and the lengths of items that are shorter than a span."""

    fingerprints: Bitmap
    windows: Bitmap
    short: list[int]


def item_windows(words: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(fingerprints, words of a window, its two hashes) of an item, given the hashes of its words."""
    n = min(span, len(words))
    if not n:
        none = np.zeros(0, dtype=np.uint64)
        return none, 0, none, none
    starts = np.arange(len(words) - n + 1)
    kept = np.zeros(0, dtype=np.uint64)
    if n == span:
        grams = gram_hashes(words, gram)
        kept = np.unique(grams[winnow(grams, np.zeros(len(words), dtype=np.int64), span - gram + 1)])
    return kept, n, *window_hashes(words, starts, n)


def document_windows(docs: Words, index: Index, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """(text, first word in it, words, hashes) of the windows that the bitmaps know."""
    words = docs.hashes()
    sought = []
    if len(words) >= span:
        grams = gram_hashes(words, gram)
        places = winnow(grams, docs.text, span - gram + 1)
        places = places[index.fingerprints.has(grams[places])]
        starts = np.unique((places[:, None] - np.arange(span - gram + 1)).ravel())
        starts = starts[(starts >= 0) & (starts + span <= len(words))]
        sought.append((span, starts))
    sought += [(n, np.arange(max(0, len(words) - n + 1))) for n in index.short]
    for n, starts in sought:
        starts = starts[docs.text[starts] == docs.text[starts + n - 1]]
        first, second = window_hashes(words, starts, n)
        on = index.windows.has(first)
        starts = starts[on]
        text = docs.text[starts]
        yield text, starts - docs.offset[text], n, first[on], second[on]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _item_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, n, h1, h2): the windows of the items, and their fingerprints with n = 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), utf8_column(batch.column(1)), strict=True):
                kept, n, first, second = item_windows(Words([text], WORD_BYTES).hashes())
                arrays = [np.r_[kept, first], np.r_[np.zeros_like(kept), second]]
                size = len(kept) + len(first)
                yield pa.RecordBatch.from_arrays([pa.array([item] * size, pa.string()), pa.array([0] * len(kept) + [n] * len(first), pa.int32()), *map(_signed, arrays)], names=["item", "n", "h1", "h2"])

    rows = items.select(F.col(quoted(id_col)).cast("string").alias("item"), F.col(quoted(text_col)).cast("string").alias("text")).where("item IS NOT NULL")
    return rows.mapInArrow(scan, "item string, n int, h1 long, h2 long").distinct()


def _bitmap(hashes: DataFrame, most: int) -> Bitmap:
    """The column h1 as a bitmap, put together in the JVM: one row of 4 kB for each 32768 bits goes to the driver."""
    count = hashes.count()
    bits = max(1, min(most, max(1, count).bit_length() + SPARE))
    place = F.shiftrightunsigned("h1", 64 - bits) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held")).collect()
    held = np.zeros(max(1, (1 << bits) >> 15) << 12, dtype=np.uint8)
    for r in rows:
        held[(r["b"] - 1) << 12 : r["b"] << 12] = np.frombuffer(r["held"], dtype=np.uint8)
    return Bitmap(bits, held)


def _index(table: DataFrame, bits: int) -> Index:
    short = sorted(r[0] for r in table.where(f"n > 0 AND n < {SPAN}").select("n").distinct().collect())
    return Index(_bitmap(table.where("n = 0").select("h1").distinct(), bits), _bitmap(table.where("n > 0").select("h1").distinct(), bits), short)


def _scanned(docs: DataFrame, id_col: str, text_col: str, index: Index) -> DataFrame:
    """Rows (id, known, hash, n_words, hits: (at, n, h1, h2) of windows) for each row of `docs`; id and hash tell rows apart up to equal ones."""
    small_arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            texts = utf8_column(batch.column(2))
            counts, lists = [], []
            for a, b in byte_slices([len(t) for t in texts], SLICE_BYTES):
                words = Words(texts[a:b], WORD_BYTES)
                own: list[list] = [[] for _ in range(b - a)]
                for text, at, n, first, second in document_windows(words, index):
                    for t, p, h1, h2 in zip(text.tolist(), at.tolist(), first.view(np.int64).tolist(), second.view(np.int64).tolist(), strict=True):
                        own[t].append({"at": p, "n": n, "h1": h1, "h2": h2})
                counts += words.counts.tolist()
                lists += own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(lists, kind)], names=["id", "hash", "n_words", "hits"])

    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    own = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return own.mapInArrow(scan, "id long, hash long, n_words long, hits array<struct<at:int,n:int,h1:long,h2:long>>")


def _key() -> Column:
    return F.coalesce("id", F.lit(NULL_ID))


def _hits(scanned: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (key, hash, at, end, class) of the windows that the items have, each once; and by that, of equal rows of `docs` one."""
    # items of a window are told by their number and the sum of their hashes
    windows = table.where("n > 0").groupBy("n", "h1", "h2").agg(F.sum(F.xxhash64("item").cast("decimal(20,0)")).alias("s"), F.count("*").alias("c"))
    windows = written(windows.select("n", "h1", "h2", F.xxhash64(F.col("s").cast("string"), "c").alias("class")))
    near = scanned.where(F.size("hits") > 0).select(_key().alias("key"), "hash", F.explode("hits").alias("w")).select("key", "hash", "w.*").distinct()
    return near.join(windows, ["n", "h1", "h2"]).select("key", "hash", F.col("at").cast("long").alias("at"), (F.col("at") + F.col("n")).cast("long").alias("end"), "class", "n", "h1", "h2")


def _spans(hits: DataFrame) -> DataFrame:
    """Rows (key, hash, spans): the words that are hit as ranges in order and apart; a window runs over the hits of one document."""
    order = Window.partitionBy("key", "hash").orderBy("at", "end")
    rows = hits.select("key", "hash", "at", "end").withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("at") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranges = rows.groupBy("key", "hash", "run").agg(F.min("at").alias("a"), F.max("end").alias("b"))
    return ranges.groupBy("key", "hash").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _items(hits: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (key, hash, items): ids of the items that hold a window of the document, in order."""
    classes = hits.select("key", "hash", "class").distinct()
    # one window stands for its class
    one = hits.groupBy("class").agg(F.min(F.struct("n", "h1", "h2")).alias("w")).select("class", "w.*")
    members = written(one.join(table, ["n", "h1", "h2"]).select("class", "item"))
    return classes.join(members, "class").groupBy("key", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))


def marked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, bits: int = BITS) -> DataFrame:
    """Rows (id, n_words, spans: words that are hit as disjoint ranges (a, b), items) for each row of `docs`."""
    table = written(_item_table(items, item_col, item_text_col))
    scanned = written(_scanned(docs, id_col, text_col, _index(table, bits)))
    hits = written(_hits(scanned, table))
    found = _spans(hits).join(_items(hits, table), ["key", "hash"])
    none = F.array()
    out = scanned.select("id", "hash", "n_words", _key().alias("key")).join(found, ["key", "hash"], "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", none.cast("array<struct<a:bigint,b:bigint>>")).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """Rows (id, n_words, n_hit, n_items, items, contaminated) for each row of `docs`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    out = marked(docs, items, **names)
    return out.select(out.columns[0], "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, bits: int = BITS) -> DataFrame:
    """The rows of `docs` with no hit, with all their columns."""
    table = written(_item_table(items, item_col, item_text_col))
    scanned = written(_scanned(docs, id_col, text_col, _index(table, bits)).where(F.size("hits") > 0))
    bad = written(_hits(scanned, table).select("key", "hash").distinct())
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    rows = packed(docs, key=F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NULL_ID)), hash=F.xxhash64(text))
    return unpacked(rows.join(bad, ["key", "hash"], "left_anti"), docs.columns)
