"""Near-duplicates by SimHash, with a binary trie joined to itself.

Fingerprints are made in an Arrow function. Equal ones are one entry. Entries are dealt out by exact values
of a third of their bits, once for each third: two fingerprints that differ in 2 bits or fewer agree on
one third at least. Entries that agree form a binary trie over the other bits. The trie is traversed in
pairs of nodes, together, adding up the bits that differ; a pair beyond the error budget is dropped with all
below it. A group of more than `max_group` entries is dealt out again by a third of its bits that are left,
which bounds every group and loses no pair. A task hands on one link for each entry at most: a
spanning forest of what it has linked. Components then come from alternating stars over those links.

A null, empty or blank text has fingerprint 0 and is linked like any other. Repeated rows and ids each
give a row; a null id is no component's least id unless all are null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import field, packed, quoted, small_arrow_batches, unpacked, utf8_column, written
from seqloom.llm.components import connected_components

BITS, BUDGET, SHINGLE, SEED = 64, 2, 3, 42
#: Entries that a task may join at a time, and pairs of nodes it holds expanded.
MAX_GROUP, NODE_PAIRS = 50_000, 100_000
LEVELS = 3
_LONG_TEXT = 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The bits that more than half of the shingles' hashes have set."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
    ends = np.cumsum(sizes)
    begin, end = (ends - sizes)[: n - shingle + 1].tolist(), (ends - 1)[shingle - 1 :].tolist()
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(begin), _LONG_TEXT):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(begin[k : k + _LONG_TEXT], end[k : k + _LONG_TEXT], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begin)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Rows (id, fp: the fingerprint's 64 bits as a signed number)."""
    small_arrow_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in utf8_column(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "id long, fp long")


def thirds(mask: int) -> list[int]:
    """The bits outside `mask` in three runs, each put to `mask`."""
    free = [i for i in range(BITS - 1, -1, -1) if not mask >> i & 1]
    cut = [len(free) * k // 3 for k in range(4)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Forest:
    """Least linked entry of each entry, under links that come in arrays."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        least = self.least
        while True:
            a, b = least[i], least[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = least[least]
                if (up == least).all():
                    break
                least[:] = up


def trie_join(values: np.ndarray, group: np.ndarray, budget: int = BUDGET, node_pairs: int = NODE_PAIRS) -> np.ndarray:
    """For each entry the number of the least entry it is linked with, by any path inside its group.

    values: 64-bit entries in ascending order inside each group; group: ascending. A node is a range of
    entries that agree on their first bits. Pairs of nodes wait on a stack, deepest first, so that what is
    held is bounded by `node_pairs` for each of the 64 levels.
    """
    n = len(values)
    forest = Forest(n)
    if not n:
        return forest.least
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    zeros: dict[int, np.ndarray] = {}

    def middle(depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if depth not in zeros:
            bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            zeros[depth] = np.r_[0, np.cumsum(bit == 0)].astype(np.int32)
        return low + zeros[depth][high] - zeros[depth][low]

    many = ends - starts > 1
    stack = [(0, starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), dtype=np.int8))]
    while stack:
        depth, a0, a1, b0, b1, bits = stack.pop()
        if len(a0) > node_pairs:
            half = len(a0) // 2
            stack += [(depth, *(x[half:] for x in (a0, a1, b0, b1, bits))), (depth, *(x[:half] for x in (a0, a1, b0, b1, bits)))]
            continue
        size = (a1 - a0) * (b1 - b0)
        small = (size <= 16) | (depth == BITS)
        if small.any():
            _leaves(values, forest, a0[small], b0[small], (b1 - b0)[small], size[small], budget)
            a0, a1, b0, b1, bits = (x[~small] for x in (a0, a1, b0, b1, bits))
        if not len(a0):
            continue
        am, bm, same = middle(depth, a0, a1), middle(depth, b0, b1), a0 == b0
        parts = [
            (a0, am, b0, bm, bits),
            (am, a1, bm, b1, bits),
            (a0, am, bm, b1, bits + 1),
            *[tuple(x[~same] for x in (am, a1, b0, bm, bits + 1))],
        ]
        a0, a1, b0, b1, bits = (np.concatenate([p[k] for p in parts]) for k in range(5))
        on = (a1 > a0) & (b1 > b0) & (bits <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        if on.any():
            stack.append((depth + 1, *(x[on] for x in (a0, a1, b0, b1, bits))))
    return forest.least


def _leaves(values: np.ndarray, forest: Forest, a0: np.ndarray, b0: np.ndarray, width: np.ndarray, size: np.ndarray, budget: int) -> None:
    """Compare all entries of small pairs of nodes."""
    number = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    i = np.repeat(a0, size) + number // np.repeat(width, size)
    j = np.repeat(b0, size) + number % np.repeat(width, size)
    near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
    forest.link(i[near], j[near])


def _links(rows: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) inside the groups (mask, key) of `rows`, one for each entry at most."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(block: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((block[2].view(np.uint64), block[1], block[0]))
            block = block[:, order]
            edge = (block[0, 1:] != block[0, :-1]) | (block[1, 1:] != block[1, :-1])
            values = block[2].view(np.uint64)
            least = trie_join(values, np.r_[0, np.cumsum(edge)], budget)
            on = np.flatnonzero(least != np.arange(len(least)))
            return pa.RecordBatch.from_arrays([pa.array(block[2][on], pa.int64()), pa.array(block[2][least[on]], pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]))
            if sum(x.shape[1] for x in held) < MAX_GROUP:
                continue
            block = np.concatenate(held, axis=1)
            last = np.flatnonzero((block[0] != block[0, -1]) | (block[1] != block[1, -1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            held = [block[:, cut:]]
            if cut:
                yield flush(block[:, :cut])
        if held and held[0].shape[1]:
            yield flush(np.concatenate(held, axis=1))

    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp").mapInArrow(join, "a long, b long")


def near_links(entries: DataFrame, *, budget: int = BUDGET, max_group: int = MAX_GROUP) -> DataFrame:
    """Links (a, b) that connect all `entries` (distinct fp) that differ in `budget` bits or fewer, by some path.

    budget: 2 at most, as the bits are dealt out in thirds.
    """
    if not 0 <= budget <= 2:
        raise ValueError("budget must be 0, 1 or 2")
    first = F.array(*[F.lit(_signed(m)) for m in thirds(0)])
    key = F.col("fp").bitwiseAND(F.col("mask"))
    rows = entries.select("fp", F.explode(first).alias("mask")).withColumn("key", key)
    out = None
    masks = thirds(0)
    for level in range(LEVELS):
        hot = None
        if level + 1 < LEVELS:
            hot = written(rows.groupBy("mask", "key").count().where(F.col("count") > max_group).select("mask", "key"))
            if hot.isEmpty():
                hot = None
        links = _links(rows if hot is None else rows.join(hot, ["mask", "key"], "left_anti"), budget)
        out = links if out is None else out.unionByName(links)
        if hot is None:
            break
        finer = {m: thirds(m) for m in masks}
        choice = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        rows = rows.join(hot, ["mask", "key"], "left_semi").select("fp", F.explode(choice[F.col("mask")]).alias("mask")).withColumn("key", key)
        masks = [s for subs in finer.values() for s in subs]
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, seed: int = SEED, budget: int = BUDGET, max_group: int = MAX_GROUP) -> DataFrame:
    """Rows (id, fp, component_id: the least id that links lead to) for each row of `docs`."""
    prints = written(fingerprints(docs, id_col, text_col, shingle=shingle, seed=seed))
    entries = written(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(near_links(entries.select("fp"), budget=budget, max_group=max_group))
    # both sides written, so that a join on the root of a large component can be split
    placed = written(entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = written(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = placed.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with the least id of each component only, with all columns.

    Of rows that share an id the one with the least text stays. Rows with a null id can't be told apart and all stay.
    """
    return keep_least(docs, simhash_components(docs, id_col, text_col, **options), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that keep_first() keeps under the components `found` (id, component_id)."""
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("id")).distinct()
    repeated = written(found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).count().where("count > 1").select("id"))
    rows = packed(docs, id=F.col(quoted(id_col)).cast("long"))
    out = rows.join(kept, "id", "left_semi")
    if not repeated.isEmpty():
        several = out.join(repeated, "id", "left_semi")
        one = several.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(field("row", text_col)))).where("place = 1").drop("place")
        out = out.join(repeated, "id", "left_anti").unionByName(one)
    return unpacked(out.unionByName(rows.where("id IS NULL")), docs.columns)
