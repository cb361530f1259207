"""Near copies by word shingles: documents whose sets of shingles have a Jaccard similarity of SIMILAR or more, without loss.

op6's method comes first: SimHash fingerprints of the texts' shingles, their binary trie joined to itself, and an exact
comparison of the entries that its links connect. Fingerprints can't promise to find every pair (at 0.8 about ten of 64 bits
differ, and a trie with such a budget prunes next to nothing), so an exact search follows for the pairs that they left apart.

Prefix filter: with the shingles of all documents in one order, two similar documents share m or more of the first
n - ceil(SIMILAR * n) + m of either. The order is by hash, after that those that a sample shows to be frequent; the sample
decides the order only, never whether a pair is found. Documents with equal sets are one entry. Entries that share
enough of their prefixes are compared exactly: in pairs where few entries share each shingle, else the entries that hang
together by such shingles form a family, which is dealt out in pairs of blocks that are near in size, and a task links what
is similar in its two blocks. Components then come from alternating stars over the links.

Shingles are told apart by 64-bit hashes. A text of fewer than SHINGLE words is one shingle; a null, empty or blank text has
none and equals its like. Repeated rows and ids each give a row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SOLID_BYTES, Words, byte_slices, gram_hashes, small_arrow_batches, utf8_column, written
from seqloom.llm.components import connected_components
from seqloom.llm.simhash import Forest, fingerprint, keep_least, near_links

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Entries that are paired at once for a shingle, and entries of a block of a family.
MAX_GROUP, BLOCK = 256, 512
#: One entry of so many is in the sample; a shingle is frequent from so many entries of the sample on; so many are told apart.
SAMPLE, FREQUENT, MAX_FREQUENT = 16, 4, 1_000_000
#: Keys that are broadcast at most.
MAX_BROADCAST = 500_000
_SLICE_BYTES = 1 << 20


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its shingles' hashes in ascending order, each once."""
    for a, b in byte_slices([len(t) for t in texts], _SLICE_BYTES):
        words = Words(texts[a:b], SOLID_BYTES)
        hashes = words.hashes()
        for begin, n in zip(words.offset.tolist(), words.counts.tolist(), strict=True):
            own = hashes[begin : begin + n]
            yield np.unique(gram_hashes(own, min(shingle, n)).view(np.int64)) if n else np.zeros(0, dtype=np.int64)


def set_key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


def least_shared(n: int) -> int:
    """Shingles that a set of n shares at least with any that is similar."""
    return -(-n * SIMILAR[0] // SIMILAR[1])


def least_in_prefixes(n):
    """Shingles that prefixes must share; of two sets the smaller number holds."""
    return 1 + n // 20


def is_similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles with so many shared ones are similar."""
    return shared * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (a + b)


def _is_size_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) * SIMILAR[1] >= np.maximum(a, b) * SIMILAR[0]


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _scan(docs: DataFrame, id_col: str, text_col: str, schema: str, rows: Callable[[Iterator], Iterator[pa.RecordBatch]]) -> DataFrame:
    """rows() gets a list of (id, key, shingles, text) for each batch."""
    small_arrow_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = ((b.column(0).to_pylist(), utf8_column(b.column(1))) for b in batches)
        yield from rows([(i, set_key(s), s, t) for i, s, t in zip(ids, shingle_sets(texts), texts, strict=True)] for ids, texts in both)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, schema)


def set_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, key: the same for equal sets of shingles, fp: op6's fingerprint of the shingles, as a signed number)."""

    def rows(scanned):
        for batch in scanned:
            found = np.array([fingerprint(x[3], SHINGLE) for x in batch], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in batch], pa.int64()), pa.array([x[1] for x in batch], pa.int64()), pa.array(found)], names=["id", "key", "fp"])

    return _scan(docs, id_col, text_col, "id long, key long, fp long", rows)


def fingerprint_links(entries: DataFrame) -> DataFrame:
    """Links (a, b) between `entries` (key, fp) of equal fingerprints, and of those that op6's trie join links; not compared yet."""
    first = written(entries.groupBy("fp").agg(F.min("key").alias("least")))
    same = entries.join(first, "fp").where("key != least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    ends = [first.select(F.col("fp").alias(x), F.col("least").alias(f"__{x}")) for x in ("a", "b")]
    near = written(near_links(first.select("fp")).distinct()).join(ends[0], "a").join(ends[1], "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    return same.unionByName(near)


def _frequent(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Hashes of shingles that are frequent in a sample, in ascending order."""

    def rows(scanned):
        seen: set[int] = set()
        for batch in scanned:
            own = []
            for _, key, shingles, _ in batch:
                if key % SAMPLE == 0 and key not in seen:
                    seen.add(key)
                    own.append(np.stack([shingles, np.full(len(shingles), key)]))
            if own:
                both = np.concatenate(own, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["hash", "key"])

    counts = _scan(docs, id_col, text_col, "hash long, key long", rows).groupBy("hash").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
    found = counts.where((F.col("n") >= FREQUENT) & (F.col("a") < F.col("b"))).orderBy(F.desc("n"), "hash").limit(MAX_FREQUENT).select("hash").toArrow()
    return np.sort(found.column(0).to_numpy())


def _prefixes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (hash, key, n: shingles of the set) for the shingles of each entry's prefix; an entry can come once for each task."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, id_col, text_col))

    def rows(scanned):
        late = frequent.value
        seen: set[int] = set()
        for batch in scanned:
            hashes, keys, sizes = [], [], []
            for _, key, shingles, _ in batch:
                n = len(shingles)
                if not n or key in seen:
                    continue
                seen.add(key)
                take = min(n, n - least_shared(n) + least_in_prefixes(n))
                if len(late):
                    at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
                    is_late = late[at] == shingles
                    shingles = np.concatenate([shingles[~is_late], shingles[is_late]])
                hashes.append(shingles[:take])
                keys.append(np.full(take, key))
                sizes.append(np.full(take, n))
            yield pa.RecordBatch.from_arrays([pa.array(_flat(x)) for x in (hashes, keys, sizes)], names=["hash", "key", "n"])

    return _scan(docs, id_col, text_col, "hash long, key long, n long", rows)


def _partners(prefixes: DataFrame, max_group: int) -> DataFrame:
    """Rows (family, a, b): pairs that share enough and are near in size; where more than `max_group` share a shingle, links of a family."""

    def pairs(block: np.ndarray) -> pa.RecordBatch:
        block = block[:, np.lexsort((block[1], block[0]))]
        first = np.r_[True, (block[0, 1:] != block[0, :-1]) | (block[1, 1:] != block[1, :-1])]
        hashes, keys, sizes = block[:, first]
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        counts = np.diff(np.r_[starts, len(hashes)])
        least = np.repeat(keys[starts], counts)
        large = np.repeat(counts > max_group, counts)
        star = large & (keys != least)
        out = [np.stack([np.ones(int(star.sum()), dtype=np.int64), least[star], keys[star], np.zeros(int(star.sum()), dtype=np.int64)])]
        group = np.where(large, -1, np.repeat(np.arange(len(starts)), counts))
        for step in range(1, min(max_group, int(counts.max()))):
            on = np.flatnonzero((group[step:] == group[:-step]) & (group[step:] >= 0))
            on = on[_is_size_near(sizes[on], sizes[on + step])]
            out.append(np.stack([np.zeros(len(on), dtype=np.int64), keys[on], keys[on + step], least_in_prefixes(np.minimum(sizes[on], sizes[on + step]))]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=["family", "a", "b", "need"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])], axis=1)
            cut = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0  # the last group may go on
            if cut:
                yield pairs(held[:, :cut])
                held = held[:, cut:]
        if held.shape[1]:
            yield pairs(held)

    rows = prefixes.repartition("hash").sortWithinPartitions("hash").mapInArrow(join, "family long, a long, b long, need long")
    # a pair that shares a shingle of a family needs no count: it is compared there
    return rows.groupBy("family", "a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("family", "a", "b")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """Rows (key, shingles: 8 bytes each) for the keys that are wanted."""

    def rows(scanned):
        seen: set[int] = set()
        for batch in scanned:
            own = [x for x in batch if x[1] not in seen]
            seen.update(x[1] for x in own)
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in own], pa.int64()), pa.array([x[2].tobytes() for x in own], pa.binary())], names=["key", "shingles"])

    few = wanted.count() <= MAX_BROADCAST
    return _scan(docs, id_col, text_col, "key long, shingles binary", rows).join(F.broadcast(wanted) if few else wanted, "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[np.frombuffer(x, dtype=np.int64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*both, strict=True)], dtype=np.int64)
            sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in both]
            yield batch.select([0, 1]).filter(pa.array(is_similar(shared, *sizes)))

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("__a"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("__b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "__a", "__b").mapInArrow(verify, "a long, b long")


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that `classes` (node, root) don't connect."""
    a, b = (classes.select(F.col("node").alias(x), F.col("root").alias(f"__{x}")) for x in ("a", "b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(~F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))).select("a", "b")


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the number of the least one it is linked with, by any path."""
    n = len(sets)
    forest = Forest(n)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    names, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    for i in range(n):
        mark = np.zeros(len(names), dtype=bool)
        mark[tokens[ends[i] - sizes[i] : ends[i]]] = True
        shared = np.add.reduceat(mark[tokens].astype(np.int64), ends - sizes)
        near = np.flatnonzero(is_similar(shared, sizes[i], sizes))
        forest.link(np.full(len(near), i), near)
        if not forest.least.any():
            break
    return forest.least


def _family_links(stars: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links (a, b) that connect all similar entries of each family, by some path."""
    members = connected_components(stars).select(F.col("node").alias("key"), "root")
    # sizes of similar sets differ by a factor of 1.25 at most, so their classes by one
    size = F.floor(F.log(F.octet_length("shingles") / 8) / F.log(F.lit(1.26))).alias("size")
    members = written(members.join(sets, "key").select("key", "root", size))
    blocks = members.groupBy("root", "size").agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = members.join(blocks, ["root", "size"]).withColumn("i", F.col("size") * (1 << 32) + F.pmod(F.xxhash64("key"), "blocks"))
    beside = own.select("key", "root", "i", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")).join(blocks, ["root", "size"])
    first = F.col("size") * (1 << 32)
    beside = beside.select("key", "root", "i", F.explode(F.sequence(first, first + F.col("blocks") - 1)).alias("j"))
    dealt = beside.select("key", "root", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                keys = np.array(list(held), dtype=np.int64)
                least = linked(list(held.values()))
                on = np.flatnonzero(least != np.arange(len(least)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(keys[least[on]])], names=["a", "b"])
            held.clear()

        for batch in batches:
            for root, i, j, key, shingles in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (root, i, j) != now:
                    yield from flush()
                    now = (root, i, j)
                held[key] = np.frombuffer(shingles, dtype=np.int64)
        yield from flush()

    rows = dealt.join(sets, "key").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return rows.select("root", "i", "j", "key", "shingles").mapInArrow(join, "a long, b long")


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_group: int = MAX_GROUP, block: int = BLOCK) -> DataFrame:
    """Rows (id, component_id: the least id that similar documents lead to) for each row of `docs`."""
    prints = written(set_keys(docs, id_col, text_col))
    entries = written(prints.groupBy("key").agg(F.min("id").alias("first"), F.min("fp").alias("fp")))
    found = written(fingerprint_links(entries))
    partners = written(_partners(_prefixes(docs, id_col, text_col), max_group))
    if found.isEmpty() and partners.isEmpty():
        placed = entries.select("key", F.col("first").alias("component_id"))
    else:
        wanted = written(found.unionByName(partners.select("a", "b")).select(F.explode(F.array("a", "b")).alias("key")).distinct())
        sets = written(_sets(docs, id_col, text_col, wanted))
        near = written(_verified(found, sets))
        # what fingerprints have connected isn't compared again
        left = _apart(partners.where("family = 0").select("a", "b"), written(connected_components(near)))
        links = near.unionByName(_verified(left, sets))
        stars = partners.where("family = 1")
        if not stars.isEmpty():
            links = links.unionByName(_family_links(stars, sets, block))
        roots = connected_components(links)
        rooted = written(entries.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")))
        placed = rooted.join(written(rooted.groupBy("root").agg(F.min("first").alias("component_id"))), "root").select("key", "component_id")
    return prints.join(placed, "key").select(F.col("id").alias(id_col), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with the least id of each component only, with all columns; as simhash.keep_first()."""
    return keep_least(docs, near_copy_components(docs, id_col, text_col, **options), id_col, text_col)
