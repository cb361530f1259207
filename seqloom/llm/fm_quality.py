"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a vector of hashed word weights (log counts, unit length), classes of its structure statistics,
and, where the caller names them, classes of numeric metadata columns. The score is the logistic function
of bias + w.x + the sum of <v_i, v_j> x_i x_j over all pairs of features, which is
half of the sum over factors of (V.x)^2 - (V^2).(x^2): linear in the features that a document has.

Training is on the driver, on a sample of at most about `sample` labelled rows (by a hash of the id, so
reruns agree), which bounds both memory and what is sent; rows whose id falls to the held-out fold
never train. Scoring runs in an Arrow function, over whole texts, in slices of about equal bytes.

A null or empty text is scored by its structure alone. A null id is not held out. Several labels of one document
count as their mean, null labels not at all; without labels of both kinds every score is the
share of good labels, 0.5 with none. Repeated rows and ids each give a row. Extra columns are ignored by score_documents()
and kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SOLID_BYTES, WORD_BYTES, Words, byte_slices, small_arrow_batches, utf8_column

BUCKETS, FACTORS = 2048, 6
#: Labelled rows to train on, about: the bound of the sample.
SAMPLE = 12_000
FOLDS, HELD_OUT, CUTOFF = 4, 2, 0.7
SLICE_BYTES = 2 << 20
#: Classes of each structure statistic: upper bounds of all but the last. Fixed values.
_SHARES = (0.002, 0.01, 0.03, 0.06, 0.1, 0.16, 0.25, 0.4, 0.6, 0.8)
STATISTICS: dict[str, tuple[float, ...]] = {
    "words": (3, 6, 10, 15, 20, 30, 50, 80, 130, 250, 500, 1500, 5000),
    "word_bytes": (2, 3, 3.6, 4.2, 4.8, 5.4, 6, 7, 8, 10, 14),
    "kinds": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "top_word": (0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.35, 0.6),
    "equal_neighbours": (0.002, 0.01, 0.03, 0.1, 0.3, 0.6),
    "line_words": (1.5, 3, 5, 8, 12, 20, 40, 80, 200),
    "capitals": _SHARES,
    "digits": _SHARES,
    "hash_signs": _SHARES,
    "stars": _SHARES,
    "dollars": _SHARES,
    "percents": _SHARES,
    "ampersands": _SHARES,
    "bars": _SHARES,
    "exclamations": _SHARES,
    "stops": _SHARES,
    "commas": _SHARES,
    "angles": _SHARES,
    "other_marks": _SHARES,
    "not_ascii": _SHARES,
}
_BYTES = {"digits": b"0123456789", "hash_signs": b"#", "stars": b"*", "dollars": b"$", "percents": b"%", "ampersands": b"&", "bars": b"|", "exclamations": b"!?", "stops": b".", "commas": b",", "angles": b"<>{}[]\\", "other_marks": b"\"'()-/:;=@^_`~+"}
_OFFSETS = np.cumsum([0] + [len(b) + 1 for b in STATISTICS.values()])
#: Classes of a metadata column: by its binary order of magnitude; the last is null.
_META = 34


def width(metadata: int) -> int:
    return BUCKETS + int(_OFFSETS[-1]) + metadata * _META


def features(texts: list[bytes], metadata: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of what is not zero, in the order of rows."""
    n = len(texts)
    metadata = metadata or []
    words = Words(texts, WORD_BYTES)
    hashes = words.hashes()
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS
    cell, count = np.unique(words.text * BUCKETS + bucket, return_counts=True)
    row = cell // BUCKETS
    weight = np.log1p(count)
    weight /= np.sqrt(np.bincount(row, weight**2, minlength=n))[row]
    rows, cells, weights = [row], [cell % BUCKETS], [weight]

    solid = Words(texts, SOLID_BYTES)
    n_solid = solid.counts
    many, least = np.maximum(words.counts, 1), np.maximum(n_solid, 1)
    sizes = np.bincount(solid.text, solid.end - solid.begin, minlength=n) if n else np.zeros(0)
    chars = np.maximum(sizes, 1)
    same = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        same[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    top = np.zeros(n)
    if len(cell):
        np.maximum.at(top, row, count)
    raw = [np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256) for t in texts]
    table = np.array(raw).reshape(n, 256) if n else np.zeros((0, 256), dtype=np.int64)
    kinds = np.bincount(row, minlength=n) if len(row) else np.zeros(n)
    values = {
        "words": n_solid,
        "word_bytes": sizes / least,
        "kinds": kinds / many,
        "top_word": top / many,
        "equal_neighbours": np.bincount(words.text, same, minlength=n) / many if len(same) else np.zeros(n),
        "line_words": n_solid / (table[:, 10] + 1),
        "capitals": table[:, 65:91].sum(axis=1) / chars,
        "not_ascii": table[:, 128:].sum(axis=1) / chars,
        **{k: table[:, list(b)].sum(axis=1) / chars for k, b in _BYTES.items()},
    }
    each = 1 / np.sqrt(len(STATISTICS))
    for (name, bounds), offset in zip(STATISTICS.items(), _OFFSETS, strict=False):
        rows.append(np.arange(n))
        cells.append(BUCKETS + offset + np.searchsorted(bounds, values[name], side="right"))
        weights.append(np.full(n, each))
    for k, column in enumerate(metadata):
        rows.append(np.arange(n))
        size = np.log2(np.maximum(np.nan_to_num(column), 0) + 1).astype(np.int64).clip(0, _META - 2)
        cells.append(BUCKETS + int(_OFFSETS[-1]) + k * _META + np.where(np.isnan(column), _META - 1, size))
        weights.append(np.full(n, each))
    row, cell, weight = np.concatenate(rows), np.concatenate(cells), np.concatenate(weights)
    order = np.argsort(row, kind="stable")
    return row[order], cell[order].astype(np.int64), weight[order].astype(np.float32)


class Machine:
    """bias, weights w (features) and factors v (features x FACTORS)."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def raw(self, n: int, row: np.ndarray, cell: np.ndarray, weight: np.ndarray) -> np.ndarray:
        linear = np.bincount(row, self.w[cell] * weight, minlength=n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            part = self.v[cell, f] * weight
            pairs += np.bincount(row, part, minlength=n) ** 2 - np.bincount(row, part**2, minlength=n)
        return self.bias + linear + pairs / 2

    def score(self, n: int, row: np.ndarray, cell: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(n, row, cell, weight), -35, 35)))


def fit(n: int, row: np.ndarray, cell: np.ndarray, weight: np.ndarray, label: np.ndarray, size: int, *, steps: int = 560, rate: float = 0.08, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Mini-batch AdaGrad on the logistic loss, 12 times over all rows and `steps` batches at least; label: share of good labels, 0 to 1."""
    share = float(label.mean()) if n else 0.5
    if not n or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    random = np.random.default_rng(seed)
    bias = float(np.log(share / (1 - share)))
    w = np.zeros(size, np.float32)
    v = random.normal(0, 0.02, (size, FACTORS)).astype(np.float32)
    gw, gv, gb = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    starts = np.searchsorted(row, np.arange(n + 1))
    batch = min(256, max(16, n // 32))
    for _ in range(max(12, -(-steps * batch // n))):
        for part in np.array_split(random.permutation(n), max(1, n // batch)):
            x = np.zeros((len(part), size), np.float32)
            for i, r in enumerate(part):
                a, b = starts[r], starts[r + 1]
                x[i, cell[a:b]] = weight[a:b]
            s = x @ v
            raw = bias + x @ w + ((s**2).sum(axis=1) - ((x**2) @ (v**2)).sum(axis=1)) / 2
            off = ((1 / (1 + np.exp(-np.clip(raw, -35, 35))) - label[part]) / len(part)).astype(np.float32)
            db = float(off.sum())
            dw = x.T @ off + decay * w
            dv = x.T @ (off[:, None] * s) - ((x**2).T @ off)[:, None] * v + decay * v
            gb += db**2
            gw += dw**2
            gv += dv**2
            bias -= rate * db / gb**0.5
            w -= rate * dw / np.sqrt(gw)
            v -= rate / 4 * dv / np.sqrt(gv)
    return Machine(bias, w, v)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _numbers(column: pa.Array) -> np.ndarray:
    return np.array([np.nan if x is None else float(x) for x in column.to_pylist()], dtype=np.float64)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, metadata: tuple[str, ...] = (), *, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most about `sample` labelled rows of `docs` outside the held-out fold."""
    small_arrow_batches(docs.sparkSession)
    key = F.col(id_col).cast("long")
    known = labels.where(F.col(label_col).isNotNull() & key.isNotNull() & ~held_out(key)).groupBy(key.alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("__label"))
    whole = known.count()
    places = 1 << 30
    cut = places if whole <= sample else int(places * sample / whole)
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(places)) < cut)  # about `sample` rows of 16 bytes: safe to broadcast
    rows = docs.select(key.alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).cast("double").alias(f"__meta{i}") for i, c in enumerate(metadata)]).join(F.broadcast(chosen), "__id")
    # a repeated id gives one row, that with the least text, so that the bound on the sample holds
    one = F.min(F.struct("__text", *[f"__meta{i}" for i in range(len(metadata))], "__label")).alias("r")
    rows = rows.groupBy("__id").agg(one).select("__id", "r.*")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_column(batch.column(1))
            cells, weights = [], []
            for a, b in byte_slices([len(t) for t in texts], SLICE_BYTES):
                row, cell, weight = features(texts[a:b], [_numbers(batch.column(2 + i))[a:b] for i in range(len(metadata))])
                at = np.searchsorted(row, np.arange(b - a + 1))
                cells += [cell[x:y].astype(np.uint16).tobytes() for x, y in zip(at, at[1:], strict=False)]
                weights += [weight[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 1), pa.array(cells, pa.binary()), pa.array(weights, pa.binary())], names=["id", "label", "cells", "weights"])

    ordered = rows.select("__id", "__text", *[f"__meta{i}" for i in range(len(metadata))], "__label").mapInArrow(scan, "id long, label double, cells binary, weights binary")
    got = sorted(((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in ordered.toLocalIterator()))
    size = width(len(metadata))
    if not got:
        none = np.zeros(0)
        return fit(0, none, none, none, none, size)
    cells = [np.frombuffer(r[2], np.uint16) for r in got]
    row = np.repeat(np.arange(len(got)), [len(c) for c in cells])
    return fit(len(got), row, np.concatenate(cells).astype(np.int64), np.concatenate([np.frombuffer(r[3], np.float32) for r in got]), np.array([r[1] for r in got]), size)


def _scorer(docs: DataFrame, machine: Machine):
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    def scores(texts: list[bytes], metadata: list[np.ndarray]) -> np.ndarray:
        own = Machine(*sent.value)
        out = [np.zeros(0)]
        for a, b in byte_slices([len(t) for t in texts], SLICE_BYTES):
            out.append(own.score(b - a, *features(texts[a:b], [m[a:b] for m in metadata])))
        return np.concatenate(out)

    return scores


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), *, cutoff: float = CUTOFF) -> DataFrame:
    """Rows (id, held_out, score, predicted) for each row of `docs`."""
    small_arrow_batches(docs.sparkSession)
    scores = _scorer(docs, machine)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(utf8_column(batch.column(1)), [_numbers(batch.column(2 + i)) for i in range(len(metadata))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["__id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).cast("double").alias(f"__meta{i}") for i, c in enumerate(metadata)])
    out = own.mapInArrow(scan, "__id long, score double")
    return out.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text", metadata: tuple[str, ...] = (), *, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs` that score `cutoff` or more, with all columns."""
    small_arrow_batches(docs.sparkSession)
    scores = _scorer(docs, machine)
    place, others = docs.columns.index(text_col), [docs.columns.index(c) for c in metadata]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(utf8_column(batch.column(place)), [_numbers(batch.column(i)) for i in others])
            yield batch.filter(pa.array(found >= cutoff, pa.bool_()))

    # names with dots can't go through an Arrow function, so columns go by number
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(keep, numbered.schema).toDF(*docs.columns)
