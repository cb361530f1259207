"""Token counts of whole texts with a public tokenizer's vocabulary.

Texts go through an Arrow function that returns lengths only. A batch is cut into slices of about
equal bytes. Every text is split before its spaces: the vocabulary has no piece with a space mark after
another character, so no merge crosses such a place and the counts of the parts add up to that
of the whole. Equal parts of a slice are encoded once.

Null and empty texts have 0 tokens. Texts may be of any length; a text is never cut short. Repeated
rows and equal ids each give a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import byte_slices, small_arrow_batches

MODEL = "piece_bpe_32k.model"
#: Parts that are remembered at a time, and the longest one.
KNOWN, KNOWN_CHARS = 800_000, 64


def parts_of(text: str) -> list[str]:
    """`text` cut before each run of spaces; a part is what the tokenizer's own leading mark makes of one space less.

    The tokenizer puts a space before the text and takes its own space mark in a text as a space. Of each run of spaces the first is that mark; a part that
    is nothing but one space is ''.
    """
    out, extra = [], 0
    pieces = text.replace("▁", " ").split(" ")
    last = len(pieces) - 1
    for i, piece in enumerate(pieces):
        if piece or i == last:
            out.append(" " * extra + piece if extra else piece)
            extra = 0
        else:
            extra += 1
    return out


class Counter:
    """Counts tokens with one sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Splitting is safe if no piece has a space mark behind another character.
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        cut = [parts_of(t) if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self.known = {}
        known = self.known
        new = list({p for parts in cut for p in parts if p not in known})
        counts = {p: len(x) for p, x in zip(new, self.model.encode(new, num_threads=1), strict=True)} if new else {}
        if "" in counts:
            counts[""] = 1
        long = {p: n for p, n in counts.items() if len(p) > KNOWN_CHARS}
        known.update((p, n) for p, n in counts.items() if len(p) <= KNOWN_CHARS)
        if not long:
            return [sum(map(known.__getitem__, parts)) for parts in cut]
        return [sum(known[p] if p in known else long[p] for p in parts) for parts in cut]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_path: str | None = None, limit: int = 4096, slice_bytes: int = 1 << 20) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    model_path: the model's file, readable on every executor; None: the installed package of public
    vocabularies tells its place there.
    """
    small_arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        counter = Counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            tokens: list[int] = []
            for a, b in byte_slices(sizes, slice_bytes):
                tokens += counter(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("doc_id", id_col)
