"""Matching a stream of queries against a fixed database.

The database's postings are written once; each micro-batch of queries is matched against them like a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.matches import KEY, islands
from seqloom.operators.postings import postings


def match_batch(stored: DataFrame, queries: DataFrame, least: int) -> DataFrame:
    """Maximal matches of `queries` (seqnum, seq) with stored postings (seqnum, pos, h1, h2) of k = `least`."""
    q = postings(queries, least)
    d = stored.join(q.select(*KEY).distinct(), KEY, "left_semi").withColumnsRenamed({"seqnum": "seq1", "pos": "pos1"})
    return islands(d.join(q.withColumnsRenamed({"seqnum": "seq2", "pos": "pos2"}), KEY).select("seq1", "pos1", "seq2", "pos2"), least)


def match_stream(stored: DataFrame, queries: DataFrame, least: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands the matches of each micro-batch of the stream `queries` to `sink` with the batch's number.

    A batch that is run again after a failure has the same number, so a sink that writes by it writes once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(match_batch(stored, batch, least), number)

    return queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()


def hits_by_window(matches: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Matches of a stream counted in windows of event time; rows later than `late` are left out."""
    return matches.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("cnt"))
