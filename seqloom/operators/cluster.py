"""Clusters by single linkage, of sequences and of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.util import written

MAX_ROUNDS = 100


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (elem, cluster): the least element of each component stands for it.

    Every round each element takes the least label among its neighbours and itself, then the label of that label,
    so labels halve their way to the least one. Minima are pre-aggregated; rounds are written, which cuts the lineage.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    now = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")))
    for _ in range(MAX_ROUNDS):
        near = both.join(now.withColumnsRenamed({"x": "y", "label": "other"}), "y").groupBy("x").agg(F.min("other").alias("other"))
        least = now.join(near, "x").select("x", F.least("label", "other").alias("label"), F.col("label").alias("was"))
        up = least.select(F.col("x").alias("label"), F.col("label").alias("up"))
        new = written(least.join(up, "label", "left").select("x", F.least("label", F.coalesce("up", "label")).alias("label"), "was"))
        if new.where("label != was").isEmpty():
            return new.select(F.col("x").alias("elem"), F.col("label").alias("cluster"))
        now = new.select("x", "label")
    raise RuntimeError("labels did not settle")


def sequence_edges(matches: DataFrame, seqs: DataFrame, small_percent: int, large_percent: int) -> DataFrame:
    """Edges (a, b) between sequences whose match covers enough of the smaller and of the larger one."""
    lens = seqs.select("seqnum", "len")
    one, two = (lens.select(F.col("seqnum").alias(f"seq{i}"), F.col("len").alias(f"__n{i}")) for i in (1, 2))
    rows = matches.where("seq1 != seq2").join(one, "seq1").join(two, "seq2")
    least = F.least("len1", "len2")
    small, large = F.least("__n1", "__n2"), F.greatest("__n1", "__n2")
    rows = rows.where((least >= F.floor(small * small_percent / 100)) & (least >= F.floor(large * large_percent / 100)))
    return rows.select(F.least("seq1", "seq2").alias("a"), F.greatest("seq1", "seq2").alias("b")).distinct()


def sequence_clusters(matches: DataFrame, seqs: DataFrame, small_percent: int, large_percent: int) -> DataFrame:
    """Rows (seqnum, cluster) for every sequence; one without an edge is its own cluster."""
    found = components(sequence_edges(matches, seqs, small_percent, large_percent)).withColumnRenamed("elem", "seqnum")
    return seqs.select("seqnum").join(found, "seqnum", "left").select("seqnum", F.coalesce("cluster", "seqnum").alias("cluster"))


def clusters_of_matched(matches: DataFrame, seqs: DataFrame, small_percent: int, large_percent: int) -> DataFrame:
    """As sequence_clusters(), but only sequences that a match names are elements, as for clusters of stored matches."""
    named = matches.select(F.explode(F.array("seq1", "seq2")).alias("seqnum")).distinct()
    return sequence_clusters(matches, seqs.join(named, "seqnum", "left_semi"), small_percent, large_percent)


def non_redundant(clusters: DataFrame, seqs: DataFrame) -> DataFrame:
    """The longest sequence of each cluster, of several the one with the least number."""
    best = clusters.join(seqs.select("seqnum", "len"), "seqnum").groupBy("cluster").agg(F.max(F.struct("len", (-F.col("seqnum")).alias("neg"))).alias("m"))
    return best.select((-F.col("m.neg")).alias("seqnum"), "cluster", F.col("m.len").alias("len"))


def size_distribution(clusters: DataFrame) -> DataFrame:
    """Rows (size, clusters): how many clusters have each size, singletons as size 1."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def _ends(matches: DataFrame) -> DataFrame:
    """Rows (match_id, seqnum, start, end): both instances of each match."""
    left = matches.select("match_id", F.col("seq1").alias("seqnum"), F.col("pos1").alias("start"), (F.col("pos1") + F.col("len1")).alias("end"))
    return left.unionByName(matches.select("match_id", F.col("seq2").alias("seqnum"), F.col("pos2").alias("start"), (F.col("pos2") + F.col("len2")).alias("end")))


def clusters_by_gap(matches: DataFrame, gap: int) -> DataFrame:
    """Rows (match_id, cluster): matches linked if instances of theirs lie `gap` or less apart in a sequence.

    Instances in the order of their starts form runs; a run links its matches to its first.
    """
    w = Window.partitionBy("seqnum").orderBy("start", "end", "match_id")
    rows = _ends(matches).withColumn("__reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__run", F.sum(F.when(F.col("start") <= F.col("__reach") + gap, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = rows.groupBy("seqnum", "__run").agg(F.min("match_id").alias("__first"))
    edges = rows.join(first, ["seqnum", "__run"]).select(F.col("__first").alias("a"), F.col("match_id").alias("b")).where("a != b").distinct()
    return _with_singles(components(edges), matches)


def clusters_by_overlap(matches: DataFrame, percent: int, *, bin_size: int = 256) -> DataFrame:
    """Rows (match_id, cluster): matches linked if instances overlap by `percent` of the longer one.

    An overlap that counts holds the later start, so instances meet in the bins they cover only, and a pair
    is taken in the bin of its later start.
    """
    rows = _ends(matches).withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    a, b = rows.alias("a"), rows.alias("b")
    low, high = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    longer = F.greatest(F.col("a.end") - F.col("a.start"), F.col("b.end") - F.col("b.start"))
    linked = (F.col("a.seqnum") == F.col("b.seqnum")) & (F.col("a.__bin") == F.col("b.__bin")) & (F.col("a.match_id") < F.col("b.match_id")) & (F.floor(low / bin_size) == F.col("a.__bin")) & (100 * (high - low) >= percent * longer) & (high > low)
    edges = a.join(b, linked).select(F.col("a.match_id").alias("a"), F.col("b.match_id").alias("b")).distinct()
    return _with_singles(components(edges), matches)


def clusters_by_similarity(matches: DataFrame, seqs: DataFrame, percent: int) -> DataFrame:
    """Rows (match_id, cluster): matches linked if an instance of one is within `percent` edits of one of the other.

    Errors are counted against the shortest of the four instances. Two strings within k edits share one of
    the k + 1 pieces of the shorter one, shifted by k or less; pairs are sought among equal q-grams, and
    the few that share one are compared. q is the piece that is sure to be whole.
    """
    from seqloom.operators.postings import windows

    texts = None
    for i in (1, 2):
        part = matches.select("match_id", F.col(f"seq{i}").alias("seqnum"), F.col(f"pos{i}").alias("start"), F.col(f"len{i}").alias("n"), F.least("len1", "len2").alias("least"))
        texts = part if texts is None else texts.unionByName(part)
    texts = texts.join(seqs.select("seqnum", "seq"), "seqnum").select("match_id", "n", "least", F.substr(F.col("seq"), (F.col("start") + 1).cast("int"), F.col("n").cast("int")).alias("text"))
    strings = written(texts.select("text").distinct().withColumn("seqnum", F.xxhash64("text")))
    bound = F.floor(F.least(F.col("a.least"), F.col("b.least")) * percent / 100)
    ids = written(texts.withColumn("sid", F.xxhash64("text")))
    if not percent:
        first = ids.groupBy("sid").agg(F.min("match_id").alias("a"))
        edges = ids.join(first, "sid").select("a", F.col("match_id").alias("b"))
        return _with_singles(components(edges.where("a != b").distinct()), matches)
    shortest = texts.agg(F.min("n")).first()[0] or 0
    # of n characters with n * percent / 100 errors, cut into one piece more than errors, the shortest piece
    k = max(1, int(100 / (percent + 100 / max(1, shortest))))
    grams = windows(strings.select("seqnum", F.col("text").alias("seq")), k).select("seqnum", "kmer").distinct()
    near = grams.alias("x").join(grams.alias("y"), (F.col("x.kmer") == F.col("y.kmer")) & (F.col("x.seqnum") <= F.col("y.seqnum"))).select(F.col("x.seqnum").alias("s"), F.col("y.seqnum").alias("t")).distinct()
    pairs = ids.alias("a").join(near, F.col("a.sid") == F.col("s")).join(ids.alias("b"), F.col("b.sid") == F.col("t"))
    pairs = pairs.where((F.col("a.match_id") != F.col("b.match_id")) & (F.abs(F.col("a.n") - F.col("b.n")) <= bound))
    close = pairs.where(F.levenshtein("a.text", "b.text") <= bound)
    edges = close.select(F.least("a.match_id", "b.match_id").alias("a"), F.greatest("a.match_id", "b.match_id").alias("b")).distinct()
    return _with_singles(components(edges), matches)


def _with_singles(found: DataFrame, matches: DataFrame) -> DataFrame:
    own = matches.select("match_id").distinct()
    return own.join(found.withColumnRenamed("elem", "match_id"), "match_id", "left").select("match_id", F.coalesce("cluster", "match_id").alias("cluster"))
