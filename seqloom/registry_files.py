"""Queries that write the driver's tables in each format and read them again, and that render matches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import filters, intervals, matches, postings
from seqloom.plans import stored
from seqloom.registry import _CB, _LETTERS, _SEQ, _bench, _conv, _docs, _mem, _query, _read, _scored, _SCORED
from seqloom.sources import readers, writers
from seqloom.util import table_folder


def _folder(spark, name: str) -> str:
    return f"{table_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _items(spark, d) -> DataFrame:
    """Benchmark items with a description, sorted into several files, so that file and place give their order."""
    rows = _bench(spark, d).withColumn("description", F.concat(F.lit("item "), F.col("seqnum").cast("string")))
    return rows.repartitionByRange(3, "seqnum").sortWithinPartitions("seqnum")


def _back(rows: DataFrame) -> DataFrame:
    return rows.select("seqnum", "description", "seq", "len")


_PLAIN = r"regexp_replace(seq, '\s', '', 'g')"
_FILES = f"SELECT row_number() OVER (ORDER BY seqnum) - 1 AS seqnum, 'item ' || seqnum AS description, {_PLAIN} AS seq, length({_PLAIN})::BIGINT AS len FROM ({_SEQ['bench']})"


@_query("source_fasta", _FILES)
def _(spark, d):
    path = _folder(spark, "fasta")
    writers.write_fasta(_items(spark, d).withColumn("seq", F.regexp_replace("seq", r"\s", " ")), path)
    return _back(readers.read_fasta(spark, path))


@_query("source_fasta_gzip", _FILES)
def _(spark, d):
    path = _folder(spark, "gzip")
    _items(spark, d).select(writers.fasta_record(50).alias("value")).write.text(path, compression="gzip")
    return _back(readers.read_fasta(spark, path))


@_query("source_sniffed", f"SELECT *, 'fasta' AS format FROM ({_FILES})")
def _(spark, d):
    path = _folder(spark, "sniffed")
    writers.write_fasta(_items(spark, d).withColumn("seq", F.regexp_replace("seq", r"\s", " ")), path)
    return _back(readers.read_sequences(spark, path)).withColumn("format", F.lit(readers.sniff(spark, path)))


_LETTERED = f"regexp_replace(seq, '[^{_LETTERS}]', '', 'g')"
_FLAT = f"SELECT row_number() OVER (ORDER BY seqnum) - 1 AS seqnum, 'ID' || seqnum || ' of the benchmark' AS description, {_LETTERED} AS seq, length({_LETTERED})::BIGINT AS len FROM ({_SEQ['bench']})"


def _flat(spark, d, first: str, second: str, start: str, read) -> DataFrame:
    """Records with an identifier line, a definition line, and letters in tens with numbers between."""
    path = _folder(spark, first)
    letters = F.regexp_replace("seq", f"[^{_LETTERS}]", "")
    body = F.array_join(F.transform(F.regexp_extract_all(letters, F.lit("[A-Za-z]{1,10}"), F.lit(0)), lambda x, i: F.concat(F.lit("  "), (i * 10 + 1).cast("string"), F.lit(" "), x)), "\n")
    record = F.concat(F.lit(f"{first}   ID"), F.col("seqnum").cast("string"), F.lit(f"\n{second}   of the benchmark\n{start}\n"), body, F.lit("\n//"))
    _items(spark, d).select(record.alias("value")).write.text(path)
    return _back(read(spark, path))


@_query("source_embl", _FLAT)
def _(spark, d):
    return _flat(spark, d, "ID", "DE", "SQ", readers.read_embl)


@_query("source_genbank", _FLAT)
def _(spark, d):
    return _flat(spark, d, "LOCUS", "DEFINITION", "ORIGIN", readers.read_genbank)


@_query("source_plain", f"SELECT '' AS description, seq || chr(10) AS seq, length(seq)::BIGINT + 1 AS len FROM ({_SEQ['bench']})")
def _(spark, d):
    path = _folder(spark, "plain")
    _bench(spark, d).select("seqnum", F.col("seq").alias("value")).repartition("seqnum").write.partitionBy("seqnum").text(path)
    return readers.read_plain(spark, path).select("description", "seq", "len")


@_query("source_files_numbered", f"SELECT count(DISTINCT f)::BIGINT AS files, count(*) AS n, sum(length({_PLAIN}))::BIGINT AS total FROM (SELECT *, 1 AS f FROM ({_SEQ['bench']}) UNION ALL SELECT *, 2 FROM ({_SEQ['bench']}))")
def _(spark, d):
    paths = [_folder(spark, f"part{i}") for i in (1, 2)]
    for p in paths:
        writers.write_fasta(_bench(spark, d).withColumn("description", F.lit("x")).withColumn("seq", F.regexp_replace("seq", r"\s", " ")).coalesce(1), p)
    rows = readers.read_fasta(spark, paths)
    return rows.agg(F.count_distinct("file_no").alias("files"), F.count_distinct("seqnum").alias("n"), F.sum("len").alias("total"))


@_query("query_part", f"SELECT seqnum, substr(seq, 11, 50) AS seq, length(substr(seq, 11, 50))::BIGINT AS len FROM ({_SEQ['bench']}) WHERE seqnum = 7")
def _(spark, d):
    return readers.query_part(_bench(spark, d), 10, 59, 7)


_RANGED = f"SELECT m.*, abs_start + pos1 AS a, 5000 * seq2 AS lo, 5000 * seq2 + 150000 AS hi FROM ({_CB}) m JOIN (SELECT seqnum, sum(length(seq) + 1) OVER (ORDER BY seqnum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM ({_SEQ['conv']})) n ON n.seqnum = seq1, LATERAL (SELECT coalesce(n.s, 0) AS abs_start)"


@_query("query_database_ranges", f"SELECT seq1, (pos1 + greatest(0, lo - a))::BIGINT AS pos1, seq2, (pos2 + greatest(0, lo - a))::BIGINT AS pos2, (least(len, hi + 1 - a) - greatest(0, lo - a))::BIGINT AS len FROM ({_RANGED}) WHERE least(len, hi + 1 - a) - greatest(0, lo - a) >= 12")
def _(spark, d):
    conv, bench = _conv(spark, d), _bench(spark, d)
    spec = F.concat(F.lit("q @ "), (F.col("seqnum") * 5000).cast("string"), F.lit(" "), (F.col("seqnum") * 5000 + 150_000).cast("string"))
    return matches.in_database_ranges(matches.query_matches(conv, bench, 12), conv, readers.database_ranges(bench.withColumn("description", spec)), 12)


_LINES = f"SELECT len AS len1, seq1, pos1, 'D' AS mode, len AS len2, seq2, pos2, 0::BIGINT AS distance, score, 100.0::DOUBLE AS identity FROM ({_SCORED})"


def _full(spark, d) -> DataFrame:
    return _scored(spark, d).withColumn("mode", F.lit("D"))


@_query("source_matches", _LINES)
def _(spark, d):
    path = _folder(spark, "matches")
    writers.write_matches(_full(spark, d), path, "-l 30", "gzip")
    return readers.read_matches(spark, path).drop("evalue")


@_query("sink_match_arguments", "SELECT '-l 30' AS arguments")
def _(spark, d):
    path = _folder(spark, "arguments")
    writers.write_matches(_full(spark, d), path, "-l 30", "gzip")
    return spark.range(1).select(F.lit(readers.match_file_arguments(spark, path)).alias("arguments"))


@_query("sink_match_lines", f"SELECT concat_ws(' ', len, seq1, pos1, 'D', len, seq2, pos2, 0, score, '100.00') AS line FROM ({_SCORED})")
def _(spark, d):
    return _full(spark, d).select(writers.match_line(leave_out=("evalue",)).alias("line"))


@_query("sink_xml", f"SELECT seq1, pos1, seq2, pos2, len AS len1 FROM ({_SCORED})")
def _(spark, d):
    path = _folder(spark, "xml")
    writers.write_xml(_full(spark, d).select("seq1", "pos1", "seq2", "pos2", "len1"), path, "gzip")
    return spark.read.format("xml").option("rowTag", "match").schema("seq1 long, pos1 long, seq2 long, pos2 long, len1 long").load(path)


@_query("sink_fasta_records", "SELECT '>item ' || seqnum || chr(10) || array_to_string([substr(seq, (40 * i + 1)::INT, 40) FOR i IN range(0, (length(seq) + 39) // 40)], chr(10)) AS value FROM (" + _SEQ["bench"] + ")")
def _(spark, d):
    return _items(spark, d).select(writers.fasta_record(40).alias("value"))


_CL = "SELECT seqnum, seqnum % 7 AS cluster FROM (" + _SEQ["bench"] + ")"


@_query("sink_clusters", f"SELECT seqnum, cluster FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM ({_CL})) WHERE n >= 2")
def _(spark, d):
    path = _folder(spark, "clusters")
    writers.write_clusters(_bench(spark, d).select("seqnum", (F.col("seqnum") % 7).alias("cluster")), path, (2, None))
    return spark.read.parquet(path).select("seqnum", F.col("cluster").cast("long").alias("cluster"))


@_query("sink_chains", f"SELECT seqnum % 5 AS chain, seqnum AS step FROM ({_SEQ['bench']})")
def _(spark, d):
    path = _folder(spark, "chains")
    writers.write_chains(_bench(spark, d).select((F.col("seqnum") % 5).alias("chain"), F.col("seqnum").alias("step")), path)
    return spark.read.parquet(path).select(F.col("chain").cast("long").alias("chain"), "step")


_FRAG = f"SELECT pos1 AS start1, pos1 + len - 1 AS end1, pos2 AS start2, pos2 + len - 1 AS end2 FROM ({_CB})"


@_query("source_fragments", f"SELECT *, CASE WHEN start1 % 2 = 0 THEN start1::DOUBLE ELSE 2.0 * (end1 - start1 + 1) END AS weight FROM ({_FRAG})")
def _(spark, d):
    from seqloom.operators.chain import default_weight

    path = _folder(spark, "fragments")
    rows = matches.query_matches(_conv(spark, d), _bench(spark, d), 12)
    ends = [F.col("pos1"), F.col("pos1") + F.col("len") - 1, F.col("pos2"), F.col("pos2") + F.col("len") - 1]
    line = F.concat_ws(" ", *[x.cast("string") for x in ends], F.when(F.col("pos1") % 2 == 0, F.col("pos1").cast("string")))
    rows.select(line.alias("value")).write.text(path)
    return default_weight(readers.read_fragments(spark, path))


@_query("source_postings", _mem("conv", "bench", 14))
def _(spark, d):
    path = _folder(spark, "postings")
    readers.write_postings(postings.postings(_conv(spark, d), 14), path, 4)
    return matches.stored_matches(readers.read_postings(spark, [path]), postings.postings(_bench(spark, d), 14), 14)


@_query("source_merged_postings", _mem("conv", "bench", 14))
def _(spark, d):
    paths = [_folder(spark, f"store{i}") for i in (0, 1)]
    for i, p in enumerate(paths):
        readers.write_postings(postings.postings(_conv(spark, d).where(F.col("seqnum") % 2 == i), 14), p, 4)
    return matches.stored_matches(readers.read_postings(spark, paths), postings.postings(_bench(spark, d), 14), 14)


@_query("source_score_matrix", "SELECT x || y AS pair, (CASE WHEN x = y THEN 5 ELSE -4 END)::BIGINT AS score FROM (SELECT unnest(['a', 'c', 'g', 't']) AS x), (SELECT unnest(['a', 'c', 'g', 't']) AS y)")
def _(spark, d):
    text = "# a matrix\n  a c g t\n" + "\n".join(f"{x} " + " ".join("5" if x == y else "-4" for y in "acgt") for x in "acgt")
    return spark.createDataFrame([(x + y, v) for (x, y), v in readers.read_score_matrix(text).items()], "pair string, score long")


@_query("stored_select", f"SELECT seq1, pos1, len1, seq2, pos2, len2 FROM (SELECT seq1, pos1, len AS len1, seq2, pos2, len AS len2, score FROM ({_SCORED})) a WHERE score >= 70 AND NOT EXISTS (SELECT 1 FROM ({_SCORED}) b WHERE a.seq1 = b.seq1 AND a.seq2 = b.seq2 AND b.pos1 <= a.pos1 AND b.pos1 + b.len >= a.pos1 + a.len1 AND b.pos2 <= a.pos2 AND b.pos2 + b.len >= a.pos2 + a.len2 AND (a.pos1, a.len1, a.pos2) <> (b.pos1, b.len, b.pos2))")
def _(spark, d):
    path = _folder(spark, "select")
    writers.write_matches(_full(spark, d), path, "-l 30", "gzip")
    found = stored.run(stored.StoredTask(score=70, order="ld"), readers.read_matches(spark, path))
    return found.select("seq1", "pos1", "len1", "seq2", "pos2", "len2")


_ORDERS = {"la": "len", "ld": "-len", "ia": "pos1", "id": "-pos1", "ja": "pos2", "jd": "-pos2", "ea": "-len", "ed": "len", "sa": "score", "sd": "-score", "ida": "identity", "idd": "-identity"}


@_query("match_orders", " UNION ALL ".join(f"SELECT '{o}' AS sorting, row_number() OVER (ORDER BY {k}, seq1, pos1, seq2, pos2) AS place, seq1, pos1, seq2, pos2 FROM ({_SCORED})" for o, k in _ORDERS.items()))
def _(spark, d):
    from seqloom.util import row_numbers, written

    # of exact matches score and E-value, which underflows, order as the length does, and the identity is always 100: orders with one key are one
    same = {"len1": ("len", 1), "score": ("len", 1), "evalue": ("len", -1), "identity": ("identity", 0)}
    orders: dict[tuple[str, int], list[str]] = {}
    for name, (column, up) in filters.ORDERS.items():
        key, sign = same.get(column, (column, 1))
        orders.setdefault((key, sign if up else -sign), []).append(name)
    rows, out = written(_scored(spark, d).select(*filters.TIES, "len")), None
    for (column, sign), names in orders.items():
        placed = row_numbers(rows.select(*filters.TIES, (F.col(column) * sign if sign else F.lit(0)).alias("key")), ["key", *filters.TIES])
        part = placed.select(F.explode(F.array(*map(F.lit, names))).alias("sorting"), (F.col("before") + 1).alias("place"), *filters.TIES)
        out = part if out is None else out.unionByName(part)
    return out


@_query("match_diagonals", f"SELECT seq1, pos1, seq2, pos2, row_number() OVER (ORDER BY pos2 - pos1 DESC, pos2, seq1, pos1, seq2) AS place FROM ({_SCORED})")
def _(spark, d):
    from seqloom.util import row_numbers

    rows = filters.by_diagonal(_scored(spark, d)).select(*filters.TIES, (F.col("pos1") - F.col("pos2")).alias("key"))
    return row_numbers(rows, ["key", "pos2", "seq1", "pos1", "seq2"]).select("seq1", "pos1", "seq2", "pos2", (F.col("before") + 1).alias("place"))


@_query("store_comparison", "SELECT 0::BIGINT AS missing, 0::BIGINT AS added")
def _(spark, d):
    path = _folder(spark, "compared")
    rows = postings.postings(_bench(spark, d), 12)
    readers.write_postings(rows, path, 4)
    back = readers.read_postings(spark, [path])
    return spark.range(1).select(F.lit(rows.exceptAll(back).count()).alias("missing"), F.lit(back.exceptAll(rows).count()).alias("added"))


@_query("nomatch_shares", f"SELECT seqnum, len, " + ", ".join(f"round((len - length(replace(seq, '{c}', '')))::DOUBLE / len, 9) AS share_{c}" for c in "aet") + f" FROM (SELECT seqnum, seq, length(seq)::BIGINT AS len FROM ({_SEQ['docs']}) WHERE length(seq) > 0)")
def _(spark, d):
    parts = _docs(spark, d).where("len > 0").withColumnRenamed("seq", "text")
    return intervals.character_shares(parts, "aet").select("seqnum", "len", *[F.round(f"share_{c}", 9).alias(f"share_{c}") for c in "aet"])


@_query("descriptions", "SELECT doc_id AS seqnum, replace(substr(source || ' ' || lang, 3, 4), ' ', '_') AS cut, split_part(source || ' ' || lang, ' ', 1) AS word FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def _(spark, d):
    from seqloom.functions.scores import formatted_description

    text = F.concat_ws(" ", "source", "lang")
    rows = _read(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    return rows.select(F.col("doc_id").alias("seqnum"), formatted_description(text, 2, 4).alias("cut"), formatted_description(text, to_blank=True).alias("word"))
