"""Sequence files, match files and fragment files as DataFrames. Compressed files (.gz) are read as Spark reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators.postings import DEALT


def _numbered(records: DataFrame) -> DataFrame:
    """Rows (path, value) with seqnum: by file name, then by place in the file.

    Rows are counted for each part of a file that a task reads, and numbered inside it; the parts' offsets come from
    a window over one row for each part.
    """
    rows = records.withColumn("__at", F.monotonically_increasing_id())
    part = ["path", "__block"]
    counts = rows.groupBy(*part).agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("__at")) - 1
    return rows.withColumn("__inside", inside).join(F.broadcast(offsets.drop("__n")), part).withColumn("seqnum", (F.col("__before") + F.col("__inside")).cast("long")).drop("__at", "__block", "__inside", "__before")


def _records(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    rows = spark.read.text(paths, lineSep=separator)
    return rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"))


def _finished(rows: DataFrame) -> DataFrame:
    """seqnum, file_no, description, seq, len; file_no counts the files by name from 0."""
    files = rows.select("path").distinct().withColumn("file_no", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))
    return rows.join(F.broadcast(files), "path").select("seqnum", "file_no", "description", "seq", F.length("seq").cast("long").alias("len"))


def _no_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """'>' begins a description line; the lines up to the next are the sequence, without white space."""
    rows = _records(spark, paths, "\n>").withColumn("value", F.regexp_replace("value", r"^\s*>", ""))
    rows = _numbered(rows.where(F.btrim("value") != ""))
    return _finished(rows.select("path", "seqnum", F.regexp_extract("value", r"^([^\r\n]*)", 1).alias("description"), _no_blanks(F.regexp_replace("value", r"^[^\n]*", "")).alias("seq")))


def _flat(spark: SparkSession, paths: str | list[str], first: tuple[str, ...], start: str) -> DataFrame:
    rows = _numbered(_records(spark, paths, "\n//").where(F.col("value").rlike(rf"(?m)^{first[0]}")))
    named = [F.regexp_extract_all("value", F.lit(rf"(?m)^{k}[ \t]+([^\r\n]*)"), F.lit(1)) for k in first]
    body = F.regexp_extract("value", rf"(?s)\n{start}[^\n]*\n(.*)$", 1)
    return _finished(rows.select("path", "seqnum", F.array_join(F.concat(*named), " ").alias("description"), F.regexp_replace(body, r"[\s0-9]", "").alias("seq")))


def read_embl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """EMBL and SWISSPROT flat files; the description is the ID line and the DE lines."""
    return _flat(spark, paths, ("ID", "DE"), "SQ")


def read_genbank(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The description is the LOCUS line and the DEFINITION line."""
    return _flat(spark, paths, ("LOCUS", "DEFINITION"), "ORIGIN")


def read_plain(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Each file is one sequence as it is."""
    rows = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("__block"))
    return _finished(_numbered(rows).select("path", "seqnum", F.lit("").alias("description"), F.col("value").alias("seq")))


FORMATS = {"fasta": read_fasta, "embl": read_embl, "genbank": read_genbank, "plain": read_plain}


def sniff(spark: SparkSession, path: str) -> str:
    """The format by the first characters that aren't white space."""
    row = spark.read.text(path).where(F.btrim("value") != "").limit(1).collect()
    text = row[0][0].lstrip() if row else ""
    return "fasta" if text.startswith(">") else "genbank" if text.startswith("LOCUS") else "embl" if text.startswith("ID ") else "plain"


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files of one format, which is found out; files of different formats are an error."""
    paths = [paths] if isinstance(paths, str) else paths
    found = {sniff(spark, p) for p in paths}
    if len(found) > 1:
        raise ValueError(f"files of different formats: {sorted(found)}")
    return FORMATS[found.pop()](spark, paths)


def query_part(query: DataFrame, first: int, last: int, seqnum: int | None = None) -> DataFrame:
    """One query, cut to the places from `first` to `last`; without a seqnum there must be one query only."""
    if seqnum is not None:
        query = query.where(F.col("seqnum") == seqnum)
    elif len(query.select("seqnum").take(2)) > 1:
        raise ValueError("a part can be taken of one query only")
    seq = F.substr(F.col("seq"), F.lit(first + 1), F.lit(last - first + 1))
    return query.withColumn("seq", seq).withColumn("len", F.length("seq").cast("long"))


def database_ranges(query: DataFrame) -> DataFrame:
    """Queries with from and to where all descriptions end in '@ from to', which limits the part of the database; else both are null."""
    number = lambda i: F.regexp_extract("description", r"@\s*(\d+)\s+(\d+)\s*$", i)
    every = query.agg(F.min((number(1) != "").cast("int"))).first()[0] == 1
    value = lambda i: number(i).try_cast("long") if every else F.lit(None).cast("long")
    return query.withColumns({"from": value(1), "to": value(2)})


def read_matches(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines 'len1 seq1 pos1 mode len2 seq2 pos2 distance evalue score identity'; others begin with '#'."""
    rows = spark.read.text(paths).where(~F.ltrim("value").startswith("#") & (F.btrim("value") != ""))
    x = F.split(F.btrim("value"), r"\s+")
    names = ["len1", "seq1", "pos1", "mode", "len2", "seq2", "pos2", "distance", "evalue", "score", "identity"]
    types = ["long", "long", "long", "string", "long", "long", "long", "long", "double", "long", "double"]
    return rows.select(*[F.get(x, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types, strict=True))])


def match_file_arguments(spark: SparkSession, path: str) -> str | None:
    """What follows '# args=' on the first line; of several files that of the one which is read first."""
    row = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select("value").limit(1).collect()
    text = row[0][0] if row else ""
    return text.removeprefix("# args=") if text.startswith("# args=") else None


def read_fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of four or five numbers: start1 end1 start2 end2 [weight]."""
    rows = spark.read.text(paths).where(~F.ltrim("value").startswith("#") & (F.btrim("value") != ""))
    x = F.split(F.btrim("value"), r"\s+")
    return rows.select(*[F.get(x, F.lit(i)).cast("long").alias(n) for i, n in enumerate(["start1", "end1", "start2", "end2"])], F.get(x, F.lit(4)).cast("double").alias("weight"))


def read_score_matrix(text: str) -> dict[tuple[str, str], int]:
    """A substitution matrix: a line of column symbols, then a line for each row symbol; '#' begins a comment."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {(r[0], c): int(v) for r in rows[1:] for c, v in zip(rows[0], r[1:], strict=True)}


def read_table(spark: SparkSession, url: str, table: str, **properties: str) -> DataFrame:
    """A table of a database."""
    return spark.read.jdbc(url, table, properties=properties)


def write_postings(rows: DataFrame, path: str, parts: int = 200) -> None:
    """Postings (h1, h2, ...) as Parquet, dealt out and sorted by hash, so that a scan prunes by it; in more than `parts` parts where those would be large."""
    rows.repartitionByRange(max(parts, -(-rows.count() // DEALT)), "h1", "h2").sortWithinPartitions("h1", "h2").write.mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One or several stores of postings as one."""
    return spark.read.parquet(*paths)
