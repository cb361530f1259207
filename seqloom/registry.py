"""Named queries over the driver's tables and the same in DuckDB SQL.

Tables as sequences: `documents` (doc_id, text), `benchmark` (item_id, text), `conversations`
(conv_id * 1000 + turn, text); DNA is benchmark text with its letters mapped to a, c, g and t in turn and all else
left out. Every query takes its tables whole and its sequences whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import alphabet, scores
from seqloom.operators import alignment, chain, cluster, complete, extend, filters, intervals, mass, matches, postings, select, tandem, unique, userfunctions

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = "".join("acgt"[i % 4] for i in range(26)) * 2


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return postings.sequences(_read(spark, d, "documents"), "doc_id", "text")


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return postings.sequences(_read(spark, d, "benchmark"), "item_id", "text")


def _conv(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "conversations").withColumn("seqnum", F.col("conv_id") * 1000 + F.col("turn"))
    return postings.sequences(rows, "seqnum", "text")


def _dna(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace(F.translate("text", _LETTERS, _BASES), "[^acgt]", "")
    return postings.sequences(_read(spark, d, "benchmark"), "item_id", "text", seq=text)


def _spoilt(seqs: DataFrame) -> DataFrame:
    """Whole sequences with characters 20, 40 and 60 replaced, as patterns with mismatches."""
    part = lambda i, n: F.substr(F.col("seq"), F.lit(i), F.lit(n))
    return seqs.select("seqnum", F.concat(part(1, 19), F.lit("~"), part(21, 19), F.lit("~"), part(41, 19), F.lit("~"), part(61, 1 << 30)).alias("seq"))


def _edited(seqs: DataFrame) -> DataFrame:
    """Whole sequences without character 30 and with one more after character 60."""
    part = lambda i, n: F.substr(F.col("seq"), F.lit(i), F.lit(n))
    return seqs.select("seqnum", F.concat(part(1, 29), part(31, 30), F.lit("~"), part(61, 1 << 30)).alias("seq"))


# --- SQL pieces ---------------------------------------------------------------------------------------------------

_SEQ = {
    "docs": "SELECT doc_id AS seqnum, text AS seq FROM documents WHERE text IS NOT NULL",
    "bench": "SELECT item_id AS seqnum, text AS seq FROM benchmark WHERE text IS NOT NULL",
    "conv": "SELECT conv_id * 1000 + turn AS seqnum, text AS seq FROM conversations WHERE text IS NOT NULL",
    "dna": f"SELECT item_id AS seqnum, regexp_replace(translate(text, '{_LETTERS}', '{_BASES}'), '[^acgt]', '', 'g') AS seq FROM benchmark WHERE text IS NOT NULL",
}
_SEQ["dnarc"] = f"SELECT seqnum, reverse(translate(seq, 'acgt', 'tgca')) AS seq FROM ({_SEQ['dna']})"


def _post(name: str, k: int) -> str:
    """All places and their k-mers without wildcards; texts in pieces first, since substr() walks from the start."""
    starts = f"SELECT seqnum, seq, unnest(range(0, length(seq) - {k} + 1, 256)) AS st FROM ({_SEQ[name]}) WHERE length(seq) >= {k}"
    parts = f"SELECT seqnum, st, substr(seq, (st + 1)::INT, {256 + k - 1}) AS part FROM ({starts})"
    places = f"SELECT seqnum, st, part, unnest(range(0, length(part) - {k} + 1)) AS o FROM ({parts})"
    return f"SELECT * FROM (SELECT seqnum, st + o AS pos, substr(part, (o + 1)::INT, {k}) AS km FROM ({places})) WHERE NOT contains(km, '#')"


def _islands(pairs: str, k: int) -> str:
    return f"""SELECT seq1, min(pos1) AS pos1, seq2, min(pos2) AS pos2, count(*) + {k - 1} AS len
        FROM (SELECT *, pos2 - pos1 AS diag, pos1 - row_number() OVER (PARTITION BY seq1, seq2, pos2 - pos1 ORDER BY pos1) AS run FROM ({pairs}))
        GROUP BY seq1, seq2, diag, run"""


def _mem(a: str, b: str, k: int) -> str:
    return _islands(f"SELECT x.seqnum AS seq1, x.pos AS pos1, y.seqnum AS seq2, y.pos AS pos2 FROM ({_post(a, k)}) x JOIN ({_post(b, k)}) y ON x.km = y.km", k)


def _selfm(a: str, k: int, same: bool = False) -> str:
    cond = "x.seqnum = y.seqnum AND x.pos < y.pos" if same else "(x.seqnum, x.pos) < (y.seqnum, y.pos)"
    return _islands(f"SELECT x.seqnum AS seq1, x.pos AS pos1, y.seqnum AS seq2, y.pos AS pos2 FROM ({_post(a, k)}) x JOIN ({_post(a, k)}) y ON x.km = y.km AND {cond}", k)


def _abs(name: str) -> str:
    return f"SELECT seqnum, CAST(length(seq) AS BIGINT) AS len, CAST(coalesce(sum(length(seq) + 1) OVER (ORDER BY seqnum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS abs_start FROM ({_SEQ[name]})"


def _components(edges: str) -> str:
    """WITH RECURSIVE parts: edges (a, b), cc (elem, cluster)."""
    return f"""edges AS ({edges}), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    walk(elem, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, w.root FROM walk w JOIN both_ways e ON e.a = w.elem),
    cc AS (SELECT elem, min(root) AS cluster FROM walk GROUP BY elem)"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- sequences and k-mers -----------------------------------------------------------------------------------------


@_query("seq_length_stats", f"SELECT count(*) AS n, min(length(seq))::BIGINT AS shortest, max(length(seq))::BIGINT AS longest, avg(length(seq)) AS average, sum(length(seq))::BIGINT AS total FROM ({_SEQ['docs']})")
def _(spark, d):
    return select.length_statistics(_docs(spark, d))


@_query("seq_length_distribution", f"SELECT length(seq)::BIGINT AS len, count(*) AS cnt FROM ({_SEQ['docs']}) GROUP BY 1")
def _(spark, d):
    return select.length_distribution(_docs(spark, d))


@_query("seq_select_length", f"SELECT seqnum, length(seq)::BIGINT AS len FROM ({_SEQ['docs']}) WHERE length(seq) BETWEEN 500 AND 1500")
def _(spark, d):
    return select.by_length(_docs(spark, d), 500, 1500).select("seqnum", "len")


@_query("seq_select_number", f"SELECT seqnum, length(seq)::BIGINT AS len FROM ({_SEQ['docs']}) WHERE seqnum IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    return select.by_number(_docs(spark, d), _read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("seqnum"))).select("seqnum", "len")


@_query("seq_select_desc", "SELECT doc_id AS seqnum, source || ' ' || lang AS description FROM documents WHERE regexp_matches(source || ' ' || lang, '^src1.* (de|fr)$')")
def _(spark, d):
    rows = _read(spark, d, "documents").select(F.col("doc_id").alias("seqnum"), F.concat_ws(" ", "source", "lang").alias("description"))
    return select.by_description(rows, "^src1.* (de|fr)$")


@_query("seq_longest", f"SELECT seqnum, length(seq)::BIGINT AS len FROM ({_SEQ['docs']}) ORDER BY length(seq) DESC, seqnum LIMIT 2")
def _(spark, d):
    return select.longest(_docs(spark, d)).select("seqnum", "len")


@_query("seq_absolute", _abs("docs"))
def _(spark, d):
    return matches.absolute(_docs(spark, d)).select("seqnum", "len", "abs_start")


@_query(
    "subseq_select",
    f"SELECT seqnum, greatest(0, 10000 - abs_start)::BIGINT AS start, substr(seq, greatest(0, 10000 - abs_start)::INT + 1, (least(len, 60001 - abs_start) - greatest(0, 10000 - abs_start))::INT) AS seq FROM ({_abs('docs')}) JOIN ({_SEQ['docs']}) USING (seqnum) WHERE abs_start <= 60000 AND abs_start + len > 10000",
)
def _(spark, d):
    return select.absolute_range(_docs(spark, d), 10_000, 60_000)


@_query("reverse_complement", f"SELECT seqnum, seq, reverse(translate(seq, 'acgt', 'tgca')) AS rc FROM ({_SEQ['dna']})")
def _(spark, d):
    return _dna(spark, d).select("seqnum", "seq", alphabet.reverse_complement(F.col("seq")).alias("rc"))


@_query("kmer_count", f"SELECT km AS kmer, count(*) AS cnt FROM ({_post('docs', 12)}) GROUP BY km HAVING count(*) >= 20")
def _(spark, d):
    return postings.kmer_counts(_docs(spark, d), 12, 20)


@_query("kmer_occratio", " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, count(*) FILTER (c = 1) AS uniq, count(*) FILTER (c > 1) AS nonuniq, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS nonuniqmulti, sum(c)::BIGINT AS total FROM (SELECT km, count(*) AS c FROM ({_post('conv', k)}) GROUP BY km)" for k in range(4, 9)))
def _(spark, d):
    return postings.occurrence_ratio(_conv(spark, d), 4, 8)


@_query("kmer_search", f"WITH q AS ({_post('bench', 16)}), c AS (SELECT km, count(*) AS cnt FROM ({_post('docs', 16)}) GROUP BY km) SELECT seqnum, pos, q.km AS kmer, cnt FROM q JOIN c ON q.km = c.km")
def _(spark, d):
    return postings.kmer_search(_docs(spark, d), _bench(spark, d), 16)


@_query("kmer_code", f"SELECT seqnum, pos, km AS kmer, list_sum([CASE substr(km, i, 1) WHEN 'a' THEN 0 WHEN 'c' THEN 1 WHEN 'g' THEN 2 ELSE 3 END * (4 ** (8 - i)) FOR i IN range(1, 9)])::BIGINT AS code, km AS back FROM ({_post('dna', 8)})")
def _(spark, d):
    code = alphabet.kmer_code(F.col("kmer"))
    return postings.windows(_dna(spark, d), 8).select("seqnum", "pos", "kmer", code.alias("code"), alphabet.kmer_text(code, 8).alias("back"))


# --- exact matches --------------------------------------------------------------------------------------------------


@_query("mem_doc_benchmark", _mem("docs", "bench", 40))
def _(spark, d):
    return matches.query_matches(_docs(spark, d), _bench(spark, d), 40)


@_query("mem_self_repeats", _selfm("conv", 40))
def _(spark, d):
    return matches.self_matches(_conv(spark, d), 40)


@_query("repeat_length_histogram", f"SELECT len AS length, count(*) AS cnt FROM ({_selfm('conv', 20)}) GROUP BY len")
def _(spark, d):
    return matches.length_histogram(matches.self_matches(_conv(spark, d), 20))


_GAP = f"SELECT m.*, (b.abs_start + pos2 - (a.abs_start + pos1 + m.len))::BIGINT AS gap FROM ({_selfm('conv', 20)}) m JOIN ({_abs('conv')}) a ON a.seqnum = seq1 JOIN ({_abs('conv')}) b ON b.seqnum = seq2"


@_query("repeat_bounded_gap", f"SELECT * FROM ({_GAP}) WHERE gap BETWEEN 0 AND 3000")
def _(spark, d):
    return matches.self_matches_by_gap(_conv(spark, d), 20, 0, 3000)


@_query(
    "supermaximal_repeats",
    f"""WITH m AS MATERIALIZED ({_selfm('bench', 11)}), t AS MATERIALIZED (SELECT m.*, substr(seq, (pos1 + 1)::INT, len::INT) AS w FROM m JOIN ({_SEQ['bench']}) ON seqnum = seq1),
    strings AS MATERIALIZED (SELECT DISTINCT w FROM t), inner_ AS (SELECT DISTINCT a.w FROM strings a JOIN strings b ON length(b.w) > length(a.w) AND contains(b.w, a.w))
    SELECT seq1, pos1, seq2, pos2, len FROM t WHERE w NOT IN (SELECT w FROM inner_)""",
)
def _(spark, d):
    return matches.supermaximal_repeats(_bench(spark, d), 11)


@_query(
    "tandem_repeats",
    f"""SELECT seqnum, p - 1 AS pos, h::BIGINT AS period FROM (SELECT seqnum, seq, unnest(range(1, length(seq) + 1)) AS p FROM ({_SEQ['conv']})), (SELECT unnest(range(4, 41)) AS h)
    WHERE p + 2 * h - 1 <= length(seq) AND substr(seq, p::INT, h::INT) = substr(seq, (p + h)::INT, h::INT) AND NOT contains(substr(seq, p::INT, h::INT), '#')
      AND (p + 2 * h > length(seq) OR substr(seq, p::INT, 1) <> substr(seq, (p + 2 * h)::INT, 1))""",
)
def _(spark, d):
    return tandem.tandem_repeats(_conv(spark, d), 4)


_MUM_COUNT = "(SELECT count(*) FROM ({s}) s, unnest(range(0, length(s.seq) - f.len + 1)) AS u(p) WHERE length(s.seq) >= f.len AND substr(s.seq, (p + 1)::INT, f.len::INT) = f.w)"


def _occurrences(name: str) -> str:
    """How often each string w of f is in the sequences, overlapping ones counted."""
    return f"""SELECT f.w, count(*) AS n FROM (SELECT DISTINCT w, len FROM f) f JOIN ({_post(name, 12)}) p ON p.km = substr(f.w, 1, 12) JOIN ({_SEQ[name]}) s ON s.seqnum = p.seqnum
        WHERE substr(s.seq, (p.pos + 1)::INT, f.len::INT) = f.w GROUP BY f.w"""


_MUM = f"WITH f AS MATERIALIZED (SELECT m.*, substr(seq, (pos1 + 1)::INT, len::INT) AS w FROM ({_mem('conv', 'bench', 12)}) m JOIN ({_SEQ['conv']}) ON seqnum = seq1), a AS ({_occurrences('conv')}), b AS ({_occurrences('bench')})"


@_query("mum_candidates", f"{_MUM} SELECT seq1, pos1, seq2, pos2, len FROM f JOIN a USING (w) WHERE a.n = 1")
def _(spark, d):
    return matches.mum_candidates(_conv(spark, d), _bench(spark, d), 12)


@_query("mum", f"{_MUM} SELECT seq1, pos1, seq2, pos2, len FROM f JOIN a USING (w) JOIN b USING (w) WHERE a.n = 1 AND b.n = 1")
def _(spark, d):
    return matches.mums(_conv(spark, d), _bench(spark, d), 12)


_PAL = f"SELECT seq1, pos1, seq2, (length(seq) - pos2 - len)::BIGINT AS pos2, len FROM ({_mem('dna', 'dnarc', 10)}) JOIN ({_SEQ['dna']}) ON seqnum = seq2"


@_query("palindromic_mem", _PAL)
def _(spark, d):
    return matches.palindromic_query_matches(_dna(spark, d), _dna(spark, d), 10)


@_query("palindromic_self", f"SELECT * FROM ({_PAL}) WHERE (seq1, pos1) <= (seq2, pos2)")
def _(spark, d):
    return matches.palindromic_self_matches(_dna(spark, d), 10)


@_query("all_strands", f"SELECT *, 'D' AS mode FROM ({_mem('dna', 'dna', 18)}) UNION ALL SELECT *, 'P' AS mode FROM ({_PAL}) WHERE len >= 18")
def _(spark, d):
    return matches.all_strands(_dna(spark, d), _dna(spark, d), 18)


# --- whole patterns ---------------------------------------------------------------------------------------------------


# patterns, all of more than 80 characters; a place where one of k + 1 pieces stands is found by the piece's first 16
_PATTERNS = {
    "whole": f"SELECT seqnum AS seq2, seq AS pat FROM ({_SEQ['bench']})",
    "spoilt": f"SELECT seqnum AS seq2, substr(seq, 1, 19) || '~' || substr(seq, 21, 19) || '~' || substr(seq, 41, 19) || '~' || substr(seq, 61) AS pat FROM ({_SEQ['bench']})",
    "edited": f"SELECT seqnum AS seq2, substr(seq, 1, 29) || substr(seq, 31, 30) || '~' || substr(seq, 61) AS pat FROM ({_SEQ['bench']})",
}


def _near_sql(name: str, k: str) -> str:
    """Rows (seq1, seq2, pat, k, start): where a pattern would start if a piece of it is right."""
    pieces = f"SELECT seq2, pat, k, (i * length(pat)) // (k + 1) AS off FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM (SELECT *, {k} AS k FROM ({_PATTERNS[name]})))"
    return f"SELECT DISTINCT p.seqnum AS seq1, seq2, pat, k, pos - off AS start FROM ({_post('docs', 16)}) p JOIN ({pieces}) ON km = substr(pat, (off + 1)::INT, 16)"


@_query("complete_exact", f"SELECT seq1, start AS pos1, length(pat)::BIGINT AS len1, seq2, 0::BIGINT AS distance FROM ({_near_sql('whole', '0')}) JOIN ({_SEQ['docs']}) ON seqnum = seq1 WHERE substr(seq, (start + 1)::INT, length(pat)::INT) = pat")
def _(spark, d):
    return complete.exact(_docs(spark, d), _bench(spark, d))


def _hamming_sql(k: str) -> str:
    off = "CASE WHEN strlen(w) = strlen(pat) THEN hamming(w, pat) ELSE list_sum([CASE WHEN substr(w, i, 1) <> substr(pat, i, 1) THEN 1 ELSE 0 END FOR i IN range(1, length(pat) + 1)]) END"
    window = f"SELECT n.*, substr(seq, (start + 1)::INT, length(pat)::INT) AS w FROM ({_near_sql('spoilt', k)}) n JOIN ({_SEQ['docs']}) ON seqnum = seq1 WHERE start >= 0 AND start + length(pat) <= length(seq)"
    return f"SELECT seq1, start AS pos1, length(pat)::BIGINT AS len1, seq2, (-off)::BIGINT AS distance FROM (SELECT *, {off} AS off FROM ({window})) WHERE off <= k"


@_query("complete_hamming", _hamming_sql("4"))
def _(spark, d):
    return complete.hamming(_docs(spark, d), _spoilt(_bench(spark, d)), 4)


@_query("complete_hamming_percent", _hamming_sql("length(pat) * 3 // 100"))
def _(spark, d):
    return complete.hamming(_docs(spark, d), _spoilt(_bench(spark, d)), 3, percent=True)


@_query("complete_hamming_best", f"SELECT * FROM ({_hamming_sql('length(pat) * 4 // 100')}) QUALIFY distance = max(distance) OVER (PARTITION BY seq2)")
def _(spark, d):
    return complete.hamming(_docs(spark, d), _spoilt(_bench(spark, d)), 4, percent=True, best=True)


_EDIT = f"""WITH n AS MATERIALIZED (SELECT DISTINCT seq1, seq2, pat, k, start + o AS start FROM (SELECT *, unnest(range(-k, k + 1)) AS o FROM ({_near_sql('edited', '3')})) WHERE start + o >= 0),
    e AS (SELECT n.*, e, levenshtein(regexp_replace(substr(seq, (start + 1)::INT, e::INT), '[^ -~\\s]', chr(1), 'g'), regexp_replace(pat, '[^ -~\\s]', chr(1), 'g')) AS d FROM (SELECT *, unnest(range(length(pat) - k, length(pat) + k + 1)) AS e FROM n) n JOIN ({_SEQ['docs']}) ON seqnum = seq1 WHERE start + e <= length(seq)),
    found AS (SELECT seq1, start AS pos1, e::BIGINT AS len1, seq2, d::BIGINT AS distance FROM e WHERE d <= k QUALIFY row_number() OVER (PARTITION BY seq1, seq2, start ORDER BY d, e DESC) = 1)"""


@_query("complete_edit", f"{_EDIT} SELECT * FROM found")
def _(spark, d):
    return complete.edit(_docs(spark, d), _edited(_bench(spark, d)), 3)


@_query("complete_edit_remred", f"{_EDIT} SELECT seq1, pos1, len1, seq2, distance FROM (SELECT *, pos1 - row_number() OVER (PARTITION BY seq1, seq2 ORDER BY pos1) AS run FROM found) QUALIFY row_number() OVER (PARTITION BY seq1, seq2, run ORDER BY distance, pos1 DESC) = 1")
def _(spark, d):
    return complete.without_redundant(complete.edit(_docs(spark, d), _edited(_bench(spark, d)), 3))


@_query("complete_palindromic", f"SELECT x.seqnum AS seq1, p AS pos1, length(y.seq)::BIGINT AS len1, y.seqnum AS seq2, 0::BIGINT AS distance FROM (SELECT seqnum, seq, unnest(range(0, length(seq) - 7)) AS p FROM ({_SEQ['dna']})) x JOIN (SELECT seqnum, substr(seq, 1, 8) AS seq FROM ({_SEQ['dnarc']})) y ON substr(x.seq, (p + 1)::INT, 8) = y.seq")
def _(spark, d):
    # patterns are the last eight bases, so that some occur
    return complete.palindromic(complete.exact, _dna(spark, d), _dna(spark, d).withColumn("seq", F.right("seq", F.lit(8))))


@_query("complete_regexp", f"SELECT seq1, pos1, length(t)::BIGINT AS len1, 0::BIGINT AS seq2, 0::BIGINT AS distance FROM (SELECT seqnum AS seq1, pos AS pos1, regexp_extract(substr(seq, (pos + 1)::INT), '^(?:gatt?[ac]{{2,}}g)') AS t FROM (SELECT seqnum, seq, unnest(range(0, length(seq))) AS pos FROM ({_SEQ['dna']}))) WHERE t <> ''")
def _(spark, d):
    return complete.regular_expressions(_dna(spark, d), spark.range(1).select(F.col("id").cast("long").alias("seqnum"), F.lit("gatt?[ac]{2,}g").alias("seq")))


# --- scores, filters, orders --------------------------------------------------------------------------------------------

_N = f"(SELECT (sum(length(seq) + 1) - 1)::DOUBLE FROM ({_SEQ['conv']}))"
_SCORED = f"SELECT m.*, 2 * len AS score, 100.0::DOUBLE AS identity, round((len * ln(1.0 / 26) + 2 * ln(1 - 1.0 / 26) + ln(0.5 * {_N} * {_N})) / ln(10), 6) AS log10_evalue FROM ({_selfm('conv', 30)}) m"


def _scored(spark, d) -> DataFrame:
    conv = _conv(spark, d)
    n = conv.agg((F.sum(F.col("len") + 1) - 1).cast("double").alias("__n"))
    found = filters.exact_columns(matches.self_matches(conv, 30)).crossJoin(F.broadcast(n))
    return filters.score_columns(found, scores.multiplier_self(F.col("__n")), 26)


@_query("match_score_identity_evalue", _SCORED)
def _(spark, d):
    rows = _scored(spark, d)
    log = scores.log_evalue(F.col("len"), F.lit(0).cast("long"), scores.multiplier_self(F.col("__n")), 26)
    return rows.select("seq1", "pos1", "seq2", "pos2", "len", "score", "identity", F.round(log / F.log(F.lit(10.0)), 6).alias("log10_evalue"))


@_query("match_filter_evalue", f"SELECT seq1, pos1, seq2, pos2, len FROM ({_SCORED}) WHERE log10_evalue <= -40")
def _(spark, d):
    return filters.keep(_scored(spark, d), evalue=1e-40).select("seq1", "pos1", "seq2", "pos2", "len")


@_query("match_filter_score", f"SELECT seq1, pos1, seq2, pos2, len FROM ({_SCORED}) WHERE score >= 80 AND identity >= 95")
def _(spark, d):
    return filters.keep(_scored(spark, d), score=80, identity=95, length=35).select("seq1", "pos1", "seq2", "pos2", "len")


@_query("best_k_matches", f"SELECT seq1, pos1, seq2, pos2, len FROM ({_SCORED}) ORDER BY len DESC, seq1, pos1, seq2, pos2 LIMIT 50")
def _(spark, d):
    return filters.best(_scored(spark, d), 50).select("seq1", "pos1", "seq2", "pos2", "len")


@_query("sorted_matches", f"SELECT seq1, pos1, seq2, pos2, len FROM ({_SCORED}) ORDER BY len DESC, seq1, pos1, seq2, pos2")
def _(spark, d):
    return filters.ordered(_scored(spark, d), "ld").select("seq1", "pos1", "seq2", "pos2", "len")


_FOUND = f"SELECT seq1, pos1, len AS len1, seq2, pos2, len AS len2 FROM ({_mem('conv', 'bench', 8)})"


@_query(
    "remove_contained",
    f"WITH m AS MATERIALIZED ({_FOUND}) SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.seq1 = b.seq1 AND a.seq2 = b.seq2 AND b.pos1 <= a.pos1 AND b.pos1 + b.len1 >= a.pos1 + a.len1 AND b.pos2 <= a.pos2 AND b.pos2 + b.len2 >= a.pos2 + a.len2 AND (a.pos1, a.len1, a.pos2, a.len2) <> (b.pos1, b.len1, b.pos2, b.len2))",
)
def _(spark, d):
    found = filters.exact_columns(matches.query_matches(_conv(spark, d), _bench(spark, d), 8))
    return filters.without_contained(found.select("seq1", "pos1", "len1", "seq2", "pos2", "len2"))


# --- intervals ------------------------------------------------------------------------------------------------------------

_MARK = f"SELECT seq1 AS seqnum, pos1 AS s, pos1 + len AS e FROM ({_mem('conv', 'bench', 12)})"
_MERGED = f"""SELECT seqnum, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY seqnum ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, max(e) OVER (PARTITION BY seqnum ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT * FROM ({{marks}})))) GROUP BY seqnum, run"""


def _marks(spark, d, side: str = "left") -> DataFrame:
    return intervals.marked(matches.query_matches(_conv(spark, d), _bench(spark, d), 12), side)


@_query("merge_regions", _MERGED.format(marks=_MARK))
def _(spark, d):
    return intervals.merged(_marks(spark, d))


def _gaps_sql(name: str, marks: str, least: int) -> str:
    return f"""WITH m AS ({_MERGED.format(marks=marks)}), x AS (SELECT seqnum, start, "end" AS e FROM m UNION ALL SELECT seqnum, length(seq), length(seq) FROM ({_SEQ[name]})),
    y AS (SELECT seqnum, coalesce(lag(e) OVER (PARTITION BY seqnum ORDER BY start, e), 0) AS a, start AS b FROM x)
    SELECT seqnum, a::BIGINT AS start, (b - a)::BIGINT AS len FROM y WHERE b - a >= {least}"""


@_query("dbnomatch", _gaps_sql("conv", _MARK, 30))
def _(spark, d):
    return intervals.unmatched(_conv(spark, d), _marks(spark, d), 30)


@_query("qnomatch", _gaps_sql("bench", f"SELECT seq2 AS seqnum, pos2 AS s, pos2 + len AS e FROM ({_mem('conv', 'bench', 12)})", 10))
def _(spark, d):
    return intervals.unmatched(_bench(spark, d), _marks(spark, d, "right"), 10)


_COVER = f"SELECT seqnum, unnest(range(s, e)) AS p FROM ({_MARK})"


@_query("mask_coverage", f"SELECT seqnum, length(seq)::BIGINT AS len, coalesce(n, 0)::BIGINT AS masked FROM ({_SEQ['conv']}) LEFT JOIN (SELECT seqnum, count(DISTINCT p) AS n FROM ({_COVER}) GROUP BY seqnum) USING (seqnum)")
def _(spark, d):
    conv = _conv(spark, d)
    return intervals.masked(conv, _marks(spark, d)).select("seqnum", F.length("seq").cast("long").alias("len"), "masked")


@_query("mask_text", f"WITH c AS (SELECT DISTINCT * FROM ({_COVER})), ch AS (SELECT seqnum, substr(seq, (p + 1)::INT, 1) AS c, p FROM (SELECT seqnum, seq, unnest(range(0, length(seq))) AS p FROM ({_SEQ['conv']}))) SELECT seqnum, md5(string_agg(CASE WHEN c.p IS NULL THEN ch.c ELSE 'X' END, '' ORDER BY ch.p)) AS digest FROM ch LEFT JOIN c ON ch.seqnum = c.seqnum AND ch.p = c.p GROUP BY ch.seqnum".replace("SELECT seqnum, md5", "SELECT ch.seqnum AS seqnum, md5"))
def _(spark, d):
    return intervals.masked(_conv(spark, d).where("len > 0"), _marks(spark, d)).select("seqnum", F.md5("seq").alias("digest"))


# --- clusters ---------------------------------------------------------------------------------------------------------------

_EDGES = f"""SELECT DISTINCT least(seq1, seq2) AS a, greatest(seq1, seq2) AS b FROM ({_selfm('conv', 40)}) m JOIN ({_SEQ['conv']}) x ON x.seqnum = seq1 JOIN ({_SEQ['conv']}) y ON y.seqnum = seq2
    WHERE seq1 <> seq2 AND len >= floor(least(length(x.seq), length(y.seq)) * 30 / 100) AND len >= floor(greatest(length(x.seq), length(y.seq)) * 10 / 100)"""
_CLUSTERS = f"WITH RECURSIVE {_components(_EDGES)}, cl AS (SELECT seqnum, length(seq)::BIGINT AS len, coalesce(cluster, seqnum) AS cluster FROM ({_SEQ['conv']}) LEFT JOIN cc ON elem = seqnum)"


def _clusters(spark, d) -> DataFrame:
    conv = _conv(spark, d)
    return cluster.sequence_clusters(filters.exact_columns(matches.self_matches(conv, 40)), conv, 30, 10)


@_query("seq_cluster", f"{_CLUSTERS} SELECT seqnum, cluster FROM cl")
def _(spark, d):
    return _clusters(spark, d)


@_query("nonredundant", f"{_CLUSTERS} SELECT seqnum, cluster, len FROM cl QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY len DESC, seqnum) = 1")
def _(spark, d):
    return cluster.non_redundant(_clusters(spark, d), _conv(spark, d))


@_query("cluster_size_distribution", f"{_CLUSTERS} SELECT size, count(*) AS clusters FROM (SELECT cluster, count(*) AS size FROM cl GROUP BY cluster) GROUP BY size")
def _(spark, d):
    return cluster.size_distribution(_clusters(spark, d))


_NUMBERED = f"SELECT row_number() OVER (ORDER BY seq1, pos1, seq2, pos2) AS match_id, seq1, pos1, len AS len1, seq2, pos2, len AS len2 FROM ({_selfm('bench', 9)})"
_INSTANCES = "inst AS MATERIALIZED (SELECT match_id, seq1 AS s, pos1 AS a, pos1 + len1 AS b FROM m UNION ALL SELECT match_id, seq2, pos2, pos2 + len2 FROM m)"


def _numbered(spark, d) -> DataFrame:
    found = filters.exact_columns(matches.self_matches(_bench(spark, d), 9))
    return found.withColumn("match_id", F.row_number().over(Window.orderBy("seq1", "pos1", "seq2", "pos2")).cast("long"))


def _match_clusters_sql(linked: str) -> str:
    edges = f"SELECT DISTINCT x.match_id AS a, y.match_id AS b FROM inst x JOIN inst y ON x.match_id < y.match_id AND {linked}"
    return f"WITH RECURSIVE m AS MATERIALIZED ({_NUMBERED}), {_INSTANCES}, {_components(edges)} SELECT match_id, coalesce(cluster, match_id) AS cluster FROM m LEFT JOIN cc ON elem = match_id"


@_query("matchcluster_gap", _match_clusters_sql("x.s = y.s AND greatest(x.a, y.a) - least(x.b, y.b) <= 10"))
def _(spark, d):
    return cluster.clusters_by_gap(_numbered(spark, d), 10)


@_query("matchcluster_overlap", _match_clusters_sql("x.s = y.s AND least(x.b, y.b) > greatest(x.a, y.a) AND 100 * (least(x.b, y.b) - greatest(x.a, y.a)) >= 60 * greatest(x.b - x.a, y.b - y.a)"))
def _(spark, d):
    return cluster.clusters_by_overlap(_numbered(spark, d), 60)


@_query(
    "matchcluster_similarity",
    f"""WITH RECURSIVE m AS MATERIALIZED ({_NUMBERED}), inst AS MATERIALIZED (SELECT match_id, n, l, substr(seq, (p + 1)::INT, n::INT) AS t FROM (SELECT match_id, seq1 AS s, pos1 AS p, len1 AS n, least(len1, len2) AS l FROM m UNION ALL SELECT match_id, seq2, pos2, len2, least(len1, len2) FROM m) JOIN ({_SEQ['bench']}) ON seqnum = s),
    {_components("SELECT DISTINCT x.match_id AS a, y.match_id AS b FROM inst x JOIN inst y ON x.match_id < y.match_id AND abs(x.n - y.n) <= floor(least(x.l, y.l) * 10 / 100) AND levenshtein(x.t, y.t) <= floor(least(x.l, y.l) * 10 / 100)")}
    SELECT match_id, coalesce(cluster, match_id) AS cluster FROM m LEFT JOIN cc ON elem = match_id""",
)
def _(spark, d):
    return cluster.clusters_by_similarity(_numbered(spark, d), _bench(spark, d), 10)


# --- user functions of matches ------------------------------------------------------------------------------------------------

_CB = _mem("conv", "bench", 12)


@_query("rightmost_match", f"SELECT seq1, pos1, seq2, pos2, len FROM ({_CB}) QUALIFY row_number() OVER (PARTITION BY seq1 ORDER BY pos1 DESC, seq2, pos2, len DESC) = 1")
def _(spark, d):
    return select.rightmost(matches.query_matches(_conv(spark, d), _bench(spark, d), 12))


@_query("dbseq_multi_query", f"SELECT seq1, count(DISTINCT seq2) AS queries FROM ({_CB}) GROUP BY seq1 HAVING count(DISTINCT seq2) >= 2")
def _(spark, d):
    return select.hit_by_several(matches.query_matches(_conv(spark, d), _bench(spark, d), 12))


_SHARE = " * ".join(f"((length(w) - length(replace(w, '{c}', '')))::DOUBLE / length(w))" for c in "acgt")


@_query("lowcomplex_filter", f"SELECT seq1, pos1, seq2, pos2, len FROM (SELECT m.*, substr(seq, (pos1 + 1)::INT, len::INT) AS w FROM ({_selfm('dna', 10)}) m JOIN ({_SEQ['dna']}) ON seqnum = seq1) WHERE {_SHARE} >= 0.002")
def _(spark, d):
    dna = _dna(spark, d)
    found = matches.match_text(matches.self_matches(dna, 10), dna)
    return found.where(scores.low_complexity(F.col("text")) >= 0.002).drop("text")


@_query("mass_search", "WITH i AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line FROM lineitem), s AS (SELECT *, sum(q) OVER (PARTITION BY l_orderkey ORDER BY line) AS c FROM i) SELECT a.l_orderkey, a.line AS first, b.line AS last FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND b.c - a.c + a.q = 60 AND b.line >= a.line")
def _(spark, d):
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    return mass.mass_search(_read(spark, d, "lineitem").withColumn("line", line), "l_orderkey", "line", "l_quantity", 60)


@_query(
    "multi_exact",
    f"""WITH p AS MATERIALIZED (SELECT seqnum % 3 AS g, seqnum, pos, km FROM ({_post('docs', 24)})), k AS (SELECT g, km FROM p GROUP BY g, km HAVING count(*) <= 2), r AS MATERIALIZED (SELECT p.* FROM p JOIN k USING (g, km)),
    t AS (SELECT [a.seqnum, b.seqnum, c.seqnum] AS seqs, a.pos AS p, [b.pos - a.pos, c.pos - a.pos] AS diag FROM r a JOIN r b ON a.km = b.km JOIN r c ON a.km = c.km WHERE a.g = 0 AND b.g = 1 AND c.g = 2),
    f AS (SELECT seqs, diag, min(p) AS p0, count(*) + 23 AS len FROM (SELECT *, p - row_number() OVER (PARTITION BY seqs, diag ORDER BY p) AS run FROM t) GROUP BY seqs, diag, run)
    SELECT array_to_string(seqs, ' ') AS seqs, p0 || ' ' || (p0 + diag[1]) || ' ' || (p0 + diag[2]) AS starts, len FROM f""",
)
def _(spark, d):
    found = matches.multi_matches(_docs(spark, d).withColumn("genome", F.col("seqnum") % 3), 24, 2)
    words = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return found.select(words("seqs"), words("starts"), "len")


def _cb(spark, d) -> DataFrame:
    return filters.exact_columns(matches.query_matches(_conv(spark, d), _bench(spark, d), 12)).select("seq1", "pos1", "len1", "seq2", "pos2", "len2")


_CB6 = f"SELECT seq1, pos1, len AS len1, seq2, pos2, len AS len2 FROM ({_CB})"
_CBS = f"SELECT m.*, x.seq AS s1, y.seq AS s2 FROM ({_CB6}) m JOIN ({_SEQ['conv']}) x ON x.seqnum = seq1 JOIN ({_SEQ['bench']}) y ON y.seqnum = seq2"
_SIX = "seq1, pos1, len1, seq2, pos2, len2"
_CB8 = f"SELECT seq1, pos1, len AS len1, seq2, pos2, len AS len2 FROM ({_mem('conv', 'bench', 8)})"


@_query("user_at_most", f"SELECT * FROM ({_CB6}) WHERE len1 <= 20")
def _(spark, d):
    return userfunctions.at_most(_cb(spark, d), 20)


_DD = _mem("dna", "dna", 5)
_DDS = f"SELECT seq1, pos1, len AS len1, seq2, pos2, len AS len2, x.seq AS s1, y.seq AS s2 FROM ({_DD}) m JOIN ({_SEQ['dna']}) x ON x.seqnum = seq1 JOIN ({_SEQ['dna']}) y ON y.seqnum = seq2"


def _dd(spark, d) -> DataFrame:
    dna = _dna(spark, d)
    return filters.exact_columns(matches.query_matches(dna, dna, 5)).select("seq1", "pos1", "len1", "seq2", "pos2", "len2")


@_query("user_touching_an_end", f"SELECT {_SIX} FROM ({_DDS}) WHERE pos1 = 0 OR pos1 + len1 = length(s1)")
def _(spark, d):
    return userfunctions.touching_an_end(_dd(spark, d), _dna(spark, d))


@_query("user_ending_at_the_end", f"SELECT {_SIX} FROM ({_DDS}) WHERE pos1 + len1 = length(s1)")
def _(spark, d):
    return userfunctions.ending_at_the_end(_dd(spark, d), _dna(spark, d))


@_query("user_tag_ends", f"SELECT {_SIX} FROM ({_DDS}) WHERE len1 >= 5 AND pos1 + len1 = length(s1) AND substr(s2, (pos2 + len2 + 1)::INT, 2) IN ('gc', 'gt')")
def _(spark, d):
    return userfunctions.tag_ends(_dd(spark, d), _dna(spark, d), _dna(spark, d), 5)


@_query("user_length_and_places", f"SELECT len1 AS len, pos1, pos2 FROM ({_DDS})")
def _(spark, d):
    return userfunctions.length_and_places(_dd(spark, d))


@_query("user_none_selected", f"SELECT {_SIX} FROM ({_CB6}) WHERE false")
def _(spark, d):
    return userfunctions.none(_cb(spark, d))


@_query("matches_not_in", f"SELECT {_SIX} FROM ({_DDS}) EXCEPT ALL SELECT {_SIX} FROM ({_DDS}) WHERE len1 >= 7")
def _(spark, d):
    found = _dd(spark, d)
    return userfunctions.not_in(found, found.where("len1 >= 7"))


@_query("user_end_to_end", f"SELECT {_SIX} FROM ({_CBS}) WHERE NOT ((pos1 > 60 AND pos2 > 60) OR (length(s1) - pos1 - len1 > 60 AND length(s2) - pos2 - len2 > 60))")
def _(spark, d):
    return userfunctions.end_to_end(_cb(spark, d), _conv(spark, d), _bench(spark, d), 60)


@_query("user_starting_and_ending", f"SELECT {_SIX} FROM ({_DDS}) WHERE substr(s1, pos1::INT + 1, 2) = 'ac' AND substr(s1, (pos1 + len1)::INT - 1, 2) = 'gt' AND len1 >= 4")
def _(spark, d):
    return userfunctions.starting_and_ending(_dd(spark, d), _dna(spark, d))


@_query("user_between_sites", f"SELECT {_SIX} FROM ({_DDS}) WHERE pos2 >= 2 AND substr(s2, pos2::INT - 1, 2) = 'ag' AND substr(s2, (pos2 + len2)::INT + 1, 2) = 'gt'")
def _(spark, d):
    return userfunctions.between_sites(_dd(spark, d), _dna(spark, d))


@_query("user_after_symbol", f"SELECT {_SIX} FROM ({_DDS}) WHERE substr(s1, pos1::INT + 1, 1) = 'a'")
def _(spark, d):
    return userfunctions.after_symbol(_dd(spark, d), _dna(spark, d), "a")


@_query("user_context", f"SELECT seq1, pos1 AS start, substr(s1, pos1::INT + 1, 17) AS text FROM ({_CBS}) WHERE pos1 + 17 <= length(s1) AND NOT contains(substr(s1, pos1::INT + 1, 17), '#')")
def _(spark, d):
    return userfunctions.context_windows(_cb(spark, d), _conv(spark, d))


@_query("user_shorter", f"SELECT {_SIX} FROM ({_CBS}) WHERE len2 < length(s1)")
def _(spark, d):
    return userfunctions.shorter_than_sequence(_cb(spark, d), _conv(spark, d))


@_query("user_qgrams", f"SELECT seq1, pos1 + o AS pos1, seq2, pos2 + o AS pos2 FROM (SELECT *, unnest(range(0, len1 - 8 + 1)) AS o FROM ({_CB6}))")
def _(spark, d):
    return userfunctions.qgram_places(_cb(spark, d), 8)


@_query("user_query_qgrams", f"SELECT seq2, pos2 + o AS pos2 FROM (SELECT *, unnest(range(0, len2 - 8 + 1)) AS o FROM ({_CB6}))")
def _(spark, d):
    return userfunctions.query_qgrams(_cb(spark, d), 8)


@_query("user_by_sequence", f"SELECT seq1 AS seqnum, seq2 AS other, len, pos1 AS start, pos2 AS other_start FROM ({_selfm('conv', 40)}) WHERE seq1 <> seq2 UNION ALL SELECT seq2, seq1, len, pos2, pos1 FROM ({_selfm('conv', 40)}) WHERE seq1 <> seq2")
def _(spark, d):
    return userfunctions.by_sequence(filters.exact_columns(matches.self_matches(_conv(spark, d), 40)))


@_query("user_fasta", f"SELECT '>' || seq1 || ' ' || pos1 || ' ' || len1 || chr(10) || substr(s1, pos1::INT + 1, len1::INT) AS value FROM ({_CBS}) UNION ALL SELECT '>' || seq2 || ' ' || pos2 || ' ' || len2 || chr(10) || substr(s2, pos2::INT + 1, len2::INT) FROM ({_CBS})")
def _(spark, d):
    return userfunctions.as_fasta(_cb(spark, d), _conv(spark, d), _bench(spark, d))


_M_OVER = "least(x.pos{i} + x.len{i}, y.pos{i} + y.len{i}) - greatest(x.pos{i}, y.pos{i})"
_M_EDGES = f"SELECT x.id AS a, y.id AS b FROM m x JOIN m y ON x.seq1 = y.seq1 AND x.seq2 = y.seq2 AND x.id < y.id AND {_M_OVER.format(i=1)} + {_M_OVER.format(i=2)} >= least(x.len1 + x.len2, y.len1 + y.len2) * 20 / 100"


@_query(
    "user_merged",
    f"""WITH RECURSIVE m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq1, seq2, pos1, pos2, len1) AS id FROM ({_CB8})), {_components(_M_EDGES)}, g AS (SELECT m.*, coalesce(cluster, id) AS c FROM m LEFT JOIN cc ON elem = id)
    SELECT min(seq1) AS seq1, min(pos1) AS pos1, max(pos1 + len1) - min(pos1) AS len1, min(seq2) AS seq2, min(pos2) AS pos2, max(pos2 + len2) - min(pos2) AS len2 FROM g GROUP BY c""",
)
def _(spark, d):
    found = filters.exact_columns(matches.query_matches(_conv(spark, d), _bench(spark, d), 8))
    return userfunctions.merged_matches(found, 20)


def _prefix_sql(least: int, most: int) -> str:
    ks = range(least - 1, most + 1)
    counts = ", ".join(f"c{k} AS (SELECT seqnum, pos, n FROM ({_post('bench', k)}) p JOIN (SELECT km, count(*) AS n FROM ({_post('conv', k)}) GROUP BY km) USING (km))" for k in ks)
    found = " UNION ALL ".join(f"SELECT seqnum, pos, {k} AS k FROM c{k} WHERE n = 1" for k in ks if k >= least)
    return f"WITH {counts} SELECT seqnum, pos, min(k)::BIGINT AS length FROM ({found}) JOIN (SELECT seqnum, pos FROM c{least - 1} WHERE n > 1) USING (seqnum, pos) GROUP BY seqnum, pos"


@_query("minimum_unique_prefix", _prefix_sql(6, 11))
def _(spark, d):
    return unique.minimum_unique_prefixes(_conv(spark, d), _bench(spark, d), 6, 11)


_PROFILE = [{"a": 2.0, "c": -1.0, "g": 0.5, "t": -2.0}, {"a": -1.0, "c": 3.0, "g": 0.0, "t": 1.0}, {"a": 0.0, "c": 0.0, "g": 2.5, "t": -1.0}, {"a": 1.5, "c": -0.5, "g": -0.5, "t": 1.0}]
_PROFILE_SQL = " + ".join(f"CASE substr(km, {i + 1}, 1) " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in col.items()) + " END" for i, col in enumerate(_PROFILE))


@_query("profile_search", f"SELECT seqnum, pos, CAST({_PROFILE_SQL} AS DOUBLE) AS score FROM ({_post('dna', 4)}) WHERE {_PROFILE_SQL} >= 6")
def _(spark, d):
    return unique.profile_search(_dna(spark, d), _PROFILE, 6)


# --- translated matches, chains, extensions: no SQL, tested against brute force ---------------------------------------------------


_CODON = f"substr('{alphabet.CODES[1]}', 16 * (instr('tcag', substr(c, 1, 1)) - 1) + 4 * (instr('tcag', substr(c, 2, 1)) - 1) + instr('tcag', substr(c, 3, 1)), 1)"
_SEQ["frames"] = f"""SELECT seqnum, f AS frame, n AS dna_len, array_to_string([{_CODON} FOR c IN [substr(s, (3 * i + f % 3 + 1)::INT, 3) FOR i IN range(0, (n - f % 3) // 3)]], '') AS seq
    FROM (SELECT seqnum, f, length(seq) AS n, CASE WHEN f < 3 THEN seq ELSE reverse(translate(seq, 'acgt', 'tgca')) END AS s FROM (SELECT *, unnest(range(0, 6)) AS f FROM ({_SEQ['dna']})))"""
_SEQ["six"] = f"SELECT seqnum * 6 + frame AS seqnum, seq FROM ({_SEQ['frames']})"
_SEQ["sixplain"] = f"SELECT seqnum * 6 + frame AS seqnum, translate(seq, '*', '#') AS seq FROM ({_SEQ['frames']})"
_SEQ["proteins"] = f"SELECT seqnum, translate(seq, '*', '#') AS seq FROM ({_SEQ['frames']}) WHERE frame = 1"


def _to_dna(frame: str, pos: str, n: str) -> str:
    return f"CASE WHEN {frame} < 3 THEN {pos} * 3 + {frame} ELSE {n} - ({pos} + len) * 3 - ({frame} - 3) END"


@_query("six_frames", f"SELECT seqnum, frame::INT AS frame, dna_len::BIGINT AS dna_len, seq FROM ({_SEQ['frames']})")
def _(spark, d):
    return alphabet.six_frames(_dna(spark, d))


@_query("protein_query", f"SELECT seq1, pos1, (seq2 // 6)::BIGINT AS seq2, (seq2 % 6)::INT AS frame, ({_to_dna('(seq2 % 6)', 'pos2', 'length(seq)')})::BIGINT AS pos2, len, len * 3 AS dna_len FROM ({_mem('proteins', 'sixplain', 4)}) JOIN ({_SEQ['dna']}) ON seqnum = seq2 // 6")
def _(spark, d):
    proteins = alphabet.six_frames(_dna(spark, d)).where("frame = 1").select("seqnum", "seq")
    return matches.protein_query_matches(proteins, _dna(spark, d), 4)


@_query("sixframe_match", f"SELECT (seq1 // 6)::BIGINT AS seq1, ({_to_dna('(seq1 % 6)', 'pos1', 'length(x.seq)')})::BIGINT AS pos1, (seq2 // 6)::BIGINT AS seq2, ({_to_dna('(seq2 % 6)', 'pos2', 'length(y.seq)')})::BIGINT AS pos2, len * 3 AS len, seq1 % 6 AS frame1, seq2 % 6 AS frame2 FROM ({_selfm('six', 4)}) JOIN ({_SEQ['dna']}) x ON x.seqnum = seq1 // 6 JOIN ({_SEQ['dna']}) y ON y.seqnum = seq2 // 6")
def _(spark, d):
    six = alphabet.six_frames(_dna(spark, d))
    prot = six.withColumn("seqnum", F.col("seqnum") * 6 + F.col("frame")).select("seqnum", "seq", "dna_len")
    found = matches.self_matches(prot, 4)
    out = found
    for i in (1, 2):
        own = six.select((F.col("seqnum") * 6 + F.col("frame")).alias(f"seq{i}"), F.col("dna_len").alias(f"__n{i}"))
        out = out.join(own, f"seq{i}")
    place = lambda i: alphabet.frame_to_dna(F.col(f"seq{i}") % 6, F.col(f"pos{i}"), F.col("len"), F.col(f"__n{i}"))
    return out.select(F.floor(F.col("seq1") / 6).alias("seq1"), place(1).alias("pos1"), F.floor(F.col("seq2") / 6).alias("seq2"), place(2).alias("pos2"), (F.col("len") * 3).alias("len"), (F.col("seq1") % 6).alias("frame1"), (F.col("seq2") % 6).alias("frame2"))


def _fragments(spark, d) -> DataFrame:
    return matches.query_matches(_conv(spark, d), _bench(spark, d), 8).select("seq1", "seq2", F.col("pos1").alias("start1"), (F.col("pos1") + F.col("len") - 1).alias("end1"), F.col("pos2").alias("start2"), (F.col("pos2") + F.col("len") - 1).alias("end2"), F.col("len").cast("double").alias("weight"))


def _chain_query(name: str, mode: chain.ChainMode) -> None:
    _query(name)(lambda spark, d: chain.chains(_fragments(spark, d), ["seq1", "seq2"], mode))


_chain_query("chain_global", chain.ChainMode("global"))
_chain_query("chain_global_gc", chain.ChainMode("gap_cost"))
_chain_query("chain_global_ov", chain.ChainMode("overlaps"))
_chain_query("chain_local", chain.ChainMode("local", ("percent", 20)))


def _seeds(spark, d) -> tuple[DataFrame, DataFrame]:
    dna = _dna(spark, d)
    return matches.self_matches(dna, 8), dna


# seeds with the mismatches left of them and right of them, as distances from the seed; the sequences' end comes last
_SEEDS = f"""seeds AS MATERIALIZED (SELECT m.*, x.seq AS s1, y.seq AS s2, least(pos1, pos2) AS nl, least(length(x.seq) - pos1 - len, length(y.seq) - pos2 - len) AS nr
    FROM ({_selfm('dna', 8)}) m JOIN ({_SEQ['dna']}) x ON x.seqnum = seq1 JOIN ({_SEQ['dna']}) y ON y.seqnum = seq2)"""
_STEPS = f"""WITH {_SEEDS}, off AS (SELECT *, list_append([i FOR i IN range(0, nl) IF substr(s1, (pos1 - i)::INT, 1) <> substr(s2, (pos2 - i)::INT, 1)], nl)[1:3] AS l0,
    list_append([i FOR i IN range(0, nr) IF substr(s1, (pos1 + len + i + 1)::INT, 1) <> substr(s2, (pos2 + len + i + 1)::INT, 1)], nr)[1:3] AS r FROM seeds),
    steps AS (SELECT *, CASE WHEN len(l0) >= 2 AND l0[2] - l0[1] > 8 THEN l0[1:1] WHEN len(l0) >= 3 AND l0[3] - l0[2] > 8 THEN l0[1:2] ELSE l0 END AS l FROM off),
    ways AS (SELECT *, i + j AS d, l[i + 1] AS left_, l[i + 1] + len + r[j + 1] AS n FROM (SELECT *, unnest(range(0, len(r))) AS j FROM (SELECT *, unnest(range(0, len(l))) AS i FROM steps)) WHERE i + j <= 2 AND l[i + 1] + len + r[j + 1] >= 15)"""
_WAY = "seq1, (pos1 - left_)::BIGINT AS pos1, n::BIGINT AS len1, seq2, (pos2 - left_)::BIGINT AS pos2, n::BIGINT AS len2, (-d)::BIGINT AS distance"
_LOG_E = "lgamma(n + 1) - lgamma(d + 1) - lgamma(n - d + 1) + (n - d) * ln(0.25) + (d + 2) * ln(0.75)"


@_query("extend_hamming", f"{_STEPS} SELECT DISTINCT {_WAY}, (CASE WHEN d = 0 THEN 2 * n ELSE 3 * d - 2 * n END)::BIGINT AS score FROM (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY seq1, pos1, seq2, pos2, len ORDER BY {_LOG_E}, d / n, n DESC, i DESC) = 1)")
def _(spark, d):
    seeds, dna = _seeds(spark, d)
    return extend.extend_hamming(seeds, dna, dna, 15, 2, seed=8)


_WAYTEXT = f"SELECT DISTINCT {_WAY}, substr(s1, (pos1 - left_ + 1)::INT, n::INT) AS t1, substr(s2, (pos2 - left_ + 1)::INT, n::INT) AS t2 FROM ways"


def _way_texts(spark, d) -> DataFrame:
    seeds, dna = _seeds(spark, d)
    found = extend.extend_all(seeds, dna, dna, 15, 2, seed=8)
    for i in (1, 2):
        found = postings.with_text(found, dna, f"seq{i}", F.col(f"pos{i}"), F.col(f"len{i}"), f"t{i}")
    return found


_ALLTEXT = f"SELECT * FROM ({_WAYTEXT}) a WHERE NOT EXISTS (SELECT 1 FROM ways b WHERE a.seq1 = b.seq1 AND a.seq2 = b.seq2 AND b.pos1 - b.left_ <= a.pos1 AND b.pos1 - b.left_ + b.n >= a.pos1 + a.len1 AND b.pos2 - b.left_ <= a.pos2 AND b.pos2 - b.left_ + b.n >= a.pos2 + a.len2 AND (a.pos1, a.len1, a.pos2) <> (b.pos1 - b.left_, b.n, b.pos2 - b.left_))"


@_query("hamming_distance", f"{_STEPS} SELECT DISTINCT seq1, pos1, seq2, pos2, list_sum([CASE WHEN substr(t1, i, 1) <> substr(t2, i, 1) THEN 1 ELSE 0 END FOR i IN range(1, length(t1) + 1)])::BIGINT AS distance, levenshtein(t1, t2)::BIGINT AS edits FROM ({_ALLTEXT})")
def _(spark, d):
    return _way_texts(spark, d).select("seq1", "pos1", "seq2", "pos2", scores.hamming(F.col("t1"), F.col("t2")).cast("long").alias("distance"), F.levenshtein("t1", "t2").cast("long").alias("edits"))


_PAIR = "CASE WHEN substr(t1, i, 1) = substr(t2, i, 1) THEN substr(t1, i, 1) ELSE {other} END"
_IUB = " ".join(f"WHEN '{a}{b}' THEN '{c}' WHEN '{b}{a}' THEN '{c}'" for a, b, c in ("acm", "agr", "atw", "cgs", "cty", "gtk"))


def _abbreviated_sql(other: str) -> str:
    return f"array_to_string([{_PAIR.format(other=other)} FOR i IN range(1, length(t1) + 1)], '')"


@_query("abbreviated_mismatch", f"{_STEPS} SELECT DISTINCT seq1, pos1, seq2, pos2, {_abbreviated_sql("'[' || substr(t1, i, 1) || substr(t2, i, 1) || ']'")} AS text, {_abbreviated_sql(f'CASE substr(t1, i, 1) || substr(t2, i, 1) {_IUB} END')} AS iub FROM ({_ALLTEXT})")
def _(spark, d):
    return _way_texts(spark, d).select("seq1", "pos1", "seq2", "pos2", scores.abbreviated(F.col("t1"), F.col("t2")).alias("text"), scores.abbreviated(F.col("t1"), F.col("t2"), iub=True).alias("iub"))


@_query("extend_edit")
def _(spark, d):
    seeds, dna = _seeds(spark, d)
    return extend.extend_edit(seeds, dna, dna, 15, 2, seed=8)


# scores along both ends of each seed: up to the first fall of more than 6 below the best, the first place of the best counts
_XDROP = f"""WITH {_SEEDS}, ids AS (SELECT *, row_number() OVER (ORDER BY seq1, pos1, seq2, pos2, len) AS id FROM seeds),
    steps AS (SELECT id, 1 AS side, k, substr(s1, (pos1 - k + 1)::INT, 1) = substr(s2, (pos2 - k + 1)::INT, 1) AS eq FROM (SELECT *, unnest(range(1, nl + 1)) AS k FROM ids)
        UNION ALL SELECT id, 2, k, substr(s1, (pos1 + len + k)::INT, 1) = substr(s2, (pos2 + len + k)::INT, 1) FROM (SELECT *, unnest(range(1, nr + 1)) AS k FROM ids)),
    totals AS (SELECT *, sum(CASE WHEN eq THEN 2 ELSE -1 END) OVER w AS t, k - coalesce(max(CASE WHEN NOT eq THEN k END) OVER w, 0) AS run FROM steps WINDOW w AS (PARTITION BY id, side ORDER BY k)),
    tops AS (SELECT *, greatest(0, max(t) OVER (PARTITION BY id, side ORDER BY k)) AS top FROM totals),
    stops AS (SELECT id, side, min(k) FILTER (t < top - 6) AS stop FROM tops GROUP BY id, side),
    scanned AS (SELECT t.* FROM tops t JOIN stops USING (id, side) WHERE stop IS NULL OR k < stop),
    ends AS (SELECT id, side, max(run) AS run, CASE WHEN max(t) > 0 THEN arg_max(k, t * 1000000 - k) ELSE 0 END AS n, greatest(0, max(t)) AS t FROM scanned GROUP BY id, side),
    both_ends AS (SELECT i.*, coalesce(a.n, 0) AS left_, coalesce(a.n, 0) + len + coalesce(b.n, 0) AS n, (2 * coalesce(a.n, 0) - coalesce(a.t, 0)) / 3 + (2 * coalesce(b.n, 0) - coalesce(b.t, 0)) / 3 AS d
        FROM ids i LEFT JOIN ends a ON a.id = i.id AND a.side = 1 LEFT JOIN ends b ON b.id = i.id AND b.side = 2 WHERE coalesce(a.run, 0) < 8)"""


@_query("xdrop_hamming", f"{_XDROP} SELECT DISTINCT {_WAY}, (CASE WHEN d = 0 THEN 2 * n ELSE 3 * d - 2 * n END)::BIGINT AS score FROM both_ends")
def _(spark, d):
    seeds, dna = _seeds(spark, d)
    return extend.extend_xdrop(seeds, dna, dna, 6, seed=8)


@_query("xdrop_edit")
def _(spark, d):
    seeds, dna = _seeds(spark, d)
    return extend.extend_xdrop(seeds, dna, dna, 6, edits=True, seed=8)


@_query("alignment_text")
def _(spark, d):
    seeds, dna = _seeds(spark, d)
    return alignment.align(extend.extend_edit(seeds, dna, dna, 15, 2, seed=8), dna, dna)


_FEWEST = "(SELECT seq1, pos1, len1, seq2, pos2, len2, max(distance) AS distance FROM (SELECT {way} FROM ways) GROUP BY ALL)".format(way=_WAY).replace(" GROUP BY ALL", " GROUP BY seq1, pos1, len1, seq2, pos2, len2")


@_query("extend_all", f"{_STEPS}, f AS MATERIALIZED {_FEWEST} SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE a.seq1 = b.seq1 AND a.seq2 = b.seq2 AND b.pos1 <= a.pos1 AND b.pos1 + b.len1 >= a.pos1 + a.len1 AND b.pos2 <= a.pos2 AND b.pos2 + b.len2 >= a.pos2 + a.len2 AND (a.pos1, a.len1, a.pos2, a.len2) <> (b.pos1, b.len1, b.pos2, b.len2))")
def _(spark, d):
    seeds, dna = _seeds(spark, d)
    return extend.extend_all(seeds, dna, dna, 15, 2, seed=8)


@_query("chain_threaded")
def _(spark, d):
    chained = chain.chains(_fragments(spark, d), ["seq1", "seq2"], chain.ChainMode("gap_cost"))
    return chain.threaded(chained, _conv(spark, d), _bench(spark, d), max_gap=40, max_errors=12)


@_query("local_alignment")
def _(spark, d):
    dna = _dna(spark, d)
    both = dna.alias("a").join(dna.alias("b"), F.col("b.seqnum") == F.col("a.seqnum") + 1)
    return alignment.local_alignments(both.select(F.col("a.seqnum").alias("seq1"), F.col("b.seqnum").alias("seq2"), F.col("a.seq").alias("text1"), F.col("b.seq").alias("text2")))


from seqloom import registry_files, registry_index  # noqa: E402, F401  they add their queries
