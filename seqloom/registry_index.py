"""Queries of alphabets, suffix order, selections by chance, and matching by other ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import alphabet, scores
from seqloom.operators import cluster, filters, intervals, matches, postings, select, suffixes
from seqloom.registry import _CB, _SEQ, _bench, _conv, _dna, _docs, _mem, _post, _query, _read, _scored, _SCORED, _selfm

_MAP = "aeiou v\nbcdfg c\nhjklm k\nxyz"


@_query("symbol_map", f"SELECT seqnum, translate(regexp_replace(lower(seq), '[^a-dfghijklmoueyxz]', '#', 'g'), 'aeioubcdfghjklmxyz', 'vvvvvccccckkkkk###') AS seq FROM ({_SEQ['bench']})")
def _(spark, d):
    return _bench(spark, d).select("seqnum", alphabet.SymbolMap.parse(_MAP).apply(F.lower("seq"), strict=False).alias("seq"))


_P20, _AZ = "LVIFKREDAGSTNQYWPHMC", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_UPPER = f"translate(seq, '{_AZ.lower()}', '{_AZ}')"


@_query("protein_alphabet", f"SELECT seqnum, regexp_replace({_UPPER}, '[^{_P20}]', '#', 'g') AS seq FROM ({_SEQ['bench']})")
def _(spark, d):
    return _bench(spark, d).select("seqnum", alphabet.PROTEIN.apply(F.translate("seq", _AZ.lower(), _AZ), strict=False).alias("seq"))


@_query("reduced_alphabet", f"SELECT seqnum, translate(regexp_replace({_UPPER}, '[^{_P20}]', '#', 'g'), 'AGSTNQDEKRLIVMFYWHPC', 'AAAANNDDKKLLLLFYWHPC') AS seq FROM ({_SEQ['bench']})")
def _(spark, d):
    return _bench(spark, d).select("seqnum", alphabet.PROTEIN11.apply(F.translate("seq", _AZ.lower(), _AZ), strict=False).alias("seq"))


@_query("dna_alphabet", f"SELECT seqnum, translate(upper(seq), 'ACGT', 'acgt') AS seq FROM ({_SEQ['dna']})")
def _(spark, d):
    return _dna(spark, d).select("seqnum", alphabet.DNA.apply(F.upper("seq")).alias("seq"))


@_query("reverse_only", f"SELECT seqnum, reverse(seq) AS reversed, translate(seq, 'acgt', 'tgca') AS complemented FROM ({_SEQ['dna']})")
def _(spark, d):
    return _dna(spark, d).select("seqnum", F.reverse("seq").alias("reversed"), alphabet.complement(F.col("seq")).alias("complemented"))


@_query("codon_tables", " UNION ALL ".join(f"SELECT {n}::INT AS number, '{a}{b}{c}' AS codon, '{aa}' AS amino, {str(a + b + c in alphabet.start_codons(n)).lower()} AS starts" for n, code in alphabet.CODES.items() for (a, b, c), aa in zip([(a, b, c) for a in "tcag" for b in "tcag" for c in "tcag"], code, strict=True)))
def _(spark, d):
    rows = [(n, codon, amino, codon in alphabet.start_codons(n)) for n in alphabet.CODES for codon, amino in alphabet.codon_table(n).items()]
    return spark.createDataFrame(rows, "number int, codon string, amino string, starts boolean")


@_query("start_codons", f"SELECT seqnum, pos, km AS codon FROM ({_post('dna', 3)}) WHERE km IN ('ttg', 'ctg', 'atg')")
def _(spark, d):
    return alphabet.start_places(_dna(spark, d))


@_query("packed_sequences", f"SELECT seqnum, array_to_string([substr('0123456789abcdef', 4 * (instr('acgt', substr(w, 2 * i + 1, 1)) - 1) + instr('acgt', substr(w, 2 * i + 2, 1)), 1) FOR i IN range(0, length(w) // 2)], '') AS code, seq AS back FROM (SELECT *, CASE WHEN length(seq) % 2 = 1 THEN seq || 'a' ELSE seq END AS w FROM ({_SEQ['dna']}))")
def _(spark, d):
    rows = _dna(spark, d).withColumn("code", alphabet.packed(F.col("seq")))
    return rows.select("seqnum", "code", alphabet.unpacked(F.col("code"), F.length("seq")).alias("back"))


@_query("all_strings", "SELECT (16 * a + 4 * b + c)::BIGINT AS code, substr('acgt', a + 1, 1) || substr('acgt', b + 1, 1) || substr('acgt', c + 1, 1) AS string FROM (SELECT unnest(range(0, 4))::INT AS a), (SELECT unnest(range(0, 4))::INT AS b), (SELECT unnest(range(0, 4))::INT AS c)")
def _(spark, d):
    return alphabet.all_strings(spark, "acgt", 3)


@_query("both_strands_index", f"SELECT seqnum, '+' AS strand, pos, km AS kmer FROM ({_post('dna', 10)}) UNION ALL SELECT seqnum, '-', pos, km FROM ({_post('dnarc', 10)})")
def _(spark, d):
    both = alphabet_strands(_dna(spark, d))
    found = postings.windows(both.select(F.col("id").alias("seqnum"), "seq"), 10)
    return found.select(F.floor(F.col("seqnum") / 2).alias("seqnum"), F.when(F.col("seqnum") % 2 == 0, "+").otherwise("-").alias("strand"), "pos", "kmer")


def alphabet_strands(dna):
    """Both strands as sequences, numbered 2 * seqnum and 2 * seqnum + 1."""
    return postings.both_strands(dna).withColumn("id", F.col("seqnum") * 2 + (F.col("strand") == "-").cast("long"))


_SUFFIXES = f"SELECT row_number() OVER (ORDER BY substr(seq, (pos + 1)::INT) || '~', seqnum, pos) - 1 AS rank, seqnum, pos, substr(seq, (pos + 1)::INT) AS s, CASE WHEN pos > 0 THEN substr(seq, pos::INT, 1) END AS bwt FROM (SELECT seqnum, seq, unnest(range(0, length(seq))) AS pos FROM ({_SEQ['dna']}))"


@_query("suffix_order", f"SELECT rank, seqnum, pos FROM ({_SUFFIXES})")
def _(spark, d):
    return suffixes.suffix_order(_dna(spark, d))


@_query("suffix_lcp_bwt", f"WITH o AS MATERIALIZED ({_SUFFIXES}) SELECT a.rank, a.seqnum, a.pos, CASE WHEN b.rank IS NULL THEN -1 ELSE coalesce(list_min([i FOR i IN range(0, least(length(a.s), length(b.s))) IF substr(a.s, (i + 1)::INT, 1) <> substr(b.s, (i + 1)::INT, 1)]), least(length(a.s), length(b.s)))::BIGINT END AS lcp, a.bwt FROM o a LEFT JOIN o b ON b.rank = a.rank - 1")
def _(spark, d):
    dna = _dna(spark, d)
    return suffixes.neighbours(suffixes.suffix_order(dna), dna).withColumn("lcp", F.coalesce("lcp", F.lit(-1).cast("long")))


@_query("suffix_buckets", f"SELECT substr(s, 1, 3) AS prefix, min(rank) AS first, count(*) AS cnt FROM ({_SUFFIXES}) WHERE length(s) >= 3 GROUP BY 1")
def _(spark, d):
    dna = _dna(spark, d)
    return suffixes.buckets(suffixes.suffix_order(dna), dna, 3)


@_query("suffix_order_to_depth", f"SELECT seqnum, pos, min(rank) OVER (PARTITION BY substr(s || repeat('~', 16), 1, 16)) AS least, max(rank) OVER (PARTITION BY substr(s || repeat('~', 16), 1, 16)) AS greatest, true AS inside FROM ({_SUFFIXES})")
def _(spark, d):
    dna = _dna(spark, d)
    whole = suffixes.suffix_order(dna)
    shallow = suffixes.suffix_order(dna, depth=16).withColumnRenamed("rank", "shallow")
    key = F.substring(F.rpad(F.substr(F.col("seq"), (F.col("pos") + 1).cast("int"), F.lit(16)), 16, "~"), 1, 16)
    rows = whole.join(dna.select("seqnum", "seq"), "seqnum").withColumn("key", key)
    bounds = rows.groupBy("key").agg(F.min("rank").alias("least"), F.max("rank").alias("greatest"))
    return rows.join(bounds, "key").join(shallow, ["seqnum", "pos"]).select("seqnum", "pos", "least", "greatest", F.col("shallow").between(F.col("least"), F.col("greatest")).alias("inside"))


@_query("prefix_length", f"SELECT greatest(1, floor(ln(greatest(4, n / 8.0)) / ln(4) + 1e-9))::INT AS recommended, greatest(1, floor(ln(greatest(4, n * 4 / 8.0)) / ln(4) + 1e-9))::INT AS most FROM (SELECT sum(length(seq)) AS n FROM ({_SEQ['dna']}))")
def _(spark, d):
    n = _dna(spark, d).agg(F.sum("len")).first()[0]
    return spark.createDataFrame([(suffixes.prefix_length(n, 4), suffixes.prefix_length(n, 4, most=True))], "recommended int, most int")


# --- by chance, from MD5, so that SQL draws the same


def _draw_sql(seed: int, *columns: str) -> str:
    return f"('0x' || left(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 12))::BIGINT"


@_query("seq_random", f"SELECT seqnum, length(seq)::BIGINT AS len FROM ({_SEQ['docs']}) ORDER BY {_draw_sql(42, 'seqnum')}, seqnum LIMIT 25")
def _(spark, d):
    return select.random_sequences(_docs(spark, d), 25).select("seqnum", "len")


@_query("seq_random_until", f"SELECT seqnum, len FROM (SELECT seqnum, length(seq)::BIGINT AS len, coalesce(sum(length(seq)) OVER (ORDER BY {_draw_sql(42, 'seqnum')}, seqnum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({_SEQ['docs']})) WHERE b < 100000")
def _(spark, d):
    return select.random_until(_docs(spark, d), 100_000).select("seqnum", "len")


@_query("subseq_by_place", f"SELECT seqnum, substr(seq, 6, 30) AS seq FROM ({_SEQ['docs']}) WHERE seqnum = 11")
def _(spark, d):
    return select.substring(_docs(spark, d), 11, 5, 30)


_AT = f"SELECT seqnum, seq, length(seq) AS len, coalesce(sum(length(seq) + 1) OVER (ORDER BY seqnum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM ({_SEQ['docs']})"


@_query(
    "subseq_random",
    f"""WITH s AS MATERIALIZED ({_AT}), w AS (SELECT max(a + len) AS n FROM s), t AS (SELECT id, unnest(range(0, 20)) AS try FROM (SELECT unnest(range(0, 200)) AS id)),
    x AS (SELECT id, try, floor({_draw_sql(43, 'id', 'try')} / 281474976710656.0 * w.n)::BIGINT AS p, 20 + floor({_draw_sql(44, 'id', 'try')} / 281474976710656.0 * 41)::BIGINT AS n FROM t, w),
    f AS (SELECT id, try, seqnum, (p - a)::BIGINT AS start, substr(seq, (p - a + 1)::INT, x.n::INT) AS t FROM x JOIN s ON p >= a AND p + x.n <= a + len WHERE NOT contains(substr(seq, (p - a + 1)::INT, x.n::INT), '#') QUALIFY row_number() OVER (PARTITION BY id ORDER BY try) = 1)
    SELECT id, seqnum, start, CASE WHEN id % 2 = 1 THEN reverse(t) ELSE t END AS seq FROM f""",
)
def _(spark, d):
    return select.random_substrings(_docs(spark, d), 200, 20, 60)


# --- other ways to match


@_query("online_match", _mem("conv", "bench", 12))
def _(spark, d):
    return matches.online_matches(_conv(spark, d), _bench(spark, d), 12)


@_query("index_against_index", _mem("conv", "bench", 16))
def _(spark, d):
    return matches.stored_matches(postings.postings(_conv(spark, d), 16), postings.postings(_bench(spark, d), 16), 16)


_RC8 = "reverse(translate(km, 'acgt', 'tgca'))"


@_query("kmer_search_both_strands", f"WITH q AS ({_post('dna', 8)}), s AS (SELECT seqnum, pos, km, 'f' AS strand FROM q UNION ALL SELECT seqnum, pos, {_RC8}, 'p' FROM q), c AS (SELECT km, count(*) AS cnt FROM q GROUP BY km) SELECT seqnum, pos, s.km AS kmer, cnt, strand FROM s JOIN c ON c.km = s.km")
def _(spark, d):
    return postings.kmer_search(_dna(spark, d), _dna(spark, d), 8, "fp")


@_query("mum_one_based", f"SELECT pos1 + 1 AS start1, pos2 + 1 AS start2, len FROM ({_CB})")
def _(spark, d):
    return matches.query_matches(_conv(spark, d), _bench(spark, d), 12).select((F.col("pos1") + 1).alias("start1"), (F.col("pos2") + 1).alias("start2"), "len")


@_query("distance_of_score", f"SELECT seq1, pos1, seq2, pos2, score, ((2 * len - (score - 9)) // 3)::BIGINT AS distance FROM ({_SCORED})")
def _(spark, d):
    return _scored(spark, d).select("seq1", "pos1", "seq2", "pos2", "score", scores.distance_of_score(F.col("len1"), F.col("len2"), F.col("score") - 9).alias("distance"))


@_query("evalues_with_errors", "SELECT n, d, round((lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + (n - k) * ln(0.25) + (k + 2) * ln(0.75) + ln(f)) / ln(10), 6) AS log10_evalue FROM (SELECT n, d, abs(d) AS k, CASE d WHEN 1 THEN 3.97 WHEN 2 THEN 12.8 WHEN 3 THEN 32.6 ELSE 1.0 END AS f FROM (SELECT unnest(range(20, 200))::BIGINT AS n), (SELECT unnest(range(-3, 4))::BIGINT AS d))")
def _(spark, d):
    rows = spark.range(20, 200).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))).alias("d"))
    return rows.select("n", "d", F.round(scores.log_evalue(F.col("n"), F.col("d"), F.lit(1.0), 4) / F.log(F.lit(10.0)), 6).alias("log10_evalue"))


@_query("bounded_distance", f"SELECT a, b, CASE WHEN v <= 150 THEN v ELSE -1 END AS distance FROM (SELECT x.seqnum AS a, y.seqnum AS b, levenshtein(x.seq, y.seq)::BIGINT AS v FROM ({_SEQ['dna']}) x JOIN ({_SEQ['dna']}) y ON y.seqnum = x.seqnum + 1)")
def _(spark, d):
    dna = _dna(spark, d)
    both = dna.alias("a").join(dna.alias("b"), F.col("b.seqnum") == F.col("a.seqnum") + 1)
    return both.select(F.col("a.seqnum").alias("a"), F.col("b.seqnum").alias("b"), F.levenshtein("a.seq", "b.seq", 150).cast("long").alias("distance"))


@_query("weighted_lengths", f"SELECT len AS length, sum(len * len)::BIGINT AS weight FROM ({_selfm('conv', 30)}) GROUP BY len")
def _(spark, d):
    return matches.self_matches(_conv(spark, d), 30).groupBy(F.col("len").alias("length")).agg(F.sum(F.col("len") * F.col("len")).alias("weight"))


_NAMED = f"SELECT DISTINCT unnest([seq1, seq2]) AS seqnum FROM ({_selfm('conv', 40)})"


@_query("clusters_of_matched", f"SELECT seqnum FROM ({_NAMED})")
def _(spark, d):
    conv = _conv(spark, d)
    found = filters.exact_columns(matches.self_matches(conv, 40))
    return cluster.clusters_of_matched(found, conv, 30, 10).select("seqnum")


@_query("mask_lower", f"WITH c AS (SELECT DISTINCT seq2 AS s, unnest(range(pos2, pos2 + len)) AS p FROM ({_CB})) SELECT seqnum, array_to_string([CASE WHEN list_contains(ps, i - 1) THEN lower(substr(seq, i::INT, 1)) ELSE substr(seq, i::INT, 1) END FOR i IN range(1, length(seq) + 1)], '') AS seq, len(ps)::BIGINT AS masked FROM ({_SEQ['bench']}) LEFT JOIN (SELECT s, list(p) AS ps FROM c GROUP BY s) ON s = seqnum".replace("list_contains(ps,", "list_contains(coalesce(ps, []),").replace("len(ps)", "coalesce(len(ps), 0)"))
def _(spark, d):
    bench = _bench(spark, d)
    return intervals.masked(bench, intervals.marked(matches.query_matches(_conv(spark, d), bench, 12), "right"), "tolower")


@_query("distinct_sorted", f"SELECT DISTINCT km AS kmer FROM ({_post('dna', 6)})")
def _(spark, d):
    return postings.windows(_dna(spark, d), 6).select("kmer").distinct().orderBy("kmer")


@_query("labelled_sequences", f"SELECT seqnum FROM ({_SEQ['docs']}) WHERE seqnum NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return _docs(spark, d).join(_read(spark, d, "labels").select(F.col("doc_id").alias("seqnum")), "seqnum", "left_anti").select("seqnum")
