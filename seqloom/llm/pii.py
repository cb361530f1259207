"""Personal data by weak supervision; DataFrame operations only.

Four base kinds are found by fixed patterns and checks and always stay. Wider patterns propose further spans:
secrets (long tokens), number groups and spelled-out mail addresses. On each proposal six labelers vote yes,
no or nothing: shape by pattern, two gazetteers of words, assignment and quote marks around it, the mix of its
characters, and what it is glued to. Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability without any labels (votes are taken as independent given the truth; a labeler's
chances of each vote given yes and no, and each kind's share of yes, are the parameters). Its posteriors train a
logistic span classifier over votes, kind, length and share of digits, which decides.

Positions: a text is split at a pattern's matches, and lengths of pieces and matches are added up, in blocks, so
that texts with very many matches cost little more than others. Patterns are possessive and start at
the first character of a run only, so that long runs are read once. What goes to the driver is counts by
vote pattern and feature class, of which there are at most 3 * 3**6 * 5 * 5.

A null or empty text has no spans. Repeated rows and ids each give a row. With no proposals at all, nothing is
added. Extra columns are ignored. Positions count code points.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import written

_LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds in their order. Fixed values; the guards in front change no match, see above.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = "[A-Za-z0-9_/+-]"
PROPOSED = {
    "secret": rf"(?<!{_TOKEN}){_TOKEN}{{20,}}+=*+",
    "number": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "mail": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[({{](?i:at)[\])}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({{](?i:dot)[\])}}])\x20?[A-Za-z0-9-]++)++",
}
#: A text without a match of this has none of the kind either.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": rf"{_TOKEN}{{20}}", "number": r"[0-9][\x20.-][0-9]", "mail": r"(?i)[\[({]at[\])}]"}
#: Gazetteers: words in front of a span that speak for it, by kind, and against any. Fixed values.
FOR = {
    "secret": "token|key|secret|password|passwd|pwd|api|auth|bearer|session|credential|apikey",
    "number": "phone|tel|call|fax|mobile|cell|ssn|social|account|passport|licence|license|id",
    "mail": "mail|email|contact|write|reach",
}
AGAINST = "page|pages|isbn|issn|version|figure|table|chapter|section|volume|year|build|commit|sha|md5"
LABELERS = ("shape", "words_for", "words_against", "marks", "mix", "glue")
CONTEXT = 40
BLOCK = 64
ROUNDS = 50


def prefix_sums(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` with each array of long numbers in `names` turned into its running sums."""
    rest = [F.col(c) for c in df.columns if c not in names]
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def offsets(c: str) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(c, b * BLOCK + 1, BLOCK)))
        return F.when(F.size(c) > 0, F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))))

    with_offsets = df.select(*rest, *names, *[offsets(c).alias(f"__off_{c}") for c in names])

    def sums(c: str) -> Column:
        def at(x: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            return F.get(F.col(f"__off_{c}"), b) + total(F.slice(c, b * BLOCK + 1, i - b * BLOCK + 1))

        # named twice, the offsets stay a column of their own; named once, they'd be worked out anew for each element
        return F.when(F.col(f"__off_{c}").isNotNull(), F.transform(c, at))

    return with_offsets.select(*rest, *[sums(c).alias(c) for c in names])


def located(docs: DataFrame, keep: list[str], patterns: dict[str, str]) -> DataFrame:
    """The columns `keep` and, for each kind, an array of its matches: begin, end, text, before, after.

    before and after are up to CONTEXT characters between the match and its neighbours. Expects __text.
    """
    kinds = list(patterns)
    out = docs.select(*keep, "__text", *[F.when(F.col("__text").rlike(NEEDS[k]), F.regexp_extract_all("__text", F.lit(patterns[k]), F.lit(0))).alias(f"__m_{k}") for k in kinds])
    out = out.select(*keep, *[f"__m_{k}" for k in kinds], *[F.when(F.size(f"__m_{k}") > 0, F.split("__text", patterns[k], -1)).alias(f"__p_{k}") for k in kinds])
    near = lambda p: F.struct(F.length(p).cast("long").alias("n"), F.right(p, F.lit(CONTEXT)).alias("last"), F.left(p, F.lit(CONTEXT)).alias("first"))
    out = out.select(*keep, *[f"__m_{k}" for k in kinds], *[F.transform(f"__p_{k}", near).alias(f"__p_{k}") for k in kinds])
    steps = [F.zip_with(F.slice(f"__p_{k}", 1, F.size(f"__m_{k}")), F.col(f"__m_{k}"), lambda p, m: p["n"] + F.length(m)).alias(f"__e_{k}") for k in kinds]
    out = prefix_sums(out.select(*keep, *[f"__m_{k}" for k in kinds], *[f"__p_{k}" for k in kinds], *steps), [f"__e_{k}" for k in kinds])

    def spans(k: str) -> Column:
        def span(e: Column, i: Column) -> Column:
            m, p = F.get(F.col(f"__m_{k}"), i), F.col(f"__p_{k}")
            return F.struct((e - F.length(m)).alias("begin"), e.alias("end"), m.alias("text"), F.get(p, i)["last"].alias("before"), F.get(p, i + 1)["first"].alias("after"))

        kind = "array<struct<begin:bigint,end:bigint,text:string,before:string,after:string>>"
        return F.coalesce(F.transform(f"__e_{k}", span), F.array()).cast(kind).alias(k)

    return out.select(*keep, *[spans(k) for k in kinds])


def _luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x["text"]))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(x["text"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.when(part(p) == "", F.lit(0)).otherwise(F.left(part(p), F.lit(3)).cast("int")) <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(x["text"]))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _votes(kind: str, x: Column) -> dict[str, Column]:
    """Each labeler's vote on a proposal: 1 yes, -1 no, 0 nothing."""
    text, before, after = x["text"], F.lower(x["before"]), x["after"]
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    letters, digits = F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(_digits(text))
    shape = {
        "secret": vote(text.rlike(r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$") | text.rlike(r"^(?:sk|pk|ghp|AKIA|xox)[A-Za-z0-9_-]{16,}$"), digits == 0),
        "number": vote(text.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$") | text.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), text.rlike(r"^[0-9]{2,4}\.[0-9]{2,4}\.[0-9]{3,4}$")),
        "mail": vote(text.rlike(r"(?i)(?:\.|[\])}])\x20?[a-z]{2,}$"), text.rlike(r"[0-9]$")),
    }[kind]
    mix = {"secret": vote((letters >= 3) & (digits >= 3), (letters == 0) | (digits == 0)), "number": vote(digits >= 9, digits <= 7), "mail": vote(letters >= 4, letters < digits)}[kind]
    return {
        "shape": shape,
        "words_for": vote(before.rlike(rf"(?:^|[^a-z])(?:{FOR[kind]})[^a-z]{{0,8}}$")),
        "words_against": vote(F.lit(False), before.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]{{0,8}}$")),
        "marks": vote(before.rlike(r"[=:]\s*[\"']?$")),
        "mix": mix,
        "glue": vote(F.lit(False), before.rlike(r"[A-Za-z0-9/._-]$") | after.rlike(r"^[A-Za-z0-9/_-]")),
    }


def proposals(df: DataFrame) -> Column:
    """All proposals of a row that no base span contains, with their votes and feature classes, as one array."""

    def of(kind: str) -> Column:
        def described(x: Column) -> Column:
            n = F.length(x["text"])
            share = F.length(_digits(x["text"])) / n
            return F.struct(
                F.lit(kind).alias("kind"),
                x["begin"].alias("begin"),
                x["end"].alias("end"),
                *[v.cast("int").alias(name) for name, v in _votes(kind, x).items()],
                F.least(F.lit(4), F.floor(n / 16)).cast("int").alias("size"),
                F.least(F.lit(4), F.floor(share * 5)).cast("int").alias("digits"),
            )

        return F.transform(F.filter(kind, lambda x: ~F.exists("base", lambda b: (b["begin"] <= x["begin"]) & (b["end"] >= x["end"]))), described)

    return F.concat(*[of(k) for k in PROPOSED])


FEATURES = ("kind", *LABELERS, "size", "digits")


def estimate(counts: list[tuple[tuple, int]], rounds: int = ROUNDS) -> tuple[dict, list[float]]:
    """Reliabilities and the posterior of each pattern (kind, votes...), by expectation-maximisation.

    It starts from the share of yes among a pattern's votes. Each chance is smoothed by one observation.
    """
    post = []
    for p, _ in counts:
        votes = [v for v in p[1:] if v]
        post.append((1 + sum(v > 0 for v in votes)) / (2 + len(votes)))
    chances: dict = {}
    for _ in range(rounds):
        prior, total = defaultdict(lambda: 1.0), defaultdict(lambda: 2.0)
        seen, sums = defaultdict(lambda: 1.0), {1: 3.0, 0: 3.0}
        for (p, n), q in zip(counts, post, strict=True):
            prior[p[0]] += n * q
            total[p[0]] += n
            sums[1] += n * q
            sums[0] += n * (1 - q)
            for j, v in enumerate(p[1:]):
                seen[j, v, 1] += n * q
                seen[j, v, 0] += n * (1 - q)
        chances = {"prior": {k: prior[k] / total[k] for k in total}, "vote": {(j, v, z): seen[j, v, z] / sums[z] for j in range(len(LABELERS)) for v in (-1, 0, 1) for z in (0, 1)}}
        new = []
        for p, _ in counts:
            odds = math.log(chances["prior"][p[0]] / (1 - chances["prior"][p[0]]))
            odds += sum(math.log(chances["vote"][j, v, 1] / chances["vote"][j, v, 0]) for j, v in enumerate(p[1:]))
            new.append(1 / (1 + math.exp(-max(-60.0, min(60.0, odds)))))
        moved, post = max((abs(a - b) for a, b in zip(post, new, strict=True)), default=0.0), new
        if moved < 1e-9:
            break
    return chances, post


def train(rows: list[tuple[tuple, int]]) -> dict[tuple[str, object], float]:
    """Weights of a logistic classifier over FEATURES from rows (their values, count), by the labelers' posteriors."""
    patterns: dict[tuple, int] = defaultdict(int)
    for p, n in rows:
        patterns[p[: 1 + len(LABELERS)]] += n
    counts = sorted(patterns.items())
    _, post = estimate(counts)
    truth = {p: q for (p, _), q in zip(counts, post, strict=True)}
    weights: dict[tuple[str, object], float] = defaultdict(float)
    whole = sum(n for _, n in rows)
    rows = sorted(rows)
    for _ in range(400):
        slope: dict[tuple[str, object], float] = defaultdict(float)
        for p, n in rows:
            z = weights["", 0] + sum(weights[f, v] for f, v in zip(FEATURES, p, strict=True))
            off = n / whole * (truth[p[: 1 + len(LABELERS)]] - 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
            slope["", 0] += off
            for f, v in zip(FEATURES, p, strict=True):
                slope[f, v] += off
        for k, g in slope.items():
            weights[k] += 2.0 * g - 1e-4 * weights[k]
    return dict(weights)


def _accepted(x: Column, weights: dict[tuple[str, object], float]) -> Column:
    z = F.lit(weights.get(("", 0), 0.0))
    for f in FEATURES:
        values = [(v, w) for (name, v), w in weights.items() if name == f]
        term = F.lit(0.0)
        for v, w in values:
            term = F.when(x[f] == v, F.lit(w)).otherwise(term)
        z = z + term
    return z > 0


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, base, added) for each row of `docs`: arrays of (kind, begin, end), by kind in its order, then by place."""
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    found = located(own, ["__id"], {**BASE, **PROPOSED})
    place = lambda k: F.transform(F.filter(k, lambda x: _valid(k, x)), lambda x: F.struct(F.lit(k).alias("kind"), x["begin"].alias("begin"), x["end"].alias("end")))
    found = found.select("__id", *PROPOSED, F.concat(*[place(k) for k in BASE]).alias("base"))
    table = written(found.select("__id", "base", proposals(found).alias("proposed")))
    counts = table.select(F.explode("proposed").alias("x")).groupBy(*[F.col(f"x.{f}").alias(f) for f in FEATURES]).count().collect()
    rows = [(tuple(r[f] for f in FEATURES), r["count"]) for r in counts]
    if not rows:
        added = F.slice(F.col("base"), 1, 0)
    else:
        weights = train(rows)
        added = F.transform(F.filter("proposed", lambda x: _accepted(x, weights)), lambda x: F.struct(x["kind"].alias("kind"), x["begin"].alias("begin"), x["end"].alias("end")))
    return table.select(F.col("__id").alias(id_col), "base", added.alias("added"))


def listed(spans: Column) -> Column:
    """kind:begin:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))), ",")
