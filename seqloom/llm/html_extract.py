"""Main text of HTML pages as the maximum-scoring contiguous run of tokens.

A page is a row of tokens: runs of words, tags, and elements that hold no article text, each one token. Words score
positive, tags and such elements negative; a linear scan finds the run with the greatest sum, and its words,
with character references decoded and white space as single spaces, are the text.

All weights are log odds of standing inside the article, learned from pages that label it themselves by one <article>
(or <main>); each page teaches twice, with that label seen and with it hidden, so that pages without it are scored too.
An element has a feature for its name and one for each word of its class, id and role. Which features mark an element
as one without article text is learned in two rounds: at first every element around a word counts, then only the
outermost one that the first round took for such, so that the list inside a menu isn't blamed for the menu. Usual names
of menus, headers, footers, sidebars, notices, adverts, forms and comments shift the odds of their features (PRIOR) by
more than data can make up for, since a label also covers the adverts inside an article; elements that are never shown
as text (MARKUP) are tags.

Weights come from a sample of about `sample` labelled pages (by a hash of the id, so reruns agree), and from features on
SUPPORT of its pages or more; every page is extracted whole. Without labelled pages fixed weights apply. A null or empty
html gives ''. Repeated rows and ids each give a row. Unclosed elements end with the page; an unclosed element without
article text, other than a footer, is taken for its tag alone. Extra columns are ignored. Time is linear in a page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_arrow_batches, written

SAMPLE, SUPPORT = 4000, 3
#: Elements that are no text, elements whose content is no markup, and elements that don't end a block. Fixed values.
MARKUP = frozenset("head script style noscript template svg math iframe object canvas".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of class, id or role that usually hold no article text. Fixed values.
USUAL_TAGS = frozenset("nav header footer aside form title button select option textarea dialog menu".split())
USUAL_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar widget widgets footer masthead cookie cookies consent notice notices popup modal newsletter subscribe signup login share sharing social"
    " related recommended comment comments disqus respond reply replies contentinfo complementary search pagination pager".split()
)
HEADER_NAMES = frozenset("header site-header page-header siteheader pageheader topbar top-bar".split())
#: Last parts of a name that leave its first part to tell what it is, as in comment-list. Fixed values.
HOLDERS = frozenset("area bar block body box container holder inner item items left link links list panel right section slot top bottom unit wrap wrapper".split())
#: What a usual name adds to the log odds of its feature, the bounds of what data says, and where an element is left out.
PRIOR, MOST_ODDS, LEFT_OUT = -5.0, 4.0, -1.0
#: Elements that hold the whole page, or what it marks as its own part.
FRAME = frozenset(("html", "body", "main"))
#: Where nothing is labelled. Fixed values.
DEFAULT = {"word": 1.0, "link": 0.3, "tag": -0.3, "skip": -1.0}
MOST_WORD, LEAST_WORD, MOST_TAG, LEAST_TAG = 2.0, 0.05, -0.05, -4.0

_OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""[^<>"']*+>""")
_NAME = re.compile(r"[\s/]*+([^\s/>=]*+)[\s]*+(=?)[\s]*+")
_BARE = re.compile(r"[^\s>]*+")
_PARTS = re.compile(r"[^a-z0-9]+")


class _Tags:
    """The tags of a page in order: (start, end, whether it closes, name, words of class, id and role).

    Values in quotes may hold '>'. A quote that is never closed is a character like any other, and a mark without an
    end takes the rest of the page; what has been sought in vain once isn't sought again, which keeps this linear.
    """

    def __init__(self, page: str):
        self.page, self.absent = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def attributes(self, at: int) -> tuple[int, list[str]]:
        """(place after the tag, names); the page's length if the tag has no end."""
        page, names = self.page, []
        if m := _PLAIN.match(page, at):
            if "=" not in m[0]:
                return m.end(), names
        while at < len(page):
            m = _NAME.match(page, at)
            at = m.end()
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ('"', "'") and quote else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = _BARE.match(page, at)
                    value, at = v[0], v.end()
            if value and m[1].lower() in ("class", "id", "role"):
                names += value.lower().split()
            if page[at : at + 1] == ">":
                return at + 1, names
            if not m[0] and not value:
                at += 1  # nothing was read, so as not to stay here
        return len(page), names

    def raw_end(self, name: str, at: int) -> tuple[int, int] | None:
        """(start, end) of the tag that closes an element whose content is no markup."""
        if "</" + name in self.absent:
            return None
        m = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(self.page, at)
        if m is None:
            self.absent.add("</" + name)
            return None
        return m.start(), m.end()

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, list[str]]]:
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            after = page[start + 1 : start + 2]
            if after in ("!", "?") and after:
                comment = page.startswith("!--", start + 1)
                end = self.find("-->" if comment else ">", start + (4 if comment else 2))
                at = len(page) if end < 0 else end + (3 if comment else 1)
                yield start, at, False, "", []
                continue
            m = _OPEN.match(page, start + 1)
            if m is None:
                at = start + 1
                continue
            at, names = self.attributes(m.end())
            closes, name = bool(m[1]), m[2].lower()
            yield start, at, closes, name, names
            if name in RAW and not closes and page[at - 2 : at - 1] != "/":
                close = self.raw_end(name, at)
                if close is not None:
                    at = close[1]
                    yield *close, True, name, []
                elif name in ("script", "style"):
                    at = len(page)


def features(name: str, names: list[str]) -> list[str]:
    """Features of an element: those of its class, id and role, and its name unless it is one inside a line."""
    return [f".{x}" for x in names] + ([] if name in INLINE else [name])


def usual(feature: str) -> bool:
    """Whether a feature is by its name one of elements without article text."""
    if not feature.startswith("."):
        return feature in USUAL_TAGS
    parts = [x for x in _PARTS.split(feature[1:]) if x]
    return feature[1:] in HEADER_NAMES or bool(parts) and (parts[-1] in USUAL_NAMES or (parts[-1] in HOLDERS and any(x in USUAL_NAMES for x in parts[:-1])))


class Weights:
    """kinds: weights of words, links and tags by 'in|', 'out|' (of a label that is seen) or 'hidden|'; odds: of features, as data says.

    priors: whether usual names count.
    """

    def __init__(self, kinds: dict[str, float] | None = None, odds: dict[str, float] | None = None, *, priors: bool = True):
        self.kinds, self.odds, self.priors = kinds or {}, odds or {}, priors

    def element(self, name: str, names: list[str]) -> float:
        """The least of the features' weights; an element of MARKUP is always left out, the page's frame never."""
        if name in MARKUP:
            return LEFT_OUT
        if name in FRAME:
            return 0.0
        found = features(name, names)
        return min((self.odds.get(f, 0.0) + (PRIOR if self.priors and usual(f) else 0.0) for f in found), default=0.0)

    def token(self, kind: str, inside: bool | None) -> float:
        where = "hidden" if inside is None else "in" if inside else "out"
        if f"{where}|{kind}" in self.kinds:
            return self.kinds[f"{where}|{kind}"]
        base = DEFAULT.get(kind, DEFAULT["tag"])
        if inside and base < 0:
            return MOST_TAG
        return base if inside is not False else -abs(base)


_BARE_MARKUP = Weights(priors=False)


class Page:
    """Tokens (kind, text) of a page, the range of them in its only outermost article, and its elements.

    Kinds: word and link for text, skip for an element that is left out, block:name and inline:name for tags. The text
    of a tag is what it puts between words. elements: (first token, token after, features) of those not inside one left out.
    """

    def __init__(self, page: str, weights: Weights | None, teach: bool = False):
        """weights: None leaves nothing out but MARKUP. teach: count the words of what is left out, too."""
        found = list(_Tags(page))
        articles = sum(name == "article" and not closes for _, _, closes, name, _ in found)
        opened: dict[str, list[int]] = {}
        match: dict[int, int] = {}
        for i, (_, _, closes, name, _) in enumerate(found):
            if closes:
                if opened.get(name):
                    match[opened[name].pop()] = i
            elif name and name not in VOID:
                opened.setdefault(name, []).append(i)
        self.tokens: list[tuple[str, str]] = []
        self.elements: list[tuple[int, int, list[str]]] = []
        self.left_out: dict[int, int] = {}
        out = self.tokens
        spans: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        ends: dict[int, tuple[str, int, list[str]]] = {}
        links, last, i = 0, 0, 0
        while i <= len(found):
            begin = found[i][0] if i < len(found) else len(page)
            if begin > last:
                raw = page[last:begin]
                text = html.unescape(raw) if "&" in raw else raw
                out.append(("inline:" if text.isspace() else "link" if links else "word", text))
            if i == len(found):
                break
            _, last, closes, name, names = found[i]
            if closes and i in ends:
                which, start, own = ends.pop(i)
                if which in spans:
                    spans[which].append((start, len(out)))
                self.elements.append((start, len(out), own))
            if not closes and name:
                alone = name == "article" and articles == 1
                weight = 0.0 if alone else (weights or _BARE_MARKUP).element(name, names)
                own = features(name, names)
                if weight <= LEFT_OUT and (i in match or name in ("footer", "script", "style")):
                    if teach and name not in MARKUP:
                        self.left_out[len(out)] = len(_shown(page[last : found[match[i]][0]] if i in match else page[last:]))
                        self.elements.append((len(out), len(out) + 1, own))
                    out.append(("skip", " "))
                    if i not in match:
                        break
                    i = match[i]
                    last = found[i][1]
                    i += 1
                    continue
                if i in match:
                    ends[match[i]] = (name, len(out), own)
                elif name == "article":
                    spans[name].append((len(out), 1 << 60))
            if name == "a":
                links = 0 if closes else links + (i in match)
            if name:
                slash = "/" if closes else ""
                out.append((f"inline:{slash}{name}", "") if name in INLINE else (f"block:{slash}{name}", " "))
            i += 1
        self.label: tuple[int, int] | None = None
        for which in ("article", "main"):
            outer, reach = [], -1
            for a, b in sorted(spans[which], key=lambda s: (s[0], -s[1])):
                if b > reach:
                    outer.append((a, min(b, len(out))))
                    reach = b
            if len(outer) == 1:
                self.label = outer[0]
            if outer:
                break

    def each(self) -> Iterator[tuple[int, str, int]]:
        """(place, kind, how often it counts) of the tokens that score."""
        for i, (kind, text) in enumerate(self.tokens):
            if kind in ("word", "link"):
                yield i, kind, len(text.split())
            elif kind != "inline:":
                yield i, kind, 1

    def inside(self, i: int) -> bool | None:
        return None if self.label is None else self.label[0] <= i < self.label[1]


def _shown(markup: str) -> list[str]:
    """Words of an element that is left out, roughly: what stands outside '<' and '>'."""
    return [w for part in markup.split("<") for w in part.rsplit(">", 1)[-1].split()]


def _odds(inside: int, outside: int) -> float:
    return math.log((inside + 0.5) / (outside + 0.5))


def counted(page: str, weights: Weights | None) -> Counter:
    """(kind or feature, inside) -> words or tokens of a labelled page; empty for other pages.

    Features come as 'f|...', and once for the page as 'p|...'; with `weights` elements inside one that is left out don't count.
    """
    found = Page(page, weights, teach=True)
    out: Counter = Counter()
    if found.label is None:
        return out
    words, within = [0], [0]
    for i, (kind, text) in enumerate(found.tokens):
        n = len(text.split()) if kind in ("word", "link") else found.left_out.get(i, 0)
        words.append(words[-1] + n)
        within.append(within[-1] + (n if found.inside(i) else 0))
    seen = set()
    for a, b, own in found.elements:
        marks = [f for f in own if f.startswith(".")]
        if weights is not None and weights.element("", [f[1:] for f in marks]) <= LEFT_OUT:
            own = marks  # its class tells what it is, not its name
        for f in set(own) - FRAME - {"article"}:
            n, k = words[b] - words[a], within[b] - within[a]
            if n:
                out[f"f|{f}", True] += k
                out[f"f|{f}", False] += n - k
                seen.add(f)
    out.update({(f"p|{f}", True): 1 for f in seen})
    for i, kind, n in found.each():
        for where in ("in" if found.inside(i) else "out", "hidden"):
            out[f"{where}|{kind}", bool(found.inside(i))] += n
    return out


def learned(counts: dict[tuple[str, bool], int], *, priors: bool = True) -> Weights:
    """Weights from counts, within their bounds."""
    kinds, odds = {}, {}
    for c in {c for c, _ in counts}:
        where, kind = c.split("|", 1)
        value = _odds(counts.get((c, True), 0), counts.get((c, False), 0))
        if where == "f":
            if counts.get((f"p|{kind}", True), 0) >= SUPPORT:
                odds[kind] = min(MOST_ODDS, max(-MOST_ODDS, value))
        elif where == "p":
            continue
        elif kind in ("word", "link") and where != "out":
            kinds[c] = min(MOST_WORD, max(LEAST_WORD, value))
        else:
            kinds[c] = min(MOST_TAG, max(LEAST_TAG, value))
    return Weights(kinds, odds, priors=priors)


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the greatest sum above 0, of several the one that ends first; (0, 0) if none is."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str, weights: Weights, *, hidden: bool = False) -> str:
    """The words of the best run of tokens. hidden: as if the page didn't label its article.

    A page all of whose words are left out by the names around them is taken without these.
    """
    for how in (weights, _BARE_MARKUP):
        found = Page(page, how)
        if hidden:
            found.label = None
        scoring = list(found.each())
        a, b = best_run([n * weights.token(kind, found.inside(i)) for i, kind, n in scoring])
        if a < b:
            return " ".join("".join(text for _, text in found.tokens[scoring[a][0] : scoring[b - 1][0] + 1]).split())
    return ""


def _counts(chosen: DataFrame, weights: Weights | None) -> dict[tuple[str, bool], int]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(counted(page or "", weights))
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])

    rows = written(chosen.mapInArrow(scan, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")))
    feature = F.substring_index("kind", "|", 1).isin("f", "p")
    often = rows.where(F.col("kind").startswith("p|") & (F.col("n") >= SUPPORT)).select(F.expr("substr(kind, 3)").alias("feature"))
    tags = "|".join(sorted(INLINE | VOID | USUAL_TAGS | MARKUP | set("div section ul ol li table thead tbody tr td th p article main details summary figure figcaption dl dt dd center html body h[1-6] pre blockquote hr address".split())))
    known = rows.where(~feature & F.col("kind").rlike(rf"^(in|out|hidden)\|(word|link|skip|(block|inline):/?({tags}))$"))
    kept = rows.where(feature).join(often, F.expr("substr(kind, 3)") == F.col("feature"), "left_semi")
    return {(r["kind"], r["inside"]): r["n"] for r in known.unionByName(kept).collect()}


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, sample: int = SAMPLE, priors: bool = True) -> Weights:
    """Weights from about `sample` of the pages; their features on SUPPORT pages or more go to the driver."""
    small_arrow_batches(pages.sparkSession, 256)
    whole = pages.count()
    places = 1 << 30
    cut = places if whole <= sample else int(places * sample / whole)
    chosen = written(pages.where(F.pmod(F.xxhash64(F.col(id_col), F.length(html_col)), F.lit(places)) < cut).select(F.col(html_col).cast("string").alias("html")))
    return learned(_counts(chosen, learned(_counts(chosen, None), priors=priors)), priors=priors)


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Rows (id, url, text, n_chars) for each row of `pages`."""
    small_arrow_batches(pages.sparkSession, 256)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p or "", weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["__id", "__url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).cast("string").alias("__url"), F.col(html_col).cast("string").alias("__html"))
    return own.mapInArrow(scan, "__id long, __url string, text string, n_chars long").withColumnsRenamed({"__id": id_col, "__url": url_col})
