"""Quotation links against a plain linker over made threads, and recall of planted personal data."""

import random
import re
from itertools import groupby

from seqloom.llm import pii, quotes
from tests.llm.test_operators import by_id, docs, sentence

MARKS = re.compile(r"^[ \t]*(?:>[ \t]?)+")


def parsed(text):
    """(level, text) of each line without the lines that introduce a quote; whether any line is quoted."""
    lines = []
    for x in text.split("\n"):
        m = MARKS.match(x)
        lines.append((m[0].count(">") if m else 0, x[m.end() :] if m else x))
    if not any(level for level, _ in lines):
        return lines, False
    kept = []
    for i, (level, t) in enumerate(lines):
        after = lines[i + 1 : i + 3]
        if after and not after[0][1].strip() and after[0][0] == level:
            after = after[1:]
        intro = after and after[0][0] > level and re.search(r"(?i)^.*\b(?:wrote|said)\s*:[ \t]*$", t)
        if not intro:
            kept.append((level, t))
    return kept, True


def key(t):
    return re.sub(r"[ \t-\r]+", " ", t).strip(" ").lower()


def units(lines):
    """(level, key) of lines and passages, and the key of the whole unquoted body at level 0."""
    out = {(level, key(t)) for level, t in lines}
    for level, run in groupby(lines, key=lambda x: x[0]):
        out.add((level, key(" ".join(t for _, t in run))))
    out.add((0, key(" ".join(t for level, t in lines if not level))))
    return {x for x in out if x[1]}


def linked(conversation):
    """turn -> (quoted lines, links, reply_to, path) of {turn: text}."""
    own = {t: units(parsed(x)[0]) for t, x in conversation.items()}
    first = {}
    for t in sorted(conversation, reverse=True):
        for level, k in own[t]:
            if not level:
                first[k] = t
    out = {}
    for t in sorted(conversation):
        quoted = sum(bool(re.match(r"[ \t]*>", x)) for x in conversation[t].split("\n"))
        found = [(level, k, first[k]) for level, k in own[t] if level and first.get(k, t) < t]
        chars = {}
        for level, k, o in found:
            if level == 1:
                chars[o] = chars.get(o, 0) + len(k)
        reply = max(((n, o) for o, n in chars.items() if n), default=(0, None))[1]
        out[t] = (quoted, len(found), reply, [*(out[reply][3] if reply is not None else []), t])
    return out


def threads(seed, conversations, most):
    r = random.Random(seed)
    out = {}
    for c in range(conversations):
        told = {}
        for t in range(r.randint(1, most)):
            text = "\n".join(sentence(r, r.randint(1, 7), 12) for _ in range(r.randint(1, 4)))
            if told and r.random() < 0.8:
                quoted = [f"> {x}" if not x.startswith(">") else f">{x}" for x in told[r.choice(list(told))].split("\n")]
                if r.random() < 0.4:
                    quoted = quoted[r.randrange(len(quoted)) :]
                if r.random() < 0.3:
                    quoted = [x.upper() if r.random() < 0.5 else x.replace(" ", "  ") for x in quoted]
                head = r.choice(["", "somebody wrote:\n", "A said:\n\n"])
                text = head + "\n".join(quoted) + "\n" + text if r.random() < 0.7 else text + "\n" + head + "\n".join(quoted)
            told[t] = text
        out[c] = told
    return out


def test_made_threads(spark):
    made = threads(1, 300, 12)
    rows = [(c, t, "user", x) for c, told in made.items() for t, x in told.items()]
    got = {(x.conv_id, x.turn): (x.n_quoted, x.n_linked, x.reply_to, list(x.path)) for x in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {(c, t): x for c, told in made.items() for t, x in linked(told).items()}
    assert got == want
    assert sum(x[2] is not None for x in want.values()) > 1000 and max(len(x[3]) for x in want.values()) > 6


def test_a_long_chain_of_replies(spark):
    made = {0: {}}
    r = random.Random(2)
    for t in range(60):
        made[0][t] = (f"> {made[0][t - 1].split(chr(10))[-1]}\n" if t else "") + sentence(r, 30, 4000)
    rows = [(0, t, "user", x) for t, x in made[0].items()]
    got = {x.turn: list(x.path) for x in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {t: list(range(t + 1)) for t in range(60)}


def test_planted_secrets(spark):
    """Spans that no base pattern finds, planted in plain prose with numbers and long words that are none."""
    r = random.Random(3)
    hexa = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    makers = [
        ("secret", lambda: hexa(40), 'token = "{}"'),
        ("secret", lambda: "sk" + mixed(30), "api_key={}"),
        ("secret", lambda: hexa(32), "password: {}"),
        ("number", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", "phone: {}"),
        ("number", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "ssn: {}"),
        ("mail", lambda: f"{mixed(6)} [at] {r.choice(['example', 'mail'])} [dot] {r.choice(['org', 'com'])}", "mail: {}"),
    ]
    innocent = ["see page 12.345.678 there", "a-rather-long-word-with-many-parts here", "chapter 10.20.300 of it", "supercalifragilisticexpialidocious", "https/very/long/path/without/numbers"]
    texts, planted = [], []
    for i in range(1500):
        words = sentence(r, 20, 90).split()
        spans = []
        if i % 3:
            kind, make, frame = r.choice(makers)
            secret = make()
            head = " ".join(words[:10]) + " "
            text = head + frame.format(secret) + " " + " ".join(words[10:])
            spans.append((kind, text.index(secret), text.index(secret) + len(secret)))
        else:
            text = " ".join([*words[:10], r.choice(innocent), *words[10:]])
        texts.append(text)
        planted.append(spans)
    got = by_id(pii.find_pii(docs(spark, texts)))
    caught = sum(any(x.begin <= a and b <= x.end for x in got[i].added) for i, s in enumerate(planted) for _, a, b in s)
    whole = sum(map(len, planted))
    clean = [i for i, s in enumerate(planted) if not s]
    wrong = sum(bool(got[i].added) for i in clean)
    missed = [texts[i][a - 12 : b + 2] for i, s in enumerate(planted) for _, a, b in s if not any(x.begin <= a and b <= x.end for x in got[i].added)]
    print(missed[:20])
    assert caught >= 0.9 * whole and wrong <= 0.02 * len(clean), (caught, whole, wrong, len(clean))
    for kind in ("secret", "number", "mail"):
        own = [(i, s[0]) for i, s in enumerate(planted) if s and s[0][0] == kind]
        assert sum(any(x.begin <= a and b <= x.end for x in got[i].added) for i, (_, a, b) in own) >= 0.9 * len(own), kind


def test_no_text_is_quoted_or_secret(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.link_quotes(empty).count() == 0
    long = docs(spark, ["a@b.c " * 20_000, "1.2.3.4 " * 20_000])
    assert sorted(len(x.base) for x in pii.find_pii(long).collect()) == [20_000, 20_000]
