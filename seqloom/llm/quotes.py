"""Quotation linking: conversations in reply order, without quotes; DataFrame operations only.

A line that begins with one or more '>' is quoted, once for each of them. A passage is a run of lines of one
level in one message. Lines and whole passages are normalised (lower case, single spaces) and hashed, and so
are the unquoted lines and the whole unquoted body of every message. A hash belongs to the earliest message of
the conversation that holds it unquoted, which is its original; a quote is linked to its original if that is an
earlier message. A message replies to the original of most of its quoted characters at level 1, the latest
of several; deeper levels are linked as well and count but don't decide. Unlinked messages start a thread.

Each conversation's hashes are pre-aggregated to one row for each hash, so frequent passages and very long
conversations meet no partner more than once, and no conversation is gathered. The reply path is found by
doubling: each round every message takes over the path of the message that its path begins with. Sorting by
(conv_id, path) gives the reply order: threads by their first turn, replies below what they answer.

Quoted lines and the line that introduces a quote ("... wrote:") leave the text; other text stays
as it is, trimmed. Null text is empty; a null conversation is a conversation, and messages with a null
turn are never linked. Repeated rows give a row each and rows with one (conv_id, turn) share their quotes and
reply; a message with quotes only has text ''. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SPACES, written

#: Reply chains of up to 2**ROUNDS messages.
ROUNDS = 40
MARKS = r"^[ \t]*(?:>[ \t]?)+"
INTRO = r"(?i)^.*\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:[ \t\r]*$"
CONV = "__conv"


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def _parsed(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """`messages` with __conv, __turn, __body and, where a line is quoted, __lines: (level, text without marks, intro) of each."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    conversation = F.when(F.col(conv).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    raw = messages.withColumns({CONV: conversation, "__turn": F.col(turn).cast("long"), "__body": body})
    lines = F.transform(F.split("__body", "\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("text")))
    out = raw.withColumn("__lines", F.when(F.col("__body").rlike(r"(?m)^[ \t]*>"), lines))
    # the next line that isn't blank is quoted deeper: a line like "A wrote:" introduces it
    def intro(x: Column, i: Column) -> Column:
        after = lambda k: F.get(F.col("__lines"), i + k)
        blank = lambda y: F.btrim(y["text"], F.lit(SPACES)) == ""
        follows = F.coalesce(F.when(blank(after(1)) & (after(1)["level"] == x["level"]), after(2)["level"]).otherwise(after(1)["level"]), F.lit(0))
        return F.struct(x["level"].alias("level"), x["text"].alias("text"), ((follows > x["level"]) & x["text"].rlike(INTRO)).alias("intro"))

    return out.withColumn("__lines", F.transform("__lines", intro))


def _keys(parsed: DataFrame) -> DataFrame:
    """Rows (__conv, __turn, level, chars, k1, k2): hashes of lines and of whole passages."""
    plain = F.transform(F.split("__body", "\n"), lambda x: F.struct(F.lit(0).alias("level"), x.alias("text"), F.lit(False).alias("intro")))
    own = parsed.select(CONV, "__turn", F.coalesce(F.filter("__lines", lambda x: ~x["intro"]), plain).alias("__own"))
    level = lambda i: F.get(F.col("__own"), i)["level"]
    changes = F.filter(F.sequence(F.lit(0), F.size("__own")), lambda i: (i == F.size("__own")) | (i == 0) | (level(i) != level(i - 1)))
    own = own.withColumn("__starts", changes)

    def passage(i: Column, k: Column) -> Column:
        run = F.slice("__own", i + 1, F.get(F.col("__starts"), k + 1) - i)
        return F.struct(level(i).alias("level"), F.array_join(F.transform(run, lambda x: x["text"]), " ").alias("text"))

    passages = F.transform(F.slice("__starts", 1, F.size("__starts") - 1), passage)
    body = F.array_join(F.transform(F.filter("__own", lambda x: x["level"] == 0), lambda x: x["text"]), " ")
    single = F.transform("__own", lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text")))
    units = F.concat(single, F.when(F.size("__own") > 0, passages).otherwise(F.slice(single, 1, 0)), F.array(F.struct(F.lit(0).alias("level"), body.alias("text"))))
    rows = own.select(CONV, "__turn", F.explode(units).alias("u")).select(CONV, "__turn", "u.level", normalised(F.col("u.text")).alias("key"))
    rows = rows.where(F.length("key") > 0)
    return rows.select(CONV, "__turn", "level", F.length("key").alias("chars"), F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def _replies(parsed: DataFrame) -> DataFrame:
    """Rows (__conv, __turn, n_linked, reply_to) for the messages with a linked quote.

    Messages without quotes are hashed only if there are quotes at all, and of their hashes only those that are quoted go on.
    """
    known = parsed.where(F.col("__turn").isNotNull())
    quotes = written(_keys(known.where(F.col("__lines").isNotNull())).where("level > 0").groupBy(CONV, "__turn", "level", "k1", "k2").agg(F.max("chars").alias("chars")))
    if quotes.isEmpty():
        return quotes.select(CONV, "__turn", F.lit(0).cast("long").alias("n_linked"), F.col("__turn").alias("reply_to"))
    wanted = quotes.select(CONV, "k1", "k2").distinct()
    originals = _keys(known).where("level = 0").join(wanted, [CONV, "k1", "k2"], "left_semi").groupBy(CONV, "k1", "k2").agg(F.min("__turn").alias("__from"))
    linked = quotes.join(originals, [CONV, "k1", "k2"]).where(F.col("__from") < F.col("__turn"))
    by_original = linked.groupBy(CONV, "__turn", "__from").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("level") == 1, F.col("chars"))), F.lit(0)).alias("chars"))
    best = F.max(F.when(F.col("chars") > 0, F.struct("chars", "__from")))["__from"]
    return by_original.groupBy(CONV, "__turn").agg(F.sum("n").alias("n_linked"), best.alias("reply_to"))


def _paths(turns: DataFrame) -> DataFrame:
    """Rows (__conv, __turn, path): from the thread's first message to this one; turns: (__conv, __turn, reply_to)."""
    alone = turns.where(F.col("reply_to").isNull()).select(CONV, "__turn", F.array("__turn").alias("path"))
    now = written(turns.where(F.col("reply_to").isNotNull()).select(CONV, "__turn", F.col("reply_to").alias("__up"), F.array("__turn").alias("path")))
    done = alone
    for _ in range(ROUNDS):
        if now.isEmpty():
            break
        ahead = now.select(F.col(CONV), F.col("__turn").alias("__up"), F.col("__up").alias("__next"), F.col("path").alias("__before"))
        known = ahead.unionByName(done.select(F.col(CONV), F.col("__turn").alias("__up"), F.lit(None).cast("long").alias("__next"), F.col("path").alias("__before")))
        step = written(now.join(known, [CONV, "__up"]).select(CONV, "__turn", F.col("__next").alias("__up"), F.concat("__before", "path").alias("path")))
        done = done.unionByName(step.where(F.col("__up").isNull()).select(CONV, "__turn", "path"))
        now = step.where(F.col("__up").isNotNull())
    return done


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text without quotes, n_quoted, n_linked, reply_to, path) for each row of `messages`.

    n_quoted: quoted lines; n_linked: different quoted lines and passages with an original; path: turns from
    the thread's first message to this one; sort by (conv_id, path).
    """
    parsed = _parsed(messages.select(conv_col, turn_col, role_col, text_col), conv_col, turn_col, text_col)
    replies = _replies(parsed)
    turns = written(parsed.where(F.col("__turn").isNotNull()).select(CONV, "__turn").distinct().join(replies, [CONV, "__turn"], "left"))
    placed = turns.join(_paths(turns.select(CONV, "__turn", "reply_to")), [CONV, "__turn"])
    kept = F.array_join(F.transform(F.filter("__lines", lambda x: (x["level"] == 0) & ~x["intro"]), lambda x: x["text"]), "\n")
    kept = F.when(F.col("__lines").isNull(), F.col("__body")).otherwise(kept)
    out = parsed.join(placed, [CONV, "__turn"], "left")
    return out.select(
        F.col(conv_col),
        F.col(turn_col),
        F.col(role_col),
        F.btrim(kept, F.lit(SPACES)).alias("text"),
        F.when(F.col("__lines").isNull(), 0).otherwise(F.size(F.filter("__lines", lambda x: x["level"] > 0))).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        F.coalesce("path", F.array().cast("array<bigint>")).alias("path"),
    )
