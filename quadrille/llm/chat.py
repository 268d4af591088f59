"""Chat formatting: typed content parts, a reversible template, and a loss mask.

A turn has a role and parts of type text, image, audio or document.  The visitor
writes text parts with their control strings escaped and every other part as a
placeholder, in order; it records a reference to each attachment and the tokens that its
placeholder expands to.  Adjacent text parts are one text before they are escaped.  A control
string inside a text gets one backslash more than twice those before it: an odd number.  A marker of
the template has a blank before it; a placeholder gets twice the backslashes that the text
before it ends in: an even number.  So every text is read back exactly, and ``placeholders`` finds those
that stand for attachments.

Rows are ordered by turn, then role and parts; null texts, roles and parts are
empty, and null conversations are one conversation.  Only column expressions are used.  A
conversation is one string and one digest, so it is put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START = "<s>"
#: Control strings of the template and of attachments.
CONTROL = r"</?s>|\[/?(?:INST|TURN|TEXT)\]|\[(?:IMAGE|AUDIO|DOCUMENT)\]"
#: Kinds of attachment, their placeholders, and the tokens that one expands to where its part doesn't say.
PLACEHOLDERS = {"image": ("[IMAGE]", 576), "audio": ("[AUDIO]", 750), "document": ("[DOCUMENT]", 1024)}
PART = "struct<type:string,text:string,ref:string,n_tokens:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"$1$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*)\1\\?({CONTROL})", "$1$2")


def placeholders(shown: Column) -> Column:
    """The placeholders of a formatted text that stand for attachments, in order."""
    return F.regexp_extract_all(shown, F.lit(r"(?<!\\)(?:\\\\)*(\[(?:IMAGE|AUDIO|DOCUMENT)\])"), 1)


def text_parts(text: Column) -> Column:
    """A turn's parts where it is text alone."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens")))


def _shown(parts: Column) -> Column:
    """The visitor: texts are gathered up to the next attachment, or the end, and then escaped."""

    def visit(s: Column, part: Column) -> Column:
        mark = F.lit(None).cast("string")
        for kind, (shown, _) in PLACEHOLDERS.items():
            mark = F.when(part["type"] == kind, F.lit(shown)).otherwise(mark)
        # backslashes at the end are doubled, so those before a placeholder are even
        closed = F.regexp_replace(escape(s["open"]), r"(\\+)$", "$1$1")
        done = F.when(mark.isNull(), s["done"]).otherwise(F.concat(s["done"], closed, mark))
        return F.struct(done.alias("done"), F.when(mark.isNull(), F.concat(s["open"], F.coalesce(part["text"], F.lit("")))).otherwise("").alias("open"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    return F.aggregate(parts, start, visit, lambda s: F.concat(s["done"], escape(s["open"])))


def _tokens(part: Column) -> Column:
    usual = F.lit(0)
    for kind, (_, n) in PLACEHOLDERS.items():
        usual = F.when(part["type"] == kind, F.lit(n)).otherwise(usual)
    return F.coalesce(part["n_tokens"], usual)


def flatten(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, content, attachments)`` of ``(conv_id, turn, role, parts)``: the visitor's pass over the parts of each turn."""
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    kinds = F.filter(parts, lambda p: p["type"].isin(*PLACEHOLDERS))
    attachments = F.transform(kinds, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("n_tokens")))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), _shown(parts).alias("content"), attachments.alias("attachments"))


def formatted(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Format conversations: ``(conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens)``.

    ``loss_spans`` are the starts (from 0) and lengths, in code points of ``formatted``, of the
    turns to learn.  ``attachments`` are in the order of their placeholders.
    """
    flat = flatten(turns)
    role, content = F.col("role"), F.col("content")
    before = F.when(role == "user", F.lit("[INST] ")).when(role == "assistant", F.lit(" ")).otherwise(F.concat(F.lit("[TURN] "), escape(role), F.lit(" [TEXT] ")))
    after = F.when(role == "user", F.lit(" [/INST]")).when(role == "assistant", F.lit(" </s>")).otherwise(F.lit(" [/TURN]"))
    flat = flat.select("conv_id", "turn", "role", "attachments", F.length(before).alias("head"), F.length(content).alias("size"), F.concat(before, content, after).alias("shown"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "shown")
    place = F.coalesce(F.sum(F.length("shown")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + len(START)
    flat = flat.select("conv_id", F.row_number().over(order).alias("at"), "shown", "attachments", F.when(F.col("role") == learn_role, F.struct((place + F.col("head")).alias("start"), F.col("size").cast("long").alias("length"))).alias("span"))
    out = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "shown", "attachments", "span"))).alias("t"))
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.concat(F.lit(START), F.array_join(F.col("t.shown"), "")).alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("t.attachments")).alias("attachments"),
        F.aggregate(F.flatten(F.col("t.attachments")), F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("expanded_tokens"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted string: an array of ``(role, text)``; placeholders stand in the texts."""
    user, other, own = r"\[INST\] (?s:.*?) \[/INST\]", r"\[TURN\] (?s:.*?) \[/TURN\]", r" (?s:.*?) </s>"
    found = F.regexp_extract_all(F.substring(text, len(START) + 1, 2**31 - 1), F.lit(f"{user}|{other}|{own}"), 0)

    def turn(x: Column) -> Column:
        inner = lambda a, b: F.substring(x, a + 1, F.length(x) - a - b)
        named = inner(7, 8)
        cut = F.locate(" [TEXT] ", named)
        return (
            F.when(x.startswith("[INST] "), F.struct(F.lit("user").alias("role"), unescape(inner(7, 8)).alias("text")))
            .when(x.startswith("[TURN] "), F.struct(unescape(F.substring(named, 1, cut - 1)).alias("role"), unescape(F.substring(named, cut + 8, 2**31 - 1)).alias("text")))
            .otherwise(F.struct(F.lit("assistant").alias("role"), unescape(inner(1, 5)).alias("text")))
        )

    return F.transform(found, turn)


def under_mask(text: Column, spans: Column) -> Column:
    """The unescaped text that a loss mask covers, nothing between its spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(done: DataFrame) -> DataFrame:
    """What the contract asks of formatted conversations, read back from the output."""
    turns = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.withColumn("learned", under_mask(F.col("formatted"), F.col("loss_spans")))
    return done.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )
