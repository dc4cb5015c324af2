"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is an array of parts ``struct<type, text, uri, tokens>``.  The
visitor ``visit`` flattens them in order: text is escaped, an attachment
(image, audio, document) becomes a numbered placeholder whose reference and
expanded token count are recorded.  A turn is ``<s>role[INST]content[/INST]</s>``.

Escaping is reversible: a backslash goes in after the bracket of anything in a
text that could pass for a control string, however many backslashes are there
already, and unescaping takes one away.  Neighbouring text parts are escaped as
one, so no control string arises across them.

The loss mask is the array of spans (code points, end exclusive) of assistant
content in the formatted text.

Defined results: null text, parts, role and uri are empty; turns with equal
numbers are ordered by role and content; null turn numbers come first; repeated
rows are turns of their own; an empty table gives an empty result; other
columns are not read.  A conversation is one output row, so its own size, not
the number of conversations, is what must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, CONTENT, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_TAIL = r"(?=/?(?:s>|INST\]|IMAGE:|AUDIO:|DOCUMENT:))"
#: Tokens that an attachment stands for where its part names none.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}
PART = "struct<type:string,text:string,uri:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2")


def text_part(text: Column) -> Column:
    """A plain text as parts."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("bigint").alias("tokens")))


def visit(parts: Column) -> Column:
    """struct<content, attachments>: the parts flattened into text.

    attachments: array of (type, uri, place, tokens) in order; place is the
    placeholder's number in the turn.
    """
    none = F.array().cast("array<struct<type:string,uri:string,place:int,tokens:bigint>>")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"), none.alias("seen"))
    cost = F.create_map(*[F.lit(x).cast("string") if isinstance(x, str) else F.lit(x).cast("bigint") for kv in EXPANDED.items() for x in kv])

    def step(acc: Column, p: Column) -> Column:
        kind = F.lower(F.coalesce(p["type"], F.lit("text")))
        place = F.size(acc["seen"])
        mark = F.concat(F.lit("["), F.upper(kind), F.lit(":"), place.cast("string"), F.lit("]"))
        ref = F.struct(kind.alias("type"), F.coalesce(p["uri"], F.lit("")).alias("uri"), place.alias("place"), F.coalesce(p["tokens"], F.try_element_at(cost, kind), F.lit(0)).cast("bigint").alias("tokens"))
        return F.when(
            kind.isin(*EXPANDED),
            F.struct(F.concat(acc["done"], escape(acc["text"]), mark).alias("done"), F.lit("").alias("text"), F.concat(acc["seen"], F.array(ref)).alias("seen")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["text"], F.coalesce(p["text"], F.lit(""))).alias("text"), acc["seen"].alias("seen")))

    return F.aggregate(
        F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, step,
        lambda acc: F.struct(F.concat(acc["done"], escape(acc["text"])).alias("content"), acc["seen"].alias("attachments")),
    )


def format_conversations(rows: DataFrame, *, parts: Column | None = None, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: id, formatted, loss_spans, attachments (with
    their turn's place), n_turns, expanded_tokens.

    ``rows``: conv_id, turn, role and either ``text`` or a ``parts`` column."""
    content = visit(text_part(F.col("text")) if parts is None else parts)
    turns = rows.select(
        F.col(conv).alias("conv_id"), F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), content.alias("c")).alias("t")
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    shown = whole.withColumn(
        "shown",
        F.transform("turns", lambda t: F.struct(
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(CONTENT)).alias("head"), t["c"]["content"].alias("body"), (t["role"] == "assistant").alias("loss"))),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    tail = len(CLOSE) + len(END)
    spans = F.aggregate(
        F.col("shown"), F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + tail).cast("bigint").alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.char_length(t["head"])).cast("bigint").alias("start"), (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"])).cast("bigint").alias("end")))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE), F.lit(END))), "")
    attachments = F.flatten(F.transform("turns", lambda t, k: F.transform(t["c"]["attachments"], lambda a: F.struct(k.alias("turn_place"), a["type"].alias("type"), a["uri"].alias("uri"), a["place"].alias("place"), a["tokens"].alias("tokens")))))
    out = shown.select(
        "conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"), F.size("turns").cast("long").alias("n_turns")
    )
    return out.withColumn("expanded_tokens", F.aggregate(F.col("attachments"), F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation without attachments."""
    turns = F.filter(F.split(formatted, F.lit(END)), lambda t: t != "")
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(F.substr(t, F.lit(len(TURN) + 1)), CONTENT, 1)).alias("role"),
        unescape(F.substr(F.substring_index(t, CLOSE, 1), F.instr(t, F.lit(CONTENT)) + len(CONTENT))).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from ``format_conversations``' output."""
    turns = read_back(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    out = formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.size("loss_spans").alias("n_loss"), "expanded_tokens")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
