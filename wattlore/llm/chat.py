"""Chat formatting with Spark expressions only: conversations of turn rows become one training text each, reversibly.

A block of adjacent turns with one role is ``<s>[ROLE]role[/ROLE]text[TURN]text</s>``. Control strings inside roles and texts
get a backslash after their first character, one more than they had, so no text can open or close a turn and reading takes
exactly one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What marks turns, and the control strings of a common public chat template, which are escaped too.
CONTROLS = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[TURN]", "[INST]", "[/INST]"]
_ANY = r"([<\[])(\\*)((?:/?s>)|(?:/?(?:ROLE|INST)\])|(?:TURN\]))"
_ESCAPED = r"([<\[])\\(\\*)((?:/?s>)|(?:/?(?:ROLE|INST)\])|(?:TURN\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ANY, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted, and loss_spans (start, length in code points of formatted).

    turns: conv_id, turn, role, text. Null text and null role are empty; rows with equal turn follow in order of role and
    text; rows that repeat are turns each; a null conv_id is a conversation of its own. Each text of loss_role is one
    span, as it stands in formatted (escaped). A conversation is one output value, so one row holds it.
    """
    part = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    chats = turns.select("conv_id", part.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    is_first = lambda i: (i == 0) | (F.col("t")[i]["role"] != F.col("t")[F.greatest(i - 1, F.lit(0))]["role"])
    chats = chats.withColumn("first", F.filter(F.sequence(F.lit(0), F.size("t") - 1), is_first))

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("first"), k + 1), F.size("t"))
        return F.struct(
            F.col("t")[start]["role"].alias("role"),
            F.transform(F.slice("t", start + 1, end - start), lambda x: escape(x["text"])).alias("texts"),
        )

    chats = chats.select("conv_id", F.transform("first", block).alias("blocks"))
    head = lambda b: F.concat(F.lit("<s>[ROLE]"), escape(b["role"]), F.lit("[/ROLE]"))
    said = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], "[TURN]"), F.lit("</s>")))
    no_spans = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def span(acc: Column, text: Column) -> Column:
        n = F.length(text).cast("long")
        return F.struct((acc["at"] + n + len("[TURN]")).alias("at"), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), n.alias("length")))).alias("spans"))

    def over(acc: Column, b: Column) -> Column:
        at = acc["at"] + F.length(head(b))
        found = F.aggregate(b["texts"], F.struct(at.alias("at"), no_spans.alias("spans")), span)
        end = found["at"] - len("[TURN]") + len("</s>")
        spans = F.when(b["role"] == loss_role, F.concat(acc["spans"], found["spans"])).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    spans = F.aggregate("blocks", F.struct(F.lit(0).cast("long").alias("at"), no_spans.alias("spans")), over)["spans"]
    return chats.select("conv_id", F.array_join(said, "").alias("formatted"), spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read format_chats' texts back: conv_id, turns (role, text), loss_text, formatted."""
    blocks = F.filter(F.split("formatted", "</s>", -1), lambda b: b != "")
    role = lambda b: unescape(F.regexp_extract(b, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1))
    body = lambda b: F.regexp_replace(b, r"(?s)^<s>\[ROLE\].*?\[/ROLE\]", "")
    of = lambda b: F.transform(F.split(body(b), r"\[TURN\]", -1), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))
    at = lambda s: F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))
    return formatted.select(
        "conv_id", "formatted", F.flatten(F.transform(blocks, of)).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(at(s))), "").alias("loss_text"),
    )


def chat_digest(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of read_chats' rows."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
