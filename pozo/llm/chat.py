"""Chat formatting as a relational job: sort the turns of a conversation, merge
neighbours of one role, join the pieces. Spark expressions only.

A block holds neighbouring turns of one role::

    <s>[ROLE]user[/ROLE]first text[NEXT]second text</s>

Control strings inside roles and texts are broken by a backslash after their
first character, and those that already hold backslashes there get one more, so
:func:`read_back` finds the blocks and turns by the marks alone and restores
every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, ROLE_END, NEXT, END = "<s>[ROLE]", "[/ROLE]", "[NEXT]", "</s>"
# The template's marks and other strings that chat models treat as
# control tokens, each as first character and rest.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[NEXT]", "[INST]", "[/INST]", "[SYS]", "[/SYS]",
            "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_RESTS = "|".join("".join("\\" + x if x in "|[]" else x for x in c[1:]) for c in CONTROLS)
_ESCAPE = f"([<\\[])(\\\\*)({_RESTS})"
_UNESCAPE = f"([<\\[])\\\\(\\\\*)({_RESTS})"


def escape(c: Column) -> Column:
    """Put a backslash after the first character of every control string."""
    return F.regexp_replace(c, _ESCAPE, "$1\\\\$2$3")


def unescape(c: Column) -> Column:
    """Undo :func:`escape`."""
    return F.regexp_replace(c, _UNESCAPE, "$1$2$3")


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(id, formatted string, loss array): one row per conversation.

    ``loss`` is the loss mask in turns, one entry per turn: ``skip`` code points
    of marks since the text before, ``chars`` code points of the escaped text,
    ``train`` whether the role is ``trained``; the last end mark follows.

    Turns are sorted by turn (null first), then role, then text: ties and
    repeated rows have one result. A null role or text is empty. A null id is a
    conversation like any other. Other columns are not read; an empty table
    gives an empty result. A conversation is one row of the result, so one task
    holds the longest one; every step takes time in proportion to its length.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = (rows.select(F.col(id_col).alias("_id"), F.struct(
        F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("_t"))
        .groupBy("_id").agg(F.array_sort(F.collect_list("_t")).alias("t")))
    t = F.col("t")
    turns = turns.withColumn("first", F.filter(
        F.sequence(F.lit(0), F.size(t) - 1),
        lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"])))
    first = F.col("first")
    end_of = lambda k: F.coalesce(F.get(first, k + 1), F.size(t))
    blocks = F.transform(first, lambda i, k: F.struct(
        escape(F.get(t, i)["role"]).alias("role"),
        (F.get(t, i)["role"] == trained).alias("train"),
        F.transform(F.slice(t, i + 1, end_of(k) - i), lambda x: escape(x["text"])).alias("texts")))
    turns = turns.select("_id", blocks.alias("b"))
    formatted = F.array_join(F.transform("b", lambda b: F.concat(
        F.lit(BEGIN), b["role"], F.lit(ROLE_END), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    marks = len(BEGIN) + len(ROLE_END)
    loss = F.flatten(F.transform("b", lambda b, k: F.transform(b["texts"], lambda x, j: F.struct(
        F.when(j > 0, len(NEXT)).otherwise(
            F.char_length(b["role"]) + marks + F.when(k > 0, len(END)).otherwise(0)).alias("skip"),
        F.char_length(x).alias("chars"), b["train"].alias("train")))))
    return turns.select(F.col("_id").alias(id_col), formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns and loss text from :func:`format_conversations`: (id, turns, loss_text, mask_ok, formatted_chars).

    ``turns`` is an array of (role, text) found by the marks alone; ``loss_text`` the
    array of texts under the loss mask; ``mask_ok`` tells whether the mask's
    lengths are those of the string.
    """
    # split() drops nothing: what follows the last end mark is the empty string.
    blocks = F.filter(F.split("formatted", "</s>", -1), lambda b: b != "")
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring_index(b, ROLE_END, -1), "\\[NEXT\\]", -1),
        lambda x: F.struct(F.substring(F.substring_index(b, ROLE_END, 1), F.lit(len(BEGIN) + 1), F.char_length(b)).alias("role"),
                           x.alias("text")))))
    found = formatted.select(F.col(id_col).alias("_id"), "loss", turns.alias("raw"),
                             F.char_length("formatted").cast("long").alias("formatted_chars"))
    pairs = F.arrays_zip("raw", "loss")
    exact = F.forall(pairs, lambda p: p["raw"]["text"].isNotNull() & (F.char_length(p["raw"]["text"]) == p["loss"]["chars"]))
    total = F.aggregate("loss", F.lit(0).cast("long"), lambda a, x: a + x["skip"] + x["chars"])
    under = F.transform(F.filter(pairs, lambda p: p["loss"]["train"]), lambda p: unescape(p["raw"]["text"]))
    return found.select(
        F.col("_id").alias(id_col),
        F.transform("raw", lambda r: F.struct(unescape(r["role"]).alias("role"), unescape(r["text"]).alias("text"))).alias("turns"),
        under.alias("loss_text"),
        (exact & (total + len(END) == F.col("formatted_chars"))).alias("mask_ok"),
        "formatted_chars")


def digest(back: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and hashes of what :func:`read_back` found."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_text", "")
    return back.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "mask_ok")
