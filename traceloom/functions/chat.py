"""Chat messages as arrays of (role, content)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.text import rstrip, strip, truncate_text

MESSAGES = "array<struct<role: string, content: string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render_template(template: str, **slots: Column) -> Column:
    """Fill the {name} slots of a template; a slot without a column is an error. {{ and }} stand for braces."""
    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{\w+\}", piece):
            if piece[1:-1] not in slots:
                raise ValueError(f"no column for the template slot {piece}")
            parts.append(slots[piece[1:-1]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def chat_messages(system: str, user: str, **slots: Column) -> Column:
    """System message, where it is not blank, and the filled user message."""
    asked = message("user", render_template(user, **slots))
    return F.array(message("system", F.lit(system)), asked) if system.strip() else F.array(asked)


def conversation_tail(messages: Column, n: int, max_chars: int) -> Column:
    start = F.greatest(F.size(messages) - n + 1, F.lit(1))
    return F.transform(
        F.slice(messages, start, n),
        lambda m: F.struct(m["role"].alias("role"), truncate_text(m["content"], max_chars).alias("content")),
    )


def format_conversation(messages: Column) -> Column:
    """A heading per turn with its text under it."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_join(
        F.transform(
            messages,
            lambda m, i: rstrip(
                F.concat(
                    F.lit("### "),
                    F.when(blank(m["role"]), F.concat(F.lit("message_"), (i + 1).cast("string"))).otherwise(m["role"]),
                    F.lit("\n"),
                    F.coalesce(m["content"], F.lit("")),
                )
            ),
        ),
        "\n\n",
    )


def quarter_length(c: Column) -> Column:
    """Rough token count: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def prompt_tokens(messages: Column, counter=quarter_length) -> Column:
    return F.aggregate(messages, F.lit(0), lambda total, m: total + counter(m["content"]))


def trim_conversation(messages: Column, budget: int, counter=quarter_length, keep: int = 4) -> Column:
    """Drop the messages after the first one until the rest fits, never going below ``keep`` messages."""
    n = F.size(messages)
    sizes = F.transform(messages, lambda m: counter(m["content"]))
    total = F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    start = F.struct(total.alias("left"), F.lit(0).alias("dropped"))
    droppable = F.slice(sizes, F.lit(2), F.greatest(n - keep, F.lit(0)))
    end = F.aggregate(
        droppable,
        start,
        lambda acc, size: F.when(acc["left"] <= budget, acc).otherwise(
            F.struct((acc["left"] - size).alias("left"), (acc["dropped"] + 1).alias("dropped"))
        ),
    )
    rest = F.slice(messages, end["dropped"] + 2, F.greatest(n - 1 - end["dropped"], F.lit(0)))
    return F.when(n <= keep, messages).otherwise(F.concat(F.slice(messages, 1, 1), rest))


def retry_message(error: Column, max_chars: int = 1200) -> Column:
    """User turn that reports a failed check, at most ``max_chars`` of it."""
    return message(
        "user",
        F.concat(
            F.lit("The previous proof did not verify. Keep the statement; correct only the proof.\n\nChecker output:\n"),
            truncate_text(F.coalesce(error, F.lit("")), max_chars),
        ),
    )
