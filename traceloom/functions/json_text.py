"""Getting JSON out of model answers, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.rows import bind
from traceloom.functions.text import is_blank, strip

RELAXED_JSON = {
    "mode": "PERMISSIVE",
    "allowSingleQuotes": "true",
    "allowUnquotedFieldNames": "true",
    "allowComments": "true",
    "allowNonNumericNumbers": "true",
    "allowBackslashEscapingAnyCharacter": "false",
}


def _last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def _fenced(text: Column, tag: str) -> Column:
    """Body of the last fence that opens an object, else of the last fence, else null."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)```{tag}\s*\n?(.*?)\n?```"), F.lit(1)), strip)
    return bind(bodies, lambda found: F.coalesce(_last(F.filter(found, lambda b: b.startswith("{"))), _last(found)))


def first_balanced_object(text: Column) -> Column:
    """First {...} whose braces balance; one step per brace, not per character."""
    tail = F.when(text.contains("{"), F.substring(text, F.locate("{", text), F.length(text)))
    pieces = F.split(tail, r"(?<=[{}])")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

    def step(acc: Column, piece: Column) -> Column:
        depth = (
            acc["depth"]
            + F.when(piece.endswith("{"), 1).otherwise(0)
            - F.when(piece.endswith("}"), 1).otherwise(0)
        )
        moved = F.struct(
            depth.alias("depth"),
            (acc["size"] + F.length(piece)).alias("size"),
            (piece.endswith("}") & (depth == 0)).alias("closed"),
        )
        return F.when(acc["closed"], acc).otherwise(moved)

    end = F.aggregate(pieces, start, step)
    return F.when(end["closed"], F.left(tail, end["size"]))


def searched_text(c: Column) -> Column:
    """The part of a model answer in which a JSON block is looked for: what follows the thinking part."""
    after = F.substring_index(c, "</think>", -1)
    without = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    return F.when(c.contains("</think>"), after).when(~is_blank(without), without).otherwise(c)


def extract_json_block(c: Column) -> Column:
    """JSON text of a model answer: after the thinking part, fenced if possible; null when there is none."""
    return bind(searched_text(c), lambda t: F.coalesce(_fenced(t, "json"), _fenced(t, ""), first_balanced_object(t)))


def is_strict_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def repair_backslashes(c: Column) -> Column:
    """Double the lone backslashes that TeX leaves in JSON strings."""
    # Commands that get one more backslash than the rest.
    doubled = F.regexp_replace(c, r"\\\\", r"\\")
    doubled = F.replace(doubled, F.lit("\\in"), F.lit("\\\\in"))
    doubled = F.replace(doubled, F.lit("\\Q"), F.lit("\\\\Q"))
    doubled = F.replace(doubled, F.lit("\\int"), F.lit("\\\\int"))
    doubled = F.replace(doubled, F.lit("\\mathbb{Q}"), F.lit("\\\\mathbb{Q}"))
    return F.replace(doubled, F.lit("\\"), F.lit("\\\\"))


QUOTED = r"""("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')"""


def drop_comments(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?s){QUOTED}|//[^\n]*|/\*.*?\*/", "$1")


def drop_trailing_commas(c: Column) -> Column:
    """Remove commas before a closing bracket, leaving quoted text alone."""
    return F.regexp_replace(c, rf"{QUOTED}|,(\s*[}}\]])", "$1$2")


def readable_json(c: Column) -> Column:
    """The block as it is when valid, else repaired for the relaxed reader."""
    return bind(c, lambda t: F.when(is_strict_json(t), t).otherwise(drop_trailing_commas(drop_comments(repair_backslashes(t)))))


def parse_llm_json(c: Column, schema: str, corrupt: str = "_unreadable") -> Column:
    """Parse an answer into ``schema``; null when it holds no readable JSON object."""
    parsed = F.from_json(
        readable_json(extract_json_block(c)),
        f"struct<{schema}, {corrupt}: string>",
        {**RELAXED_JSON, "columnNameOfCorruptRecord": corrupt},
    )
    return F.when(parsed.isNotNull() & parsed[corrupt].isNull(), parsed.dropFields(corrupt))


LEFT = r"(?<![\w.$])"
# A piece of relaxed JSON: a quoted text, a comment, a number of any form, or what lies between.
PIECE = rf"(?s)\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|//[^\n]*|/\*.*?\*/|{LEFT}[+-]?0[xX][0-9a-fA-F]+|{LEFT}[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[^\"'/0-9.+-]+|."


def strict_pieces(c: Column) -> Column:
    """Relaxed JSON piece by piece as strict: comments go, texts get double quotes and only the escapes that strict JSON has, numbers lose
    a plus sign, get a digit on both sides of the point, and hexadecimal ones become decimal. Bare names and commas stay as they are."""

    def text(piece: Column) -> Column:
        body = F.substring(piece, F.lit(2), F.length(piece) - 2)
        units = F.regexp_extract_all(body, F.lit(r"(?s)\\(?:\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)|[^\\]+"), F.lit(0))

        def unit(u: Column) -> Column:
            second = F.substring(u, F.lit(2), F.length(u))
            escaped = (
                F.when(second.rlike(r"^[\"\\\\/bfnrtu]"), u)
                .when(second.rlike(r"^x[0-9a-fA-F]{2}$"), F.concat(F.lit("\\u00"), F.substring(second, 2, 2)))
                .when(second.isin("\n", "\r\n", "\r"), F.lit(""))  # the text goes on in the next line
                .when(second == "v", F.lit("\\u000b"))
                .when(second == "0", F.lit("\\u0000"))
                .otherwise(second)
            )
            plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(u, '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t")
            return F.when(u.startswith("\\"), escaped).otherwise(plain)

        return F.concat(F.lit('"'), F.array_join(F.transform(units, unit), ""), F.lit('"'))

    def number(piece: Column) -> Column:
        bare = F.regexp_replace(piece, r"^\+", "")
        sign, digits = F.when(bare.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.regexp_replace(bare, r"^-?0[xX]0*", "")
        whole = F.when(F.length(digits) <= 16, F.coalesce(F.conv(F.when(digits == "", F.lit("0")).otherwise(digits), 16, 10), F.lit("0")))
        wide = F.aggregate(F.split(digits, ""), F.lit(0.0), lambda acc, d: F.when(d == "", acc).otherwise(acc * 16 + F.conv(d, 16, 10).cast("double"))).cast("string")
        pointed = F.regexp_replace(F.regexp_replace(bare, r"^(-?)\.", r"$10."), r"\.(?![0-9])", ".0")
        return F.when(bare.rlike(r"^-?0[xX]"), F.concat(sign, F.coalesce(whole, wide))).otherwise(pointed)

    pieces = F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
    quoted = lambda p: p.rlike(r"(?s)^\".*\"$") | p.rlike(r"(?s)^'.*'$")
    strict = lambda p: (
        F.when(quoted(p) & (F.length(p) > 1), text(p))
        .when(p.rlike(r"(?s)^(//|/\*)"), F.lit(""))
        .when(p.rlike(r"^[+-]?(?:[0-9]|\.[0-9])"), number(p))
        .otherwise(p)
    )
    return F.array_join(F.transform(pieces, strict), "")


def read_answer(c: Column) -> Column:
    """The JSON value of an answer as a VARIANT, whatever its type; null when it holds no readable JSON.

    Strict JSON is read as it is, then with lone backslashes repaired, then as relaxed JSON.
    """
    block = extract_json_block(c)

    def read(t: Column) -> Column:
        repaired = repair_backslashes(t)
        relaxed = F.from_json(drop_trailing_commas(strict_pieces(repaired)), "variant", RELAXED_JSON)
        return F.coalesce(F.try_parse_json(t), F.try_parse_json(repaired), relaxed)

    return bind(block, read)


def extract_json_object(c: Column) -> Column:
    """Strict JSON text of a short report answer: fences off, else first { to last }; null when unreadable."""
    text = strip(c)
    bare = F.when(
        text.startswith("```"),
        F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""),
    ).otherwise(text)
    span = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    first_readable = lambda texts: F.get(F.filter(texts, is_strict_json), F.lit(0))
    return first_readable(F.array(bare, span))
