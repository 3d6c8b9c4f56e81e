"""Formal code texts: blocks, headers and spliced proofs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.rows import bind
from traceloom.functions.text import rstrip, strip

# The required header lines and what opens a header or a declaration line.
HEADER_LINES = [
    "import Mathlib",
    "import Aesop",
    "set_option maxHeartbeats 0",
    "open BigOperators Real Nat Topology Rat Filter",
]
HEADER_STARTS = ["import ", "set_option ", "open "]
DECLARATION_STARTS = ["import ", "set_option ", "open ", "lemma ", "theorem "]
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _starts(line: Column, starts: list[str]) -> Column:
    hit = F.lit(False)
    for start in starts:
        hit = hit | line.startswith(start)
    return hit


def _leading(lines: Column, keep) -> Column:
    """How many lines at the top satisfy ``keep``."""
    first_other = F.array_position(F.transform(lines, keep), F.lit(False)).cast("int")
    return bind(first_other, lambda at: F.when(at > 0, at - 1).otherwise(F.size(lines)))


def _tail(lines: Column, skip: Column) -> Column:
    return F.slice(lines, skip + 1, F.greatest(F.size(lines) - skip, F.lit(0)))


def _text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _in_header(line: Column) -> Column:
    return (strip(line) == "") | _starts(strip(line), HEADER_STARTS)


def _in_header_or_note(line: Column) -> Column:
    return _in_header(line) | strip(line).startswith("--")


def remove_header(c: Column) -> Column:
    """Drop the fixed header lines wherever they stand."""
    return strip(_text(F.filter(F.split(c, "\n"), lambda line: ~strip(line).isin(HEADER_LINES))))


def split_header_body(c: Column) -> Column:
    """Leading import, option, open and blank lines against the rest."""

    def parts(lines: Column) -> Column:
        return bind(
            _leading(lines, _in_header),
            lambda n: F.struct(
                strip(_text(F.slice(lines, F.lit(1), n))).alias("header"), strip(_text(_tail(lines, n))).alias("body")
            ),
        )

    return bind(F.split(c, LINE_END), parts)


def ensure_header(c: Column) -> Column:
    """Add the missing required lines after the leading header, with a blank line after it."""

    def completed(lines: Column) -> Column:
        missing = F.filter(
            F.array(*[F.lit(s) for s in HEADER_LINES]),
            lambda wanted: ~F.exists(lines, lambda line: strip(line).contains(wanted)),
        )
        return bind(
            _leading(lines, _in_header_or_note),
            lambda at: F.flatten(F.array(F.slice(lines, F.lit(1), at), missing, _tail(lines, at))),
        )

    def spaced(lines: Column) -> Column:
        leading = F.slice(lines, F.lit(1), _leading(lines, _in_header_or_note))
        blank_run = bind(F.reverse(leading), lambda back: _leading(back, lambda line: strip(line) == ""))
        end = bind(leading, lambda top: F.size(top) - blank_run)
        return bind(
            end,
            lambda n: F.when(
                (n > 0) & (n < F.size(lines)) & (strip(F.get(lines, n)) != ""),
                F.flatten(F.array(F.slice(lines, F.lit(1), n), F.array(F.lit("")), _tail(lines, n))),
            ).otherwise(lines),
        )

    return F.ltrim(_text(bind(bind(F.split(c, "\n"), completed), spaced)), F.lit("\n"))


def bare_code_block(c: Column) -> Column:
    """Last lean4 fence, else from the first declaration line to the next fence; null when there is neither."""
    fenced = F.regexp_extract_all(c, F.lit(r"(?s)```lean4\s*\n(.*?)\n```"), F.lit(1))
    last = bind(fenced, lambda blocks: F.get(blocks, F.size(blocks) - 1))

    def loose(lines: Column) -> Column:
        before = _leading(lines, lambda line: ~_starts(strip(line), DECLARATION_STARTS))
        return bind(
            bind(before, lambda n: _tail(lines, n)),
            lambda rest: _text(F.slice(rest, F.lit(1), _leading(rest, lambda line: ~strip(line).startswith("```")))),
        )

    return F.coalesce(strip(last), F.nullif(strip(bind(F.split(strip(c), LINE_END), loose)), F.lit("")))


def extract_code_block(c: Column) -> Column:
    return ensure_header(bare_code_block(c))


def theorem_prefix(c: Column) -> Column:
    """Statement before the first ':= by'; null when there is none."""
    mark = r":=\s*by\b"
    return F.when(c.rlike(mark), rstrip(F.get(F.split(c, mark, 2), F.lit(0))))


def proof_body(answer: Column) -> Column:
    """Proof text of an answer, 'sorry' when nothing is left."""
    fenced = F.regexp_extract_all(answer, F.lit(r"(?is)```(?:lean4|lean)?\s*\n(.*?)\n```"), F.lit(1))
    text = strip(F.coalesce(F.get(fenced, F.size(fenced) - 1), answer))
    parts = F.split(text, r":=\s*by\b", 2)
    body = strip(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(text))
    body = strip(F.regexp_replace(body, r"^by\b", ""))
    body = strip(F.regexp_replace(body, r"(?i)^```(?:lean4|lean)?\s*", ""))
    body = strip(F.regexp_replace(body, r"\s*```\z", ""))
    return F.when(body == "", F.lit("sorry")).otherwise(body)


def splice_proof(statement: Column, answer: Column) -> Column:
    """Statement with the answer's proof; an error text when the statement has no ':= by'."""
    prefix = theorem_prefix(statement)
    body = proof_body(answer)
    return F.struct(
        F.concat(prefix, F.lit(" := by\n"), body).alias("code"),
        F.when(prefix.isNotNull(), body).alias("body"),
        F.when(prefix.isNull(), F.lit("the statement has no ':= by'")).alias("error"),
    )
