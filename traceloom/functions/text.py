"""Text functions over columns: thinking blocks, ids, trimming, display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

# Characters a plain strip() removes, the rollout id marker and the thinking tags.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)
ROLLOUT_MARKER = "__rollout_"
CLOSED_THINK = r"(?is)<think\b[^>]*>.*?</think>"
OPEN_THINK_TAIL = r"(?is)<think\b[^>]*>.*\z"
OPEN_THINK_TAG = r"(?i)<think\b[^>]*>"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c.cast("string")) == "")


def has_unclosed_think(c: Column) -> Column:
    """True where an opening tag is left after all closed blocks are removed."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), CLOSED_THINK, "").rlike(OPEN_THINK_TAG)


def strip_think(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, CLOSED_THINK, ""), OPEN_THINK_TAIL, ""))


def parent_id(c: Column) -> Column:
    """Part before the last rollout marker; the whole id when there is none."""
    return F.when(c.contains(ROLLOUT_MARKER), F.regexp_extract(c, rf"(?s)^(.*){ROLLOUT_MARKER}", 1)).otherwise(c)


def rollout_no(c: Column) -> Column:
    """Number after the last rollout marker, null when the id carries none."""
    return F.regexp_extract(c, rf"(?s)^.*{ROLLOUT_MARKER}(\d+)$", 1).try_cast("int")


def rollout_record_id(parent: Column, number: Column) -> Column:
    return F.concat(parent, F.lit(ROLLOUT_MARKER), number.cast("string"))


def truncate_text(c: Column, n: int) -> Column:
    """Keep ``n`` characters and say how many were left out; ``n <= 0`` keeps all."""
    if n <= 0:
        return c
    note = F.concat(F.lit("\n...[truncated "), (F.length(c) - n).cast("string"), F.lit(" chars]"))
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), note)).otherwise(c)


def compact_ws(c: Column, n: int = 500) -> Column:
    """One line of at most ``n`` characters, ending in three dots where cut."""
    line = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(line) <= n, line).otherwise(F.concat(F.left(line, F.lit(n - 3)), F.lit("...")))


def wrap_gold(c: Column) -> Column:
    """Put dollar signs round an answer that is TeX but not marked as such."""
    # The characters that make an answer count as TeX.
    tex = r"[\\\\{}^_]"
    text = strip(c)
    return F.when(text.rlike(tex) & ~text.contains("$"), F.concat(F.lit("$"), text, F.lit("$"))).otherwise(text)


def join_phrase(parts: Column) -> Column:
    """'', 'a', 'a and b', 'a, b, and c'."""
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.get(parts, n - 1)
    return (
        F.when(n <= 0, F.lit(""))
        .when(n == 1, last)
        .when(n == 2, F.concat(head, F.lit(" and "), last))
        .otherwise(F.concat(head, F.lit(", and "), last))
    )


def natural_key(c: Column) -> Column:
    """Sort key that puts f_2 before f_10: letters, number (-1 when none), id."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.struct(
        F.regexp_replace(c, r"\d", "").alias("letters"),
        F.coalesce(digits.try_cast("bigint"), F.lit(-1)).alias("number"),
        c.alias("id"),
    )


def sanitize_name(c: Column, n: int = 140, default: str = "cases") -> Column:
    """A file-name-safe form of a label."""
    safe = F.regexp_replace(strip(c), r"[^A-Za-z0-9_.-]+", "_")
    safe = F.left(F.btrim(safe, F.lit("._-")), F.lit(n))
    return F.when(safe == "", F.lit(default)).otherwise(safe)


def error_text(c: Column, kind: DataType | None = None) -> Column:
    """Null becomes ''; text stays; a value of a nested ``kind`` becomes compact JSON with sorted keys."""
    if isinstance(kind, VariantType):
        return F.coalesce(F.to_json(c), F.lit(""))
    if isinstance(kind, (StructType, ArrayType, MapType)):
        return F.coalesce(F.to_json(F.to_variant_object(c)), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def fmt_pct(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit("")).otherwise(F.format_string("%.2f%%", F.bround(c * 100, 2)))


def fmt_seconds(seconds: Column) -> Column:
    """320ms, 4.20s, 3m05.0s, 1h02m07.5s."""
    whole_minutes = F.floor(seconds / 60)
    rest = F.bround(seconds - whole_minutes * 60, 1)
    return (
        F.when(seconds < 1, F.format_string("%.0fms", F.bround(seconds * 1000, 0)))
        .when(seconds < 60, F.format_string("%.2fs", F.bround(seconds, 2)))
        .when(whole_minutes < 60, F.format_string("%dm%04.1fs", whole_minutes, rest))
        .otherwise(F.format_string("%dh%02dm%04.1fs", F.floor(whole_minutes / 60), whole_minutes % 60, rest))
    )


def display_text(problem: Column, trace: Column, answer: Column) -> Column:
    """Problem with its trace, or with its answer where there is no trace."""
    problem, trace, answer = (strip(F.coalesce(c, F.lit(""))) for c in (problem, trace, answer))
    return F.concat_ws(
        "\n",
        F.when(problem != "", F.concat(F.lit("Problem:\n"), problem)),
        F.when(trace != "", F.concat(F.lit("\nRaw CoT:\n"), trace)),
        F.when((answer != "") & (trace == ""), F.concat(F.lit("\nAnswer:\n"), answer)),
    )


def nested_get(json: Column, *paths: str) -> Column:
    """First non-blank value among dotted paths of a JSON text, '' when none."""
    found = [F.get_json_object(json, f"$.{path}") for path in paths]
    return F.coalesce(*[F.when(~is_blank(value), value) for value in found], F.lit(""))


def quoted_repr(c: Column) -> Column:
    """A text as Python writes it in quotes: double ones only if it holds single and no double ones, other characters escaped."""
    double = c.contains("'") & ~c.contains('"')

    def written(ch: Column) -> Column:
        code = F.lower(F.hex(F.ascii(ch)))
        escaped = (
            F.when(F.length(code) <= 2, F.concat(F.lit("\\x"), F.lpad(code, 2, "0")))
            .when(F.length(code) <= 4, F.concat(F.lit("\\u"), F.lpad(code, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(code, 8, "0")))
        )
        return (
            F.when(ch == "\\", F.lit("\\\\"))
            .when(ch == "\n", F.lit("\\n"))
            .when(ch == "\r", F.lit("\\r"))
            .when(ch == "\t", F.lit("\\t"))
            .when((ch == "'") & ~double, F.lit("\\'"))
            .when(ch.rlike(r"[\p{C}\p{Z}&&[^ ]]"), escaped)
            .otherwise(ch)
        )

    mark = F.when(double, F.lit('"')).otherwise(F.lit("'"))
    letters = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    return F.concat(mark, F.array_join(F.transform(letters, written), ""), mark)
