"""Reading loosely typed values: raw text columns to numbers, flags and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.text import strip

# Accepted spellings of flags, category names and their aliases, issue labels.
TRUE_WORDS = ["true", "t", "1", "yes", "y"]
FALSE_WORDS = ["false", "f", "0", "no", "n"]
CATEGORIES = ["Number Theory", "Discrete & Prob", "Calculus", "Geometry", "Algebra"]
CATEGORY_ALIASES = {
    "discrete": "Discrete & Prob",
    "discrete math": "Discrete & Prob",
    "combinatorics": "Discrete & Prob",
    "probability": "Discrete & Prob",
    "discrete & probability": "Discrete & Prob",
    "number theory": "Number Theory",
    "geometry": "Geometry",
    "algebra": "Algebra",
    "calculus": "Calculus",
}
ISSUES = ["builder", "formalizer", "prover"]


def to_step(c: Column) -> Column:
    """Whole number from raw JSON text: digits only, so flags and decimals are null."""
    text = strip(F.regexp_replace(c, r'^"(.*)"$', "$1"))
    signed = F.when(~c.startswith('"') & c.rlike(r"^-\d+$"), c.try_cast("bigint"))
    return F.coalesce(F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")), signed)


NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def to_float(c: Column) -> Column:
    """Finite number written in decimal digits, or null; type letters as in ``1d`` are no numbers."""
    text = strip(c)
    value = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def to_bool(c: Column) -> Column:
    """The flag a text stands for: one of the known words, and nothing else; a number in a text is no flag."""
    word = F.lower(strip(c))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def json_kind(value: Column) -> Column:
    """What a VARIANT holds: number, text, flag, or other (lists, objects, null); null without a value."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit("number"))
        .when(name == "STRING", F.lit("text"))
        .when(name == "BOOLEAN", F.lit("flag"))
        .when(value.isNotNull(), F.lit("other"))
    )


def typed_float(value: Column) -> Column:
    """Finite number of a VARIANT: its own, or the one its text writes; a flag is none."""
    kind = json_kind(value)
    own = F.try_variant_get(value, "$", "double")
    finite = F.when(F.isnan(own) | (F.abs(own) == float("inf")), None).otherwise(own)
    return F.when(kind == "number", finite).when(kind == "text", to_float(F.try_variant_get(value, "$", "string")))


def typed_bool(value: Column) -> Column:
    """Flag of a VARIANT: its own, whether its number is not zero, or the one its word stands for."""
    kind = json_kind(value)
    return (
        F.when(kind == "flag", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "number", F.try_variant_get(value, "$", "double") != 0)
        .when(kind == "text", to_bool(F.try_variant_get(value, "$", "string")))
    )


def raw_bool(c: Column) -> Column:
    """The flag of raw JSON text: of a JSON value by its type, as ``typed_bool``; other text is taken as a word."""
    return F.coalesce(typed_bool(F.try_parse_json(c)), to_bool(c))


def coerce_skip(c: Column) -> Column:
    """0 only for a readable zero; null and junk count as 1."""
    return F.when(c.try_cast("int") == 0, 0).otherwise(1)


def normalize_category(c: Column) -> Column:
    """One of five names through fixed aliases, else UNKNOWN."""
    text = strip(F.coalesce(c, F.lit("")))
    named = F.when(text.isin(CATEGORIES), text)
    for alias, name in CATEGORY_ALIASES.items():
        named = named.when(F.lower(text) == alias, F.lit(name))
    return named.otherwise(F.lit("UNKNOWN"))


def normalize_issue(main: Column, secondary: Column, reason: Column, evidence: Column, confidence: Column) -> Column:
    """Issue verdict with defaults: prover, known secondary labels only, confidence 0."""
    label = F.lower(strip(F.coalesce(main, F.lit(""))))
    others = F.transform(F.coalesce(secondary, F.array().cast("array<string>")), lambda s: F.lower(strip(s)))
    return F.struct(
        F.when(label.isin(ISSUES), label).otherwise(F.lit("prover")).alias("main_issue"),
        F.filter(others, lambda s: s.isin(ISSUES)).alias("secondary_issues"),
        F.coalesce(reason, F.lit("")).alias("reason"),
        F.coalesce(evidence, F.lit("")).alias("evidence"),
        F.coalesce(confidence.try_cast("double"), F.lit(0.0)).alias("confidence"),
    )


def parse_experiment_name(c: Column) -> Column:
    """Context and model a run name stands for; both null where the name has no known form."""
    # The two forms of run names and the model digit.
    with_context = r"^step_proof_ctx_(c[0-4])_form_(api|goedel_8b|goedel_32b|qwen3_8b|qwen3_32b)$"
    full = r"^step_proof_full_1([01])[01]$"
    digit = F.regexp_extract(c, full, 1)
    return F.struct(
        F.when(c.rlike(with_context), F.regexp_extract(c, with_context, 1)).when(c.rlike(full), F.lit("c0")).alias("ctx"),
        F.when(c.rlike(with_context), F.regexp_extract(c, with_context, 2))
        .when(digit == "0", F.lit("goedel_8b"))
        .when(digit == "1", F.lit("goedel_32b"))
        .alias("model"),
    )


def known_experiment_name(c: Column) -> Column:
    """True for names of a known form, the discarded ones included."""
    return parse_experiment_name(c)["ctx"].isNotNull() | c.rlike(r"^step_proof_full_0[01][01]$")
