"""Dataset jobs: rollout shapes, grading inputs, training records, failure tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.chat import chat_messages
from traceloom.functions.coerce import normalize_category, normalize_issue
from traceloom.functions.json_text import extract_json_object, first_balanced_object, read_answer
from traceloom.functions.rows import bind, settle
from traceloom.functions.text import has_unclosed_think, is_blank, rollout_record_id, strip, strip_think, truncate_text
from traceloom.operators.graph import ancestor_lists, parents_of, place_from_end, schema_issues, typed_facts, with_cells
from traceloom.operators.sampling import pick_one, split_by_ratio
from traceloom.sources.sinks import column_values

# Reject reason, version of the issue table, classes of a training record.
OPEN_THINK_REASON = "unclosed_think_block"
ISSUE_VERSION = 2
ABILITY, REWARD_STYLE = "math", "rule"


def normalize_bench(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Benchmark rows as id, source, question, gold: renamed, without nulls, all text, in source and id order."""
    from traceloom.operators.routing import require_columns

    names = ["id", "source", "question", "gold"]
    require_columns(df, [columns.get(n, n) for n in names])
    picked = df.select(*[F.col(columns.get(n, n)).cast("string").alias(n) for n in names])
    return picked.dropna(subset=names).orderBy("source", "id")


def unpivot_rollouts(wide: DataFrame, n: int | None = None) -> DataFrame:
    """One row per non-blank ``response_<k>`` column of a wide table, up to ``n`` of them."""
    numbers = sorted(int(c[9:]) for c in wide.columns if re.fullmatch(r"response_\d+", c))
    numbers = [k for k in numbers if n is None or k <= n]
    cells = F.array(*[F.struct(F.lit(k).alias("rollout_id"), F.col(f"response_{k}").alias("response")) for k in numbers])
    kept = [c for c in ("id", "source", "question", "gold") if c in wide.columns]
    return wide.select(*kept, F.inline(cells)).where(~is_blank(F.col("response")))


def pivot_rollouts(flat: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """One row per problem with ``response_k`` columns; the first rollout supplies the other fields. Numbers not given are read."""
    if numbers is None:
        numbers = column_values(flat, "rollout_id")
    fields = [c for c in ("source", "question", "gold") if c in flat.columns]
    cells = [c for c in ("response", "finish_reason") if c in flat.columns]
    wide = [
        F.first(F.when(F.col("rollout_id") == k, F.col(c)), ignorenulls=True).alias(f"{c}_{k}") for k in numbers for c in cells
    ]
    return flat.groupBy(F.col("parent_id").alias("id")).agg(
        *[F.min_by(c, F.struct("rollout_id", F.col("id"))).alias(c) for c in fields], *wide
    )


def flatten_rollouts(wide: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Flat rollouts, and the rejected ones with their reason."""
    cells = unpivot_rollouts(wide, n).withColumnRenamed("id", "parent_id")
    keyed = cells.withColumn("id", rollout_record_id(F.col("parent_id"), F.col("rollout_id")))
    bad = has_unclosed_think(F.col("response"))
    rejected = keyed.where(bad).select("id", "parent_id", "rollout_id", "source", F.lit(OPEN_THINK_REASON).alias("reason"))
    return keyed.where(~bad), rejected


def grading_inputs(rollouts: DataFrame, selected: DataFrame, seeds: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to grade: all rollouts with closed thinking, one pick per problem and seed, and the selection with its scores."""
    every = rollouts.where(~is_blank(F.col("answer")) & ~has_unclosed_think(F.col("answer")))
    scores = [c for c in selected.columns if c not in ("id", "parent_id", "source", "rollout_id", "answer", "gold")]
    chosen = selected.select(
        *[c for c in ("id", "parent_id", "source", "rollout_id", "answer", "gold") if c in selected.columns],
        *[F.col(c).alias(f"score_{c}") for c in scores],
    )
    return every, pick_one(every, "parent_id", seeds, "id"), chosen


def prompt_rows(traces: DataFrame, system: str, user: str, keep_think: bool) -> DataFrame:
    """Graph-building prompts; the template has {problem} and {solution}. Blank inputs are an error for the caller to see."""
    from traceloom.operators.routing import require_none

    blank = is_blank(F.col("problem_text")) | is_blank(F.col("solution"))
    require_none(traces.where(blank).select("record_id"), "blank problem or solution")
    solution = F.col("solution") if keep_think else strip_think(F.col("solution"))
    return traces.withColumn("prompt", chat_messages(system, user, problem=F.col("problem_text"), solution=solution))


def training_records(rows: DataFrame, data_source: str, prompt_name: str, keep_think: bool) -> DataFrame:
    """Nested training records from prompt rows with a ``split``."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return rows.select(
        F.lit(data_source).alias("data_source"),
        "prompt",
        F.lit(ABILITY).alias("ability"),
        F.struct(F.lit(REWARD_STYLE).alias("style"), text("reference_answer").alias("ground_truth")).alias("reward_model"),
        F.struct(
            "record_id",
            "problem_text",
            F.col("solution").alias("solution_or_cot"),
            text("reference_answer").alias("reference_answer"),
            "split",
            text("source_file").alias("source_file"),
            F.coalesce(F.col("source_row_pos"), F.lit(-1)).alias("source_row_pos"),
            F.lit(prompt_name).alias("fdg_prompt"),
            F.lit(keep_think).alias("include_think_in_dag"),
        ).alias("extra_info"),
        "split",
    )


def prepare_splits(
    traces: DataFrame, system: str, user: str, data_source: str, prompt_name: str, keep_think: bool = False,
    train: float = 0.98, val: float = 0.01, seed: int = 42,
) -> DataFrame:
    """Prompts, a seeded split by ratios, and nested records."""
    prompts = prompt_rows(split_by_ratio(traces, "record_id", train, val, seed), system, user, keep_think)
    return training_records(prompts, data_source, prompt_name, keep_think)


def first_problem(records: DataFrame, order: Column) -> DataFrame:
    """First non-blank problem text of each parent."""
    usable = records.where(~is_blank(F.col("problem")) & (F.col("parent_id") != ""))
    row = F.struct(F.col("record_id").alias("example_record_id"), strip(F.col("problem")).alias("problem"))
    return usable.groupBy("parent_id").agg(F.min_by(row, order).alias("_first")).select("parent_id", "_first.*")


def boxed_answer(c: Column) -> Column:
    """Content of the last \\boxed{...}, braces balanced; null when there is none."""
    tail = F.when(c.contains("\\boxed{"), F.substring_index(c, "\\boxed", -1))
    return bind(first_balanced_object(tail), lambda b: F.substring(b, F.lit(2), F.length(b) - 2))


def _bare(c: Column) -> Column:
    """Without spaces, dollar signs and thousands commas."""
    return F.regexp_replace(F.regexp_replace(c, r"[\s$]", ""), r"(?<=\d),(?=\d{3})", "")


def plain_answer(c: Column) -> Column:
    """Boxed answer, else the last number, else the whole text."""
    numbers = F.regexp_extract_all(c, F.lit(r"(-?\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    last = bind(numbers, lambda found: F.get(found, F.size(found) - 1))
    return _bare(F.coalesce(boxed_answer(c), last, c))


def grade_answers(rows: DataFrame, places: int = 6) -> DataFrame:
    """Compare ``answer`` with ``gold``: same text, or numbers equal to ``places`` decimals. Not symbolic."""
    staged = settle(rows, extracted_answer=plain_answer(F.col("answer")), extracted_gold=_bare(F.coalesce(boxed_answer(F.col("gold")), F.col("gold"))))
    a, g = F.col("extracted_answer").try_cast("double"), F.col("extracted_gold").try_cast("double")
    same = (F.col("extracted_answer") == F.col("extracted_gold")) | (F.round(a, places) == F.round(g, places))
    return staged.withColumns(
        {
            "is_correct": F.when(F.coalesce(same, F.lit(False)), 1).otherwise(0),
            "error": F.when(F.col("answer").isNull() | F.col("gold").isNull(), F.lit("missing text")).otherwise(F.lit("")),
        }
    )


def apply_categories(problems: DataFrame, responses: DataFrame, order: str) -> DataFrame:
    """Categories from batch answers ``{"items": [{"parent_id", "category", "reason"}]}``; UNKNOWN where absent."""
    schema = "items array<struct<parent_id: string, category: string, reason: string>>"
    read = settle(responses, _parsed=F.from_json(extract_json_object(F.col("content")), schema))
    items = read.select(order, F.posexplode("_parsed.items").alias("_at", "item")).select(
        order, "_at", strip(F.col("item.parent_id")).alias("parent_id"), "item.category", "item.reason"
    )
    last = items.where(~is_blank(F.col("parent_id"))).groupBy("parent_id").agg(
        F.max_by(F.struct("category", "reason"), F.struct(order, "_at")).alias("_item")
    )
    named = normalize_category(F.col("_item.category"))
    return problems.join(last, "parent_id", "left").select(
        *problems.columns,
        named.alias("category"),
        strip(F.coalesce(F.col("_item.reason"), F.lit(""))).alias("reason"),
        (named != "UNKNOWN").alias("ok"),
    )


def apply_issues(failed: DataFrame, responses: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Issue verdict of each failed node; unreadable answers count as prover with confidence 0.

    Rows of ``previous`` made with the current table version are kept as they are.
    """
    keys = ["record_id", "fact_id"]
    schema = "main_issue string, secondary_issues array<string>, reason string, evidence string, confidence string"
    old = None
    if previous is not None:
        old = previous.where(F.coalesce(F.col("context_schema_version"), F.lit(0)) == ISSUE_VERSION)
        failed = failed.join(old, keys, "left_anti")
    read = settle(
        failed.join(responses.select(*keys, "content"), keys, "left"), _json=extract_json_object(F.col("content"))
    ).withColumn("_p", F.from_json("_json", schema))
    p = F.col("_p")
    verdict = normalize_issue(p["main_issue"], p["secondary_issues"], p["reason"], p["evidence"], p["confidence"])
    fresh = read.select(
        *keys,
        F.lit(ISSUE_VERSION).alias("context_schema_version"),
        verdict.alias("_v"),
        F.when(F.col("_json").isNull(), F.lit("unreadable answer")).otherwise(F.lit("")).alias("parse_error"),
    ).select(*keys, "context_schema_version", "_v.*", "parse_error")
    if old is None:
        return fresh
    return old.join(failed.select(*keys), keys, "left_anti").select(*fresh.columns).unionByName(fresh)


def compact_response(c: Column) -> Column:
    """Answer reduced to the JSON it holds, as compact JSON; '' when it holds none.

    A graph without schema findings is written field by field, without skip. Any other value stays whole, its keys in name order.
    """

    def short(document: Column) -> Column:
        facts = F.transform(typed_facts(document), lambda f: f.dropFields("skip"))
        text = lambda name: F.try_variant_get(document, f"$.{name}", "string").alias(name)
        graph = F.to_json(F.struct(text("problem_id"), text("problem_text"), facts.alias("facts")))
        whole = (F.size(schema_issues(document)) == 0) & F.schema_of_variant(document).startswith("OBJECT")
        return F.when(whole, graph).when(document.isNotNull(), F.to_json(document)).otherwise(F.lit(""))

    return bind(read_answer(c), short)


def compact_fact(f: Column, max_chars: int) -> Column:
    return F.struct(
        strip(f["fact_id"]).alias("fact_id"),
        truncate_text(F.coalesce(f["text"], F.lit("")), max_chars).alias("text"),
        f["origin"].alias("origin"),
        f["parent_fact_ids"].alias("parent_fact_ids"),
        F.coalesce(f["is_final_answer"], F.lit(False)).alias("is_final_answer"),
    )


def failure_payloads(records: DataFrame, failed, context: str = "ancestor", max_failed: int | None = None, max_chars: int = 2400) -> DataFrame:
    """One row per failed fact with its compacted context: none, direct parents, or all it rests on, parents before children.

    ``failed`` is the test of a fact; ``max_failed`` is the report's own limit per record.
    """
    if context not in ("none", "direct", "ancestor"):
        raise ValueError(f"unknown context {context!r}")
    staged = with_cells(records)
    facts = F.col("facts")
    if context == "ancestor":
        staged = staged.withColumn("_lists", ancestor_lists(failed))

    def around(f: Column, k: Column) -> Column:
        if context == "none":
            return F.filter(facts, lambda e: F.lit(False))
        if context == "direct":
            near = lambda ids: F.filter(F.zip_with(facts, "_ids", lambda e, i: F.when(F.array_contains(ids, i), e)), lambda e: e.isNotNull())
            return bind(parents_of(f), near)
        return F.transform(F.get("_lists", k), lambda i: F.element_at(facts, place_from_end(F.col("_back"), i)))

    bad = F.filter(facts, failed)
    if max_failed is not None:
        bad = F.slice(bad, 1, max_failed)
    rows = F.transform(
        bad,
        lambda f, k: F.struct(
            strip(f["fact_id"]).alias("fact_id"),
            compact_fact(f, max_chars).alias("node"),
            F.transform(around(f, k), lambda e: compact_fact(e, max_chars)).alias("context"),
        ),
    )
    kept = [c for c in staged.columns if c in ("record_id", "problem_text")]
    return staged.select(*kept, F.inline(rows))


def failure_prompts(payloads: DataFrame, system: str, user: str) -> DataFrame:
    """Messages that ask why a node failed; the template has {problem} and {payload}."""
    payload = F.to_json(F.struct("record_id", "fact_id", "node", "context"))
    return payloads.select("record_id", "fact_id", chat_messages(system, user, problem=F.col("problem_text"), payload=payload).alias("messages"))
