"""Filters, guards and outcome routes over traces, rollouts and attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.text import strip
from traceloom.functions.chat import prompt_tokens, quarter_length
from traceloom.functions.checks import classify_api_error
from traceloom.functions.coerce import coerce_skip
from traceloom.functions.text import has_unclosed_think, is_blank

YES = lambda c: F.coalesce(c, F.lit(False))
# Error of a record without facts, mode names, the context mode older outputs were made with.
EMPTY_GRAPH_ERROR = "Empty FDG graph (no facts). Skipped by Stage 2."
GRAPH_MODE = "fdg"
DEFAULT_CONTEXT = "c0_parent"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns {lacking}; the input has {df.columns}")
    return df


def require_none(violations: DataFrame, message: str, show: int = 5) -> None:
    """Raise with a few examples when ``violations`` has any row."""
    found = violations.limit(show).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def resume_filter(df: DataFrame, done: list[DataFrame], key: str = "record_id") -> DataFrame:
    """Rows whose id is in none of the finished outputs; rows waiting on an API are not finished."""
    finished = reduce(DataFrame.union, [d.select(F.col(key)) for d in done]).distinct()
    return df.join(finished, key, "left_anti")


def pending(traces: DataFrame, done: list[DataFrame], limit: int = -1, order: list[str] | None = None) -> DataFrame:
    """Traces still to be worked on; ``limit`` counts what is left after all filters."""
    usable = traces.where(
        ~is_blank(F.col("record_id")) & F.col("problem").isNotNull() & F.col("raw_cot").isNotNull() & ~has_unclosed_think(F.col("raw_cot"))
    )
    left = resume_filter(usable, done) if done else usable
    return left.orderBy(*(order or ["record_id"])).limit(limit) if limit >= 0 else left


def check_compatible(done: DataFrame, prompt: str, context: str) -> None:
    """Finished rows must have been made with the same prompt and context; no context means the default one."""
    require_none(incompatible(done, prompt, context), f"finished rows were not made with {prompt!r} and {context!r}")


def incompatible(done: DataFrame, prompt: str, context: str) -> DataFrame:
    """Finished rows made with another prompt or context. Without a noted prompt any prompt will do; without a noted context, null or
    blank, a row was made with the default one."""
    noted = F.nullif(strip(F.coalesce(F.col("prompt"), F.lit(""))), F.lit(""))
    made_with = F.coalesce(F.nullif(strip(F.coalesce(F.col("context_mode"), F.lit(""))), F.lit("")), F.lit(DEFAULT_CONTEXT))
    return done.where((noted.isNotNull() & (noted != prompt)) | (made_with != context))


def reject_problems(rollouts: DataFrame, grades: DataFrame) -> DataFrame:
    """Rollouts of problems none of whose traces or graded answers has an open thinking block."""
    bad = (
        rollouts.where(has_unclosed_think(F.col("response"))).select("parent_id")
        .union(grades.where(has_unclosed_think(F.col("answer"))).select("parent_id"))
        .distinct()
    )
    return rollouts.join(bad, "parent_id", "left_anti")


def should_execute(nodes: DataFrame) -> DataFrame:
    return nodes.where(coerce_skip(F.col("skip")) == 0)


def prove_ready() -> Column:
    """pending for nodes with a passing formal statement that count, else skipped."""
    ready = (coerce_skip(F.col("skip")) == 0) & YES(F.col("form_lean_pass")) & (F.coalesce(F.col("form_code"), F.lit("")) != "")
    return F.when(ready, F.lit("pending")).otherwise(F.lit("skipped"))


def route_empty(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with facts, and those without as failed rows."""
    empty = F.col("facts").isNull() | (F.size("facts") == 0)
    return records.where(~empty), records.where(empty).withColumn("last_error", F.lit(EMPTY_GRAPH_ERROR))


def outcome(max_retries: int) -> Column:
    """Route of one stage-1 attempt with its retry count: ok, skipped, api_pending, retry or failed."""
    again = F.when(F.col("retry_count") >= max_retries, F.lit("failed")).otherwise(F.lit("retry"))
    return (
        F.when(YES(F.col("token_overflow")), F.lit("skipped"))
        .when(YES(F.col("api_error")), F.lit("api_pending"))
        .when(YES(F.col("output_truncated")), again)
        .when(YES(F.col("valid")), F.lit("ok"))
        .otherwise(again)
    )


def reason() -> Column:
    """Why an attempt did not end well, null for ok."""
    return (
        F.when(YES(F.col("token_overflow")), F.lit("prompt_token_overflow"))
        .when(YES(F.col("api_error")), classify_api_error(F.col("api_error_type"), F.col("api_error_text")))
        .when(YES(F.col("output_truncated")), F.lit("output_truncated"))
        .when(~YES(F.col("valid")), F.lit("max_retries"))
    )


def route_outcomes(attempts: DataFrame, max_retries: int) -> DataFrame:
    return attempts.withColumns({"outcome": outcome(max_retries), "reason": reason()})


def graph_mode(meta: Column, has_facts: Column) -> Column:
    """Mode of a record: by schema version, else by its facts, else by the stated mode."""
    version = F.lower(F.trim(F.coalesce(meta["schema_version"], F.lit(""))))
    stated = F.lower(F.trim(F.coalesce(meta["graph_mode"], F.lit(""))))
    return F.when(version.startswith("fdg-") | has_facts | (stated == ""), F.lit(GRAPH_MODE)).otherwise(stated)


def mode_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("mode").agg(F.count("*").alias("records"))


def ensure_single_mode(records: DataFrame) -> str:
    """The one mode of the records; mixed or foreign modes are an error."""
    modes = sorted(r["mode"] for r in mode_counts(records).select("mode").limit(10).collect())
    if len(modes) > 1:
        raise ValueError(f"several graph modes: {modes}")
    if modes and modes[0] != GRAPH_MODE:
        raise ValueError(f"foreign graph mode {modes[0]!r}")
    return GRAPH_MODE


def select_rollouts(df: DataFrame, sample: str, rollout_id: int = 1, every: bool = False, contains: bool = False) -> DataFrame:
    """Rows with this id, else of this parent, else (``contains``) with it in either; near matches are named."""
    part = F.col("id").contains(sample) | F.col("parent_id").contains(sample)
    tiers = [F.col("id") == sample, F.col("parent_id") == sample] + ([part] if contains else [])
    for place, test in enumerate(tiers):
        found = df.where(test)
        if found.isEmpty():
            continue
        if place == 0 or every:
            return found
        picked = found.where(F.col("rollout_id").try_cast("int") == rollout_id)
        if not picked.isEmpty():
            return picked
        if place == 2:
            return found.orderBy("parent_id", "rollout_id", "id").limit(1)
        raise ValueError(f"{sample!r} has no rollout {rollout_id}")
    near = [r["id"] for r in df.where(part).select("id").distinct().orderBy("id").limit(12).collect()]
    raise ValueError(f"nothing called {sample!r}; near: {near}")


def prompt_overflow(df: DataFrame, limit: int, messages: str = "messages", counter=quarter_length) -> DataFrame:
    """Add the token estimate of the messages and whether it exceeds ``limit``."""
    counted = df.withColumn("prompt_tokens", prompt_tokens(F.col(messages), counter))
    return counted.withColumn("overflow", F.col("prompt_tokens") > limit)
