"""Status, attempt, reward and token reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.bins import doubling_bin, doubling_label, fixed_bin, fixed_bin_labels, pow2_bin, small_table, zero_filled
from traceloom.functions.checks import classify_error
from traceloom.functions.coerce import to_bool, to_float, to_step, typed_bool, typed_float
from traceloom.functions.exact import exact_mean, exact_std_pop, exact_sum
from traceloom.functions.text import compact_ws, is_blank, strip
from traceloom.schemas import TERMINAL

YES = lambda c: F.coalesce(c, F.lit(False))


def with_outcome(nodes: DataFrame, stage: str) -> DataFrame:
    """Add origin, status, outcome and error class of each node for one stage (``form`` or ``prove``)."""
    status = F.coalesce(F.nullif(strip(F.col(f"{stage}_status")), F.lit("")), F.lit("unknown"))
    passed = YES(F.col("form_lean_pass" if stage == "form" else "lean_verify"))
    outcome = F.when(status == "skipped", F.lit("skipped")).when(passed, F.lit("success")).otherwise(F.lit("failed"))
    origin = F.when(is_blank(F.col("origin")), F.lit("<missing>")).otherwise(strip(F.col("origin")))
    error = classify_error(F.col("error_msg"), F.col("lean_code"), F.col(f"{stage}_skipped"), status)
    return nodes.withColumns(
        {"origin": origin, "status": status, "outcome": outcome, "category": F.when(outcome == "failed", error)}
    )


def node_status_summary(nodes: DataFrame, stage: str) -> DataFrame:
    """Long table (kind, name, nodes) of origins, statuses, outcomes and error classes, in one aggregation."""
    marked = with_outcome(nodes, stage)
    labels = F.array_compact(
        F.array(
            F.struct(F.lit("total").alias("kind"), F.lit("nodes").alias("name")),
            F.struct(F.lit("origin").alias("kind"), F.col("origin").alias("name")),
            F.struct(F.lit("status").alias("kind"), F.col("status").alias("name")),
            F.struct(F.lit("outcome").alias("kind"), F.col("outcome").alias("name")),
            F.when(F.col("outcome") != "skipped", F.struct(F.lit("total").alias("kind"), F.lit("need").alias("name"))),
            F.when(F.col("category").isNotNull(), F.struct(F.lit("error").alias("kind"), F.col("category").alias("name"))),
        )
    )
    # Counted per combination first: the rows that are fanned out are the combinations, not the nodes.
    combined = marked.groupBy("origin", "status", "outcome", "category").agg(F.count("*").alias("_n"))
    return combined.select(F.inline(labels), "_n").groupBy("kind", "name").agg(F.sum("_n").alias("nodes"))


def error_examples(nodes: DataFrame, stage: str, order: list[str], n: int = 100) -> DataFrame:
    """First ``n`` failed nodes with their error class and a one-line message."""
    failed = with_outcome(nodes, stage).where("outcome = 'failed'")
    return failed.orderBy(*order).limit(n).select(
        "record_id", "fact_id", "origin", "status", "category", compact_ws(F.coalesce("error_msg", F.lit(""))).alias("error_msg")
    )


def record_status(nodes: DataFrame, include_prove: bool = True) -> DataFrame:
    """Status counts of each record and whether it completed with failures; a node without a prove status is pending."""
    stages = ["form", "prove"] if include_prove else ["form"]
    state_of = {"form": F.col("form_status"), "prove": F.coalesce("prove_status", F.lit("pending")) if include_prove else None}
    counts = [F.count_if(state_of[s] == v).alias(f"{s}_{v}") for s in stages for v in TERMINAL + ["pending", "running"]]
    failed = F.lit(0)
    for s in stages:
        failed = failed + F.col(f"{s}_failed")
    state = F.when(failed > 0, F.lit("completed_with_failures")).otherwise(F.lit("completed"))
    return nodes.groupBy("record_id").agg(*counts).withColumn("record_status", state)


def record_terminal(nodes: DataFrame, stage: str) -> DataFrame:
    """Whether every node of a record has reached a final status."""
    return nodes.groupBy("record_id").agg(F.every(YES(F.col(f"{stage}_status").isin(TERMINAL))).alias("terminal"))


def record_trace_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("record_id").agg(
        F.count("*").alias("nodes"),
        *[
            F.count_if(F.col(f"{s}_status") == v).alias(f"{s}_{v}")
            for s in ("form", "prove")
            for v in ("success", "failed")
        ],
    )


def output_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each named output."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows") for name, df in tables.items()]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("rows"))


def _spread(value: Column) -> list[Column]:
    n = F.count(value)
    return [
        n.alias("n"),
        F.coalesce(exact_mean(value), F.lit(0.0)).alias("mean"),
        F.coalesce(exact_std_pop(value), F.lit(0.0)).alias("std_pop"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def _with_step(samples: DataFrame) -> DataFrame:
    return samples.withColumn("step", to_step(F.col("step").cast("string"))).where("step IS NOT NULL")


def reward_by_step(samples: DataFrame, field: str = "reward") -> DataFrame:
    """Reward spread per step and over all (step null); missing and unreadable rewards are counted apart.

    A step without rollouts, whose row has a null ``rollout_idx``, has a row of its own and no missing reward.
    """
    raw = F.col(field).cast("string")
    there = F.col("rollout_idx").isNotNull() if "rollout_idx" in samples.columns else F.lit(True)
    read = _with_step(samples).select("step", raw.alias("_raw"), to_float(raw).alias("_x"), there.alias("_there"))
    return read.rollup("step").agg(
        *_spread(F.col("_x")),
        F.count_if(F.col("_raw").isNull() & F.col("_there")).alias("missing"),
        F.count_if(F.col("_raw").isNotNull() & F.col("_x").isNull()).alias("invalid"),
        F.grouping("step").alias("overall"),
    )


def reward_histogram(samples: DataFrame, lo: float = -1.0, hi: float = 1.0, width: float = 0.05, field: str = "reward") -> DataFrame:
    """Rewards per step and bin; values outside [lo, hi] are in no bin."""
    binned = _with_step(samples).select("step", fixed_bin(to_float(F.col(field).cast("string")), lo, hi, width).alias("bin"))
    return binned.where("bin IS NOT NULL").groupBy("step", "bin").agg(F.count("*").alias("rewards"))


def reward_histogram_report(samples: DataFrame, lo: float = -1.0, hi: float = 1.0, width: float = 0.05, field: str = "reward") -> DataFrame:
    """Per step, and over all (step null), the counts of all bins in order (``hist``, empty bins 0) and their ``labels``.

    Steps without rollouts have a row of zeros. All bins are counted in one pass.
    """
    labels = fixed_bin_labels(lo, hi, width)
    rows = _with_step(samples).select("step", fixed_bin(to_float(F.col(field).cast("string")), lo, hi, width).alias("_bin"))
    counts = F.array(*[F.count_if(F.col("_bin") == k) for k in range(len(labels))])
    counted = rows.rollup("step").agg(counts.alias("hist"), F.grouping("step").alias("overall"))
    return counted.withColumn("labels", F.array(*[F.lit(name) for name in labels]))


def sample_gaps(records: DataFrame) -> DataFrame:
    """Of step records with a ``rollouts`` array: how many lack a step and how many lack rollouts."""
    no_step = to_step(F.col("step").cast("string")).isNull()
    return records.agg(
        F.count("*").alias("records"),
        F.count_if(no_step).alias("missing_step"),
        F.count_if(~no_step & F.col("rollouts").isNull()).alias("missing_rollouts"),
        F.coalesce(F.sum(F.when(~no_step & F.col("rollouts").isNotNull(), F.size("rollouts"))), F.lit(0)).alias("rollouts_seen"),
    )


def trace_gaps(samples: DataFrame) -> DataFrame:
    """Per step, and over all (step null), rollouts, those without a trace and those whose trace is no object."""
    return _with_step(samples).rollup("step").agg(
        F.count_if(F.col("trace_state") != "none").alias("rollouts"),
        F.count_if(F.col("trace_state") == "missing").alias("missing_trace"),
        F.count_if(F.col("trace_state") == "invalid").alias("invalid_trace"),
        F.grouping("step").alias("overall"),
    )


def reward_trace_by_step(samples: DataFrame, metrics: list[str], bools: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per step, and over all, spread of each numeric field and rate of each flag of the reward trace.

    Fields that ``explode_samples`` keeps as VARIANT are read by their JSON type: a quoted number is a number in a text, so it counts for
    the spread and is no flag. A JSON null is a missing value.
    """
    rows = _with_step(samples)
    kinds = dict(rows.dtypes)
    typed = lambda c: kinds[c] == "variant"
    there = lambda c: F.col(c).isNotNull() & (~F.is_variant_null(c) if typed(c) else F.lit(True))
    number = lambda c: typed_float(F.col(c)) if typed(c) else to_float(F.col(c).cast("string"))
    flag = lambda c: typed_bool(F.col(c)) if typed(c) else F.col(c) if kinds[c] == "boolean" else to_bool(F.col(c).cast("string"))
    if "trace_state" in samples.columns:
        rows = rows.where("trace_state = 'ok'")
    numbers = rows.select(
        "step",
        F.inline(F.array(*[F.struct(F.lit(m).alias("field"), there(m).alias("_there"), number(m).alias("_x")) for m in metrics])),
    )
    spread = numbers.groupingSets([["step", "field"], ["field"]], "step", "field").agg(
        *_spread(F.col("_x")),
        F.count_if(~F.col("_there")).alias("missing"),
        F.count_if(F.col("_there") & F.col("_x").isNull()).alias("invalid"),
    )
    flags = rows.select("step", F.inline(F.array(*[F.struct(F.lit(b).alias("field"), flag(b).alias("_v")) for b in bools])))
    rates = flags.groupingSets([["step", "field"], ["field"]], "step", "field").agg(
        F.count("_v").alias("n"),
        F.count_if("_v").alias("true_n"),
        F.coalesce(F.avg(F.col("_v").cast("int")), F.lit(0.0)).alias("true_rate"),
    )
    return spread, rates


def outcome_class(tries: Column, verified: Column) -> Column:
    """A, B: done in one or two tries; C, D: three tries, verified or not."""
    return (
        F.when(tries == 1, F.lit("A"))
        .when(tries == 2, F.lit("B"))
        .when((tries == 3) & YES(verified), F.lit("C"))
        .when(tries == 3, F.lit("D"))
    )


def token_spread(rows: DataFrame) -> DataFrame:
    """Per class and measure (input, output, sum): count, min, max, mean of the token counts."""
    return _token_rows(rows).groupBy("class", "measure").agg(
        F.count("*").alias("n"), F.min("tokens").alias("min"), F.max("tokens").alias("max"), F.avg("tokens").alias("mean")
    )


def _token_rows(rows: DataFrame) -> DataFrame:
    """Long form of rows with ``class``, ``input_tokens`` and ``output_tokens``."""
    measures = [
        F.struct(F.lit(name).alias("measure"), value.cast("bigint").alias("tokens"))
        for name, value in (
            ("input", F.col("input_tokens")),
            ("output", F.col("output_tokens")),
            ("sum", F.col("input_tokens") + F.col("output_tokens")),
        )
    ]
    return rows.where("class IS NOT NULL").select("class", F.inline(F.array(*measures)))


def token_histograms(rows: DataFrame, start: int = 256) -> DataFrame:
    """Rows per class, measure and doubling range, empty ranges up to the largest value included."""
    binned = _token_rows(rows).withColumn("bin", doubling_bin(F.col("tokens"), start))
    counts = binned.groupBy("class", "measure", "bin").agg(F.count("*").alias("rows"))
    tops = counts.groupBy("class", "measure").agg(F.max("bin").alias("_top"))
    every = tops.select("class", "measure", F.explode(F.sequence(F.lit(0), F.col("_top") + 1)).alias("bin"), "_top")
    filled = every.join(counts, ["class", "measure", "bin"], "left").fillna(0, ["rows"])
    open_end = F.concat(F.lit("["), (F.lit(start) * F.pow(F.lit(2.0), F.col("_top"))).cast("bigint").cast("string"), F.lit(",inf)"))
    label = F.when(F.col("bin") > F.col("_top"), open_end).otherwise(doubling_label(F.col("bin"), start))
    return filled.select("class", "measure", "bin", label.alias("range"), "rows")


def token_bins(df: DataFrame, tokens: Column) -> DataFrame:
    """Rows and percentage per fixed power-of-two range."""
    counts = df.select(pow2_bin(tokens).alias("range"), tokens.alias("_n")).groupBy("range").agg(
        F.count("*").alias("rows"), F.max("_n").alias("largest")
    )
    total = F.sum("rows").over(_whole())
    return counts.withColumn("percent", F.col("rows") / total * 100.0)


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def retry_scaling(outcomes: DataFrame) -> DataFrame:
    """Nodes per retry bucket 0, 1, 2, 3, failed; anything else counts as failed."""
    known = ["0", "1", "2", "3", "failed"]
    bucket = F.when(F.col("success_bucket").isin(known), F.col("success_bucket")).otherwise(F.lit("failed"))
    counts = outcomes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("nodes"))
    dimension = small_table(outcomes.sparkSession, ["bucket"], [(k,) for k in known])
    filled = zero_filled(counts, dimension, ["bucket"], ["nodes"])
    total = F.sum("nodes").over(_whole())
    return filled.withColumn("ratio", F.when(total > 0, F.col("nodes") / total).otherwise(0.0))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables (metric, value) of two states side by side with their difference; a missing value counts as 0."""
    left = before.select("metric", F.col("value").alias("before"))
    joined = left.join(after.select("metric", F.col("value").alias("after")), "metric", "full").fillna(0.0, ["before", "after"])
    return joined.withColumn("delta", F.col("after") - F.col("before"))


def stats_metrics(stats: DataFrame) -> DataFrame:
    """(metric, value) rows of the global ratios of both scopes."""
    values = [
        F.struct(F.concat("scope", F.lit(f".{name}")).alias("metric"), F.col(column).alias("value"))
        for name, column in (
            ("global_prove_verified_nodes_ratio", "verified_ratio"),
            ("global_form_verified_nodes_ratio", "formal_ratio"),
        )
    ]
    return stats.select(F.inline(F.array(*values)))


def runtime_rollup(log: DataFrame) -> DataFrame:
    """Per stage: wall time, check time, checks, mean per check and share of idle time (null over nothing)."""
    sums = log.groupBy("stage").agg(
        (F.max("ended") - F.min("started")).alias("total_seconds"),
        exact_sum(F.col("check_seconds")).alias("check_seconds"),
        F.count("check_seconds").alias("checks"),
        exact_mean(F.col("check_seconds")).alias("seconds_per_check"),
        exact_sum(F.col("idle_seconds")).alias("idle_seconds"),
    )
    return sums.withColumn("idle_ratio", F.when(F.col("total_seconds") > 0, F.col("idle_seconds") / F.col("total_seconds")))
