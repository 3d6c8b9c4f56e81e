"""Prover-retry study: sample, outcome, state before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.bins import percent_bucket
from traceloom.functions.text import parent_id, rollout_no
from traceloom.operators.attempts import apply_retry
from traceloom.operators.routing import reject_problems
from traceloom.operators.sampling import sample_stratified
from traceloom.operators.scoring import best_of_n, problem_ratio, score_records, verification_stats
from traceloom.operators.stats import before_after, output_counts, stats_metrics


def selected_records(nodes: DataFrame) -> DataFrame:
    """Best record of each problem by its node scores."""
    scores = score_records(nodes).withColumns(
        {"parent_id": parent_id(F.col("record_id")), "rollout_id": rollout_no(F.col("record_id"))}
    )
    return best_of_n(scores)


def selection_summary(nodes: DataFrame, grades: DataFrame) -> DataFrame:
    """Per source: selected records, how many have a grade, and their accuracy; an ungraded one counts as wrong."""
    graded = selected_records(nodes).join(grades.select(F.col("id").alias("record_id"), "source", "is_correct"), "record_id", "left")
    return graded.groupBy("source").agg(
        F.count("*").alias("selected"),
        F.count("is_correct").alias("graded"),
        F.sum("is_correct").alias("correct"),
        F.avg(F.coalesce("is_correct", F.lit(0))).alias("accuracy"),
    )


def selection_totals(nodes: DataFrame, grades: DataFrame) -> DataFrame:
    """The summary of ``selection_summary`` per source and over all (``overall`` 1, source null); selected records without a grade have
    the source null."""
    graded = selected_records(nodes).join(grades.select(F.col("id").alias("record_id"), "source", "is_correct"), "record_id", "left")
    return graded.rollup("source").agg(
        F.grouping("source").cast("int").alias("overall"),
        F.count("*").alias("selected"),
        F.count("is_correct").alias("graded"),
        F.coalesce(F.sum("is_correct"), F.lit(0)).alias("correct"),
        F.avg(F.coalesce("is_correct", F.lit(0))).alias("accuracy"),
    )


def ungraded_selections(nodes: DataFrame, grades: DataFrame) -> DataFrame:
    """Ids of the selected records that have no grade."""
    return selected_records(nodes).join(grades.select(F.col("id").alias("record_id")), "record_id", "left_anti").select("record_id", "parent_id")


def selection_report(nodes: DataFrame, per_bucket: int, seed: int, step: int = 20) -> DataFrame:
    """Problems and sampled problems per ratio bucket."""
    problems = problem_ratio(nodes, True).select("parent_id", percent_bucket(F.col("ratio_percent"), step).alias("bucket"))
    drawn = sample_stratified(problems, "bucket", seed, "parent_id", per_bucket=per_bucket, step=step)
    before = problems.groupBy("bucket").agg(F.count("*").alias("problems"))
    after = drawn.groupBy("bucket").agg(F.count("*").alias("sampled"))
    return before.join(after, "bucket", "left").fillna(0, ["sampled"])


def selection_counts(rollouts: DataFrame, grades: DataFrame, answers: DataFrame, per_bucket: int, seed: int, ratios: DataFrame, step: int = 20) -> DataFrame:
    """Problems in all, rejected for open thinking, eligible, drawn by bucket, and rollouts without a grade.

    ``answers`` holds the graded answer texts, ``ratios`` the proof ratio of each problem.
    """
    kept = reject_problems(rollouts, answers)
    bucket = percent_bucket(F.col("ratio_percent"), step)
    eligible = ratios.join(kept.select("parent_id").distinct(), "parent_id", "left_semi").withColumn("bucket", bucket)
    drawn = sample_stratified(eligible, "bucket", seed, "parent_id", per_bucket=per_bucket, step=step)
    ungraded = rollouts.select("id").join(grades.select("id"), "id", "left_anti")
    problems = rollouts.select("parent_id").distinct()
    named = {"total": problems, "eligible": eligible, "selected": drawn, "ungraded": ungraded, "rejected": rejected_problems(rollouts, answers)}
    return output_counts(named).groupBy().pivot("output", list(named)).sum("rows")


def rejected_problems(rollouts: DataFrame, answers: DataFrame) -> DataFrame:
    """Ids of the problems that are left out because a rollout or an answer of theirs ends inside open thinking."""
    kept = reject_problems(rollouts, answers).select("parent_id").distinct()
    return rollouts.select("parent_id").distinct().join(kept, "parent_id", "left_anti")


def metrics(nodes: DataFrame, grades: DataFrame) -> DataFrame:
    """Global ratios of both scopes and the accuracy of the selection."""
    chosen = selected_records(nodes).join(grades.select(F.col("id").alias("record_id"), "is_correct"), "record_id", "left")
    accuracy = chosen.agg(F.avg(F.coalesce("is_correct", F.lit(0))).alias("value")).select(F.lit("step_proof_best.accuracy").alias("metric"), "value")
    return stats_metrics(verification_stats(nodes, "retry")).unionByName(accuracy)


def before_after_retry(nodes: DataFrame, grades: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The five study metrics before and after the retry results are applied."""
    return before_after(metrics(nodes, grades), metrics(apply_retry(nodes, outcomes), grades))
