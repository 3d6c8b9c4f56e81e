"""Rerank evaluation: nodes to scores to best-of-N to accuracies, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.evaluate import run_metrics
from traceloom.operators.sampling import pick_one
from traceloom.operators.scoring import attach_scores, best_of_n, score_records


def rerank_report(nodes: DataFrame, grades: DataFrame, seeds: list[int]) -> DataFrame:
    """(metric, source, value) of random picks, pass@1, pass@k, the selection and its hit rate."""
    rollouts = grades.select("id", "parent_id", "rollout_id", "source", "is_correct")
    selected = best_of_n(attach_scores(rollouts, score_records(nodes)))
    return run_metrics(grades, selected, pick_one(rollouts, "parent_id", seeds, "id"))


def source_summary(nodes: DataFrame, grades: DataFrame, seeds: list[int], sources: list[str]) -> DataFrame:
    """(metric, value) over the problems of the chosen sources: the number selected, random picks, pass@1, pass@k, the selection and
    its hit rate."""
    chosen = grades.where(F.trim("source").isin([s.strip() for s in sources if s.strip()]))
    report = rerank_report(nodes, chosen, seeds).where("source = 'avg'").select("metric", "value")
    total = chosen.agg(F.count_distinct("parent_id").cast("double").alias("value")).select(F.lit("selected").alias("metric"), "value")
    return report.unionByName(total)
