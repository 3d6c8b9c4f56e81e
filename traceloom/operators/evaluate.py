"""Accuracy reports and case mining over graded rollouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.text import rollout_no, strip
from traceloom.operators.scoring import LAST_ROLLOUT

# Bucket names of the case report.
CASES_ANY = ["pass4_correct_selected_wrong", "pass1_correct_selected_wrong", "high_score_wrong"]
CASES_TWO = ["a_wrong_b_correct", "a_correct_b_wrong"]


def rollout_number() -> Column:
    """The column where it is a number, else the number in the id."""
    return F.coalesce(F.col("rollout_id").try_cast("int"), rollout_no(F.col("id")))


def first_rollout(grades: DataFrame) -> DataFrame:
    return grades.where(rollout_number() == 1)


def filter_sources(df: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of the named sources; a name the data lacks is an error."""
    present = df.where(F.col("source").isin(sources)).select("source").distinct()
    lacking = set(sources) - {r["source"] for r in present.collect()}  # at most len(sources) rows
    if lacking:
        raise ValueError(f"unknown sources {sorted(lacking)}")
    return df.where(F.col("source").isin(sources))


def accuracy(grades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of correct rows; null over no rows."""
    return grades.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("is_correct"), F.lit(0)).alias("correct"),
        F.avg("is_correct").alias("accuracy"),
    )


def accuracy_with_sources(grades: DataFrame) -> DataFrame:
    """Accuracy per source and over all, source null, from one aggregation."""
    return grades.rollup("source").agg(F.count("*").alias("total"), F.sum("is_correct").alias("correct"), F.avg("is_correct").alias("accuracy"), F.grouping("source").alias("overall"))


def solved(grades: DataFrame) -> DataFrame:
    """Per problem whether any rollout, and whether the first one, is correct; source is the first non-blank one."""
    number = F.coalesce(rollout_number(), F.lit(LAST_ROLLOUT))
    named = F.when(strip(F.col("source")) != "", F.col("source"))
    return grades.groupBy("parent_id").agg(
        F.max("is_correct").alias("any_correct"),
        F.max(F.when(rollout_number() == 1, F.col("is_correct")).otherwise(0)).alias("first_correct"),
        F.min_by(named, F.when(named.isNotNull(), F.struct(number, F.col("id")))).alias("source"),
        F.max(rollout_number()).alias("top_rollout"),
    )


def pass_at_k(grades: DataFrame) -> DataFrame:
    """Share of problems with a correct rollout, per source and over all; k is the largest rollout number present."""
    reported = solved(grades).rollup("source").agg(
        F.count("*").alias("total"),
        F.sum("any_correct").alias("correct"),
        F.avg("any_correct").alias("accuracy"),
        F.max("top_rollout").alias("k"),
        F.grouping("source").alias("overall"),
    )
    # The report has one row per source, so one task can hold it.
    return reported.withColumn("k", F.max("k").over(Window.partitionBy(F.lit(0))))


def random_baseline(picks: DataFrame) -> DataFrame:
    """Mean and population deviation of the accuracy over the seeds of ``pick_one``."""
    per_seed = picks.groupBy("seed").agg(F.avg("is_correct").alias("_accuracy"))
    return per_seed.agg(
        F.count("*").alias("runs"), F.avg("_accuracy").alias("mean_accuracy"), F.stddev_pop("_accuracy").alias("std_accuracy")
    )


def selection_hits(selected: DataFrame, grades: DataFrame) -> DataFrame:
    """Solvable problems with whether the selected rollout is correct; a problem without a selection is a miss."""
    chosen = selected.select("parent_id", F.col("is_correct").alias("_hit"))
    solvable = solved(grades).where("any_correct = 1").select("parent_id", "source")
    return solvable.join(chosen, "parent_id", "left").select("parent_id", "source", F.coalesce("_hit", F.lit(0)).alias("hit"))


def selection_hit_rate(selected: DataFrame, grades: DataFrame) -> DataFrame:
    return selection_hits(selected, grades).agg(
        F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("solvable"), F.avg("hit").alias("hit_rate")
    )


def run_metrics(grades: DataFrame, selected: DataFrame, picks: DataFrame) -> DataFrame:
    """Long table (metric, source, value): random runs, pass@1, pass@k, the selection and its hit rate.

    ``source`` is ``avg`` for the value over all sources.
    """
    over = lambda df, metric, value: df.select(
        metric.alias("metric"), F.when(F.col("overall") == 1, F.lit("avg")).otherwise(F.col("source")).alias("source"), F.col(value).alias("value")
    )
    runs = picks.groupingSets([["source", "seed"], ["seed"]], "source", "seed").agg(F.avg("is_correct").alias("accuracy"), F.grouping("source").alias("overall"))
    parts = [
        over(runs, F.concat(F.lit("random_seed_"), F.col("seed").cast("string")), "accuracy"),
        over(accuracy_with_sources(first_rollout(grades)), F.lit("pass@1"), "accuracy"),
        over(pass_at_k(grades), F.concat(F.lit("pass@"), F.col("k").cast("string")), "accuracy"),
        over(accuracy_with_sources(selected), F.lit("ours"), "accuracy"),
        selection_hit_rate(selected, grades).select(F.lit("hit_rate").alias("metric"), F.lit("avg").alias("source"), F.col("hit_rate").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def correct_rollouts(grades: DataFrame) -> DataFrame:
    """Sorted numbers of the correct rollouts of each problem."""
    numbers = F.collect_set(F.when(F.col("is_correct") == 1, rollout_number()))
    return grades.groupBy("parent_id").agg(F.array_sort(numbers).alias("correct_rollouts"))


def available_sources(*runs: DataFrame) -> DataFrame:
    """Sources of all runs and whether a report shows them by default."""
    names = reduce(DataFrame.union, [r.select("source") for r in runs]).distinct().where("source <> ''")
    # Fixed value: part of the names left out by default.
    return names.withColumn("shown_by_default", ~F.lower("source").contains("gsm8k"))


def selected_view(run_scores: DataFrame, run_grades: DataFrame) -> DataFrame:
    """Per problem of one run: best rollout with its score, whether it is correct, and pass@k and pass@1."""
    from traceloom.operators.scoring import best_of_n

    best = best_of_n(run_scores).select("parent_id", F.col("id").alias("selected_id"), "rollout_id", "success_ratio", "prove_success_nodes", "lean_pass_nodes")
    graded = run_grades.select(F.col("id").alias("selected_id"), F.col("is_correct").alias("_ok"))
    facts = solved(run_grades).select("parent_id", "any_correct", "first_correct")
    return (
        best.join(graded, "selected_id", "left")
        .join(facts, "parent_id", "left")
        .select(
            "parent_id", "selected_id", "rollout_id",
            (F.coalesce("_ok", F.lit(0)) == 1).alias("selected_ok"),
            (F.coalesce("any_correct", F.lit(0)) == 1).alias("pass_k_ok"),
            (F.coalesce("first_correct", F.lit(0)) == 1).alias("pass_1_ok"),
            F.struct("success_ratio", "prove_success_nodes", "lean_pass_nodes", (-F.coalesce("rollout_id", F.lit(LAST_ROLLOUT))).alias("rollout")).alias("rank_key"),
        )
    )


def mine_cases(views: dict[str, DataFrame]) -> DataFrame:
    """Problems common to all runs, one row per bucket they fall in.

    ``wrong_score`` is the best score among wrong selections; the high-score report sorts by it.
    """
    fields = ["selected_id", "selected_ok", "pass_k_ok", "pass_1_ok", "rank_key"]
    tagged = [
        view.select("parent_id", F.struct(*fields).alias(f"_r{i}")) for i, view in enumerate(views.values())
    ]
    joined = reduce(lambda a, b: a.join(b, "parent_id"), tagged)
    runs = [F.col(f"_r{i}") for i in range(len(views))]
    every = lambda test: reduce(lambda a, b: a & b, [test(r) for r in runs])
    wrong = every(lambda r: ~r["selected_ok"])
    buckets = [
        F.when(every(lambda r: r["pass_k_ok"]) & wrong, F.lit(CASES_ANY[0])),
        F.when(every(lambda r: r["pass_1_ok"]) & wrong, F.lit(CASES_ANY[1])),
        F.when(~every(lambda r: r["selected_ok"]), F.lit(CASES_ANY[2])),
    ]
    if len(runs) == 2:
        a, b = runs
        buckets.append(F.when(~a["selected_ok"] & b["selected_ok"], F.lit(CASES_TWO[0])))
        buckets.append(F.when(a["selected_ok"] & ~b["selected_ok"], F.lit(CASES_TWO[1])))
    keys = [F.when(~r["selected_ok"], r["rank_key"]) for r in runs]
    best_wrong = F.greatest(*keys) if len(keys) > 1 else keys[0]
    return joined.select(
        "parent_id",
        F.explode(F.array_compact(F.array(*buckets))).alias("bucket"),
        best_wrong.alias("wrong_score"),
        F.array(*[r["selected_id"] for r in runs]).alias("selected_ids"),
    )


def case_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("bucket").agg(F.count("*").alias("cases"))


def top_cases(cases: DataFrame, limit: int) -> DataFrame:
    """First cases of each bucket: by score for the high-score bucket, by problem id for the others."""
    from traceloom.operators.ranks import top_per

    high = F.when(F.col("bucket") == CASES_ANY[2], F.col("wrong_score"))
    return top_per(cases, ["bucket"], [high.desc_nulls_last(), F.col("parent_id")], limit)


def select_case_rows(flat: DataFrame, cases: DataFrame, correct: DataFrame | None, mode: str) -> DataFrame:
    """Rollouts of the mined problems: all of them, the selected, the correct, or both of the latter."""
    if mode not in ("all-rollouts", "selected", "correct", "selected-and-correct"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "all-rollouts":
        return flat.join(cases.select("parent_id").distinct(), "parent_id", "left_semi")
    ids = []
    if mode in ("selected", "selected-and-correct"):
        ids.append(cases.select(F.explode("selected_ids").alias("id")))
    if mode in ("correct", "selected-and-correct"):
        ids.append(correct.where("is_correct = 1").join(cases.select("parent_id").distinct(), "parent_id", "left_semi").select("id"))
    return flat.join(reduce(DataFrame.union, ids).distinct(), "id", "left_semi")


def rollout_details(scored: DataFrame, grades: DataFrame, stages: dict[str, DataFrame], selected: DataFrame) -> DataFrame:
    """One row per rollout: place, score, grade and which stages have a record of it."""
    from traceloom.operators.scoring import rank_rollouts

    rows = rank_rollouts(scored).join(grades.select("id", "is_correct"), "id", "left")
    rows = rows.withColumn("grade_missing", F.col("is_correct").isNull())
    for name, records in stages.items():
        seen = records.select(F.col("record_id").alias("id")).distinct().withColumn(f"in_{name}", F.lit(True))
        rows = rows.join(seen, "id", "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    chosen = selected.select("id").withColumn("selected", F.lit(True))
    return rows.join(chosen, "id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def compare_nodes(base: DataFrame, runs: dict[str, DataFrame], fields: list[str], order: str) -> DataFrame:
    """Long table (record, fact, field, one column per run): each run's value for every node of ``base``.

    Where a run lists a node twice the last one by ``order`` counts.
    """
    keys = ["record_id", "fact_id"]
    rows = base.select(*keys).distinct()
    for name, nodes in runs.items():
        values = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
        rows = rows.join(nodes.groupBy(*keys).agg(F.max_by(values, order).alias(f"_{name}")), keys, "left")
    cells = [
        F.struct(F.lit(f).alias("field"), *[F.coalesce(F.col(f"_{name}.{f}"), F.lit("")).alias(name) for name in runs]) for f in fields
    ]
    return rows.select(*keys, F.inline(F.array(*cells)))
