"""Record scores, best-of-N selection and verification statistics over the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.exact import exact_mean
from traceloom.functions.bins import bucket_labels, percent_bucket, small_table, zero_filled
from traceloom.operators.ranks import row_ranks, top_per
from traceloom.schemas import PROVED_ORIGINS

YES = lambda c: F.coalesce(c, F.lit(False))
# Fixed value: the rollout number a missing one counts as when ranking.
LAST_ROLLOUT = 10**9


def required(exclude_skipped: bool = False) -> Column:
    """Nodes that need a proof; ``exclude_skipped`` leaves out derived ones marked skip."""
    origin = F.lower(F.trim(F.coalesce(F.col("origin"), F.lit(""))))
    needed = origin.isin(PROVED_ORIGINS)
    return needed & ~((origin == "derived") & (F.coalesce(F.col("skip"), F.lit(0)) == 1)) if exclude_skipped else needed


def required_nodes(nodes: DataFrame, exclude_skipped: bool = False) -> DataFrame:
    return nodes.where(required(exclude_skipped))


def unproved(nodes: DataFrame) -> DataFrame:
    """Formalised nodes without a verified proof."""
    return nodes.where(
        required(True)
        & (F.col("form_status") == "success")
        & YES(F.col("form_lean_pass"))
        & ~YES(F.col("form_skipped"))
        & ~YES(F.col("prove_skipped"))
        & ~((F.col("prove_status") == "success") & YES(F.col("lean_verify")))
    )


def retry_eligible(nodes: DataFrame) -> DataFrame:
    """As ``unproved``, but any skip mark drops a node and the skipped payload is not looked at."""
    return nodes.where(
        required()
        & (F.coalesce(F.col("skip"), F.lit(0)) == 0)
        & (F.col("form_status") == "success")
        & YES(F.col("form_lean_pass"))
        & ~((F.col("prove_status") == "success") & YES(F.col("lean_verify")))
    )


def with_need(nodes: DataFrame) -> DataFrame:
    """Add ``_need`` and ``_need_x``, the two scopes of nodes to prove, as flags worked out once per node."""
    return nodes.withColumns({"_need": required(), "_need_x": required(True)})


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def score_records(nodes: DataFrame, keys: list[str] = ["record_id"]) -> DataFrame:
    """Node counts per record; the ratio divides by all required nodes, the skipped ones included."""
    needed = F.col("_need")
    counted = with_need(nodes).groupBy(*keys).agg(
        F.count_if(needed).alias("_all"),
        F.count_if("_need_x").alias("prove_required_nodes"),
        F.count_if(needed & (F.col("prove_status") == "success")).alias("prove_success_nodes"),
        F.count_if(needed & YES(F.col("lean_verify"))).alias("lean_verify_nodes"),
        F.count_if(needed & YES(F.col("lean_pass"))).alias("lean_pass_nodes"),
    )
    return counted.select(
        *keys,
        "prove_required_nodes",
        (F.col("_all") - F.col("prove_required_nodes")).alias("skip_derived_nodes"),
        "prove_success_nodes",
        "lean_verify_nodes",
        "lean_pass_nodes",
        ratio(F.col("prove_success_nodes"), F.col("_all")).alias("success_ratio"),
    )


# What a rollout without a scored record gets.
MISSING_SCORE = {
    "prove_required_nodes": 0,
    "skip_derived_nodes": 0,
    "prove_success_nodes": -1,
    "lean_verify_nodes": -1,
    "lean_pass_nodes": -1,
    "success_ratio": 0.0,
}


def attach_scores(rollouts: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """Rollouts with the scores of their records; a missing record gets the fixed defaults."""
    kept = scores.select(F.col("record_id").alias("_record"), *MISSING_SCORE)
    joined = rollouts.join(kept, rollouts[key] == kept["_record"], "left").drop("_record")
    return joined.fillna(MISSING_SCORE)


def preference() -> Column:
    """Sort key of rollouts, best first."""
    return F.struct(
        (-F.col("success_ratio")).alias("ratio"),
        (-F.col("prove_success_nodes")).alias("successes"),
        (-F.col("lean_pass_nodes")).alias("passes"),
        F.coalesce(F.col("rollout_id"), F.lit(LAST_ROLLOUT)).alias("rollout"),
    )


def best_of_n(scored: DataFrame, by: str = "parent_id") -> DataFrame:
    """Best rollout of each problem, by partial minima: no group is gathered."""
    rest = [c for c in scored.columns if c != by]
    return scored.groupBy(by).agg(F.min_by(F.struct(*rest), preference()).alias("_best")).select(by, "_best.*")


def rank_rollouts(scored: DataFrame, by: str = "parent_id", tie: str = "id") -> DataFrame:
    """All rollouts with their place within the problem."""
    return row_ranks(scored, [by], [preference(), F.col(tie)], "rank")


def record_ratios(nodes: DataFrame, keys: list[str] = ["record_id"], flavour: str = "report") -> DataFrame:
    """Counts each record contributes to the statistics, for both scopes, in one pass.

    ``report`` calls a node formalised on success or on a pass that was no placeholder, ``retry`` on a pass.
    """
    formal = YES(F.col("form_lean_pass"))
    if flavour == "report":
        formal = YES(F.col("form_status") == "success") | (formal & ~YES(F.col("form_skipped")))
    verified, final = YES(F.col("lean_verify")), YES(F.col("is_final_answer"))
    marked = with_need(nodes).withColumns({"_formal": formal, "_answer": final | (F.lower(F.trim("origin")) == "answer")})
    wide = [F.count("*").alias("nodes"), F.count_if(final & ~verified).alias("finals_unverified")]
    answer = F.col("_answer")
    for tag, scope in (("include", F.col("_need")), ("exclude", F.col("_need_x"))):
        wide += [
            F.count_if(scope).alias(f"{tag}_required"),
            F.count_if(scope & verified).alias(f"{tag}_verified"),
            F.count_if(scope & F.col("_formal")).alias(f"{tag}_formal"),
            F.count_if(scope & answer).alias(f"{tag}_finals"),
            F.count_if(scope & answer & verified).alias(f"{tag}_finals_verified"),
        ]
    counted = marked.groupBy(*keys).agg(*wide)
    fields = ["required", "verified", "formal", "finals", "finals_verified"]
    scopes = F.array(
        *[
            F.struct(F.lit(f"{tag}_skipped_derived").alias("scope"), *[F.col(f"{tag}_{f}").alias(f) for f in fields])
            for tag in ("include", "exclude")
        ]
    )
    rows = counted.select(*keys, "nodes", "finals_unverified", F.inline(scopes))
    return rows.withColumn("prove_percent", ratio(F.col("verified"), F.col("required")) * 100.0).withColumn(
        "form_percent", ratio(F.col("formal"), F.col("required")) * 100.0
    )


def verification_stats(nodes: DataFrame, flavour: str = "report", empty_records: int = 0) -> DataFrame:
    """One row per scope with totals and ratios in percent.

    ``report`` leaves records without nodes out and rounds to six places; ``retry`` counts ``empty_records`` in the
    denominators and does not round. The two also differ in what makes a final answer wrong.
    """
    rows = record_ratios(nodes, flavour=flavour)
    if flavour == "report":
        wrong = F.col("finals_unverified") > 0
    else:
        wrong = (F.col("finals") > 0) & (F.col("finals_verified") == 0)
    totals = rows.groupBy("scope").agg(
        F.count("*").alias("_records"),
        F.count_if((F.col("required") > 0) & (F.col("verified") == F.col("required"))).alias("all_verified_records"),
        F.count_if(wrong).alias("final_wrong_records"),
        F.sum("nodes").alias("nodes"),
        F.sum("required").alias("required_nodes"),
        F.sum("verified").alias("verified_nodes"),
        F.sum("formal").alias("formal_nodes"),
    )
    records = F.col("_records") + (empty_records if flavour == "retry" else 0)
    percent = lambda part, whole: ratio(part, whole) * 100.0
    tidy = (lambda c: F.round(c, 6)) if flavour == "report" else (lambda c: c)
    return totals.select(
        "scope",
        "nodes",
        "required_nodes",
        "verified_nodes",
        "formal_nodes",
        "all_verified_records",
        "final_wrong_records",
        tidy(percent(F.col("all_verified_records"), records)).alias("all_verified_ratio"),
        tidy(percent(F.col("final_wrong_records"), records)).alias("final_wrong_ratio"),
        tidy(percent(F.col("verified_nodes"), F.col("required_nodes"))).alias("verified_ratio"),
        tidy(percent(F.col("formal_nodes"), F.col("required_nodes"))).alias("formal_ratio"),
    )


def ratio_histogram(nodes: DataFrame, step: int = 10, flavour: str = "report") -> DataFrame:
    """Records per ratio bucket, scope and stage, empty buckets included."""
    rows = record_ratios(nodes, flavour=flavour)
    staged = rows.select(
        "scope",
        F.inline(
            F.array(
                F.struct(F.lit("prove").alias("stage"), percent_bucket(F.col("prove_percent"), step).alias("bucket")),
                F.struct(F.lit("form").alias("stage"), percent_bucket(F.col("form_percent"), step).alias("bucket")),
            )
        ),
    )
    counts = staged.groupBy("scope", "stage", "bucket").agg(F.count("*").alias("records"))
    dimension = small_table(
        nodes.sparkSession,
        ["scope", "stage", "bucket"],
        [
            (scope, stage, bucket)
            for scope in ("include_skipped_derived", "exclude_skipped_derived")
            for stage in ("prove", "form")
            for bucket in bucket_labels(step)
        ],
    )
    return zero_filled(counts, dimension, ["scope", "stage", "bucket"], ["records"])


def top_ids(nodes: DataFrame, n: int = 5, order: list[Column] | None = None, scope: str = "include_skipped_derived", keys: list[str] = ["record_id"], step: int = 10) -> DataFrame:
    """First ``n`` records of each proof-ratio bucket in input order."""
    rows = record_ratios(nodes, keys).where(F.col("scope") == scope)
    bucketed = rows.select(*keys, percent_bucket(F.col("prove_percent"), step).alias("bucket"))
    return top_per(bucketed, ["bucket"], order or [F.col(k) for k in keys], n).select("bucket", "rank", *keys)


def select_by_bucket(nodes: DataFrame, buckets: list[str], n: int, order: list[Column] | None = None, step: int = 10) -> DataFrame:
    """Top ids of the named buckets, bucket by bucket; an unknown label is an error."""
    unknown = [b for b in buckets if b not in bucket_labels(step)]
    if unknown:
        raise ValueError(f"unknown buckets {unknown}")
    wanted = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col("bucket"))
    return top_ids(nodes, n, order, step=step).where(wanted > 0).withColumn("bucket_order", wanted)


def problem_ratio(nodes: DataFrame, include_skipped: bool, keys: list[str] = ["parent_id"]) -> DataFrame:
    """Mean over a problem's rollouts of their proof ratio in percent; 0 for a rollout with nothing to prove.

    The ratios are added up in whole units of 10^-9 percent, so that neither the mean nor its bucket hangs on summing order.
    """
    scope = required(not include_skipped)
    per_record = nodes.groupBy(*keys, "record_id").agg(
        F.count_if(scope).alias("_need"), F.count_if(scope & YES(F.col("lean_verify"))).alias("_done")
    )
    return per_record.groupBy(*keys).agg(exact_mean(ratio(F.col("_done"), F.col("_need")) * 100.0, 9).alias("ratio_percent"))


def with_category(records: DataFrame, categories: DataFrame, order: str) -> DataFrame:
    """Add ``category``: the last mapping of a problem wins, unknown labels become UNKNOWN."""
    from traceloom.functions.coerce import CATEGORIES

    last = categories.groupBy("parent_id").agg(F.max_by("category", order).alias("_category"))
    known = F.when(F.col("_category").isin(CATEGORIES), F.col("_category")).otherwise(F.lit("UNKNOWN"))
    return records.join(last, "parent_id", "left").withColumn("category", known).drop("_category")


def success_by_category(nodes: DataFrame, categories: DataFrame, order: str, include_skipped: bool = False) -> DataFrame:
    """Problems, rollouts and node counts per category in fixed order, empty ones included."""
    from traceloom.functions.coerce import CATEGORIES

    scope = required(not include_skipped)
    per_record = nodes.groupBy("parent_id", "record_id").agg(
        F.count_if(scope).alias("_need"), F.count_if(scope & YES(F.col("lean_verify"))).alias("_done")
    )
    per_problem = per_record.groupBy("parent_id").agg(
        F.count("*").alias("rollout_count"),
        F.count_if(F.col("_need") > 0).alias("rollouts_with_required_nodes"),
        F.count_if((F.col("_need") > 0) & (F.col("_done") == F.col("_need"))).alias("rollouts_all_required_prove_success"),
        F.sum("_need").alias("prove_required_nodes"),
        F.sum("_done").alias("prove_success_nodes"),
    )
    sums = ["rollout_count", "rollouts_with_required_nodes", "rollouts_all_required_prove_success", "prove_required_nodes", "prove_success_nodes"]
    counts = (
        with_category(per_problem, categories, order)
        .groupBy("category")
        .agg(F.count("*").alias("problem_count"), *[F.sum(s).alias(s) for s in sums])
    )
    labels = CATEGORIES + ["UNKNOWN"]
    dimension = small_table(nodes.sparkSession, ["category_order", "category"], list(enumerate(labels)))
    filled = zero_filled(counts, dimension, ["category"], ["problem_count", *sums])
    percent = lambda part, whole: F.round(ratio(F.col(part), F.col(whole)) * 100.0, 6)
    return filled.withColumn("node_prove_success_ratio", percent("prove_success_nodes", "prove_required_nodes")).withColumn(
        "rollout_all_required_prove_success_ratio", percent("rollouts_all_required_prove_success", "rollouts_with_required_nodes")
    )
