"""Scores, selections, accuracies and case mining over the node and grade views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.views import grades, nodes
from traceloom.operators import evaluate as ev
from traceloom.operators import sampling, scoring
from traceloom.plans import rerank

SCORES = """scores AS (
  SELECT record_id, count(*) FILTER (need AND NOT (origin = 'derived' AND skip = 1)) AS prove_required_nodes,
         count(*) FILTER (need AND origin = 'derived' AND skip = 1) AS skip_derived_nodes,
         count(*) FILTER (need AND prove_status = 'success') AS prove_success_nodes,
         count(*) FILTER (need AND lean_verify) AS lean_verify_nodes, count(*) FILTER (need AND lean_pass) AS lean_pass_nodes,
         CASE WHEN count(*) FILTER (need) > 0 THEN count(*) FILTER (need AND prove_status = 'success') / count(*) FILTER (need) ELSE 0.0 END AS success_ratio
  FROM (SELECT *, origin IN ('derived', 'answer') AS need FROM nodes) GROUP BY record_id)"""
SCORED = """scored AS (
  SELECT g.id, g.parent_id, g.rollout_id, g.source, g.is_correct, coalesce(prove_required_nodes, 0) AS prove_required_nodes,
         coalesce(skip_derived_nodes, 0) AS skip_derived_nodes, coalesce(prove_success_nodes, -1) AS prove_success_nodes,
         coalesce(lean_verify_nodes, -1) AS lean_verify_nodes, coalesce(lean_pass_nodes, -1) AS lean_pass_nodes, coalesce(success_ratio, 0.0) AS success_ratio
  FROM grades g LEFT JOIN scores s ON s.record_id = g.id)"""
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY success_ratio DESC, prove_success_nodes DESC, lean_pass_nodes DESC, rollout_id, id) AS rank FROM scored)"""
SOLVED = """solved AS (SELECT parent_id, max(is_correct) AS any_correct, max(CASE WHEN rollout_id = 1 THEN is_correct ELSE 0 END) AS first_correct,
   arg_min(source, rollout_id) AS source, max(rollout_id) AS k FROM grades GROUP BY parent_id)"""
BEST = f"{SCORES}, {SCORED}, {RANKED}"
SEEDS = [0, 1, 2]
PICKS = """picks AS (SELECT seed, arg_min(is_correct, md5(concat(seed, '|', id))) AS is_correct, arg_min(id, md5(concat(seed, '|', id))) AS id,
   arg_min(source, md5(concat(seed, '|', id))) AS source, parent_id
   FROM grades, (SELECT unnest([0, 1, 2]) AS seed) GROUP BY seed, parent_id)"""


def scored(spark, sf_dir):
    rollouts = grades(spark, sf_dir).select("id", "parent_id", "rollout_id", "source", "is_correct")
    return scoring.attach_scores(rollouts, scoring.score_records(nodes(spark, sf_dir)))


def selected(spark, sf_dir):
    return scoring.best_of_n(scored(spark, sf_dir))


def picks(spark, sf_dir):
    rows = grades(spark, sf_dir).select("id", "parent_id", "source", "is_correct")
    return sampling.pick_one(rows, "parent_id", SEEDS, "id")


@query("record_scores", f"WITH {SCORES} SELECT * FROM scores")
def record_scores(spark, sf_dir):
    return scoring.score_records(nodes(spark, sf_dir))


@query("rollout_scores", f"WITH {SCORES}, {SCORED} SELECT * FROM scored")
def rollout_scores(spark, sf_dir):
    return scored(spark, sf_dir)


@query("best_of_n", f"WITH {BEST} SELECT * EXCLUDE (rank) FROM ranked WHERE rank = 1")
def best_of_n(spark, sf_dir):
    return selected(spark, sf_dir)


@query("rollout_ranks", f"WITH {BEST} SELECT id, parent_id, rank FROM ranked")
def rollout_ranks(spark, sf_dir):
    return scoring.rank_rollouts(scored(spark, sf_dir)).select("id", "parent_id", "rank")


RUN = f"""WITH {BEST}, {SOLVED}, {PICKS}, parts AS (
   SELECT concat('random_seed_', seed) AS metric, source, is_correct AS v FROM picks
   UNION ALL SELECT 'pass@1', source, is_correct FROM grades WHERE rollout_id = 1
   UNION ALL SELECT concat('pass@', (SELECT max(k) FROM solved)), source, any_correct FROM solved
   UNION ALL SELECT 'ours', source, is_correct FROM ranked WHERE rank = 1)
 SELECT metric, coalesce(source, 'avg') AS source, avg(v) AS value FROM parts GROUP BY GROUPING SETS ((metric, source), (metric))
 UNION ALL SELECT 'hit_rate', 'avg', avg(coalesce(r.is_correct, 0)) FROM solved s LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (parent_id) WHERE any_correct = 1"""


@query("rerank_report", RUN)
def rerank_report(spark, sf_dir):
    """The whole rerank evaluation in one plan."""
    return rerank.rerank_report(nodes(spark, sf_dir), grades(spark, sf_dir), SEEDS)


CHOSEN = "(SELECT * FROM grades WHERE source IN ('1-URGENT', '2-HIGH'))"


@query(
    "chosen_source_summary",
    f"""SELECT metric, value FROM ({RUN.replace('FROM grades', f'FROM {CHOSEN}')}) WHERE source = 'avg'
    UNION ALL SELECT 'selected', CAST(count(DISTINCT parent_id) AS DOUBLE) FROM {CHOSEN}""",
)
def chosen_source_summary(spark, sf_dir):
    return rerank.source_summary(nodes(spark, sf_dir), grades(spark, sf_dir), SEEDS, [" 1-URGENT", "2-HIGH", ""])


@query(
    "metrics_wide",
    f"""SELECT metric, max(value) FILTER (source = '1-URGENT') AS "1-URGENT", max(value) FILTER (source = '2-HIGH') AS "2-HIGH",
       max(value) FILTER (source = '3-MEDIUM') AS "3-MEDIUM", max(value) FILTER (source = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED",
       max(value) FILTER (source = '5-LOW') AS "5-LOW", max(value) FILTER (source = 'avg') AS "avg" FROM ({RUN}) GROUP BY metric""",
)
def metrics_wide(spark, sf_dir):
    from traceloom.sources.sinks import wide_metrics

    return wide_metrics(rerank_report(spark, sf_dir))


@query("accuracy_by_source", "SELECT source, count(*) AS total, CAST(sum(is_correct) AS BIGINT) AS correct, avg(is_correct) AS accuracy, CAST(grouping(source) AS TINYINT) AS overall FROM grades GROUP BY GROUPING SETS ((source), ())")
def accuracy_by_source(spark, sf_dir):
    return ev.accuracy_with_sources(grades(spark, sf_dir))


@query("accuracy_overall", "SELECT count(*) AS total, CAST(sum(is_correct) AS BIGINT) AS correct, avg(is_correct) AS accuracy FROM grades")
def accuracy_overall(spark, sf_dir):
    return ev.accuracy(grades(spark, sf_dir))


@query("pass_at_1", "SELECT source, count(*) AS total, CAST(sum(is_correct) AS BIGINT) AS correct, avg(is_correct) AS accuracy FROM grades WHERE rollout_id = 1 GROUP BY source")
def pass_at_1(spark, sf_dir):
    return ev.accuracy(ev.first_rollout(grades(spark, sf_dir)), ["source"])


@query("pass_at_k", f"""WITH {SOLVED} SELECT source, count(*) AS total, CAST(sum(any_correct) AS BIGINT) AS correct, avg(any_correct) AS accuracy, (SELECT max(k) FROM solved) AS k,
   CAST(grouping(source) AS TINYINT) AS overall FROM solved GROUP BY GROUPING SETS ((source), ())""")
def pass_at_k(spark, sf_dir):
    return ev.pass_at_k(grades(spark, sf_dir))


@query("random_baseline", f"""WITH {PICKS}, runs AS (SELECT seed, avg(is_correct) AS a FROM picks GROUP BY seed)
   SELECT count(*) AS runs, round(avg(a), 9) AS mean_accuracy, round(stddev_pop(a), 9) AS std_accuracy FROM runs""")
def random_baseline(spark, sf_dir):
    rows = ev.random_baseline(picks(spark, sf_dir))
    return rows.select("runs", F.round("mean_accuracy", 9).alias("mean_accuracy"), F.round("std_accuracy", 9).alias("std_accuracy"))


@query("random_picks", f"WITH {PICKS} SELECT seed, parent_id, id, source, is_correct FROM picks")
def random_picks(spark, sf_dir):
    return picks(spark, sf_dir)


@query("selection_hits", f"""WITH {BEST}, {SOLVED} SELECT s.parent_id, s.source, coalesce(r.is_correct, 0) AS hit FROM solved s
   LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (parent_id) WHERE any_correct = 1""")
def selection_hits(spark, sf_dir):
    return ev.selection_hits(selected(spark, sf_dir), grades(spark, sf_dir))


@query("selection_hit_rate", f"""WITH {BEST}, {SOLVED} SELECT CAST(sum(coalesce(r.is_correct, 0)) AS BIGINT) AS hits, count(*) AS solvable, avg(coalesce(r.is_correct, 0)) AS hit_rate
   FROM solved s LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (parent_id) WHERE any_correct = 1""")
def selection_hit_rate(spark, sf_dir):
    return ev.selection_hit_rate(selected(spark, sf_dir), grades(spark, sf_dir))


@query("correct_rollouts", "SELECT parent_id, coalesce(string_agg(rollout_id, ',' ORDER BY rollout_id) FILTER (is_correct = 1), '') AS correct_rollouts FROM grades GROUP BY parent_id")
def correct_rollouts(spark, sf_dir):
    rows = ev.correct_rollouts(grades(spark, sf_dir))
    return rows.select("parent_id", F.array_join(F.transform("correct_rollouts", lambda r: r.cast("string")), ",").alias("correct_rollouts"))


@query("source_summary", f"""WITH {BEST} SELECT source, count(*) AS total, CAST(sum(is_correct) AS BIGINT) AS correct, avg(is_correct) AS accuracy
   FROM ranked WHERE rank = 1 AND source IN ('1-URGENT', '5-LOW') GROUP BY source""")
def source_summary(spark, sf_dir):
    return ev.accuracy(ev.filter_sources(selected(spark, sf_dir), ["1-URGENT", "5-LOW"]), ["source"])


# --- two runs: the second one grades and scores with other columns -----------------------------------------

SECOND_GRADES = "grades_b AS (SELECT * REPLACE (CAST(CASE WHEN answer = 'O' OR o_custkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS is_correct) FROM grades)"
VIEW_A = """view_a AS (SELECT r.parent_id, r.id, r.rollout_id, coalesce(r.is_correct, 0) = 1 AS ok, s.any_correct = 1 AS k_ok, s.first_correct = 1 AS one_ok,
   r.success_ratio, r.prove_success_nodes, r.lean_pass_nodes FROM ranked r JOIN solved s USING (parent_id) WHERE rank = 1)"""
VIEW_B = """scores_b AS (SELECT record_id, count(*) FILTER (lean_verify) AS won, count(*) AS n FROM nodes WHERE origin IN ('derived', 'answer') GROUP BY record_id),
  ranked_b AS (SELECT g.*, coalesce(s.won / s.n, 0.0) AS success_ratio, coalesce(s.won, -1) AS prove_success_nodes, -1 AS lean_pass_nodes,
     row_number() OVER (PARTITION BY parent_id ORDER BY coalesce(s.won / s.n, 0.0) DESC, coalesce(s.won, -1) DESC, rollout_id) AS rank FROM grades_b g LEFT JOIN scores_b s ON s.record_id = g.id),
  solved_b AS (SELECT parent_id, max(is_correct) AS any_correct, max(CASE WHEN rollout_id = 1 THEN is_correct ELSE 0 END) AS first_correct FROM grades_b GROUP BY parent_id),
  view_b AS (SELECT r.parent_id, r.id, r.rollout_id, r.is_correct = 1 AS ok, s.any_correct = 1 AS k_ok, s.first_correct = 1 AS one_ok,
   r.success_ratio, r.prove_success_nodes, r.lean_pass_nodes FROM ranked_b r JOIN solved_b s USING (parent_id) WHERE rank = 1)"""
CASES = f"""{BEST}, {SOLVED}, {SECOND_GRADES}, {VIEW_A}, {VIEW_B},
  both_runs AS (SELECT a.parent_id, a.ok AS a_ok, b.ok AS b_ok, a.k_ok AND b.k_ok AS k_ok, a.one_ok AND b.one_ok AS one_ok, a.id AS a_id, b.id AS b_id,
     greatest(CASE WHEN NOT a.ok THEN row(a.success_ratio, a.prove_success_nodes, a.lean_pass_nodes, -a.rollout_id) END,
              CASE WHEN NOT b.ok THEN row(b.success_ratio, b.prove_success_nodes, b.lean_pass_nodes, -b.rollout_id) END) AS wrong_score
     FROM view_a a JOIN view_b b USING (parent_id)),
  cases AS (SELECT *, 'pass4_correct_selected_wrong' AS bucket FROM both_runs WHERE k_ok AND NOT a_ok AND NOT b_ok
    UNION ALL SELECT *, 'pass1_correct_selected_wrong' FROM both_runs WHERE one_ok AND NOT a_ok AND NOT b_ok
    UNION ALL SELECT *, 'high_score_wrong' FROM both_runs WHERE NOT (a_ok AND b_ok)
    UNION ALL SELECT *, 'a_wrong_b_correct' FROM both_runs WHERE NOT a_ok AND b_ok
    UNION ALL SELECT *, 'a_correct_b_wrong' FROM both_runs WHERE a_ok AND NOT b_ok)"""


def second_grades(spark, sf_dir):
    right = (F.col("answer") == "O") | (F.col("o_custkey") % 5 == 0)
    return grades(spark, sf_dir).withColumn("is_correct", F.when(right, 1).otherwise(0))


def second_scored(spark, sf_dir):
    needed = scoring.required_nodes(nodes(spark, sf_dir))
    won = needed.groupBy("record_id").agg(F.count_if("lean_verify").alias("_won"), F.count("*").alias("_n"))
    joined = second_grades(spark, sf_dir).join(won, F.col("id") == F.col("record_id"), "left")
    return joined.select(
        "id", "parent_id", "rollout_id", "source", "is_correct",
        F.coalesce(F.col("_won") / F.col("_n"), F.lit(0.0)).alias("success_ratio"),
        F.coalesce("_won", F.lit(-1)).alias("prove_success_nodes"),
        F.lit(-1).cast("bigint").alias("lean_pass_nodes"),
    )


def cases(spark, sf_dir):
    return ev.mine_cases(
        {
            "a": ev.selected_view(scored(spark, sf_dir), grades(spark, sf_dir)),
            "b": ev.selected_view(second_scored(spark, sf_dir), second_grades(spark, sf_dir)),
        }
    )


@query("case_mining", f"WITH {CASES} SELECT parent_id, bucket, a_id, b_id FROM cases")
def case_mining(spark, sf_dir):
    rows = cases(spark, sf_dir)
    return rows.select("parent_id", "bucket", F.get("selected_ids", F.lit(0)).alias("a_id"), F.get("selected_ids", F.lit(1)).alias("b_id"))


@query("case_counts", f"WITH {CASES} SELECT bucket, count(*) AS cases FROM cases GROUP BY bucket")
def case_counts(spark, sf_dir):
    return ev.case_counts(cases(spark, sf_dir))


@query("case_top", f"""WITH {CASES}, placed AS (SELECT parent_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN bucket = 'high_score_wrong' THEN wrong_score END DESC NULLS LAST, parent_id) AS rank FROM cases)
   SELECT parent_id, bucket, CAST(rank AS INT) AS rank FROM placed WHERE rank <= 20""")
def case_top(spark, sf_dir):
    return ev.top_cases(cases(spark, sf_dir), 20).select("parent_id", "bucket", "rank")


@query("case_rollouts_all", f"WITH {CASES} SELECT id, parent_id, rollout_id FROM grades WHERE parent_id IN (SELECT parent_id FROM cases)")
def case_rollouts_all(spark, sf_dir):
    return ev.select_case_rows(grades(spark, sf_dir), cases(spark, sf_dir), None, "all-rollouts").select("id", "parent_id", "rollout_id")


@query("case_rollouts_selected", f"""WITH {CASES} SELECT id, parent_id, rollout_id FROM grades WHERE id IN (SELECT a_id FROM cases UNION SELECT b_id FROM cases)
   OR id IN (SELECT id FROM grades_b WHERE is_correct = 1 AND parent_id IN (SELECT parent_id FROM cases))""")
def case_rollouts_selected(spark, sf_dir):
    return ev.select_case_rows(grades(spark, sf_dir), cases(spark, sf_dir), second_grades(spark, sf_dir), "selected-and-correct").select("id", "parent_id", "rollout_id")


@query("common_problems", "SELECT parent_id FROM grades WHERE rollout_id = 1 INTERSECT SELECT parent_id FROM nodes")
def common_problems(spark, sf_dir):
    from traceloom.operators.ids import common_ids

    return common_ids(ev.first_rollout(grades(spark, sf_dir)).select("parent_id"), nodes(spark, sf_dir).select("parent_id"))


@query("rollout_details", f"""WITH {BEST} SELECT r.id, r.parent_id, r.rank, r.success_ratio, g.is_correct, g.id IS NULL AS grade_missing, n.record_id IS NOT NULL AS in_stage2,
   v.record_id IS NOT NULL AS in_stage3, r.rank = 1 AS selected FROM ranked r LEFT JOIN (SELECT * FROM grades WHERE answer <> 'P') g USING (id)
   LEFT JOIN (SELECT DISTINCT record_id FROM nodes) n ON n.record_id = r.id LEFT JOIN (SELECT DISTINCT record_id FROM nodes WHERE lean_verify) v ON v.record_id = r.id""")
def rollout_details(spark, sf_dir):
    everything = nodes(spark, sf_dir)
    rows = ev.rollout_details(
        scored(spark, sf_dir).drop("is_correct"),
        grades(spark, sf_dir).where("answer <> 'P'"),
        {"stage2": everything, "stage3": everything.where("lean_verify")},
        selected(spark, sf_dir),
    )
    return rows.select("id", "parent_id", "rank", "success_ratio", "is_correct", "grade_missing", "in_stage2", "in_stage3", "selected")


@query("compare_nodes", """WITH a AS (SELECT record_id, fact_id, arg_max(prove_status, l_extendedprice) AS prove_status, arg_max(form_status, l_extendedprice) AS form_status FROM nodes GROUP BY ALL),
   b AS (SELECT record_id, fact_id, arg_max(prove_status, l_extendedprice) AS prove_status, arg_max(CASE WHEN l_quantity < 20 THEN 'failed' ELSE form_status END, l_extendedprice) AS form_status FROM nodes WHERE l_quantity < 40 GROUP BY ALL)
   SELECT a.record_id, a.fact_id, 'form_status' AS field, a.form_status AS first, coalesce(b.form_status, '') AS second FROM a LEFT JOIN b USING (record_id, fact_id)
   UNION ALL SELECT a.record_id, a.fact_id, 'prove_status', a.prove_status, coalesce(b.prove_status, '') FROM a LEFT JOIN b USING (record_id, fact_id)""")
def compare_nodes(spark, sf_dir):
    first = nodes(spark, sf_dir)
    second = first.where("l_quantity < 40").withColumn("form_status", F.when(F.col("l_quantity") < 20, "failed").otherwise(F.col("form_status")))
    return ev.compare_nodes(first, {"first": first, "second": second}, ["form_status", "prove_status"], "l_extendedprice")


@query("available_sources", "SELECT source, true AS shown_by_default FROM grades UNION SELECT source, true FROM documents")
def available_sources(spark, sf_dir):
    from catalog.views import table

    return ev.available_sources(grades(spark, sf_dir), table(spark, sf_dir, "documents"))


@query("first_rollouts", "SELECT id, parent_id FROM grades WHERE rollout_id = 1")
def first_rollouts(spark, sf_dir):
    return ev.first_rollout(grades(spark, sf_dir)).select("id", "parent_id")
