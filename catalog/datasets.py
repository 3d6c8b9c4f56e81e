"""Samples, splits and dataset jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.evaluation import BEST, PICKS, grades, picks, selected
from catalog.stats import BUCKET, RATIOS
from catalog.views import graph_records, nodes, table, traces
from traceloom.functions.bins import percent_bucket
from traceloom.operators import datasets, sampling, scoring

HASH = lambda seed, key: f"md5(concat('{seed}', '|', {key}))"


@query("sample_n", f"SELECT id FROM grades ORDER BY {HASH(7, 'id')} LIMIT 250")
def sample_n(spark, sf_dir):
    return sampling.sample_n(grades(spark, sf_dir), 250, 7, "id").select("id")


@query("sample_n_large", f"SELECT id FROM grades ORDER BY {HASH(7, 'id')} LIMIT 1400")
def sample_n_large(spark, sf_dir):
    return sampling.sample_n(grades(spark, sf_dir), 1400, 7, "id").select("id")


@query("sample_where", f"SELECT id FROM grades WHERE is_correct = 1 ORDER BY {HASH(3, 'id')} LIMIT 100")
def sample_where(spark, sf_dir):
    return sampling.sample_where(grades(spark, sf_dir), F.col("is_correct") == 1, 100, 3, "id").select("id")


PER = f"per AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY {HASH(42, 'id')}) AS r FROM grades)"


@query("sample_per_source", f"WITH {PER} SELECT id, source FROM per WHERE r <= 40")
def sample_per_source(spark, sf_dir):
    return sampling.sample_per(grades(spark, sf_dir), "source", 40, 42, "id").select("id", "source")


@query("sample_per_source_large", f"WITH {PER} SELECT id, source FROM per WHERE r <= 2000")
def sample_per_source_large(spark, sf_dir):
    return sampling.sample_per(grades(spark, sf_dir), "source", 2000, 42, "id").select("id", "source")


@query("sample_per_source_total", f"WITH {PER} SELECT id, source FROM per WHERE r <= 40 ORDER BY {HASH(42, 'id')} LIMIT 90")
def sample_per_source_total(spark, sf_dir):
    return sampling.sample_per(grades(spark, sf_dir), "source", 40, 42, "id", total=90).select("id", "source")


STRATA = f"""{RATIOS}, strata AS (SELECT record_id, {BUCKET('prove_percent')} AS bucket, row_number() OVER (PARTITION BY {BUCKET('prove_percent')} ORDER BY {HASH(1, 'record_id')}) AS r
  FROM percents WHERE scope = 'exclude_skipped_derived'),
  bucket_order AS (SELECT concat(10 * i, '-', 10 * i + 10, '%') AS bucket, i AS place FROM range(10) t(i) UNION ALL SELECT '100%', 10)"""


def bucketed(spark, sf_dir):
    rows = scoring.record_ratios(nodes(spark, sf_dir)).where("scope = 'exclude_skipped_derived'")
    return rows.select("record_id", percent_bucket(F.col("prove_percent")).alias("bucket"))


@query("sample_stratified_fixed", f"WITH {STRATA} SELECT record_id, bucket FROM strata WHERE r <= 7")
def sample_stratified_fixed(spark, sf_dir):
    return sampling.sample_stratified(bucketed(spark, sf_dir), "bucket", 1, "record_id", per_bucket=7)


@query("sample_stratified_total", f"WITH {STRATA} SELECT record_id, bucket FROM strata JOIN bucket_order USING (bucket) ORDER BY r, place LIMIT 123")
def sample_stratified_total(spark, sf_dir):
    return sampling.sample_stratified(bucketed(spark, sf_dir), "bucket", 1, "record_id", n=123)


@query("batches", "SELECT id, (row_number() OVER (ORDER BY o_custkey, id) - 1) // 64 AS batch FROM grades")
def batches(spark, sf_dir):
    return sampling.batch_no(grades(spark, sf_dir), [F.col("o_custkey"), F.col("id")], 64).select("id", "batch")


@query(
    "split_by_ratio",
    f"""WITH placed AS (SELECT record_id, row_number() OVER (ORDER BY {HASH(42, 'record_id')}) AS r, count(*) OVER () AS n FROM traces)
    SELECT record_id, CASE WHEN r <= floor(n * 0.9) THEN 'train' WHEN r <= floor(n * 0.9) + floor(n * 0.06) THEN 'val' ELSE 'test' END AS split FROM placed""",
)
def split_by_ratio(spark, sf_dir):
    return sampling.split_by_ratio(traces(spark, sf_dir), "record_id", 0.9, 0.06).select("record_id", "split")


@query("split_by_range", "SELECT id, CASE WHEN r <= 1000 THEN 'train' ELSE 'val' END AS split FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM grades) WHERE r <= 1200")
def split_by_range(spark, sf_dir):
    return sampling.split_by_range(grades(spark, sf_dir), [F.col("id")], 1000, 200).select("id", "split")


# --- rollout shapes ----------------------------------------------------------------------------------------

WIDE_SQL = """wide AS (SELECT record_id AS id, source, raw_cot AS response_1, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END AS response_2,
   CASE WHEN doc_id % 5 > 0 THEN concat('<think>', source) END AS response_10 FROM traces)"""
CELLS = """cells AS (SELECT id, source, 1 AS rollout_id, response_1 AS response FROM wide UNION ALL SELECT id, source, 2, response_2 FROM wide UNION ALL SELECT id, source, 10, response_10 FROM wide),
   full_cells AS (SELECT * FROM cells WHERE response IS NOT NULL AND trim(response, chr(32) || chr(10)) <> '')"""


def wide(spark, sf_dir):
    rows = traces(spark, sf_dir)
    return rows.select(
        F.col("record_id").alias("id"), "source", F.lit("?").alias("question"), F.lit("4").alias("gold"),
        F.col("raw_cot").alias("response_1"),
        F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("response_2"),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("<think>"), "source")).alias("response_10"),
        F.lit("x").alias("response_x"),
    )


@query("unpivot_rollouts", f"WITH {WIDE_SQL}, {CELLS} SELECT id, CAST(rollout_id AS INT) AS rollout_id, response FROM full_cells")
def unpivot_rollouts(spark, sf_dir):
    return datasets.unpivot_rollouts(wide(spark, sf_dir)).select("id", "rollout_id", "response")


@query(
    "pivot_rollouts",
    """SELECT parent_id AS id, arg_min(source, rollout_id) AS source, max(answer) FILTER (rollout_id = 1) AS response_1, max(answer) FILTER (rollout_id = 2) AS response_2,
    max(answer) FILTER (rollout_id = 3) AS response_3, max(answer) FILTER (rollout_id = 4) AS response_4 FROM grades GROUP BY parent_id""",
)
def pivot_rollouts(spark, sf_dir):
    return datasets.pivot_rollouts(grades(spark, sf_dir).withColumnRenamed("answer", "response"))


SHUT = r"NOT regexp_matches(regexp_replace(response, '(?is)<think\b[^>]*>.*?</think>', '', 'g'), '(?i)<think\b[^>]*>')"


@query(
    "flatten_rollouts",
    f"""WITH {WIDE_SQL}, {CELLS} SELECT concat(id, '__rollout_', rollout_id) AS id, id AS parent_id, CAST(rollout_id AS INT) AS rollout_id, source, response FROM full_cells WHERE {SHUT}""",
)
def flatten_rollouts(spark, sf_dir):
    flat, _ = datasets.flatten_rollouts(wide(spark, sf_dir))
    return flat.select("id", "parent_id", "rollout_id", "source", "response")


@query(
    "flatten_rejected",
    f"""WITH {WIDE_SQL}, {CELLS} SELECT concat(id, '__rollout_', rollout_id) AS id, id AS parent_id, CAST(rollout_id AS INT) AS rollout_id, source, 'unclosed_think_block' AS reason FROM full_cells WHERE NOT ({SHUT})""",
)
def flatten_rejected(spark, sf_dir):
    return datasets.flatten_rollouts(wide(spark, sf_dir))[1]


@query("grading_inputs_random", "WITH " + PICKS + " SELECT seed, parent_id, id FROM picks")
def grading_inputs_random(spark, sf_dir):
    _, drawn, _ = datasets.grading_inputs(grades(spark, sf_dir), selected(spark, sf_dir), [0, 1, 2])
    return drawn.select("seed", "parent_id", "id")


@query("grading_inputs_selected", f"WITH {BEST} SELECT id, parent_id, rollout_id, success_ratio AS score_success_ratio, lean_verify_nodes AS score_lean_verify_nodes FROM ranked WHERE rank = 1")
def grading_inputs_selected(spark, sf_dir):
    _, _, chosen = datasets.grading_inputs(grades(spark, sf_dir), selected(spark, sf_dir), [0])
    return chosen.select("id", "parent_id", "rollout_id", "score_success_ratio", "score_lean_verify_nodes")


WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def solutions(spark, sf_dir):
    return traces(spark, sf_dir).select(
        "record_id", F.concat(F.lit("Find "), "source").alias("problem_text"), F.col("raw_cot").alias("solution"),
        F.col("lang").alias("reference_answer"), F.lit("documents").alias("source_file"), F.col("doc_id").alias("source_row_pos"),
    )


VISIBLE = rf"trim(regexp_replace(regexp_replace(raw_cot, '(?is)<think\b[^>]*>.*?</think>', '', 'g'), '(?is)<think\b[^>]*>.*$', ''), {WS})"


@query("prompt_rows", f"SELECT record_id, concat('Find ', source, chr(10), {VISIBLE}) AS asked FROM traces")
def prompt_rows(spark, sf_dir):
    rows = datasets.prompt_rows(solutions(spark, sf_dir), "", "{problem}\n{solution}", keep_think=False)
    return rows.select("record_id", F.get("prompt", F.lit(0))["content"].alias("asked"))


@query(
    "training_records",
    f"""WITH placed AS (SELECT *, row_number() OVER (ORDER BY {HASH(5, 'record_id')}) AS r, count(*) OVER () AS n FROM traces)
    SELECT record_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split, lang AS ground_truth, 'math' AS ability, doc_id AS source_row_pos,
    concat('Find ', source, ': ', raw_cot) AS asked FROM placed""",
)
def training_records(spark, sf_dir):
    rows = datasets.prepare_splits(solutions(spark, sf_dir), "", "{problem}: {solution}", "graphs", "plain", keep_think=True, train=0.8, val=0.1, seed=5)
    return rows.select(
        "extra_info.record_id", "split", "reward_model.ground_truth", "ability", "extra_info.source_row_pos", F.get("prompt", F.lit(0))["content"].alias("asked")
    )


@query("first_problems", f"SELECT parent_id, arg_min(record_id, doc_id) AS example_record_id, arg_min(trim(raw_cot, {WS}), doc_id) AS problem FROM (SELECT *, concat('g', doc_id // 4) AS parent_id FROM traces WHERE doc_id % 4 <> 0 AND trim(raw_cot, {WS}) <> '') GROUP BY parent_id")
def first_problems(spark, sf_dir):
    rows = traces(spark, sf_dir).withColumns(
        {
            "parent_id": F.concat(F.lit("g"), F.floor(F.col("doc_id") / 4).cast("string")),
            "problem": F.when(F.col("doc_id") % 4 == 0, F.lit(" \n ")).otherwise(F.col("raw_cot")),
        }
    )
    return datasets.first_problem(rows, F.col("doc_id"))


@query(
    "grade_answers",
    """SELECT p_partkey, CASE WHEN k IN (0, 1, 2) THEN 1 ELSE 0 END::INT AS is_correct, CASE k WHEN 0 THEN '1234.50' WHEN 1 THEN concat(chr(92), 'frac{', p_size, '}{3}') WHEN 2 THEN concat(p_size, '.0') WHEN 3 THEN CAST(p_size + 1 AS VARCHAR) END AS extracted_answer FROM (SELECT *, p_partkey % 4 AS k FROM part)""",
)
def grade_answers(spark, sf_dir):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    fraction = F.concat(F.lit("\\frac{"), size, F.lit("}{3}"))
    answer = (
        F.when(k == 0, F.lit("So $\\boxed{1}$, no: \\boxed{1,234.50}."))
        .when(k == 1, F.concat(F.lit("Thus \\boxed{"), fraction, F.lit("} holds")))
        .when(k == 2, F.concat(F.lit("it is "), size, F.lit(".0")))
        .otherwise(F.concat(F.lit("\\boxed{ "), (F.col("p_size") + 1).cast("string"), F.lit(" }")))
    )
    gold = F.when(k == 0, F.lit("1234.5")).when(k == 1, F.concat(F.lit("\\boxed{"), fraction, F.lit("}"))).otherwise(size)
    rows = table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"), gold.alias("gold"))
    return datasets.grade_answers(rows).select("p_partkey", "is_correct", "extracted_answer")


@query(
    "apply_categories",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'UNKNOWN' WHEN p_partkey % 3 = 1 THEN 'Geometry' WHEN p_size % 2 = 0 THEN 'Discrete & Prob' ELSE 'UNKNOWN' END AS category,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS reason FROM part""",
)
def apply_categories(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 3 == 1, "geometry").when(F.col("p_size") % 2 == 0, "Combinatorics").otherwise("poetry")
    item = lambda category: F.struct(F.col("p_partkey").cast("string").alias("parent_id"), category.alias("category"), F.col("p_name").alias("reason"))
    body = F.to_json(F.struct(F.array(item(F.lit("Algebra")), item(label)).alias("items")))
    responses = parts.select(
        F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("content")
    )
    problems = parts.select(F.col("p_partkey").cast("string").alias("parent_id"), "p_partkey")
    return datasets.apply_categories(problems, responses, "ord").select("p_partkey", "category", "reason")


@query(
    "apply_issues",
    """WITH f AS (SELECT record_id, fact_id, l_partkey AS k FROM nodes WHERE prove_status = 'failed')
    SELECT record_id, fact_id, CASE WHEN k % 9 = 0 THEN 'formalizer' WHEN k % 3 = 0 THEN 'prover' WHEN k % 3 = 1 THEN 'builder' ELSE 'prover' END AS main_issue,
      CASE WHEN k % 9 = 0 THEN 0.25 WHEN k % 3 = 1 THEN 0.5 ELSE 0.0 END AS confidence, CASE WHEN k % 9 = 0 OR k % 3 <> 0 THEN '' ELSE 'unreadable answer' END AS parse_error FROM f""",
)
def apply_issues(spark, sf_dir):
    k = F.col("l_partkey")
    failed = nodes(spark, sf_dir).where("prove_status = 'failed'").select("record_id", "fact_id", "l_partkey")
    content = (
        F.when(k % 3 == 0, "cannot say")
        .when(k % 3 == 1, F.lit('Verdict: {"main_issue": "Builder", "confidence": "0.5", "secondary_issues": ["prover"]}'))
        .otherwise(F.lit('{"main_issue": "luck", "confidence": "low"}'))
    )
    responses = failed.withColumn("content", content)
    previous = failed.where(k % 9 == 0).select(
        "record_id", "fact_id", F.lit(2).alias("context_schema_version"), F.lit("formalizer").alias("main_issue"), F.array().cast("array<string>").alias("secondary_issues"),
        F.lit("").alias("reason"), F.lit("").alias("evidence"), F.lit(0.25).alias("confidence"), F.lit("").alias("parse_error"),
    )
    rows = datasets.apply_issues(failed.select("record_id", "fact_id"), responses, previous)
    return rows.select("record_id", "fact_id", "main_issue", "confidence", "parse_error")


@query(
    "failure_payloads",
    """WITH placed AS (SELECT f.*, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS nth FROM facts f WHERE origin IN ('derived', 'answer') AND formalized AND NOT verified),
    near AS (SELECT p.record_id, p.pos, count(DISTINCT f.pos) AS n FROM placed p JOIN links l ON l.record_id = p.record_id AND l.pos = p.pos
       JOIN facts f ON f.record_id = l.record_id AND f.fact_id = l.parent_id GROUP BY ALL)
    SELECT p.record_id, p.fact_id, p.nth, coalesce(n.n, 0)::INT AS context_facts, CASE WHEN length(p.text) > 60 THEN concat(substr(p.text, 1, 60), chr(10), '...[truncated ', length(p.text) - 60, ' chars]') ELSE p.text END AS text
    FROM placed p LEFT JOIN near n ON n.record_id = p.record_id AND n.pos = p.pos""".replace("p.nth, ", ""),
)
def failure_payloads(spark, sf_dir):
    failed = lambda f: f["origin"].isin("derived", "answer") & f["formalized"] & ~f["verified"]
    rows = datasets.failure_payloads(graph_records(spark, sf_dir), failed, "direct", max_chars=60)
    return rows.select("record_id", "fact_id", F.size("context").alias("context_facts"), "node.text")


@query("failure_prompts")
def failure_prompts(spark, sf_dir):
    failed = lambda f: f["origin"].isin("derived", "answer") & f["formalized"] & ~f["verified"]
    rows = datasets.failure_payloads(graph_records(spark, sf_dir), failed, "ancestor", max_chars=200)
    asked = datasets.failure_prompts(rows, "", "Problem: {problem}\nWhy did this node fail?\n{payload}")
    return asked.select("record_id", "fact_id", F.md5(F.get("messages", F.lit(0))["content"]).alias("prompt_hash"))


@query("bench_rows", "SELECT CAST(item_id AS VARCHAR) AS id, concat('set', item_id % 3) AS source, text AS question, CAST(length(text) AS VARCHAR) AS gold FROM benchmark WHERE item_id % 7 <> 0")
def bench_rows(spark, sf_dir):
    raw = table(spark, sf_dir, "benchmark").select(
        "item_id", F.concat(F.lit("set"), F.col("item_id") % 3).alias("kind"), F.when(F.col("item_id") % 7 != 0, F.col("text")).alias("text"), F.length("text").alias("size")
    )
    return datasets.normalize_bench(raw, {"id": "item_id", "source": "kind", "question": "text", "gold": "size"})
