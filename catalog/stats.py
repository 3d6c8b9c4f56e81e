"""Verification statistics, status summaries and reward reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.views import grades, nodes, samples, table
from traceloom.functions.exact import sql_mean, sql_std_pop, sql_sum
from traceloom.operators import scoring, stats
from traceloom.sources import readers

FORMAL = "(form_status = 'success' OR (form_lean_pass AND NOT form_skipped))"
RATIOS = f"""base AS (SELECT *, origin IN ('derived', 'answer') AS need, origin IN ('derived', 'answer') AND NOT (origin = 'derived' AND skip = 1) AS need_x FROM nodes),
 per_record AS (
  SELECT record_id, scope, count(*) AS nodes, count(*) FILTER (is_final_answer AND NOT lean_verify) AS wrong_any,
    count(*) FILTER (use) AS req, count(*) FILTER (use AND lean_verify) AS ver, count(*) FILTER (use AND {FORMAL}) AS form, count(*) FILTER (use AND form_lean_pass) AS form_retry,
    count(*) FILTER (use AND (is_final_answer OR origin = 'answer')) AS fin, count(*) FILTER (use AND (is_final_answer OR origin = 'answer') AND lean_verify) AS fin_ver
  FROM (SELECT *, need AS use, 'include_skipped_derived' AS scope FROM base UNION ALL SELECT *, need_x, 'exclude_skipped_derived' FROM base) GROUP BY record_id, scope),
 percents AS (SELECT *, CASE WHEN req > 0 THEN ver / req * 100.0 ELSE 0.0 END AS prove_percent, CASE WHEN req > 0 THEN form / req * 100.0 ELSE 0.0 END AS form_percent FROM per_record)"""
BUCKET = lambda c: f"CASE WHEN {c} >= 100 THEN '100%' ELSE concat(CAST(floor({c} / 10) * 10 AS INT), '-', CAST(floor({c} / 10) * 10 + 10 AS INT), '%') END"


@query(
    "verification_stats",
    f"""WITH {RATIOS} SELECT scope, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(req) AS BIGINT) AS required_nodes, CAST(sum(ver) AS BIGINT) AS verified_nodes, CAST(sum(form) AS BIGINT) AS formal_nodes,
      count(*) FILTER (req > 0 AND ver = req) AS all_verified_records, count(*) FILTER (wrong_any > 0) AS final_wrong_records,
      round(count(*) FILTER (req > 0 AND ver = req) / count(*) * 100.0, 6) AS all_verified_ratio, round(count(*) FILTER (wrong_any > 0) / count(*) * 100.0, 6) AS final_wrong_ratio,
      round(sum(ver) / sum(req) * 100.0, 6) AS verified_ratio, round(sum(form) / sum(req) * 100.0, 6) AS formal_ratio FROM per_record GROUP BY scope""",
)
def verification_stats(spark, sf_dir):
    return scoring.verification_stats(nodes(spark, sf_dir))


@query(
    "verification_stats_retry",
    f"""WITH {RATIOS}, extra AS (SELECT count(*) AS empties FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
      SELECT scope, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(req) AS BIGINT) AS required_nodes, CAST(sum(ver) AS BIGINT) AS verified_nodes, CAST(sum(form_retry) AS BIGINT) AS formal_nodes,
      count(*) FILTER (req > 0 AND ver = req) AS all_verified_records, count(*) FILTER (fin > 0 AND fin_ver = 0) AS final_wrong_records,
      count(*) FILTER (req > 0 AND ver = req) / (count(*) + any_value(empties)) * 100.0 AS all_verified_ratio, count(*) FILTER (fin > 0 AND fin_ver = 0) / (count(*) + any_value(empties)) * 100.0 AS final_wrong_ratio,
      sum(ver) / sum(req) * 100.0 AS verified_ratio, sum(form_retry) / sum(req) * 100.0 AS formal_ratio FROM per_record, extra GROUP BY scope""",
)
def verification_stats_retry(spark, sf_dir):
    everything = nodes(spark, sf_dir)
    empties = grades(spark, sf_dir).join(everything, F.col("id") == F.col("record_id"), "left_anti").count()
    return scoring.verification_stats(everything, "retry", empties)


@query(
    "ratio_histogram",
    f"""WITH {RATIOS}, counted AS (SELECT scope, 'prove' AS stage, {BUCKET('prove_percent')} AS bucket FROM percents UNION ALL SELECT scope, 'form', {BUCKET('form_percent')} FROM percents),
    labels AS (SELECT concat(10 * i, '-', 10 * i + 10, '%') AS bucket FROM range(10) t(i) UNION ALL SELECT '100%')
    SELECT s.scope, s.stage, l.bucket, count(c.bucket) AS records FROM (SELECT DISTINCT scope, stage FROM counted) s CROSS JOIN labels l
    LEFT JOIN counted c ON c.scope = s.scope AND c.stage = s.stage AND c.bucket = l.bucket GROUP BY s.scope, s.stage, l.bucket""",
)
def ratio_histogram(spark, sf_dir):
    return scoring.ratio_histogram(nodes(spark, sf_dir))


@query(
    "bucket_top_ids",
    f"""WITH {RATIOS}, placed AS (SELECT {BUCKET('prove_percent')} AS bucket, record_id, CAST(row_number() OVER (PARTITION BY {BUCKET('prove_percent')} ORDER BY record_id) AS INT) AS rank
      FROM percents WHERE scope = 'include_skipped_derived') SELECT * FROM placed WHERE rank <= 5""",
)
def bucket_top_ids(spark, sf_dir):
    return scoring.top_ids(nodes(spark, sf_dir))


@query(
    "bucket_selection",
    f"""WITH {RATIOS}, placed AS (SELECT {BUCKET('prove_percent')} AS bucket, record_id, CAST(row_number() OVER (PARTITION BY {BUCKET('prove_percent')} ORDER BY record_id) AS INT) AS rank
      FROM percents WHERE scope = 'include_skipped_derived') SELECT bucket, rank, record_id FROM placed WHERE rank <= 10 AND bucket IN ('100%', '0-10%')""",
)
def bucket_selection(spark, sf_dir):
    return scoring.select_by_bucket(nodes(spark, sf_dir), ["100%", "0-10%"], 10).select("bucket", "rank", "record_id")


@query(
    "problem_ratio",
    f"""WITH {RATIOS} SELECT regexp_extract(record_id, '^(.*)__rollout_', 1) AS parent_id, {sql_mean('prove_percent', 9)} AS ratio_percent FROM percents
    WHERE scope = 'exclude_skipped_derived' GROUP BY ALL""",
)
def problem_ratio(spark, sf_dir):
    return scoring.problem_ratio(nodes(spark, sf_dir), False)


CATEGORY_ROWS = """category_rows AS (SELECT concat('p', o_orderkey // 4) AS parent_id, o_orderkey AS ord,
   list_extract(['Number Theory', 'Discrete & Prob', 'Calculus', 'Geometry', 'Algebra', 'Poetry'], CAST(o_custkey % 6 + 1 AS INT)) AS category FROM orders WHERE o_orderstatus <> 'P')"""
LAST_CATEGORY = """last_category AS (SELECT parent_id, CASE WHEN arg_max(category, ord) = 'Poetry' THEN 'UNKNOWN' ELSE arg_max(category, ord) END AS category FROM category_rows GROUP BY parent_id)"""


def categories(spark, sf_dir):
    names = ["Number Theory", "Discrete & Prob", "Calculus", "Geometry", "Algebra", "Poetry"]
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderstatus <> 'P'")
        .select(
            F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / 4).cast("string")).alias("parent_id"),
            F.col("o_orderkey").alias("ord"),
            F.get(F.array(*[F.lit(n) for n in names]), (F.col("o_custkey") % 6).cast("int")).alias("category"),
        )
    )


@query(
    "success_by_category",
    f"""WITH {RATIOS}, {CATEGORY_ROWS}, {LAST_CATEGORY},
    labels AS (SELECT unnest(['Number Theory', 'Discrete & Prob', 'Calculus', 'Geometry', 'Algebra', 'UNKNOWN']) AS category, unnest([0, 1, 2, 3, 4, 5]) AS category_order),
    rows AS (SELECT p.*, regexp_extract(p.record_id, '^(.*)__rollout_', 1) AS parent_id FROM percents p WHERE scope = 'exclude_skipped_derived'),
    named AS (SELECT r.*, coalesce(c.category, 'UNKNOWN') AS category FROM rows r LEFT JOIN last_category c USING (parent_id))
    SELECT l.category, l.category_order, count(DISTINCT parent_id) AS problem_count, count(parent_id) AS rollout_count, count(*) FILTER (req > 0) AS rollouts_with_required_nodes,
      count(*) FILTER (req > 0 AND ver = req) AS rollouts_all_required_prove_success, CAST(coalesce(sum(req), 0) AS BIGINT) AS prove_required_nodes, CAST(coalesce(sum(ver), 0) AS BIGINT) AS prove_success_nodes,
      coalesce(round(sum(ver) / nullif(sum(req), 0) * 100.0, 6), 0.0) AS node_prove_success_ratio,
      coalesce(round(count(*) FILTER (req > 0 AND ver = req) / nullif(count(*) FILTER (req > 0), 0) * 100.0, 6), 0.0) AS rollout_all_required_prove_success_ratio
    FROM labels l LEFT JOIN named n USING (category) GROUP BY l.category, l.category_order""",
)
def success_by_category(spark, sf_dir):
    return scoring.success_by_category(nodes(spark, sf_dir), categories(spark, sf_dir), "ord")


@query(
    "records_with_category",
    f"""WITH {CATEGORY_ROWS}, {LAST_CATEGORY} SELECT g.id, coalesce(c.category, 'UNKNOWN') AS category FROM grades g LEFT JOIN last_category c USING (parent_id)""",
)
def records_with_category(spark, sf_dir):
    return scoring.with_category(grades(spark, sf_dir), categories(spark, sf_dir), "ord").select("id", "category")


@query("required_nodes", "SELECT record_id, fact_id FROM nodes WHERE origin IN ('derived', 'answer') AND NOT (origin = 'derived' AND skip = 1)")
def required_nodes(spark, sf_dir):
    return scoring.required_nodes(nodes(spark, sf_dir), True).select("record_id", "fact_id")


@query(
    "unproved_nodes",
    """SELECT record_id, fact_id FROM nodes WHERE origin IN ('derived', 'answer') AND NOT (origin = 'derived' AND skip = 1) AND form_status = 'success' AND form_lean_pass
    AND NOT form_skipped AND NOT prove_skipped AND NOT (prove_status = 'success' AND lean_verify)""",
)
def unproved_nodes(spark, sf_dir):
    return scoring.unproved(nodes(spark, sf_dir)).select("record_id", "fact_id")


@query(
    "retry_eligible_nodes",
    """SELECT record_id, fact_id FROM nodes WHERE origin IN ('derived', 'answer') AND skip = 0 AND form_status = 'success' AND form_lean_pass
    AND NOT (prove_status = 'success' AND lean_verify)""",
)
def retry_eligible_nodes(spark, sf_dir):
    return scoring.retry_eligible(nodes(spark, sf_dir)).select("record_id", "fact_id")


MARKED = """marked AS (SELECT *, CASE WHEN prove_status = 'skipped' THEN 'skipped' WHEN lean_verify THEN 'success' ELSE 'failed' END AS outcome,
   CASE WHEN prove_status IN ('pending', 'running') THEN prove_status WHEN prove_skipped THEN 'skipped'
     WHEN contains(lower(error_msg), 'prompt token') THEN 'token_overflow' WHEN contains(lower(error_msg), 'truncated') THEN 'output_truncated'
     WHEN contains(lower(error_msg), 'no lean 4 code block') THEN 'extract_error' WHEN contains(lower(error_msg), 'sorry') THEN 'sorry_or_incomplete_proof'
     WHEN contains(lower(error_msg), 'timed out') THEN 'timeout' WHEN contains(lower(error_msg), '"severity": "error"') THEN 'lean_type_mismatch'
     WHEN contains(lower(error_msg), 'unknown constant') THEN 'lean_unknown_constant' WHEN contains(lower(error_msg), 'type mismatch') THEN 'lean_type_mismatch'
     WHEN contains(lower(error_msg), 'tactic') AND contains(lower(error_msg), 'failed') THEN 'lean_tactic_failed' WHEN contains(lower(error_msg), 'unsolved goals') THEN 'lean_unsolved_goals'
     WHEN lean_code <> '' THEN 'lean_error_other' WHEN error_msg = '' THEN 'failed_no_error_msg' ELSE 'other_error' END AS error_class FROM nodes)"""


@query(
    "node_status_summary",
    f"""WITH {MARKED} SELECT kind, name, count(*) AS nodes FROM (
      SELECT 'total' AS kind, 'nodes' AS name FROM marked UNION ALL SELECT 'origin', origin FROM marked UNION ALL SELECT 'status', prove_status FROM marked
      UNION ALL SELECT 'outcome', outcome FROM marked UNION ALL SELECT 'total', 'need' FROM marked WHERE outcome <> 'skipped'
      UNION ALL SELECT 'error', error_class FROM marked WHERE outcome = 'failed') GROUP BY kind, name""",
)
def node_status_summary(spark, sf_dir):
    return stats.node_status_summary(nodes(spark, sf_dir), "prove")


@query(
    "node_error_classes",
    f"WITH {MARKED} SELECT record_id, fact_id, outcome, CASE WHEN outcome = 'failed' THEN error_class END AS category FROM marked",
)
def node_error_classes(spark, sf_dir):
    return stats.with_outcome(nodes(spark, sf_dir), "prove").select("record_id", "fact_id", "outcome", "category")


@query(
    "error_examples",
    f"""WITH {MARKED} SELECT record_id, fact_id, origin, prove_status AS status, error_class AS category, trim(regexp_replace(error_msg, '\\s+', ' ', 'g')) AS error_msg FROM marked
    WHERE outcome = 'failed' ORDER BY record_id, pos, fact_id LIMIT 100""",
)
def error_examples(spark, sf_dir):
    return stats.error_examples(nodes(spark, sf_dir), "prove", ["record_id", "pos", "fact_id"])


@query(
    "record_status",
    """SELECT record_id, count(*) FILTER (form_status = 'success') AS form_success, count(*) FILTER (form_status = 'failed') AS form_failed, count(*) FILTER (form_status = 'skipped') AS form_skipped,
    count(*) FILTER (form_status = 'pending') AS form_pending, count(*) FILTER (form_status = 'running') AS form_running, count(*) FILTER (prove_status = 'success') AS prove_success,
    count(*) FILTER (prove_status = 'failed') AS prove_failed, count(*) FILTER (prove_status = 'skipped') AS prove_skipped, count(*) FILTER (prove_status = 'pending') AS prove_pending,
    count(*) FILTER (prove_status = 'running') AS prove_running,
    CASE WHEN count(*) FILTER (form_status = 'failed' OR prove_status = 'failed') > 0 THEN 'completed_with_failures' ELSE 'completed' END AS record_status FROM nodes GROUP BY record_id""",
)
def record_status(spark, sf_dir):
    return stats.record_status(nodes(spark, sf_dir))


@query("record_terminal", "SELECT record_id, bool_and(prove_status IN ('success', 'failed', 'skipped')) AS terminal FROM nodes GROUP BY record_id")
def record_terminal(spark, sf_dir):
    return stats.record_terminal(nodes(spark, sf_dir), "prove")


@query(
    "record_trace_summary",
    """SELECT record_id, count(*) AS nodes, count(*) FILTER (form_status = 'success') AS form_success, count(*) FILTER (form_status = 'failed') AS form_failed,
    count(*) FILTER (prove_status = 'success') AS prove_success, count(*) FILTER (prove_status = 'failed') AS prove_failed FROM nodes GROUP BY record_id""",
)
def record_trace_summary(spark, sf_dir):
    return stats.record_trace_summary(nodes(spark, sf_dir))


@query(
    "output_counts",
    """SELECT 'facts' AS output, count(*) AS rows FROM nodes UNION ALL SELECT 'grades', count(*) FROM grades UNION ALL SELECT 'failed', count(*) FROM nodes WHERE prove_status = 'failed'""",
)
def output_counts(spark, sf_dir):
    everything = nodes(spark, sf_dir)
    return stats.output_counts(
        {"facts": everything, "grades": grades(spark, sf_dir), "failed": everything.where("prove_status = 'failed'")}
    )


@query("source_counts", "SELECT source, count(*) AS rows FROM grades GROUP BY source")
def source_counts(spark, sf_dir):
    return stats.source_counts(grades(spark, sf_dir))


def _rounded(df):
    return df.withColumn("std_pop", F.round("std_pop", 6))


@query(
    "reward_by_step",
    f"""SELECT step, count(reward) AS n, coalesce({sql_mean('reward')}, 0) AS mean, round(coalesce({sql_std_pop('reward')}, 0), 6) AS std_pop, min(reward) AS min, max(reward) AS max,
    count(*) FILTER (reward_missing) AS missing, count(*) FILTER (NOT reward_missing AND reward IS NULL) AS invalid, CAST(grouping(step) AS TINYINT) AS overall
    FROM samples GROUP BY GROUPING SETS ((step), ())""",
)
def reward_by_step(spark, sf_dir):
    return _rounded(stats.reward_by_step(samples(spark, sf_dir), "reward_text"))


@query(
    "reward_histogram",
    """SELECT step, CAST(CASE WHEN reward = 1.0 THEN 39 ELSE trunc((reward + 1.0) / CAST(0.05 AS DOUBLE)) END AS INT) AS bin, count(*) AS rewards FROM samples WHERE reward BETWEEN -1.0 AND 1.0 GROUP BY ALL""",
)
def reward_histogram(spark, sf_dir):
    return stats.reward_histogram(samples(spark, sf_dir), field="reward_text")


def _trace_fields(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return rows.withColumns(
        {
            "score": F.col("reward_text"),
            "structure_score": (F.col("value") / 100).cast("string"),
            "validator": F.when(F.col("validator_passed"), F.lit("yes")).when(F.col("event_type") == "view", F.lit("0")).otherwise(F.lit("maybe")),
        }
    )


@query(
    "reward_trace_metrics",
    f"""SELECT step, field, count(x) AS n, coalesce({sql_mean('x')}, 0) AS mean, round(coalesce({sql_std_pop('x')}, 0), 6) AS std_pop, min(x) AS min, max(x) AS max,
    count(*) FILTER (lacking) AS missing, count(*) FILTER (NOT lacking AND x IS NULL) AS invalid FROM (
      SELECT step, 'score' AS field, reward AS x, reward_missing AS lacking FROM samples UNION ALL SELECT step, 'structure_score', value / 100, false FROM samples)
    GROUP BY GROUPING SETS ((step, field), (field))""",
)
def reward_trace_metrics(spark, sf_dir):
    numbers, _ = stats.reward_trace_by_step(_trace_fields(spark, sf_dir), ["score", "structure_score"], ["validator"])
    return _rounded(numbers)


@query(
    "reward_trace_flags",
    """SELECT step, field, count(v) AS n, count(*) FILTER (v) AS true_n, round(coalesce(avg(CAST(v AS INT)), 0), 6) AS true_rate FROM (
      SELECT step, 'validator' AS field, CASE WHEN validator_passed THEN true WHEN event_type = 'view' THEN false END AS v FROM samples UNION ALL SELECT step, 'valid_json', valid_json FROM samples)
    GROUP BY GROUPING SETS ((step, field), (field))""",
)
def reward_trace_flags(spark, sf_dir):
    _, flags = stats.reward_trace_by_step(_trace_fields(spark, sf_dir), ["score"], ["validator", "valid_json"])
    return flags.withColumn("true_rate", F.round("true_rate", 6))


@query(
    "reward_trace_scalars",
    """SELECT step, count(*) FILTER (k IN (1, 2, 3)) AS flags, count(*) FILTER (k IN (0, 2)) AS numbers, count(*) FILTER (k = 3) AS missing, count(*) FILTER (k IN (1, 4)) AS invalid
      FROM (SELECT event_id // 100 AS step, user_id % 5 AS k FROM events) GROUP BY step""",
)
def reward_trace_scalars(spark, sf_dir):
    """Fields of reward traces by their JSON type: a quoted number is a number and no flag, a true flag is no number."""
    traces = ['{"passed": "5.0", "score": "5.0"}', '{"passed": 5.0, "score": true}', '{"passed": true, "score": "1e1"}', '{"passed": "true", "score": null}', '{"passed": [1], "score": "x"}']
    trace = F.get(F.array(*[F.lit(t) for t in traces]), (F.col("user_id") % 5).cast("int"))
    step = F.floor(F.col("event_id") / 100).cast("string").alias("step")
    records = table(spark, sf_dir, "events").select(step, F.array(F.struct(F.lit("0.5").alias("reward"), trace.alias("trace"))).alias("rollouts"))
    spread, flags = stats.reward_trace_by_step(readers.explode_samples(records, ["score", "passed"]), ["score"], ["passed"])
    numbers = spread.where("step IS NOT NULL").select("step", F.col("n").alias("numbers"), "missing", "invalid")
    return flags.where("step IS NOT NULL").select("step", F.col("true_n").alias("flags")).join(numbers, "step")


@query(
    "sample_gaps",
    """SELECT count(*) AS records, count(*) FILTER (event_type = 'view') AS missing_step, count(*) FILTER (event_type = 'signup') AS missing_rollouts,
    CAST(sum(CASE WHEN event_type IN ('view', 'signup') THEN 0 ELSE 2 END) AS BIGINT) AS rollouts_seen FROM events""",
)
def sample_gaps(spark, sf_dir):
    pair = F.array(F.col("value"), F.col("value"))
    records = samples(spark, sf_dir).select(
        F.when(F.col("event_type") == "view", F.lit("true")).otherwise(F.col("step").cast("string")).alias("step"),
        F.when(F.col("event_type") != "signup", pair).alias("rollouts"),
    )
    return stats.sample_gaps(records)


TOKENS = """token_rows AS (SELECT CASE WHEN p_size % 5 = 1 THEN 'A' WHEN p_size % 5 = 2 THEN 'B' WHEN p_size % 5 = 3 AND l_linestatus = 'F' THEN 'C' WHEN p_size % 5 = 3 THEN 'D' END AS class,
   CAST(l_quantity * 20 AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS output_tokens FROM lineitem JOIN part ON l_partkey = p_partkey),
  long_tokens AS (SELECT class, 'input' AS measure, input_tokens AS tokens FROM token_rows WHERE class IS NOT NULL UNION ALL SELECT class, 'output', output_tokens FROM token_rows WHERE class IS NOT NULL
    UNION ALL SELECT class, 'sum', input_tokens + output_tokens FROM token_rows WHERE class IS NOT NULL)"""


def token_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        stats.outcome_class(F.col("p_size") % 5, F.col("l_linestatus") == "F").alias("class"),
        (F.col("l_quantity") * 20).cast("bigint").alias("input_tokens"),
        (F.floor("l_extendedprice") % 5000).alias("output_tokens"),
    )


@query("token_spread", f"WITH {TOKENS} SELECT class, measure, count(*) AS n, min(tokens) AS min, max(tokens) AS max, round(avg(tokens), 6) AS mean FROM long_tokens GROUP BY ALL")
def token_spread(spark, sf_dir):
    return stats.token_spread(token_rows(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(
    "token_histograms",
    f"""WITH {TOKENS}, binned AS (SELECT class, measure, CAST(CASE WHEN tokens < 256 THEN 0 ELSE length(bin(tokens // 256)) END AS INT) AS bin FROM long_tokens),
    tops AS (SELECT class, measure, max(bin) AS top FROM binned GROUP BY ALL)
    SELECT t.class, t.measure, CAST(b.i AS INT) AS bin, CASE WHEN b.i > t.top THEN concat('[', 256 << t.top, ',inf)') WHEN b.i = 0 THEN '[0,256)' ELSE concat('[', 256 << CAST(b.i - 1 AS INT), ',', 256 << CAST(b.i AS INT), ')') END AS range,
      count(x.bin) AS rows FROM tops t JOIN range(0, 40) b(i) ON b.i <= t.top + 1 LEFT JOIN binned x ON x.class = t.class AND x.measure = t.measure AND x.bin = b.i GROUP BY t.class, t.measure, b.i, t.top""",
)
def token_histograms(spark, sf_dir):
    return stats.token_histograms(token_rows(spark, sf_dir))


@query(
    "token_bins",
    """SELECT CASE WHEN n = 0 THEN '0' WHEN n < 128 THEN '0-128' WHEN n < 256 THEN '128-256' WHEN n < 512 THEN '256-512' WHEN n < 1024 THEN '512-1024' WHEN n < 2048 THEN '1024-2048'
      WHEN n < 4096 THEN '2048-4096' WHEN n < 8192 THEN '4096-8192' WHEN n < 16384 THEN '8192-16384' ELSE 'more' END AS range, count(*) AS rows, max(n) AS largest,
      round(count(*) / (SELECT count(*) FROM documents) * 100.0, 6) AS percent FROM (SELECT CAST(greatest(1, length(text) // 4) AS INT) AS n FROM documents) GROUP BY 1""",
)
def token_bins(spark, sf_dir):
    from traceloom.functions.chat import quarter_length

    rows = stats.token_bins(table(spark, sf_dir, "documents"), quarter_length(F.col("text")))
    return rows.withColumn("percent", F.round("percent", 6))


@query(
    "runtime_rollup",
    f"""SELECT *, CASE WHEN total_seconds > 0 THEN idle_seconds / total_seconds END AS idle_ratio FROM (
      SELECT event_type AS stage, epoch(max(ts)) - epoch(min(ts)) AS total_seconds, {sql_sum('value')} AS check_seconds, count(value) AS checks,
      {sql_mean('value')} AS seconds_per_check, {sql_sum('value / 10')} AS idle_seconds FROM events GROUP BY event_type)""",
)
def runtime_rollup(spark, sf_dir):
    origin = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    at = F.timestamp_diff("MICROSECOND", origin, F.col("ts").cast("timestamp_ntz")) / 1e6
    log = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), at.alias("started"), at.alias("ended"), F.col("value").alias("check_seconds"), (F.col("value") / 10).alias("idle_seconds")
    )
    return stats.runtime_rollup(log)


@query(
    "trace_gaps",
    """WITH r AS (SELECT doc_id % 7 AS step, list_filter([1, 2, 3], lambda i: doc_id % 11 <> 0) AS ids, doc_id FROM documents),
    u AS (SELECT step, doc_id, unnest(ids) AS i FROM r), steps AS (SELECT DISTINCT step FROM r)
    SELECT s.step, count(u.i) AS rollouts, count(*) FILTER (u.i IS NOT NULL AND (u.doc_id + u.i) % 5 = 1) AS missing_trace, count(*) FILTER (u.i IS NOT NULL AND (u.doc_id + u.i) % 5 = 2) AS invalid_trace,
    CAST(grouping(s.step) AS TINYINT) AS overall FROM steps s LEFT JOIN u USING (step) GROUP BY GROUPING SETS ((s.step), ())""",
)
def trace_gaps(spark, sf_dir):
    from traceloom.sources.readers import explode_samples

    docs = table(spark, sf_dir, "documents")
    kind = lambda i: (F.col("doc_id") + i) % 5
    trace = lambda i: F.when(kind(i) == 1, F.lit(None)).when(kind(i) == 2, F.lit("[1, 2]")).otherwise(F.to_json(F.struct(F.col("n_chars").alias("score"))))
    rollouts = F.transform(
        F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.col("doc_id") % 11 != 0),
        lambda i: F.struct(F.lit("0.5").alias("reward"), trace(i).alias("trace")),
    )
    records = docs.select((F.col("doc_id") % 7).cast("string").alias("step"), rollouts.alias("rollouts"))
    return stats.trace_gaps(explode_samples(records, ["score"]))


BINNED = "CAST(CASE WHEN reward = 1.0 THEN 39 WHEN reward BETWEEN -1.0 AND 1.0 THEN trunc((reward + 1.0) / CAST(0.05 AS DOUBLE)) END AS INT)"
BIN_COUNTS = ", ' ', ".join(f"count(*) FILTER (b = {k})" for k in range(40))
BIN_NAMES = " ".join(f"[{-1 + k * 0.05:.4g},{-1 + (k + 1) * 0.05:.4g}{')' if k < 39 else ']'}" for k in range(40))


@query(
    "reward_histogram_report",
    f"""SELECT step, concat({BIN_COUNTS}) AS hist, '{BIN_NAMES}' AS labels, CAST(grouping(step) AS TINYINT) AS overall
    FROM (SELECT step, {BINNED} AS b FROM samples) GROUP BY GROUPING SETS ((step), ())""",
)
def reward_histogram_report(spark, sf_dir):
    rows = stats.reward_histogram_report(samples(spark, sf_dir), field="reward_text")
    joined = {"hist": F.array_join(F.col("hist").cast("array<string>"), " "), "labels": F.array_join("labels", " ")}
    return rows.withColumns(joined)
