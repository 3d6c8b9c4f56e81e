"""Attempt-log state, retries and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.graphs import FINDINGS, OBLIGATIONS
from catalog.views import attempts, fact_log, graph_records, grades, nodes, table
from traceloom.operators import attempts as at
from traceloom.operators import reward, stats

KIND = "CASE WHEN token_overflow THEN 'token_overflow' WHEN api_error THEN 'api_error' WHEN output_truncated THEN 'output_truncated' WHEN no_code THEN 'extract_error' ELSE 'validated' END"
KIND_PROVE = "CASE WHEN token_overflow THEN 'token_overflow' WHEN output_truncated THEN 'output_truncated' WHEN no_code THEN 'extract_error' ELSE 'validated' END"


def status(kind, passed, spent):
    return f"CASE WHEN {kind} = 'validated' AND {passed} THEN 'success' WHEN {kind} = 'token_overflow' OR {spent} THEN 'failed' ELSE 'pending' END"


@query("attempt_kinds", f"SELECT conv_id, turn, {KIND} AS kind, {KIND_PROVE} AS prove_kind FROM attempts")
def attempt_kinds(spark, sf_dir):
    return attempts(spark, sf_dir).select("conv_id", "turn", at.attempt_kind().alias("kind"), at.attempt_kind("prove").alias("prove_kind"))


@query(
    "node_status",
    f"""WITH marked AS (SELECT *, {KIND} AS kind FROM attempts), judged AS (SELECT *, {status('kind', 'lean_pass', 'attempt > 2')} AS status FROM marked)
    SELECT record_id, fact_id, max(attempt) AS tries, arg_max(status, attempt) AS status, arg_max(kind, attempt) AS kind FROM judged GROUP BY record_id, fact_id""",
)
def node_status(spark, sf_dir):
    return at.fold_status(attempts(spark, sf_dir), 2)


@query(
    "node_status_training",
    f"""WITH marked AS (SELECT *, {KIND_PROVE} AS kind FROM attempts), judged AS (SELECT *, {status('kind', 'lean_verify', 'attempt >= 2')} AS status FROM marked)
    SELECT record_id, fact_id, max(attempt) AS tries, arg_max(status, attempt) AS status, arg_max(kind, attempt) AS kind FROM judged GROUP BY record_id, fact_id""",
)
def node_status_training(spark, sf_dir):
    return at.fold_status(attempts(spark, sf_dir), 2, "prove", "ge")


@query(
    "last_attempts",
    """SELECT record_id, fact_id, max(attempt) AS attempt, arg_max(output, attempt) AS output, CAST(count(*) - 1 AS INT) AS earlier FROM attempts GROUP BY record_id, fact_id""",
)
def last_attempts(spark, sf_dir):
    rows = at.last_attempts(attempts(spark, sf_dir), ["output", "lean_verify"], with_history=True)
    return rows.select("record_id", "fact_id", "attempt", "output", F.size("history").alias("earlier"))


@query(
    "retry_conversations",
    """SELECT record_id, fact_id, concat('prove it', coalesce(string_agg(concat('|', CASE WHEN lean_pass THEN 'Lean error/warnings: ' ELSE 'Error: ' END, output, chr(10), chr(10), ' Based on these errors, please correct the previous response. '), '' ORDER BY attempt)
      FILTER (attempt < last), '')) AS turns FROM (SELECT *, max(attempt) OVER (PARTITION BY record_id, fact_id) AS last FROM attempts) GROUP BY record_id, fact_id""",
)
def retry_conversations(spark, sf_dir):
    from traceloom.functions.chat import message

    log = attempts(spark, sf_dir).withColumns({"lean_code": F.when(F.col("lean_pass"), "x").otherwise(" "), "error_msg": F.col("output")})
    rows = at.last_attempts(log, ["lean_code", "error_msg"], with_history=True)
    turns = at.rebuild_conversation(F.array(message("user", F.lit("prove it"))), F.col("history"))
    return rows.select("record_id", "fact_id", F.array_join(F.transform(turns, lambda m: m["content"]), "|").alias("turns"))


@query(
    "feedback_messages",
    """SELECT conv_id, turn, CASE WHEN token_overflow THEN 'The previous response hit a token limit. Regenerate the full Lean4 formalization.'
      WHEN no_code THEN concat('The previous response was invalid because: ', output, chr(10), 'Please regenerate valid Lean4 code.')
      ELSE concat('The previous Lean4 code did not compile.', chr(10), 'Lean errors: ', output, chr(10), 'Please regenerate corrected Lean4 code.') END AS feedback,
      concat(CASE WHEN no_code THEN 'Error: ' ELSE 'Lean error/warnings: ' END, output, chr(10), chr(10), ' Based on these errors, please correct the previous response. ') AS retry FROM attempts""",
)
def feedback_messages(spark, sf_dir):
    error = F.when(F.col("token_overflow"), "token_overflow").otherwise(F.col("output"))
    code = F.when(F.col("no_code"), "").otherwise("x")
    kind = F.when(F.col("no_code"), "extract_error").otherwise("validated")
    return attempts(spark, sf_dir).select(
        "conv_id", "turn", at.feedback_message("formalize", error, code).alias("feedback"), at.retry_turn("prove", kind, F.col("output")).alias("retry")
    )


@query(
    "seed_formalize",
    f"""WITH {OBLIGATIONS} SELECT f.record_id, f.fact_id, CASE WHEN h % 3 = 0 THEN 'pending' ELSE 'skipped' END AS form_status, CASE WHEN h % 3 = 0 THEN t.statement END AS statement, h % 3 <> 0 AS lean_pass
    FROM facts f LEFT JOIN tasks t ON t.record_id = f.record_id AND t.pos = f.pos""",
)
def seed_formalize(spark, sf_dir):
    from traceloom.functions.rows import settle

    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), F.col("doc_id"), "text")
    sized = F.transform(F.split("text", r"\. "), lambda s, i: (F.length(s) * 31 + (i + 1) * 17 + F.col("doc_id") * 7) % 1000)
    marks = settle(docs, h=sized).select("record_id", "h")
    marked = F.transform("facts", lambda f, i: f.withField("skip", F.when(F.get("h", i) % 3 == 0, 0).otherwise(2)))
    records = settle(graph_records(spark, sf_dir).join(marks, "record_id"), facts=marked)
    rows = at.seed_formalize(records).select("record_id", "fact_id", "form_status", "statement", "lean_pass")
    return rows


@query("seed_prove", "SELECT record_id, fact_id, CASE WHEN skip = 0 AND form_lean_pass AND lean_code <> '' THEN 'pending' ELSE 'skipped' END AS prove_status, NOT (skip = 0 AND form_lean_pass AND lean_code <> '') AS skipped FROM nodes")
def seed_prove(spark, sf_dir):
    return at.seed_prove(nodes(spark, sf_dir).withColumn("form_code", F.col("lean_code")))


@query(
    "recovered_nodes",
    """SELECT record_id, fact_id, CASE WHEN skip <> 0 OR NOT form_lean_pass OR lean_code = '' THEN 'skipped' WHEN prove_status = 'running' THEN 'pending' ELSE prove_status END AS prove_status FROM nodes""",
)
def recovered_nodes(spark, sf_dir):
    return at.recover(nodes(spark, sf_dir).withColumn("form_code", F.col("lean_code")), "prove").select("record_id", "fact_id", "prove_status")


TARGETS = """targets AS (SELECT record_id, fact_id FROM nodes WHERE prove_status = 'failed'),
  tries AS (SELECT record_id, fact_id, k AS attempt, (l_partkey * 7 + k * 3) % 5 = 0 AS lean_verify FROM nodes, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE prove_status = 'failed' AND l_suppkey % 9 > 0 AND k <= l_partkey % 6),
  outcomes AS (SELECT t.record_id, t.fact_id, min(attempt) FILTER (lean_verify AND attempt <= 3) AS won, max(attempt) FILTER (attempt <= 3) AS last FROM targets t LEFT JOIN tries USING (record_id, fact_id) GROUP BY t.record_id, t.fact_id)"""


def retries(spark, sf_dir):
    failed = nodes(spark, sf_dir).where("prove_status = 'failed'")
    tries = (
        failed.where("l_suppkey % 9 > 0")
        .select("record_id", "fact_id", "l_partkey", F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("attempt"))
        .where(F.col("attempt") <= F.col("l_partkey") % 6)
        .withColumn("lean_verify", (F.col("l_partkey") * 7 + F.col("attempt") * 3) % 5 == 0)
    )
    return at.retry_outcome(failed, tries, 3)


@query("retry_outcomes", f"WITH {TARGETS} SELECT record_id, fact_id, won IS NOT NULL AS success, coalesce(CAST(won AS VARCHAR), 'failed') AS success_bucket, CAST(coalesce(won + 1, last + 1, 0) AS INT) AS attempt_count FROM outcomes")
def retry_outcomes(spark, sf_dir):
    return retries(spark, sf_dir)


@query(
    "retry_scaling",
    f"""WITH {TARGETS}, counted AS (SELECT coalesce(CAST(won AS VARCHAR), 'failed') AS bucket FROM outcomes)
    SELECT d.bucket, count(c.bucket) AS nodes, count(c.bucket) / (SELECT count(*) FROM counted) AS ratio FROM (SELECT unnest(['0', '1', '2', '3', 'failed']) AS bucket) d LEFT JOIN counted c USING (bucket) GROUP BY d.bucket""",
)
def retry_scaling(spark, sf_dir):
    return stats.retry_scaling(retries(spark, sf_dir))


AFTER = f"""{TARGETS}, after_nodes AS (SELECT n.*, coalesce(o.won IS NOT NULL, false) AS now FROM nodes n LEFT JOIN outcomes o USING (record_id, fact_id))"""


@query("retry_applied", f"WITH {AFTER} SELECT record_id, fact_id, CASE WHEN now THEN 'success' ELSE prove_status END AS prove_status, now OR lean_verify AS lean_verify, NOT now AND prove_skipped AS prove_skipped FROM after_nodes")
def retry_applied(spark, sf_dir):
    rows = at.apply_retry(nodes(spark, sf_dir), retries(spark, sf_dir))
    return rows.select("record_id", "fact_id", "prove_status", "lean_verify", "prove_skipped")


# Targets with an id of their own that no record holds, and every attempt's code and error.
PAYLOADS = f"""{TARGETS}, wanted AS (SELECT record_id, fact_id, true AS found FROM targets UNION ALL SELECT DISTINCT record_id, 'f_none', false FROM targets),
  coded AS (SELECT record_id, fact_id, attempt, lean_verify, concat('code ', fact_id, ' ', attempt) AS code, CASE WHEN lean_verify THEN '' ELSE concat('error ', attempt) END AS error FROM tries WHERE attempt <= 3),
  told AS (SELECT w.record_id, w.fact_id, w.found, o.won, coalesce(CAST(o.won AS VARCHAR), 'failed') AS bucket, coalesce(o.won + 1, o.last + 1, 0) AS n,
    e.error AS last_error, CASE WHEN o.won IS NOT NULL THEN e.code END AS code FROM wanted w LEFT JOIN outcomes o USING (record_id, fact_id)
    LEFT JOIN (SELECT DISTINCT * FROM coded) e ON e.record_id = w.record_id AND e.fact_id = w.fact_id AND e.attempt = coalesce(o.won, o.last))"""


def retry_payload_rows(spark, sf_dir):
    failed = nodes(spark, sf_dir).where("prove_status = 'failed'")
    unknown = failed.select("record_id", F.lit("f_none").alias("fact_id")).distinct().withColumn("found", F.lit(False))
    targets = failed.select("record_id", "fact_id", F.lit(True).alias("found")).unionByName(unknown)
    k = F.col("attempt")
    tries = failed.where("l_suppkey % 9 > 0").select("record_id", "fact_id", "l_partkey", F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("attempt")).where(k <= F.col("l_partkey") % 6)
    passed = (F.col("l_partkey") * 7 + k * 3) % 5 == 0
    log = tries.select(
        "record_id", "fact_id", "attempt", F.concat(F.lit("code "), "fact_id", F.lit(" "), k.cast("string")).alias("candidate_lean_code"),
        passed.alias("lean_pass"), passed.alias("lean_verify"), F.when(passed, "").otherwise(F.concat(F.lit("error "), k.cast("string"))).alias("error_msg"),
    )
    return at.retry_payloads(targets, log.unionByName(log.where("attempt = 1")), 3)


@query(
    "retry_payloads",
    f"""WITH {PAYLOADS} SELECT t.record_id, t.fact_id, won IS NOT NULL AS success, bucket AS success_bucket, CAST(n AS INT) AS attempt_count, CASE WHEN found THEN coalesce(last_error, '') END AS final_error, CASE WHEN found THEN won IS NOT NULL END AS final_verify,
    coalesce(string_agg(concat(c.attempt, ':', c.code, ':', c.lean_verify, ':', c.error), ';' ORDER BY c.attempt) FILTER (c.attempt IS NOT NULL), '') AS attempts, CASE WHEN found THEN '' ELSE 'fact not found' END AS error
    FROM told t LEFT JOIN (SELECT DISTINCT * FROM coded) c ON c.record_id = t.record_id AND c.fact_id = t.fact_id AND (won IS NULL OR c.attempt <= won) GROUP BY ALL""",
)
def retry_payloads(spark, sf_dir):
    """Outcome, final result and list of attempts of each retried node, those of unknown facts and with replayed attempts too."""
    line = lambda a: F.concat_ws(":", a["attempt_index"], a["candidate_lean_code"], a["lean_verify"].cast("string"), a["error_msg"])
    return retry_payload_rows(spark, sf_dir).select(
        "record_id", "fact_id", "success", "success_bucket", "attempt_count", F.col("final_lean_result.error_msg").alias("final_error"),
        F.col("final_lean_result.lean_verify").alias("final_verify"), F.array_join(F.transform("attempts", line), ";").alias("attempts"), "error",
    )


@query(
    "retry_upsert",
    f"""WITH {PAYLOADS} SELECT x.record_id, x.pos, x.fact_id, CASE WHEN won IS NOT NULL THEN 'success' ELSE prove_status END AS prove_status, CASE WHEN won IS NOT NULL THEN t.code ELSE x.lean_code END AS lean_code,
    won IS NOT NULL OR lean_verify AS lean_verify, CASE WHEN won IS NOT NULL THEN last_error ELSE error_msg END AS error_msg, CASE WHEN won IS NOT NULL THEN CAST(n AS INT) END AS tries,
    CASE WHEN found THEN concat_ws(' ', bucket, n, coalesce(last_error, '')) END AS retry
    FROM (SELECT *, row_number() OVER (PARTITION BY record_id, fact_id ORDER BY pos, prove_status, lean_code, lean_pass, lean_verify, error_msg) AS nth FROM nodes) x LEFT JOIN told t ON t.record_id = x.record_id AND t.fact_id = x.fact_id AND nth = 1""",
)
def retry_upsert(spark, sf_dir):
    """Stage records, one a rollout, with the retry results put into their facts."""
    proof = F.struct("lean_code", "lean_pass", "lean_verify", "error_msg", F.lit(None).cast("int").alias("tries"), F.col("prove_skipped").alias("skipped"))
    fact = F.struct("pos", "fact_id", "prove_status", proof.alias("solved_lemma"))
    gathered = nodes(spark, sf_dir).groupBy("record_id").agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    records = gathered.select(F.struct("record_id").alias("meta"), F.struct("facts").alias("results"))
    rows = at.upsert_retry(records, retry_payload_rows(spark, sf_dir)).select(F.col("meta.record_id").alias("record_id"), F.explode("results.facts").alias("f"))
    told = F.col("f.prove_failure_retry")
    return rows.select(
        "record_id", "f.pos", "f.fact_id", "f.prove_status", "f.solved_lemma.lean_code", "f.solved_lemma.lean_verify", "f.solved_lemma.error_msg", "f.solved_lemma.tries",
        F.when(told.isNotNull(), F.concat_ws(" ", told["success_bucket"], told["attempt_count"], told["final_lean_result"]["error_msg"])).alias("retry"),
    )


@query(
    "retry_study",
    f"""WITH {AFTER}, flags AS (SELECT *, origin IN ('derived', 'answer') AS need, origin IN ('derived', 'answer') AND NOT (origin = 'derived' AND skip = 1) AS need_x FROM after_nodes),
    ranked_pre AS (SELECT record_id, parent_id, rollout_id, count(*) FILTER (need AND prove_status = 'success') AS s, count(*) FILTER (need AND (now OR prove_status = 'success')) AS s2, count(*) FILTER (need AND lean_pass) AS p, count(*) FILTER (need AND (now OR lean_pass)) AS p2, count(*) FILTER (need) AS n FROM flags GROUP BY ALL),
    best AS (SELECT arg_min(record_id, row(-(CASE WHEN n > 0 THEN s / n ELSE 0.0 END), -s, -p, rollout_id)) AS id, arg_min(record_id, row(-(CASE WHEN n > 0 THEN s2 / n ELSE 0.0 END), -s2, -p2, rollout_id)) AS id2 FROM ranked_pre GROUP BY parent_id),
    accs AS (SELECT avg(g.is_correct) AS a, avg(g2.is_correct) AS b FROM best JOIN grades g ON g.id = best.id JOIN grades g2 ON g2.id = best.id2),
    sums AS (SELECT count(*) FILTER (need AND lean_verify) / count(*) FILTER (need) * 100.0 AS pi, count(*) FILTER (need AND (now OR lean_verify)) / count(*) FILTER (need) * 100.0 AS pi2,
      count(*) FILTER (need_x AND lean_verify) / count(*) FILTER (need_x) * 100.0 AS px, count(*) FILTER (need_x AND (now OR lean_verify)) / count(*) FILTER (need_x) * 100.0 AS px2,
      count(*) FILTER (need AND form_lean_pass) / count(*) FILTER (need) * 100.0 AS fi, count(*) FILTER (need_x AND form_lean_pass) / count(*) FILTER (need_x) * 100.0 AS fx FROM flags),
    long AS (SELECT unnest(['include_skipped_derived.global_prove_verified_nodes_ratio', 'exclude_skipped_derived.global_prove_verified_nodes_ratio', 'include_skipped_derived.global_form_verified_nodes_ratio', 'exclude_skipped_derived.global_form_verified_nodes_ratio', 'step_proof_best.accuracy']) AS metric,
      unnest([pi, px, fi, fx, a]) AS before, unnest([pi2, px2, fi, fx, b]) AS after FROM sums, accs)
    SELECT metric, round(before, 8) AS before, round(after, 8) AS after, round(after - before, 8) AS delta FROM long""",
)
def retry_study(spark, sf_dir):
    from traceloom.plans.retry import before_after_retry

    rows = before_after_retry(nodes(spark, sf_dir), grades(spark, sf_dir), retries(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 8) for c in ("before", "after", "delta")})


@query("selection_summary", """WITH ranked_pre AS (SELECT record_id, parent_id, rollout_id, count(*) FILTER (need AND prove_status = 'success') AS s, count(*) FILTER (need AND lean_pass) AS p, count(*) FILTER (need) AS n
     FROM (SELECT *, origin IN ('derived', 'answer') AS need FROM nodes) GROUP BY ALL),
   best AS (SELECT parent_id, arg_min(record_id, row(-(CASE WHEN n > 0 THEN s / n ELSE 0.0 END), -s, -p, rollout_id)) AS id FROM ranked_pre GROUP BY parent_id)
   SELECT g.source, count(*) AS selected, count(g.id) AS graded, CAST(sum(g.is_correct) AS BIGINT) AS correct, avg(coalesce(g.is_correct, 0)) AS accuracy FROM best LEFT JOIN (SELECT * FROM grades WHERE answer <> 'P') g ON g.id = best.id GROUP BY g.source""")
def selection_summary(spark, sf_dir):
    from traceloom.plans.retry import selection_summary as summary

    return summary(nodes(spark, sf_dir), grades(spark, sf_dir).where("answer <> 'P'"))


BEST = """ranked_pre AS (SELECT record_id, parent_id, rollout_id, count(*) FILTER (need AND prove_status = 'success') AS s, count(*) FILTER (need AND lean_pass) AS p, count(*) FILTER (need) AS n
     FROM (SELECT *, origin IN ('derived', 'answer') AS need FROM nodes) GROUP BY ALL),
   best AS (SELECT parent_id, arg_min(record_id, row(-(CASE WHEN n > 0 THEN s / n ELSE 0.0 END), -s, -p, rollout_id)) AS id FROM ranked_pre GROUP BY parent_id),
   given AS (SELECT * FROM grades WHERE answer <> 'P')"""


@query("selection_totals", f"""WITH {BEST} SELECT g.source, CAST(grouping(g.source) AS INT) AS overall, count(*) AS selected, count(g.id) AS graded, CAST(coalesce(sum(g.is_correct), 0) AS BIGINT) AS correct, avg(coalesce(g.is_correct, 0)) AS accuracy
   FROM best LEFT JOIN given g ON g.id = best.id GROUP BY ROLLUP (g.source)""")
def selection_totals(spark, sf_dir):
    from traceloom.plans.retry import selection_totals as totals

    return totals(nodes(spark, sf_dir), grades(spark, sf_dir).where("answer <> 'P'"))


@query("ungraded_selections", f"WITH {BEST} SELECT id AS record_id, parent_id FROM best WHERE id NOT IN (SELECT id FROM given)")
def ungraded_selections(spark, sf_dir):
    from traceloom.plans.retry import ungraded_selections as ungraded

    return ungraded(nodes(spark, sf_dir), grades(spark, sf_dir).where("answer <> 'P'"))


@query("selection_report", f"""WITH kept AS (SELECT parent_id, sum(CAST(round(p * 1e9) AS DECIMAL(18,0)))::DOUBLE / (count(p) * 1e9) AS ratio FROM (SELECT parent_id, record_id, CASE WHEN count(*) FILTER (need) > 0 THEN count(*) FILTER (need AND lean_verify) / count(*) FILTER (need) * 100.0 ELSE 0.0 END AS p
     FROM (SELECT *, origin IN ('derived', 'answer') AS need FROM nodes) GROUP BY parent_id, record_id) GROUP BY parent_id),
   b AS (SELECT parent_id, CASE WHEN ratio >= 100 THEN '100%' ELSE concat(CAST(floor(ratio / 20) * 20 AS INT), '-', CAST(floor(ratio / 20) * 20 + 20 AS INT), '%') END AS bucket FROM kept),
   r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat('11|', parent_id))) AS r FROM b)
   SELECT bucket, count(*) AS problems, count(*) FILTER (r <= 4) AS sampled FROM r GROUP BY bucket""")
def selection_report(spark, sf_dir):
    from traceloom.plans.retry import selection_report as report

    return report(nodes(spark, sf_dir), per_bucket=4, seed=11, step=20)


@query("selection_counts", """WITH pr AS (SELECT parent_id, sum(CAST(round(p * 1e9) AS DECIMAL(18,0)))::DOUBLE / (count(p) * 1e9) AS ratio FROM (SELECT parent_id, record_id, CASE WHEN count(*) FILTER (need) > 0 THEN count(*) FILTER (need AND lean_verify) / count(*) FILTER (need) * 100.0 ELSE 0.0 END AS p
     FROM (SELECT *, origin IN ('derived', 'answer') AS need FROM nodes) GROUP BY parent_id, record_id) GROUP BY parent_id),
   g AS (SELECT *, o_custkey % 23 = 0 AS open_trace, o_custkey % 31 = 0 AS open_answer FROM grades), bad AS (SELECT DISTINCT parent_id FROM g WHERE open_trace OR open_answer),
   ok AS (SELECT parent_id, CASE WHEN ratio >= 100 THEN '100%' ELSE concat(CAST(floor(ratio / 20) * 20 AS INT), '%') END AS bucket FROM pr WHERE parent_id IN (SELECT parent_id FROM g) AND parent_id NOT IN (SELECT parent_id FROM bad))
   SELECT (SELECT count(DISTINCT parent_id) FROM g) AS total, (SELECT count(*) FROM ok) AS eligible, (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY bucket) AS r FROM ok) WHERE r <= 25) AS selected,
   (SELECT count(*) FROM g WHERE answer = 'P') AS ungraded, (SELECT count(*) FROM bad) AS rejected""")
def selection_counts(spark, sf_dir):
    from traceloom.operators.scoring import problem_ratio
    from traceloom.plans import retry

    rows = grades(spark, sf_dir)
    opened = lambda n: F.when(F.col("o_custkey") % n == 0, "<think>open").otherwise("done")
    rollouts = rows.select("id", "parent_id", opened(23).alias("response"))
    answers = rows.select("parent_id", opened(31).alias("answer"))
    return retry.selection_counts(rollouts, rows.where("answer <> 'P'"), answers, 25, 4, problem_ratio(nodes(spark, sf_dir), True))


@query("rejected_problem_ids", "SELECT DISTINCT parent_id FROM grades WHERE o_custkey % 23 = 0 OR o_custkey % 31 = 0")
def rejected_problem_ids(spark, sf_dir):
    from traceloom.plans import retry

    rows = grades(spark, sf_dir)
    opened = lambda n: F.when(F.col("o_custkey") % n == 0, "<think>open").otherwise("done")
    return retry.rejected_problems(rows.select("id", "parent_id", opened(23).alias("response")), rows.select("parent_id", opened(31).alias("answer")))


@query("graph_done", "SELECT record_id, coalesce(bool_and(prove_status IN ('success', 'failed', 'skipped')) FILTER (origin NOT IN ('given', 'introduced')), true) AS done FROM nodes GROUP BY record_id")
def graph_done(spark, sf_dir):
    from traceloom.schemas import ROOT_ORIGINS, TERMINAL

    return at.graph_done(nodes(spark, sf_dir), F.col("origin").isin(ROOT_ORIGINS), F.col("prove_status").isin(TERMINAL))


FORMAL = "formal AS (SELECT record_id, fact_id, l_partkey AS ord, error_msg AS formal_error FROM nodes WHERE l_partkey % 4 > 0 UNION ALL SELECT record_id, fact_id, -1, 'older' FROM nodes WHERE l_suppkey % 2 = 0)"


@query("joined_traces", f"WITH {FORMAL} SELECT n.record_id, n.fact_id, f.formal_error FROM nodes n JOIN (SELECT record_id, fact_id, arg_max(formal_error, ord) AS formal_error FROM formal GROUP BY ALL) f USING (record_id, fact_id)")
def joined_traces(spark, sf_dir):
    return _joined(spark, sf_dir)[0].select("record_id", "fact_id", "formal.formal_error")


@query("unmatched_traces", f"WITH {FORMAL} SELECT count(*) AS unmatched FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM formal f WHERE f.record_id = n.record_id AND f.fact_id = n.fact_id)")
def unmatched_traces(spark, sf_dir):
    return _joined(spark, sf_dir)[1]


def _joined(spark, sf_dir):
    everything = nodes(spark, sf_dir)
    new = everything.where("l_partkey % 4 > 0").select("record_id", "fact_id", F.col("l_partkey").alias("ord"), F.col("error_msg").alias("formal_error"))
    old = everything.where("l_suppkey % 2 = 0").select("record_id", "fact_id", F.lit(-1).cast("bigint").alias("ord"), F.lit("older").alias("formal_error"))
    return at.join_traces(everything.select("record_id", "fact_id", "prove_status"), new.unionByName(old), "ord")


@query("reused_stage", "SELECT g.id AS record_id, o_custkey AS position, arg_min(n.fact_id, row(pos, n.fact_id)) AS fact_id FROM grades g JOIN nodes n ON n.record_id = g.id WHERE answer = 'F' GROUP BY ALL")
def reused_stage(spark, sf_dir):
    wanted = grades(spark, sf_dir).where("answer = 'F'").select(F.col("id").alias("record_id"), F.col("o_custkey").alias("position"))
    return at.reuse_stage(wanted, nodes(spark, sf_dir).select("record_id", "fact_id", "pos"), F.struct("pos", "fact_id")).select("record_id", "position", "fact_id")


@query("exported_subset", "SELECT g.id AS record_id, o_custkey AS position, n.fact_id FROM grades g JOIN nodes n ON n.record_id = g.id WHERE answer = 'F'")
def exported_subset(spark, sf_dir):
    have = nodes(spark, sf_dir).select("record_id").distinct()
    wanted = grades(spark, sf_dir).where("answer = 'F'").select(F.col("id").alias("record_id"), F.col("o_custkey").alias("position")).join(have, "record_id", "left_semi")
    return at.export_subset(nodes(spark, sf_dir).select("record_id", "fact_id"), wanted)


# --- rewards -----------------------------------------------------------------------------------------------

REWARD = f"""{FINDINGS}, errs AS (SELECT record_id, count(*) AS n_err, count(DISTINCT nullif(fact_id, '')) AS bad FROM findings WHERE type <> 'final_answer_without_parents' GROUP BY record_id),
  warns AS (SELECT record_id, count(*) AS n_warn FROM findings WHERE type = 'final_answer_without_parents' GROUP BY record_id),
  oks AS (SELECT f.record_id, count(*) AS n, count(*) FILTER (r.pos IS NOT NULL) AS roots, count(*) FILTER (r.pos IS NOT NULL AND fm.fact_id IS NOT NULL) AS formed, count(*) FILTER (r.pos IS NOT NULL AND vf.fact_id IS NOT NULL) AS proved,
     count(*) FILTER (is_final_answer) AS fin, count(*) FILTER (is_final_answer AND vf.fact_id IS NOT NULL) AS fin_ok
     FROM facts f LEFT JOIN rooted r ON r.record_id = f.record_id AND r.pos = f.pos
     LEFT JOIN (SELECT DISTINCT record_id, fact_id FROM facts WHERE formalized) fm ON fm.record_id = f.record_id AND fm.fact_id = f.fact_id
     LEFT JOIN (SELECT DISTINCT record_id, fact_id FROM facts WHERE verified) vf ON vf.record_id = f.record_id AND vf.fact_id = f.fact_id GROUP BY f.record_id),
  parts AS (SELECT o.record_id, CAST(substr(o.record_id, 2) AS BIGINT) % 10 > 0 AS valid_json, n_err IS NULL AS passed, o.*, coalesce(n_warn, 0) AS warns, n_err, bad FROM oks o LEFT JOIN errs USING (record_id) LEFT JOIN warns USING (record_id)),
  rewards AS (SELECT record_id, valid_json, valid_json AND passed AS validator_passed,
    CASE WHEN NOT valid_json THEN -1.0 WHEN NOT passed THEN 0.05 - 0.6 * CASE WHEN bad > 0 THEN least(1.0, bad / n) ELSE 1.0 END ELSE 0.05 + 0.15 - 0.01 * warns END AS structure_score,
    CASE WHEN valid_json AND passed AND roots > 0 THEN 0.4 * formed / roots ELSE 0 END AS formalizer_score, CASE WHEN valid_json AND passed AND roots > 0 THEN 0.2 * proved / roots ELSE 0 END AS prover_score,
    CASE WHEN valid_json AND passed AND fin > 0 THEN 0.2 * fin_ok / fin ELSE 0 END AS final_answer_score FROM parts)"""


def rewarded(spark, sf_dir):
    ids = lambda flag: F.transform(F.filter("facts", lambda f: f[flag]), lambda f: f["fact_id"])
    graphs = graph_records(spark, sf_dir).withColumns(
        {
            "valid_json": F.substring("record_id", 2, 20).cast("bigint") % 10 > 0,
            "formalized": ids("formalized"),
            "verified": ids("verified"),
        }
    )
    return reward.score_graphs(graphs)


@query(
    "graph_rewards",
    f"""WITH RECURSIVE {REWARD} SELECT record_id, valid_json, validator_passed, round(CAST(structure_score AS DOUBLE), 6) AS structure_score, round(CAST(formalizer_score AS DOUBLE), 6) AS formalizer_score, round(CAST(prover_score AS DOUBLE), 6) AS prover_score,
    round(CAST(final_answer_score AS DOUBLE), 6) AS final_answer_score, round(CAST(structure_score + formalizer_score + prover_score + final_answer_score AS DOUBLE), 6) AS score FROM rewards""",
)
def graph_rewards(spark, sf_dir):
    parts = ["structure_score", "formalizer_score", "prover_score", "final_answer_score", "score"]
    return rewarded(spark, sf_dir).select("record_id", "valid_json", "validator_passed", *[F.round(p, 6).alias(p) for p in parts])


@query(
    "offline_evaluation",
    f"""WITH RECURSIVE {REWARD} SELECT count(*) AS candidates, round(avg(CAST(structure_score + formalizer_score + prover_score + final_answer_score AS DOUBLE)), 6) AS mean_score FROM rewards""",
)
def offline_evaluation(spark, sf_dir):
    return reward.evaluate_offline(rewarded(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "candidate_rewards",
    """SELECT record_id, valid_json, passed AS validator_passed, CASE WHEN NOT valid_json THEN -1.0 WHEN passed THEN 0.6 ELSE -0.55 END::DOUBLE AS score FROM (
      SELECT concat('d', doc_id) AS record_id, doc_id % 4 < 3 AS valid_json, doc_id % 4 < 2 AND trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' AS passed FROM documents)""",
)
def candidate_rewards(spark, sf_dir):
    """Model answers parsed, validated and scored: a two-fact graph, one without facts, or no JSON at all."""
    fact = lambda i, body, parents, final, origin: F.struct(
        F.lit(i).alias("fact_id"), body.alias("text"), F.array(*[F.lit(p) for p in parents]).cast("array<string>").alias("parent_fact_ids"),
        F.lit(final).alias("is_final_answer"), F.lit(origin).alias("origin"),
    )
    both = F.array(fact("f_1", F.col("text"), [], False, "given"), fact("f_2", F.lit("so"), ["f_1"], True, "answer"))
    body = lambda facts: F.to_json(F.struct(F.lit("p").alias("problem_id"), F.lit("q").alias("problem_text"), facts.alias("facts")))
    kind = F.col("doc_id") % 4
    empty = F.lit('```json\n{"problem_id": "p", "problem_text": "q", "facts": []}\n```')
    answer = F.when(kind < 2, F.concat(F.lit("```json\n"), body(both), F.lit("\n```"))).when(kind == 2, empty).otherwise("none")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), answer.alias("model_output"))
    parsed = reward.parse_candidates(rows).withColumns({"formalized": F.array(F.lit("f_2")), "verified": F.array(F.lit("f_1"))})
    return reward.score_graphs(parsed).select("record_id", "valid_json", "validator_passed", F.round("score", 6).alias("score"))


PASSED = "NOT token_overflow AND NOT output_truncated AND NOT no_code AND CASE WHEN stage = 'prover' THEN lean_verify ELSE lean_pass AND NOT api_error END"
# What each stage of a fact came to within three attempts.
STAGES = f"""tried AS (SELECT *, {PASSED} AS passed FROM fact_log WHERE attempt <= 3),
  ended AS (SELECT record_id, fact_id, stage, bool_or(passed) AS won, coalesce(min(attempt) FILTER (passed), max(attempt)) AS tries, coalesce(arg_min(lean_code, attempt) FILTER (passed), arg_max(lean_code, attempt)) AS lean_code,
    coalesce(arg_min(error_msg, attempt) FILTER (passed), arg_max(error_msg, attempt)) AS error_msg, CASE WHEN bool_or(passed) THEN 'success' WHEN max(attempt) >= 3 THEN 'failed' ELSE 'pending' END AS status FROM tried GROUP BY ALL),
  worked AS (SELECT f.record_id, f.pos, f.fact_id, a.status AS form_status, a.tries AS form_tries, a.lean_code AS form_code, CASE WHEN a.won THEN b.status END AS prove_status, CASE WHEN a.won THEN b.tries END AS prove_tries, CASE WHEN a.won THEN b.error_msg END AS prove_error,
    coalesce(a.status = 'failed' OR (a.won AND b.status <> 'pending'), false) AS done
    FROM facts f JOIN (SELECT DISTINCT record_id, pos FROM links) r ON r.record_id = f.record_id AND r.pos = f.pos
    LEFT JOIN ended a ON a.record_id = f.record_id AND a.fact_id = f.fact_id AND a.stage = 'formalizer' LEFT JOIN ended b ON b.record_id = f.record_id AND b.fact_id = f.fact_id AND b.stage = 'prover'),
  formed AS (SELECT DISTINCT record_id, fact_id FROM worked WHERE form_status = 'success'), proven AS (SELECT DISTINCT record_id, fact_id FROM worked WHERE prove_status = 'success'),
  traced AS (SELECT record_id, bool_and(done) AS done, string_agg(concat_ws(' ', fact_id, coalesce(form_status, '-'), coalesce(form_tries, 0), coalesce(form_code, '-'), coalesce(prove_status, '-'), coalesce(prove_tries, 0), coalesce(prove_error, '-')), ';' ORDER BY pos) AS trace FROM worked GROUP BY record_id)"""
LOG_REWARD = REWARD.replace("  oks AS (", f"  {STAGES},\n  oks AS (").replace("(SELECT DISTINCT record_id, fact_id FROM facts WHERE formalized)", "formed").replace("(SELECT DISTINCT record_id, fact_id FROM facts WHERE verified)", "proven")
START_SQL = "left(concat('no graph: ', translate(text, '{}`', '()\"')), 100)"
ESCAPED_SQL = f"replace(replace(replace({START_SQL}, chr(92), concat(chr(92), chr(92))), chr(10), concat(chr(92), 'n')), chr(9), concat(chr(92), 't'))"


@query(
    "candidate_rewards_from_log",
    f"""WITH RECURSIVE {LOG_REWARD}, errors AS (SELECT concat('d', doc_id) AS record_id, concat('No JSON block found. Text starts with: ',
      CASE WHEN contains({START_SQL}, chr(39)) AND NOT contains({START_SQL}, chr(34)) THEN concat(chr(34), {ESCAPED_SQL}, chr(34)) ELSE concat(chr(39), replace({ESCAPED_SQL}, chr(39), concat(chr(92), chr(39))), chr(39)) END) AS parse_error FROM documents WHERE doc_id % 10 = 0)
    SELECT w.record_id, valid_json, validator_passed, coalesce(parse_error, '') AS parse_error, NOT validator_passed OR coalesce(done, true) AS done, CASE WHEN validator_passed THEN coalesce(trace, '') ELSE '' END AS trace,
    round(CAST(structure_score + formalizer_score + prover_score + final_answer_score AS DOUBLE), 6) AS score FROM rewards w LEFT JOIN traced t ON t.record_id = w.record_id LEFT JOIN errors e ON e.record_id = w.record_id""",
)
def candidate_rewards_from_log(spark, sf_dir):
    """Model answers scored by the log of attempts on their facts: answers without a graph, graphs with faults, open and finished ones."""
    fields = ["fact_id", "text", "parent_fact_ids", "is_final_answer", "origin", "skip"]
    facts = F.transform("facts", lambda f: F.struct(*[f[c].alias(c) for c in fields]))
    body = F.to_json(F.struct(F.col("record_id").alias("problem_id"), "problem_text", facts.alias("facts")))
    none = F.concat(F.lit("no graph: "), F.translate("raw_cot", "{}`", '()"'))
    graph = F.substring("record_id", 2, 20).cast("bigint") % 10 > 0
    answers = graph_records(spark, sf_dir).select("record_id", F.when(graph, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(none).alias("model_output"))
    rewards = reward.rewards_from_log(answers, fact_log(spark, sf_dir))
    working = F.filter("facts", lambda f: F.size(f["parent_fact_ids"]) > 0)
    or_dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    line = lambda f: F.concat_ws(
        " ", f["fact_id"], or_dash(f["formalizer"]["status"]), number(f["formalizer"]["attempts"]), or_dash(f["formalizer"]["lean_code"]),
        or_dash(f["prover"]["status"]), number(f["prover"]["attempts"]), or_dash(f["prover"]["error_message"]),
    )
    trace = F.array_join(F.transform(working, line), ";")
    return rewards.select("record_id", "valid_json", "validator_passed", "parse_error", "done", trace.alias("trace"), F.round("score", 6).alias("score"))


# Answers by kind: what is wrong with the second fact, or with the whole answer, and what it scores.
SCHEMA_CASES = [
    ('{{"problem_id": "p", "problem_text": "q", "facts": [{first}, {second}]}}', None, 0.6),
    ('{{"problem_id": "p", "problem_text": "q", "facts": [{first}, {no_origin}]}}', "facts.1.origin: Field required", -0.55),
    ('{{"problem_text": "q", "facts": [{first}, {second}]}}', "problem_id: Field required", -0.55),
    ('{{"problem_id": "p", "facts": [{first}, {second}]}}', "problem_text: Field required", -0.55),
    ('{{"problem_id": "p", "problem_text": "q", "facts": [{first}, {number_text}]}}', "facts.1.text: Input should be a valid string", -0.55),
    ('{{"problem_id": "p", "problem_text": "q", "facts": [{first}, {spelled}]}}', None, 0.6),
    ('```json\n[{first}, {second}]\n```', ": Input should be a valid dictionary or instance of FDGDocument", -0.55),
    ('{{"problem_id": "p", "problem_text": "q", "facts": [], "extra": [0x1F, +1, .5],}}', "The FDG must contain at least one fact.", -0.55),
    ('{{"problem_id": "p", "problem_text": "q", "facts": [{first}, 7]}}', "facts.1: Input should be a valid dictionary or instance of FactItem", -0.55),
    ('{{"problem_id": "p", "problem_text": "q", "facts": [{first}, {second_part}]}}', "facts.1.skip: Input should be a valid integer, got a number with a fractional part", -0.55),
    ("no answer", None, -1.0),
]
SECOND = '{"fact_id": "f_2", "text": "so", "parent_fact_ids": ["f_1"], "is_final_answer": true, "origin": "answer"}'
PIECES = {
    "second": SECOND,
    "no_origin": SECOND.replace(', "origin": "answer"', ""),
    "number_text": SECOND.replace('"so"', "5"),
    "spelled": SECOND.replace("true", '"Yes"'),
    "second_part": SECOND.replace("}", ', "skip": 0.5}'),
}


def _schema_sql():
    kinds = " ".join(f"WHEN {k} THEN {score}" for k, (_, _, score) in enumerate(SCHEMA_CASES))
    texts = " ".join(f"WHEN {k} THEN '{problem}'" for k, (_, problem, _) in enumerate(SCHEMA_CASES) if problem)
    return f"""SELECT doc_id, doc_id % {len(SCHEMA_CASES)} < {len(SCHEMA_CASES) - 1} AS valid_json,
      CASE WHEN blank AND k IN (0, 5) THEN 'Fact text must not be empty.' ELSE CASE k {texts} END END AS message,
      CAST(CASE WHEN blank AND k IN (0, 5) THEN -0.25 ELSE CASE k {kinds} END END AS DOUBLE) AS score
      FROM (SELECT doc_id, doc_id % {len(SCHEMA_CASES)} AS k, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' AS blank FROM documents)"""


@query("candidate_schema_rewards", _schema_sql())
def candidate_schema_rewards(spark, sf_dir):
    """Answers with every kind of schema fault round a fact that holds the document's text: first finding and score."""
    first = F.to_json(F.struct(F.lit("f_1").alias("fact_id"), F.col("text"), F.array().cast("array<string>").alias("parent_fact_ids"), F.lit("given").alias("origin")))
    answers = F.lit(None)
    for k, (template, _, _) in enumerate(SCHEMA_CASES):
        parts = template.format(first="\0", **PIECES).split("\0")
        whole = F.lit(parts[0]) if len(parts) == 1 else F.concat(F.lit(parts[0]), first, F.lit(parts[1]))
        answers = F.coalesce(F.when(F.col("doc_id") % len(SCHEMA_CASES) == k, whole), answers)
    rows = table(spark, sf_dir, "documents").select("doc_id", answers.alias("model_output"))
    parsed = reward.parse_candidates(rows).withColumns({"formalized": F.array(F.lit("f_2")), "verified": F.array(F.lit("f_1"))})
    scored = reward.score_graphs(parsed)
    return scored.select("doc_id", "valid_json", F.when(F.col("valid_json"), F.get("errors", F.lit(0))["message"]).alias("message"), F.round("score", 6).alias("score"))
