"""Filters, routes and guards over traces, nodes and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.views import attempts, grades, graph_records, nodes, table, traces
from traceloom.functions.text import has_unclosed_think
from traceloom.operators import ids, routing

CLOSED = r"(?is)<think\b[^>]*>.*?</think>"
OPEN = f"regexp_matches(regexp_replace(raw_cot, '{CLOSED}', '', 'g'), '(?i)<think\\b[^>]*>')"


@query("unclosed_think", f"SELECT record_id, {OPEN} AS unclosed FROM traces")
def unclosed_think(spark, sf_dir):
    return traces(spark, sf_dir).select("record_id", has_unclosed_think(F.col("raw_cot")).alias("unclosed"))


LABELLED = "SELECT concat('d', doc_id) AS record_id FROM labels WHERE quality = {q}"


@query(
    "pending_traces",
    f"""SELECT record_id FROM traces WHERE NOT {OPEN} AND record_id NOT IN ({LABELLED.format(q=1)}) AND record_id NOT IN ({LABELLED.format(q=0)} AND toxic = 1)
    ORDER BY record_id LIMIT 300""",
)
def pending_traces(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("record_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    done = [labels.where("quality = 1"), labels.where("quality = 0 AND toxic = 1")]
    rows = traces(spark, sf_dir).withColumn("problem", F.col("source"))
    return routing.pending(rows, done, 300).select("record_id")


@query("resume_traces", f"SELECT record_id, lang FROM traces WHERE record_id NOT IN ({LABELLED.format(q=1)})")
def resume_traces(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"))
    return routing.resume_filter(traces(spark, sf_dir), [labels]).select("record_id", "lang")


@query(
    "incompatible_rows",
    """SELECT id FROM grades WHERE NOT (answer = 'F') OR (o_custkey % 3 = 0)""",
)
def incompatible_rows(spark, sf_dir):
    done = grades(spark, sf_dir).select(
        "id", F.col("answer").alias("prompt"), F.when(F.col("o_custkey") % 3 == 0, "c1_problem_parent").when(F.col("o_custkey") % 3 == 1, "c0_parent").alias("context_mode")
    )
    return routing.incompatible(done, "F", "c0_parent").select("id")


REJECT = r"""roll AS (SELECT concat('g', doc_id // 4) AS parent_id, record_id, raw_cot FROM traces),
  bad AS (SELECT DISTINCT parent_id FROM roll WHERE regexp_matches(regexp_replace(raw_cot, '(?is)<think\b[^>]*>.*?</think>', '', 'g'), '(?i)<think\b[^>]*>') AND length(raw_cot) % 3 = 0
     UNION SELECT DISTINCT concat('g', doc_id // 4) FROM documents WHERE n_chars % 29 = 0)"""


@query("rejected_problems", f"WITH {REJECT} SELECT record_id, parent_id FROM roll WHERE parent_id NOT IN (SELECT parent_id FROM bad)")
def rejected_problems(spark, sf_dir):
    parent = F.concat(F.lit("g"), F.floor(F.col("doc_id") / 4).cast("string"))
    rollouts = traces(spark, sf_dir).select(
        "record_id", parent.alias("parent_id"), F.when(F.length("raw_cot") % 3 == 0, F.col("raw_cot")).otherwise("closed").alias("response")
    )
    graded = table(spark, sf_dir, "documents").select(parent.alias("parent_id"), F.when(F.col("n_chars") % 29 == 0, "<think>open").otherwise("<think>x</think> 4").alias("answer"))
    return routing.reject_problems(rollouts, graded).select("record_id", "parent_id")


@query("executable_nodes", "SELECT record_id, fact_id FROM nodes WHERE skip = 0 AND l_partkey % 12 <> 10")
def executable_nodes(spark, sf_dir):
    loose = F.when(F.col("error_msg") == "", F.lit("junk")).otherwise(F.col("skip").cast("string"))
    return routing.should_execute(nodes(spark, sf_dir).withColumn("skip", loose)).select("record_id", "fact_id")


@query("prove_ready", "SELECT record_id, fact_id, CASE WHEN skip = 0 AND form_lean_pass AND lean_code <> '' THEN 'pending' ELSE 'skipped' END AS prove_status FROM nodes")
def prove_ready(spark, sf_dir):
    rows = nodes(spark, sf_dir).withColumn("form_code", F.col("lean_code"))
    return rows.select("record_id", "fact_id", routing.prove_ready().alias("prove_status"))


@query("empty_graphs", "SELECT record_id, 'Empty FDG graph (no facts). Skipped by Stage 2.' AS last_error FROM facts GROUP BY record_id HAVING max(pos) < 5")
def empty_graphs(spark, sf_dir):
    short = F.when(F.size("facts") < 5, F.expr("filter(facts, f -> false)")).otherwise(F.col("facts"))
    _, failed = routing.route_empty(graph_records(spark, sf_dir).withColumn("facts", short))
    return failed.select("record_id", "last_error")


@query(
    "routed_outcomes",
    """SELECT conv_id, turn, CASE WHEN token_overflow THEN 'skipped' WHEN api_error THEN 'api_pending' WHEN NOT output_truncated AND lean_pass THEN 'ok' WHEN attempt >= 3 THEN 'failed' ELSE 'retry' END AS outcome,
    CASE WHEN token_overflow THEN 'prompt_token_overflow' WHEN api_error THEN CASE turn % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'quota_exhausted' ELSE 'api_error' END
      WHEN output_truncated THEN 'output_truncated' WHEN NOT lean_pass THEN 'max_retries' END AS reason FROM attempts""",
)
def routed_outcomes(spark, sf_dir):
    kind, turn = F.lit("APIError"), F.col("turn") % 3
    rows = attempts(spark, sf_dir).withColumns(
        {
            "retry_count": F.col("attempt"),
            "valid": F.col("lean_pass"),
            "api_error_type": kind,
            "api_error_text": F.when(turn == 0, "request Timed Out").when(turn == 1, "You exceeded your quota").otherwise("odd"),
        }
    )
    return routing.route_outcomes(rows, 3).select("conv_id", "turn", "outcome", "reason")


@query(
    "graph_modes",
    """SELECT CASE WHEN answer = 'F' OR rollout_id = 2 OR source = '5-LOW' THEN 'fdg' ELSE 'tree' END AS mode, count(*) AS records FROM grades GROUP BY 1""",
)
def graph_modes(spark, sf_dir):
    meta = F.struct(
        F.when(F.col("answer") == "F", "FDG-form-v1").alias("schema_version"), F.when(F.col("source") == "5-LOW", " ").otherwise("Tree").alias("graph_mode")
    )
    rows = grades(spark, sf_dir).withColumn("mode", routing.graph_mode(meta, F.col("rollout_id") == 2))
    return routing.mode_counts(rows)


@query("named_rollouts", "SELECT id, parent_id, rollout_id FROM grades WHERE contains(id, 'p12') OR contains(parent_id, 'p12')")
def named_rollouts(spark, sf_dir):
    return routing.select_rollouts(grades(spark, sf_dir).where("parent_id <> 'p12'"), "p12", every=True, contains=True).unionByName(
        routing.select_rollouts(grades(spark, sf_dir), "p12", every=True)
    ).select("id", "parent_id", "rollout_id")


@query("prompt_overflow", "SELECT record_id, CAST(greatest(1, length(raw_cot) // 4) + 2 AS INT) AS prompt_tokens, greatest(1, length(raw_cot) // 4) + 2 > 500 AS overflow FROM traces")
def prompt_overflow(spark, sf_dir):
    from traceloom.functions.chat import message

    rows = traces(spark, sf_dir).withColumn("messages", F.array(message("system", F.lit("Be brief.")), message("user", F.col("raw_cot"))))
    return routing.prompt_overflow(rows, 500).select("record_id", "prompt_tokens", "overflow")


@query("known_sources", "SELECT id FROM grades WHERE source IN ('1-URGENT', '2-HIGH')")
def known_sources(spark, sf_dir):
    from traceloom.operators.evaluate import filter_sources

    return filter_sources(grades(spark, sf_dir), ["1-URGENT", "2-HIGH"]).select("id")


@query("done_ids", "SELECT parent_id FROM nodes UNION SELECT parent_id FROM grades")
def done_ids(spark, sf_dir):
    return ids.all_ids(nodes(spark, sf_dir).select("parent_id"), grades(spark, sf_dir).select("parent_id"))


@query("missing_ids", "SELECT id FROM grades WHERE id NOT IN (SELECT record_id FROM nodes)")
def missing_ids(spark, sf_dir):
    return ids.missing_ids(grades(spark, sf_dir).select("id"), nodes(spark, sf_dir).select("record_id"))


@query("unknown_sources", "SELECT source FROM documents EXCEPT SELECT 'src' || (page_id % 15) FROM pages")
def unknown_sources(spark, sf_dir):
    known = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), (F.col("page_id") % 15).cast("string")).alias("source"))
    return ids.unknown_values(table(spark, sf_dir, "documents").select("source"), known)


@query("ordered_ids", "SELECT parent_id, min(l_orderkey * 100 + pos) AS first_seen FROM nodes GROUP BY parent_id")
def ordered_ids(spark, sf_dir):
    return ids.dedup_ordered(nodes(spark, sf_dir), "parent_id", F.col("l_orderkey") * 100 + F.col("pos"))


@query("requested_ids", "SELECT parent_id, min(l_orderkey * 100 + pos) AS first_seen FROM nodes GROUP BY parent_id ORDER BY first_seen LIMIT 500")
def requested_ids(spark, sf_dir):
    return ids.requested_ids(nodes(spark, sf_dir), "parent_id", F.col("l_orderkey") * 100 + F.col("pos"), 500)
