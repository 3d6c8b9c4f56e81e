"""Sources, sinks and streams: files that Spark writes from the given tables, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.attempts import KIND, PASSED, STAGES, status
from catalog.evaluation import CASES
from catalog.views import attempts, fact_log, grades, graph_records, samples, table, traces
from traceloom.functions.exact import sql_mean, sql_std_pop
from traceloom.operators import datasets
from traceloom.plans import cases as case_plan
from traceloom.session import scratch_path
from traceloom.sources import readers, sinks
from traceloom.streaming import live


@query("read_traces", "SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS problem, text AS raw_cot, lang AS reference_answer, 'documents.parquet' AS source_file FROM documents")
def read_traces(spark, sf_dir):
    rows = readers.read_traces(spark, sf_dir, "documents.parquet", "doc_id", "source", "text", "lang")
    return rows.drop("source_row_pos")


@query("read_traces_positions", "SELECT count(*) AS traces, count(DISTINCT doc_id) AS positions, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM documents")
def read_traces_positions(spark, sf_dir):
    rows = readers.read_traces(spark, sf_dir, "documents.parquet", "doc_id", "source", "text")
    place = F.col("source_row_pos")
    return rows.agg(F.count("*").alias("traces"), F.count_distinct(place).alias("positions"), F.min(place).alias("first"), F.max(place).alias("last"))


def stage_records(spark, sf_dir):
    """Stage records with nested facts, one per document."""
    empty = F.lit(None).cast("string")
    payload = lambda passed, verified: F.struct(
        empty.alias("lean_code"), passed.alias("lean_pass"), verified.alias("lean_verify"), F.lit("").alias("error_msg"), F.lit(1).alias("tries"), F.lit(False).alias("skipped")
    )
    fact = lambda f: F.struct(
        f["fact_id"].alias("fact_id"), f["text"].alias("text"), f["parent_fact_ids"].alias("parent_fact_ids"), f["is_final_answer"].alias("is_final_answer"),
        f["origin"].alias("origin"), f["skip"].alias("skip"), F.when(f["formalized"], "success").otherwise("failed").alias("form_status"),
        payload(f["formalized"], F.lit(False)).alias("formalization"), F.when(f["verified"], "success").otherwise("failed").alias("prove_status"), payload(f["verified"], f["verified"]).alias("solved_lemma"),
    )
    return graph_records(spark, sf_dir).select(
        F.struct(F.lit("fdg-form-v1").alias("schema_version"), "record_id").alias("meta"),
        F.struct(F.col("problem_text").alias("problem"), "raw_cot").alias("input"),
        F.struct(F.transform("facts", fact).alias("facts")).alias("results"),
    )


@query("read_stage_records", "SELECT record_id, count(*) AS facts, count(*) FILTER (verified) AS verified, CAST(sum(length(text)) AS BIGINT) AS chars FROM facts GROUP BY record_id")
def read_stage_records(spark, sf_dir):
    path = scratch_path(spark, "stage-records")
    stage_records(spark, sf_dir).write.json(path)
    rows = readers.read_stage_records(spark, path).select("meta.record_id", F.explode("results.facts").alias("f"))
    return rows.groupBy("record_id").agg(
        F.count("*").alias("facts"), F.count_if("f.solved_lemma.lean_verify").alias("verified"), F.sum(F.length("f.text")).alias("chars")
    )


@query(
    "bad_lines",
    """SELECT line, value FROM (SELECT doc_id, k, row_number() OVER (ORDER BY doc_id, k) AS line, CASE WHEN k = 1 THEN concat('{"meta": {"record_id": "d', doc_id, '"') END AS value
      FROM documents, (SELECT unnest([0, 1]) AS k) WHERE k = 1 OR doc_id % 5 = 0) WHERE k = 1 AND doc_id % 9 = 0""",
)
def bad_lines(spark, sf_dir):
    """File and line of lines that are no record, blank lines counted."""
    whole = F.to_json(F.struct(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id")).alias("meta"), F.struct(F.col("text").alias("raw_cot")).alias("input")))
    broken = F.concat(F.lit('{"meta": {"record_id": "d'), F.col("doc_id").cast("string"), F.lit('"'))
    line = F.when(F.col("doc_id") % 9 == 0, broken).otherwise(whole)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(""), line)).otherwise(F.array(line))).alias("k", "value"))
    path = scratch_path(spark, "lines")
    lines.orderBy("doc_id", "k").select("value").write.text(path)
    return readers.bad_lines(spark, path, parts=True).select("line", "value")


@query("read_stage_records_tolerant", "SELECT CASE WHEN doc_id % 9 = 0 THEN 'corrupt' ELSE 'kept' END AS lines, count(*) AS n FROM documents GROUP BY 1")
def read_stage_records_tolerant(spark, sf_dir):
    path = scratch_path(spark, "stage-lines")
    number = F.substring(F.col("meta.record_id"), 2, 20).cast("bigint")
    line = F.when(number % 9 == 0, F.concat(F.lit('{"meta": {"record_id": '), number.cast("string"))).otherwise(F.to_json(F.struct("meta", "input", "results")))
    stage_records(spark, sf_dir).select(line.alias("value")).write.text(path)
    kept = readers.read_stage_records(spark, path, strict=False).select("meta.record_id").agg(F.count("record_id").alias("n"))
    bad = readers.corrupt_lines(spark, path).agg(F.coalesce(F.sum("corrupt_lines"), F.lit(0)).alias("n"))
    return kept.select(F.lit("kept").alias("lines"), "n").unionByName(bad.select(F.lit("corrupt").alias("lines"), "n"))


@query(
    "final_over_checkpoints",
    """SELECT record_id, doc % 3 = 0 AS is_checkpoint, count(*) AS facts FROM (SELECT record_id, CAST(substr(record_id, 2) AS BIGINT) AS doc, fact_id FROM facts)
    GROUP BY record_id, doc HAVING doc % 3 <> 0""".replace(" HAVING doc % 3 <> 0", "").replace("count(*) AS facts", "CASE WHEN doc % 3 = 0 THEN count(DISTINCT fact_id) ELSE count(*) END AS facts"),
)
def final_over_checkpoints(spark, sf_dir):
    number = F.substring(F.col("meta.record_id"), 2, 20).cast("bigint")
    records = stage_records(spark, sf_dir).withColumn("n", number)
    final = records.where("n % 3 <> 0").withColumn("row", F.lit(1))
    doubled = final.unionByName(final.withColumn("row", F.lit(0)).withColumn("results", F.struct(F.expr("filter(results.facts, f -> false)").alias("facts"))))
    keyed = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform("results.facts", lambda f: f["fact_id"])),
            lambda i: F.struct(i.alias("key"), F.get(F.filter("results.facts", lambda f: f["fact_id"] == i), F.lit(0)).alias("value")),
        )
    )
    from traceloom.functions.rows import settle

    parts = settle(records.select("n", "meta", F.col("results")), results=F.col("results"))
    checkpoints = parts.where("n % 6 <> 1").select(
        F.struct(F.when(F.col("n") % 2 == 0, F.col("meta.record_id")).alias("record_id")).alias("meta"),
        keyed.alias("runtime_facts"),
        F.concat(F.col("meta.record_id"), F.lit(".json")).alias("source_file"),
    )
    rows = readers.final_over_checkpoints(doubled, checkpoints, F.col("row"), F.col("source_file"))
    return rows.select("record_id", "is_checkpoint", F.size("facts").cast("bigint").alias("facts"))


@query(
    "experiment_stats",
    """SELECT concat('step_proof_ctx_c', nk % 5, '_form_api') AS experiment, concat('c', nk % 5) AS ctx, 'api' AS model, round(sum(v), 6) AS global_prove_verified_nodes_ratio, CAST(count(*) AS DOUBLE) AS global_form_verified_nodes_ratio
    FROM (SELECT c_nationkey % 5 AS nk, c_acctbal AS v FROM customer) GROUP BY nk""",
)
def experiment_stats(spark, sf_dir):
    root = scratch_path(spark, "runs")
    run = F.concat(F.lit("step_proof_ctx_c"), (F.col("c_nationkey") % 5).cast("string"), F.lit("_form_api"))
    ratios = table(spark, sf_dir, "customer").groupBy(run.alias("experiment")).agg(
        F.round(F.sum("c_acctbal"), 6).alias("global_prove_verified_nodes_ratio"), F.count("*").cast("double").alias("global_form_verified_nodes_ratio")
    )
    odd = ratios.limit(1).withColumn("experiment", F.lit("step_proof_full_011")).unionByName(ratios.limit(1).withColumn("experiment", F.lit("elsewhere")))
    rows = ratios.unionByName(odd)
    body = rows.select(F.col("experiment"), F.struct("global_prove_verified_nodes_ratio", "global_form_verified_nodes_ratio").alias("exclude_skipped_derived"))
    body.write.json(root)
    read = spark.read.schema("experiment string, exclude_skipped_derived struct<global_prove_verified_nodes_ratio: double, global_form_verified_nodes_ratio: double>").json(root)
    return readers.experiment_ratios(read.select("experiment", "exclude_skipped_derived.*"))


@query(
    "experiment_status",
    """SELECT source AS experiment, array_to_string(list_filter(['a', 'b', 'c'], lambda f: NOT list_contains(names, f)), ',') AS missing, len(list_filter(['a', 'b', 'c'], lambda f: NOT list_contains(names, f))) = 0 AS complete
    FROM (SELECT source, list(DISTINCT CASE WHEN n_chars % 3 > 0 THEN list_extract(['a', 'b', 'c', 'd'], CAST(doc_id % 4 + 1 AS INT)) ELSE 'none' END) AS names FROM documents GROUP BY source)""",
)
def experiment_status(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in "abcd"])
    files = table(spark, sf_dir, "documents").select(
        F.col("source").alias("experiment"), F.get(names, (F.col("doc_id") % 4).cast("int")).alias("file"), (F.col("n_chars") % 3).alias("length")
    )
    rows = readers.experiment_status(files, ["a", "b", "c"])
    return rows.select("experiment", F.array_join("missing", ",").alias("missing"), "complete")


@query("written_rollouts", "SELECT id, source, CAST(rollout_id AS INT) AS rollout_id FROM grades")
def written_rollouts(spark, sf_dir):
    path = scratch_path(spark, "rollouts")
    sinks.write_rollouts(grades(spark, sf_dir).select("id", "source", "rollout_id"), path)
    a = spark.read.parquet(f"{path}/rollouts.parquet")
    b = spark.read.schema("id string, source string, rollout_id int").json(f"{path}/rollouts.jsonl")
    return a.intersect(b)


@query("written_training", "SELECT record_id, split, lang AS ground_truth FROM (SELECT *, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('5|', record_id))) AS r, count(*) OVER () AS n FROM traces))")
def written_training(spark, sf_dir):
    from catalog.datasets import solutions

    path = scratch_path(spark, "training")
    rows = datasets.prepare_splits(solutions(spark, sf_dir), "", "{problem}: {solution}", "graphs", "plain", keep_think=True, train=0.8, val=0.1, seed=5)
    sinks.write_training(rows, path)
    return spark.read.parquet(path).select("extra_info.record_id", "split", "reward_model.ground_truth")


@query("written_manifest", "SELECT count(*) AS rollouts, CAST(sum(is_correct) AS BIGINT) AS correct, 'plain' AS prompt FROM grades")
def written_manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    summary = grades(spark, sf_dir).agg(F.count("*").alias("rollouts"), F.sum("is_correct").alias("correct"))
    sinks.write_manifest(summary, path, prompt="plain")
    return spark.read.schema("rollouts bigint, correct bigint, prompt string").json(path)


@query("written_metrics", "SELECT 'accuracy' AS metric, round(avg(is_correct) FILTER (source = '1-URGENT'), 6) AS \"1-URGENT\", round(avg(is_correct) FILTER (source = '5-LOW'), 6) AS \"5-LOW\", round(avg(is_correct), 6) AS avg FROM grades")
def written_metrics(spark, sf_dir):
    from traceloom.operators.evaluate import accuracy_with_sources

    path = scratch_path(spark, "metrics")
    rows = accuracy_with_sources(grades(spark, sf_dir))
    name = F.when(F.col("overall") == 1, "avg").otherwise(F.col("source"))
    sinks.write_metrics_csv(rows.select(F.lit("accuracy").alias("metric"), name.alias("source"), F.round("accuracy", 6).alias("value")), path, ["1-URGENT", "5-LOW"])
    return spark.read.option("header", True).schema("metric string, `1-URGENT` double, `5-LOW` double, avg double").csv(path)


@query(
    "extracted_cases",
    f"WITH {CASES} SELECT id, parent_id, rollout_id FROM grades WHERE parent_id IN (SELECT parent_id FROM cases WHERE bucket = 'a_wrong_b_correct')",
)
def extracted_cases(spark, sf_dir):
    from catalog.evaluation import ev, scored, second_grades, second_scored

    path = scratch_path(spark, "cases")
    views = {"a": ev.selected_view(scored(spark, sf_dir), grades(spark, sf_dir)), "b": ev.selected_view(second_scored(spark, sf_dir), second_grades(spark, sf_dir))}
    flat = grades(spark, sf_dir).select("id", "parent_id", "rollout_id", "source", F.col("answer").alias("response"))
    case_plan.extract_cases(views, flat, None, path, buckets=["a_wrong_b_correct"])
    return spark.read.parquet(f"{path}/a_wrong_b_correct/rollouts.parquet").select("id", "parent_id", "rollout_id")


@query(
    "step_sample_files",
    "SELECT step, count(reward) AS n, count(*) FILTER (reward_missing) AS missing, count(*) FILTER (NOT reward_missing AND reward IS NULL) AS invalid, count(*) FILTER (validator_passed) AS passed FROM samples GROUP BY step",
)
def step_sample_files(spark, sf_dir):
    from traceloom.operators import stats

    path = scratch_path(spark, "samples")
    rollout = F.struct(F.col("reward_text").alias("reward"), F.to_json(F.struct(F.col("validator_passed").alias("validator_passed"))).alias("trace"))
    samples(spark, sf_dir).select(F.col("step").cast("string").alias("step"), F.array(rollout).alias("rollouts")).write.json(path)
    rows = readers.explode_samples(readers.read_samples(spark, path), ["validator_passed"])
    spread = stats.reward_by_step(rows).where("overall = 0").select("step", "n", "missing", "invalid")
    _, flags = stats.reward_trace_by_step(rows, ["reward"], ["validator_passed"])
    return spread.join(flags.where("step IS NOT NULL").select("step", F.col("true_n").alias("passed")), "step")


# --- streams -----------------------------------------------------------------------------------------------


def _stream(spark, df, name, batches=4):
    """Write rows as files and read them as a stream in so many batches, each of a file for every core."""
    path = scratch_path(spark, name)
    files = spark.sparkContext.defaultParallelism
    df.repartition(batches * files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(
    "stream_status",
    f"""WITH marked AS (SELECT *, {KIND} AS kind FROM attempts), judged AS (SELECT *, {status('kind', 'lean_pass', 'attempt > 2')} AS status FROM marked)
    SELECT record_id, fact_id, max(attempt) AS tries, arg_max(status, attempt) AS status FROM judged GROUP BY record_id, fact_id""",
)
def stream_status(spark, sf_dir):
    log = _stream(spark, attempts(spark, sf_dir).select("record_id", "fact_id", "attempt", "lean_pass", "lean_verify", "token_overflow", "api_error", "output_truncated", "no_code"), "attempt-log")
    out, mark = scratch_path(spark, "status"), scratch_path(spark, "status-mark")
    live.run_updates(live.stream_status(log, 2), out, mark)
    return live.latest_updates(spark, out, ["record_id", "fact_id"])


@query(
    "stream_reward",
    f"""SELECT step, count(reward) AS n, coalesce({sql_mean('reward')}, 0) AS mean, round(coalesce({sql_std_pop('reward')}, 0), 6) AS std_pop, min(reward) AS min, max(reward) AS max,
    count(*) FILTER (reward_missing) AS missing, count(*) FILTER (NOT reward_missing AND reward IS NULL) AS invalid FROM samples GROUP BY step""",
)
def stream_reward(spark, sf_dir):
    log = _stream(spark, samples(spark, sf_dir).select("step", F.col("reward_text").alias("reward")), "sample-log")
    out, mark = scratch_path(spark, "reward"), scratch_path(spark, "reward-mark")
    live.run_updates(live.stream_reward(log), out, mark)
    return live.latest_updates(spark, out, ["step"]).withColumn("std_pop", F.round("std_pop", 6))


@query(
    "stream_reward_histogram",
    """SELECT step, CAST(CASE WHEN reward = 1.0 THEN 39 ELSE trunc((reward + 1.0) / CAST(0.05 AS DOUBLE)) END AS INT) AS bin, count(*) AS rewards FROM samples WHERE reward BETWEEN -1.0 AND 1.0 GROUP BY ALL""",
)
def stream_reward_histogram(spark, sf_dir):
    log = _stream(spark, samples(spark, sf_dir).select("step", F.col("reward_text").alias("reward")), "histogram-log")
    out, mark = scratch_path(spark, "histogram"), scratch_path(spark, "histogram-mark")
    live.run_updates(live.stream_reward_histogram(log), out, mark)
    return live.latest_updates(spark, out, ["step", "bin"])


@query(
    "stream_status_ttl",
    f"""WITH marked AS (SELECT *, {KIND} AS kind FROM attempts), judged AS (SELECT *, {status('kind', 'lean_pass', 'attempt > 2')} AS status FROM marked)
    SELECT record_id, fact_id, max(attempt) AS tries, arg_max(status, attempt) AS status FROM judged GROUP BY record_id, fact_id""",
)
def stream_status_ttl(spark, sf_dir):
    live.keep_state_in_rocksdb(spark)
    fields = ["record_id", "fact_id", "attempt", "lean_pass", "lean_verify", "token_overflow", "api_error", "output_truncated", "no_code"]
    log = _stream(spark, attempts(spark, sf_dir).select(*fields, F.timestamp_seconds(F.col("turn") + 1000).alias("arrived")), "timed-log")
    out, mark = scratch_path(spark, "status-ttl"), scratch_path(spark, "status-ttl-mark")
    live.run_updates(live.stream_status_ttl(log, 2, "arrived", 86400, late="1 hour"), out, mark)
    return live.latest_updates(spark, out, ["record_id", "fact_id"])


@query(
    "graph_countdown",
    f"""WITH {STAGES}, open AS (SELECT record_id, fact_id, bool_and(done) AS done FROM worked GROUP BY ALL), known AS (SELECT DISTINCT record_id FROM facts)
    SELECT record_id, CAST(count(fact_id) AS INT) AS facts FROM known LEFT JOIN open USING (record_id) GROUP BY record_id HAVING coalesce(bool_and(done), true)""",
)
def graph_countdown(spark, sf_dir):
    """The records whose facts are all done, told once each by a stream over graphs and attempts in files of any order."""
    live.keep_state_in_rocksdb(spark)
    facts = F.transform("facts", lambda f: F.struct(f["fact_id"].alias("fact_id"), f["parent_fact_ids"].alias("parent_fact_ids")))
    graphs = _stream(spark, graph_records(spark, sf_dir).select("record_id", facts.alias("facts")), "graphs", batches=2)
    # what a runner would have written: nothing after the attempt that passed, else the outcome would hang on the order of the files
    whole = fact_log(spark, sf_dir)
    won = whole.where(PASSED).groupBy("record_id", "fact_id", "stage").agg(F.min("attempt").alias("won"))
    made = whole.join(won, ["record_id", "fact_id", "stage"], "left").where("won IS NULL OR attempt <= won").drop("won")
    log = _stream(spark, made, "fact-log", batches=2)
    out, mark = scratch_path(spark, "countdown"), scratch_path(spark, "countdown-mark")
    live.run_available(live.stream_countdown(live.countdown_events(graphs, log)), out, mark)
    return spark.read.schema("record_id string, facts int").parquet(out)


@query(
    "stream_resume_growing",
    """SELECT concat('d', doc_id) AS record_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND (doc_id % 2 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
)
def stream_resume_growing(spark, sf_dir):
    """Records put out if they are unfinished when their batch runs; the table of finished ones grows between two batches."""
    named = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id")
    path, done, out, mark = (scratch_path(spark, n) for n in ("resume-log", "resume-done", "resume-growing", "resume-growing-mark"))
    read = lambda: spark.read.schema("record_id string").parquet(done)
    for finished, arrived in (("quality = 1", "doc_id % 2 = 0"), ("toxic = 1", "true")):
        table(spark, sf_dir, "labels").where(finished).select(named).write.mode("append").parquet(done)
        table(spark, sf_dir, "documents").where(arrived).select(named).write.mode("append").parquet(path)
        live.run_resume(spark.readStream.schema("record_id string").parquet(path), read, out, mark)
    return spark.read.schema("record_id string").parquet(f"{out}/batch=*")


@query("stream_resume", "SELECT DISTINCT record_id FROM traces WHERE record_id NOT IN (SELECT concat('d', doc_id) FROM labels WHERE quality = 1)")
def stream_resume(spark, sf_dir):
    ids = traces(spark, sf_dir).select("record_id")
    log = _stream(spark, ids.unionByName(ids), "trace-log")
    done = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"))
    out, mark = scratch_path(spark, "resume"), scratch_path(spark, "resume-mark")
    live.run_available(live.stream_resume(log, done), out, mark)
    return spark.read.schema("record_id string").parquet(out)
