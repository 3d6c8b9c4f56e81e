"""Ranks under skew, samples, splits, guards, files and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from traceloom.operators import attempts, ids, ranks, routing, sampling, scoring, stats
from traceloom.session import cut_lineage, scratch_path
from traceloom.sources import readers, sinks
from traceloom.streaming import live


def skewed(spark, n=30_000):
    """A third of all rows share one key."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), (F.col("id") * 7919 % n).alias("v")
    )


def expected_ranks(rows, order):
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r["key"], []).append(r["id"])
    return {i: place for members in groups.values() for place, i in enumerate(members, 1)}


def test_row_ranks_split_a_hot_group(spark):
    df = skewed(spark)
    got = {r["id"]: r["rank"] for r in ranks.row_ranks(df, ["key"], [F.col("v")]).collect()}
    assert got == expected_ranks(df.collect(), lambda r: r["v"])


def test_row_ranks_place_a_hot_group_in_several_tasks(spark):
    parts = skewed(spark).repartitionByRange(8, "key", "v").where("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_row_ranks_with_null_groups(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "a").alias("key"), F.col("id").alias("v"))
    got = {r["id"]: r["rank"] for r in ranks.row_ranks(df, ["key"], [F.col("v")]).collect()}
    assert got == expected_ranks(df.collect(), lambda r: r["v"])


def test_draw_bounds_are_the_nth_digests(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise("rest").alias("key"), "id")
    draw = ranks.seeded_hash(3, "id")
    ordered = {}
    for r in df.withColumn("d", draw).collect():
        ordered.setdefault(r.key, []).append(r.d)
    got = {r.key: r._bound for r in ranks.draw_bounds(df, ["key"], draw, 700).collect()}
    assert got == {"hot": sorted(ordered["hot"])[699]}


def test_top_per_prunes_before_the_shuffle(spark):
    plan = ranks.top_per(skewed(spark), ["key"], [F.col("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_best_of_n_does_not_sort_groups(spark):
    scored = spark.range(100).select(
        F.lit("p").alias("parent_id"), F.col("id").cast("string").alias("id"), F.col("id").cast("int").alias("rollout_id"),
        (F.col("id") % 10 / 10).alias("success_ratio"), F.lit(1).alias("prove_success_nodes"), F.lit(1).alias("lean_pass_nodes"),
    )
    best = scoring.best_of_n(scored)
    assert best.collect()[0]["id"] == "9"
    assert "Window" not in best._jdf.queryExecution().executedPlan().toString()


def test_splits(spark):
    assert sampling.split_sizes(2, 0.98, 0.01) == (1, 0, 1)
    assert sampling.split_sizes(3, 0.98, 0.01) == (1, 1, 1)
    assert sampling.split_sizes(100, 0.98, 0.01) == (98, 1, 1)
    counts = {r["split"]: r["count"] for r in sampling.split_by_ratio(skewed(spark, 1000), "id", 0.9, 0.05).groupBy("split").count().collect()}
    assert counts == {"train": 900, "val": 50, "test": 50}
    with pytest.raises(ValueError):
        sampling.split_by_ratio(skewed(spark, 2), "id")
    with pytest.raises(ValueError):
        sampling.split_by_range(skewed(spark, 10), [F.col("id")])


def test_samples(spark):
    df = skewed(spark, 600)
    with pytest.raises(ValueError):
        sampling.sample_n(df, 601, 1, "id")
    drawn = sampling.sample_per(df, "key", 2, 1, "id")
    assert drawn.groupBy("key").count().agg(F.max("count")).collect()[0][0] == 2
    assert sampling.pick_one(df, "key", [1, 2], "id").count() == 2 * df.select("key").distinct().count()
    dealt = sampling.sample_stratified(df.withColumn("bucket", F.when(F.col("id") < 3, "0-10%").otherwise("100%")), "bucket", 1, "id", n=10)
    assert {r["bucket"]: r["count"] for r in dealt.groupBy("bucket").count().collect()} == {"0-10%": 3, "100%": 7}


def test_guards(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "y", "c1")], "record_id string, prompt string, context_mode string")
    with pytest.raises(ValueError, match="missing columns"):
        routing.require_columns(df, ["record_id", "nope"])
    with pytest.raises(ValueError):
        routing.check_compatible(df, "x", "c0_parent")
    routing.check_compatible(df.where("record_id = 'a'"), "x", "c0_parent")
    with pytest.raises(ValueError):
        routing.ensure_single_mode(spark.createDataFrame([("fdg",), ("tree",)], "mode string"))
    assert routing.ensure_single_mode(spark.createDataFrame([], "mode string")) == "fdg"
    with pytest.raises(ValueError, match="unknown sources"):
        from traceloom.operators.evaluate import filter_sources

        filter_sources(spark.createDataFrame([("a",)], "source string"), ["a", "b"])
    with pytest.raises(ValueError):
        scoring.select_by_bucket(spark.createDataFrame([], "record_id string"), ["5%"], 1)


def test_routes_cover_every_attempt(spark):
    flags = [(t, a, o, v, n) for t in (True, False) for a in (True, False) for o in (True, False) for v in (True, False) for n in (0, 3)]
    df = spark.createDataFrame(flags, "token_overflow boolean, api_error boolean, output_truncated boolean, valid boolean, retry_count int")
    rows = routing.route_outcomes(df.withColumns({"api_error_type": F.lit("x"), "api_error_text": F.lit("quota exceeded")}), 3)
    counts = {r["outcome"]: r["count"] for r in rows.groupBy("outcome").count().collect()}
    assert sum(counts.values()) == len(flags) and set(counts) == {"skipped", "api_pending", "retry", "failed", "ok"}


def test_select_rollouts(spark):
    df = spark.createDataFrame([("p__rollout_1", "p", 1), ("p__rollout_2", "p", 2)], "id string, parent_id string, rollout_id int")
    assert routing.select_rollouts(df, "p").collect()[0]["rollout_id"] == 1
    assert routing.select_rollouts(df, "p__rollout_2").count() == 1
    assert routing.select_rollouts(df, "rollout", rollout_id=9, contains=True).count() == 1
    with pytest.raises(ValueError, match="no rollout"):
        routing.select_rollouts(df, "p", rollout_id=7)
    with pytest.raises(ValueError, match="near"):
        routing.select_rollouts(df, "out")


def test_retry_scaling_counts_unknown_as_failed(spark):
    rows = stats.retry_scaling(spark.createDataFrame([("0",), ("7",), (None,)], "success_bucket string"))
    assert {r["bucket"]: r["nodes"] for r in rows.collect()} == {"0": 1, "1": 0, "2": 0, "3": 0, "failed": 2}


def test_empty_statistics(spark):
    schema = "record_id string, origin string, skip int, is_final_answer boolean, form_status string, form_lean_pass boolean, form_skipped boolean, lean_verify boolean"
    assert scoring.verification_stats(spark.createDataFrame([], schema)).count() == 0
    rows = scoring.ratio_histogram(spark.createDataFrame([("r", "given", 1, False, "skipped", True, True, False)], schema)).collect()
    assert len(rows) == 44 and sum(r["records"] for r in rows) == 4


def test_strict_and_tolerant_records(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([('{"meta": {"record_id": "a"}}',), ("",), ("{broken",)], "value string").coalesce(1).write.text(path)
    assert [r["record_id"] for r in readers.read_stage_records(spark, path, strict=False).select("meta.record_id").collect()] == ["a"]
    assert readers.corrupt_lines(spark, path).collect()[0]["corrupt_lines"] == 1
    with pytest.raises(Exception):
        readers.read_stage_records(spark, path).collect()


def test_run_statistics_from_folders(spark):
    root = scratch_path(spark, "runs")
    import json
    from pathlib import Path

    body = {"exclude_skipped_derived": {"global_prove_verified_nodes_ratio": 1.5, "global_form_verified_nodes_ratio": 2.5}}
    for name in ("step_proof_ctx_c1_form_api", "step_proof_full_101", "step_proof_full_001"):
        folder = Path(root.removeprefix("file:")) / name
        folder.mkdir(parents=True)
        (folder / "stage3_verify_stats.json").write_text(json.dumps(body, indent=1))
    rows = {r["experiment"]: (r["ctx"], r["model"]) for r in readers.read_experiment_stats(spark, root, strict=True).collect()}
    assert rows == {"step_proof_ctx_c1_form_api": ("c1", "api"), "step_proof_full_101": ("c0", "goedel_8b")}
    listed = readers.list_files(spark, root)
    status = {r["experiment"]: r["complete"] for r in readers.experiment_status(listed, ["stage3_verify_stats.json"]).collect()}
    assert len(status) == 3 and all(status.values())


def test_checkpoint_folder_comes_from_the_session(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_stream_status_equals_the_fold(spark):
    log = spark.range(3000).select(
        F.concat(F.lit("r"), F.col("id") % 40).alias("record_id"), F.concat(F.lit("f"), F.col("id") % 7).alias("fact_id"), (F.col("id") % 5 + 1).cast("int").alias("attempt"),
        (F.col("id") % 3 == 0).alias("lean_pass"), F.lit(False).alias("lean_verify"), (F.col("id") % 11 == 0).alias("token_overflow"), F.lit(False).alias("api_error"),
        F.lit(False).alias("output_truncated"), F.lit(False).alias("no_code"),
    ).groupBy("record_id", "fact_id", "attempt").agg(*[F.max(c).alias(c) for c in ("lean_pass", "lean_verify", "token_overflow", "api_error", "output_truncated", "no_code")])
    log = cut_lineage(log)
    path = scratch_path(spark, "log")
    log.unionByName(log).repartition(3).write.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "out")
    live.run_updates(live.stream_status(stream, 3), out, scratch_path(spark, "mark"))
    got = {(r["record_id"], r["fact_id"]): (r["tries"], r["status"]) for r in live.latest_updates(spark, out, ["record_id", "fact_id"]).collect()}
    want = {(r["record_id"], r["fact_id"]): (r["tries"], r["status"]) for r in attempts.fold_status(log, 3).collect()}
    assert got == want


def test_sinks(spark):
    path = scratch_path(spark, "sinks")
    rows = spark.createDataFrame([("a", "ok"), ("b", "failed")], "record_id string, outcome string")
    sinks.write_routed(rows, f"{path}/routed")
    assert spark.read.schema("record_id string, outcome string").json(f"{path}/routed").count() == 2
    metrics = spark.createDataFrame([("m", "s1", 0.5), ("m", "avg", 0.5)], "metric string, source string, value double")
    sinks.write_metrics_csv(metrics, f"{path}/metrics")
    assert spark.read.option("header", True).csv(f"{path}/metrics").columns == ["metric", "s1", "avg"]


def test_ordered_ids(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (" ", 0)], "k string, pos int")
    assert [r["k"] for r in ids.requested_ids(df, "k", F.col("pos"), 5).orderBy("first_seen").collect()] == ["b", "a"]


def test_draws_move_no_payload(spark):
    import re

    from traceloom.operators import sampling

    rows = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("part"), F.repeat(F.lit("x"), 50).alias("payload"))
    plans = {
        "sample_n": sampling.sample_n(rows, 10, 1, "key"),
        "sample_per": sampling.sample_per(rows, "part", 10, 1, "key"),
        "split": sampling.split_by_ratio(rows, "key"),
        "stratified": sampling.sample_stratified(rows.withColumn("part", F.col("part").cast("string")), "part", 1, "key", per_bucket=5),
    }
    for name, df in plans.items():
        text = df._jdf.queryExecution().executedPlan().toString()
        for line in text.split("\n"):
            assert not (re.search(r"\bExchange\b", line) and "payload" in line), (name, line)
        assert "payload" not in str([x for x in re.findall(r"Window \[.*", text)])


@pytest.mark.parametrize("n", [1000, 1001])
def test_draws_have_one_way_for_every_size(spark, n):
    import hashlib

    from traceloom.operators import ranks, sampling

    rows = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("part"))
    digest = {k: hashlib.md5(f"5|{k}".encode()).hexdigest() for k in range(4000)}
    want = sorted(range(4000), key=digest.get)[:n]
    assert sorted(r.key for r in sampling.sample_n(rows, n, 5, "key").collect()) == sorted(want)
    per = {p: sorted((k for k in range(4000) if k % 3 == p), key=digest.get)[:n] for p in range(3)}
    assert sorted(r.key for r in sampling.sample_per(rows, "part", n, 5, "key").collect()) == sorted(k for v in per.values() for k in v)
    top = ranks.top_per(rows, ["part"], [F.col("key").desc()], n).collect()
    assert {(r.part, r["rank"]): r.key for r in top} == {(p, i + 1): k for p in range(3) for i, k in enumerate(sorted((k for k in range(4000) if k % 3 == p), reverse=True)[:n])}


def test_finished_rows_without_prompt_or_context(spark):
    done = spark.createDataFrame(
        [(1, "p", "c0_parent"), (2, None, None), (3, " ", ""), (4, "q", "c0_parent"), (5, "p", "c1"), (6, None, "c1")], "id int, prompt string, context_mode string"
    )
    assert sorted(r.id for r in routing.incompatible(done, "p", "c0_parent").collect()) == [4, 5, 6]
    assert sorted(r.id for r in routing.incompatible(done, "p", "c1").collect()) == [1, 2, 3, 4]


def test_node_without_prove_status_is_pending(spark):
    nodes = spark.createDataFrame([("r", "success", None), ("r", "success", "success")], "record_id string, form_status string, prove_status string")
    row = stats.record_status(nodes.withColumns({"form_failed": F.lit(0), "prove_failed": F.lit(0)})).first()
    assert (row.prove_pending, row.prove_success) == (1, 1)


def test_steps_without_rollouts_and_traces(spark):
    records = spark.createDataFrame(
        [("1", [("0.5", '{"score":"1"}'), ("0.5", None), ("1", "[1]"), None, ("2", "null")]), ("2", None), ("3", [])], "step string, rollouts array<struct<reward:string,trace:string>>"
    )
    rows = readers.explode_samples(records, ["score"])
    gaps = {r.step: (r.rollouts, r.missing_trace, r.invalid_trace) for r in stats.trace_gaps(rows).collect()}
    assert gaps == {1: (5, 2, 2), 2: (0, 0, 0), 3: (0, 0, 0), None: (5, 2, 2)}
    spread = {r.step: (r.n, r.missing) for r in stats.reward_by_step(rows).collect()}
    assert spread == {1: (4, 1), 2: (0, 0), 3: (0, 0), None: (4, 1)}
    numbers, _ = stats.reward_trace_by_step(rows, ["score"], ["score"])
    assert {(r.step, r.n, r.missing) for r in numbers.collect()} == {(1, 1, 0), (None, 1, 0)}


def test_run_folders_and_paths(spark, tmp_path):
    for name, files in {"step_proof_a": ["summary/metrics.json", "scores.jsonl"], "step_proof_b": ["metrics.json"], "step_proof_c": []}.items():
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).parent.mkdir(exist_ok=True)
            (tmp_path / name / f).write_text("{}")
    root = str(tmp_path)
    status = readers.experiment_status(readers.list_files(spark, root), ["summary/metrics.json", "scores.jsonl"], readers.run_folders(spark, root))
    assert {r.experiment: r.missing for r in status.collect()} == {
        "step_proof_a": [], "step_proof_b": ["summary/metrics.json", "scores.jsonl"], "step_proof_c": ["summary/metrics.json", "scores.jsonl"]
    }


def test_bad_lines_are_named_across_splits(spark, tmp_path):
    """A file in many parts: the error names file and line, and no task reads a whole file."""
    path = tmp_path / "records"
    path.mkdir()
    for name, bad in (("a.jsonl", {700}), ("b.jsonl", {3, 899}), ("c.jsonl", set())):
        lines = ["" if k % 50 == 7 else '{"meta": {"record_id": "x"' if k in bad else '{"meta": {"record_id": "r%d", "source_file": "%s"}}' % (k, "y" * 100) for k in range(900)]
        (path / name).write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 9
        got = sorted((r.source_file.rsplit("/", 1)[1], r.line) for r in readers.bad_lines(spark, str(path)).collect())
        assert got == [("a.jsonl", 701), ("b.jsonl", 4), ("b.jsonl", 900)]
        with pytest.raises(ValueError, match="a.jsonl:701.*b.jsonl:4.*b.jsonl:900"):
            readers.read_stage_records(spark, str(path))
        assert len(readers.read_stage_records(spark, str(path), strict=False).select("meta.record_id").collect()) == 900 * 3 - 18 * 3 - 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_traces_of_a_table_in_parts(spark, tmp_path):
    """A shard that is a folder: one name, and rows that count on over its parts; plain files beside it count for themselves."""
    rows = spark.createDataFrame([(k, f"q{k}", f"r{k}") for k in range(30)], "id long, question string, response string")
    rows.repartition(4).write.parquet(str(tmp_path / "many.parquet"))
    rows.limit(3).toPandas().to_parquet(tmp_path / "single.parquet")
    got = readers.read_traces(spark, str(tmp_path)).collect()
    assert sorted((r.source_file, r.source_row_pos) for r in got) == [("many.parquet", k) for k in range(30)] + [("single.parquet", k) for k in range(3)]
    assert {r.record_id for r in got} == {str(k) for k in range(30)}
    some = readers.read_traces(spark, str(tmp_path), "many.parquet", limit=7)
    assert [(r.source_file, r.source_row_pos) for r in some.collect()] == [("many.parquet", k) for k in range(7)]
    alone = readers.read_traces(spark, str(tmp_path), "single.*", limit=2)
    assert [(r.source_file, r.source_row_pos) for r in alone.collect()] == [("single.parquet", 0), ("single.parquet", 1)]


def test_bad_lines_count_on_over_the_parts_of_one_text(spark, tmp_path):
    path = str(tmp_path / "text")
    value = F.when(F.col("id") % 7 == 0, F.lit("")).when(F.col("id") % 11 == 0, F.lit('{"meta": ')).otherwise(F.lit('{"meta": {"record_id": "r"}}'))
    spark.range(500).repartitionByRange(6, "id").sortWithinPartitions("id").select(value.alias("value")).write.text(path)
    got = readers.bad_lines(spark, path, parts=True)
    assert got.select("source_file").distinct().count() > 1
    assert sorted(r.line for r in got.collect()) == [k + 1 for k in range(500) if k % 11 == 0 and k % 7]


def test_lines_and_streams_are_written_in_many_files(spark):
    """No query puts its lines in one file, or a batch of its stream in one."""
    import inspect

    from catalog import tables

    assert "coalesce" not in inspect.getsource(tables.bad_lines)
    log = tables._stream(spark, spark.range(1000), "many-files")
    live.run_available(log, out := scratch_path(spark, "out"), scratch_path(spark, "mark"))
    assert spark.read.schema("id long").parquet(out).count() == 1000
    files = spark.read.schema("id long").parquet(out).inputFiles()
    assert len(files) >= 4
