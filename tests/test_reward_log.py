"""Rewards from the attempt log, and the streams over it: count-down, time-to-live and resume."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import attempts, reward
from traceloom.session import scratch_path
from traceloom.streaming import live

LOG = "record_id string, fact_id string, stage string, attempt int, lean_pass boolean, lean_verify boolean, token_overflow boolean, api_error boolean, output_truncated boolean, no_code boolean, lean_code string, error_msg string"
FLAGS = (False, False, False, False)


def entry(record, fact, stage, attempt, passed, flags=FLAGS, code="c", error=""):
    return (record, fact, stage, attempt, passed, passed and stage == "prover", *flags, code, error)


def graph(*facts):
    listed = [
        {"fact_id": i, "text": f"text of {i}", "parent_fact_ids": p, "is_final_answer": o == "answer", "origin": o} for i, p, o in facts
    ]
    return "```json\n" + json.dumps({"problem_id": "p", "problem_text": "q", "facts": listed}) + "\n```"


CHAIN = graph(("f_1", [], "given"), ("f_2", ["f_1"], "derived"), ("f_3", ["f_2", "f_1"], "answer"))


def scored(spark, rows, log, **more):
    candidates = spark.createDataFrame(rows, "record_id string, model_output string")
    return {r.record_id: r for r in reward.rewards_from_log(candidates, spark.createDataFrame(log, LOG), **more).collect()}


def test_rewards_follow_the_log(spark):
    log = [
        entry("a", "f_2", "formalizer", 1, False, error="bad"), entry("a", "f_2", "formalizer", 2, True, code="two"),
        entry("a", "f_2", "formalizer", 1, False, error="bad"),  # a replay
        entry("a", "f_2", "prover", 1, True), entry("a", "f_3", "formalizer", 1, True), entry("a", "f_3", "prover", 1, False),
        entry("a", "f_3", "prover", 2, False), entry("a", "f_3", "prover", 3, False), entry("a", "f_3", "prover", 4, True),  # past the limit
        entry("a", "f_1", "formalizer", 1, True), entry("a", "f_9", "formalizer", 1, True),  # a root and an unknown fact
        entry("b", "f_2", "formalizer", 1, True), entry("b", "f_3", "formalizer", 1, True, (True, False, False, False)),
        entry("b", "f_3", "prover", 1, True),  # not formalized, so never proved
        entry("c", "f_2", "formalizer", 1, True), entry("d", "f_2", "formalizer", 1, True),
    ]
    rows = [("a", CHAIN), ("b", CHAIN), ("c", "just\twords, isn't it"), ("d", graph(("f_1", [], "given"))), ("e", "```json\n{oops\n```"), ("f", None)]
    got = scored(spark, rows, log)
    a, b = got["a"], got["b"]
    assert (a.num_formalized, a.num_proved, a.num_final_verified, a.done) == (2, 1, 0, True)
    assert a.score == pytest.approx(0.2 + 0.4 + 0.2 / 2)
    by_id = {f.fact_id: f for f in a.facts}
    assert by_id["f_1"].formalizer is None and by_id["f_1"].proof_obligation is None
    assert (by_id["f_2"].formalizer.status, by_id["f_2"].formalizer.attempts, by_id["f_2"].formalizer.lean_code) == ("success", 2, "two")
    assert (by_id["f_3"].prover.status, by_id["f_3"].prover.attempts, by_id["f_3"].prover.verified) == ("failed", 3, False)
    assert by_id["f_3"].proof_obligation == "Given text of f_2 and text of f_1, prove that text of f_3."
    assert [f.fact_id for f in a.facts] == ["f_1", "f_2", "f_3"]
    assert (b.num_formalized, b.num_proved, b.done) == (1, 0, False) and b.facts[2].formalizer.status == "pending" and b.facts[2].prover is None
    assert (got["c"].valid_json, got["c"].parse_error) == (False, f"No JSON block found. Text starts with: {'just' + chr(9) + 'words, isn' + chr(39) + 't it'!r}")
    assert (got["d"].validator_passed, got["d"].facts, got["d"].done, got["d"].parse_error) == (False, [], True, "")
    assert got["e"].parse_error == "The JSON block cannot be read." and got["f"].score == -1.0


def test_without_prover_a_formalized_fact_is_done(spark):
    log = [entry("a", "f_2", "formalizer", 1, True), entry("a", "f_3", "formalizer", 1, True)]
    got = scored(spark, [("a", CHAIN)], log, include_prover=False)["a"]
    assert got.done and got.num_formalized == 2 and got.num_proved == 0 and got.facts[1].prover is None


def whole_log(seed):
    """Graphs and a complete or broken-off log of them, as it would be written."""
    rng = random.Random(seed)
    graphs, log = [], []
    for r in range(60):
        record = f"r{r}"
        facts = [(f"f_{k}", [f"f_{k - 1}"] if k else []) for k in range(rng.randrange(5))]
        graphs.append((record, facts))
        for fact, parents in facts:
            if not parents or rng.random() < 0.1:
                continue
            for stage in ("formalizer", "prover"):
                passed = False
                for attempt in range(1, 4):
                    if rng.random() < 0.05:
                        break  # broken off
                    passed = rng.random() < 0.4
                    log.append(entry(record, fact, stage, attempt, passed))
                    if passed:
                        break
                if not passed:
                    break
    return graphs, log


def fold(graphs, log):
    """Records whose working facts are all done."""
    done = set()
    for record, facts in graphs:
        if all(fact_is_done(record, fact, log) for fact, parents in facts if parents):
            done.add(record)
    return done


def fact_is_done(record, fact, log):
    mine = [e for e in log if e[:2] == (record, fact)]
    status = {}
    for stage in ("formalizer", "prover"):
        rows = [e for e in mine if e[2] == stage]
        status[stage] = "success" if any(e[4] for e in rows) else "failed" if any(e[3] == 3 for e in rows) else "pending"
    return status["formalizer"] == "failed" or (status["formalizer"] == "success" and status["prover"] != "pending")


def test_countdown_equals_the_fold_with_repeats_late_rows_and_a_restart(spark):
    live.keep_state_in_rocksdb(spark)
    graphs, log = whole_log(5)
    rng = random.Random(1)
    rows = [*log, *rng.sample(log, len(log) // 3)]
    rng.shuffle(rows)
    facts = "record_id string, facts array<struct<fact_id string, parent_fact_ids array<string>>>"
    graph_path, log_path, out, mark = (scratch_path(spark, n) for n in ("graphs", "log", "out", "mark"))

    def work():
        graphs_in = spark.readStream.schema(facts).option("maxFilesPerTrigger", 1).parquet(graph_path)
        log_in = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(log_path)
        live.run_available(live.stream_countdown(live.countdown_events(graphs_in, log_in)), out, mark)
        return [(r.record_id, r.facts) for r in spark.read.schema("record_id string, facts int").parquet(out).collect()]

    half = len(rows) // 2
    spark.createDataFrame(graphs[:30], facts).repartition(2).write.mode("append").parquet(graph_path)
    spark.createDataFrame(rows[:half], LOG).repartition(3).write.mode("append").parquet(log_path)
    first = work()
    assert {r for r, _ in first} <= fold(graphs, log) and len(set(first)) == len(first)
    spark.createDataFrame(graphs[30:], facts).repartition(1).write.mode("append").parquet(graph_path)  # their attempts came first
    spark.createDataFrame(rows[half:], LOG).repartition(2).write.mode("append").parquet(log_path)
    got = work()
    assert len(got) == len(set(got)) and set(first) <= set(got)
    assert got and dict(got) == {r: sum(bool(p) for _, p in f) for r, f in graphs if r in fold(graphs, log)}
    nodes = spark.createDataFrame([(r, f, not p, fact_is_done(r, f, log)) for r, fs in graphs for f, p in fs], "record_id string, fact_id string, root boolean, done boolean")
    batch = {r.record_id for r in attempts.graph_done(nodes, F.col("root"), F.col("done")).where("done").collect()}
    assert batch == {r for r, f in graphs if f and r in dict(got)}


def test_countdown_state_ends(spark):
    """A record is told once while its state lives; long after, its repeated events tell it again."""
    live.keep_state_in_rocksdb(spark)
    path, out, mark = (scratch_path(spark, n) for n in ("events", "out", "mark"))
    schema = "record_id string, needed array<string>, fact_id string, stage string, verdict string, second long"
    whole = lambda name, second: [(name, ["f"], None, None, None, second), (name, None, "f", "formalizer", "failed", second)]
    told = []
    for batch in (whole("a", 0), whole("a", 30) + [("b", ["g"], None, None, None, 30)], whole("c", 500), whole("d", 501), whole("a", 502)):
        rows = spark.createDataFrame(batch, schema).withColumn("arrived", F.timestamp_seconds(F.col("second") + 1000))
        rows.coalesce(1).write.mode("append").parquet(path)
        events = spark.readStream.schema(rows.schema).parquet(path)
        live.run_available(live.stream_countdown(events, arrived="arrived", ttl_seconds=60), out, mark)
        told.append(sorted(r.record_id for r in spark.read.schema("record_id string, facts int").parquet(out).collect()))
    assert told == [["a"], ["a"], ["a", "c"], ["a", "c", "d"], ["a", "a", "c", "d"]]


NODES = "record_id string, fact_id string, attempt int, lean_pass boolean, lean_verify boolean, token_overflow boolean, api_error boolean, output_truncated boolean, no_code boolean, arrived timestamp"


def test_status_with_time_to_live(spark):
    """One row a node however long its attempts go on; after the time-to-live its state is gone and a repeat begins anew."""
    live.keep_state_in_rocksdb(spark)
    path, out, mark = (scratch_path(spark, n) for n in ("nodes", "out", "mark"))
    row = lambda node, attempt, passed, second: ("r", node, attempt, passed, passed, False, False, False, False, f"2026-01-01 00:{second // 60:02d}:{second % 60:02d}")
    batches = [
        [row("a", 1, False, 0), row("b", 1, True, 0)],
        [row("a", 2, False, 50), row("a", 1, False, 51)],  # goes on before its time is over, and a repeat
        [row("a", 3, True, 100)],  # over any window of a minute, yet the same node
        [row("c", 1, False, 400)],  # moves the watermark on: a and b end
        [row("d", 1, False, 401)],
        [row("b", 1, True, 402)],
    ]
    states = []
    for batch in batches:
        rows = spark.createDataFrame(batch, NODES.replace("timestamp", "string")).withColumn("arrived", F.to_timestamp("arrived"))
        rows.coalesce(1).write.mode("append").parquet(path)
        log = spark.readStream.schema(rows.schema).parquet(path)
        live.run_updates(live.stream_status_ttl(log, 2, "arrived", 60), out, mark)
        found = spark.read.option("basePath", out).parquet(out)
        states.append(sorted((r.fact_id, r.tries, r.status) for r in found.collect()))
    fresh = [sorted(set(b) - set(a)) if len(set(b)) > len(set(a)) else [x for x, g in itertools.groupby(b) if len(list(g)) > a.count(x)] for a, b in itertools.pairwise([[], *states])]
    assert fresh[:3] == [[("a", 1, "pending"), ("b", 1, "success")], [("a", 2, "pending")], [("a", 3, "success")]]
    assert fresh[5] == [("b", 1, "success")]  # told again, for its state had ended
    assert [s for s in states[-1] if s[0] == "a"] == [("a", 1, "pending"), ("a", 2, "pending"), ("a", 3, "success")]


def test_resume_reads_done_anew_and_leaves_replayed_batches(spark, tmp_path):
    path, out, mark, done = (scratch_path(spark, n) for n in ("records", "out", "mark", "done"))
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "record_id string").coalesce(1)
    read = lambda: spark.read.schema("record_id string").parquet(done)
    kept = lambda: sorted(r.record_id for r in spark.read.schema("record_id string").parquet(f"{out}/batch=*").collect())

    def work(mark):
        live.run_resume(spark.readStream.schema("record_id string").parquet(path), read, out, mark)

    ids("x").write.parquet(done)
    ids("a", "b", "x", "a").write.parquet(path)
    work(mark)
    assert kept() == ["a", "b"]
    ids("c").write.mode("append").parquet(done)  # finished between two batches
    ids("c", "d", "a").write.mode("append").parquet(path)
    work(mark)
    assert kept() == ["a", "b", "d"]
    ids("a", "d").write.mode("append").parquet(done)
    work(scratch_path(spark, "mark"))  # all is run again from the start: the first folder stays, for it was written whole
    assert kept()[:2] == ["a", "b"]


def test_countdown_asks_its_state_once_a_record():
    """However many facts and attempts a record has, its state is read and written once a batch."""
    import pandas as pd

    calls = []

    class Store:
        def __init__(self):
            self.value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return Store()

    machine = live.CountDown(True, None)
    machine.init(Handle())
    ids = [f"f{k}" for k in range(500)]
    ends = lambda stage: pd.DataFrame({"needed": None, "fact_id": ids, "stage": stage, "verdict": "success"})
    told = [t for part in ([ends("prover")], [pd.DataFrame({"needed": [ids], "fact_id": None, "stage": None, "verdict": None})], [ends("formalizer")]) for t in machine.handleInputRows(("r",), iter(part), None)]
    assert len(told) == 1 and told[0].to_dict("records") == [{"record_id": "r", "facts": 500}]
    assert calls == ["get", "update"] * 3


def test_answers_are_read_once_for_their_traces(spark):
    """The graphs meet the outcomes of their log in one join, so no second reading of the answers stands in the plan."""
    from catalog.attempts import candidate_rewards_from_log

    plan = candidate_rewards_from_log(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_document#") > 0 and plan.count("inline(array(struct(_document,") == 1
