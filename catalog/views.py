"""Views that give the driver's tables the shapes of the input data: DataFrames here, the same in DuckDB SQL.

All of them are row by row: no window and no grouping is needed to get facts, rollouts or attempts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.rows import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- nodes: one row per node of a proof run, from lineitem -------------------------------------------------

NODES_SQL = """
  SELECT concat('p', l_orderkey // 4, '__rollout_', l_orderkey % 4 + 1) AS record_id,
         concat('p', l_orderkey // 4) AS parent_id, CAST(l_orderkey % 4 + 1 AS INT) AS rollout_id,
         l_linenumber AS pos, concat('f_', l_linenumber, '_', l_partkey, '_', l_suppkey) AS fact_id, origin,
         (origin = 'answer' OR l_quantity > 48) AS is_final_answer,
         CAST(CASE WHEN origin IN ('given', 'introduced') THEN 1 WHEN l_quantity < 8 THEN 1 ELSE 0 END AS INT) AS skip,
         CASE WHEN origin IN ('given', 'introduced') THEN 'skipped' WHEN l_tax < 0.06 THEN 'success' ELSE 'failed' END AS form_status,
         (origin IN ('given', 'introduced') OR l_tax < 0.06 OR l_tax > 0.075) AS form_lean_pass,
         (origin IN ('given', 'introduced')) AS form_skipped,
         CASE WHEN origin IN ('given', 'introduced') OR l_tax >= 0.06 THEN 'skipped' WHEN l_linestatus = 'F' THEN 'success'
              WHEN l_discount > 0.08 THEN 'running' ELSE 'failed' END AS prove_status,
         (origin IN ('derived', 'answer') AND l_tax < 0.06 AND (l_linestatus = 'F' OR l_discount < 0.02)) AS lean_pass,
         (origin IN ('derived', 'answer') AND l_tax < 0.06 AND l_linestatus = 'F' AND l_discount < 0.09) AS lean_verify,
         (origin IN ('given', 'introduced') OR l_tax >= 0.06) AS prove_skipped,
         CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 'prompt token limit' WHEN 1 THEN 'output truncated'
              WHEN 2 THEN 'No Lean 4 code block found' WHEN 3 THEN 'declaration uses sorry' WHEN 4 THEN 'Timed out'
              WHEN 5 THEN '{"severity": "error", "data": "type mismatch"}' WHEN 6 THEN 'unknown constant x'
              WHEN 7 THEN 'application type mismatch' WHEN 8 THEN 'linarith tactic failed' WHEN 9 THEN 'unsolved goals'
              WHEN 10 THEN '' ELSE 'odd   words' END AS error_msg,
         CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'lemma x := by simp' END AS lean_code,
         l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 'given' WHEN l_returnflag = 'A' AND l_linenumber < 4 THEN 'introduced'
                       WHEN l_linenumber >= 6 THEN 'answer' ELSE 'derived' END AS origin FROM lineitem)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "origin",
        F.when(line == 1, "given")
        .when((F.col("l_returnflag") == "A") & (line < 4), "introduced")
        .when(line >= 6, "answer")
        .otherwise("derived"),
    )
    root = F.col("origin").isin("given", "introduced")
    tax, final = F.col("l_tax"), F.col("l_linestatus") == "F"
    parent = F.concat(F.lit("p"), F.floor(F.col("l_orderkey") / 4).cast("string"))
    rollout = (F.col("l_orderkey") % 4 + 1).cast("int")
    errors = [
        "prompt token limit", "output truncated", "No Lean 4 code block found", "declaration uses sorry", "Timed out",
        '{"severity": "error", "data": "type mismatch"}', "unknown constant x", "application type mismatch",
        "linarith tactic failed", "unsolved goals", "", "odd   words",
    ]
    return lines.select(
        F.concat(parent, F.lit("__rollout_"), rollout.cast("string")).alias("record_id"),
        parent.alias("parent_id"),
        rollout.alias("rollout_id"),
        line.alias("pos"),
        F.concat_ws("_", F.lit("f"), line, F.col("l_partkey"), F.col("l_suppkey")).alias("fact_id"),
        "origin",
        ((F.col("origin") == "answer") | (F.col("l_quantity") > 48)).alias("is_final_answer"),
        F.when(root | (F.col("l_quantity") < 8), 1).otherwise(0).alias("skip"),
        F.when(root, "skipped").when(tax < 0.06, "success").otherwise("failed").alias("form_status"),
        (root | (tax < 0.06) | (tax > 0.075)).alias("form_lean_pass"),
        root.alias("form_skipped"),
        F.when(root | (tax >= 0.06), "skipped")
        .when(final, "success")
        .when(F.col("l_discount") > 0.08, "running")
        .otherwise("failed")
        .alias("prove_status"),
        (~root & (tax < 0.06) & (final | (F.col("l_discount") < 0.02))).alias("lean_pass"),
        (~root & (tax < 0.06) & final & (F.col("l_discount") < 0.09)).alias("lean_verify"),
        (root | (tax >= 0.06)).alias("prove_skipped"),
        F.get(F.array(*[F.lit(e) for e in errors]), (F.col("l_partkey") % 12).cast("int")).alias("error_msg"),
        F.when(F.col("l_suppkey") % 3 == 0, "").otherwise("lemma x := by simp").alias("lean_code"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )


# --- graph records: one row per document, its sentences are the facts --------------------------------------

SENTENCES_SQL = """
  SELECT concat('d', doc_id) AS record_id, source, s, i, n, (length(s) * 31 + i * 17 + doc_id * 7) % 1000 AS h
  FROM (SELECT doc_id, source, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS i,
               len(string_split(text, '. ')) AS n FROM documents)"""

FACTS_SQL = """
  SELECT record_id, source, CAST(i AS INT) AS pos, CASE WHEN h < 4 AND i > 1 THEN concat('f_', i - 1) ELSE concat('f_', i) END AS fact_id,
         CASE WHEN h BETWEEN 4 AND 7 THEN '' ELSE s END AS text,
         CASE WHEN h BETWEEN 8 AND 11 THEN 'assumed' WHEN i = n THEN 'answer' WHEN i = 1 THEN 'given'
              WHEN h BETWEEN 100 AND 139 THEN 'introduced' ELSE 'derived' END AS origin,
         ((i = n AND h % 50 <> 13) OR h IN (12, 14)) AS is_final_answer,
         (h % 10 < 8) AS formalized, (h % 10 < 5) AS verified, i, n, h
  FROM sentences"""

LINKS_SQL = """
  SELECT record_id, pos, fact_id, origin, ord, CASE WHEN ord = 1 THEN concat('f_', i - 1) WHEN ord = 2 THEN concat('f_', i - 2)
         WHEN ord = 3 THEN 'f_0' WHEN ord = 4 THEN concat('f_', i + 1) WHEN ord = 5 THEN concat('f_', i) ELSE concat('f_', i - 1) END AS parent_id
  FROM facts, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS ord)
  WHERE (ord = 1 AND i > 1 AND origin IN ('derived', 'answer') AND h NOT BETWEEN 32 AND 35)
     OR (ord = 2 AND i > 2 AND h % 2 = 0 AND origin IN ('derived', 'answer') AND h NOT BETWEEN 32 AND 35)
     OR (ord = 3 AND h BETWEEN 20 AND 23) OR (ord = 4 AND h BETWEEN 24 AND 27) OR (ord = 5 AND h = 28)
     OR (ord = 6 AND h BETWEEN 29 AND 31 AND i > 1)"""


def graph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = lambda n: F.concat(F.lit("f_"), n.cast("string"))
    # The table is one row group, so one task would build all graphs; a stage that wrote the graphs would have dealt them out by id.
    dealt = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    staged = dealt.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), "source", F.col("text").alias("raw_cot"), "doc_id"
    )
    numbered = F.transform(
        F.split("raw_cot", r"\. "),
        lambda s, i: F.struct(
            s.alias("s"), (i + 1).alias("i"), ((F.length(s) * 31 + (i + 1) * 17 + F.col("doc_id") * 7) % 1000).alias("h")
        ),
    )
    staged = settle(staged, p=numbered)

    def origin(e):
        return (
            F.when(e["h"].between(8, 11), F.lit("assumed"))
            .when(e["i"] == F.size("p"), F.lit("answer"))
            .when(e["i"] == 1, F.lit("given"))
            .when(e["h"].between(100, 139), F.lit("introduced"))
            .otherwise(F.lit("derived"))
        )

    staged = settle(staged, p=F.transform("p", lambda e: e.withField("origin", origin(e))))

    def fact(e):
        i, h = e["i"], e["h"]
        proved = e["origin"].isin("derived", "answer") & ~h.between(32, 35)
        parents = F.array_compact(
            F.array(
                F.when(proved & (i > 1), named(i - 1)),
                F.when(proved & (i > 2) & (h % 2 == 0), named(i - 2)),
                F.when(h.between(20, 23), F.lit("f_0")),
                F.when(h.between(24, 27), named(i + 1)),
                F.when(h == 28, named(i)),
                F.when(h.between(29, 31) & (i > 1), named(i - 1)),
            )
        )
        return F.struct(
            F.when((h < 4) & (i > 1), named(i - 1)).otherwise(named(i)).alias("fact_id"),
            F.when(h.between(4, 7), F.lit("")).otherwise(e["s"]).alias("text"),
            parents.alias("parent_fact_ids"),
            (((i == F.size("p")) & (h % 50 != 13)) | h.isin(12, 14)).alias("is_final_answer"),
            e["origin"].alias("origin"),
            F.lit(0).alias("skip"),
            (h % 10 < 8).alias("formalized"),
            (h % 10 < 5).alias("verified"),
        )

    first = F.get(F.col("p"), F.lit(0))["s"]
    return settle(staged, problem_text=first, facts=F.transform("p", fact)).select(
        "record_id", "source", "raw_cot", "problem_text", "facts"
    )


# --- traces, grades, attempts, step samples ----------------------------------------------------------------

TRACES_SQL = """
  SELECT concat('d', doc_id) AS record_id, source, lang, doc_id,
       CASE CAST(doc_id % 4 AS INT)
         WHEN 0 THEN concat('<think>', substr(text, 1, 60), '</think>', chr(10), substr(text, 61))
         WHEN 1 THEN concat(substr(text, 1, 40), chr(10), '<think>', substr(text, 41))
         WHEN 2 THEN concat('<THINK id=1>', substr(text, 1, 20), '</think> mid <think>b</think>', substr(text, 21))
         ELSE text END AS raw_cot FROM documents"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, kind = F.col("text"), F.col("doc_id") % 4
    rest = lambda start: F.substring(text, F.lit(start), F.length(text))
    head = lambda n: F.left(text, F.lit(n))
    cot = (
        F.when(kind == 0, F.concat(F.lit("<think>"), head(60), F.lit("</think>\n"), rest(61)))
        .when(kind == 1, F.concat(head(40), F.lit("\n<think>"), rest(41)))
        .when(kind == 2, F.concat(F.lit("<THINK id=1>"), head(20), F.lit("</think> mid <think>b</think>"), rest(21)))
        .otherwise(text)
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), "source", "lang", "doc_id", cot.alias("raw_cot")
    )


GRADES_SQL = """
  SELECT concat('p', o_orderkey // 4, '__rollout_', o_orderkey % 4 + 1) AS id, concat('p', o_orderkey // 4) AS parent_id,
         CAST(o_orderkey % 4 + 1 AS INT) AS rollout_id, o_orderpriority AS source, o_orderstatus AS answer,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS is_correct, o_custkey FROM orders"""


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / 4).cast("string"))
    rollout = (F.col("o_orderkey") % 4 + 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.concat(parent, F.lit("__rollout_"), rollout.cast("string")).alias("id"),
        parent.alias("parent_id"),
        rollout.alias("rollout_id"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderstatus").alias("answer"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_correct"),
        "o_custkey",
    )


ATTEMPTS_SQL = """
  SELECT concat('c', conv_id) AS record_id, concat('f_', turn // 3) AS fact_id, CAST(turn % 3 + 1 AS INT) AS attempt, role, text AS output,
         (length(text) % 3 <> 1) AS lean_pass, (length(text) % 3 = 0) AS lean_verify, (length(text) % 11 = 0) AS token_overflow,
         (length(text) % 13 = 0) AS api_error, (length(text) % 7 = 0) AS output_truncated, (length(text) % 5 = 0) AS no_code,
         conv_id, turn FROM conversations"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, turn = F.length("text"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("record_id"),
        F.concat(F.lit("f_"), F.floor(turn / 3).cast("string")).alias("fact_id"),
        (turn % 3 + 1).cast("int").alias("attempt"),
        "role",
        F.col("text").alias("output"),
        (n % 3 != 1).alias("lean_pass"),
        (n % 3 == 0).alias("lean_verify"),
        (n % 11 == 0).alias("token_overflow"),
        (n % 13 == 0).alias("api_error"),
        (n % 7 == 0).alias("output_truncated"),
        (n % 5 == 0).alias("no_code"),
        "conv_id",
        "turn",
    )


SAMPLES_SQL = """
  SELECT CAST(event_id // 100 AS BIGINT) AS step, CAST(event_id % 100 AS INT) AS rollout_idx,
         CASE WHEN event_type = 'error' THEN NULL WHEN user_id % 17 = 0 THEN 'n/a' ELSE CAST(value / 20.0 - 1.0 AS VARCHAR) END AS reward_text,
         CASE WHEN event_type = 'error' OR user_id % 17 = 0 THEN NULL ELSE value / 20.0 - 1.0 END AS reward,
         (event_type = 'error') AS reward_missing, (event_type <> 'error') AS valid_json,
         event_type IN ('purchase', 'signup') AS validator_passed, value, event_type, user_id FROM events"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step samples; ``reward_text`` is the loosely typed input, the other columns are for comparison."""
    reward = F.col("value") / 20.0 - 1.0
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 100).alias("step"),
        (F.col("event_id") % 100).cast("int").alias("rollout_idx"),
        F.when(F.col("event_type") == "error", None)
        .when(F.col("user_id") % 17 == 0, F.lit("n/a"))
        .otherwise(reward.cast("string"))
        .alias("reward_text"),
        (F.col("event_type") != "error").alias("valid_json"),
        F.col("event_type").isin("purchase", "signup").alias("validator_passed"),
        "value",
        "event_type",
        "user_id",
    )


# --- the log of what was tried on the facts of graph records --------------------------------------------------

FACT_LOG_SQL = """
  SELECT record_id, fact_id, stage, attempt, u % 5 < 2 AS lean_pass, stage = 'prover' AND u % 5 < 2 AS lean_verify, u % 11 = 0 AS token_overflow,
         u % 13 = 0 AS api_error, u % 17 = 0 AS output_truncated, u % 19 = 0 AS no_code, concat('code ', u) AS lean_code, concat('error ', u) AS error_msg
  FROM (SELECT record_id, fact_id, stage, attempt, h, h + attempt * 7 + CASE WHEN stage = 'prover' THEN 3 ELSE 0 END AS u
        FROM facts, (SELECT unnest([1, 2, 3, 4]) AS attempt), (SELECT unnest(['formalizer', 'prover']) AS stage))
  WHERE attempt <= CASE WHEN stage = 'prover' THEN 1 + (h // 4) % 4 ELSE 1 + h % 4 END"""


def fact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("at", "s"))
    number = F.col("at") + 1
    facts = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"),
        number.alias("i"),
        ((F.length("s") * 31 + number * 17 + F.col("doc_id") * 7) % 1000).alias("h"),
    )
    named = F.concat(F.lit("f_"), F.when((F.col("h") < 4) & (F.col("i") > 1), F.col("i") - 1).otherwise(F.col("i")).cast("string"))
    stages = F.explode(F.array(F.lit("formalizer"), F.lit("prover"))).alias("stage")
    proving = F.col("stage") == "prover"
    most = F.when(proving, 1 + F.floor(F.col("h") / 4) % 4).otherwise(1 + F.col("h") % 4)
    tried = facts.select("record_id", named.alias("fact_id"), "h", stages).select("*", F.explode(F.sequence(F.lit(1), most.cast("int"))).alias("attempt"))
    u = F.col("u")
    return tried.withColumn("u", F.col("h") + F.col("attempt") * 7 + F.when(proving, 3).otherwise(0)).select(
        "record_id", "fact_id", "stage", "attempt", (u % 5 < 2).alias("lean_pass"), (proving & (u % 5 < 2)).alias("lean_verify"), (u % 11 == 0).alias("token_overflow"),
        (u % 13 == 0).alias("api_error"), (u % 17 == 0).alias("output_truncated"), (u % 19 == 0).alias("no_code"),
        F.concat(F.lit("code "), u.cast("string")).alias("lean_code"), F.concat(F.lit("error "), u.cast("string")).alias("error_msg"),
    )


VIEWS = {
    "nodes": (NODES_SQL, []),
    "sentences": (SENTENCES_SQL, []),
    "facts": (FACTS_SQL, ["sentences"]),
    "links": (LINKS_SQL, ["facts"]),
    "traces": (TRACES_SQL, []),
    "grades": (GRADES_SQL, []),
    "attempts": (ATTEMPTS_SQL, []),
    "samples": (SAMPLES_SQL, []),
    "fact_log": (FACT_LOG_SQL, ["facts"]),
}


def with_views(sql: str) -> str:
    """Put the views a text names in front of it as common table expressions."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][1]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][0]})" for name in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        recursive = body[5:].lstrip().upper().startswith("RECURSIVE ")
        body = body[5:].lstrip()
        if recursive:
            return f"WITH RECURSIVE {ctes},\n{body[10:].lstrip()}"
        return f"WITH {ctes},\n{body}"
    return f"WITH {ctes}\n{body}"
