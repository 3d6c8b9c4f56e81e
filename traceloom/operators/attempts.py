"""State of nodes as a fold over their attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.chat import MESSAGES
from traceloom.functions.coerce import coerce_skip
from traceloom.operators.graph import obligation, with_cells
from traceloom.functions.text import strip

YES = lambda c: F.coalesce(c, F.lit(False))
NODE = ["record_id", "fact_id"]


def attempt_kind(stage: str = "formalize") -> Column:
    """What came of one attempt; only formalising can end in an API error."""
    kind = F.when(YES(F.col("token_overflow")), F.lit("token_overflow"))
    if stage == "formalize":
        kind = kind.when(YES(F.col("api_error")), F.lit("api_error"))
    return (
        kind.when(YES(F.col("output_truncated")), F.lit("output_truncated"))
        .when(YES(F.col("no_code")), F.lit("extract_error"))
        .otherwise(F.lit("validated"))
    )


def attempt_status(kind: Column, attempt: Column, passed: Column, retries: int, rule: str = "gt") -> Column:
    """Status after an attempt: ``gt`` gives up past ``retries`` attempts, ``ge`` at that many."""
    spent = attempt > retries if rule == "gt" else attempt >= retries
    return (
        F.when((kind == "validated") & YES(passed), F.lit("success"))
        .when((kind == "token_overflow") | spent, F.lit("failed"))
        .otherwise(F.lit("pending"))
    )


def fold_status(attempts: DataFrame, retries: int, stage: str = "formalize", rule: str = "gt") -> DataFrame:
    """Status of each node after its last attempt, by partial maxima."""
    passed = F.col("lean_pass" if stage == "formalize" else "lean_verify")
    status = attempt_status(attempt_kind(stage), F.col("attempt"), passed, retries, rule)
    return attempts.groupBy(*NODE).agg(
        F.max("attempt").alias("tries"), F.max_by(status, "attempt").alias("status"), F.max_by(attempt_kind(stage), "attempt").alias("kind")
    )


def last_attempts(attempts: DataFrame, payload: list[str], with_history: bool = False) -> DataFrame:
    """Last attempt of each node; ``history`` lists the earlier ones.

    Attempts of the same number are replays of one and count once, the last of them in payload order.
    """
    rows = F.struct("attempt", *payload)
    if with_history:
        attempts = attempts.groupBy(*NODE, "attempt").agg(F.max(F.struct(*payload)).alias("_payload")).select(*NODE, "attempt", "_payload.*")
    wanted = [F.max_by(rows, "attempt").alias("_last")]
    if with_history:
        wanted.append(F.array_sort(F.collect_list(rows)).alias("_all"))
    last = attempts.groupBy(*NODE).agg(*wanted)
    if with_history:
        earlier = F.filter("_all", lambda r: r["attempt"] < F.col("_last.attempt"))
        return last.select(*NODE, "_last.*", earlier.alias("history"))
    return last.select(*NODE, "_last.*")


def seed_formalize(records: DataFrame) -> DataFrame:
    """First state of each fact: pending with its obligation where it counts, else skipped as passed."""
    counts = lambda f: coerce_skip(f["skip"]) == 0
    rows = F.zip_with(
        "facts",
        "_f",
        lambda f, cell: F.struct(
            cell["id"].alias("fact_id"),
            coerce_skip(f["skip"]).alias("skip"),
            F.when(counts(f), F.lit("pending")).otherwise(F.lit("skipped")).alias("form_status"),
            F.when(counts(f), obligation(cell)).alias("statement"),
            (~counts(f)).alias("lean_pass"),
            (~counts(f)).alias("skipped"),
        ),
    )
    return with_cells(records).select("record_id", F.inline(rows))


def seed_prove(nodes: DataFrame) -> DataFrame:
    from traceloom.operators.routing import prove_ready

    status = prove_ready()
    return nodes.select(*NODE, status.alias("prove_status"), (status == "skipped").alias("skipped"))


def recover(nodes: DataFrame, stage: str = "form") -> DataFrame:
    """Statuses after a crash: running goes back to pending, nodes that do not count are skipped."""
    status = F.when(F.col(f"{stage}_status") == "running", F.lit("pending")).otherwise(F.col(f"{stage}_status"))
    counts = coerce_skip(F.col("skip")) == 0
    if stage == "prove":
        counts = counts & YES(F.col("form_lean_pass")) & (F.coalesce(F.col("form_code"), F.lit("")) != "")
    return nodes.withColumn(f"{stage}_status", F.when(counts, status).otherwise(F.lit("skipped")))


# Feedback to the next attempt, by stage and case; {error} is filled in.
FEEDBACK = {
    "formalize": {
        "overflow": "The previous response hit a token limit. Regenerate the full Lean4 formalization.",
        "no_code": "The previous response was invalid because: {error}\nPlease regenerate valid Lean4 code.",
        "checked": "The previous Lean4 code did not compile.\nLean errors: {error}\nPlease regenerate corrected Lean4 code.",
    },
    "prove": {
        "overflow": "The previous response hit a token limit. Regenerate the complete Lean4 proof.",
        "no_code": "The previous response was invalid because: {error}\nPlease regenerate valid Lean4 proof code.",
        "checked": "The previous Lean4 proof did not verify.\nLean feedback: {error}\nPlease regenerate a corrected proof.",
    },
}
RETRY_SUFFIX = {
    "formalize": "\n\nBased on the error, please correct the previous response. ",
    "prove": "\n\n Based on these errors, please correct the previous response. ",
}
RETRY_PREFIX = {"formalize": "Lean error: ", "prove": "Lean error/warnings: "}


def feedback_message(stage: str, error: Column, code: Column) -> Column:
    texts = FEEDBACK[stage]
    fill = lambda text: F.replace(F.lit(text), F.lit("{error}"), F.coalesce(error, F.lit("")))
    return (
        F.when(error == "token_overflow", F.lit(texts["overflow"]))
        .when(F.coalesce(code, F.lit("")) == "", fill(texts["no_code"]))
        .otherwise(fill(texts["checked"]))
    )


def retry_turn(stage: str, kind: Column, error: Column) -> Column:
    """User turn after a failed attempt in the batch stages."""
    lead = F.when(kind == "validated", F.lit(RETRY_PREFIX[stage])).otherwise(F.lit("Error: "))
    return F.concat(lead, F.coalesce(error, F.lit("")), F.lit(RETRY_SUFFIX[stage]))


def rebuild_conversation(base: Column, history: Column) -> Column:
    """Base messages and one user turn per earlier attempt, from (lean_code, error_msg) entries."""
    turns = F.transform(
        history,
        lambda h: F.struct(
            F.lit("user").alias("role"),
            F.concat(
                F.when(strip(F.coalesce(h["lean_code"], F.lit(""))) != "", F.lit("Lean error/warnings: ")).otherwise(F.lit("Error: ")),
                F.coalesce(h["error_msg"], F.lit("")),
                F.lit(RETRY_SUFFIX["prove"]),
            ).alias("content"),
        ),
    )
    return F.concat(base.cast(MESSAGES), turns.cast(MESSAGES))


def retry_outcome(targets: DataFrame, attempts: DataFrame, max_retries: int) -> DataFrame:
    """Outcome of the prover retries: bucket is the index of the first verified attempt, or failed.

    ``attempt`` counts from 0; attempts after the first verified one or past the limit were never made.
    """
    made = attempts.where(F.col("attempt") <= max_retries).groupBy(*NODE).agg(
        F.min(F.when(YES(F.col("lean_verify")), F.col("attempt"))).alias("_won"), F.max("attempt").alias("_last")
    )
    joined = targets.select(*NODE).distinct().join(made, NODE, "left")
    return joined.select(
        *NODE,
        F.col("_won").isNotNull().alias("success"),
        F.coalesce(F.col("_won").cast("string"), F.lit("failed")).alias("success_bucket"),
        F.coalesce(F.coalesce("_won", "_last") + 1, F.lit(0)).alias("attempt_count"),
    )


NOT_FOUND = "fact not found"  # fixed value: the error of a target that its record does not hold


def retry_payloads(targets: DataFrame, attempts: DataFrame, max_retries: int) -> DataFrame:
    """(record_id, fact_id, success, success_bucket, attempt_count, final_lean_result, attempts, error) of each target.

    ``attempts`` has (record_id, fact_id, attempt from 0, candidate_lean_code, lean_pass, lean_verify, error_msg). Those after the first
    verified one or past the limit were never made, replays of one number count once. The final result is that of the last attempt made.
    A target whose column ``found`` is false has no attempts and says so; without the column all are taken to be found. A node's list
    holds at most ``max_retries`` + 1 attempts, whatever its log holds.
    """
    found = F.coalesce(F.col("found"), F.lit(False)) if "found" in targets.columns else F.lit(True)
    parts = ["candidate_lean_code", "lean_pass", "lean_verify", "error_msg"]
    once = attempts.where(F.col("attempt").between(0, max_retries)).groupBy(*NODE, "attempt").agg(F.max(F.struct(*parts)).alias("_p"))
    made = once.groupBy(*NODE).agg(
        F.array_sort(F.collect_list(F.struct(F.col("attempt").cast("int").alias("attempt_index"), "_p.*"))).alias("_all"), F.min(F.when(YES(F.col("_p.lean_verify")), F.col("attempt"))).alias("_won")
    )
    listed = F.when(found, F.filter("_all", lambda a: F.col("_won").isNull() | (a["attempt_index"] <= F.col("_won"))))
    joined = targets.select(*NODE, found.alias("_found")).distinct().withColumnRenamed("_found", "found").join(made, NODE, "left")
    settled = joined.select(*NODE, "found", (F.col("found") & F.col("_won").isNotNull()).alias("success"), "_won", listed.alias("attempts"))
    last = F.get("attempts", F.size("attempts") - 1)
    final = F.struct(YES(last["lean_pass"]).alias("lean_pass"), YES(last["lean_verify"]).alias("lean_verify"), F.coalesce(last["error_msg"], F.lit("")).alias("error_msg"))
    return settled.select(
        *NODE,
        "success",
        F.when(F.col("success"), F.col("_won").cast("string")).otherwise(F.lit("failed")).alias("success_bucket"),
        F.coalesce(F.size("attempts"), F.lit(0)).alias("attempt_count"),
        F.when(F.col("found"), final).alias("final_lean_result"),
        F.coalesce("attempts", F.array().cast(settled.schema["attempts"].dataType)).alias("attempts"),
        F.when(F.col("found"), F.lit("")).otherwise(F.lit(NOT_FOUND)).alias("error"),
    )


def upsert_retry(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Stage records with the retry results put onto their facts, each in its place in ``results.facts``.

    A fact with a result gets ``prove_failure_retry``; if it succeeded, also the status and the proof of the first verified attempt, in
    place of what it had. Of facts that share an id the first is meant. Records are not taken apart: a record meets the list of its
    own results, and only that list is gathered. Results of unknown facts or records go nowhere.
    """
    won = F.get(F.filter("attempts", lambda a: YES(a["lean_verify"])), F.lit(0))
    told = F.struct("success", "success_bucket", "attempt_count", "final_lean_result")
    results = payloads.groupBy("record_id").agg(F.collect_list(F.struct("fact_id", told.alias("told"), won.alias("won"))).alias("_results"))
    own = results.select(F.col("record_id").alias("_of"), "_results")
    joined = records.join(own, strip(F.col("meta.record_id")) == F.col("_of"), "left")
    facts = F.col("results.facts")
    ids = F.transform(facts, lambda f: f["fact_id"])

    def put(f: Column, at: Column) -> Column:
        mine = F.get(F.filter("_results", lambda r: (r["fact_id"] == f["fact_id"]) & (F.array_position(ids, f["fact_id"]) == at + 1)), F.lit(0))

        def change(r: Column) -> Column:
            success = YES(r["told"]["success"])
            proof = F.struct(
                r["won"]["candidate_lean_code"].alias("lean_code"), F.lit(True).alias("lean_pass"), F.lit(True).alias("lean_verify"),
                r["won"]["error_msg"].alias("error_msg"), r["told"]["attempt_count"].alias("tries"), F.lit(False).alias("skipped"),
            )
            return (
                f.withField("prove_status", F.when(success, F.lit("success")).otherwise(f["prove_status"]))
                .withField("solved_lemma", F.when(success, proof).otherwise(f["solved_lemma"]))
                .withField("prove_failure_retry", r["told"])
            )

        return F.get(F.transform(F.array(mine), change), F.lit(0))

    return joined.withColumn("results", F.col("results").withField("facts", F.transform(facts, put))).drop("_of", "_results")


def apply_retry(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Put retry results onto their nodes: always the outcome, and on success the proof as well."""
    joined = nodes.join(outcomes.select(*NODE, "success", "success_bucket", "attempt_count"), NODE, "left")
    won = YES(F.col("success"))
    return joined.withColumns(
        {
            "prove_status": F.when(won, F.lit("success")).otherwise(F.col("prove_status")),
            "lean_pass": won | F.col("lean_pass"),
            "lean_verify": won | F.col("lean_verify"),
            "prove_skipped": ~won & F.col("prove_skipped"),
        }
    )


def graph_done(nodes: DataFrame, root: Column, done: Column) -> DataFrame:
    """Whether all facts of a graph that need work are done."""
    return nodes.groupBy("record_id").agg(F.coalesce(F.every(F.when(~root, done)), F.lit(True)).alias("done"))


def join_traces(prove: DataFrame, formal: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Prove rows with the last formal row of their node, and how many have none."""
    last = formal.groupBy(*NODE).agg(F.max_by(F.struct(*[c for c in formal.columns if c not in NODE]), order).alias("formal"))
    unmatched = prove.join(last, NODE, "left_anti").agg(F.count("*").alias("unmatched"))
    return prove.join(last, NODE), unmatched


def reuse_stage(requested: DataFrame, previous: DataFrame, order: Column) -> DataFrame:
    """First earlier row of each requested id, in requested order (``position``)."""
    rest = [c for c in previous.columns if c != "record_id"]
    first = previous.join(requested, "record_id", "left_semi").groupBy("record_id").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return requested.select("record_id", "position").join(first, "record_id").select("record_id", "position", "_row.*")


def export_subset(df: DataFrame, ids: DataFrame, key: str = "record_id", require_all: bool = True) -> DataFrame:
    """Rows with listed ids and the position of their id; a listed id without a row is an error."""
    from traceloom.operators.routing import require_none

    if require_all:
        require_none(ids.select(key).join(df.select(key), key, "left_anti"), "ids without a row")
    return df.join(ids.select(key, "position"), key)
