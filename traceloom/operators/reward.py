"""Reward of candidate graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.json_text import extract_json_block, read_answer, searched_text
from traceloom.functions.rows import bind, settle
from traceloom.functions.text import quoted_repr, strip
from traceloom.operators.attempts import YES, attempt_kind
from traceloom.operators.graph import obligation, schema_issues, typed_facts, validate_graphs, with_cells
from traceloom.schemas import RewardWeights, ValidationChecks


def parse_candidates(candidates: DataFrame, answer: str = "model_output") -> DataFrame:
    """Add what the model's answer holds: ``valid_json``, ``schema_errors``, ``problem_text``, ``facts`` and ``num_raw_facts``.

    The answer is read to a VARIANT and checked field by field first; only a document without findings is cast to typed facts, so
    one mistyped field neither hides nor throws away the rest. The raw count is that of an object's list of facts. ``parse_error`` says
    what stood in the way of a value: no block at all, with the start of the text that was searched, or a block that is not JSON.
    """
    read = settle(candidates, _document=read_answer(F.col(answer)))
    document = F.col("_document")
    checked = settle(read, schema_errors=schema_issues(document))
    raw = F.size(F.try_variant_get(document, "$.facts", "array<variant>"))
    parsed = settle(
        checked,
        valid_json=document.isNotNull(),
        problem_text=F.try_variant_get(document, "$.problem_text", "string"),
        facts=typed_facts(F.when(F.size("schema_errors") == 0, document)),
        num_raw_facts=F.coalesce(F.greatest(raw, F.lit(0)), F.lit(0)),
        parse_error=F.when(document.isNull(), parse_error(F.col(answer))),
    )
    return parsed.select(*candidates.columns, "valid_json", "schema_errors", "problem_text", "facts", "num_raw_facts", "parse_error")


# Why an answer has no graph; {text} is the quoted start of the text.
NO_BLOCK = "No JSON block found. Text starts with: {text}"
NO_JSON = "The JSON block cannot be read."
START = 100


def parse_error(answer: Column) -> Column:
    """Why an answer that holds no JSON value holds none."""
    start = quoted_repr(F.left(searched_text(F.coalesce(answer, F.lit(""))), F.lit(START)))
    missing = F.concat(F.lit(NO_BLOCK.removesuffix("{text}")), start)
    return F.when(extract_json_block(answer).isNull(), missing).otherwise(F.lit(NO_JSON))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def score_graphs(
    graphs: DataFrame,
    weights: RewardWeights = RewardWeights(),
    checks: ValidationChecks = ValidationChecks(),
    formalized=lambda f: F.array_contains(F.col("formalized"), f["fact_id"]),
    verified=lambda f: F.array_contains(F.col("verified"), f["fact_id"]),
) -> DataFrame:
    """Reward parts of graphs with ``valid_json`` and ``facts``.

    Which facts are formalized and verified is told of each fact, by default by lists of ids in columns of these names. Everything
    about a graph is in its row, so the score needs no shuffle.
    """
    w = weights
    judged = validate_graphs(graphs, checks)
    listed = F.col("num_raw_facts") if "num_raw_facts" in graphs.columns else F.size("facts")
    bad_ids = F.array_distinct(F.filter(F.transform("errors", lambda e: strip(e["fact_id"])), lambda i: i.isNotNull() & (i != "")))
    scale = (
        F.when(listed <= 0, F.lit(1.0))
        .when(F.size(bad_ids) > 0, F.least(F.lit(1.0), F.size(bad_ids) / listed))
        .otherwise(F.when(F.size("errors") > 0, 1.0).otherwise(0.0))
    )
    structure = (
        F.when(~F.col("valid_json"), F.lit(w.invalid_json_penalty))
        .when(~F.col("passed"), F.lit(w.valid_json_bonus) + F.lit(w.invalid_fdg_penalty) * scale)
        .otherwise(F.lit(w.valid_json_bonus) + F.lit(w.validator_pass_bonus) - F.size("warnings") * F.lit(w.warning_penalty))
    )
    counted = F.col("valid_json") & F.col("passed")
    rooted = F.filter("facts", lambda f: F.size(f["parent_fact_ids"]) > 0)
    finals = F.filter("facts", lambda f: F.coalesce(f["is_final_answer"], F.lit(False)))
    among = lambda facts, holds: F.size(F.filter(facts, holds))
    when_counted = lambda c: F.when(counted, c).otherwise(0)
    staged = settle(
        judged,
        structure_score=structure,
        num_facts=F.when(F.col("valid_json"), listed).otherwise(0),
        num_warnings=F.when(F.col("valid_json"), F.size("warnings")).otherwise(0),
        num_non_root_facts=when_counted(F.size(rooted)),
        num_final_facts=when_counted(F.size(finals)),
        num_formalized=when_counted(among(rooted, formalized)),
        num_proved=when_counted(among(rooted, verified)),
        num_final_verified=when_counted(among(finals, verified)),
        validator_passed=counted,
    )
    scored = staged.withColumns(
        {
            "formalizer_score": w.formalizer_pass_weight * _share(F.col("num_formalized"), F.col("num_non_root_facts")),
            "prover_score": w.prover_pass_weight * _share(F.col("num_proved"), F.col("num_non_root_facts")),
            "final_answer_score": w.final_answer_pass_weight * _share(F.col("num_final_verified"), F.col("num_final_facts")),
            "length_penalty": F.lit(0.0),
        }
    )
    total = F.col("structure_score") + F.col("formalizer_score") + F.col("prover_score") + F.col("final_answer_score") - F.col("length_penalty")
    return scored.withColumn("score", total)


FORMALIZED = lambda f: YES(f["formalizer"]["success"])
VERIFIED = lambda f: YES(f["prover"]["verified"])


def stage_outcomes(log: DataFrame, stage: str, retries: int, key: str = "record_id") -> DataFrame:
    """Per fact what its attempts of one stage came to, as a struct named like the stage.

    ``log`` has (key, fact_id, attempt, lean_pass, lean_verify, token_overflow, api_error, output_truncated, no_code, lean_code,
    error_msg); attempts count from 1. The first passed attempt ends the stage, else the ``retries``-th; attempts beyond either were
    never made. Attempts of one number are replays of each other and count once. Until the end the stage is pending. Partial
    minima and maxima per fact, whatever the number and order of its attempts.
    """
    passed = (attempt_kind("formalize" if stage == "formalizer" else "prove") == "validated") & YES(F.col("lean_pass" if stage == "formalizer" else "lean_verify"))
    row = F.struct(
        F.col("attempt").cast("int").alias("attempts"), passed.alias("success"), (passed & YES(F.col("lean_verify"))).alias("verified"),
        F.coalesce("lean_code", F.lit("")).alias("lean_code"), F.coalesce("error_msg", F.lit("")).alias("error_message"),
    )
    won = F.min(F.when(passed, row))
    last = F.max(row)
    made = log.where(F.col("attempt").between(1, retries)).groupBy(key, "fact_id").agg(won.alias("_won"), last.alias("_last"))
    outcome = F.coalesce("_won", "_last")
    ended = F.col("_won").isNotNull() | (F.col("_last.attempts") >= retries)
    status = F.when(F.col("_won").isNotNull(), F.lit("success")).when(ended, F.lit("failed")).otherwise(F.lit("pending"))
    return made.select(key, "fact_id", outcome.withField("status", status).alias(stage))


def trace_facts(graphs: DataFrame, formalizer: DataFrame, prover: DataFrame, key: str = "record_id") -> DataFrame:
    """Put the outcomes of both stages into the facts of their graphs, with each fact's obligation.

    Facts without parents need no work and get no outcome; a fact is proved only after it is formalized. The outcomes are gathered by
    ``key``, which must tell graphs apart, and meet the graphs once, so these are worked out and moved once. Outcomes of unknown facts go
    nowhere.
    """
    proved = F.when(YES(F.col("formalizer.success")), F.col("prover"))
    entry = F.struct("fact_id", F.struct("formalizer", proved.alias("prover")))
    both = formalizer.join(prover, [key, "fact_id"], "full").where(F.col("fact_id").isNotNull() & F.col(key).isNotNull())
    listed = both.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("_found"))
    needs = lambda f: F.size(f["parent_fact_ids"]) > 0
    traced = lambda f, statement: bind(
        F.when(needs(f), F.try_element_at(F.col("_found"), f["fact_id"])),
        lambda o: F.struct(
            f["fact_id"].alias("fact_id"), f["text"].alias("text"), f["parent_fact_ids"].alias("parent_fact_ids"),
            f["is_final_answer"].alias("is_final_answer"), f["origin"].alias("origin"), f["skip"].alias("skip"),
            F.when(needs(f), statement).alias("proof_obligation"), o["formalizer"].alias("formalizer"), o["prover"].alias("prover"),
        ),
    )
    joined = settle(with_cells(graphs.join(listed, key, "left")), _told=F.transform("_f", lambda cell: obligation(cell)))
    return settle(joined, facts=F.zip_with("facts", "_told", traced)).drop("_f", "_ids", "_back", "_found", "_told")


def fact_done(fact: Column, include_prover: bool = True) -> Column:
    """Whether a fact with parents needs no further attempt."""
    form, prove = F.coalesce(fact["formalizer"]["status"], F.lit("pending")), F.coalesce(fact["prover"]["status"], F.lit("pending"))
    after = F.when(form == "success", prove != "pending") if include_prover else F.when(form == "success", F.lit(True))
    return (F.size(fact["parent_fact_ids"]) == 0) | F.coalesce(after, form == "failed")


def rewards_from_log(
    candidates: DataFrame,
    log: DataFrame,
    answer: str = "model_output",
    key: str = "record_id",
    form_retries: int = 3,
    prove_retries: int = 3,
    include_prover: bool = True,
    weights: RewardWeights = RewardWeights(),
    checks: ValidationChecks = ValidationChecks(),
) -> DataFrame:
    """Rewards of model answers with the trace of every fact, from the log of what was tried on their facts.

    ``log`` has the columns of ``stage_outcomes`` and ``stage``, formalizer or prover. An answer without a valid graph has no facts to
    work on: its attempts count for nothing and its list of facts is empty. ``done`` tells whether no fact waits for an attempt; the
    score of a graph that is not done is what it has so far.
    """
    parsed = parse_candidates(candidates, answer)
    form = stage_outcomes(log.where("stage = 'formalizer'"), "formalizer", form_retries, key)
    prove = stage_outcomes(log.where("stage = 'prover'" if include_prover else "false"), "prover", prove_retries, key)
    scored = score_graphs(trace_facts(parsed, form, prove, key), weights, checks, FORMALIZED, VERIFIED)
    traced = F.when(F.col("validator_passed"), F.col("facts")).otherwise(F.filter("facts", lambda f: F.lit(False)))
    done = ~F.col("validator_passed") | F.forall("facts", lambda f: fact_done(f, include_prover))
    return settle(scored, done=done, facts=traced).withColumn("parse_error", F.coalesce("parse_error", F.lit("")))


def evaluate_offline(scored: DataFrame) -> DataFrame:
    """Number of scored candidates and their mean score."""
    return scored.agg(F.count("*").alias("candidates"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))
