"""Explicit schemas of the input tables and the option sets of the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Origins of facts, node states and statuses.
ORIGINS = ["given", "introduced", "derived", "answer"]
ROOT_ORIGINS = ["given", "introduced"]
PROVED_ORIGINS = ["derived", "answer"]
TERMINAL = ["success", "failed", "skipped"]

FACT = (
    "fact_id string, text string, parent_fact_ids array<string>, is_final_answer boolean, origin string, skip int"
)
GRAPH_DOCUMENT = (
    "problem_id: string, problem_text: string, facts: array<struct<fact_id: string, text: string,"
    " parent_fact_ids: array<string>, is_final_answer: boolean, origin: string, skip: int>>"
)
PAYLOAD = "struct<lean_code: string, lean_pass: boolean, lean_verify: boolean, error_msg: string, tries: int, skipped: boolean>"
STAGE_FACT = (
    "struct<fact_id: string, text: string, parent_fact_ids: array<string>, is_final_answer: boolean, origin: string,"
    f" skip: int, form_status: string, formalization: {PAYLOAD}, prove_status: string, solved_lemma: {PAYLOAD}>"
)
STAGE_RECORD = (
    "meta struct<schema_version: string, graph_mode: string, record_id: string, source_file: string, source_row_pos: bigint>,"
    " input struct<problem: string, raw_cot: string>,"
    f" graph struct<facts: array<{STAGE_FACT}>, topo_order: array<string>, final_fact_ids: array<string>>,"
    " execution struct<record_status: string>,"
    f" results struct<facts: array<{STAGE_FACT}>>,"
    f" runtime_facts map<string, {STAGE_FACT}>"
)
ROLLOUT = "id string, parent_id string, rollout_id int, source string, question string, response string, gold string"
STEP_SAMPLES = "step string, rollouts array<struct<reward: string, trace: string>>"


@dataclass(frozen=True)
class ValidationChecks:
    """Which graph rules count; the rest always do."""

    dependency_structure: bool = True
    origin_rules: bool = True
    introduced_without_parents: bool = True
    all_facts_reach_answer: bool = True


@dataclass(frozen=True)
class RewardWeights:
    """Default weights of the graph reward."""

    invalid_json_penalty: float = -1.0
    invalid_fdg_penalty: float = -0.6
    valid_json_bonus: float = 0.05
    validator_pass_bonus: float = 0.15
    formalizer_pass_weight: float = 0.4
    prover_pass_weight: float = 0.2
    final_answer_pass_weight: float = 0.2
    warning_penalty: float = 0.01
