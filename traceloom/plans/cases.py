"""Case extraction: mine two or more runs and write the rollouts of each bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame

from traceloom.operators.datasets import pivot_rollouts
from traceloom.operators.evaluate import CASES_ANY, CASES_TWO, case_counts, mine_cases, select_case_rows, top_cases
from traceloom.session import cut_lineage
from traceloom.sources.sinks import write_manifest, write_rollouts


def extract_cases(
    views: dict[str, DataFrame], flat: DataFrame, correct: DataFrame | None, path: str, mode: str = "all-rollouts",
    limit: int = -1, buckets: list[str] | None = None,
) -> DataFrame:
    """Write flat and wide rollouts per bucket and for all, with a manifest; returns the case counts before any limit."""
    cases = cut_lineage(mine_cases(views))  # every write below starts from these rows
    names = buckets or CASES_ANY + (CASES_TWO if len(views) == 2 else [])
    kept = cases if limit < 0 else top_cases(cases, limit)
    kept = kept.where(kept["bucket"].isin(names))
    for name in ["all", *names]:
        some = kept if name == "all" else kept.where(kept["bucket"] == name)
        rows = select_case_rows(flat, some, correct, mode)
        write_rollouts(rows, f"{path}/{name}")
        pivot_rollouts(rows).write.mode("overwrite").json(f"{path}/{name}/rollout_raw.jsonl")
    counts = case_counts(cases)
    write_manifest(counts.groupBy().pivot("bucket", names).sum("cases"), f"{path}/manifest", mode=mode, limit=str(limit))
    return counts
