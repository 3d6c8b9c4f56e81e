"""Writers: rollouts, training records, manifests and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rollouts(flat: DataFrame, path: str, skipped: DataFrame | None = None) -> None:
    """Flat rollouts as Parquet and as JSON lines, with the rejected rows beside them.

    The input is worked out once: the JSON lines are made from the Parquet files.
    """
    flat.write.mode("overwrite").parquet(f"{path}/rollouts.parquet")
    written = flat.sparkSession.read.schema(flat.schema).parquet(f"{path}/rollouts.parquet")
    written.write.mode("overwrite").json(f"{path}/rollouts.jsonl")
    if skipped is not None:
        skipped.write.mode("overwrite").json(f"{path}/skipped.jsonl")


def write_training(rows: DataFrame, path: str) -> None:
    """Nested training records, one folder per split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_routed(rows: DataFrame, path: str) -> None:
    """Outcome-routed rows, one folder per outcome."""
    rows.write.mode("overwrite").partitionBy("outcome").json(path)


def write_manifest(summary: DataFrame, path: str, **parameters: str) -> None:
    """One JSON row of counts and parameters; ``summary`` holds a single row."""
    stamped = summary.withColumns({name: F.lit(value) for name, value in parameters.items()})
    stamped.coalesce(1).write.mode("overwrite").json(path)


MAX_COLUMNS = 1000


def column_values(df: DataFrame, column: str, most: int = MAX_COLUMNS) -> list:
    """The sorted distinct values of a column that become columns; more than ``most`` of them are an error."""
    found = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column} would become columns; name those wanted")
    return sorted(found)


def wide_metrics(metrics: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Metrics as rows, sources as sorted columns, the value over all sources last. Sources not given are read, at most MAX_COLUMNS."""
    if sources is None:
        sources = column_values(metrics.where("source <> 'avg' AND source <> ''"), "source")
    return metrics.groupBy("metric").pivot("source", [*sources, "avg"]).agg(F.first("value"))


def write_metrics_csv(metrics: DataFrame, path: str, sources: list[str] | None = None) -> None:
    wide_metrics(metrics, sources).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def is_written(spark, path: str) -> bool:
    """Whether a folder was written whole: Spark's writers leave their mark last."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
