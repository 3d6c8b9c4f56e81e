"""Readers: trace tables with provenance, stage records, checkpoints, run statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.functions.coerce import known_experiment_name, parse_experiment_name
from traceloom.functions.text import is_blank, strip
from traceloom.operators.routing import require_columns, require_none
from traceloom.schemas import STAGE_FACT, STAGE_RECORD, STEP_SAMPLES

# The fields a run's statistics file must have.
RATIO_SCOPE = "exclude_skipped_derived"
RATIO_FIELDS = ["global_prove_verified_nodes_ratio", "global_form_verified_nodes_ratio"]


def read_traces(
    spark: SparkSession, path: str, glob: str = "*.parquet", id_col: str = "id", question_col: str = "question",
    response_col: str = "response", answer_col: str | None = None, limit: int = -1,
) -> DataFrame:
    """Trace shards with the shard, relative to ``path``, and row each trace came from; ``limit`` takes the first in that order.

    A shard is a file, or a folder of parts as Spark writes a table: its rows count on from part to part, in the order of their names.
    """
    raw = spark.read.parquet(f"{path.rstrip('/')}/{glob}")
    require_columns(raw, [id_col, question_col, response_col] + ([answer_col] if answer_col else []))
    below = F.substring_index("_metadata.file_path", path.rstrip("/") + "/", -1)
    rows = raw.select(
        F.col(id_col).cast("string").alias("record_id"),
        F.col(question_col).cast("string").alias("problem"),
        F.col(response_col).cast("string").alias("raw_cot"),
        (F.col(answer_col).cast("string") if answer_col else F.lit("")).alias("reference_answer"),
        F.substring_index(below, "/", 1).alias("source_file"),
        F.col("_metadata.row_index").alias("source_row_pos"),
        below.alias("_part"),
    )
    if any("/" in f.rsplit(path.rstrip("/") + "/", 1)[-1] for f in raw.inputFiles()):
        before = Window.partitionBy("source_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        held = rows.groupBy("source_file", "_part").agg((F.max("source_row_pos") + 1).alias("_rows"))
        starts = held.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))  # one row a part
        rows = rows.join(F.broadcast(starts), "_part").withColumn("source_row_pos", F.col("_before") + F.col("source_row_pos")).drop("_before")
    rows = rows.drop("_part")
    return rows.orderBy("source_file", "source_row_pos").limit(limit) if limit >= 0 else rows


def read_bench(spark: SparkSession, path: str, columns: dict[str, str], schema: str | None = None) -> DataFrame:
    """Benchmark rows from Parquet or JSON lines; JSON needs its schema stated."""
    from traceloom.operators.datasets import normalize_bench

    if path.endswith((".json", ".jsonl")):
        if schema is None:
            raise ValueError("reading JSON lines needs a schema")
        return normalize_bench(spark.read.schema(schema).json(path), columns)
    return normalize_bench(spark.read.parquet(path), columns)


def read_stage_records(spark: SparkSession, path: str, schema: str = STAGE_RECORD, strict: bool = True) -> DataFrame:
    """Stage records from JSON lines; blank lines are ignored. Strict looks through the lines first and makes bad ones an error that
    names file and line, else they are left out."""
    if strict:
        require_readable(spark, path, schema)
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL").drop("_bad")


NAMED_LINES = 5  # places that an error message gives


def bad_lines(spark: SparkSession, path: str, schema: str = STAGE_RECORD, parts: bool = False) -> DataFrame:
    """(source_file, line, value) of the lines that are no record of the schema; lines count from 1, blank ones too.

    Files may be cut over tasks anywhere: each task numbers the lines of its parts of files in order, the lines of each part are counted,
    and a part's first line is what the parts before it hold. One row a part goes through these sums, never a file. With ``parts`` the
    files are parts of one text, as Spark writes it, and lines count on over them in the order of their names.
    """
    part = ["source_file", "_start"]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")
    )
    counts = lines.groupBy(*part).agg(F.count("*").alias("_lines"), F.min("_id").alias("_first"))
    whole = Window.orderBy(F.length("source_file"), "source_file", "_start") if parts else Window.partitionBy("source_file").orderBy("_start")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = lines.where(~is_blank(F.col("value"))).withColumn("_read", read).where("_read IS NULL OR _read._bad IS NOT NULL")
    return bad.join(offsets, part).select("source_file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def require_readable(spark: SparkSession, path: str, schema: str = STAGE_RECORD) -> None:
    """An error that names the first bad lines, if there are any."""
    found = bad_lines(spark, path, schema).orderBy("source_file", "line").limit(NAMED_LINES).select("source_file", "line").collect()
    if found:
        raise ValueError("lines that cannot be read: " + ", ".join(f"{r.source_file}:{r.line}" for r in found))


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Unreadable lines per file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    bad = lines.where(~is_blank(F.col("value")) & F.try_parse_json("value").isNull())
    return bad.groupBy("source_file").agg(F.count("*").alias("corrupt_lines"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Training-step samples; steps, rewards and traces stay raw text until they are judged."""
    return spark.read.schema(STEP_SAMPLES).json(path)


def explode_samples(records: DataFrame, fields: list[str]) -> DataFrame:
    """One row per rollout of step records, with the named trace fields as VARIANT, which keeps their JSON type.

    ``trace_state`` is ok, missing (no trace) or invalid (a rollout or trace that is no object); a record without rollouts keeps one
    row of state none.
    """
    rows = records.select("step", F.posexplode_outer("rollouts").alias("rollout_idx", "_r"))
    kind = F.schema_of_variant(F.try_parse_json("_r.trace"))
    state = (
        F.when(F.col("rollout_idx").isNull(), "none")
        .when(F.col("_r").isNull(), "invalid")
        .when(F.col("_r.trace").isNull() | (kind == "VOID"), "missing")
        .when(kind.startswith("OBJECT"), "ok")
        .otherwise("invalid")
    )
    parsed = F.when(state == "ok", F.try_parse_json("_r.trace"))
    traces = [F.try_variant_get(parsed, f"$.{f}", "variant").alias(f) for f in fields]
    return rows.select("step", "rollout_idx", "_r.reward", *traces, state.alias("trace_state"))


def final_over_checkpoints(final: DataFrame, checkpoints: DataFrame, final_order: Column, checkpoint_order: Column) -> DataFrame:
    """Finished records together with checkpoints of unfinished ones.

    The last finished row of an id wins over all checkpoints, then the first checkpoint; a checkpoint without an
    id is named after its file. Facts of a checkpoint are the values of its map.
    """
    own_id = lambda c: strip(F.coalesce(c, F.lit("")))
    facts_type = f"array<{STAGE_FACT}>"
    done = final.select(
        own_id(F.col("meta.record_id")).alias("record_id"), F.col("results.facts").cast(facts_type).alias("facts"),
        F.lit(False).alias("is_checkpoint"), final_order.alias("_order"),
    ).where("record_id <> ''")
    named = F.when(is_blank(F.col("meta.record_id")), F.regexp_replace("source_file", r"\.json$", "")).otherwise(own_id(F.col("meta.record_id")))
    open_ = checkpoints.select(
        named.alias("record_id"), F.map_values("runtime_facts").cast(facts_type).alias("facts"), F.lit(True).alias("is_checkpoint"), checkpoint_order.alias("_order")
    )
    row = F.struct("facts", "is_checkpoint")
    last_done = done.groupBy("record_id").agg(F.max_by(row, "_order").alias("_row"))
    first_open = open_.join(last_done, "record_id", "left_anti").groupBy("record_id").agg(F.min_by(row, "_order").alias("_row"))
    return last_done.unionByName(first_open).select("record_id", "_row.*")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint records, one per JSON file, with the file they are from."""
    return spark.read.schema(STAGE_RECORD).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("source_file"))


def read_experiment_stats(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Global ratios of every run folder under ``root``; strict makes an unknown name or a missing field an error."""
    fields = ", ".join(f"{f}: double" for f in RATIO_FIELDS)
    raw = spark.read.schema(f"{RATIO_SCOPE} struct<{fields}>").option("multiLine", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "stage3_verify_stats.json"
    ).json(root)
    name = F.regexp_extract("_metadata.file_path", r"/(step_proof_[^/]+)/", 1)
    rows = raw.select(name.alias("experiment"), *[F.col(f"{RATIO_SCOPE}.{f}").alias(f) for f in RATIO_FIELDS])
    return experiment_ratios(rows, strict)


def experiment_ratios(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Run names to context and model, with the two ratios; discarded and unknown names drop out."""
    if strict:
        require_none(rows.where(~known_experiment_name(F.col("experiment"))).select("experiment"), "unknown run names")
        lacking = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in RATIO_FIELDS])
        require_none(rows.where(lacking).select("experiment"), "runs without all ratios")
    read = rows.dropna(subset=RATIO_FIELDS).withColumn("_p", parse_experiment_name(F.col("experiment")))
    return read.where(F.col("_p.ctx").isNotNull()).select("experiment", "_p.ctx", "_p.model", *RATIO_FIELDS)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root``: the run folder they are in, their path below it and their size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    return files.select(F.substring_index(below, "/", 1).alias("experiment"), F.regexp_replace(below, "^[^/]*/", "").alias("file"), "length")


def run_folders(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders right below ``root``, empty ones included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found if f.isDirectory())
    return spark.createDataFrame([(n,) for n in names], "experiment string")


def experiment_status(files: DataFrame, required: list[str], folders: DataFrame | None = None) -> DataFrame:
    """Per run the required files, by their path below the run folder, that are missing or empty; complete when there are none.

    ``folders`` names all runs, so that those without any file have a row too.
    """
    present = F.collect_set(F.when((F.col("length") > 0) & F.col("file").isin(required), F.col("file")))
    status = files.groupBy("experiment").agg(present.alias("_have"))
    if folders is not None:
        status = folders.select("experiment").distinct().join(status, "experiment", "left")
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("_have", F.array().cast("array<string>")))
    return status.select("experiment", missing.alias("missing"), (F.size(missing) == 0).alias("complete"))
