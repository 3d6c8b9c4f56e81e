"""Streaming forms: node status, reward spread and exactly-once resume over append-only logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from traceloom.functions.bins import fixed_bin
from traceloom.functions.coerce import to_float, to_step
from traceloom.functions.exact import exact_mean, exact_std_pop
from traceloom.operators.attempts import NODE, attempt_kind, attempt_status
from traceloom.sources.sinks import is_written


def stream_status(
    attempts: DataFrame, retries: int, stage: str = "formalize", rule: str = "gt", arrived: str | None = None, retention: str = "7 days"
) -> DataFrame:
    """Tries and status of each node by its highest attempt, updated as attempts arrive; repeated and late attempts change nothing.

    State is one row a node. With ``arrived``, a column of arrival times, nodes are kept per window of ``retention`` (column
    ``seen``) and their state ends one ``retention`` after the window: attempts of a node must arrive within it. Without, the
    state lives as long as the query, which suits a log that is worked through once.
    """
    passed = F.col("lean_pass" if stage == "formalize" else "lean_verify")
    judged = attempts.withColumn("_status", attempt_status(attempt_kind(stage), F.col("attempt"), passed, retries, rule))
    keys: list = list(NODE)
    if arrived is not None:
        judged = judged.withWatermark(arrived, retention)
        keys.append(F.window(arrived, retention).alias("seen"))
    return judged.groupBy(*keys).agg(F.max("attempt").cast("int").alias("tries"), F.max_by("_status", "attempt").alias("status"))


class LastAttempt(StatefulProcessor):
    """The highest attempt of a node and its status, until no attempt has come for a time-to-live of event time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "tries int, status string, expires bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        before = self.last.get() if self.last.exists() else None
        tries, status, expires = before or (None, None, 0)
        was = tries, expires
        for part in rows:
            for attempt, verdict, seen in zip(part["attempt"].tolist(), part["status"].tolist(), part["seen_ms"].tolist(), strict=True):
                if tries is None or (attempt, verdict) > (tries, status):
                    tries, status = attempt, verdict
                expires = max(expires, seen + self.ttl_ms)
        if was[1] and was[1] != expires:
            self.handle.deleteTimer(was[1])
        if was[1] != expires:
            self.handle.registerTimer(expires)
        self.last.update((tries, status, expires))
        if before is None or before[:2] != (tries, status):
            yield pd.DataFrame({"record_id": [key[0]], "fact_id": [key[1]], "tries": [tries], "status": [status]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_state_in_rocksdb(spark) -> None:
    """The state store that processors with maps, timers and times-to-live need; set before their query first starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_status_ttl(attempts: DataFrame, retries: int, arrived: str, ttl_seconds: int, stage: str = "formalize", rule: str = "gt", late: str = "0 seconds") -> DataFrame:
    """Tries and status of each node as ``stream_status`` has them, one row a node however long its attempts go on (update mode).

    State is one small row a node. It ends when the watermark of ``arrived`` (less ``late``) passes the node's last attempt by
    ``ttl_seconds``; an attempt after that begins anew. Rows without an arrival time are left out.
    """
    passed = F.col("lean_pass" if stage == "formalize" else "lean_verify")
    status = attempt_status(attempt_kind(stage), F.col("attempt"), passed, retries, rule)
    rows = attempts.where(F.col(arrived).isNotNull()).withWatermark(arrived, late)
    judged = rows.select(*NODE, F.col("attempt").cast("int"), status.alias("status"), F.unix_millis(arrived).alias("seen_ms"), arrived)
    return judged.groupBy(*NODE).transformWithStateInPandas(
        LastAttempt(1000 * ttl_seconds), "record_id string, fact_id string, tries int, status string", "Update", "EventTime"
    )


SUCCESS, FAILED = 1, 2


class CountDown(StatefulProcessor):
    """The open facts of a record; its row goes out once, when the last of them is done.

    The state of a record is one value, read and written once a batch: a call to the state store costs more than a fact. ``facts`` is the
    JSON of what is known of each fact: its id, whether it is listed, and what its stages came to.
    """

    def __init__(self, include_prover: bool, ttl_ms: int | None):
        self.include_prover, self.ttl_ms = include_prover, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "known boolean, open int, facts int, told boolean, expires bigint, stages string")

    def ended(self, form: int, prove: int) -> bool:
        return form == FAILED or (form == SUCCESS and (not self.include_prover or prove > 0))

    def handleInputRows(self, key, rows, timerValues):
        import json

        import pandas as pd

        known, left, facts, told, expires, stages = self.record.get() or (False, 0, 0, False, 0, "[]")
        was, held = expires, {fact: kept for fact, *kept in json.loads(stages)}
        for part in rows:
            if self.ttl_ms is not None:
                expires = max(expires, int(part["seen_ms"].max()) + self.ttl_ms)
            if told:
                continue
            for needed, fact_id, stage, verdict in zip(*(part[c].tolist() for c in ("needed", "fact_id", "stage", "verdict")), strict=True):
                if needed is not None and not known:
                    known, facts = True, len(needed)
                    for one in needed:
                        _, form, prove = held.get(one, (False, 0, 0))
                        held[one] = True, form, prove
                        left += not self.ended(form, prove)
                elif needed is None:
                    listed, form, prove = held.get(fact_id, (False, 0, 0))
                    before = self.ended(form, prove)
                    code = SUCCESS if verdict == "success" else FAILED
                    if stage == "formalizer":
                        form = form if form == SUCCESS else code
                    else:
                        prove = prove if prove == SUCCESS else code
                    held[fact_id] = listed, form, prove
                    left += listed * (before - self.ended(form, prove))
        if known and not left and not told:
            told = True
            held = {}
            yield pd.DataFrame({"record_id": [key[0]], "facts": [facts]})
        if was != expires:
            if was:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(expires)
        self.record.update((known, left, facts, told, expires, json.dumps([(fact, *kept) for fact, kept in held.items()])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.record.clear()
        return iter(())

    def close(self) -> None:
        pass


def countdown_events(graphs: DataFrame, log: DataFrame, form_retries: int = 3, prove_retries: int = 3, arrived: str | None = None) -> DataFrame:
    """What the count-down needs of a stream of graphs (record_id, facts) and of the log of attempts: which facts need work, and the
    attempts that end a stage, by success or as the last one. All others are left out before they reach any state. ``arrived`` is a column
    of arrival times of both."""
    seen = [arrived] if arrived else []
    working = F.filter("facts", lambda f: F.size(f["parent_fact_ids"]) > 0)
    needed = graphs.select("record_id", *seen, F.array_distinct(F.transform(working, lambda f: f["fact_id"])).alias("needed"))
    form = F.col("stage") == "formalizer"
    kind = F.when(form, attempt_kind("formalize")).otherwise(attempt_kind("prove"))
    passed = (kind == "validated") & F.coalesce(F.when(form, F.col("lean_pass")).otherwise(F.col("lean_verify")), F.lit(False))
    limit = F.when(form, form_retries).otherwise(prove_retries)
    verdict = F.when(passed, F.lit("success")).when(F.col("attempt") == limit, F.lit("failed"))
    ends = log.where(F.col("attempt").between(1, limit)).select("record_id", *seen, "fact_id", "stage", verdict.alias("verdict")).where("verdict IS NOT NULL")
    return needed.unionByName(ends, allowMissingColumns=True)


def stream_countdown(events: DataFrame, include_prover: bool = True, arrived: str | None = None, ttl_seconds: int = 7 * 86400, late: str = "0 seconds") -> DataFrame:
    """(record_id, facts) of each record once, when all its facts that need work are done; ``events`` are those of ``countdown_events``.

    A fact is done when formalizing has failed, or has passed and proving has ended. Attempts may come before their graph, in any order
    and repeatedly; a later success outweighs a failure unless the record is out by then. The state of a record is one row, which
    names its facts until it is out. With ``arrived``, a column of arrival times, it ends ``ttl_seconds`` after the record's last event; without, it stays.
    """
    schema, keys = "record_id string, facts int", ["record_id"]
    if arrived is None:
        return events.groupBy(*keys).transformWithStateInPandas(CountDown(include_prover, None), schema, "Append", "None")
    timed = events.withWatermark(arrived, late).withColumn("seen_ms", F.unix_millis(arrived))
    return timed.groupBy(*keys).transformWithStateInPandas(CountDown(include_prover, 1000 * ttl_seconds), schema, "Append", "EventTime")


def stream_reward(samples: DataFrame, field: str = "reward") -> DataFrame:
    """Running reward spread per step (update mode)."""
    raw = F.col(field).cast("string")
    value = to_float(raw)
    rows = samples.select(to_step(F.col("step").cast("string")).alias("step"), raw.alias("_raw"), value.alias("_x"))
    return rows.where("step IS NOT NULL").groupBy("step").agg(
        F.count("_x").alias("n"),
        F.coalesce(exact_mean(F.col("_x")), F.lit(0.0)).alias("mean"),
        F.coalesce(exact_std_pop(F.col("_x")), F.lit(0.0)).alias("std_pop"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
        F.count_if(F.col("_raw").isNull()).alias("missing"),
        F.count_if(F.col("_raw").isNotNull() & F.col("_x").isNull()).alias("invalid"),
    )


def stream_reward_histogram(samples: DataFrame, lo: float = -1.0, hi: float = 1.0, width: float = 0.05, field: str = "reward") -> DataFrame:
    """Running histogram per step and bin (update mode)."""
    rows = samples.select(
        to_step(F.col("step").cast("string")).alias("step"), fixed_bin(to_float(F.col(field).cast("string")), lo, hi, width).alias("bin")
    )
    return rows.where("step IS NOT NULL AND bin IS NOT NULL").groupBy("step", "bin").agg(F.count("*").alias("rewards"))


def stream_resume(records: DataFrame, done: DataFrame, key: str = "record_id", arrived: str | None = None, retention: str = "7 days") -> DataFrame:
    """Each unfinished record once: finished ids are joined away, repeats are dropped by state.

    With ``arrived``, a column of arrival times, an id is remembered for ``retention`` only, so the state is bounded by what arrives
    in that time; a repeat that comes later than that is expected to be in ``done`` by then. Without, every id is remembered.
    """
    unfinished = records.join(done.select(key).distinct(), key, "left_anti")
    if arrived is None:
        return unfinished.dropDuplicates([key])
    return unfinished.withWatermark(arrived, retention).dropDuplicatesWithinWatermark([key])


def run_resume(records: DataFrame, read_done: Callable[[], DataFrame], path: str, checkpoint: str, key: str = "record_id", arrived: str | None = None, retention: str = "7 days") -> None:
    """Put out each record that is unfinished when its batch runs, once, in a folder per batch.

    ``read_done`` is called for every batch, so what was finished since the last one stays in. Repeats are dropped by state, as in
    ``stream_resume``. A batch that was written whole before is left as it is when it is run again, whatever is done by then.
    """
    once = records.dropDuplicates([key]) if arrived is None else records.withWatermark(arrived, retention).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{path}/batch={number}"
        if is_written(batch.sparkSession, folder):
            batch.write.format("noop").mode("overwrite").save()  # the state of repeats goes on
        else:
            batch.join(read_done().select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(folder)

    query = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work through what is there and stop; file sinks make each batch count once."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Update-mode streams to files: one folder per batch, rewritten whole when a batch is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_updates(spark, path: str, keys: list[str]) -> DataFrame:
    """Last update of every key of what ``run_updates`` wrote."""
    rows = spark.read.option("basePath", path).parquet(path)
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("_row")).select(*keys, "_row.*")
