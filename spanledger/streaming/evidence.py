"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanledger.session import shared_folder
from spanledger.sources.media import ingest, name_verdict, sniff


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one Parquet file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a stream takes a plain path for a folder's; a pattern may match a file or a folder
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")


# Fixed value: the state store that list state and timers need, which also keeps large state out of the heap.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over everything available and return what it wrote.

    The batches go to a table in the shared folder under their batch number, so a
    repeated batch replaces itself; in complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        job = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write)
            .trigger(availableNow=True).start()
        )
        job.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
    out = spark.read.parquet(f"{base}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("batch"))
        out = out.join(last, "batch", "left_semi")
    return out.drop("batch")


def intake(objects: DataFrame, max_bytes: int, kind: str) -> DataFrame:
    """New objects with digest, detected type and verdict (batch and stream alike).

    Needs filename, declared_mime and content.
    """
    seen = ingest(objects, max_bytes).withColumn("detected_mime", sniff(F.col("header"), kind))
    named = name_verdict(F.col("filename"), F.col("declared_mime"), F.col("detected_mime"), kind)
    return seen.withColumn("verdict", F.when(F.col("status") == "ACCEPTED", named).otherwise(F.col("status"))).drop("header", "status")


def session_spans(spans: DataFrame, gap_ms: int, watermark: str = "1 hour") -> DataFrame:
    """Gap merge as session windows: a span keeps its session open for its length plus the gap."""
    at = F.timestamp_millis("start_ms")
    gap = F.concat(((F.col("end_ms") - F.col("start_ms") + gap_ms)).cast("string"), F.lit(" milliseconds"))
    return (
        spans.withColumn("ts", at).withWatermark("ts", watermark)
        .groupBy("run_id", F.session_window("ts", gap).alias("w"))
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_spans"))
        .drop("w")
    )


def tumbling_counts(spans: DataFrame, width: str = "600 seconds", watermark: str = "1 hour") -> DataFrame:
    at = F.timestamp_millis("start_ms")
    return (
        spans.withColumn("ts", at).withWatermark("ts", watermark).groupBy("run_id", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("run_id", F.unix_millis("w.start").alias("start_ms"), "n")
    )


def first_requests(requests: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Exact repeats of a request (scope, key, payload) let through once."""
    return requests.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["scope", "key", "payload"])


def flag_conflicts(requests: DataFrame) -> DataFrame:
    """NEW, REUSED or CONFLICT per request, run over everything available.

    The payload of a key is that of its earliest request (ts, request_id) in the first micro-batch that has the key; later
    batches are judged against it, whatever their timestamps. Payloads are aggregated and joined as
    columns, so a key of any size is no single task's work, and a batch that is repeated replaces what it wrote.
    """
    spark = requests.sparkSession
    base = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    stored_schema = f"scope {kinds['scope']}, key {kinds['key']}, payload {kinds['payload']}, request_id {kinds['request_id']}, batch int"

    def judge(batch: DataFrame, number: int) -> None:
        rows = batch.select("scope", "key", "payload", "request_id", "ts")
        first = rows.groupBy("scope", "key").agg(F.min_by(F.struct("payload", "request_id"), F.struct("ts", "request_id")).alias("f"))
        first = first.select("scope", "key", "f.payload", "f.request_id")
        same = lambda a, b: a["scope"].eqNullSafe(b["scope"]) & a["key"].eqNullSafe(b["key"])
        if number:
            stored = spark.read.schema(stored_schema).parquet(f"{base}/first").where(F.col("batch") < number).drop("batch")
            first = first.join(stored, same(first, stored), "left_anti")
        first.write.mode("overwrite").parquet(f"{base}/first/batch={number}")
        known = spark.read.schema(stored_schema).parquet(f"{base}/first").where(F.col("batch") <= number)
        judged = rows.join(known, same(rows, known)).select(rows["request_id"], F.when(
            (known["batch"] == number) & (known["request_id"] == rows["request_id"]), "NEW").when(known["payload"].eqNullSafe(rows["payload"]), "REUSED").otherwise("CONFLICT").alias("outcome"))
        judged.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    job = requests.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(judge).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(f"request_id {kinds['request_id']}, outcome string").parquet(f"{base}/out").drop("batch")


# Fixed value: states over which the keys are dealt. Calls to the state store cost milliseconds, so they must not grow with the keys.
STATES = 1024


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their event time, whatever micro-batch brings them.

    Rows wait in a list state until the watermark has passed them; a timer at the earliest one wakes them. What is then ripe is sorted and goes
    key by key through ``fold``, whose state is one row; ``due`` says when a key must wake though no row is waiting. Only the rows within the watermark's delay are held.
    Keys are dealt to ``STATES`` states. An entry of a list state holds the rows of one Arrow batch, and a value state the folds of its keys, as an array per column.
    """

    def __init__(self, row: str, state: str, output: list[str], fold: Callable, due: Callable | None = None) -> None:
        self.output, self.fold, self.due = output, fold, due
        self.row, self.held_schema = self._columns(f"key bigint, {row}")
        self.state_schema = self._columns(f"key bigint, {state}")[1]

    @staticmethod
    def _columns(schema: str) -> tuple[list[tuple[str, str]], str]:
        fields = [tuple(field.split()) for field in schema.split(",")]
        return fields, ", ".join(f"{name} array<{kind}>" for name, kind in fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.folds = handle.getValueState("folds", self.state_schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [tuple(self._values(frame[name], kind) for name, kind in self.row) for frame in rows if len(frame)]
        if waiting:
            self.held.appendList(waiting)
            self.handle.registerTimer(min(min(columns[1]) for columns in waiting) + 1)
        return iter(())

    @staticmethod
    def _values(column: pd.Series, kind: str) -> list:
        whole = kind == "bigint" and column.dtype.kind == "f"  # pandas makes floats of whole numbers beside nulls
        return [None if v != v else int(v) if whole else v for v in column.tolist()]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = [row for columns in self.held.get() for row in zip(*columns, strict=True)]
        ripe = sorted((row for row in waiting if row[1] < watermark), key=lambda row: row[1:3])
        later = [row for row in waiting if row[1] >= watermark]
        before = self.folds.get()
        before = {} if before is None else {row[0]: row[1:] for row in zip(*before, strict=True)}
        states, out, wakes = dict(before), [], [row[1] + 1 for row in later]
        for name, *row in ripe:
            state, made = self.fold(states.get(name), row)
            states[name] = state
            out += [(name, *m) for m in made]
        for name, state in states.items() if self.due else ():
            if state is not None:
                wake, states[name], made = self.due(state, watermark)
                out += [(name, *m) for m in made]
                wakes += [] if wake is None else [wake]
        if ripe:
            self.held.put([self._packed(later)]) if later else self.held.clear()
        kept = {name: state for name, state in states.items() if state is not None}
        if kept != before:
            self.folds.update(self._packed([(name, *state) for name, state in kept.items()])) if kept else self.folds.clear()
        if wakes:
            self.handle.registerTimer(min(wakes))
        if out:
            yield pd.DataFrame(out, columns=self.output)

    @staticmethod
    def _packed(rows: list[tuple]) -> tuple:
        return tuple(map(list, zip(*rows, strict=True)))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, watch: InOrder, output: str) -> DataFrame:
    """The rows (``key`` and those of ``watch``) through ``watch``; keys that are null are a key of their own."""
    state = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(STATES)))
    return rows.withColumn("state", state).withColumnRenamed(key, "key").groupBy("state").transformWithStateInPandas(watch, output, "Append", "EventTime")


def _lease_row(state: tuple | None, row: tuple) -> tuple:
    """A RUNNING row opens its lease; any later row ends the open one, which had run out if it was not longer."""
    at, event, lease = row
    made = [(state[0], state[1])] if state and state[1] <= at else []
    return (None if lease is None or lease < 0 else (event, lease)), made


def _lease_due(state: tuple, watermark: int) -> tuple:
    event, lease = state
    return (None, None, [(event, lease)]) if lease < watermark else (lease + 1, state, [])


def expired_leases(log: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """A row for each lease that ran out before the job's next event or the watermark.

    Events are taken in order of (ts, event_id) across micro-batches, as far as the watermark's delay allows for late ones.
    """
    rows = log.withWatermark("ts", watermark).select(
        "job_id", "event_id", "ts", F.unix_millis("ts").alias("ts_ms"), F.when(F.col("status") == "RUNNING", F.unix_millis("lease_expires_at")).otherwise(-1).alias("lease_ms"))
    watch = InOrder("ts_ms bigint, event_id bigint, lease_ms bigint", "event_id bigint, lease_ms bigint", ["job_id", "event_id", "expired_at_ms"], _lease_row, _lease_due)
    return in_order(rows, "job_id", watch, "job_id bigint, event_id bigint, expired_at_ms bigint")


def _kept_row(state: tuple | None, row: tuple) -> tuple:
    start, evidence, end, text, confidence = row
    slot, last_end, last_text, last = state or (-1, None, None, None)
    repeat = last_end == start and last_text == text
    if repeat and confidence <= last:
        return state, []
    slot += not repeat
    return (slot, end, text, confidence), [(slot, evidence, start, end)]


def ordered_dedup(segments: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Adjacent-duplicate removal over late and split input: the upsert log of :func:`incremental_dedup`, by start time.

    Segments wait until the watermark on their start has passed them, so the log is that of the batch operator whatever micro-batches the rows come in, as
    long as none is later than ``watermark``. A row far ahead in time (of any run) closes a finished stream.
    """
    # the first watermark is 0 and what is not above it counts as late
    rows = segments.withColumn("ts", F.timestamp_millis(F.col("start_ms") + 1)).withWatermark("ts", watermark)
    keep = InOrder(
        "start_ms bigint, evidence_id string, end_ms bigint, text string, confidence double",
        "slot bigint, end_ms bigint, text string, confidence double", ["run_id", "slot", "evidence_id", "start_ms", "end_ms"], _kept_row)
    return in_order(rows, "run_id", keep, "run_id bigint, slot bigint, evidence_id string, start_ms bigint, end_ms bigint")


def incremental_dedup(segments: DataFrame) -> DataFrame:
    """Adjacent-duplicate removal across micro-batches whose rows of a run come in time order; see :func:`ordered_dedup` for any order.

    Emits an upsert log (run_id, slot, ...): the last row of a slot is the kept one. The
    state of a run is its last kept row, whatever the run's size.
    """
    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot, end, text, confidence = state.get if state.exists else (-1, None, None, None)
        out = []
        for row in pd.concat(list(batches)).sort_values(["start_ms", "end_ms", "evidence_id"]).itertuples():
            repeat = end == row.start_ms and text == row.text
            if repeat and row.confidence <= confidence:
                continue
            slot += 0 if repeat else 1
            end, text, confidence = row.end_ms, row.text, row.confidence
            out.append((key[0], slot, row.evidence_id, row.start_ms, row.end_ms))
        state.update((int(slot), int(end), text, float(confidence)))
        yield pd.DataFrame(out, columns=["run_id", "slot", "evidence_id", "start_ms", "end_ms"])

    return segments.groupBy("run_id").applyInPandasWithState(
        keep, "run_id bigint, slot bigint, evidence_id string, start_ms bigint, end_ms bigint",
        "slot bigint, end_ms bigint, text string, confidence double", "append", GroupStateTimeout.NoTimeout)


def settle_slots(log: DataFrame) -> DataFrame:
    """Current rows of the upsert log."""
    last = log.groupBy("run_id", "slot").agg(F.max(F.struct("start_ms", "end_ms", "evidence_id")).alias("r"))
    return last.select("run_id", "r.evidence_id", "r.start_ms", "r.end_ms")
