"""Folds in parts and stateful streams against plain loops."""

import random
import tempfile

from pyspark.sql import functions as F

from spanledger.operators import folds
from spanledger.streaming import evidence as st


def test_a_fold_in_parts_equals_one_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, "a", "bb", "ccc", "dd", "é"]) or None) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "run_id bigint, text string").repartition(7)
    got = {r.run_id: (r.rows, r.chars, r.longest) for r in folds.fold_by_key(frame, ["run_id"], folds.longest_texts(2), held=1).collect()}
    for key in (1, 2, None):
        texts = [t for k, t in rows if k == key and t is not None]
        assert got[key] == (len(texts), sum(map(len, texts)), sorted(texts, key=lambda t: (-len(t), t))[:2])
    assert folds.fold_by_key(frame.limit(0), ["run_id"], folds.longest_texts(2)).count() == 0


def test_late_and_split_input_gives_the_batch_log(spark):
    rng = random.Random(5)
    schema = "run_id bigint, evidence_id string, text string, confidence double, start_ms bigint, end_ms bigint"
    rows = [(run, f"{i:04d}", rng.choice("xy"), rng.choice([0.1, 0.5, 0.9]), i * 100, i * 100 + 100) for run in (1, 2) for i in range(60)]
    want = {}
    for run in (1, 2):
        log, last = [], None
        for r in sorted(r for r in rows if r[0] == run):
            if last and last[5] == r[4] and last[2] == r[2]:
                if r[3] <= last[3]:
                    continue
                log[-1] = r[1]
            else:
                log.append(r[1])
            last = r
        want[run] = log
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    # every file holds rows up to two seconds out of order, and a far row closes the stream
    mixed = sorted(rows, key=lambda r: r[4] + rng.randrange(2000))
    for i in range(0, len(mixed), 30):
        spark.createDataFrame(mixed[i : i + 30], schema).coalesce(1).write.parquet(f"{folder}/in{i:04d}")
    spark.createDataFrame([(-1, "", "", 0.0, 10_000_000, 10_000_001)], schema).coalesce(1).write.parquet(f"{folder}/in9999")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")
    kept = st.settle_slots(st.run_available(st.ordered_dedup(stream, "10 seconds"))).where("run_id > 0").orderBy("run_id", "start_ms").collect()
    assert {run: [r.evidence_id for r in kept if r.run_id == run] for run in (1, 2)} == want


def test_leases_across_micro_batches(spark):
    schema = "job_id bigint, event_id bigint, status string, ts timestamp, lease_expires_at timestamp"
    at = lambda s: f"timestamp_seconds({1_700_000_000 + s})"
    events = [(1, 1, "RUNNING", 0, 50), (1, 2, "OTHER", 60, 0), (2, 3, "RUNNING", 5, 500), (2, 4, "OTHER", 70, 0), (1, 5, "RUNNING", 80, 90), (3, 6, "OTHER", 1000, 0), (3, 7, "OTHER", 2000, 0)]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, part in enumerate((events[1:4], [events[0]], events[4:6], events[6:])):  # the first event comes after its successor
        rows = [f"SELECT {j} AS job_id, {e} AS event_id, '{s}' AS status, {at(t)} AS ts, {at(x)} AS lease_expires_at" for j, e, s, t, x in part]
        spark.sql(" UNION ALL ".join(rows)).select(F.col("job_id").cast("bigint"), F.col("event_id").cast("bigint"), "status", "ts", "lease_expires_at").coalesce(1).write.parquet(f"{folder}/in{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")
    got = st.run_available(st.expired_leases(stream, "100 seconds")).collect()
    assert sorted((r.job_id, r.event_id) for r in got) == [(1, 1), (1, 5)]
