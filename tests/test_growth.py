"""Work that must not be repeated or sorted as tables grow."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanledger.operators import chapters, compose, graph, scan, segmentation
from spanledger.plans import timeline
from spanledger.streaming import evidence

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["i11_sparse_sentence_ends", "i14_dense_grid_snap"])
def test_sentences_are_cut_once(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "documents.parquet" not in plan
    assert "SortAggregate" not in plan


def test_connected_frames_bind_their_arrays_once(spark):
    rows = spark.createDataFrame(
        [(1, [1, 2, 3], [(1, 2), (3, 2)]), (2, [1, 2, 3], [(1, 2), (3, 9)]), (3, [], []), (4, [5, 5], []), (5, list(range(300)), [(i + 1, i) for i in range(299)])],
        "k int, nodes array<int>, edges array<struct<src:int,dst:int>>")
    connected = rows.select("k", compose.frames_connected(F.col("nodes"), F.col("edges")).alias("c"))
    assert dict(connected.collect()) == {1: True, 2: False, 3: True, 4: True, 5: True}
    plan = plan_of(QUERIES["t8_frame_connectivity"](spark, FOLDER)).splitlines()
    assert all(len(re.findall("flatten\\(transform", line)) <= 1 for line in plan)


@pytest.mark.parametrize("name, times", [("i18_base_segments_dense", 1), ("i20_near_target_groups", 0), ("i21_rule_chapters", 1)])
def test_texts_are_staged_once_at_most(spark, monkeypatch, name, times):
    staged = []
    for module in (timeline, segmentation, chapters, scan):
        monkeypatch.setattr(module, "checkpoint", lambda df, whole=module.checkpoint: staged.append(df.columns) or whole(df))
    QUERIES[name](spark, FOLDER)
    assert sum(len({"text", "first_text", "rows", "__title"} & set(columns)) for columns in staged) == times


def test_nodes_without_edges_take_no_part_in_rounds(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(graph, "checkpoint", lambda df, whole=graph.checkpoint: staged.append(whole(df)) or staged[-1])
    nodes = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 4)], "run_id int, node int")
    edges = spark.createDataFrame([(1, 3, 5), (1, 5, 7), (2, 4, 4)], "run_id int, a int, b int")
    got = {(r["run_id"], r["node"]): r["root"] for r in graph.components(edges, nodes, ["run_id"]).collect()}
    assert got == {(2, 4): 4} | {(1, i): 3 if i in (3, 5, 7) else i for i in range(10)}
    assert staged[-1].count() == 3


@pytest.mark.parametrize("states", [1, 3])
def test_keys_share_states_of_streams(spark, monkeypatch, tmp_path, states):
    """Leases of many jobs, also of none and without an end, over two micro-batches, from as many states as there may be."""
    monkeypatch.setattr(evidence, "STATES", states)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), i, rng.choice(["RUNNING", "RUNNING", "OTHER"]), rng.randrange(1, 400), rng.choice([None, 5, 30])) for i in range(600)]
    rows.append((-1, 600, "OTHER", 10_000, None))  # moves the watermark past all others
    schema, frame = "job_id bigint, event_id bigint, status string, at bigint, lasts bigint", None
    for k, part in enumerate((rows[::2][:-1], rows[1::2] + rows[-1:])):
        frame = spark.createDataFrame(part, schema).select("job_id", "event_id", "status", F.timestamp_seconds("at").alias("ts"), F.timestamp_seconds(F.col("at") + F.col("lasts")).alias("lease_expires_at"))
        frame.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    want = []
    for job in {r[0] for r in rows}:
        own = sorted((at, event, status, lasts) for j, event, status, at, lasts in rows if j == job)
        for (at, event, status, lasts), after in zip(own, [*own[1:], (9_000, 0)], strict=True):
            if status == "RUNNING" and lasts is not None and at + lasts <= after[0]:
                want.append((job, event, (at + lasts) * 1000))
    watched = evidence.expired_leases(stream, "1000 seconds")
    got = evidence.run_available(watched)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    calls = []

    class Handle:
        def registerTimer(self, at):
            calls.append("timer")

        def appendList(self, rows):
            calls.append(len(rows))

    watch = evidence.InOrder("ts_ms bigint, event_id bigint, lease_ms bigint", "event_id bigint, lease_ms bigint", ["job_id", "event_id", "expired_at_ms"], evidence._lease_row)
    watch.handle = watch.held = Handle()
    watch.handleInputRows((0,), iter([pd.DataFrame({"key": range(500), "ts_ms": 7, "event_id": range(500), "lease_ms": 9})]), None)
    assert calls == [1, "timer"]
