"""Folds and generators that a user brings along, packaged so that they run in parts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Fold:
    """An aggregate in three steps: ``update(state, row)`` within a task, ``merge(state, state)`` across tasks, ``finish(state)`` per key.

    States are dictionaries of ``state_schema``, results of ``result_schema``; ``merge`` must not depend on the order of its parts.
    """

    state_schema: str
    result_schema: str
    zero: Callable[[], dict]
    update: Callable[[dict, dict], dict]
    merge: Callable[[dict, dict], dict]
    finish: Callable[[dict], dict]


def fold_by_key(rows: DataFrame, keys: list[str], fold: Fold, held: int = 50_000) -> DataFrame:
    """One result per key. Every task folds its own rows and hands on one state per key it met, at most ``held`` at a time, so a
    key with a third of all rows reaches the merging task as one small state per task."""
    kept = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    key_fields = kept.schema.fields[: len(keys)]
    schema = StructType([*key_fields, *StructType.fromDDL(fold.state_schema).fields])
    arrow = to_arrow_schema(schema)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, dict] = {}

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | state for key, state in states.items()], arrow)

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                states[key] = fold.update(states.get(key) or fold.zero(), row)
            if len(states) > held:
                yield given()
                states.clear()
        yield given()

    result = StructType([*key_fields, *StructType.fromDDL(fold.result_schema).fields])
    made = to_arrow_schema(result)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            done = []
            for part in batch.to_pylist():
                this = tuple(part[k] for k in keys)
                if total is None or not _same(this, key):
                    done += [] if total is None else [dict(zip(keys, key, strict=True)) | fold.finish(total)]
                    key, total = this, part
                else:
                    total = fold.merge(total, part)
            yield pa.RecordBatch.from_pylist(done, made)
        if total is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | fold.finish(total)], made)

    # states come sorted and are merged as they stream by, with one state held, so that a key costs no call of its own
    return kept.mapInArrow(partial, schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, result)


def _same(left: tuple, right: tuple) -> bool:
    """Equal keys as in Spark's grouping: null equals null, and not-a-number itself."""
    return all(a == b or (a != a and b != b) for a, b in zip(left, right, strict=True))


def longest_texts(n: int) -> Fold:
    """Rows, characters and the ``n`` longest texts (ties by text)."""
    best = lambda texts: sorted(texts, key=lambda t: (-len(t), t))[:n]
    return Fold(
        "rows bigint, chars bigint, texts array<string>", "rows bigint, chars bigint, longest array<string>", lambda: {"rows": 0, "chars": 0, "texts": []},
        lambda s, r: s if r["text"] is None else {"rows": s["rows"] + 1, "chars": s["chars"] + len(r["text"]), "texts": best([*s["texts"], r["text"]])},
        lambda a, b: {"rows": a["rows"] + b["rows"], "chars": a["chars"] + b["chars"], "texts": best([*a["texts"], *b["texts"]])},
        lambda s: {"rows": s["rows"], "chars": s["chars"], "longest": list(s["texts"])})


@udtf(returnType="run_id bigint, from_ref string, to_ref string, pause_ms bigint, turned boolean")
class Pauses:
    """Table function over evidence in time order: a row for every pause between two rows of a run, and whether the speaker changes.

    The state of a partition is its last row; ``TABLE(...) PARTITION BY run_id ORDER BY start_ms`` hands rows over one by one.
    """

    def __init__(self) -> None:
        self.last = None

    def eval(self, row) -> Iterator[tuple]:
        last, self.last = self.last, (row["evidence_id"], row["end_ms"], row["role"])
        if last and row["start_ms"] > last[1]:
            yield row["run_id"], last[0], row["evidence_id"], row["start_ms"] - last[1], last[2] != row["role"]


def pauses(spark: SparkSession, evidence: DataFrame) -> DataFrame:
    """``Pauses`` registered and called on a table."""
    spark.udtf.register("evidence_pauses", Pauses)
    return spark.sql("SELECT * FROM evidence_pauses(TABLE(SELECT run_id, evidence_id, role, start_ms, end_ms FROM {rows}) PARTITION BY run_id ORDER BY (start_ms, evidence_id))", rows=evidence)
