"""Views derived from the given tables, as Spark jobs and as comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions.timing import epoch_ms
from spanledger.operators import generate
from spanledger.operators.scan import Scan, ordered_scan

EPOCH_2024_MS = 1_704_067_200_000
AS_OF = "2024-01-20 00:00:00"


def v_transcript(t) -> DataFrame:
    """One run per conversation: 150 ms per character, 500 ms between turns."""
    turns = t.conversations.where(F.length("text") > 0).select(
        F.col("conv_id").alias("run_id"),
        F.concat(F.lit("ev_"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("evidence_id"),
        F.col("turn").alias("seq"),
        "role",
        "text",
        ((F.col("turn") % 10) / 10.0).cast("double").alias("confidence"),
        (F.length("text") * 150).cast("bigint").alias("dur"),
    ).withColumn("step", F.col("dur") + 500)
    placed = ordered_scan(
        turns, ["run_id"], ["seq"], F.floor(F.col("seq") / 64), [Scan("before", "sum_before", "step")]
    )
    start = F.coalesce("before", F.lit(0)).cast("bigint")
    return placed.select(
        "run_id", "evidence_id", "seq", "role", "text", "confidence",
        start.alias("start_ms"), (start + F.col("dur")).alias("end_ms"),
    )


def v_runs(t) -> DataFrame:
    return t.v_transcript.groupBy("run_id").agg((F.max("end_ms") + 1000).alias("duration_ms"))


def v_sentences(t) -> DataFrame:
    """One run per document, one row per sentence; offsets are folded inside the row."""
    parts = F.split("text", r"\. ")
    length_ms = lambda s: (F.least(F.length(s), F.lit(1900)) * 60).cast("bigint")
    offsets = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("bigint").alias("next"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, s: F.struct(
            (acc["next"] + length_ms(s) + 250).alias("next"),
            F.concat(acc["starts"], F.array(acc["next"])).alias("starts"),
        ),
    )["starts"]
    placed = t.documents.select("doc_id", "lang", F.posexplode(F.arrays_zip(
        parts.alias("text"), offsets.alias("start_ms"))))
    return placed.select(
        F.col("doc_id").alias("run_id"),
        F.concat(F.lit("st_"), F.col("doc_id"), F.lit("_"), F.col("pos") + 1).alias("evidence_id"),
        (F.col("pos") + 1).cast("bigint").alias("seq"),
        "lang",
        F.col("col.text").alias("text"),
        F.col("col.start_ms").alias("start_ms"),
        (F.col("col.start_ms") + length_ms(F.col("col.text"))).alias("end_ms"),
    ).where(F.length("text") > 0)


def v_sentence_runs(t) -> DataFrame:
    return t.v_sentences.groupBy("run_id").agg((F.max("end_ms") + 1000).alias("duration_ms"))


def v_spans(t) -> DataFrame:
    start = epoch_ms(F.col("ts")) - EPOCH_2024_MS
    length = F.greatest(F.round(F.col("value") * 100).cast("bigint") * 600, F.lit(1).cast("bigint"))
    return t.events.select(
        F.col("user_id").alias("run_id"), "event_id", start.alias("start_ms"),
        (start + length).alias("end_ms"), (F.col("value") / 500.0).alias("confidence"), "event_type",
    )


def v_jobs(t) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "RUNNING")
        .when(F.col("event_type") == "click", "RETRY_WAIT")
        .when(F.col("event_type") == "purchase", "SUCCEEDED").otherwise("FAILED")
    )
    ts = F.col("ts").cast("timestamp")
    return t.events.select(
        F.col("user_id").alias("job_id"), "event_id", ts.alias("ts"), status.alias("status"),
        (ts + F.expr("INTERVAL 1 HOUR")).alias("lease_expires_at"), "value",
    )


def v_pairs(t) -> DataFrame:
    """Every turn with a predecessor: previous turn as reference, this one as hypothesis."""
    turns = t.conversations
    previous = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    lang = t.documents.select(F.col("doc_id").alias("conv_id"), "lang")
    return (
        turns.select("conv_id", "turn", F.col("text").alias("hypothesis"))
        .join(previous, ["conv_id", "turn"])
        .join(lang, "conv_id", "left")
        .select(F.col("conv_id").alias("run_id"), "turn",
                F.coalesce("lang", F.lit("und")).alias("lang"), "reference", "hypothesis")
    )


def v_facts(t) -> DataFrame:
    return t.lineitem.groupBy(
        F.col("l_orderkey").alias("sample_id"), F.col("l_suppkey").alias("fact_id")
    ).agg(
        F.max(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).cast("bigint").alias("supported"),
        F.max(F.when(F.col("l_quantity") >= 25, 1).otherwise(0)).cast("bigint").alias("is_key"),
    )


def v_windows(t) -> DataFrame:
    """Chapters for the closure rules: 300 s slices of each run."""
    return generate.fixed_windows(t.v_runs, "run_id", "duration_ms", 300_000)


SPARK_VIEWS = {
    f.__name__: f
    for f in (v_transcript, v_runs, v_sentences, v_sentence_runs, v_spans, v_jobs, v_pairs, v_facts, v_windows)
}

SQL_NEEDS = {
    "v_runs": ("v_transcript",),
    "v_sentence_runs": ("v_sentences",),
    "v_windows": ("v_runs",),
    "v_sentences": ("v_sentence_rows",),
}

SQL_VIEWS = {
    "v_transcript": """
SELECT conv_id AS run_id, 'ev_' || conv_id || '_' || turn AS evidence_id, turn AS seq, role, text,
       CAST((turn % 10) / 10.0 AS DOUBLE) AS confidence,
       CAST(coalesce(sum(dur + 500) OVER w, 0) AS BIGINT) AS start_ms,
       CAST(coalesce(sum(dur + 500) OVER w, 0) + dur AS BIGINT) AS end_ms
FROM (SELECT *, CAST(length(text) * 150 AS BIGINT) AS dur FROM conversations WHERE length(text) > 0)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "v_runs": "SELECT run_id, max(end_ms) + 1000 AS duration_ms FROM v_transcript GROUP BY run_id",
    "v_sentence_rows": """
SELECT doc_id, lang, CAST(generate_subscripts(a, 1) AS BIGINT) AS seq, unnest(a) AS text
FROM (SELECT doc_id, lang, string_split(text, '. ') AS a FROM documents)""",
    "v_sentences": """
SELECT run_id, evidence_id, seq, lang, text, start_ms, start_ms + dur AS end_ms FROM (
SELECT doc_id AS run_id, 'st_' || doc_id || '_' || seq AS evidence_id, seq, lang, text, dur,
       CAST(coalesce(sum(dur + 250) OVER w, 0) AS BIGINT) AS start_ms
FROM (SELECT *, CAST(least(length(text), 1900) * 60 AS BIGINT) AS dur FROM v_sentence_rows)
WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
) WHERE length(text) > 0""",
    "v_sentence_runs": "SELECT run_id, max(end_ms) + 1000 AS duration_ms FROM v_sentences GROUP BY run_id",
    "v_spans": f"""
SELECT user_id AS run_id, event_id, epoch_us(ts) // 1000 - {EPOCH_2024_MS} AS start_ms,
       epoch_us(ts) // 1000 - {EPOCH_2024_MS} + greatest(CAST(round(value * 100) AS BIGINT) * 600, 1) AS end_ms,
       value / 500.0 AS confidence, event_type FROM events""",
    "v_jobs": """
SELECT user_id AS job_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RETRY_WAIT'
                       WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
       ts + INTERVAL '1' HOUR AS lease_expires_at, value FROM events""",
    "v_pairs": """
SELECT b.conv_id AS run_id, b.turn, coalesce(d.lang, 'und') AS lang, a.text AS reference, b.text AS hypothesis
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
LEFT JOIN documents d ON d.doc_id = b.conv_id""",
    "v_facts": """
SELECT l_orderkey AS sample_id, l_suppkey AS fact_id,
       CAST(max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS supported,
       CAST(max(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS is_key
FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "v_windows": """
SELECT run_id, k AS chunk_index, k * 300000 AS start_ms, least(duration_ms, (k + 1) * 300000) AS end_ms
FROM (SELECT run_id, duration_ms, unnest(range(0, (duration_ms + 299999) // 300000)) AS k FROM v_runs)""",
}


# Fixed value: every non-ASCII letter of the given tables. The comparison engine measures edit
# distance in bytes, so its side maps each letter one to one onto an unused single byte.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
LOWER_LETTERS = "äçèéêíñóöü"


def sql_norm(column: str) -> str:
    """Comparison form of ``normalize_text``."""
    return rf"trim(regexp_replace(replace(lower({column}), 'ß', 'ss'), '\s+', ' ', 'g'))"


def sql_bytes_lower(expression: str) -> str:
    return f"translate({expression}, '{LOWER_LETTERS}', '{'ABCDEFGHIJKLMNOP'[:len(LOWER_LETTERS)]}')"


def sql_bytes_any(expression: str) -> str:
    free = [i for i in range(1, 32) if i not in (9, 10, 13)][: len(LETTERS)]
    return f"translate({expression}, '{LETTERS}', {' || '.join(f'chr({i})' for i in free)})"
