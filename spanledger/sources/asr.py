"""Recogniser responses (verbose JSON) to speech segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions.speech import recognizer_language

RESPONSE = (
    "struct<text:string,language:string,segments:array<struct<text:string,start:double,end:double,"
    "avg_logprob:double,no_speech_prob:double>>>"
)


def parse_responses(responses: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Responses to ``(segments, response status)``.

    One bad segment refuses its whole response. ``responses`` keeps its other columns.
    """
    keys = [c for c in responses.columns if c != payload]
    body = responses.select(*keys, F.from_json(payload, RESPONSE).alias("r"))
    start_ms = lambda s: F.bround(s["start"] * 1000, 0).cast("bigint")
    end_ms = lambda s: F.bround(s["end"] * 1000, 0).cast("bigint")

    def is_bad(s):
        finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e300)
        good = (
            (F.length(F.trim(s["text"])) > 0) & finite(s["start"]) & finite(s["end"]) & finite(s["avg_logprob"])
            & finite(s["no_speech_prob"]) & (s["start"] >= 0) & (s["end"] > s["start"])
            & s["no_speech_prob"].between(0.0, 1.0) & (end_ms(s) > start_ms(s))
        )
        return ~F.coalesce(good, F.lit(False))

    segments = F.col("r.segments")
    has_text = F.length(F.trim("r.text")) > 0
    broken = (
        F.col("r.text").isNull() | F.col("r.language").isNull() | segments.isNull()
        | (has_text != (F.size(segments) > 0)) | F.exists(segments, is_bad)
    )
    code, warning = recognizer_language(F.col("r.language"))
    judged = body.withColumn("__bad", F.coalesce(broken, F.lit(True)))
    status = judged.select(*keys, F.when(F.col("__bad"), "INVALID_RESPONSE").otherwise("ACCEPTED").alias("status"),
                           code.alias("language"), warning.alias("warning"))
    rows = judged.where("NOT __bad").select(*keys, code.alias("language"), F.posexplode("r.segments").alias("pos", "s"))
    confidence = F.exp(F.least(F.lit(0.0), F.col("s.avg_logprob"))) * (1 - F.col("s.no_speech_prob"))
    parsed = rows.select(
        *keys, "pos", "language", start_ms(F.col("s")).alias("start_ms"), end_ms(F.col("s")).alias("end_ms"),
        F.trim("s.text").alias("text"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"),
    )
    return parsed, status
