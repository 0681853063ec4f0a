"""Text error counts, set scores, thresholds and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from spanledger.functions.text import nfkc, normalize_text

# Metric limits and directions.
THRESHOLDS = [
    ("zh_cer", 0.15, "max"), ("ja_cer", 0.20, "max"), ("ko_cer", 0.20, "max"), ("en_wer", 0.18, "max"), ("es_wer", 0.18, "max"),
    ("visual_text_accuracy", 0.90, "min"), ("visual_key_field_recall", 0.90, "min"), ("semantic_boundary_f1", 0.75, "min"),
    ("fact_support_rate", 0.95, "min"), ("key_fact_recall", 0.85, "min"), ("unknown_evidence_count", 0.0, "max"),
    ("fabricated_name_count", 0.0, "max"), ("schema_time_valid_rate", 1.0, "min"), ("rtf", 3.0, "max"),
]
LANGUAGES = ["zh", "en", "ja", "ko", "es"]
CHARACTER_LANGUAGES = ["zh", "ja", "ko"]
METRIC_OF_LANGUAGE = {"zh": "zh_cer", "ja": "ja_cer", "ko": "ko_cer", "en": "en_wer", "es": "es_wer"}


# Cells of the table up to which the built-in distance is the faster one, and errors that the first band of a long text allows.
SMALL_TABLE = 65_536
BAND = 512


def _places(text: str) -> dict[str, int]:
    """Bits of the places of every character."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}


def _distance_within(long: str, short: str, places: dict[str, int], most: int) -> int | None:
    """Edit distance if it is ``most`` at the most, from the diagonals of the table that far from the main one; columns are bit vectors that move along."""
    width = 2 * most + 2
    mask, diagonal, level = (1 << width) - 1, 1 << (width - 1), width - 2
    up, down, found = (mask << (width - most - 1)) & mask, 0, most
    for i, character in enumerate(short):
        equal, start = places.get(character, 0), most + 1 - width + i
        equal = (equal << -start if start < 0 else equal >> start) & mask
        straight = ((((equal & up) + up) ^ up) | equal | down) & mask
        rise, fall = (down | ~(straight | up)) & mask, straight & up
        if i < len(long) - most:
            found += not straight & diagonal
        else:
            found += (rise >> level & 1) - (fall >> level & 1)
            level -= 1
        straight >>= 1
        up, down = (fall | ~(straight | rise)) & mask, straight & rise
    return found if found <= most else None


def bit_distance(left: str, right: str) -> int:
    """Edit distance by bit vectors (Myers, Hyyro): a column of the table is a pair of whole numbers, so that a character costs a few operations on words.

    Long texts try bands that grow by four, so that the work follows length times distance where they are alike.
    """
    long, short = (left, right) if len(left) >= len(right) else (right, left)
    places, most = _places(long), BAND
    while 8 * most <= len(short):
        if len(long) - len(short) <= most and (found := _distance_within(long, short, places, most)) is not None:
            return found
        most *= 4
    full = (1 << len(long)) - 1
    up, down = full, 0
    for character in short:
        equal = places.get(character, 0)
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = (down | ~(across | up)) << 1 | 1, (up & across) << 1
        equal |= down
        up, down = (fall | ~(equal | rise)) & full, rise & equal & full
    return len(short) + up.bit_count() - down.bit_count()


@F.pandas_udf(LongType())
def _bit_distances(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else bit_distance(a, b) for a, b in zip(left, right, strict=True)], dtype="Int64")


def edit_distance(left: Column, right: Column) -> Column:
    """Exact edit distance of texts of any length: small tables are filled by the built-in function, others by bit vectors."""
    small = F.length(left).cast("bigint") * F.length(right) <= SMALL_TABLE
    return F.when(small, F.levenshtein(left, right).cast("bigint")).otherwise(_bit_distances(F.when(~small, left), F.when(~small, right)))


def character_counts(hypothesis: Column, reference: Column) -> tuple[Column, Column]:
    """Edit errors and reference length on normalised text without spaces."""
    bare = lambda text: F.replace(normalize_text(text), F.lit(" "), F.lit(""))
    ref = bare(reference)
    return edit_distance(bare(hypothesis), ref), F.length(ref).cast("bigint")


def exact_character_counts(hypothesis: Column, reference: Column) -> tuple[Column, Column]:
    """Edit errors with case and spaces kept (only NFKC applied)."""
    ref = nfkc(reference)
    return edit_distance(nfkc(hypothesis), ref), F.length(ref).cast("bigint")


def token_distance(left: list[str], right: list[str]) -> int:
    """Unit-cost edit distance of two token lists, one vector per token."""
    codes = {token: i for i, token in enumerate(dict.fromkeys([*left, *right]))}
    a, b = [codes[t] for t in left], np.array([codes[t] for t in right], dtype=np.int64)
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, token in enumerate(a, start=1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != token))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def _tokens(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def token_errors(left: Column, right: Column) -> Column:
    """Unit-cost edit distance of two token arrays: the tokens of a pair become one character each, by their place among its distinct tokens.

    Characters from U+10000 on hold a million distinct tokens; the distance itself is the built-in one over characters.
    """
    def coded(tokens: Column, names: Column) -> Column:
        points = F.transform(tokens, lambda t: F.lpad(F.hex(F.array_position(names, t) + 0x10000), 8, "0"))
        return F.decode(F.unhex(F.array_join(points, "")), "UTF-32")

    # the one-element array binds the pair and its names, so that they are computed once and not for every token
    pair = F.array(F.struct(left.alias("l"), right.alias("r"), F.array_distinct(F.concat(left, right)).alias("names")))
    return F.transform(pair, lambda p: F.levenshtein(coded(p["l"], p["names"]), coded(p["r"], p["names"])))[0].cast("bigint")


@F.pandas_udf(LongType())
def _word_errors(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([token_distance(h.split(), r.split()) for h, r in zip(hypothesis, reference)], dtype="int64")


def word_counts(hypothesis: Column, reference: Column) -> tuple[Column, Column]:
    """Token errors and reference length as expressions over raw texts; :func:`word_error_rows` is the form for tables."""
    ref = normalize_text(reference)
    return _word_errors(normalize_text(hypothesis), ref), F.size(_tokens(ref)).cast("bigint")


def word_error_rows(pairs: DataFrame, keys: list[str], hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """(keys, errors, units) of every pair; texts are normalised in a step of their own, then nothing leaves the JVM."""
    normal = pairs.select(*keys, normalize_text(F.col(hypothesis)).alias("__h"), normalize_text(F.col(reference)).alias("__r"))
    return normal.select(*keys, token_errors(_tokens(F.col("__h")), _tokens(F.col("__r"))).alias("errors"), F.size(_tokens(F.col("__r"))).cast("bigint").alias("units"))


def rate(errors: Column, units: Column) -> Column:
    return F.when(units == 0, F.when(errors == 0, 0.0).otherwise(1.0)).otherwise(errors / units)


def micro_average(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of errors over sum of units; null with a reason when there are no units."""
    totals = counts.groupBy(*keys).agg(F.sum("errors").alias("errors"), F.sum("units").alias("units"))
    return totals.withColumn("value", F.try_divide("errors", "units")).withColumn(
        "not_run_reason", F.when(F.col("units") == 0, "NO_REFERENCE_UNITS").otherwise(""))


def item_accuracy(reference: Column, hypothesis: Column) -> Column:
    """Share of positions with equal items over the longer list."""
    longest = F.greatest(F.size(reference), F.size(hypothesis))
    equal = F.size(F.filter(F.zip_with(reference, hypothesis, lambda a, b: a.eqNullSafe(b) & a.isNotNull()), lambda x: x))
    return F.when(longest == 0, 1.0).otherwise(equal / longest)


def term_recall(normalized_text: Column, terms: Column) -> Column:
    found = F.size(F.filter(terms, lambda term: F.contains(normalized_text, term)))
    return F.when(F.size(terms) > 0, found / F.size(terms))


def fact_scores(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Support rate and key-fact recall from distinct fact rows with 0/1 flags."""
    total = facts.groupBy(*keys).agg(
        F.sum("predicted").alias("p"), F.sum(F.col("predicted") * F.col("supported")).alias("ps"), F.sum("is_key").alias("k"),
        F.sum(F.col("is_key") * F.col("predicted") * F.col("supported")).alias("kps"))
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    return total.select(*keys, share("ps", "p").alias("support_rate"), share("kps", "k").alias("key_fact_recall"))


def closure_rate(claims: DataFrame, refs: DataFrame, known: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Share of claims that have references, all of which exist (1.0 without claims).

    ``claims`` (``claim_id``) and ``refs`` (``claim_id``, ``ref``) come apart, so a claim without a reference counts as open.
    With ``results`` (``has_result``, one row per planned run) the rate is 0.0 when there is none or a run has no result.
    """
    marked = refs.join(known.select("ref").distinct().withColumn("known", F.lit(True)), "ref", "left")
    held = marked.groupBy("claim_id").agg(F.min(F.coalesce("known", F.lit(False))).alias("closed"))
    n, closed = F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.col("closed"), F.lit(False)).cast("bigint")), F.lit(0).cast("bigint"))
    rate = claims.join(held, "claim_id", "left").agg(n.alias("claims"), closed.alias("closed"), F.when(n == 0, 1.0).otherwise(F.round(F.try_divide(closed, n), 9)).alias("rate"))
    if results is None:
        return rate
    whole = results.agg(F.coalesce(F.min(F.coalesce("has_result", F.lit(False))), F.lit(False)).alias("whole"))
    return rate.join(whole, F.lit(1) == F.lit(1)).select("claims", "closed", F.when(F.col("whole"), F.col("rate")).otherwise(0.0).alias("rate"))


def rubric_means(judged: DataFrame, keys: list[str]) -> DataFrame:
    score = F.when(F.col("title_relevance") == "RELEVANT", 1.0).when(F.col("title_relevance") == "PARTIAL", 0.5).otherwise(0.0)
    verdict = lambda name: F.round(F.avg(F.when(F.col("verdict") == name, 1.0).when(F.col("verdict").isNotNull(), 0.0)), 9)
    return judged.groupBy(*keys).agg(
        F.round(F.avg(score), 9).alias("title_relevance"), verdict("SUPPLEMENTS").alias("visual_supplement_rate"),
        verdict("DUPLICATES").alias("visual_duplicate_rate"))


def visual_accuracy(cases: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Accuracy and key-field recall over all cases; null with a reason unless every case succeeded and there is something to count."""
    sums = cases.groupBy(*keys).agg(
        F.coalesce(F.min("succeeded"), F.lit(False)).alias("ok"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("errors", "units", "hits", "fields")])
    accuracy = F.greatest(F.lit(0.0), 1.0 - F.try_divide("errors", "units"))
    reason = lambda column, name: F.when(~F.col("ok"), "CASES_NOT_READY").when(F.col(column) == 0, name).otherwise("")
    return sums.select(
        *keys, F.when(F.col("ok") & (F.col("units") > 0), F.round(accuracy, 9)).alias("visual_text_accuracy"),
        F.when(F.col("ok"), F.round(F.try_divide("hits", "fields"), 9)).alias("visual_key_field_recall"),
        reason("units", "NO_REFERENCE_TEXT").alias("text_reason"), reason("fields", "NO_KEY_FIELDS").alias("key_reason"))


def language_coverage(samples: DataFrame, minimum: int = 6) -> DataFrame:
    """Sample count per required language and whether it is enough."""
    need = samples.sparkSession.createDataFrame([(x,) for x in LANGUAGES], "lang string")
    counts = samples.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return need.join(counts, "lang", "left").select("lang", n.alias("samples"), (n >= minimum).alias("enough"))


def representativeness(frames: DataFrame, categories: list[str], media: int = 3, total: int = 12, each: int = 3) -> DataFrame:
    """Distinct media, frames and frames per category against their minima."""
    per_media = frames.groupBy("media").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("category") == c, 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(categories)])
    sums = per_media.agg(F.count(F.lit(1)).alias("media"), F.sum("n").alias("frames"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(categories))])
    enough = (F.col("media") >= media) & (F.col("frames") >= total)
    for i in range(len(categories)):
        enough = enough & (F.col(f"c{i}") >= each)
    return sums.select(enough.alias("representative"), "media", "frames")


def evaluate_thresholds(observations: DataFrame, thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    """PASS, FAIL or NOT_RUN per metric; an observation without a threshold is UNKNOWN_METRIC."""
    limits = observations.sparkSession.createDataFrame(thresholds, "metric string, threshold double, direction string")
    joined = limits.join(observations.select("metric", "value"), "metric", "full")
    good = F.when(F.col("direction") == "max", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    status = (
        F.when(F.col("threshold").isNull(), "UNKNOWN_METRIC").when(F.col("value").isNull(), "NOT_RUN")
        .when(good, "PASS").otherwise("FAIL"))
    return joined.select("metric", "value", "threshold", "direction", status.alias("status"))


def overall_status(results: DataFrame, has_resources: bool = True) -> DataFrame:
    severity = F.max(F.when(F.col("status").isin("FAIL", "UNKNOWN_METRIC"), 2).when(F.col("status") == "NOT_RUN", 1).otherwise(0))
    floor = F.lit(0 if has_resources else 1)
    worst = F.greatest(severity, floor)
    return results.agg(F.when(worst == 2, "FAIL").when(worst == 1, "NOT_RUN").otherwise("PASS").alias("status"))


def resolution_decision(results: DataFrame, keys: list[str]) -> DataFrame:
    """Compare the 1280 and 1920 configurations of each case.

    ``results`` has one row per (keys, config) with ``text_value`` and ``key_value``.
    """
    value = lambda config, name: F.max(F.when(F.col("config") == config, F.col(name)))
    wide = results.groupBy(*keys).agg(
        value("1280", "text_value").alias("t0"), value("1920", "text_value").alias("t1"),
        value("1280", "key_value").alias("k0"), value("1920", "key_value").alias("k1"))
    missing = F.col("t0").isNull() | F.col("t1").isNull() | F.col("k0").isNull() | F.col("k1").isNull()
    up = (F.col("t1") > F.col("t0")) | (F.col("k1") > F.col("k0"))
    down = (F.col("t1") < F.col("t0")) | (F.col("k1") < F.col("k0"))
    decision = (
        F.when(missing, "INCONCLUSIVE").when(up & ~down, "KEEP_1920").when(~up, "PREFER_1280")
        .otherwise("TRADEOFF_REVIEW_REQUIRED"))
    return wide.select(*keys, decision.alias("decision"))


def report_status(planned: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Status of a report over its planned cases.

    A planned case without a result makes it INCOMPLETE; a result that was never planned, or a second one for a case, makes it REFUSED.
    Both tables have ``keys`` and ``case_id``.
    """
    per_case = results.groupBy(*keys, "case_id").agg(F.count(F.lit(1)).alias("times"), F.min("case_status").alias("case_status"))
    rows = planned.select(*keys, "case_id").withColumn("planned", F.lit(1)).join(per_case, [*keys, "case_id"], "full")
    count = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    n, missing = F.count("planned"), count(F.col("times").isNull())
    refused = count(F.col("planned").isNull() | (F.col("times") > 1))
    only_waiting = F.min(F.coalesce(F.col("case_status") == "NOT_RUN", F.lit(False)))
    failed = F.max(F.coalesce(F.col("case_status").isin("FAIL", "NOT_RUN"), F.lit(False)))
    status = F.when(refused > 0, "REFUSED").when(missing > 0, "INCOMPLETE").when(only_waiting, "NOT_RUN").when(failed, "FAIL").otherwise("SUCCEEDED")
    return rows.groupBy(*keys).agg(n.alias("planned"), missing.alias("missing"), refused.alias("refused"), status.alias("status"))
