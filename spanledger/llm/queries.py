"""Named queries over whole tables for the ten operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm import alignment, decontamination, language, mixing, pieces, quality_cnn, rotation, sharding, simhash, toxicity, units, warc, whitening
from spanledger.llm.sampling import remainder
from spanledger.session import shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _held_out(modulus: int, rest: int):
    return F.coalesce(remainder(F.col("doc_id"), modulus) == rest, F.lit(False)).alias("held_out")


def op1_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.fit_language_model(docs)
    return language.identify_languages(docs, model).select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op2_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    path = warc.write_archives(_table(spark, folder, "pages"))
    records = warc.read_archives(spark, path, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(_table(spark, folder, "documents"), path)
    shards = sharding.read_shards(spark, path)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_toxicity_trees(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity_model(docs, _table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_benchmark_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark").select("item_id", "text"))


def op7_repeated_units(spark: SparkSession, folder: str) -> DataFrame:
    kept = units.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat(s.start.cast("string"), F.lit("-"), s.stop.cast("string"))), ",")
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start)
    return kept.select("row.doc_id", "text", removed.alias("removed_chars"), spans.alias("removed_spans"))


def op8_quality_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    network = quality_cnn.fit_quality_model(docs, _table(spark, folder, "labels"))
    scored = quality_cnn.score_quality(docs, network)
    return scored.select("row.doc_id", "quality_score", "quality_kept").select("doc_id", _held_out(5, 0), F.col("quality_score").alias("score"), F.col("quality_kept").cast("int").alias("predicted"))


def op9_piece_dropout(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, folder, "documents").select("doc_id", "text"), pieces.load_vocabulary())


def op10_rotation_codes(spark: SparkSession, folder: str) -> DataFrame:
    return rotation.near_vectors(_table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op11_slot_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_documents(_table(spark, folder, "documents"))


def op12_polar_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_vectors(_table(spark, folder, "embeddings"))


def op13_anchor_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.token_alignment(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_crf, op2_simhash_groups, op3_warc_bundles, op4_histogram_shards, op5_toxicity_trees, op6_benchmark_overlap, op7_repeated_units,
        op8_quality_cnn, op9_piece_dropout, op10_rotation_codes, op11_slot_schedule, op12_polar_whitening, op13_anchor_alignment,
    )
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * (instr('0123456789abcdef', substr(h, {5 * i // 4 + 1}, 1)) - 1) + "
    f"greatest(instr('0123456789abcdef', substr(h, {5 * i // 4 + 2}, 1)) - 1, 0)) >> {3 - 5 * i % 4}) & 31), 1)"
    for i in range(32)
)

ORACLE: dict[str, str] = {
    "op3_warc_bundles": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)""",
    "op6_benchmark_overlap": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
d2 AS (SELECT doc_id, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM d),
b AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d2, sizes WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, item_id, i, dg.k FROM (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM dw) dg JOIN win ON win.k = dg.k AND win.g = dg.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d2.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d2 LEFT JOIN n ON n.doc_id = d2.doc_id LEFT JOIN it ON it.doc_id = d2.doc_id""",
    "op7_repeated_units": r"""
WITH s AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\r]', '\1' || chr(31), 'g'), '\n', chr(31), 'g'), chr(31)) AS parts FROM documents),
u AS (SELECT doc_id, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM s WHERE text <> ''),
o AS (SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
v AS (SELECT doc_id, place, CAST(start AS BIGINT) AS start, least(CAST(start AS BIGINT) + length(part) + 1, length(text)) AS stop, substr(text, CAST(start AS BIGINT) + 1, length(part) + 1) AS raw,
      trim(regexp_replace(lower(part), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS norm FROM o),
y AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n, lag(norm, 1, '') OVER (PARTITION BY doc_id ORDER BY place) AS before FROM v),
x AS (SELECT *, CASE WHEN n >= 5 THEN norm WHEN n > 0 AND before <> '' AND n + len(string_split(before, ' ')) >= 5 THEN before || ' ' || norm END AS unit FROM y),
w AS (SELECT *, CASE WHEN unit IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY unit ORDER BY doc_id, place) END AS nth FROM x),
kept AS (SELECT doc_id, string_agg(raw, '' ORDER BY place) AS text FROM w WHERE nth = 1 GROUP BY doc_id),
isl AS (SELECT doc_id, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run, start, stop FROM w WHERE nth > 1),
span AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM isl GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(stop - start) AS removed_chars, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars, coalesce(removed_spans, '') AS removed_spans
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id""",
    "op10_rotation_codes": """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT DISTINCT a AS v, a AS w FROM l UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.w),
c AS (SELECT v, min(w) AS low FROM r GROUP BY v), n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.v = vec_id""",
    "op11_slot_schedule": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS o FROM d GROUP BY source),
f AS (SELECT *, [5, 2, 1][o % 3 + 1] AS w, z * CAST(2 AS DOUBLE) AS cap, sum(z) OVER () * CAST(1.5 AS DOUBLE) AS everything FROM s),
l AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= w * (everything - coalesce(sum(cap) OVER (ORDER BY cap / w, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM f),
t AS (SELECT source, o, z, CASE WHEN filled THEN cap ELSE w * ((everything - coalesce(sum(cap) FILTER (filled) OVER (), 0)) / sum(w) FILTER (NOT filled) OVER ()) END AS target FROM l),
p AS (SELECT doc_id, size, z, target, CAST(floor(target + 0.5) AS BIGINT) AS goal,
      CAST(coalesce(sum(size) OVER (PARTITION BY o ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target, greatest(0, least(start + size, goal) - start) + greatest(0, least(start + size + z, goal) - start - z) AS taken FROM p""",
}
