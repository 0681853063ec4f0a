"""Document composition: budgets, chunks, fallback chapters, blocks and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions import text as tx
from spanledger.functions.identity import stable_id
from spanledger.operators import rendering
from spanledger.operators.scan import Scan, ordered_scan


def observation_intervals(shown: DataFrame, chapters: DataFrame) -> DataFrame:
    """Interval of each observation, clamped to its chapter, with ordered keyframe ids.

    ``shown`` has one row per frame of an observation (a handful per observation).
    """
    spans = shown.groupBy("observation_id").agg(
        F.min("timestamp_ms").alias("lo"), (F.max("timestamp_ms") + 1).alias("hi"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("timestamp_ms", "ord", "frame_id"))),
            lambda f: F.concat(F.lit("kf_"), f["frame_id"]),
        ).alias("keyframe_refs"),
    )
    return spans.join(chapters, "observation_id").select(
        "observation_id", F.greatest("lo", "chapter_start_ms").alias("start_ms"),
        F.least("hi", "chapter_end_ms").alias("end_ms"), "keyframe_refs",
    )


def within_text_budget(rows: DataFrame, keys: list[str], order: list[str], limit: int | Column, bucket: Column) -> DataFrame:
    """Rows that still fit a running character budget; the last one is cut."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    sized = rows.withColumn("__len", F.length("text").cast("bigint"))
    used = ordered_scan(sized, keys, order, bucket, [Scan("__used", "sum_before", "__len")])
    left = (limit - F.coalesce("__used", F.lit(0))).cast("int")
    return used.withColumn("__left", left).where("__left > 0").withColumn(
        "text", F.substring(F.col("text"), F.lit(1), F.col("__left"))
    ).drop("__len", "__used", "__left")


def fixed_chunks(rows: DataFrame, keys: list[str], order: list[str], size: int, bucket: Column) -> DataFrame:
    """Add ``chunk``: the ordinal of the fixed-size chunk a row falls in."""
    counted = ordered_scan(rows, keys, order, bucket, [Scan("__n", "count_before")])
    return counted.withColumn("chunk", F.floor(F.col("__n") / size).cast("bigint")).drop("__n")


def edge_evidence(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """First and last ``n`` evidence rows of each chapter, flagged.

    Each end is its own ranked filter, which Spark turns into a group limit before
    the shuffle, so a large chapter sends only ``n`` rows per task.
    """
    columns = ["start_ms", "end_ms", "evidence_id"]
    slim = rows.select(*keys, *columns)

    def ranked(*order) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return slim.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")

    head = ranked(*columns).withColumn("is_head", F.lit(True)).withColumn("is_tail", F.lit(False))
    tail = ranked(*[F.desc(c) for c in columns]).withColumn("is_head", F.lit(False)).withColumn("is_tail", F.lit(True))
    return head.unionByName(tail).groupBy(*keys, *columns).agg(
        F.max("is_head").alias("is_head"), F.max("is_tail").alias("is_tail")
    )


# Body and summary limits per detail level, and placeholder texts.
BODY_LIMITS = {"concise": 800, "standard": 2000, "detailed": 4000}
SUMMARY_LIMITS = {"concise": 160, "standard": 300, "detailed": 500}
EMPTY_TITLE = "无语义内容"
OVERVIEW_LIMIT = 8000
CHUNK_ROWS = 32
MAX_CHAPTERS = 240


def fallback_paragraphs(evidence: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Paragraphs of a rule-written chapter: 32 evidence rows each, under the body limit.

    ``keys`` names the chapter. Rows are numbered with a sliced scan and joined per chunk,
    so no chapter is collected; the limit is a running sum over the few chunks.
    """
    rows = evidence.select(*keys, "evidence_id", "start_ms", "end_ms", "text")
    order = ["start_ms", "end_ms", "evidence_id"]
    chunked = fixed_chunks(rows, keys, order, CHUNK_ROWS, F.floor(F.col("start_ms") / 60_000))
    ordered = F.array_sort(F.collect_list(F.struct(*order, "text")))
    joined = chunked.groupBy(*keys, "chunk").agg(ordered.alias("__r")).select(
        *keys, "chunk", F.array_join(F.transform("__r", lambda r: r["text"]), " ").alias("text"),
        F.transform("__r", lambda r: r["evidence_id"]).alias("evidence_refs"))
    kept = within_text_budget(joined, keys, ["chunk"], limit, F.floor(F.col("chunk") / 256))
    return kept.where(F.length("text") > 0)


def fallback_chapters(
    chapters: DataFrame, evidence: DataFrame, keys: list[str], detail: str = "standard", paragraphs: DataFrame | None = None
) -> DataFrame:
    """Chapters with title, summary, header references and status; chapters without evidence become placeholders."""
    if paragraphs is None:
        paragraphs = fallback_paragraphs(evidence, keys, BODY_LIMITS[detail])
    first = paragraphs.where("chunk = 0").select(*keys, F.substring("text", 1, SUMMARY_LIMITS[detail]).alias("__summary"))
    heads = evidence.groupBy(*keys).agg(
        F.min(F.struct("start_ms", "end_ms", "evidence_id", "text")).alias("__h"), F.count(F.lit(1)).alias("n_evidence"))
    joined = chapters.join(heads, keys, "left").join(first, keys, "left")
    grounded = F.col("__h").isNotNull()
    return joined.select(
        *chapters.columns,
        F.when(grounded, F.substring("__h.text", 1, 200)).otherwise(F.lit(EMPTY_TITLE)).alias("title"),
        F.when(grounded, F.coalesce("__summary", F.lit(""))).otherwise(F.lit("")).alias("summary"),
        F.when(grounded, F.array("__h.evidence_id")).otherwise(F.array().cast("array<string>")).alias("header_refs"),
        F.when(grounded, "GROUNDED").otherwise("NO_SEMANTIC_EVIDENCE").alias("content_status"),
        F.coalesce("n_evidence", F.lit(0)).cast("bigint").alias("n_evidence"),
    )


def ensure_claims(chapters: DataFrame) -> DataFrame:
    """Give a chapter without claims one claim: the first sentence of its summary."""
    usable = (F.size("claims") == 0) & (F.length(F.trim("summary")) > 0) & (F.size("header_refs") > 0)
    claim = F.array(F.struct(
        tx.first_sentence(F.col("summary")).alias("text"), F.col("header_refs").alias("evidence_refs"), F.lit(0.7).alias("certainty")))
    return chapters.withColumn("claims", F.when(usable, claim).otherwise(F.col("claims")))


def flatten_claims(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """Claim rows with stable ids."""
    rows = chapters.select(*keys, F.posexplode("claims").alias("pos", "c"))
    key = {k: F.col(k) for k in keys}
    return rows.select(
        *keys, "pos", stable_id("claim", **key, pos=F.col("pos"), text=F.col("c.text")).alias("claim_id"),
        F.col("c.text").alias("text"), F.col("c.evidence_refs").alias("evidence_refs"))


def evidence_closure(*parts: Column) -> Column:
    """Ordered distinct union of reference arrays."""
    return F.array_distinct(F.concat(*parts))


def overview(chapters: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Joined summaries of the grounded chapters, cut to the overview limit.

    A run has at most 240 chapters; rows past the limit are dropped before collecting.
    """
    grounded = chapters.where("content_status = 'GROUNDED'").select(*keys, order, F.col("summary").alias("text"))
    kept = within_text_budget(grounded, keys, [order], OVERVIEW_LIMIT, F.floor(F.col(order) / 64))
    joined = kept.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(order, "text"))), lambda r: r["text"]).alias("__t"))
    return joined.select(*keys, F.substring(F.array_join("__t", "；"), 1, OVERVIEW_LIMIT).alias("overview"))


def quote_matches(quote: Column, referenced: Column) -> Column:
    """Whether the quote occurs verbatim in the referenced text, ignoring spaces and punctuation."""
    key = tx.quote_key(quote)
    return (F.length(key) > 0) & F.contains(tx.quote_key(referenced), key)


def refs_are_contiguous(positions: Column) -> Column:
    return (F.size(positions) > 0) & (F.array_max(positions) - F.array_min(positions) + 1 == F.size(F.array_distinct(positions)))


def quote_verdicts(quotes: DataFrame, transcript: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, verbatim): whether a quote stands in the transcript rows it refers to, which must follow each other without a gap.

    ``quotes``: keys, block_id, text, evidence_refs. ``transcript``: keys, evidence_id, position (the row's number in its chapter), text. References that
    are no transcript rows do not count; a quote with none left is not verbatim.
    """
    named = quotes.select(*keys, "block_id", F.explode("evidence_refs").alias("evidence_id")).distinct()
    rows = named.join(transcript.select(*keys, "evidence_id", "position", F.col("text").alias("told")), [*keys, "evidence_id"])
    told = rows.groupBy(*keys, "block_id").agg(F.array_sort(F.collect_list(F.struct("position", "told"))).alias("r"))
    found = told.select(*keys, "block_id", refs_are_contiguous(F.transform("r", lambda x: x["position"])).alias("__next"), F.array_join(F.transform("r", lambda x: x["told"]), " ").alias("__told"))
    joined = quotes.select(*keys, "block_id", "text").join(found, [*keys, "block_id"], "left")
    return joined.select(*keys, "block_id", F.coalesce(F.col("__next") & quote_matches(F.col("text"), F.col("__told")), F.lit(False)).alias("verbatim"))


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Quotes that are not verbatim become paragraphs; DUPLICATE visual blocks are dropped.

    Needs ``block_type``, ``verbatim`` and ``relation``.
    """
    kept = blocks.where(~((F.col("block_type") == "VISUAL") & F.col("relation").eqNullSafe("DUPLICATE")))
    demoted = (F.col("block_type") == "QUOTE") & ~F.coalesce("verbatim", F.lit(False))
    return kept.withColumn("block_type", F.when(demoted, "PARAGRAPH").otherwise(F.col("block_type")))


def append_visuals(observations: DataFrame, keys: list[str], max_frames: int, char_limit: int) -> DataFrame:
    """Observations added to a chapter in order under its frame and character budgets.

    DUPLICATE and CONFLICTING observations are never added. A chapter has a few observations.
    """
    usable = observations.where(~F.col("relation").isin("DUPLICATE", "CONFLICTING"))
    lists = usable.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ord", "observation_id", "frame_ids", "caption"))).alias("o"))

    def step(acc: Column, x: Column) -> Column:
        frames = F.array_union(acc["frames"], x["frame_ids"])
        size = acc["chars"] + F.length(x["caption"])
        fits = (F.size(acc["frames"]) < max_frames) & (F.size(frames) <= max_frames) & (size <= char_limit)
        return F.when(fits, F.struct(
            frames.alias("frames"), size.alias("chars"), F.concat(acc["ids"], F.array(x["observation_id"])).alias("ids"))).otherwise(acc)

    start = F.struct(
        F.slice(F.element_at("o", 1)["frame_ids"], 1, 0).alias("frames"), F.lit(0).alias("chars"),
        F.slice(F.array(F.element_at("o", 1)["observation_id"]), 1, 0).alias("ids"))
    out = F.aggregate("o", start, step)
    return lists.select(*keys, out["ids"].alias("observation_ids"), out["frames"].alias("frame_ids"), out["chars"].cast("bigint").alias("chars"))


def first_seen(rows: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Distinct values per owner in order of first appearance."""
    seen = rows.groupBy(*keys, value).agg(F.min(position).alias("__p"))
    return seen.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__p", F.col(value).alias("v")))), lambda r: r["v"]).alias("values"))


def frames_connected(nodes: Column, edges: Column) -> Column:
    """Whether the shown frames form one connected graph (``edges``: array of src, dst).

    Frames start as parts of one; each edge between shown frames joins the parts of its ends, so edges are walked once.
    """
    def parts_of(bound: Column) -> Column:
        shown = bound["nodes"]
        usable = F.filter(bound["edges"], lambda e: F.array_contains(shown, e["src"]) & F.array_contains(shown, e["dst"]))

        def join(parts: Column, edge: Column) -> Column:
            touched = lambda p: F.array_contains(p, edge["src"]) | F.array_contains(p, edge["dst"])
            return F.concat(F.filter(parts, lambda p: ~F.coalesce(touched(p), F.lit(False))), F.array(F.flatten(F.filter(parts, touched))))

        return F.aggregate(usable, F.transform(shown, lambda n: F.array(n)), join)

    # bound in a lambda, so that neither array is built again for every edge
    bound = F.array(F.struct(F.array_distinct(nodes).alias("nodes"), edges.alias("edges")))
    return F.size(F.get(F.transform(bound, parts_of), F.lit(0))) <= 1


def visual_block_verdicts(blocks: DataFrame, observations: DataFrame) -> DataFrame:
    """Keep, blank or drop each visual block, with the reason.

    ``blocks``: block_id, observation_ref, evidence_refs, content_refs. ``observations``:
    observation_id, content_ids.
    """
    joined = blocks.join(
        observations.select(F.col("observation_id").alias("observation_ref"), "content_ids"), "observation_ref", "left")
    unknown = F.size(F.array_except("content_refs", "content_ids")) > 0
    reason = (
        F.when(F.col("content_ids").isNull(), "unknown_observation")
        .when((F.size("evidence_refs") != 1) | (F.get("evidence_refs", F.lit(0)) != F.col("observation_ref")), "invalid_visual_evidence_refs")
        .when((F.size("content_ids") > 0) & (F.size("content_refs") == 0), "missing_content_reference")
        .when((F.size("content_ids") > 0) & unknown, "unknown_content_reference").otherwise(""))
    blank = (F.col("reason") == "") & (F.size("content_ids") == 0) & (F.size("content_refs") > 0)
    return joined.withColumn("reason", reason).withColumn(
        "action", F.when(F.col("reason") != "", "DROP").when(blank, "BLANK").otherwise("KEEP"))


def derive_targets(selected: DataFrame, frame_targets: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets covered by the selected frames, in the order the request lists them."""
    covered = selected.join(frame_targets, [*keys[:1], "frame_id"]).select(*keys, "target_id").distinct()
    ordered = covered.join(targets.select(keys[0], "target_id", "target_order"), [keys[0], "target_id"])
    return ordered.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("target_order", "target_id"))), lambda r: r["target_id"]).alias("target_ids"))


def suspicious_boundaries(drafts: DataFrame, minimum_ms: int) -> DataFrame:
    """Batch edges that need a second look: agreeing titles, a short neighbour, a repaired or fallback batch.

    ``drafts``: run_id, batch, ordinal, start_ms, end_ms, title, repaired.
    """
    row = F.struct("ordinal", "start_ms", "end_ms", "title", "repaired")
    edges = drafts.groupBy("run_id", "batch").agg(F.max(row).alias("last"), F.min(row).alias("first"))
    left = edges.select("run_id", "batch", F.col("last").alias("l"))
    right = edges.select("run_id", (F.col("batch") - 1).alias("batch"), F.col("first").alias("r"))
    pairs = left.join(right, ["run_id", "batch"]).withColumn("__lk", tx.title_key(F.col("l.title"))).withColumn(
        "__rk", tx.title_key(F.col("r.title")))
    agree = (F.length("__lk") > 0) & (F.length("__rk") > 0) & (
        F.contains("__lk", "__rk") | F.contains("__rk", "__lk"))
    short = (F.col("l.end_ms") - F.col("l.start_ms") < minimum_ms) | (F.col("r.end_ms") - F.col("r.start_ms") < minimum_ms)
    repaired = F.col("l.repaired") | F.col("r.repaired")
    return pairs.select(
        "run_id", F.col("batch").alias("boundary_index"), agree.alias("titles_agree"), short.alias("short"), repaired.alias("repaired"),
        (agree | short | repaired).alias("suspicious"))


def apply_merge_decisions(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted merges: a chapter taken by one merge cannot be taken by the next.

    ``decisions`` holds the mergeable MERGE boundaries (``boundary_index``, ``only_chapter``:
    the right batch has a single chapter, so the next boundary would reuse it). Boundaries
    that share chapters form chains; in a chain every other boundary is accepted.
    """
    linked = ordered_scan(decisions, keys, ["boundary_index"], F.floor(F.col("boundary_index") / 4096), [
        Scan("__pi", "lag", "boundary_index"), Scan("__po", "lag", "only_chapter")])
    opens = F.col("__pi").isNull() | (F.col("__pi") != F.col("boundary_index") - 1) | ~F.col("__po")
    marked = linked.withColumn("__open", F.when(opens, F.col("boundary_index")))
    heads = ordered_scan(marked, keys, ["boundary_index"], F.floor(F.col("boundary_index") / 4096), [Scan("__before", "max_before", "__open")])
    head = F.coalesce("__open", "__before")
    return heads.withColumn("accepted", (F.col("boundary_index") - head) % 2 == 0).select(*keys, "boundary_index", "accepted")


def bind_source(blocks: Column, evidence_id: Column) -> Column:
    """Attach the single source evidence of an image to every block."""
    return F.transform(blocks, lambda b: F.struct(b.alias("text"), F.array(evidence_id).alias("evidence_refs")))


def block_characters(block_type: Column, text: Column, items: Column) -> Column:
    """Characters a block spends of the body budget."""
    listed = F.aggregate(items, F.lit(0), lambda n, x: n + F.length(x))
    return F.when(block_type.isin("BULLET_LIST", "TABLE"), listed).otherwise(F.length(text)).cast("bigint")


def render_documents(titles: DataFrame, chapters: DataFrame, paragraphs: DataFrame, claims: DataFrame) -> DataFrame:
    """Markdown of runs whose chapters hold paragraphs (run_id, chapter_index, chunk, text) only."""
    blocks = paragraphs.select("run_id", "chapter_index", F.col("chunk").alias("position"), rendering.block(F.lit("PARAGRAPH"), text=F.col("text")).alias("block"))
    return rendering.render_video(titles, chapters, blocks, claims)
