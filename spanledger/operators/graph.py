"""The typed reference graph of a document: chapters, blocks, observations, frames and transcripts.

Edges and nodes are rows, so a run of any size is joined, never gathered. Rules give violation rows (see :mod:`closure`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.operators.closure import violation
from spanledger.session import checkpoint

# What each kind of reference may point to, and which references must lie within the time of their owner.
TARGETS = {
    "CHAPTER_OBSERVATION": ("OBSERVATION",), "CHAPTER_FRAME": ("KEYFRAME",), "SELECTED_FRAME": ("KEYFRAME",), "SHOWN_FRAME": ("KEYFRAME",),
    "CHAPTER_TRANSCRIPT": ("SPEECH", "SUBTITLE"), "CHAPTER_EVIDENCE": ("OBSERVATION", "KEYFRAME", "SPEECH", "SUBTITLE"), "VISUAL": ("OBSERVATION",),
}
CONTAINED = ("CHAPTER_OBSERVATION", "CHAPTER_FRAME", "SELECTED_FRAME", "SHOWN_FRAME", "CHAPTER_TRANSCRIPT", "CHAPTER_EVIDENCE")


def reference_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unknown owners and targets, targets of a kind the role does not allow, and targets outside their owner's time.

    ``edges``: run_id, owner_id, role, ref_id. ``nodes``: run_id, node_id, kind, start_ms, end_ms. Each edge meets its
    two ends in one equality join each; an edge has one finding at most, in that order.
    """
    end = lambda key, name: nodes.select("run_id", F.col("node_id").alias(key), F.struct("kind", "start_ms", "end_ms").alias(name))
    joined = edges.join(end("owner_id", "o"), ["run_id", "owner_id"], "left").join(end("ref_id", "r"), ["run_id", "ref_id"], "left")
    allowed = F.lit(False)
    for role, kinds in TARGETS.items():
        allowed = allowed | ((F.col("role") == role) & F.col("r.kind").isin(*kinds))
    inside = (F.col("o.start_ms") <= F.col("r.start_ms")) & (F.col("r.end_ms") <= F.col("o.end_ms"))
    rule = (
        F.when(F.col("o").isNull(), "UNKNOWN_OWNER").when(F.col("r").isNull(), "UNKNOWN_REFERENCE").when(~allowed, "TYPE_MISMATCH")
        .when(F.col("role").isin(*CONTAINED) & ~inside, "OUTSIDE_OWNER"))
    found = joined.withColumn("__rule", rule).where("__rule IS NOT NULL")
    return found.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("__rule").alias("rule"), F.col("owner_id").alias("entity_id"), F.col("ref_id").alias("ref_id"), F.col("role").alias("detail"))


def visual_block_violations(blocks: DataFrame, observations: DataFrame) -> DataFrame:
    """Content selection of visual blocks.

    ``blocks``: run_id, block_id, observation_ref, evidence_refs, content_refs, caption. ``observations``: run_id, observation_id, kind,
    relation, caption, content_ids (arrays of the model's bounded size). A block has one finding at most.
    """
    known = observations.select("run_id", F.col("observation_id").alias("observation_ref"), F.struct("kind", "relation", "caption", "content_ids").alias("o"))
    joined = blocks.join(known, ["run_id", "observation_ref"], "left")
    chosen, offered = F.col("content_refs"), F.coalesce("o.content_ids", F.array().cast("array<string>"))
    reason = (
        F.when((F.size("evidence_refs") != 1) | (F.get("evidence_refs", F.lit(0)) != F.col("observation_ref")), "BOUND_TO_OTHERS")
        .when(F.col("o").isNull() | (F.col("o.kind") != "OBSERVATION"), "NOT_AN_OBSERVATION")
        .when(F.size(F.array_distinct(chosen)) != F.size(chosen), "CONTENT_REPEATED")
        .when((F.size(offered) > 0) & (F.size(chosen) == 0), "CONTENT_MISSING").when((F.size(offered) == 0) & (F.size(chosen) > 0), "CONTENT_OF_EMPTY_OBSERVATION")
        .when(F.size(F.array_except(chosen, offered)) > 0, "CONTENT_UNKNOWN")
        .when(F.col("o.relation") == "DUPLICATE", "DUPLICATE_SHOWN").when((F.col("o.relation") == "CONFLICTING") & (F.col("caption") != F.col("o.caption")), "CONFLICT_CAPTION"))
    return violation(joined.withColumn("__r", reason).where("__r IS NOT NULL"), "VISUAL_BLOCK", F.col("run_id"), F.col("block_id"), F.col("observation_ref"), F.col("__r"))


def backward_relations(relations: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame relations that do not go forward in the true time of their frames.

    ``relations``: run_id, observation_id, from_frame, to_frame. ``frames``: run_id, frame_id, timestamp_ms.
    """
    at = lambda key, name: frames.select("run_id", F.col("frame_id").alias(key), F.col("timestamp_ms").alias(name))
    timed = relations.join(at("from_frame", "__from"), ["run_id", "from_frame"]).join(at("to_frame", "__to"), ["run_id", "to_frame"])
    return violation(timed.where("__from >= __to"), "RELATION_BACKWARD", F.col("run_id"), F.col("observation_id"), F.col("from_frame"), F.col("to_frame"))


def orphan_frames(frames: DataFrame, shown: DataFrame) -> DataFrame:
    """Frames that no observation shows. ``shown``: run_id, observation_id, frame_id."""
    alone = frames.join(shown.select("run_id", "frame_id").distinct(), ["run_id", "frame_id"], "left_anti")
    return violation(alone, "ORPHAN_KEYFRAME", F.col("run_id"), F.col("frame_id"))


def chosen_sources(blocks: DataFrame, contents: DataFrame, shown: DataFrame) -> DataFrame:
    """Frames a visual block stands for: the sources of its contents in order, else all frames its observation shows.

    ``blocks``: run_id, chapter_id, block_id, position, observation_ref, content_refs. ``contents``: run_id, observation_id, content_id, source_position,
    frame_id. ``shown``: run_id, observation_id, frame_position, frame_id. Result: run_id, chapter_id, block_id, place, frame_id, where ``place`` orders frames of a chapter.
    """
    picked = blocks.select("run_id", "chapter_id", "block_id", "position", F.col("observation_ref").alias("observation_id"), F.posexplode("content_refs").alias("at", "content_id"))
    named = picked.join(contents, ["run_id", "observation_id", "content_id"]).select(
        "run_id", "chapter_id", "block_id", F.struct("position", "at", F.col("source_position").alias("n")).alias("place"), "frame_id")
    bare = blocks.join(named.select("run_id", "block_id").distinct(), ["run_id", "block_id"], "left_anti").select(
        "run_id", "chapter_id", "block_id", "position", F.col("observation_ref").alias("observation_id"))
    whole = bare.join(shown, ["run_id", "observation_id"]).select(
        "run_id", "chapter_id", "block_id", F.struct("position", F.lit(0).alias("at"), F.col("frame_position").cast("int").alias("n")).alias("place"), "frame_id")
    return named.unionByName(whole)


def rebuilt_selection(sources: DataFrame, declared: DataFrame) -> DataFrame:
    """Chapters whose declared frames are not, in order, the distinct sources of their visual blocks.

    ``declared``: run_id, chapter_id, position, frame_id. Both sides are numbered and compared place by place, so no list is built;
    each chapter that differs is named with its first differing place.
    """
    keys = ["run_id", "chapter_id"]
    first = sources.groupBy(*keys, "frame_id").agg(F.min("place").alias("place"))
    number = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    built = first.select(*keys, number("place").alias("n"), F.col("frame_id").alias("built"))
    given = declared.select(*keys, number("position").alias("n"), F.col("frame_id").alias("given"))
    wrong = built.join(given, [*keys, "n"], "full").where(~F.col("built").eqNullSafe(F.col("given"))).groupBy(*keys).agg(F.min("n").alias("n"))
    return violation(wrong, "KEYFRAMES_DIFFER", F.col("run_id"), F.col("chapter_id"), None, F.col("n"))


def components(edges: DataFrame, nodes: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, node, root): the least node that each node reaches over undirected ``edges`` (scope, a, b) within its scope.

    Every round a node takes the least root among its own and its neighbours', then the root of that root, so paths
    halve and a chain of n nodes is done in about log(n) rounds. Rounds are joins on (scope, node) over all runs at once and
    each is written to the checkpoint folder; the loop ends when no root has changed. Nodes without an edge are their own root and take no part in the rounds.
    """
    both = checkpoint(edges.select(*scope, "a", "b").unionByName(edges.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    own = checkpoint(nodes.select(*scope, "node").distinct().withColumn("root", F.col("node")))
    linked = both.select(*scope, F.col("a").alias("node")).distinct()
    current = checkpoint(own.join(linked, [*scope, "node"], "left_semi"))
    while True:
        roots = current.select(*scope, F.col("node").alias("b"), "root")
        near = both.join(roots, [*scope, "b"]).groupBy(*scope, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hung = current.join(near, [*scope, "node"], "left").select(*scope, "node", "root", F.least("root", "near").alias("next"))
        # a root that learns of a lesser one tells all nodes that hang on it
        told = hung.groupBy(*scope, F.col("root").alias("next")).agg(F.min("next").alias("further"))
        moved = checkpoint(hung.join(told, [*scope, "next"], "left").select(*scope, "node", F.least("next", "further").alias("root"), (F.least("next", "further") != F.col("root")).alias("changed")))
        current = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return current.unionByName(own.join(linked, [*scope, "node"], "left_anti"))


def unrelated_sources(sources: DataFrame, blocks: DataFrame, relations: DataFrame) -> DataFrame:
    """Blocks whose frames are not one connected graph over their observation's relations among these frames."""
    scope = ["run_id", "block_id"]
    frames = sources.select(*scope, F.col("frame_id").alias("node")).distinct()
    owned = blocks.select(*scope, F.col("observation_ref").alias("observation_id")).join(relations, ["run_id", "observation_id"])
    inside = owned.join(frames.select(*scope, F.col("node").alias("from_frame")), [*scope, "from_frame"]).join(frames.select(*scope, F.col("node").alias("to_frame")), [*scope, "to_frame"])
    roots = components(inside.select(*scope, F.col("from_frame").alias("a"), F.col("to_frame").alias("b")), frames, scope)
    parts = roots.groupBy(*scope).agg(F.count_distinct("root").alias("parts")).where("parts > 1")
    return violation(parts, "FRAMES_UNRELATED", F.col("run_id"), F.col("block_id"), None, F.col("parts"))


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, node_id) of every node that directed ``edges`` (run_id, owner_id, ref_id) reach from ``seeds`` (run_id, node_id), seeds included.

    Each round follows the edges of the nodes met last and keeps those not met before, all runs at once; rounds are as many as the longest shortest path, and written.
    """
    steps = checkpoint(edges.select("run_id", "owner_id", F.col("ref_id").alias("node_id")).distinct())
    met = last = checkpoint(seeds.select("run_id", "node_id").distinct())
    while not last.isEmpty():
        next_ = last.select("run_id", F.col("node_id").alias("owner_id")).join(steps, ["run_id", "owner_id"]).select("run_id", "node_id").distinct()
        last = checkpoint(next_.join(met, ["run_id", "node_id"], "left_anti"))
        met = met.unionByName(last)
    return met


def unreached(nodes: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence that no chain of references from a chapter reaches."""
    alone = nodes.join(reachable(seeds, edges), ["run_id", "node_id"], "left_anti")
    return violation(alone, "UNREACHED", F.col("run_id"), F.col("node_id"), None, F.col("kind"))

