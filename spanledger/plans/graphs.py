"""Queries over the reference graph of documents: events become frames, observations, blocks and transcripts of ten-day chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.functions.timing import epoch_ms
from spanledger.operators import graph
from spanledger.operators.scan import Scan, ordered_scan
from spanledger.plans.catalog import query
from spanledger.plans.rules import _row
from spanledger.plans.views import EPOCH_2024_MS
from spanledger.session import checkpoint

CHAPTER_MS = 864_000_000


_GRAPH = f"""
ev AS (SELECT user_id AS run_id, event_id AS e, event_type AS t, value, props, epoch_us(ts) // 1000 - {EPOCH_2024_MS} AS ms, (epoch_us(ts) // 1000 - {EPOCH_2024_MS}) // {CHAPTER_MS} AS ch FROM events),
fr AS (SELECT run_id, ch, e, ms, 'kf_' || e AS frame_id, row_number() OVER (PARTITION BY run_id, ch ORDER BY ms, e) AS n FROM ev WHERE t = 'view'),
ob AS (SELECT run_id, ch, e, props, 'ob_' || e AS observation_id, 'ch_' || (ch + CASE WHEN e % 13 = 0 THEN 1 ELSE 0 END) AS chapter_id, ms,
              CASE e % 5 WHEN 0 THEN 'DUPLICATE' WHEN 1 THEN 'CONFLICTING' ELSE 'SUPPORTING' END AS relation FROM ev WHERE t = 'click'),
sh AS (SELECT o.run_id, o.observation_id, o.chapter_id, o.e AS oe, f.n, f.frame_id, f.e, f.ms FROM ob o JOIN fr f ON f.run_id = o.run_id AND f.ch = o.ch),
os AS (SELECT run_id, observation_id, min(ms) AS start_ms, CASE WHEN any_value(oe) % 7 = 0 THEN max(ms) ELSE max(ms) + 1 END AS end_ms FROM sh GROUP BY ALL),
chs AS (SELECT DISTINCT run_id, ch, 'ch_' || ch AS node_id, ch * {CHAPTER_MS} AS start_ms, (ch + 1) * {CHAPTER_MS} AS end_ms FROM ev),
nd AS (SELECT run_id, node_id, 'CHAPTER' AS kind, start_ms, end_ms FROM chs UNION ALL SELECT run_id, frame_id, 'KEYFRAME', ms, ms + 1 FROM fr UNION ALL SELECT run_id, observation_id, 'OBSERVATION', start_ms, end_ms FROM os
       UNION ALL SELECT run_id, 'sp_' || e, CASE WHEN e % 15 = 0 THEN 'SUBTITLE' ELSE 'SPEECH' END, ms, ms + CAST(floor(value * 1000) AS BIGINT) * 600 FROM ev WHERE t = 'purchase' UNION ALL SELECT run_id, 'si_' || e, 'SILENCE', ms, ms + 1 FROM ev WHERE t = 'signup'),
ed AS (SELECT run_id, chapter_id AS owner_id, 'CHAPTER_OBSERVATION' AS role, observation_id AS ref_id FROM ob SEMI JOIN os USING (run_id, observation_id)
       UNION ALL SELECT run_id, observation_id, 'SHOWN_FRAME', frame_id FROM sh UNION ALL SELECT run_id, chapter_id, 'CHAPTER_FRAME', frame_id FROM sh
       UNION ALL SELECT run_id, 'ch_' || ch, 'CHAPTER_TRANSCRIPT', CASE WHEN t = 'signup' THEN 'si_' WHEN e % 17 = 0 THEN 'gone_' ELSE 'sp_' END || e FROM ev WHERE t = 'purchase' OR (t = 'signup' AND e % 10 = 0)),
ct AS (SELECT run_id, observation_id, 'c' || e AS content_id, n, frame_id, e FROM sh WHERE e % 2 = 0),
oc AS (SELECT run_id, observation_id, coalesce(list('c' || e ORDER BY n) FILTER (e % 2 = 0), []) AS content_ids FROM sh GROUP BY ALL),
bk AS (SELECT o.run_id, 'ch_' || o.ch AS chapter_id, 'b_' || o.e AS block_id, o.e AS position, CASE WHEN o.e % 19 = 0 THEN 'kf_1' ELSE o.observation_id END AS observation_ref, o.observation_id, o.relation, o.props, o.e,
       CASE WHEN o.e % 9 = 0 THEN [] ELSE coalesce((SELECT list(content_id ORDER BY n) FROM ct WHERE ct.run_id = o.run_id AND ct.observation_id = o.observation_id AND ct.e % 4 = 0), []) END AS chosen FROM ob o SEMI JOIN os USING (run_id, observation_id)),
re AS (SELECT a.run_id, a.ch, CASE WHEN b.e % 11 = 0 THEN b.frame_id ELSE a.frame_id END AS x, CASE WHEN b.e % 11 = 0 THEN a.frame_id ELSE b.frame_id END AS y FROM fr a JOIN fr b ON a.run_id = b.run_id AND a.ch = b.ch AND b.n = a.n + 1 WHERE b.e % 6 <> 0),
rl AS (SELECT o.run_id, o.observation_id, x, y FROM ob o JOIN re USING (run_id, ch)),
nm AS (SELECT b.run_id, b.chapter_id, b.block_id, b.position, c.frame_id, c.n FROM bk b JOIN ct c ON c.run_id = b.run_id AND c.observation_id = b.observation_ref AND list_contains(b.chosen, c.content_id)),
so AS (SELECT * FROM nm UNION ALL SELECT b.run_id, b.chapter_id, b.block_id, b.position, s.frame_id, s.n FROM bk b JOIN sh s ON s.run_id = b.run_id AND s.observation_id = b.observation_ref WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.run_id = b.run_id AND nm.block_id = b.block_id))"""


class Document:
    """The tables of the graph; events and what is shown are read and joined once and kept as stages."""

    def __init__(self, t) -> None:
        ms = epoch_ms(F.col("ts")) - EPOCH_2024_MS
        e = F.col("event_id")
        self.events = checkpoint(t.events.select(F.col("user_id").alias("run_id"), e.alias("e"), F.col("event_type").alias("t"), "value", "props", ms.alias("ms"), F.floor(ms / CHAPTER_MS).cast("bigint").alias("ch")))
        e = F.col("e")
        named = lambda prefix: F.concat(F.lit(prefix), e)
        at = lambda c: F.concat(F.lit("ch_"), c)
        seen = self.events.where("t = 'view'").select("run_id", "ch", "e", F.col("ms").alias("timestamp_ms"), named("kf_").alias("frame_id"))
        day = F.floor(F.col("timestamp_ms") / 86_400_000)
        self.frames = checkpoint(ordered_scan(seen, ["run_id", "ch"], ["timestamp_ms", "e"], day, [Scan("n", "count_before"), Scan("before", "lag", "frame_id")]))
        clicks = self.events.where("t = 'click'")
        relation = F.when(e % 5 == 0, "DUPLICATE").when(e % 5 == 1, "CONFLICTING").otherwise("SUPPORTING")
        marked = clicks.select("run_id", "ch", "e", "props", named("ob_").alias("observation_id"), at(F.col("ch") + F.when(e % 13 == 0, 1).otherwise(0)).alias("chapter_id"), relation.alias("relation"))
        frame = self.frames.select("run_id", "ch", F.col("n").alias("frame_position"), "frame_id", F.col("e").alias("fe"), "timestamp_ms")
        self.shown = checkpoint(marked.join(frame, ["run_id", "ch"]))
        self.observations = self.shown.groupBy("run_id", "ch", "observation_id", "e", "chapter_id", "relation", "props").agg(
            F.min("timestamp_ms").alias("start_ms"), (F.max("timestamp_ms") + F.when(e % 7 == 0, 0).otherwise(1)).alias("end_ms"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("fe") % 2 == 0, F.struct("frame_position", F.concat(F.lit("c"), "fe").alias("c"))))), lambda r: r["c"]).alias("content_ids"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("fe") % 4 == 0, F.struct("frame_position", F.concat(F.lit("c"), "fe").alias("c"))))), lambda r: r["c"]).alias("marked_ids"))
        self.blocks = self.observations.select(
            "run_id", at(F.col("ch")).alias("chapter_id"), F.concat(F.lit("b_"), e).alias("block_id"), e.alias("position"), F.when(e % 19 == 0, "kf_1").otherwise(F.col("observation_id")).alias("observation_ref"),
            F.when(e % 9 == 0, F.array().cast("array<string>")).otherwise(F.col("marked_ids")).alias("content_refs"), "e", "observation_id", "props")
        self.contents = self.shown.where("fe % 2 = 0").select("run_id", "observation_id", F.concat(F.lit("c"), "fe").alias("content_id"), F.lit(0).alias("source_position"), "frame_id")

    def nodes(self):
        seen = self.events.where("t IN ('purchase', 'signup')").select(
            "run_id", F.concat(F.when(F.col("t") == "signup", "si_").otherwise("sp_"), "e").alias("node_id"),
            F.when(F.col("t") == "signup", "SILENCE").when(F.col("e") % 15 == 0, "SUBTITLE").otherwise("SPEECH").alias("kind"), F.col("ms").alias("start_ms"),
            (F.col("ms") + F.when(F.col("t") == "signup", 1).otherwise(F.floor(F.col("value") * 1000) * 600)).alias("end_ms"))
        chapters = self.events.select("run_id", "ch").distinct().select(
            "run_id", F.concat(F.lit("ch_"), "ch").alias("node_id"), F.lit("CHAPTER").alias("kind"), (F.col("ch") * CHAPTER_MS).alias("start_ms"), ((F.col("ch") + 1) * CHAPTER_MS).alias("end_ms"))
        frames = self.frames.select("run_id", F.col("frame_id").alias("node_id"), F.lit("KEYFRAME").alias("kind"), F.col("timestamp_ms").alias("start_ms"), (F.col("timestamp_ms") + 1).alias("end_ms"))
        observations = self.observations.select("run_id", F.col("observation_id").alias("node_id"), F.lit("OBSERVATION").alias("kind"), "start_ms", "end_ms")
        return checkpoint(chapters.unionByName(frames).unionByName(observations).unionByName(seen))

    def edges(self):
        edge = lambda rows, owner, role, ref: rows.select("run_id", owner.alias("owner_id"), F.lit(role).alias("role"), ref.alias("ref_id"))
        spoken = self.events.where("t = 'purchase' OR (t = 'signup' AND e % 10 = 0)")
        prefix = F.when(F.col("t") == "signup", "si_").when(F.col("e") % 17 == 0, "gone_").otherwise("sp_")
        return (
            edge(self.observations, F.col("chapter_id"), "CHAPTER_OBSERVATION", F.col("observation_id")).unionByName(edge(self.shown, F.col("observation_id"), "SHOWN_FRAME", F.col("frame_id")))
            .unionByName(edge(self.shown, F.col("chapter_id"), "CHAPTER_FRAME", F.col("frame_id"))).unionByName(edge(spoken, F.concat(F.lit("ch_"), "ch"), "CHAPTER_TRANSCRIPT", F.concat(prefix, "e"))))

    def relations(self):
        turned = F.col("e") % 11 == 0
        linked = self.frames.where("before IS NOT NULL AND e % 6 <> 0").select(
            "run_id", "ch", F.when(turned, F.col("frame_id")).otherwise(F.col("before")).alias("from_frame"), F.when(turned, F.col("before")).otherwise(F.col("frame_id")).alias("to_frame"))
        clicks = self.events.where("t = 'click'").select("run_id", "ch", F.concat(F.lit("ob_"), "e").alias("observation_id"))
        return clicks.join(linked, ["run_id", "ch"]).drop("ch")

    def sources(self):
        return checkpoint(graph.chosen_sources(self.blocks, self.contents, self.shown.select("run_id", "observation_id", "frame_position", "frame_id")))


@query("v3_reference_graph", f"""
WITH {_GRAPH}, al AS (SELECT * FROM (VALUES ('CHAPTER_OBSERVATION', 'OBSERVATION'), ('CHAPTER_FRAME', 'KEYFRAME'), ('SHOWN_FRAME', 'KEYFRAME'), ('CHAPTER_TRANSCRIPT', 'SPEECH'), ('CHAPTER_TRANSCRIPT', 'SUBTITLE')) AS a(role, kind)),
v AS (SELECT ed.*, CASE WHEN o.node_id IS NULL THEN 'UNKNOWN_OWNER' WHEN r.node_id IS NULL THEN 'UNKNOWN_REFERENCE' WHEN (ed.role, r.kind) NOT IN (SELECT (role, kind) FROM al) THEN 'TYPE_MISMATCH'
             WHEN r.start_ms < o.start_ms OR r.end_ms > o.end_ms THEN 'OUTSIDE_OWNER' END AS rule
      FROM ed LEFT JOIN nd o ON o.run_id = ed.run_id AND o.node_id = ed.owner_id LEFT JOIN nd r ON r.run_id = ed.run_id AND r.node_id = ed.ref_id)
SELECT CAST(run_id AS VARCHAR) AS run_id, rule, owner_id AS entity_id, ref_id, role AS detail FROM v WHERE rule IS NOT NULL""")
def _(t):
    document = Document(t)
    return graph.reference_violations(document.edges(), document.nodes())


@query("v7_visual_blocks", f"""
WITH {_GRAPH}, b AS (SELECT bk.*, CASE WHEN e % 10 = 3 THEN [observation_id, 'x'] ELSE [observation_id] END AS refs, CASE WHEN e % 29 = 0 THEN list_append(chosen, 'c-1') ELSE chosen END AS picked, CASE WHEN e % 3 = 0 THEN 'other' ELSE props END AS caption FROM bk),
v AS (SELECT b.*, CASE WHEN len(refs) <> 1 OR refs[1] <> observation_ref THEN 'BOUND_TO_OTHERS' WHEN oc.observation_id IS NULL THEN 'NOT_AN_OBSERVATION' WHEN len(content_ids) > 0 AND len(picked) = 0 THEN 'CONTENT_MISSING'
   WHEN len(content_ids) = 0 AND len(picked) > 0 THEN 'CONTENT_OF_EMPTY_OBSERVATION' WHEN NOT list_has_all(content_ids, picked) THEN 'CONTENT_UNKNOWN' WHEN relation = 'DUPLICATE' THEN 'DUPLICATE_SHOWN' WHEN relation = 'CONFLICTING' AND caption <> props THEN 'CONFLICT_CAPTION' END AS r
   FROM b LEFT JOIN oc ON oc.run_id = b.run_id AND oc.observation_id = b.observation_ref)
SELECT {_row('VISUAL_BLOCK', 'run_id', 'block_id', 'observation_ref', 'r')} FROM v WHERE r IS NOT NULL""")
def _(t):
    document = Document(t)
    e = F.col("e")
    refs = F.when(e % 10 == 3, F.array("observation_id", F.lit("x"))).otherwise(F.array("observation_id"))
    picked = F.when(e % 29 == 0, F.array_append("content_refs", F.lit("c-1"))).otherwise(F.col("content_refs"))
    blocks = document.blocks.select("run_id", "block_id", "observation_ref", refs.alias("evidence_refs"), picked.alias("content_refs"), F.when(e % 3 == 0, "other").otherwise(F.col("props")).alias("caption"))
    known = document.observations.select("run_id", "observation_id", F.lit("OBSERVATION").alias("kind"), "relation", F.col("props").alias("caption"), "content_ids")
    return graph.visual_block_violations(blocks, known)


@query("v8_frame_relations", f"""
WITH {_GRAPH} SELECT {_row('RELATION_BACKWARD', 'rl.run_id', 'observation_id', 'x', 'y')} FROM rl JOIN fr a ON a.run_id = rl.run_id AND a.frame_id = x JOIN fr b ON b.run_id = rl.run_id AND b.frame_id = y WHERE a.ms >= b.ms
UNION ALL SELECT {_row('ORPHAN_KEYFRAME', 'fr.run_id', 'fr.frame_id')} FROM fr ANTI JOIN sh USING (run_id, frame_id)""")
def _(t):
    document = Document(t)
    frames = document.frames.select("run_id", "frame_id", "timestamp_ms")
    return graph.backward_relations(document.relations(), frames).unionByName(graph.orphan_frames(frames, document.shown))


@query("v8_frames_connected", f"""
WITH RECURSIVE {_GRAPH}, sf AS (SELECT DISTINCT run_id, block_id, frame_id FROM so),
li AS (SELECT DISTINCT b.run_id, b.block_id, x AS a, y AS b FROM bk b JOIN rl ON rl.run_id = b.run_id AND rl.observation_id = b.observation_ref
       SEMI JOIN sf p ON p.run_id = b.run_id AND p.block_id = b.block_id AND p.frame_id = x SEMI JOIN sf q ON q.run_id = b.run_id AND q.block_id = b.block_id AND q.frame_id = y),
lk AS (SELECT run_id, block_id, a, b FROM li UNION ALL SELECT run_id, block_id, b, a FROM li),
rc AS (SELECT run_id, block_id, frame_id AS v, frame_id AS w FROM sf UNION SELECT rc.run_id, rc.block_id, rc.v, lk.b FROM rc JOIN lk ON lk.run_id = rc.run_id AND lk.block_id = rc.block_id AND lk.a = rc.w),
rt AS (SELECT run_id, block_id, v, min(w) AS root FROM rc GROUP BY ALL), pt AS (SELECT run_id, block_id, count(DISTINCT root) AS parts FROM rt GROUP BY ALL)
SELECT {_row('FRAMES_UNRELATED', 'run_id', 'block_id', detail='parts')} FROM pt WHERE parts > 1""")
def _(t):
    document = Document(t)
    return graph.unrelated_sources(document.sources(), document.blocks, document.relations())


@query("v8_rebuilt_keyframes", f"""
WITH {_GRAPH}, first AS (SELECT run_id, chapter_id, frame_id, min((position, n)) AS place FROM so GROUP BY ALL), bu AS (SELECT run_id, chapter_id, frame_id, row_number() OVER (PARTITION BY run_id, chapter_id ORDER BY place) AS n FROM first),
gi AS (SELECT run_id, 'ch_' || ch AS chapter_id, frame_id, row_number() OVER (PARTITION BY run_id, ch ORDER BY ms, e) AS n FROM fr WHERE e % 4 = 0),
d AS (SELECT run_id, chapter_id, min(n) AS n FROM bu FULL JOIN gi USING (run_id, chapter_id, n) WHERE bu.frame_id IS DISTINCT FROM gi.frame_id GROUP BY ALL)
SELECT {_row('KEYFRAMES_DIFFER', 'run_id', 'chapter_id', detail='n')} FROM d""")
def _(t):
    document = Document(t)
    declared = document.frames.where("e % 4 = 0").select("run_id", F.concat(F.lit("ch_"), "ch").alias("chapter_id"), F.struct("timestamp_ms", "e").alias("position"), "frame_id")
    return graph.rebuilt_selection(document.sources(), declared)


@query("v8_unreached_evidence", f"""
WITH RECURSIVE {_GRAPH}, rc AS (SELECT run_id, node_id FROM nd WHERE kind = 'CHAPTER' UNION SELECT ed.run_id, ed.ref_id FROM rc JOIN ed ON ed.run_id = rc.run_id AND ed.owner_id = rc.node_id WHERE ed.role <> 'CHAPTER_FRAME')
SELECT {_row('UNREACHED', 'nd.run_id', 'nd.node_id', detail='nd.kind')} FROM nd ANTI JOIN rc ON rc.run_id = nd.run_id AND rc.node_id = nd.node_id""")
def _(t):
    document = Document(t)
    nodes = document.nodes()
    return graph.unreached(nodes, nodes.where("kind = 'CHAPTER'"), document.edges().where("role <> 'CHAPTER_FRAME'"))
