"""Queries of annotation and judgment rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.operators import annotations
from spanledger.plans.catalog import query
from spanledger.plans.rules import _row


@query("v18_annotation_rules", f"""
WITH b AS (SELECT l_orderkey AS sample_id, l_linenumber AS position, CAST(l_quantity AS BIGINT) * 1000 - 2000 AS at_ms, lag(CAST(l_quantity AS BIGINT) * 1000 - 2000) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before_ms FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)),
f AS (SELECT l_orderkey AS sample_id, l_suppkey AS fact_id FROM lineitem WHERE l_returnflag <> 'R'), k AS (SELECT l_orderkey AS sample_id, l_suppkey AS fact_id FROM lineitem WHERE l_quantity >= 25),
v AS (SELECT l_orderkey AS sample_id, l_partkey AS frame_id, CAST(floor(l_extendedprice) AS BIGINT) AS timestamp_ms FROM lineitem)
SELECT {_row('BOUNDARY_OUTSIDE', 'sample_id', 'position', detail='at_ms')} FROM b WHERE at_ms < 0 OR at_ms >= 40000
UNION ALL SELECT {_row('BOUNDARY_ORDER', 'sample_id', 'position', detail='at_ms')} FROM b WHERE at_ms <= before_ms
UNION ALL SELECT {_row('FRAME_AFTER_END', 'sample_id', 'frame_id', detail='timestamp_ms')} FROM v WHERE timestamp_ms >= 40000
UNION ALL SELECT {_row('FRAME_REPEATED', 'sample_id', 'frame_id', detail='count(*)')} FROM v GROUP BY sample_id, frame_id HAVING count(*) > 1
UNION ALL SELECT {_row('FACT_REPEATED', 'sample_id', 'fact_id', detail='count(*)')} FROM f GROUP BY sample_id, fact_id HAVING count(*) > 1
UNION ALL SELECT {_row('KEY_FACT_REPEATED', 'sample_id', 'fact_id', detail='count(*)')} FROM k GROUP BY sample_id, fact_id HAVING count(*) > 1
UNION ALL SELECT {_row('KEY_FACT_UNKNOWN', 'sample_id', 'fact_id')} FROM (SELECT DISTINCT * FROM k EXCEPT SELECT * FROM f)""")
def _(t):
    lines = t.lineitem.withColumn("sample_id", F.col("l_orderkey"))
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity"))["l_quantity"]
    boundaries = lines.groupBy("sample_id", F.col("l_linenumber").alias("position")).agg((first.cast("bigint") * 1000 - 2000).alias("at_ms"))
    samples = lines.select("sample_id").distinct().withColumn("duration_ms", F.lit(40_000))
    frames = lines.select("sample_id", F.col("l_partkey").alias("frame_id"), F.floor("l_extendedprice").cast("bigint").alias("timestamp_ms"))
    facts = lines.where("l_returnflag <> 'R'").select("sample_id", F.col("l_suppkey").alias("fact_id"))
    return annotations.annotation_rules(samples, boundaries, frames, facts, lines.where("l_quantity >= 25").select("sample_id", F.col("l_suppkey").alias("fact_id")))


@query("v19_hint_references", f"""
WITH p AS (SELECT conv_id * 10 + turn // 2 AS pair_id, sha256(left(text, 1)) AS d FROM conversations)
SELECT {_row('HINT_REFERENCE', 'pair_id', 'pair_id')} FROM p GROUP BY pair_id HAVING min(d) <> max(d)""")
def _(t):
    pair = F.col("conv_id") * 10 + F.floor(F.col("turn") / 2)
    return annotations.hint_reference_rules(t.conversations.select(pair.alias("pair_id"), F.sha2(F.left("text", F.lit(1)), 256).alias("reference_sha256")))


@query("v20_judgment_rules", f"""
WITH m AS (SELECT l_orderkey AS sample_id, l_suppkey AS fact_id FROM lineitem WHERE l_suppkey % 3 <> 0), k AS (SELECT l_orderkey AS sample_id, l_suppkey AS fact_id FROM lineitem WHERE l_quantity >= 15),
n AS (SELECT c_nationkey AS sample_id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE lower(left(c_name, 9)) || c_custkey % 40 END AS name FROM customer), a AS (SELECT DISTINCT c_nationkey AS sample_id, lower(left(c_name, 9)) || c_custkey % 7 AS name FROM customer)
SELECT {_row('KEY_FACT_UNKNOWN', 'sample_id', 'fact_id')} FROM (SELECT DISTINCT * FROM m EXCEPT SELECT * FROM k)
UNION ALL SELECT {_row('KEY_FACT_REPEATED', 'sample_id', 'fact_id', detail='count(*)')} FROM m GROUP BY sample_id, fact_id HAVING count(*) > 1
UNION ALL SELECT {_row('NAME_BLANK', 'sample_id', 'name')} FROM n WHERE name = ''
UNION ALL SELECT {_row('NAME_REPEATED', 'sample_id', 'name', detail='count(*)')} FROM n WHERE name <> '' GROUP BY sample_id, name HAVING count(*) > 1
UNION ALL SELECT {_row('NAME_IS_KNOWN', 'sample_id', 'name')} FROM (SELECT DISTINCT * FROM n SEMI JOIN a USING (sample_id, name))""")
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), F.col("l_suppkey").alias("fact_id"), "l_quantity")
    name = lambda n: F.concat(F.left("c_name", F.lit(9)), F.col("c_custkey") % n)
    people = t.customer.select(F.col("c_nationkey").alias("sample_id"), "c_custkey", "c_name")
    fabricated = people.select("sample_id", F.when(F.col("c_custkey") % 11 == 0, "  ").otherwise(name(40)).alias("name"))
    aliases = people.select("sample_id", F.concat(F.lit(" "), F.upper(name(7)), F.lit("\t")).alias("name"))
    return annotations.judgment_rules(lines.where("fact_id % 3 <> 0"), lines.where("l_quantity >= 15"), fabricated, aliases)
