"""Mixtures of sources by a low-discrepancy schedule of slots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.session import checkpoint

#: Points lie on a lattice of 2**BITS places; STEP is the place nearest to the golden ratio's part of it, and odd, so every place is met once a round.
BITS = 31
STEP = 1_327_217_885
#: Places of one cell of the table that maps points to sources.
CELL = 15
#: Bits of the shuffling hash.
HASH = 60
#: Slots of one slice of the schedule, rows of one slice of a source, copies of a row that are listed together.
SLOTS = 4096
ROWS = 50_000
COPIES = 4096


def word_count(text: Column) -> Column:
    """Number of stretches without white space; each is replaced by one letter, so no array of words is built."""
    blank = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"
    marks = F.regexp_replace(text, f"{blank}*+{word}++{blank}*+", "x")
    return F.when(F.coalesce(text.rlike(word), F.lit(False)), F.length(marks)).otherwise(0).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, ordinal, source_size, target) of every source of ``sized`` (source, size).

    Sources in order of their code points, null last, weigh ``weights`` in turn and share ``share`` times the
    size of all. A target stops at ``most`` times its source's size and what is above is shared again by weight until
    none is above: with sources sorted by the level at which they fill, one running sum finds the last that does.
    The windows run over one row per source, after aggregation.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("ordinal") % len(weights) + 1)
    cap = F.col("source_size") * most
    by_level = Window.orderBy("fills_at", "ordinal")
    levels = (
        numbered.withColumn("weight", weight).withColumn("cap", cap).withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(Window.partitionBy()) * share)
        .withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("ahead", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("ahead") <= F.col("weight") * (F.col("all") - F.col("before")))
    )
    whole = Window.partitionBy()
    level = (F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    return levels.withColumn("level", level).select("source", "ordinal", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, ordinal, rank): the source of every slot and the slot's number among those of its source.

    Slot k stands at point k * STEP of the lattice, the golden-ratio sequence in whole numbers, and belongs to the source in whose part of the
    cumulative targets the point lies; after any number of slots each source has had its share but for a few. Points
    and parts meet by an equality join on cells. Ranks are counts within slices of ``SLOTS`` slots on top of the counts of the slices before.
    A source too thin to meet a point gets one slot after the others. ``sources`` has (ordinal, target).
    """
    places = 1 << BITS
    total = F.sum("target").over(Window.partitionBy())
    reach = F.sum("target").over(Window.orderBy("ordinal"))
    parts = (
        sources.withColumn("high", F.least(F.floor(reach / total * places), F.lit(places)).cast("bigint"))
        .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("ordinal")), F.lit(0))).filter("low < high")
    )
    cells = parts.select("ordinal", "low", "high", F.explode(F.sequence(F.shiftright("low", CELL), F.shiftright(F.col("high") - 1, CELL))).alias("cell"))
    point = F.col("slot").bitwiseAND(places - 1) * STEP
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot")).withColumn("point", point.bitwiseAND(places - 1)).withColumn("cell", F.shiftright("point", CELL))
    met = points.join(cells, "cell").filter("low <= point AND point < high").select("slot", "ordinal", F.floor(F.col("slot") / SLOTS).alias("slice"))
    counts = checkpoint(met.groupBy("ordinal", "slice").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ordinal").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("ordinal", "slice", before.alias("start"))
    within = F.row_number().over(Window.partitionBy("ordinal", "slice").orderBy("slot")) - 1
    ranked = met.withColumn("within", within).join(starts, ["ordinal", "slice"]).select("slot", "ordinal", (F.col("start") + F.col("within")).alias("rank"))
    thin = sources.filter("target > 0").join(counts, "ordinal", "left_anti")
    return ranked.unionByName(thin.select((F.col("ordinal") + slots).cast("bigint").alias("slot"), "ordinal", F.lit(0).cast("bigint").alias("rank")))


def _expanded(rows: DataFrame, times: str) -> DataFrame:
    """Every row ``times`` times with its number ``copy``, listed ``COPIES`` at a time."""
    first = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1, F.lit(COPIES).cast("bigint"))))
    return first.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES - 1, F.col(times) - 1)))).drop("from")


def place_documents(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The shuffled documents of every source on one line of words, and the sources.

    Rows: (ordinal, id, size, start), where ``start`` counts the words of the documents before it in its source in order of a
    seeded hash of the id. Equal rows are counted together before anything is ordered, and each source is cut into slices of the hash of about ``ROWS`` rows,
    so neither a large source nor a row repeated without end stays in one task. Documents without a word have a null ``start``.
    """
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, HASH // 4), 16, 10)
    rows = checkpoint(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hashed.cast("bigint").alias("h"))
        .groupBy("source", "h", "id", "size").agg(F.count("*").alias("times"))
    )
    sources = checkpoint(source_targets(rows.select("source", (F.col("size") * F.col("times")).alias("size"))))
    placed = rows.join(sources.select(F.col("source").alias("_source"), "ordinal"), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    bits = max(1, math.ceil(math.log2(max(1, rows.count()) / ROWS + 1)))
    cut = placed.filter("size > 0").withColumn("slice", F.shiftright("h", HASH - bits))
    words = F.sum(F.col("size") * F.col("times"))
    per = cut.groupBy("ordinal", "slice").agg(words.alias("words"))
    earlier = Window.partitionBy("ordinal").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("ordinal", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("ordinal", "slice").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = cut.withColumn("within", F.coalesce(words.over(inside), F.lit(0))).join(starts, ["ordinal", "slice"])
    lined = _expanded(begun, "times").select("ordinal", "id", "size", (F.col("base") + F.col("within") + F.col("copy") * F.col("size")).alias("start"))
    empty = _expanded(placed.filter("size = 0"), "times").select("ordinal", "id", "size", F.lit(None).cast("bigint").alias("start"))
    return checkpoint(lined.unionByName(empty)), sources


def mix(placed: DataFrame, sources: DataFrame, block_words: int = 1024) -> DataFrame:
    """The mixture: (slot, ordinal, id, start, first, stop), stretches of documents in the order of slots.

    A source gives the words of its line up to its target, going over it again where the target is above its size. They
    are cut into blocks of equal words, one for each slot of the source (about ``block_words``; the last may be shorter), and block r goes to
    the slot of rank r. ``first`` and ``stop`` are the words of the document, counted from 0, that the slot takes; ``start`` tells documents of a source apart.
    """
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    slots = checkpoint(schedule(sources, math.ceil(total / block_words)))
    taken = F.floor(F.col("target") + 0.5).cast("bigint")
    lines = (
        sources.select("ordinal", "source_size", taken.alias("words")).filter("words > 0").join(slots.groupBy("ordinal").agg(F.count("*").alias("slots")), "ordinal")
        .select("ordinal", "source_size", "words", F.ceil(F.col("words") / F.col("slots")).alias("block"))
    )
    passes = placed.filter("start IS NOT NULL").join(lines, "ordinal").withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    begin = F.col("start") + F.col("pass") * F.col("source_size")
    ranges = passes.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words"))).filter("begin < end")
    blocks = ranges.withColumn("rank", F.explode(F.sequence(F.expr("begin div block"), F.expr("(end - 1) div block"))))
    pieces = blocks.select(
        "ordinal", "rank", "id", "start", (F.greatest("begin", F.col("rank") * F.col("block")) - F.col("begin")).alias("first"),
        (F.least("end", (F.col("rank") + 1) * F.col("block")) - F.col("begin")).alias("stop"),
    )
    return pieces.join(slots, ["ordinal", "rank"]).select("slot", "ordinal", "id", "start", "first", "stop")


def mixed_documents(docs: DataFrame, block_words: int = 1024, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every row: the words that the mixture takes of it, repeats counted.

    A null text has size 0, a null source is a source of its own, null and repeated ids are ordinary rows, equal rows each
    get a line, and an empty table gives none. Other columns of ``docs`` are not read, so their names cannot clash. Nothing is taken of a row more than twice.
    """
    placed, sources = place_documents(docs, seed, id_col, text_col, source_col)
    sums = mix(placed, sources, block_words).groupBy("ordinal", "start").agg(F.sum(F.col("stop") - F.col("first")).alias("taken"))
    known = sources.select("ordinal", "source_size", "target")
    return placed.join(sums, ["ordinal", "start"], "left").join(known, "ordinal").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))
