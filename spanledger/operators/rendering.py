"""Markdown of video, audio and image documents whose bodies hold blocks of every type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as tx

#: A body block, tagged by ``kind``; each kind uses the fields named here and leaves the others null.
#: PARAGRAPH, QUOTE, VISUAL, DESCRIPTION and other image contents: text. BULLET_LIST: items. CODE: text, language. TABLE: columns, cells. FORMULA: text, note.
BLOCK = {
    "kind": "string", "text": "string", "items": "array<string>", "language": "string", "columns": "array<string>", "cells": "array<array<string>>", "note": "string",
}
# Headings and placeholder texts of a document.
OVERVIEW, NO_OVERVIEW, CONTENTS, CONCLUSIONS = "核心概览", "未提供核心概览。", "目录", "本章结论"
PICTURE, FINDINGS, TIME, SHOWN = "图片内容", "关键结论", "时间：", "**视觉补充：** "
LINE_END = r"[[^ -~]&&[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]](?:(?<=\r)\n)?"


def block(kind: Column, **fields: Column) -> Column:
    """A block value; fields that are not given are null."""
    given = {"kind": kind} | fields
    return F.struct(*[given.get(name, F.lit(None)).cast(kind_of).alias(name) for name, kind_of in BLOCK.items()])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines of a text; a line end at its end starts no further line."""
    return _bound(F.split(text, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def even_line_ends(text: Column) -> Column:
    """The lines of a text, joined by line feeds."""
    return F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), r"\n\z", "")


def _joined(lines: Column, separator: str = "\n") -> Column:
    return F.array_join(lines, separator)


def _listed(lines: Column) -> Column:
    """Lines followed by an empty one, the last line end left to whatever follows."""
    return _bound(lines, lambda x: F.when(F.size(x) > 0, F.concat(_joined(x), F.lit("\n"))).otherwise(""))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), _joined(cells, " | "), F.lit(" |"))


def _table(b: Column, cell: Callable[[Column], Column]) -> Column:
    rule = F.transform(b["columns"], lambda _: F.lit("---"))
    rows = F.transform(b["cells"], lambda r: _row(F.transform(r, cell)))
    return _listed(F.concat(F.array(_row(F.transform(b["columns"], cell)), _row(rule)), rows))


def _language(b: Column) -> Column:
    return F.regexp_replace(F.coalesce(b["language"], F.lit("")), r"[^A-Za-z0-9_+.-]", "")


def _by_kind(b: Column, generators: dict[str, Column]) -> Column:
    out = None
    for kind, lines in generators.items():
        out = F.when(b["kind"] == kind, lines) if out is None else out.when(b["kind"] == kind, lines)
    return out


def video_block(b: Column) -> Column:
    """Lines of a block of a video document, joined; a block of an unknown kind is null and takes no line."""
    esc = tx.escape_markdown
    fence = tx.code_fence(b["text"])
    return _by_kind(b, {
        "PARAGRAPH": F.concat(esc(b["text"]), F.lit("\n")),
        "BULLET_LIST": _listed(F.transform(b["items"], lambda x: F.concat(F.lit("- "), F.replace(esc(x), F.lit("\n"), F.lit("\n  "))))),
        "QUOTE": _listed(F.transform(lines_of(esc(b["text"])), lambda x: F.concat(F.lit("> "), x))),
        "CODE": F.concat(fence, _language(b), F.lit("\n"), b["text"], F.lit("\n"), fence, F.lit("\n")),
        "TABLE": _table(b, lambda c: F.replace(esc(c), F.lit("\n"), F.lit(" / "))),
        "FORMULA": F.concat(F.lit("$$\n"), tx.escape_html(b["text"]), F.lit("\n$$\n"), F.when(F.length(b["note"]) > 0, F.concat(esc(b["note"]), F.lit("\n"))).otherwise("")),
        "VISUAL": F.concat(F.lit(SHOWN), esc(b["text"]), F.lit("\n")),
    })


def audio_text(text: Column) -> Column:
    """Prose of an audio document: evidence ids removed, escaped, line ends made equal."""
    return tx.escape_markdown(even_line_ends(tx.clean_markers(text)))


def audio_block(b: Column) -> Column:
    """Lines of a block of an audio document; code keeps a plain fence and a formula its text."""
    return _by_kind(b, {
        "PARAGRAPH": F.concat(audio_text(b["text"]), F.lit("\n")),
        "BULLET_LIST": _listed(F.transform(b["items"], lambda x: F.concat(F.lit("- "), audio_text(x)))),
        "QUOTE": _listed(F.transform(lines_of(b["text"]), lambda x: F.concat(F.lit("> "), audio_text(x)))),
        "CODE": F.concat(F.lit("```"), _language(b), F.lit("\n"), b["text"], F.lit("\n```\n")),
        "TABLE": _table(b, audio_text),
        "FORMULA": F.concat(F.lit("$$\n"), b["text"], F.lit("\n$$\n")),
    })


def _ordinal(index: Column, numeral: Callable[[Column], Column]) -> Column:
    return F.concat(F.lit("第"), F.coalesce(numeral(index), index.cast("string")), F.lit("章："))


def _clock(chapter: str = "") -> Column:
    return F.concat(tx.clock(F.col(f"{chapter}start_ms")), F.lit(" - "), tx.clock(F.col(f"{chapter}end_ms")))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, tx.UNICODE_SPACE + "+", " "))


def chapter_bodies(blocks: DataFrame, claims: DataFrame, keys: list[str], lines: Callable[[Column], Column], escape: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Per chapter: the rendered body with the prose it holds, and the rendered conclusions.

    Blocks are rendered one by one before anything is grouped; a chapter is one ordered aggregation over its blocks.
    """
    b = F.col("block")
    prose = F.when(b["kind"].isin("PARAGRAPH", "QUOTE"), b["text"])
    rendered = blocks.select(*keys, "position", lines(b).alias("line"), prose.alias("prose"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "line", "prose")))
    bodies = rendered.groupBy(*keys).agg(ordered.alias("b")).select(
        *keys, _joined(F.transform("b", lambda r: r["line"])).alias("body"), _joined(F.transform("b", lambda r: r["prose"]), " ").alias("prose"))
    points = claims.select(*keys, "pos", F.concat(F.lit("- "), escape(F.col("text"))).alias("line"))
    ends = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("c")).select(
        *keys, F.concat(F.lit(f"#### {CONCLUSIONS}\n\n"), _joined(F.transform("c", lambda r: r["line"])), F.lit("\n")).alias("conclusions"))
    return bodies, ends


def _documents(titles: DataFrame, chapters: DataFrame, bodies: DataFrame, ends: DataFrame, text: Callable[[Column], Column], heading: Callable[[Column, Column], Column], prose: Callable[[Column], Column], brackets: tuple[str, str], no_overview: str, numeral: Callable[[Column], Column]) -> DataFrame:
    """One string per chapter, then one ordered aggregation per document."""
    name = _ordinal(F.col("chapter_index"), numeral)
    stated = (F.length("summary") > 0) & ~F.coalesce((F.length("prose") > 0) & (_spaced(prose(F.col("summary"))) == _spaced(prose(F.col("prose")))), F.lit(False))
    shown = F.col("shown")
    parts = F.array(
        F.concat(F.lit("## "), heading(name, F.col("title")), F.lit("\n")), F.concat(F.lit(TIME), _clock(), F.lit("\n")),
        F.when(shown & stated, F.concat(text(F.col("summary")), F.lit("\n"))), F.when(shown, F.col("body")), F.when(shown, F.col("conclusions")))
    entry = F.concat(F.lit("- "), name, text(F.col("title")), F.lit(brackets[0]), _clock(), F.lit(brackets[1]))
    keys = ["run_id", "chapter_index"]
    told = chapters.join(bodies, keys, "left").join(ends, keys, "left").select("run_id", "chapter_index", entry.alias("entry"), _joined(parts).alias("told"))
    whole = told.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "entry", "told"))).alias("c"))
    head = F.array(
        F.concat(F.lit("# "), text(F.col("title")), F.lit("\n")), F.lit(f"## {OVERVIEW}\n"),
        F.concat(text(F.coalesce(F.nullif("overview", F.lit("")), F.lit(no_overview))), F.lit("\n")), F.lit(f"## {CONTENTS}\n"))
    lines = F.concat(head, F.transform("c", lambda r: r["entry"]), F.array(F.lit("")), F.transform("c", lambda r: r["told"]))
    return titles.join(whole, "run_id").select("run_id", _finished(_joined(lines)).alias("content"))


def _finished(text: Column) -> Column:
    return F.concat(F.rtrim(text, F.lit("\n")), F.lit("\n"))


def render_video(titles: DataFrame, chapters: DataFrame, blocks: DataFrame, claims: DataFrame, numeral: Callable[[Column], Column] = tx.chinese_ordinal) -> DataFrame:
    """(run_id, content) of every run of ``titles`` that has a chapter.

    ``titles``: run_id, title, overview. ``chapters``: run_id, chapter_index (from 1), start_ms, end_ms, title, summary, content_status. ``blocks``: run_id, chapter_index, position,
    block. ``claims``: run_id, chapter_index, pos, text. Only GROUNDED chapters show their summary, body and conclusions. Each input is read once.
    ``numeral`` writes the number of a chapter, or null where the number itself is to stand.
    """
    bodies, ends = chapter_bodies(blocks, claims, ["run_id", "chapter_index"], video_block, tx.escape_markdown)
    told = chapters.withColumn("shown", F.col("content_status") == "GROUNDED")
    return _documents(titles, told, bodies, ends, tx.escape_markdown, lambda name, title: tx.escape_markdown(F.concat(name, title)), lambda c: c, (" （", "）"), NO_OVERVIEW, numeral)


def render_audio(titles: DataFrame, chapters: DataFrame, blocks: DataFrame, claims: DataFrame, numeral: Callable[[Column], Column] = tx.chinese_ordinal) -> DataFrame:
    """As ``render_video`` for audio documents: every chapter is shown, and prose loses evidence ids."""
    bodies, ends = chapter_bodies(blocks, claims, ["run_id", "chapter_index"], audio_block, audio_text)
    return _documents(titles, chapters.withColumn("shown", F.lit(True)), bodies, ends, audio_text, lambda name, title: F.concat(name, audio_text(title)), tx.clean_markers, (" (", ")"), "", numeral)


def render_images(titles: DataFrame, blocks: DataFrame, claims: DataFrame) -> DataFrame:
    """(run_id, content) of every image of ``titles`` (run_id, title, overview): contents under a heading of their kind, then the findings.

    Image texts are kept as they are, as the model of images has no Markdown in them. ``blocks``: run_id, position, block; ``claims``: run_id, pos, text.
    """
    b = F.col("block")
    line = F.when(b["kind"] == "DESCRIPTION", F.concat(b["text"], F.lit("\n"))).otherwise(F.concat(F.lit("### "), b["kind"], F.lit("\n\n"), b["text"], F.lit("\n")))
    ordered = lambda rows, at: rows.groupBy("run_id").agg(_joined(F.transform(F.array_sort(F.collect_list(F.struct(at, "line"))), lambda r: r["line"])).alias("lines"))
    bodies = ordered(blocks.select("run_id", "position", line.alias("line")), "position").withColumnRenamed("lines", "body")
    points = ordered(claims.select("run_id", "pos", F.concat(F.lit("- "), F.col("text")).alias("line")), "pos").withColumnRenamed("lines", "points")
    parts = F.array(
        F.concat(F.lit("# "), F.col("title"), F.lit("\n")), F.lit(f"## {OVERVIEW}\n"), F.concat(F.coalesce(F.nullif("overview", F.lit("")), F.lit(NO_OVERVIEW)), F.lit("\n")),
        F.lit(f"## {PICTURE}\n"), F.col("body"), F.lit(f"## {FINDINGS}\n"), F.col("points"))
    return titles.join(bodies, "run_id", "left").join(points, "run_id", "left").select("run_id", _finished(_joined(parts)).alias("content"))
