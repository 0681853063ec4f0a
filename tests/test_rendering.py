"""Rendered documents of every block type against a plain writer."""

import html
import random
import re

from pyspark.sql import functions as F

from spanledger.functions import text as tx
from spanledger.operators import rendering

BLOCK = "struct<kind:string,text:string,items:array<string>,language:string,columns:array<string>,cells:array<array<string>>,note:string>"


def plain_escape(value):
    marked = re.sub(r"[\\`*_\[\]{}()#|>!]", lambda m: "\\" + m.group(), html.escape(value, quote=True))
    return "\n".join(re.sub(r"^(\s*)(?=[-+*]\s|\d+[.)]\s)", lambda m: m.group() + "\\", line) for line in marked.split("\n"))


def plain_block(kind, text, items, language, columns, cells, note):
    if kind == "PARAGRAPH":
        return [plain_escape(text), ""]
    if kind == "BULLET_LIST":
        return ["- " + plain_escape(x).replace("\n", "\n  ") for x in items] + [""]
    if kind == "QUOTE":
        return ["> " + x for x in plain_escape(text).splitlines()] + [""]
    if kind == "CODE":
        fence = "`" * max([3] + [len(x) + 1 for x in re.findall("`+", text)])
        return [fence + re.sub(r"[^A-Za-z0-9_+.-]", "", language or ""), text, fence, ""]
    if kind == "TABLE":
        row = lambda r: "| " + " | ".join(plain_escape(x).replace("\n", " / ") for x in r) + " |"
        return [row(columns), "| " + " | ".join("---" for _ in columns) + " |", *map(row, cells), ""]
    if kind == "FORMULA":
        return ["$$", html.escape(text), "$$", *([plain_escape(note)] if note else []), ""]
    return ["**视觉补充：** " + plain_escape(text), ""]


def random_text(rng):
    return "".join(rng.choice(["- ", "-\n", "1. ", "12) x", "\n", "\r\n", " ", "a", "é*", "`", "``", "|", "<b>", "&", "'", " ", "\x0c", "# ", "一", "+\t"]) for _ in range(rng.randrange(1, 12)))


def test_blocks_of_every_kind(spark):
    rng = random.Random(8)
    rows = []
    for position in range(400):
        kind = rng.choice(["PARAGRAPH", "BULLET_LIST", "QUOTE", "CODE", "TABLE", "FORMULA", "VISUAL"])
        wide = rng.randrange(1, 4)
        rows.append((position, (
            kind, random_text(rng), [random_text(rng) for _ in range(rng.randrange(1, 4))], rng.choice([None, "c++ !", "py"]), [random_text(rng) for _ in range(wide)],
            [[random_text(rng) for _ in range(wide)] for _ in range(rng.randrange(3))], rng.choice([None, "", random_text(rng)]))))
    frame = spark.createDataFrame(rows, f"position int, block {BLOCK}")
    got = {r["position"]: r["line"] for r in frame.select("position", rendering.video_block(F.col("block")).alias("line")).collect()}
    for position, block in rows:
        assert got[position] == "\n".join(plain_block(*block)), block
    assert frame.select(rendering.video_block(rendering.block(F.lit("OTHER"))).alias("x")).first().x is None


def test_escape_ends_lines_at_line_feeds_only(spark):
    values = ["-\nx", "- x\n- y", "1. x", "\n\n- a", "a\r- b", "  +\ty", "٣. x", " - x"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.e for r in frame.select(tx.escape_markdown(F.col("v")).alias("e")).collect()] == [plain_escape(v) for v in values]


def test_audio_documents_lose_evidence_ids(spark):
    titles = spark.createDataFrame([(1, "T [asr_abc1]", "O asr_abc1 .")], "run_id int, title string, overview string")
    chapters = spark.createDataFrame([(1, 1, 0, 1000, " - t", "one two", "NO_SEMANTIC_EVIDENCE")], "run_id int, chapter_index int, start_ms int, end_ms int, title string, summary string, content_status string")
    blocks = [(1, 1, 0, ("PARAGRAPH", "one  asr_xyz9 two")), (1, 1, 1, ("CODE", "a ```` b")), (1, 1, 2, ("FORMULA", "x < y")), (1, 1, 3, ("QUOTE", "l1\r\nl2 subtitle_a-1_ !\n"))]
    frame = spark.createDataFrame([(r, c, p, (k, t, None, "py", None, None, None)) for r, c, p, (k, t) in blocks], f"run_id int, chapter_index int, position int, block {BLOCK}")
    claims = spark.createDataFrame([(1, 1, 0, "c*")], "run_id int, chapter_index int, pos int, text string")
    content = rendering.render_audio(titles, chapters, frame, claims).first().content
    assert content == (
        "# T\n\n## 核心概览\n\nO.\n\n## 目录\n\n- 第一章：\\- t (00:00:00 - 00:00:01)\n\n## 第一章：\\- t\n\n时间：00:00:00 - 00:00:01\n\n"
        "one two\n\none two\n\n```py\na ```` b\n```\n\n$$\nx < y\n$$\n\n> l1\n> l2\\!\n\n#### 本章结论\n\n- c\\*\n")


def test_image_documents(spark):
    titles = spark.createDataFrame([(1, "T*", ""), (2, "empty", "o")], "run_id int, title string, overview string")
    frame = spark.createDataFrame([(1, 0, ("DESCRIPTION", "d*", None, None, None, None, None)), (1, 1, ("OCR_TEXT", "o", None, None, None, None, None))], f"run_id int, position int, block {BLOCK}")
    claims = spark.createDataFrame([(1, 0, "c1"), (1, 1, "c2")], "run_id int, pos int, text string")
    got = {r.run_id: r.content for r in rendering.render_images(titles, frame, claims).collect()}
    assert got[1] == "# T*\n\n## 核心概览\n\n未提供核心概览。\n\n## 图片内容\n\nd*\n\n### OCR_TEXT\n\no\n\n## 关键结论\n\n- c1\n- c2\n"
    assert got[2] == "# empty\n\n## 核心概览\n\no\n\n## 图片内容\n\n## 关键结论\n"


def test_texts_of_audio_blocks_are_cleaned_once(spark):
    """Each text of a block goes through its patterns once, however often its lines are named."""
    plan = spark.createDataFrame([], f"block {BLOCK}").select(rendering.audio_block(F.col("block")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(tx.EVIDENCE_MARKER) == 5  # a paragraph, an item, a line of a quote, the head and a cell of a table
    empty = [("BULLET_LIST", None, []), ("BULLET_LIST", None, None), ("BULLET_LIST", None, [""]), ("BULLET_LIST", None, [None]), ("QUOTE", "", None), ("QUOTE", "\n", None), ("QUOTE", "a\r\n", None), ("QUOTE", None, None)]
    frame = spark.createDataFrame([(i, (k, t, v, None, None, None, None)) for i, (k, t, v) in enumerate(empty)], f"i int, block {BLOCK}")
    got = {r.i: r.x for r in frame.select("i", rendering.audio_block(F.col("block")).alias("x")).collect()}
    assert [got[i] for i in range(len(empty))] == ["", "", "- \n", "\n", "", "> \n", "> a\n", ""]


def test_patterns_that_look_ahead_match_the_same(spark):
    space = r"\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
    plain = {
        tx.UNICODE_SPACE: rf"[\s{space}]", tx.INNER_SPACE: rf"[\t\f\r {space}]", rendering.LINE_END: r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]", tx.MARKDOWN_SPECIAL: r"([\\`*_\[\]{}()#|>!])",
        tx.EVIDENCE_MARKER: r"(?i)\\?\[\s*(?:asr|subtitle)_[A-Za-z0-9_-]{3,}\s*\\?\]|(?:asr|subtitle)_[A-Za-z0-9_-]{3,}", r"[ \t][ \t]+": r"[ \t]{2,}", r"(?=\s)(?:^\s+|\s+$)": r"^\s+|\s+$",
    }
    rng = random.Random(3)
    odd = ["\\", "[", "]", " ", "  ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2007", "\u2028", "\u3000", "ASR_", "asr_ab", "subtitle_", "Subtitle_x-1", "s", "a", "é", "\u017f", "日", "abc", "~", "!", "_", "#"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(9))) for _ in range(4000)] + ["a \x85", " \n a  "]
    frame = spark.createDataFrame([(x,) for x in texts], "x string")
    for got, want in plain.items():
        assert frame.where(F.regexp_replace("x", got, "<>") != F.regexp_replace("x", want, "<>")).count() == 0, got
        assert frame.where(F.regexp_replace("x", want, "<>") != F.col("x")).count() > 50
    # line ends made equal are the lines, joined
    assert frame.where(rendering.even_line_ends(F.col("x")) != F.array_join(rendering.lines_of(F.col("x")), "\n")).count() == 0
