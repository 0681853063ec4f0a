"""Mixtures against plain loops."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

from spanledger.llm import mixing

FIELDS = "doc_id bigint, text string, source string, ordinal int, start string, size double, slot int, target string"


def plain_targets(sizes, weights=(5, 2, 1)):
    """Share by weight, stop at twice the size, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = Fraction(3 * sum(sizes.values()), 2), dict.fromkeys(names, Fraction(0)), set(names)
    while open_ and left > 0:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + weight[s] * level >= 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] += weight[s] * level
            break
        for s in over:
            left -= 2 * sizes[s]
            target[s] = Fraction(2 * sizes[s])
        open_ -= over
    return target


def plain_mix(rows):
    sizes, groups = defaultdict(int), defaultdict(list)
    for doc, text, source in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += size
        groups[source].append((hashlib.md5(f"11:{'' if doc is None else doc}".encode()).hexdigest()[:15], doc is not None, doc or 0, size, doc))
    targets, out = plain_targets(sizes), []
    for source, docs in groups.items():
        goal, total, at = int(targets[source] + Fraction(1, 2)), sizes[source], 0
        for *_, size, doc in sorted(docs, key=lambda d: d[:4]):
            taken = sum(max(0, min(at + size + p * total, goal) - at - p * total) for p in (0, 1))
            out.append((doc, size, total, round(float(targets[source]), 6), taken))
            at += size
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5, 2, "y") for r in rows], FIELDS)


def test_words_taken_equal_the_plain_mix(spark):
    rng = random.Random(4)
    blanks = [" ", "\t", "\n\n", "\x0b \x0c", "\r\n", " ", " "]
    rows = [(i, "".join(rng.choice(["é", "ab", "c"]) + rng.choice(blanks) for _ in range(rng.randrange(60))), rng.choice(["a", "a", "a", "b", "Z", "é", "\U0001f600", "￮", None])) for i in range(400)]
    rows += [(None, "x y", "a"), (None, None, "a"), (None, "x y", None), (7, "again and again", "b"), (7, "again and again", "b"), (900, "w " * 30_000, "long"), (901, "", "empty"), (902, " \t", "empty"), (903, "one", "tiny")]
    rows += [(77, "the same row", "a")] * 300
    for words in (3, 40, 5000):
        got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mixed_documents(frame(spark, rows), words).collect()]
        assert sorted(got, key=repr) == plain_mix(rows)


def test_slots_take_one_block_each_in_low_discrepancy_order(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 7}") for i in range(2000)] + [(5000 + i, "w " * 40, "large") for i in range(1000)]
    placed, sources = mixing.place_documents(frame(spark, rows))
    pieces = mixing.mix(placed, sources, 32).collect()
    targets = {r["ordinal"]: r["target"] for r in sources.collect()}
    total = sum(targets.values())
    slots, seen = defaultdict(int), {}
    for r in pieces:
        slots[r["slot"]] += r["stop"] - r["first"]
        assert seen.setdefault(r["slot"], r["ordinal"]) == r["ordinal"]
    counts = defaultdict(int)
    for n, slot in enumerate(sorted(slots)):
        counts[seen[slot]] += 1
        if n > 200:
            assert all(abs(counts[o] - t / total * slot) < 12 + 0.04 * slot for o, t in targets.items())
    by_source = defaultdict(set)
    for slot, words in slots.items():
        by_source[seen[slot]].add(words)
    assert all(len(sizes) <= 2 for sizes in by_source.values())  # equal blocks and a shorter last one


def test_schedule_ranks_count_slots_of_a_source(spark):
    sources = spark.createDataFrame([(0, 900.0), (1, 90.0), (2, 0.0), (3, 1e-9), (4, 10.0)], "ordinal int, target double")
    rows = sorted((r["slot"], r["ordinal"], r["rank"]) for r in mixing.schedule(sources, 20_000).collect())
    assert [s for s, _, _ in rows][:20_000] == list(range(20_000))
    ranks = defaultdict(int)
    for _, ordinal, rank in rows:
        assert rank == ranks[ordinal]
        ranks[ordinal] += 1
    assert abs(ranks[0] - 18_000) < 8 and abs(ranks[1] - 1800) < 8 and ranks[2] == 0 and ranks[3] == 1 and abs(ranks[4] - 200) < 8


def test_no_rows_and_no_words(spark):
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    got = mixing.mixed_documents(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_copies_are_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(1, "a b c", "s")] * 50 + [(2, "d", "s")]
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mixed_documents(frame(spark, rows), 5).collect()]
    assert sorted(got, key=repr) == plain_mix(rows)
