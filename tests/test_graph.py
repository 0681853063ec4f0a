"""Reference graph against plain searches, with long chains and a dominating run."""

import random

from spanledger.operators import graph


def test_components_of_long_chains_and_hubs(spark, monkeypatch):
    rng = random.Random(2)
    names = list(range(3000))
    rng.shuffle(names)
    edges = [(1, a, b) for a, b in zip(names, names[1:], strict=False) if a % 500] + [(2, 0, i) for i in range(1, 400)] + [(3, 5, 5), (3, 7, 6)]
    nodes = [(1, n) for n in names] + [(2, n) for n in range(401)] + [(3, n) for n in (5, 6, 7)]
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for s, a, b in edges:
        x, y = sorted((find((s, a)), find((s, b))))
        root[y] = x
    rounds = []
    plain = graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: rounds.append(1) or plain(df))
    got = graph.components(spark.createDataFrame(edges, "scope int, a int, b int"), spark.createDataFrame(nodes, "scope int, node int"), ["scope"])
    assert {(r.scope, r.node): (r.scope, r.root) for r in got.collect()} == {n: find(n) for n in nodes}
    assert len(rounds) < 16, len(rounds)
    none = graph.components(spark.createDataFrame([], "scope int, a int, b int"), spark.createDataFrame([(1, 4)], "scope int, node int"), ["scope"])
    assert [tuple(r) for r in none.collect()] == [(1, 4, 4)]


def test_reachable_follows_direction(spark):
    edges = [("r", "ch", "ob"), ("r", "ob", "kf"), ("r", "kf", "ch"), ("r", "x", "y"), ("q", "ch", "z")]
    got = graph.reachable(spark.createDataFrame([("r", "ch")], "run_id string, node_id string"), spark.createDataFrame(edges, "run_id string, owner_id string, ref_id string"))
    assert sorted(tuple(r) for r in got.collect()) == [("r", "ch"), ("r", "kf"), ("r", "ob")]


def test_each_rule_names_the_violating_and_leaves_the_clean(spark):
    nodes = spark.createDataFrame([
        (1, "c", "CHAPTER", 0, 100), (1, "o", "OBSERVATION", 10, 50), (1, "k1", "KEYFRAME", 10, 11), (1, "k2", "KEYFRAME", 60, 61), (1, "s", "SPEECH", 90, 120)],
        "run_id int, node_id string, kind string, start_ms int, end_ms int")
    edges = spark.createDataFrame([
        (1, "c", "CHAPTER_OBSERVATION", "o"), (1, "o", "SHOWN_FRAME", "k1"), (1, "o", "SHOWN_FRAME", "k2"), (1, "c", "CHAPTER_TRANSCRIPT", "s"), (1, "c", "SELECTED_FRAME", "s"), (1, "c", "VISUAL", "no"),
        (1, "no", "VISUAL", "o"), (1, "c", "SELECTED_FRAME", "k2"), (2, "c", "CHAPTER_FRAME", "k1")], "run_id int, owner_id string, role string, ref_id string")
    got = sorted((r.run_id, r.rule, r.entity_id, r.ref_id) for r in graph.reference_violations(edges, nodes).collect())
    assert got == [
        ("1", "OUTSIDE_OWNER", "c", "s"), ("1", "OUTSIDE_OWNER", "o", "k2"), ("1", "TYPE_MISMATCH", "c", "s"), ("1", "UNKNOWN_OWNER", "no", "o"), ("1", "UNKNOWN_REFERENCE", "c", "no"), ("2", "UNKNOWN_OWNER", "c", "k1")]
    declared = spark.createDataFrame([(1, "a", 0, "k1"), (1, "a", 1, "k2"), (1, "b", 0, "k1"), (1, "d", 0, "k1")], "run_id int, chapter_id string, position int, frame_id string")
    sources = spark.createDataFrame([(1, "a", "x", 0, "k1"), (1, "a", "x", 1, "k2"), (1, "a", "y", 2, "k1"), (1, "b", "x", 0, "k2"), (1, "e", "x", 0, "k2")], "run_id int, chapter_id string, block_id string, place int, frame_id string")
    assert sorted((r.entity_id, r.detail) for r in graph.rebuilt_selection(sources, declared).collect()) == [("b", "1"), ("d", "1"), ("e", "1")]
