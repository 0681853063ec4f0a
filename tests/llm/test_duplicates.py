"""SimHash groups, repeated units and embedding links against plain loops."""

import random

import numpy as np
import pytest
import xxhash

from spanledger.llm import components, rotation, simhash, units


def plain_groups(keys, linked):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(keys))]


def plain_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "a b", "É É é x y z a b c", "x\x0by\tz \n w  q", "Ab cD " * 200])
def test_fingerprint(text):
    got = simhash.fingerprint(None if text is None else text.encode()) & (2**64 - 1)
    assert got == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("SELECT xxhash64('the contract binds') AS h").first()["h"] & (2**64 - 1)
    assert got == xxhash.xxh64_intdigest(b"the contract binds", 42)


@pytest.mark.parametrize("bucket", [256, 2])
def test_links_within_two(spark, monkeypatch, bucket):
    """All links are found, also where every bucket is over its limit."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            base ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                base ^= 1 << rng.randrange(32)
            prints.add(base)
    prints |= {0, 2**64 - 1, 1 << 63, 3}
    prints = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = {r["node"]: r["root"] for r in components.connected_components(simhash.links_within_two(frame)).collect()}
    want = plain_groups(prints, lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2)
    for p, root in zip(prints, want, strict=True):
        assert got.get(p, p) == prints[root]


def test_near_duplicate_edges(spark):
    """Nulls, wordless texts, repeated rows and ids, a null id, clashing names and a long text."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(5, "a b c d e f"), (3, "A  b c\td e F"), (9, None), (8, ""), (8, ""), (7, " \n"), (None, "a b c d e f"), (2, long), (4, long), (6, "quite another text here")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, fingerprint string, component_id string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(frame).collect())
    assert got == sorted([(False, 5, 3), (False, 3, 3), (False, 9, 7), (False, 8, 7), (False, 8, 7), (False, 7, 7), (True, 0, 3), (False, 2, 2), (False, 4, 2), (False, 6, 6)])
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 700)}


def plain_units(rows, min_words=5):
    """Scan in rank order; cut every unit met before."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept, gone, before = [], [], []
        for start, stop in units.unit_spans(text or ""):
            norm = "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in text[start:stop].lower()).split()
            unit = tuple(norm if len(norm) >= min_words or not norm else before + norm)
            before = norm
            if len(unit) >= min_words and unit in seen:
                gone.append((start, stop))
            else:
                kept.append(text[start:stop])
                seen.add(unit)
        out[key] = ("".join(kept) if text is not None else None, gone)
    return out


def test_unit_spans_cover_the_text():
    text = "One. Two! Three?\nFour 3.14 five.\n\nSix"
    assert "".join(text[a:b] for a, b in units.unit_spans(text)) == text
    assert [text[a:b] for a, b in units.unit_spans(text)] == ["One. ", "Two! ", "Three?\n", "Four 3.14 five.\n", "\n", "Six"]


def test_repeated_units(spark):
    rng = random.Random(4)
    pool = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    rows = [(i, rng.choice(["", "\n"]).join(rng.choice(pool).capitalize() + rng.choice([". ", ".\n", "! "]) for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, rows[3][1])]
    frame = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id bigint, text string, _id int, places int, removed string")
    got = {r["row"]["doc_id"]: (r["text"], [tuple(s) for s in r["removed"]]) for r in units.remove_repeats(frame).collect()}
    for key, (text, gone) in plain_units(rows).items():
        assert got[key][0] == text
        flat = [x for a, b in got[key][1] for x in range(a, b)]
        assert flat == [x for a, b in gone for x in range(a, b)]
    assert units.remove_repeats(frame.limit(0)).count() == 0


def test_equal_rows_get_equal_results(spark):
    text = "The very same sentence stands here. And another sentence of some length."
    got = units.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")).collect()
    assert sorted((r["row"]["doc_id"], r["text"]) for r in got) == [(1, text), (1, text), (2, "")]


def vectors_with_groups(seed, count=400, dims=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((count, dims))
    near = [base[i] + rng.standard_normal(dims) * rng.uniform(0.02, 0.3) for i in rng.integers(0, 30, 250)]
    return np.concatenate([base, near, base[:20], base[:5] * 3])


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors(spark, monkeypatch, block):
    """Recall of 0.98 at least over links from 0.95 on, none below, and exact counts for what is far above."""
    monkeypatch.setattr(rotation, "BLOCK", block)
    v = vectors_with_groups(3)
    frame = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r for r in rotation.near_vectors(frame, miss=1e-4).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -1)
    want = (cosine >= 0.95).sum(axis=1)
    have = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (have <= want).all()
    assert have.sum() >= 0.98 * want.sum()
    roots = plain_groups(list(range(len(v))), lambda a, b: cosine[a, b] >= 0.95)
    assert np.mean([got[i]["component_id"] == roots[i] for i in range(len(v))]) >= 0.98
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_vectors_without_links(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, -0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 0.0]), (8, [1.0]), (9, []), (10, [1.0, -0.0]), (2, [2.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id bigint, embedding array<double>, kept string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rotation.near_vectors(frame).collect())
    lone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (10, 3, 1, False), *lone])
    assert rotation.near_vectors(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    turns = rotation.rotations(64, 6, 2)
    x = rng.standard_normal((2000, 64))
    y = x * 0.9 + rng.standard_normal((2000, 64)) * 0.45
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    codes, factors = rotation.encode(x, turns)
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    estimate = np.einsum("ij,ij->i", signs, y @ turns) * (8 / turns.shape[1]) / factors
    error = estimate - np.einsum("ij,ij->i", x, y)
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) < rotation.WIDTH * np.sqrt(1 - factors**2) / factors / np.sqrt(63 * 6)).all()
