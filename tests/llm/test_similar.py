"""Groups of similar texts against brute force over their shingle sets."""

import random

import pytest

from spanledger.llm import simhash
from test_duplicates import plain_groups


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def grouped(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame).collect()}
    return [got[i] for i in range(len(texts))]


def fresh(rng, count):
    return [f"w{rng.randrange(10**9)}" for _ in range(count)]


def templated(rng, families, shared, own):
    """Texts of one template, each with its own words at the end, in pairs that differ by the last word."""
    template, out = fresh(rng, shared), []
    for _ in range(families):
        words = template + fresh(rng, own)
        out += [" ".join(words), " ".join(words[:-1] + fresh(rng, 1))]
    return out


def test_texts_below_the_threshold_are_not_linked(spark):
    """Texts that are 0.75 alike share a template and stay apart; only the pairs within are copies."""
    texts = templated(random.Random(1), 60, 200, 33)
    sets = [shingles(t) for t in texts]
    assert 0.7 < similarity(sets[0], sets[2]) < 0.8 <= similarity(sets[0], sets[1])
    got = grouped(spark, texts)
    assert all(got[i] in (i, i - i % 2) for i in range(len(texts)))


def pairs_at(rng, count, least, most):
    """Pairs of texts in which single words are replaced until the similarity lies between the two."""
    out = []
    while len(out) < 2 * count:
        words = fresh(rng, rng.randrange(60, 400))
        other = list(words)
        while similarity(shingles(" ".join(words)), shingles(" ".join(other))) >= most:
            other[rng.randrange(len(other))] = fresh(rng, 1)[0]
        if similarity(shingles(" ".join(words)), shingles(" ".join(other))) >= least:
            out += [" ".join(words), " ".join(other)]
    return out


def test_pairs_at_the_threshold_are_found(spark):
    """Of 400 pairs that are 0.8 to 0.83 alike one may be missed."""
    texts = pairs_at(random.Random(2), 400, 0.8, 0.83)
    got = grouped(spark, texts)
    assert all(got[i] in (i, i - i % 2) for i in range(len(texts)))
    assert sum(got[i + 1] != i for i in range(0, len(texts), 2)) <= 1


@pytest.mark.parametrize("block", [2048, 16])
def test_pairs_in_a_crowded_bucket_are_found(spark, monkeypatch, block):
    """Families of one template meet in common buckets; pairs between the ends of other families count as well."""
    monkeypatch.setattr(simhash, "BUCKET_BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCK", min(block, 512))
    texts = templated(random.Random(3), 150, 200, 60)
    random.Random(4).shuffle(texts)
    sets = [shingles(t) for t in texts]
    want = plain_groups(sets, lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    assert len(set(want)) == 150
    assert grouped(spark, texts) == want
