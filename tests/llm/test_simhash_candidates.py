"""The pipeline's near copies come from SimHash fingerprints as well, with the exact check behind them."""

import random

from pyspark.sql import functions as F

from spanledger.llm import simhash
from test_similar import fresh, grouped


def test_fingerprints_alone_name_the_nearest_pairs(spark, monkeypatch):
    """Without a single MinHash pair, texts that differ in one word of 3,000 are still linked; others are not."""
    monkeypatch.setattr(simhash, "forests", lambda work, value, read, linker, made=simhash.forests: made(
        work.filter(F.lit(value == "text")), value, read, linker))
    rng, texts = random.Random(6), []
    for _ in range(6):
        words = fresh(rng, 3000)
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    got = grouped(spark, [*texts, *(" ".join(fresh(rng, 50)) for _ in range(6))])
    near = [simhash.fingerprint(t.encode(), 5) for t in texts]
    apart = [((near[i] ^ near[i + 1]) & (2**64 - 1)).bit_count() for i in range(0, 12, 2)]
    assert sum(a <= 2 for a in apart) >= 4
    assert got == [i - i % 2 if i < 12 and apart[i // 2] <= 2 else i for i in range(18)]
