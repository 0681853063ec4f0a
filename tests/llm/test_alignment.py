"""Token alignment against a plain version over all token pairs."""

import hashlib
from collections import Counter

from spanledger.llm import alignment

TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "naïve café — straße 東京タワー", "  two  spaces\tand\ttabs\n\n lines ", None, "", " ", "ab▁cd", "<|endoftext|> and <s> or </s> are text",
    "emoji 👩‍👩‍👧 and ́combining ‍", "a" * 3000, "no-space-" * 500, "The quick brown fox jumps over the lazy dog.", "x\x00y", "x\r\ny", "1234567890 12,345.67", "ﬁ ligature ½", "therrors esan antidisestablishmentarianism " * 40,
]


def library(tokenizers):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizers.byte_level)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_both_libraries_give_the_same_ids():
    tokenizers = alignment.Tokenizers()
    odd = ["<|endoftext|> a", "½ ² 東京", "a b　c d", "'s 'LL I'll 'll", " \n\n \t x  ", "ẞ ǅ ͅ ︎", "1²3½ Ⅷ", "a\x1cb\x85c", "᠎​ ﻿", "x" * 20_000, " " * 20_000, "\n" * 5000 + "a"]
    for text in [t or "" for t in TEXTS] + odd:
        assert tokenizers.first.encode_ordinary(" " + text) == library(tokenizers).encode(" " + text, add_special_tokens=False).ids


def plain(texts):
    tokenizers = alignment.Tokenizers()
    rows, counts = [], Counter()
    for text in texts:
        a, b = (library(tokenizers).encode(" " + (text or ""), add_special_tokens=False).ids, tokenizers.second.encode(text or ""))
        raw = (" " + (text or "")).encode()
        if not text or b"".join(tokenizers.first_bytes[i] for i in a) != raw or b"".join(tokenizers.second_bytes[i] for i in b) != raw:
            rows.append(None)
            continue
        spans = []
        for ids, table in ((a, tokenizers.first_bytes), (b, tokenizers.second_bytes)):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(found)
        links = Counter()
        for s, e, i in spans[0]:
            for t, f, j in spans[1]:
                if max(s, t) < min(e, f):
                    links[i, j] += 1
        counts.update(links)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for _, e, i in side if low < e <= end) for side in spans))
            low = end
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, digest = row
        out.append((n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[1]]), sum(n * counts[p] for p, n in links.items()), digest))
    return out


def found(rows):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((r["doc_id"], *[r[n] for n in names]) for r in rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", [2], "i") for r in rows], "doc_id bigint, text string, a int, row string, pairs array<int>, id string")


def test_alignment_equals_the_plain_version(spark):
    rows = list(enumerate(TEXTS))
    want = sorted((i, *r) for i, r in enumerate(plain(TEXTS)))
    assert sum(r[1] > 0 for r in want) >= 10
    assert found(alignment.token_alignment(frame(spark, rows).repartition(3)).collect()) == want


def test_counts_without_frequent_pairs_and_without_memo(spark, monkeypatch):
    want = sorted((i, *r) for i, r in enumerate(plain(TEXTS)))
    monkeypatch.setattr(alignment, "FREQUENT", 20)
    assert found(alignment.token_alignment(frame(spark, list(enumerate(TEXTS)))).collect()) == want
    aligner = alignment.Aligner(alignment.Tokenizers())
    monkeypatch.setattr(alignment, "MEMO", 2)
    monkeypatch.setattr(alignment, "STRETCH", 3)
    encoded = list(aligner.tokenizers.encode([t or "" for t in TEXTS]))
    for step in (1, 5, 100):
        rows = [row for at in range(0, len(encoded), step) for row in aligner.documents(encoded[at : at + step])]
        for i, (n_a, n_b, groups, links, digest, *_) in enumerate(rows):
            assert (i, n_a, n_b, groups, links, digest) == (*want[i][:5], want[i][7])


def test_anchors_cut_before_spaces_only():
    aligner = alignment.Aligner(alignment.Tokenizers())
    (ids,) = aligner.tokenizers.encode(["one two three two"])
    numbers, begins = aligner.windows(*ids)
    assert len(begins) == 4 and numbers[1] == numbers[3] and len(aligner.memo) == 3
    again, _ = aligner.windows(*ids)
    assert again.tolist() == numbers.tolist() and len(aligner.memo) == 3


def test_windows_with_equal_hashes_stay_apart(monkeypatch):
    encoded = list(alignment.Tokenizers().encode(["one two three four", "five six"]))
    want = [r[:5] for r in alignment.Aligner(alignment.Tokenizers()).documents(encoded)]
    monkeypatch.setattr(alignment, "_mixed", lambda values: values * 0)
    assert [r[:5] for r in alignment.Aligner(alignment.Tokenizers()).documents(encoded)] == want


def test_batches_cover_all_texts(monkeypatch):
    monkeypatch.setattr(alignment, "BATCH", 3)
    monkeypatch.setattr(alignment, "LETTERS", 10)
    texts = ["a" * 30, None, "b", "c" * 11, "d", "e", "f", "g"]
    ranges = list(alignment._batches(texts))
    assert [i for low, high in ranges for i in range(low, high)] == list(range(8)) and max(high - low for low, high in ranges) <= 3
    assert list(alignment._batches([])) == []


def test_repeated_ids_and_empty_tables(spark):
    assert alignment.token_alignment(frame(spark, [])).count() == 0
    rows = alignment.token_alignment(frame(spark, [(1, "same text"), (1, "same text"), (None, "same text"), (None, None), (1, "other")])).collect()
    want = plain(["same text", "same text", "same text", None, "other"])
    keyed = Counter((r["doc_id"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows)
    assert keyed == Counter((i, w[3], w[4], w[5], w[6]) for i, w in zip([1, 1, None, None, 1], want, strict=True))
