"""Archives, shards, benchmark overlap and pieces: exact against plain versions and round trips."""

import glob
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from spanledger.llm import decontamination, pieces, sharding, warc


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}\r\ny z", f"<p>é{i % 7}</p>" * (i % 9)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (None, "u", "<p>é1</p>"), (None, "u", "alone"), (50, "again", rows[50][2]), (200, "big", "x" * 100_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int").repartition(3)
    path = warc.write_archives(frame, str(tmp_path / "a"), frame_bytes=300, bundle_bytes=400)
    assert len(glob.glob(f"{path}/part-*")) > 3
    got = warc.read_archives(spark, path).collect()
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = max((p for p in groups[html or ""] if p is not None), default=None)
        revisit = first is not None and page != first and len(groups[html or ""]) > 1
        want.append((page, len(body), warc.payload_digest(body), "revisit" if revisit else "response", first if revisit else None, None if revisit else body))
    key = repr
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=key) == sorted(want, key=key)


def test_bundle_is_seekable_and_a_plain_stream(tmp_path):
    import io

    import zstandard

    bundle = warc.Bundle()
    records = [(f"r{i}", bytes([i % 251]) * (5000 * (i % 90 + 1))) for i in range(100)]
    for key, record in records:
        bundle.add(key, record)
    data = bundle.finish()
    frames = warc.seek_table(data)
    assert len(frames) > 10
    for (key, record), (name, frame, offset, length) in zip(records, warc.record_index(data), strict=True):
        assert name == key
        assert warc.read_frame(data, frames[frame])[offset : offset + length] == record
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    assert stream.read() == b"".join(r for _, r in records)


def test_fetch_reads_only_the_wanted(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id bigint, url string, html string")
    path = warc.write_archives(frame, str(tmp_path / "b"))
    wanted = spark.createDataFrame([(warc.record_id(i),) for i in (3, 41, 999)], "record_id string")
    assert sorted((r["page_id"], bytes(r["payload"])) for r in warc.fetch_records(spark, path, wanted).collect()) == [(3, b"page 3"), (41, b"page 41")]
    empty = warc.write_archives(frame.limit(0), str(tmp_path / "c"))
    assert warc.read_archives(spark, empty).count() == 0


def check_shards(rows, texts, tolerance):
    total = [0] * 8
    slots, places = defaultdict(list), defaultdict(set)
    for r in rows:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        places[texts[r["doc_id"]]].add(r["shard"])
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 1, zlib.crc32(body))
    target = sum(total) / 8
    assert max(abs(t - target) for t in total) <= tolerance * target, total
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    return places


def test_shards_keep_groups_and_balance(spark):
    rng = random.Random(2)
    texts = {i: "é" * rng.randrange(200) + str(i) for i in range(6000)}
    for i in range(300):
        texts[10_000 + i] = "same text " * 30
    for i in range(150):
        texts[20_000 + i] = "other text " * 25
    texts |= {30_000: None, 30_001: ""}
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in texts.items()], "doc_id bigint, text string, shard string, slot int")
    places = check_shards(sharding.shard_documents(frame).collect(), texts, 0.02)
    assert all(len(p) == 1 for p in places.values())


def test_a_group_larger_than_a_shard_is_dealt_out(spark):
    texts = {i: "hot" * 50 for i in range(4000)} | {10_000 + i: f"text {i} " * 20 for i in range(4000)}
    rows = sharding.shard_documents(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    places = check_shards(rows, texts, 0.02)
    assert len(places["hot" * 50]) == 8


def test_equal_rows_and_rows_without_an_id_are_dealt_out(spark):
    for same in (7, None):
        rows = [(same, "copy " * 20)] * 400 + [(i, f"other {i}") for i in range(100, 200)]
        got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
        total = [0] * 8
        for r in got:
            total[r["shard"]] += r["size"]
        assert len(got) == 500 and max(total) < 1.5 * sum(total) / 8 and min(total) > 0.5 * sum(total) / 8, total


def test_shards_are_read_back(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else "é" * (i % 30), "s", i) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, size int")
    sharding.write_shards(frame, str(tmp_path / "b"))
    got = sharding.read_shards(spark, str(tmp_path / "b")).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    sharding.write_shards(frame.limit(0), str(tmp_path / "none"))
    assert sharding.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(i, f"text {i % 40}", "x", i) for i in range(300)] + [(None, None, None, None)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string, shard string, slot int"), str(tmp_path / "s"), shards=3)
    got = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((tuple(r["row"]) for r in got), key=repr) == sorted(rows, key=repr)
    assert {r["shard"] for r in got} == {0, 1, 2}


def test_shards_of_little(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id bigint, text string")
    assert len(sharding.shard_documents(frame).collect()) == 3
    assert sharding.shard_documents(frame.limit(0)).count() == 0


def plain_overlap(text, items, width=10):
    words = decontamination.words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        other = decontamination.words_of((body or "").encode())
        size = min(width, len(other))
        for at in range(len(other) - size + 1) if other else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == other[at : at + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_contamination(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_WORDS", 40)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["É1", "the"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 5, 9, 10, 11, 25, 14, 30])]
    items += [(50, None), (51, " .. "), (7, items[4][1])]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(words) + 1)
        docs.append((i, ", ".join([*words[:at], rng.choice(items)[1] or "", *words[at:]]).upper().replace("É", "É")))
    docs += [(90, None), (91, ""), (91, items[6][1]), (92, "-" * 50), (None, items[8][1])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, n_hit string, ord int").repartition(2)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    import hashlib

    got = sorted(((r["doc_id"] or -1), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.contamination(frame, tests, segment_words=120).collect())
    want = []
    for key, text in docs:
        n, hit, found = plain_overlap(text, items)
        want.append(((key or -1), n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert got == sorted(want)
    assert decontamination.contamination(frame.limit(0), tests).count() == 0
    clean = decontamination.contamination(frame, tests.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha x y z beta gamma delta"), (3, "alpha beta gamma delta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id bigint, text string")
    index = decontamination.build_index(docs.coalesce(1))
    names = {r["ord"]: r["id"] for r in index.filter("ord IS NOT NULL").collect()}
    exact = decontamination.phrase_matches(index, items).collect()
    near = decontamination.phrase_matches(index, items, slop=1).collect()
    assert {names[r["ord"]] for r in exact} == {3}
    assert {names[r["ord"]] for r in near} == {1, 3}


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


TEXTS = ["", " ", "a", " lead and trail ", "naïve ▁ mark ▁▁", "line\nend\ttab\x00", "日本語のテキスト 한국어", "m² x². 3,5% (ok)!!", "wörter " * 50, "x" * 3000, "supercalifragilistic" * 40, "\U0001f600 é́"]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6, 1.0])
@pytest.mark.parametrize("text", TEXTS)
def test_pieces_round_trip(vocabulary, text, rate):
    for seed in (1, 2):
        ids = np.frombuffer(pieces.Encoder(vocabulary, rate, seed).encode(text, 5), np.int32).tolist()
        assert pieces.decode(vocabulary, ids) == text


@pytest.mark.parametrize("text", [t for t in TEXTS if "▁" not in t])
def test_without_dropout_it_is_the_library(vocabulary, text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert np.frombuffer(pieces.Encoder(vocabulary, 0.0, 1).encode(text), np.int32).tolist() == model.encode(text)


def test_both_agendas_agree_and_seeds_differ(vocabulary):
    one, two = pieces.Encoder(vocabulary, 0.3, 1), pieces.Encoder(vocabulary, 0.3, 2)
    rng = random.Random(1)
    words = ["▁" + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    assert all(one._short(w, k) == one._long(w, k) for k, w in enumerate(words))
    assert sum(one.encode(w[1:]) != two.encode(w[1:]) for w in words) > 150
    repeated = np.frombuffer(one.encode("internationalisation " * 40), np.int32)
    assert len(set(repeated.tolist())) > len(set(np.frombuffer(pieces.Encoder(vocabulary, 0.0, 1).encode("internationalisation " * 40), np.int32).tolist()))


def test_every_occurrence_has_its_own_segmentation(vocabulary):
    """Segmentations of one word over many texts occur as often as plain dropout of each candidate by its own coin gives them."""
    word, rate, times = "▁international", 0.3, 4000
    encoder, rng = pieces.Encoder(vocabulary, rate, 1), random.Random(1)
    got = Counter(encoder.encode(word[1:], salt) for salt in range(times))

    def plain():
        symbols, dropped = list(word), set()
        while True:
            offers = [(-vocabulary.scores[a + b], at) for at, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in vocabulary.scores and (sum(map(len, symbols[:at])), a, b) not in dropped]
            if not offers:
                return encoder._numbers(symbols)
            at = min(offers)[1]
            if rng.random() < rate:
                dropped.add((sum(map(len, symbols[:at])), symbols[at], symbols[at + 1]))
            else:
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    want = Counter(plain() for _ in range(times))
    assert len(got) > 20
    assert all(abs(got[ids] - want[ids]) < 6 * (got[ids] + want[ids]) ** 0.5 for ids in got.keys() | want.keys())
    fresh = [pieces.Encoder(vocabulary, rate, 1).encode(word[1:], salt) for salt in range(50)]
    assert fresh == [encoder.encode(word[1:], salt) for salt in range(50)]


def test_occurrences_are_segmented_side_by_side(vocabulary):
    """Calls into Python functions do not follow the occurrences that lose a candidate, and the ids are those of one word after the other."""
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("etaoinshrdluü7日") for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + ["x" * 60]
    texts = [" ".join(rng.choice(lexicon) for _ in range(4000)) for _ in range(6)] + ["", "a", "naïve ▁ mark ▁▁"]
    encoder, calls = pieces.Encoder(vocabulary, 0.2, 1), Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = [encoder.encode(text, salt) for salt, text in enumerate(texts)]
    finally:
        sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < 8 * 24_000, calls
    for salt, text in enumerate(texts[:-1]):
        words = encoder.word.findall("▁" + text.replace(" ", "▁")) if text else []
        keys = pieces.mixed(np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(pieces.STEP) + np.uint64(xxhash.xxh64_intdigest(salt.to_bytes(8, "little"), 1)))
        assert got[salt] == b"".join(map(encoder._long, words, keys.tolist()))
    ids, sizes = pieces.Encoder(vocabulary, 0.2, 1).encode_all(texts, range(len(texts)))
    assert ids.tobytes() == b"".join(got) and [4 * n for n in sizes.tolist()] == list(map(len, got))


def test_encode_documents(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3]), (None, "no id")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, token_ids string")
    encoded = pieces.encode_documents(frame, vocabulary)
    got = encoded.collect()
    assert len(got) == len(rows)
    assert all(r["lossless"] for r in got if r["n_tokens"] is not None) and sum(r["n_tokens"] is None for r in got) == 1
    back = sorted((repr(r["doc_id"]), repr(r["text"])) for r in pieces.decode_documents(encoded, vocabulary).collect())
    assert back == sorted((repr(i), repr(t)) for i, t in rows)
    assert pieces.encode_documents(frame.limit(0), vocabulary).count() == 0
