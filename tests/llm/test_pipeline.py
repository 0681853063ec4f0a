"""Every stage of the pipeline against a plain version, on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from spanledger import session
from spanledger.llm import decontamination, pieces, quality_cnn, simhash
from test_documents import plain_overlap
from test_duplicates import plain_units

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def rows(frame):
    return {r["doc_id"]: r.asDict() for r in frame.collect()}


def test_columns(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_quality(spark, stages):
    net = quality_cnn.fit_quality_model(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {k: r for k, r in rows(stages[0]).items() if quality_cnn.score_texts(net, [r["text"].encode()])[0] >= 0.3}
    assert rows(stages[1]) == want and 0 < len(want) < stages[0].count()


def test_near_copies(stages):
    """No two of the kept are near copies that the tables can hold, and every dropped one has a link to another."""
    before, kept = rows(stages[1]), rows(stages[2])
    prints = {k: simhash.wide_fingerprint(r["text"].encode()) for k, r in before.items()}
    apart = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(prints[a], prints[b], strict=True))
    most = simhash.distance_at(0.8)
    assert all(before[k] == r for k, r in kept.items()) and 0 < len(kept) < len(before)
    assert all(min(apart(k, other) for other in before if other != k) <= most for k in before.keys() - kept.keys())
    texts = {}
    for key in sorted(before):
        texts.setdefault(before[key]["text"], key)
    assert set(kept) <= set(texts.values())

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {k: shingles(r["text"]) for k, r in kept.items()}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])]
    assert len(close) <= 1


def test_repeated_passages(stages):
    before, after = rows(stages[2]), rows(stages[3])
    for key, (text, gone) in plain_units([(k, r["text"]) for k, r in before.items()]).items():
        assert after[key] == before[key] | {"text": text, "n_chars": len(text) if gone else before[key]["n_chars"]}
    assert after.keys() == before.keys()


def test_benchmark_leaks(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = rows(stages[3])
    assert rows(stages[4]) == {k: r for k, r in before.items() if not plain_overlap(r["text"], items)[1]}


def test_encode(stages):
    vocabulary, before, after = pieces.load_vocabulary(), rows(stages[4]), rows(stages[5])
    assert {k: pieces.decode(vocabulary, r["token_ids"]) for k, r in after.items()} == {k: r["text"] for k, r in before.items()}


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, removed int, quality_kept boolean"
    frame = spark.createDataFrame([
        (1, None, None, None, None, 1, 1, True), (2, "", "en", "s", 0, 1, 1, True), (None, "no id here", None, "s", 10, 1, 1, True),
        (3, "a b c d e f g", "en", "s", 13, 1, 1, True), (3, "a b c d e f g", "en", "s", 13, 1, 1, True), (4, "A b c d e f g", "en", "s", 13, 1, 1, True),
    ], schema)
    docs = frame
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.dtypes == frame.dtypes
    pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    copies = pipeline.near_copies(spark, frame, FOLDER).collect()
    assert sorted(str(r["doc_id"]) for r in copies) == ["1", "3", "None"]
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame.limit(0), FOLDER).count() == 0
    assert decontamination.words_of(None) == []


def test_stages_delete_their_tables(spark, tmp_path, monkeypatch):
    """What a stage writes on its way is gone before its rows are read, and the rows are still there."""
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, f"a b c d e f g {i // 2}. one two three four five six") for i in range(8)], "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    copies = pipeline.near_copies(spark, docs, FOLDER)
    assert len(list(tmp_path.iterdir())) == 3
    assert sorted(r["doc_id"] for r in copies.collect()) == [0, 2, 4, 6]
    passages = pipeline.repeated_passages(spark, docs, FOLDER)
    assert len(list(tmp_path.iterdir())) == 4
    assert passages.count() == 8
