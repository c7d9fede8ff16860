"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from test_small import brute_components, brute_lines

from tempora.llm import bpe, jaccard_join, mixing, queries, toxicity
from tempora.llm.common import table
from tempora.llm.shingles import shingle_sets

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([r.asDict() for r in docs.collect()])
        assert k == 4 or docs.columns == columns
    model = toxicity.train(table(spark, DIR, "documents"), toxicity.learnable(table(spark, DIR, "labels"), 3, 1))
    cache = {}
    clean = {r["doc_id"]: r["text"] for r in table(spark, DIR, "documents").collect() if toxicity.noisy_or([z for _, _, z in model.sentences(r["text"] or "", cache)]) < 0.7}
    assert {r["doc_id"]: r["text"] for r in kept[0]} == clean
    lines = brute_lines(clean.items())
    assert {r["doc_id"]: r["text"] for r in kept[1]} == {i: t for i, (t, _, _) in lines.items()} and all(r["n_chars"] == len(r["text"]) for r in kept[1])
    comps = brute_components([(r["doc_id"], r["text"]) for r in kept[1]])
    assert {r["doc_id"] for r in kept[2]} == {i for i, (_, c) in comps.items() if c == i}
    n = {}
    for r in kept[3]:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert set(n) <= {r["doc_id"] for r in kept[2]} and max(n.values()) <= 2
    own = bpe.load(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in kept[2]}
    for r in kept[4]:
        ids = own.encode(texts[r["doc_id"]])
        assert r["ids"] == memoryview(ids).cast("i").tolist() and r["decoded_sha256"] == hashlib.sha256(own.decode(ids).encode()).hexdigest()
    assert sorted(r["doc_id"] for r in kept[4]) == sorted(r["doc_id"] for r in kept[3])


def test_run_has_the_rows_of_the_stages(spark):
    got = corpus_pipeline.run(spark, DIR)
    docs = table(spark, DIR, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("copies", [1, 2])
def test_stage_3_sends_no_own_shingles(spark, tmp_path, monkeypatch, copies):
    """After line dedup, the join's shuffle holds only shingles of two texts or more, however many shingles a bit of its filter there are: disk follows what is repeated."""
    kept, line = "by of the\nin an or to", "a line that every document here has and that goes"
    rows = [(1000 * c + k, "\n".join([kept, line, " ".join(f"w{k}_{j}" for j in range(60))]), "en", "x", 0) for c in range(copies) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    (_, dedup), (_, join) = corpus_pipeline.STAGES[1:3]
    dedup(spark, docs, DIR).write.parquet(f"{tmp_path}/1")
    found, measure = [], jaccard_join.measure
    monkeypatch.setattr(jaccard_join, "measure", lambda texts: (found.append(measure(texts)), found[-1])[1])
    monkeypatch.setattr(jaccard_join, "LEAST_BITS", 1 << 11)
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 1 << 11)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert sum(line in t for t in texts.values()) == 1
    got = join(spark, spark.read.parquet(f"{tmp_path}/1"), DIR)
    assert {r["doc_id"] for r in got.collect()} == {i for i, (_, c) in brute_components(texts.items()).items() if c == i}
    raw = [t.encode() for t in set(texts.values())]
    sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    sent = [len(found[0][1].prefix(s, len(s) - jaccard_join.needed(len(s), 80) + 1)) for s in sets]
    assert sum(sent) < len(sets) and sum(map(len, sets)) > 60 * len(sets)


def test_every_operator_is_registered():
    assert [sorted(q for q in queries.QUERIES if q.startswith(f"op{n}_")) != [] for n in range(1, 11)] == [True] * 10 and mixing.mix
