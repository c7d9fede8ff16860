"""op4 and op8 on the driver's tables and small ones, against models fitted again without Spark."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tempora.llm import quality, toxicity


def load(spark, d):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    return docs, {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op4_equals_a_second_fit(spark, sf):
    d = f"/root/testdata/{sf}"
    docs, labels = load(spark, d)
    x = {i: np.array(quality.statistics(t or "")) for i, t in docs.items()}
    use = [i for i in labels if crc(i) % 5 != 0]
    raw, y = np.array([x[i] for i in use]), np.array([labels[i][0] for i in use])
    center, scale = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-3)
    z = {i: np.clip((v - center) / scale, -quality.CLIP, quality.CLIP) for i, v in x.items()}
    train, k = np.array([z[i] for i in use]), raw.shape[1]
    covs = [np.cov(train[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(np.mean(y == c) * covs[c] for c in (0, 1))
    logs = {}
    for c in (0, 1):
        s = (1 - quality.POOL) * covs[c] + quality.POOL * pooled
        s = (1 - quality.RIDGE) * s + quality.RIDGE * (np.trace(s) / k + 1e-6) * np.eye(k)
        m, inv, det = train[y == c].mean(axis=0), np.linalg.inv(s), np.linalg.slogdet(s)[1]
        for i, v in z.items():
            logs[i, c] = math.log(np.mean(y == c)) - 0.5 * (det + (v - m) @ inv @ (v - m))
    got = quality.op4_quality(spark, d).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        want = 1 / (1 + math.exp(min(500, logs[r["doc_id"], 0] - logs[r["doc_id"], 1])))
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (crc(r["doc_id"]) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]][0] for r in held]) >= 0.95


def second_fit(docs, labels):
    """The toxicity model by counting in Python."""
    use = [i for i in labels if crc(i) % 3 != 1 and i in docs]
    y = {i: labels[i][1] for i in use}
    n1 = sum(y.values())
    base, seen = n1 / len(use), {0: Counter(), 1: Counter()}
    for i in use:
        seen[y[i]].update({f for w in set(toxicity.LETTERS.findall((docs[i] or "").lower())) for f in toxicity.word_features(w)})
    tried = [f for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= toxicity.LEAST_DOCS]
    kept = {}
    for f in tried:
        p, q = seen[1][f], seen[0][f]
        s = p / (p + q)
        if s > base and (p + q) * (s * math.log(s / base) + ((1 - s) * math.log((1 - s) / (1 - base)) if q else 0)) >= math.log(len(tried)):
            kept[f] = (p, q)
    return kept, n1, len(use) - n1


@pytest.mark.parametrize("sf,least", [("sf0.001", 0.0), ("sf0.01", 0.75)])
def test_op8_equals_a_second_count(spark, sf, least):
    d = f"/root/testdata/{sf}"
    docs, labels = load(spark, d)
    kept, n1, n0 = second_fit(docs, labels)
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), toxicity.learnable(spark.read.parquet(f"{d}/labels.parquet"), 3, 1))
    assert set(model.weights) <= set(toxicity.nested(kept)) and all(g in kept for f in model.weights for g in [f])
    got, cache = toxicity.op8_toxicity(spark, d).collect(), {}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        clear = math.prod(1 - 1 / (1 + math.exp(-z)) for _, _, z in model.sentences(docs[r["doc_id"]] or "", cache))
        assert abs(r["score"] - (1 - clear)) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (crc(r["doc_id"]) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    bad = [r["predicted"] for r in held if labels[r["doc_id"]][1]]
    assert np.mean(bad) >= least and np.mean([r["predicted"] for r in held if not labels[r["doc_id"]][1]]) <= 0.01


def test_nested_features():
    n = {"^moro": (5, 0), "=moron": (5, 0), "^grum": (9, 1), "^grumb": (8, 0), "^grumbl": (8, 0), "=grumblex": (4, 0)}
    assert set(toxicity.nested(n)) == {"^moro", "^grum", "^grumbl", "=grumblex"}


def test_odd_rows(spark, tables):
    words = "sun tree house river stone cloud"
    rows = [(k, f"{words} {k % 7}. " + ("vilewort here." if k % 3 == 0 else "calm day.") if k else None) for k in range(240)]
    rows += [(None, words), (None, None), (500, ""), (501, "vilewort " * 20_000), (9, "other text of nine"), (9, "vilewort"), (9, None)]
    labels = [(k, 1 - int(k % 3 == 0), int(k % 3 == 0)) for k in range(240)] + [(5, None, None), (6, 2, 2), (7, -1, 7), (None, 1, 1), (8, 1, 0), (9999, 0, 1)]
    tables("labels", labels, "doc_id long, quality int, toxic int")
    d = tables("documents", [(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, score string, held_out int")
    for query, mod, out in ((toxicity.op8_toxicity, 3, 1), (quality.op4_quality, 5, 0)):
        got = query(spark, d).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r["score"] <= 1 and r["held_out"] is (r["doc_id"] is not None and crc(r["doc_id"]) % mod == out) for r in got)
    hit = {r["doc_id"]: r["predicted"] for r in toxicity.op8_toxicity(spark, d).collect()}
    assert hit[501] == 1 and hit[500] == hit[0] == hit[None] == 0
    assert np.mean([hit[k] == int(k % 3 == 0) for k in range(1, 240) if k != 9]) > 0.98
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("documents", "doc_id long, text string")):
        d = tables(name, [], schema)
        if name == "labels":
            assert {r["score"] for r in quality.op4_quality(spark, d).collect()} == {0.5} and max(r["score"] for r in toxicity.op8_toxicity(spark, d).collect()) < 0.7
    assert quality.op4_quality(spark, d).count() == toxicity.op8_toxicity(spark, d).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} " * 50) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, sample=10, sample_bytes=1000).bias <= 0
