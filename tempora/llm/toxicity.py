"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table, text_slices, thrifty, without

#: Labelled documents that the model is fitted on, taken by hash of doc_id, and bytes of their texts: the sample ends with the one that goes beyond.
SAMPLE, SAMPLE_BYTES = 16_000, 128 << 20
#: A feature is tried if so many documents have it. It is kept if toxic ones have it so often that less than one of all features tried would by chance.
LEAST_DOCS = 3
#: What is added to counts before weights are first guessed, and how strongly the fit is held to these guesses.
SMOOTH, HOLD = 0.1, 0.01
PREFIXES = (4, 5, 6)
CACHE = 300_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\n?|[.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word itself (=) and its beginnings (^), which catch inflected and compound forms."""
    return ["=" + word] + ["^" + word[:n] for n in PREFIXES if len(word) > n]


@dataclass
class Model:
    """p(sentence) = sigmoid(bias + weights of its words' features); p(document) = 1 - product of 1 - p(sentence)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0

    def sentences(self, text: str, cache: dict[str, float]) -> list[tuple[int, int, float]]:
        """(start, end, z) of each sentence; spans are code points of the text."""
        out, get = [], cache.get
        for m in SENTENCE.finditer(text):
            z = self.bias
            for w in LETTERS.findall(m[0].lower()):
                x = get(w)
                if x is None:
                    if len(cache) > CACHE:
                        cache.clear()
                    x = cache[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
                z += x
            out.append((m.start(), m.end(), z))
        return out


def softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def noisy_or(zs: list[float]) -> float:
    return -math.expm1(-sum(map(softplus, zs)))


def fit_weights(rows: list[tuple[int, int, list[list[int]]]], guess: np.ndarray, steps: int = 400, hold: float = HOLD) -> tuple[np.ndarray, float]:
    """Weights and bias that fit (label, sentences without features, features of the other sentences), by Adam on the noisy-or likelihood.

    A squared penalty holds weights to the guess: without it words that come beside others in the sample
    would get little, as these explain their documents.
    """
    n = len(guess)
    y = np.array([r[0] for r in rows], float)
    empty = np.array([r[1] for r in rows], float)
    doc = np.array([d for d, r in enumerate(rows) for _ in r[2]], np.int64)
    sent = np.array([s for s, fs in enumerate(x for r in rows for x in r[2]) for _ in fs], np.int64)
    feat = np.array([f for r in rows for fs in r[2] for f in fs], np.int64)
    x = np.append(guess, -6.0)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sp = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        z = x[-1] + np.bincount(sent, x[feat], len(doc)) if len(doc) else np.zeros(0)
        clear = -(np.bincount(doc, sp(z), len(y)) if len(doc) else 0) - empty * sp(x[-1])  # log of 1 - p(document)
        clear = np.minimum(clear, -1e-9)
        by_doc = np.where(y > 0, np.exp(clear) / -np.expm1(clear), -1.0)  # slope of the loss in clear
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-x[-1]))
        by_sent = -by_doc[doc] * p if len(doc) else np.zeros(0)
        g = np.append(np.bincount(feat, by_sent[sent], n) if len(doc) else np.zeros(n), by_sent.sum() - (by_doc * empty).sum() * p0) / len(y)
        g[:-1] += hold / len(y) * (x[:-1] - guess)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:-1], float(x[-1])


def nested(kept: dict[str, tuple[int, int]]) -> list[str]:
    """kept (feature to its counts) less the features whose documents are those of a longer beginning of the same words, or of a word that has such a one."""
    out = []
    for f, n in sorted(kept.items()):
        if f[0] == "=":
            longer = any(kept.get("^" + f[1 : 1 + k]) == n for k in PREFIXES if len(f) - 1 > k)
        else:
            longer = any(g != f and g.startswith(f) and kept[g] == n for g in kept)
        if not longer:
            out.append(f)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model fitted on the documents of at most sample labelled rows, by hash of doc_id, with about sample_bytes of text.

    Null labels and those other than 0 and 1 are left out. Of a doc_id with several texts the one of the
    least hash counts, of one with several labels each. Without both labels among them no feature is kept,
    and every document scores low.
    """
    spark = docs.sparkSession
    fine = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y")).distinct()
    chosen = cut(fine.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample))
    ids = chosen.select("doc_id").distinct()
    once = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    held = once.select("doc_id", "t.text", F.coalesce(F.octet_length("t.text"), F.lit(0)).cast("long").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # over sample rows at most, without texts
    held = cut(held)
    within = held.select("doc_id", "_n").withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < sample_bytes).select("doc_id")
    seen = cut(held.join(F.broadcast(within), "doc_id").join(F.broadcast(chosen), "doc_id").select("text", "_y").repartition(partitions(spark)))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[str, list[int]] = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in {f for w in set(LETTERS.findall((text or "").lower())) for f in word_features(w)}:
                    count.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([c[1] for c in count.values()], pa.int64()), pa.array([c[0] for c in count.values()], pa.int64())], names=["f", "pos", "neg"])

    total = {r["_y"]: r["count"] for r in seen.groupBy("_y").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return Model()
    pos, neg = F.col("pos"), F.col("neg")
    tried = cut(
        seen.mapInArrow(thrifty(presence), "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(pos + neg >= LEAST_DOCS)
    )
    base, share, rest = n1 / (n1 + n0), pos / (pos + neg), neg / (pos + neg)
    # the chance that so many of its documents are toxic is at most exp(-odd)
    odd = (pos + neg) * (share * F.ln(share / base) + F.when(neg > 0, rest * F.ln(rest / (1 - base))).otherwise(0.0))
    got = tried.filter((share > base) & (odd >= math.log(max(tried.count(), 1)))).collect()  # by the sample's bound few
    kept = {r["f"]: (r["pos"], r["neg"]) for r in got}
    at = {f: i for i, f in enumerate(nested(kept))}
    guess = np.array([math.log((kept[f][0] + SMOOTH) / (n1 + 2 * SMOOTH)) - math.log((kept[f][1] + SMOOTH) / (n0 + 2 * SMOOTH)) for f in at])
    if not at:
        return Model()
    known = spark.sparkContext.broadcast(at)

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            empty, full = [], []
            for text in b.column(0).to_pylist():
                sents = [[known.value[f] for w in LETTERS.findall(m[0].lower()) for f in word_features(w) if f in known.value] for m in SENTENCE.finditer(text or "")]
                full.append([s for s in sents if s])
                empty.append(len(sents) - len(full[-1]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(empty, pa.int64()), pa.array(full, pa.list_(pa.list_(pa.int32())))], names=["y", "empty", "full"])

    got = seen.mapInArrow(thrifty(instances), "y int, empty long, full array<array<int>>").collect()
    rows = sorted((r["y"], r["empty"], [list(s) for s in r["full"]]) for r in got)
    w, bias = fit_weights(rows, guess)
    return Model({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-3}, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, spans: bool = True) -> DataFrame:
    """docs with score double, predicted int and, if wanted, offending: the spans (start, end, p) of sentences that alone reach the threshold, or else the worst one of a predicted document.

    The whole text is read. Null and empty texts have no sentence and score 0. Columns of those names
    are replaced, others stay.
    """
    names = ["score", "predicted"] + ["offending"] * spans
    docs = without(docs, *names)
    at, every = docs.columns.index("text"), [*docs.columns, *names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int" + ", offending array<struct<start:int,end:int,p:double>>" * spans
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            for lo, hi, raw, off in text_slices(b, at):
                data, scores, where = raw.tobytes(), [], []
                for i in range(hi - lo):
                    sents = known.value.sentences(data[off[i] : off[i + 1]].decode(), cache)
                    scores.append(noisy_or([z for _, _, z in sents]))
                    if spans:
                        ps = [{"start": a, "end": e, "p": 1 / (1 + math.exp(-z))} for a, e, z in sents] if scores[-1] >= threshold else []
                        where.append([s for s in ps if s["p"] >= threshold] or ps and [max(ps, key=lambda s: s["p"])])
                cols = [*(c.slice(lo, hi - lo) for c in b.columns), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(where, kind)] * spans, names=every)

    return docs.mapInArrow(thrifty(run), schema)


def learnable(labels: DataFrame, mod: int, out: int) -> DataFrame:
    """Rows that labels may be learned from: crc32 of doc_id as text mod mod isn't out."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % mod != out)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (false for a null doc_id), score, predicted and n_offending, the number of located sentences, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable(table(spark, sf_dir, "labels"), 3, 1))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
