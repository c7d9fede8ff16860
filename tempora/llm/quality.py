"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_slices, thrifty, without
from .toxicity import learnable

#: Shrinkage of each class covariance: towards the pooled one, then towards a multiple of the identity.
POOL, RIDGE = 0.2, 0.05
#: Standardised statistics are clipped here, so that one odd statistic cannot outweigh the others.
CLIP = 5.0
STATS = ("words", "word_chars", "letters", "upper", "digits", "marks", "mark_runs", "repeats", "distinct", "top_word", "pairs", "bare_marks", "line_words", "title_words")
RUN = re.compile(r"[^\w\s]{2,}")
OFTEN = 400


def share(part: float, whole: float) -> float:
    """Share of part in whole on the arcsine scale, which evens out its variance; 0 of 0 is 0."""
    return math.asin(math.sqrt(min(part / whole, 1.0))) if whole > 0 else 0.0


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: logs of counts and arcsines of shares, so that classes are nearer to normal."""
    words = text.split()
    n, chars = len(words), sum(map(len, words))
    count = Counter(words)
    upper, letters = sum(map(str.isupper, words)), sum(map(str.isalpha, words))
    bare = sum(v for w, v in count.items() if not any(map(str.isalnum, w)))
    runs = len(RUN.findall(text))
    marks = chars - len(re.findall(r"\w", text))
    digits = len(re.findall(r"\d", text))
    repeats = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n),
        math.log1p(chars / max(n, 1)),
        share(letters, n),
        share(upper, n),
        share(digits, chars),
        share(marks, chars),
        share(runs, n),
        share(repeats, n - 1),
        math.log((len(count) + 1) / (n + 1)) + 0.3 * math.log1p(n / OFTEN),
        share(max(count.values(), default=0), n),
        math.log((pairs + 1) / (n + 1)),
        share(bare, n),
        math.log1p(n / (text.count("\n") + 1)),
        share(sum(map(str.istitle, words)), n),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs less text, with stats: array of STATS."""
    at, names = docs.columns.index("text"), [c for c in docs.columns if c != "text"] + ["stats"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"] + ["stats array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, off in text_slices(b, at):
                data = raw.tobytes()
                stats = [statistics(data[off[i] : off[i + 1]].decode()) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for i, c in enumerate(b.columns) if i != at), pa.array(stats, pa.list_(pa.float64()))], names=names)

    return docs.mapInArrow(thrifty(run), schema)


@dataclass
class Discriminant:
    """Log odds of class 1: difference of log densities from Mahalanobis distances by cached Cholesky factors, plus that of priors."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        logs = []
        for m, inv in zip(self.means, self.factors, strict=True):  # inv: inverse of the Cholesky factor
            logs.append(-0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) + np.log(np.diag(inv)).sum())
        return logs[1] - logs[0] + self.prior


def moments(rows: DataFrame, d: int, center: np.ndarray, scale: np.ndarray) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(count, sum, sum of products) of standardised and clipped statistics for each class of rows (stats, y); a row a class and task is shuffled."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {y: [0, np.zeros(d), np.zeros((d, d))] for y in (0, 1)}
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            x = np.clip((b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - center) / scale, -CLIP, CLIP)
            for k, a in acc.items():
                xk = x[y == k]
                a[0] += len(xk)
                a[1] += xk.sum(axis=0)
                a[2] += xk.T @ xk
        out = [(y, i, float(v)) for y, (n, s, p) in acc.items() for i, v in enumerate([n, *s, *p.ravel()]) if n]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.float64())], names=["y", "i", "v"])

    got = rows.mapInArrow(thrifty(part), "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) rows at most
    flat = {y: np.zeros(1 + d + d * d) for y in (0, 1)}
    for r in got:
        flat[r["y"]][r["i"]] = r["v"]
    return {y: (int(f[0]), f[1 : 1 + d], f[1 + d :].reshape(d, d)) for y, f in flat.items() if f[0]}


def fit(rows: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Discriminant | None:
    """The discriminant of rows (stats, y); None unless both classes have a row."""
    d = len(STATS)
    sums = rows.select(*[F.avg(F.col("stats")[i]).alias(f"a{i}") for i in range(d)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]).first()
    if sums is None or sums["a0"] is None:
        return None
    center, scale = np.array([sums[f"a{i}"] for i in range(d)]), np.array([max(sums[f"s{i}"], 1e-3) for i in range(d)])
    m = moments(rows, d, center, scale)
    if len(m) < 2:
        return None
    means = {y: s / n for y, (n, s, _) in m.items()}
    covs = {y: p / n - np.outer(means[y], means[y]) for y, (n, _, p) in m.items()}
    total = sum(n for n, _, _ in m.values())
    pooled = sum(m[y][0] / total * covs[y] for y in m)
    factors = []
    for y in (0, 1):
        c = (1 - pool) * covs[y] + pool * pooled
        c = (1 - ridge) * c + ridge * (np.trace(c) / d + 1e-6) * np.eye(d)
        factors.append(np.linalg.inv(np.linalg.cholesky(c)))
    return Discriminant(center, scale, [means[0], means[1]], factors, math.log(m[1][0] / m[0][0]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """docs less text with score double (nearness to class 1, 0 to 1) and predicted int.

    labels (doc_id, label): what the model may learn from; all of them are used, but null labels and
    those other than 0 and 1; several rows of a doc_id count each. Null and empty texts have the
    statistics of no words and a score like others. Where a class has no rows, the score is the share of
    class 1 (0.5 without labels). Columns score, predicted and stats are replaced.
    """
    docs = without(docs, "score", "predicted", "stats")
    stats = cut(with_statistics(docs))
    chosen = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    rows = cut(stats.join(chosen, stats["doc_id"] == chosen["_id"]).select("stats", "_y"))
    model, mean = fit(rows), rows.agg(F.avg("_y")).first()[0]
    mean = 0.5 if mean is None else mean
    names = [c for c in stats.columns if c != "stats"] + ["score", "predicted"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name != "stats"] + ["score double, predicted int"])
    at, d = stats.columns.index("stats"), len(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            s = np.full(len(x), mean) if model is None else 1 / (1 + np.exp(-np.clip(model.log_odds(x), -500, 500)))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)

    return stats.mapInArrow(thrifty(run), schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (false for a null doc_id), score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, learnable(table(spark, sf_dir, "labels"), 5, 0))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
