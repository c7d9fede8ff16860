"""What the vector searches share: valid rows, query groups of bounded size, and the best k of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import thrifty

#: Bytes of query vectors that are broadcast at once; more queries take more passes over the candidates.
GROUP_BYTES = 16 << 20
#: Queries of a group whose scores with each other give the first thresholds; how far rounding may take a score.
WARM, SLACK = 4096, 1e-9


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows whose vector is there, not empty, and has finite components only."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite)


def query_groups(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most GROUP_BYTES each and of one length; a vec_id that comes more than once is one query, with its least vector."""
    once = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    held: dict[int, tuple[list, list]] = {}
    for r in once.toLocalIterator():
        ids, rows = held.setdefault(len(r["embedding"]), ([], []))
        ids.append(r["vec_id"])
        rows.append(np.array(r["embedding"]))
        if len(ids) * len(rows[0]) * 8 >= GROUP_BYTES:
            yield np.array(ids, np.int64), np.array(rows)
            ids.clear()
            rows.clear()
    for ids, rows in held.values():
        if ids:
            yield np.array(ids, np.int64), np.array(rows)


class Best:
    """The k best of each query so far: higher scores first, ties to smaller ids. least: a score that k candidates of the query are known to reach, less what rounding may do."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None, kind: type = np.float64) -> None:
        self.k = k
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
        self.least = np.full(queries, -np.inf) if least is None else least.copy()

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], lowered(s[last].astype(float)))


def lowered(x: np.ndarray) -> np.ndarray:
    return x - SLACK * (1 + np.abs(x))


Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def first_least(matrix: np.ndarray, k: int, measure: Measure) -> np.ndarray:
    """Of each query the k-th best score among at most WARM other queries, which are candidates, too; -inf if there are fewer."""
    out, warm = np.full(len(matrix), -np.inf), matrix[:WARM]
    if len(warm) > k:
        for lo in range(0, len(matrix), 1024):
            m = measure(matrix[lo : lo + 1024], warm).astype(float)
            own = np.arange(lo, min(lo + len(m), len(warm)))
            m[own - lo, own] = -np.inf
            out[lo : lo + len(m)] = lowered(np.partition(m, len(warm) - k, axis=1)[:, len(warm) - k])
    return out


Blocks = Iterator[tuple[np.ndarray, np.ndarray]]


def blocks(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Blocks:
    """(ids, matrix) of at most rows candidates each, of the rows of length dim."""
    for b in batches:
        ids, col = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        fits = np.flatnonzero(np.diff(col.offsets.to_numpy()) == dim)
        if len(fits) < len(ids):
            ids, col = ids[fits], col.take(pa.array(fits))
        x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        for at in range(0, len(ids), rows):
            yield ids[at : at + rows], x[at : at + rows]


def search(candidates: DataFrame, queries: DataFrame, k: int, work: Callable[[np.ndarray, np.ndarray, Blocks, Best], object], rows: int, measure: Measure, kind: str = "double") -> DataFrame:
    """(query_id, rank, vec_id, score): each task keeps the k best of its candidates for each query by work(); the k best of these are the result.

    queries are some of the candidates. They are taken in groups of bounded size, each against all
    candidates; what is shuffled is k rows a query and task. measure: scores of two matrices, for the
    first thresholds, so that bounds and stopping tests act from a task's first block on.
    """
    spark, out, dtype = candidates.sparkSession, None, np.int64 if kind == "long" else np.float64
    for ids, matrix in query_groups(queries):
        group = spark.sparkContext.broadcast((ids, matrix, first_least(matrix, k, measure)))

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            ids, matrix, least = group.value
            best = Best(len(ids), k, least, dtype)
            work(ids, matrix, blocks(batches, matrix.shape[1], rows), best)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

        part = candidates.mapInArrow(thrifty(run), f"query_id long, vec_id long, score {kind}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"query_id long, vec_id long, score {kind}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
