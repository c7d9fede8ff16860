"""Exact top-k inner products by multi-resolution segment statistics: coarse to fine bounds, then exact values for survivors."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import Best, Blocks, search, valid

#: Segments of each resolution, coarse to fine.
LEVELS = (4, 8, 16)
ROWS, QUERIES = 4096, 1024
#: Queries of a tile on which the levels are tried before the others; a product for a pair alone costs so many in a matrix.
TRIED, ALONE = 32, 12.0
LONG = 2**63 - 1


def segment_statistics(x: np.ndarray, segments: int | np.ndarray) -> np.ndarray:
    """Means and deviations of each row's segments (so many even ones, or by their edges), each times the root of the segment's length.

    For the statistics a and b of two rows, |a - b| is a lower bound of the rows' distance (each segment's
    mean and deviation differ at most as its points do); as |a| and |b| are the rows' own norms, a . b is
    the matching upper bound of their inner product.
    """
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int) if isinstance(segments, int) else segments
    root = np.sqrt(np.diff(edges))
    mean = np.add.reduceat(x, edges[:-1], axis=1) / root
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.hstack([mean, np.sqrt(np.maximum(0, square - mean * mean))])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as doubles where these hold them and else rounded once from whole ones."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= 2**53:
        whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object)
        return (whole(q) @ whole(x).T).astype(float)
    return q @ x.T


def pair_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of rows as longs; what is beyond a long is the largest or smallest one."""
    if q.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= 2**53:
        return np.array([max(-LONG, min(LONG, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], np.int64)
    return (q * x).sum(axis=1).astype(np.int64)


class Resolutions:
    """Queries in the basis of their own principal axes, from their mean, with statistics by segments of even variance.

    q . x = q . c + (q R) . ((x - c) R) for any centre c and orthonormal R; this choice puts as much of the
    product as can be into few, short segments.
    """

    def __init__(self, queries: np.ndarray, levels: tuple[int, ...]) -> None:
        self.centre = queries.mean(axis=0)
        x = queries - self.centre
        spread, axes = np.linalg.eigh(x.T @ x / len(x)) if np.isfinite(x).all() and float(np.abs(x).max(initial=0.0)) < 1e150 else (np.ones(x.shape[1]), np.eye(x.shape[1]))
        self.axes = axes[:, ::-1]
        share = np.append(0, np.cumsum(np.maximum(spread[::-1], 1e-12 * max(spread[-1], 1e-300))))
        cuts = [np.searchsorted(share, share[-1] * np.arange(1, n) / n) for n in levels]
        self.edges = [np.unique(np.concatenate([[0], np.clip(c, 0, x.shape[1] - 1)])) for c in cuts]
        self.edges = [np.append(e, x.shape[1]) for e in self.edges]
        self.base = queries @ self.centre
        self.queries = [segment_statistics(queries @ self.axes, e) for e in self.edges]
        self.slack = np.sqrt((queries * queries).sum(axis=1))

    def of(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        y = (x - self.centre) @ self.axes
        return [segment_statistics(y, e) for e in self.edges], np.sqrt((x * x).sum(axis=1)) + np.sqrt(self.centre @ self.centre)

    def may(self, level: int, rows: np.ndarray, stats: list[np.ndarray], norms: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Pairs of the queries rows and candidates whose bound, with what rounding may do, reaches least."""
        bound = self.queries[level][rows] @ stats[level].T
        return bound + 1e-7 * self.slack[rows, None] * norms >= (least[rows] - self.base[rows])[:, None]


def best_products(levels: tuple[int, ...], ids: np.ndarray, queries: np.ndarray, candidates: Blocks, best: Best) -> dict[int, list[int]]:
    """Adds to best all candidates that may be among the k best of a query; the pairs (tried, left) by level.

    Each tile first tries all levels on a few queries. A level is used on the others if it drops more
    than it costs; survivors go on to the next one, and then to exact products: one by one where they
    are few, else the whole tile's in one matrix. Vectors without structure leave no level in use.
    """
    scale, count = Resolutions(queries, levels), {n: [0, 0] for n in levels}
    for c_ids, x in candidates:
        stats, norms = scale.of(x)
        for at in range(0, len(queries), QUERIES):
            rows = np.arange(at, min(at + QUERIES, len(queries)))
            use, left = [], 1.0
            few = rows[:: max(1, len(rows) // TRIED)]
            for n, _ in enumerate(levels):
                share = float(scale.may(n, few, stats, norms, best.least).mean())
                cost = scale.queries[n].shape[1] / x.shape[1]
                if left - share > cost and min(1.0, ALONE * share) + cost < min(1.0, ALONE * left):
                    use.append(n)
                    left = share
            may = None
            for n in use:
                if may is None:
                    may = scale.may(n, rows, stats, norms, best.least)
                    count[levels[n]][0] += may.size
                else:
                    count[levels[n]][0] += int(np.count_nonzero(may))
                    may &= scale.may(n, rows, stats, norms, best.least)
                count[levels[n]][1] += int(np.count_nonzero(may))
            if may is not None and np.count_nonzero(may) * ALONE < may.size:
                hits = [(r, np.flatnonzero(m)) for r, m in zip(rows, may, strict=True) if m.any()]
                hits = [(r, j[products(queries[r : r + 1], x[j])[0] >= best.least[r]]) for r, j in hits]
                r, j = np.repeat([r for r, _ in hits], [len(j) for _, j in hits]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(j for _, j in hits)])
            else:
                r, j = np.nonzero(products(queries[rows], x) >= best.least[rows, None])
                r = rows[r]
            own = ids[r] != c_ids[j]
            r, j = r[own], j[own]
            for lo in range(0, len(r), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                best.add(r[part], pair_products(queries[r[part]], x[j[part]]), c_ids[j[part]])
    return count


def top_products(vectors: DataFrame, is_query, k: int = 20, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score long): the k rows of the largest inner product with each query, but its own.

    vectors: (vec_id, embedding) of whole numbers. Vectors that are null, empty or hold null or
    non-finite components, and rows without vec_id, take no part; those of another length than a query
    aren't compared with it. Rows of a repeated vec_id are candidates each, but never of a query of that
    vec_id, which is one query, with its least vector. Ties go to the smaller vec_id; scores beyond a
    long are its largest or smallest value. An empty table gives no rows; other columns don't matter.
    """
    rows = valid(vectors)
    return search(rows, rows.filter(is_query), k, partial(best_products, levels), ROWS, products, "long")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of each vector whose vec_id is divisible by 20, in the manner of top_products."""
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * 64).cast("double"))
    clean = F.when(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), whole)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", clean.alias("embedding"))
    return top_products(vectors, F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 20
"""
