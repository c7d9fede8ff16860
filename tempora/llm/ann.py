"""Approximate nearest neighbours: low-dimensional stable projections in a kd-tree; projected neighbours are verified, nearest first, until a chi-square test holds."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import Best, Blocks, search, valid

#: Dimensions of the projection; chance that a point nearer than the k-th has come up when a search stops.
DIMS, CHANCE, SEED = 24, 0.9, 7
LEAF, ROWS, QUERIES = 64, 16384, 128
#: Shares of the stopping distance up to which a search goes in turn; each looks again at how near the k-th is.
STEPS = (0.5, 0.8, 1.0)


def projection(dim: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """Gaussian (2-stable) directions: the projected distance of two points over their distance, squared, is chi-square with dims degrees of freedom."""
    return np.random.default_rng(seed).standard_normal((dim, dims))


def chi2_cdf(x: float, n: int) -> float:
    """Regularised lower incomplete gamma function of n / 2 at x / 2, by its series."""
    a, h = n / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    i = 1
    while term > 1e-16 * total:
        term *= h / (a + i)
        total += term
        i += 1
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_quantile(p: float, n: int) -> float:
    lo, hi = 0.0, 20.0 * n + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, n) < p else (lo, mid)
    return hi


class KdTree:
    """Points in leaf order, with each leaf's rows and box; nodes are split at the median of their widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                leaves.append(rows)
                continue
            p = points[rows]
            side = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            half = len(rows) // 2
            order = np.argpartition(p[:, side], half)
            todo += [rows[order[:half]], rows[order[half:]]]
        self.order = np.concatenate(leaves)
        self.start = np.cumsum([0] + [len(x) for x in leaves])
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def box_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of each query to each leaf's box: no point of the leaf is nearer."""
        out = np.zeros((len(q), len(self.low)))
        for d in range(q.shape[1]):
            out += np.square(np.maximum(0, np.maximum(self.low[:, d] - q[:, d, None], q[:, d, None] - self.high[:, d])))
        return out


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q @ x.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1)))


def nearest(dims: int, chance: float, ids: np.ndarray, queries: np.ndarray, candidates: Blocks, best: Best) -> tuple[int, int]:
    """Adds to best the nearest candidates found in each block's own tree; (pairs verified, pairs in all).

    Points come up by projected distance: leaves by their boxes, then the points in them. A query stops
    once the next point is so far that one as near as its k-th so far would have come up before with the
    given chance: the projected squared distance over the k-th one's reaches the chi-square quantile. Only
    points that come up are verified.
    """
    plan = projection(queries.shape[1], dims)
    stop, verified, pairs = chi2_quantile(chance, dims), 0, 0
    q_norm = np.sqrt((queries * queries).sum(axis=1))
    q_unit = queries / np.where(q_norm > 0, q_norm, 1)[:, None]
    q_flat = q_unit @ plan
    for c_ids, x in candidates:
        norm = np.sqrt((x * x).sum(axis=1))
        some = np.isfinite(norm) & (norm > 0)
        c_ids, x, norm = c_ids[some], x[some], norm[some]
        if not len(x):
            continue
        flat = (x / norm[:, None]) @ plan
        tree = KdTree(flat)
        c_ids, x, norm, flat = c_ids[tree.order], x[tree.order], norm[tree.order], flat[tree.order]
        length, far_from = np.diff(tree.start), (flat * flat).sum(axis=1)
        for at in range(0, len(queries), QUERIES):
            rows = np.flatnonzero(q_norm[at : at + QUERIES] > 0) + at
            pairs += len(rows) * len(x)
            reached = np.full(len(rows), -1.0)  # squared distance up to which points have come up
            boxes = tree.box_distances(q_flat[rows])
            for step in STEPS:
                # squared distance of unit vectors; all points come up while fewer than k are known
                limit = step * stop * np.maximum(2 - 2 * best.least[rows], 1e-12)
                leaves = (boxes < limit[:, None]).any(axis=0) & bool((limit > reached).any())
                cols = np.flatnonzero(np.repeat(leaves, length))
                if not len(cols):
                    continue
                q = q_flat[rows]
                far = np.maximum(0, (q * q).sum(axis=1)[:, None] + far_from[cols] - 2 * q @ flat[cols].T)
                up = (far < limit[:, None]) & (far >= reached[:, None])
                own, point = [], []
                for i in np.flatnonzero(up.any(axis=1)).tolist():
                    r, j = rows[i], cols[up[i]]
                    verified += len(j)
                    j = j[(x[j] @ queries[r]) / (q_norm[r] * norm[j]) >= best.least[r]]
                    own.append(np.full(len(j), r))
                    point.append(j)
                if own:
                    r, j = np.concatenate(own), np.concatenate(point)
                    other = ids[r] != c_ids[j]
                    r, j = r[other], j[other]
                    for lo in range(0, len(r), 1 << 16):
                        some = slice(lo, lo + (1 << 16))
                        # by the same sum whatever the place in the block, so that equal vectors tie
                        best.add(r[some], (x[j[some]] * queries[r[some]]).sum(axis=1) / (q_norm[r[some]] * norm[j[some]]), c_ids[j[some]])
                reached = np.maximum(reached, limit)
    return verified, pairs


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, dims: int = DIMS, chance: float = CHANCE) -> DataFrame:
    """(query_id, rank, vec_id, score double): the k nearest found by cosine to each query, but its own.

    Every row is indexed, each task's rows in trees of their own; scores are exact cosines in double
    precision. Vectors that are null, empty, zero or hold null or non-finite components, and rows without
    vec_id, take no part; those of another length than a query aren't compared with it. Ties go to the
    smaller vec_id; a repeated vec_id is one query (its least vector) and a candidate each, but never of
    its own queries. An empty table gives no rows.
    """
    rows = valid(vectors).filter(F.exists("embedding", lambda v: v != 0))
    return search(rows, rows.filter(is_query), k, partial(nearest, dims, chance), ROWS, cosines)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found by cosine of each vector whose vec_id is divisible by 50, in the manner of nearest_neighbours."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
