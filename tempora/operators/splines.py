"""Paths through nodes by parametric cubic splines: sampled finely, projected on and read as paths of short edges, with tangents of the curve itself."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .geometry import Nodes

#: Short edges between two nodes; points times edges that are measured at a time.
FINE, PAIRS = 50, 1 << 20


def curvatures(u: np.ndarray, y: np.ndarray, shut: bool = False) -> np.ndarray:
    """Second derivatives at u of the cubic spline through (u, y): periodic if shut (y ends as it begins), else without a knot at the second and the last but one u."""
    n, h, d = len(u), np.diff(u), np.diff(y) / np.diff(u)
    a, b = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        b[k] = 6 * (d[k] - d[k - 1])
    if shut:
        a[0, 0], a[0, -1] = 1, -1
        a[-1, 0], a[-1, 1], a[-1, -2], a[-1, -1] = 2 * h[0], h[0], h[-1], 2 * h[-1]
        b[-1] = 6 * (d[0] - d[-1])
    else:
        a[0, :3] = h[1], -(h[0] + h[1]), h[0]
        a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(a, b)


@dataclass(frozen=True)
class Spline:
    """A curve through nodes: knots u by chord length from 0 to 1, polynomials (a + b s + c s s + d s s s with s from a knot on) of x and y, and its samples with the length up to each."""

    u: np.ndarray
    x: np.ndarray
    y: np.ndarray
    samples: np.ndarray
    at: np.ndarray
    along: np.ndarray

    @property
    def length(self) -> float:
        return float(self.along[-1])

    @property
    def edge_lengths(self) -> np.ndarray:
        """Lengths between nodes."""
        return np.diff(np.interp(self.u, self.at, self.along))

    def point(self, u: np.ndarray, order: int = 0) -> np.ndarray:
        """(x, y), or their first derivatives, at u."""
        k = np.clip(np.searchsorted(self.u, u, side="right") - 1, 0, len(self.u) - 2)
        s = u - self.u[k]
        return np.stack([_value(*p[k].T, s, order) for p in (self.x, self.y)], axis=-1)


def _value(a, b, c, d, s, order: int = 0):
    return a + s * (b + s * (c + s * d)) if order == 0 else b + s * (2 * c + s * 3 * d)


def spline(nodes: Nodes, shut: bool = False, fine: int = FINE) -> Spline:
    """The curve through nodes, four or more, closed if shut."""
    if len(nodes) < 4:
        raise ValueError("a spline has four nodes or more")
    p = np.array([*nodes, nodes[0]] if shut and tuple(nodes[0]) != tuple(nodes[-1]) else nodes, float)
    chord = np.hypot(*np.diff(p, axis=0).T)
    if (chord == 0).any():
        raise ValueError("two nodes in a row are the same")
    u = np.append(0, np.cumsum(chord)) / chord.sum()

    def pieces(y: np.ndarray) -> np.ndarray:
        h, m = np.diff(u), curvatures(u, y, shut)
        return np.stack([y[:-1], np.diff(y) / h - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / (6 * h)], axis=1)

    curve = Spline(u, pieces(p[:, 0]), pieces(p[:, 1]), np.zeros((0, 2)), np.zeros(0), np.zeros(0))
    at = np.interp(np.linspace(0, len(u) - 1, (len(u) - 1) * fine + 1), np.arange(len(u)), u)
    samples = curve.point(at)
    return Spline(u, curve.x, curve.y, samples, at, np.append(0, np.cumsum(np.hypot(*np.diff(samples, axis=0).T))))


def numbers(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def place(x: Column, rising: np.ndarray) -> Column:
    """The last k with rising[k] <= x, from 0 to its length - 2, by halving."""

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < float(rising[mid]), search(lo, mid)).otherwise(search(mid, hi))

    return search(0, len(rising) - 1)


def nearest(x: np.ndarray, y: np.ndarray, curve: Spline) -> tuple[np.ndarray, ...]:
    """(distance, edge of the nodes, signed distance, px, py, along) of the nearest place of points, the first of equals."""
    s, step = curve.samples[:-1], np.diff(curve.samples, axis=0)
    n, fine = np.hypot(*step.T), len(step) // (len(curve.u) - 1)
    r = np.clip(((x[:, None] - s[:, 0]) * step[:, 0] + (y[:, None] - s[:, 1]) * step[:, 1]) / n, 0, n)
    px, py = s[:, 0] + r * step[:, 0] / n, s[:, 1] + r * step[:, 1] / n
    d = np.hypot(x[:, None] - px, y[:, None] - py)
    k, row = np.argmin(np.round(d, 12), axis=1), np.arange(len(x))
    side = np.where(step[k, 0] * (y - s[k, 1]) - (x - s[k, 0]) * step[k, 1] < 0, -1.0, 1.0)
    return d[row, k], (k // fine).astype(np.int32), side * d[row, k], px[row, k], py[row, k], curve.along[k] + r[row, k]


def to_spline(points: DataFrame, curve: Spline) -> DataFrame:
    """points (x, y) with path: struct(ad distance, edge of the nodes, d signed, px, py, along the whole): the nearest place, the first of equals; of nulls for a point without x or y."""
    step = max(1, PAIRS // (len(curve.samples) - 1))

    @arrow_udf("ad double, edge int, d double, px double, py double, along double")
    def place_of(x: pa.Array, y: pa.Array) -> pa.Array:
        u, v = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y))
        parts = [nearest(u[lo : lo + step], v[lo : lo + step], curve) for lo in range(0, len(u), step)]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0), np.zeros(0, np.int32), *[np.zeros(0)] * 4]
        none = np.isnan(u) | np.isnan(v)
        return pa.StructArray.from_arrays([pa.array(c, mask=none) for c in cols], names=["ad", "edge", "d", "px", "py", "along"])

    return points.withColumn("path", place_of(F.col("x").cast("double"), F.col("y").cast("double")))


def from_spline(rows: DataFrame, curve: Spline, along: str = "along", off: str | None = None) -> DataFrame:
    """rows with point: struct(edge, x, y, tangent) at a distance along the samples, and off to its left if a column says so; null beyond the ends. The tangent is the curve's."""
    a, fine = F.col(along), (len(curve.samples) - 1) // (len(curve.u) - 1)
    inside = (a >= 0) & (a <= curve.length)
    out = rows.withColumn("_k", place(F.coalesce(F.least(F.greatest(a, F.lit(0.0)), F.lit(curve.length)), F.lit(0.0)), curve.along))
    pick = lambda x: numbers(x)[F.col("_k")]
    before, size = pick(curve.along[:-1]), pick(np.diff(curve.along))
    out = out.withColumn("_s", (a - before) / size)
    u = pick(curve.at[:-1]) + F.col("_s") * pick(np.diff(curve.at))
    out = out.withColumns({"_e": F.floor(F.col("_k") / fine).cast("int"), "_u": u})
    rest = F.col("_u") - numbers(curve.u[:-1])[F.col("_e")]
    slope = [_value(*[numbers(p[:, j])[F.col("_e")] for j in range(4)], rest, 1) for p in (curve.x, curve.y)]
    out = out.withColumn("_t", F.atan2(slope[1], slope[0]))
    shift = F.coalesce(F.col(off), F.lit(0.0)) if off else F.lit(0.0)
    x, y = (pick(curve.samples[:-1, j]) + F.col("_s") * pick(np.diff(curve.samples[:, j])) for j in (0, 1))
    point = F.struct(F.col("_e").alias("edge"), (x - shift * F.sin("_t")).alias("x"), (y + shift * F.cos("_t")).alias("y"), F.col("_t").alias("tangent"))
    return out.withColumn("point", F.when(inside, point)).drop("_k", "_s", "_e", "_u", "_t")


def spline_box(curve: Spline) -> tuple[float, float, float, float]:
    """(x0, y0, x1, y1) of the samples."""
    return (*curve.samples.min(axis=0).tolist(), *curve.samples.max(axis=0).tolist())
