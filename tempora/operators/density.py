"""Gaussian mixtures (source, comp_id, weight, mean, var) and mixed kernels: evaluation as joins, merging of samples by source."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import range_join

#: Squared distance beyond which a component adds nothing.
CUTOFF = 16.0


def distance2(x: Column, mean: Column, var: Column, dims: list[int]) -> Column:
    """Squared Mahalanobis distance over the given elements of arrays, for a diagonal covariance."""
    return reduce(lambda a, b: a + b, [(x[d] - mean[d]) * (x[d] - mean[d]) / var[d] for d in dims])


def scale(var: Column, dims: list[int]) -> Column:
    """One over the integral of exp(-q / 2)."""
    return 1 / F.sqrt(reduce(lambda a, b: a * b, [var[d] * (2 * math.pi) for d in dims]))


def samples_to_components(samples: DataFrame, var: list[float], dims: list[int]) -> DataFrame:
    """One component of weight 1 / n (by source) for each sample (source, id, x)."""
    n = samples.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    return samples.join(n, "source").select("source", F.col("id").alias("comp_id"), (1 / F.col("_n")).alias("weight"), F.array(*[F.col("x")[d].cast("double") for d in dims]).alias("mean"), F.array(*[F.lit(float(v)) for v in var]).alias("var"))


def marginalize(components: DataFrame, dims: list[int]) -> DataFrame:
    """Components over the kept dimensions."""
    return components.withColumns({"mean": F.array(*[F.col("mean")[d] for d in dims]), "var": F.array(*[F.col("var")[d] for d in dims])})


def near_pairs(points: DataFrame, components: DataFrame, dims: list[int], cutoff: float = CUTOFF, width: float | None = None) -> DataFrame:
    """Points (source, id, x) with components of their source within the cutoff, and their squared distance q.

    The first dimension's cut-off interval of each component is a range join, so that a point meets only
    the components about it; width is about that interval's usual length.
    """
    r = F.sqrt(cutoff * F.col("var")[dims[0]])
    box = components.withColumns({"start": F.col("mean")[dims[0]] - r, "stop": F.col("mean")[dims[0]] + r})
    at = points.withColumn("_x", F.col("x")[dims[0]])
    pairs = range_join(at, box, width, ("source",), "_x", closed=True) if width else at.join(box, "source")
    return pairs.withColumn("q", distance2(F.col("x"), F.col("mean"), F.col("var"), dims)).filter(F.col("q") <= cutoff).drop("_x", "start", "stop")


def evaluate(points: DataFrame, components: DataFrame, dims: list[int], width: float | None = None) -> DataFrame:
    """points with density: weighted components within the cutoff; 0 where there is none."""
    pairs = near_pairs(points, components, dims, width=width)
    got = pairs.groupBy("source", "id").agg(F.sum(F.col("weight") * scale(F.col("var"), dims) * F.exp(-F.col("q") / 2)).alias("density"))
    return points.join(got, ["source", "id"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def on_grid(components: DataFrame, grid: list[float], dim: int = 0) -> DataFrame:
    """(source, g, density) of one dimension at grid points, which are driver constants: each component is sent to those within its cutoff and summed before the shuffle."""
    at = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(float(x)).alias("x")) for g, x in enumerate(grid)])).alias("_g")
    q = (F.col("_g.x") - F.col("mean")[dim]) * (F.col("_g.x") - F.col("mean")[dim]) / F.col("var")[dim]
    near = components.select("source", "weight", "mean", "var", at).withColumn("_q", q).filter(F.col("_q") <= CUTOFF)
    return near.groupBy("source", F.col("_g.g").alias("g")).agg(F.sum(F.col("weight") * scale(F.col("var"), [dim]) * F.exp(-F.col("_q") / 2)).alias("density"))


def grid_sums(rows: DataFrame, keys: list[str], grid: list[float], values, *more: Column) -> DataFrame:
    """(keys, sums array over the grid, more): values(x) is a column for the grid point x; one row a group is shuffled, not one a grid point."""
    sums = [F.sum(values(float(x))) for x in grid]
    return rows.groupBy(*keys).agg(F.array(*sums).alias("sums"), *more)


def marginal_at(dim: int, weight: Column | None = None):
    """Density of a component in one dimension at a point, 0 beyond the cutoff, as grid_sums takes it."""

    def value(x: float) -> Column:
        q = (x - F.col("mean")[dim]) * (x - F.col("mean")[dim]) / F.col("var")[dim]
        return F.when(q <= CUTOFF, (F.col("weight") if weight is None else weight) * scale(F.col("var"), [dim]) * F.exp(-q / 2)).otherwise(0.0)

    return value


def moment_match(components: DataFrame, keys: list[str], dims: list[int]) -> DataFrame:
    """(keys, weight, mean, var): one diagonal component with the weight, mean and variance of each group."""
    w = F.col("weight")
    m = components.groupBy(*keys).agg(F.sum(w).alias("weight"), *[(F.sum(w * F.col("mean")[d]) / F.sum(w)).alias(f"m{d}") for d in dims], *[(F.sum(w * (F.col("var")[d] + F.col("mean")[d] * F.col("mean")[d])) / F.sum(w)).alias(f"s{d}") for d in dims])
    return m.select(*keys, "weight", F.array(*[F.col(f"m{d}") for d in dims]).alias("mean"), F.array(*[F.col(f"s{d}") - F.col(f"m{d}") * F.col(f"m{d}") for d in dims]).alias("var"))


def mixed_kernel(data: Column, point: Column, kernels: list[tuple[str, float]]) -> Column:
    """Product kernel over array elements: gaussian (cut at squared distance CUTOFF), epanechnikov or box (jointly over their dimensions), vonmises (exp of kappa cos) and delta (equal values)."""
    gauss, ball, kind, rest = F.lit(0.0), F.lit(0.0), None, F.lit(1.0)
    for d, (name, h) in enumerate(kernels):
        u = (data[d] - point[d]) / h
        if name == "gaussian":
            gauss = gauss + u * u
        elif name in ("epanechnikov", "box"):
            ball, kind = ball + u * u, name
        elif name == "vonmises":
            rest = rest * F.exp(h * F.cos(data[d] - point[d]))
        elif name == "delta":
            rest = rest * F.when(data[d] == point[d], 1.0).otherwise(0.0)
        else:
            raise ValueError(f"no kernel called {name}")
    value = F.when(gauss <= CUTOFF, F.exp(-gauss / 2)).otherwise(0.0) * rest
    if kind:
        value = value * F.when(ball <= 1, 1 - ball if kind == "epanechnikov" else F.lit(1.0)).otherwise(0.0)
    return value


def mixed_density(points: DataFrame, data: DataFrame, kernels: list[tuple[str, float]], width: float | None = None) -> DataFrame:
    """(source, id, value): mean kernel of a source's data (source, y, weight) at each point (source, id, x); with width, a range join on the first dimension, whose kernel must be cut off."""
    reach = {"gaussian": math.sqrt(CUTOFF), "epanechnikov": 1.0, "box": 1.0}.get(kernels[0][0])
    if width and reach:
        h = reach * kernels[0][1]
        near = range_join(points.withColumn("_x", F.col("x")[0]), data.withColumns({"start": F.col("y")[0] - h, "stop": F.col("y")[0] + h}), width, ("source",), "_x", closed=True)
    else:
        near = points.join(data, "source")
    total = data.groupBy("source").agg(F.sum("weight").alias("_w"))
    got = near.groupBy("source", "id").agg(F.sum(F.col("weight") * mixed_kernel(F.col("y"), F.col("x"), kernels)).alias("s"))
    return got.join(total, "source").select("source", "id", (F.col("s") / F.col("_w")).alias("value"))


class Cells:
    """Which components a sample may join: a grid of cells over the first dimensions, as wide as a sample's own reach either way. A component is listed in each cell that its reach touches, and in more as it moves and widens; what would take too many is looked at for every sample."""

    #: Dimensions of the grid, and cells of a component.
    DIMS, MOST = 3, 64

    def __init__(self, var: np.ndarray, threshold: float) -> None:
        self.dims, self.threshold = min(self.DIMS, len(var)), threshold
        self.size = 2 * threshold * np.sqrt(var[: self.dims])
        self.cells: dict[tuple[int, ...], list[int]] = {}
        self.listed: dict[int, tuple] = {}
        self.wide: list[int] = []

    def put(self, j: int, mean: np.ndarray, var: np.ndarray) -> None:
        """Lists component j where samples may be nearer than the threshold: each dimension alone bounds the distance."""
        reach = self.threshold * np.sqrt(var[: self.dims])
        low, high = (np.floor((mean[: self.dims] + side * reach) / self.size).astype(np.int64) for side in (-1, 1))
        before = self.listed.get(j)
        if before == () or before and (before[0] <= low).all() and (before[1] >= high).all():
            return
        if before:
            low, high = np.minimum(low, before[0]), np.maximum(high, before[1])
        if np.prod(high - low + 1.0) > self.MOST:
            self.listed[j] = ()
            self.wide.append(j)
            return
        self.listed[j] = (low, high)
        for cell in itertools.product(*(range(u, v + 1) for u, v in zip(low.tolist(), high.tolist(), strict=True))):
            if not before or any(c < u or c > v for c, u, v in zip(cell, before[0], before[1], strict=True)):
                self.cells.setdefault(cell, []).append(j)

    def near(self, x: np.ndarray) -> np.ndarray:
        """Components that x may join, in order."""
        at = tuple(np.floor(x[: self.dims] / self.size).astype(np.int64).tolist())
        return np.array(sorted({*self.cells.get(at, ()), *self.wide}), np.int64)


def merge_source(x: np.ndarray, var: np.ndarray, threshold: float, method: str = "diagonal", ends: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | list[int]:
    """(members, means, variances) after each sample, in order, joined the component nearest by Mahalanobis distance if nearer than threshold, or else began one.

    method: what a component's covariance becomes. diagonal: variances match the moments; full: all
    covariances do (variances are then matrices); constant: it stays that of a sample. A sample is compared
    with the components about it only. ends: instead the number of components after so many samples each.
    """
    n, d = x.shape
    start = np.diag(var) if method == "full" else np.asarray(var, float)
    if threshold <= 0:
        return list(ends) if ends is not None else (np.ones(n), x.astype(float), np.broadcast_to(start, (n, *start.shape)).copy())
    count, mean, cov = np.zeros(n), np.zeros((n, d)), np.zeros((n, *start.shape))
    cells, grown, k = Cells(np.asarray(var, float), threshold), [], 0
    own = lambda j: np.diag(cov[j]) if method == "full" else cov[j]
    for i, row in enumerate(x):
        near = cells.near(row)
        if len(near):
            far = row - mean[near]
            q = np.einsum("ki,ki->k", far, np.linalg.solve(cov[near], far[:, :, None])[:, :, 0]) if method == "full" else (far * far / cov[near]).sum(axis=1)
            best = int(np.argmin(q))
            j = int(near[best])
        if len(near) and q[best] < threshold * threshold:
            m = count[j]
            step = (row - mean[j]) / (m + 1)
            if method != "constant":
                # the moments of the component and a sample about their common mean
                outer = np.outer(step, step) if method == "full" else step * step
                cov[j] = (m * (cov[j] + outer) + start + m * m * outer) / (m + 1)
            mean[j] += step
            count[j] = m + 1
        else:
            j = k
            count[j], mean[j], cov[j] = 1, row, start
            k += 1
        cells.put(j, mean[j], own(j))
        if ends is not None and len(grown) < len(ends) and i + 1 == ends[len(grown)]:
            grown.append(k)
    return grown if ends is not None else (count[:k], mean[:k], cov[:k])


def merge_samples(samples: DataFrame, var: list[float], dims: list[int], threshold: float, method: str = "diagonal") -> DataFrame:
    """Components of each source's samples (source, id, x), taken in order of id; with method full also cov, their covariances. A source is one task's work, by nature of the method; threshold 0 merges nothing, and then there is no Python group, and a window numbers samples."""
    if threshold <= 0:
        return _unmerged(samples, var, dims, method)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["x"].to_numpy()).astype(float)[:, dims]
        n, m, v = merge_source(x, np.array(var, float), threshold, method)
        full = {"cov": [c.tolist() for c in v]} if method == "full" else {}
        return pd.DataFrame({"source": pdf["source"].iloc[0], "comp_id": np.arange(len(n)), "weight": n / n.sum(), "mean": list(m), "var": [np.diag(c) for c in v] if method == "full" else list(v), **full})

    kind = samples.schema["source"].dataType.simpleString()
    return samples.groupBy("source").applyInPandas(merge, f"source {kind}, comp_id long, weight double, mean array<double>, var array<double>" + ", cov array<array<double>>" * (method == "full"))


def _unmerged(samples: DataFrame, var: list[float], dims: list[int], method: str) -> DataFrame:
    """A component of each sample, comp_id its place in the source by id."""
    n = samples.groupBy(F.col("source").alias("_z")).agg(F.count(F.lit(1)).alias("_n"))
    kept = samples.select("source", "id", F.array(*[F.col("x")[d].cast("double") for d in dims]).alias("mean"))
    # a window that sorts and spills; where comp_id isn't asked for there is none
    numbered = kept.withColumn("comp_id", (F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1).cast("long"))
    out = numbered.join(n, F.col("source").eqNullSafe(F.col("_z"))).select("source", "comp_id", (1.0 / F.col("_n")).alias("weight"), "mean", F.array(*[F.lit(float(v)) for v in var]).alias("var"))
    full = F.array(*[F.array(*[F.lit(float(v) if i == j else 0.0) for j in range(len(var))]) for i, v in enumerate(var)])
    return out.withColumn("cov", full) if method == "full" else out


def merge_curve(samples: DataFrame, var: list[float], dims: list[int], threshold: float, batch: int = 25, method: str = "diagonal") -> DataFrame:
    """(source, n_samples, n_components) after each batch of a source's samples in order of id, in one pass over them."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("id")["x"].to_numpy()).astype(float)[:, dims]
        ends = [*range(batch, len(x), batch), len(x)]
        return pd.DataFrame({"source": pdf["source"].iloc[0], "n_samples": ends, "n_components": merge_source(x, np.array(var, float), threshold, method, ends)})

    kind = samples.schema["source"].dataType.simpleString()
    return samples.groupBy("source").applyInPandas(grow, f"source {kind}, n_samples long, n_components long")


def sparsify(samples: DataFrame, dims: list[int], threshold: float) -> DataFrame:
    """(source, comp_id, mean, weight): each sample, in order of id, joins the nearest running mean if nearer than threshold, or else begins one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("id")["x"].to_numpy()).astype(float)[:, dims]
        n, m, _ = merge_source(x, np.ones(len(dims)), threshold, "constant")
        return pd.DataFrame({"source": pdf["source"].iloc[0], "comp_id": np.arange(len(n)), "mean": list(m), "weight": n})

    kind = samples.schema["source"].dataType.simpleString()
    return samples.groupBy("source").applyInPandas(run, f"source {kind}, comp_id long, mean array<double>, weight double")


def moment_match_full(components: DataFrame, keys: list[str], dims: list[int]) -> DataFrame:
    """(keys, weight, mean, cov): one component with the weight, mean and covariance of each group's components (weight, mean, cov)."""
    w = F.col("weight")
    means = [(F.sum(w * F.col("mean")[d]) / F.sum(w)).alias(f"m{d}") for d in dims]
    seconds = [(F.sum(w * (F.col("cov")[i][j] + F.col("mean")[i] * F.col("mean")[j])) / F.sum(w)).alias(f"s{i}_{j}") for i in dims for j in dims if i <= j]
    m = components.groupBy(*keys).agg(F.sum(w).alias("weight"), *means, *seconds)
    cov = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}") - F.col(f"m{i}") * F.col(f"m{j}")
    return m.select(*keys, "weight", F.array(*[F.col(f"m{d}") for d in dims]).alias("mean"), F.array(*[F.array(*[cov(i, j) for j in dims]) for i in dims]).alias("cov"))


def with_factors(components: DataFrame) -> DataFrame:
    """components (mean, cov) with inv, the inverse Cholesky factor of cov row by row, and log_scale, the log of one over the integral of exp(-q / 2): worked out once a component."""

    def run(frames):
        for f in frames:
            inv = [np.linalg.inv(np.linalg.cholesky(np.stack(c).astype(float))) for c in f["cov"]]
            yield f.assign(inv=[m.tolist() for m in inv], log_scale=[float(np.log(np.diag(m)).sum() - len(m) / 2 * math.log(2 * math.pi)) for m in inv], cov=[np.stack(c).tolist() for c in f["cov"]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in components.schema)
    return components.mapInPandas(run, f"{kinds}, inv array<array<double>>, log_scale double")


def evaluate_full(points: DataFrame, components: DataFrame, dims: list[int], cutoff: float = CUTOFF) -> DataFrame:
    """points (source, id, x) with density under components of their source (weight, mean, inv, log_scale) of full covariance; 0 beyond the cutoff."""
    far = [F.col("x")[d] - F.col("mean")[i] for i, d in enumerate(dims)]
    rows = [reduce(lambda a, b: a + b, [F.col("inv")[i][j] * far[j] for j in range(i + 1)]) for i in range(len(dims))]
    q = reduce(lambda a, b: a + b, [r * r for r in rows])
    pairs = points.join(components.select("source", "weight", "mean", "inv", "log_scale"), "source").withColumn("q", q).filter(F.col("q") <= cutoff)
    got = pairs.groupBy("source", "id").agg(F.sum(F.col("weight") * F.exp(F.col("log_scale") - F.col("q") / 2)).alias("density"))
    return points.join(got, ["source", "id"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def mixture_density(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    far = x[:, None, :] - mean
    q = np.einsum("nki,nki->nk", far, np.linalg.solve(cov[None], far[..., None])[..., 0])
    return (weight * np.exp(-q / 2) / np.sqrt(np.linalg.det(2 * math.pi * cov))).sum(axis=1)


def unscented_hellinger(a: tuple, b: tuple, reach: float = 3.0, weighted: bool = False) -> float:
    """Hellinger distance of two mixtures (weights, means, covariances) from sigma points of both: their means and, along the principal axes, the points sqrt(reach) deviations either way."""
    (wa, ma, ca), (wb, mb, cb) = a, b
    if not weighted:
        wa, wb = wa / wa.sum(), wb / wb.sum()
    w, m, c = np.concatenate([wa, wb]) / 2, np.concatenate([ma, mb]), np.concatenate([ca, cb])
    w = w / w.sum()
    d = m.shape[1]
    k = max(0.0, reach - d)
    values, axes = np.linalg.eigh(c)
    steps = np.sqrt(d + k) * np.sqrt(np.maximum(values, 0))[:, None, :] * axes
    points = np.concatenate([m[:, None, :], m[:, None, :] + steps.transpose(0, 2, 1), m[:, None, :] - steps.transpose(0, 2, 1)], axis=1)
    own = np.append(k / (d + k), np.full(2 * d, 0.5 / (d + k)))
    x, at = points.reshape(-1, d), (w[:, None] * own).ravel()
    pa, pb, p0 = mixture_density(x, wa, ma, ca), mixture_density(x, wb, mb, cb), mixture_density(x, w, m, c)
    return float(np.sqrt(abs((at * np.square(np.sqrt(pa) - np.sqrt(pb)) / p0).sum() / 2)))


def without_components(components: DataFrame, gone: DataFrame) -> DataFrame:
    """components less those of gone (source, comp_id)."""
    return components.join(gone.select("source", "comp_id"), ["source", "comp_id"], "left_anti")


def covariance_of_bandwidths(position_cm: float, amplitude_mv: float, wires: int = 4) -> list[float]:
    """Variances of a position and of amplitudes in millivolts, which are kept in microvolts."""
    return [position_cm**2] + [(amplitude_mv * 1000) ** 2] * wires


def hellinger(m1: Column, v1: Column, m2: Column, v2: Column, dims: list[int]) -> Column:
    """Hellinger distance of two diagonal gaussians."""
    parts = [F.sqrt(2 * F.sqrt(v1[d] * v2[d]) / (v1[d] + v2[d])) * F.exp(-(m1[d] - m2[d]) * (m1[d] - m2[d]) / (4 * (v1[d] + v2[d]))) for d in dims]
    return F.sqrt(F.greatest(F.lit(0.0), 1 - reduce(lambda a, b: a * b, parts)))


def kullback_leibler(m1: Column, v1: Column, m2: Column, v2: Column, dims: list[int]) -> Column:
    """Divergence of the second diagonal gaussian from the first."""
    parts = [F.ln(v1[d] / v2[d]) + v2[d] / v1[d] + (m1[d] - m2[d]) * (m1[d] - m2[d]) / v1[d] - 1 for d in dims]
    return reduce(lambda a, b: a + b, parts) / 2


def compress_source(weight: np.ndarray, mean: np.ndarray, var: np.ndarray, threshold: float, rounds: int = 100) -> list[np.ndarray]:
    """Groups of components such that each group's moment match is within threshold, in Hellinger distance, of all its components; the worst group is split in two until that holds."""

    def match(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = weight[g] / weight[g].sum()
        m = w @ mean[g]
        return m, w @ (var[g] + mean[g] ** 2) - m * m

    def far(g: np.ndarray) -> float:
        m, v = match(g)
        s = var[g] + v
        parts = np.sqrt(2 * np.sqrt(var[g] * v) / s) * np.exp(-np.square(mean[g] - m) / (4 * s))
        return float(np.sqrt(np.maximum(0, 1 - parts.prod(axis=1))).max())

    groups = [np.arange(len(weight))]
    score = [far(groups[0])]
    while max(score) > threshold:
        k = int(np.argmax(score))
        g = groups[k]
        if len(g) == 1:
            break
        m, v = match(g)
        axis = int(np.argmax(v))
        side = mean[g, axis] > m[axis]
        if side.all() or not side.any():
            side = np.arange(len(g)) >= len(g) // 2
        for _ in range(rounds):  # hard assignment by divergence to the two halves' matches
            (m0, v0), (m1, v1) = match(g[~side]), match(g[side])
            d0, d1 = ((np.log(b / var[g]) + (var[g] + np.square(mean[g] - a)) / b).sum(axis=1) for a, b in ((m0, v0), (m1, v1)))
            new = d1 < d0
            if new.all() or not new.any() or (new == side).all():
                break
            side = new
        groups[k : k + 1] = [g[~side], g[side]]
        score[k : k + 1] = [far(g[~side]), far(g[side])]
    return groups


def compress(components: DataFrame, threshold: float) -> DataFrame:
    """Components of each source replaced by moment matches of groups that are near enough; a source is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("comp_id")
        w, m, v = pdf["weight"].to_numpy(float), np.stack(pdf["mean"].to_numpy()).astype(float), np.stack(pdf["var"].to_numpy()).astype(float)
        groups = compress_source(w, m, v, threshold)
        share = [w[g] / w[g].sum() for g in groups]
        means = [s @ m[g] for s, g in zip(share, groups, strict=True)]
        return pd.DataFrame({"source": pdf["source"].iloc[0], "comp_id": range(len(groups)), "weight": [w[g].sum() for g in groups], "mean": means, "var": [s @ (v[g] + m[g] ** 2) - x * x for s, g, x in zip(share, groups, means, strict=True)]})

    kind = components.schema["source"].dataType.simpleString()
    return components.select("source", "comp_id", "weight", "mean", "var").groupBy("source").applyInPandas(run, f"source {kind}, comp_id long, weight double, mean array<double>, var array<double>")
