"""Posterior of a position from marked spikes: joins and sums; densities of spikes by components in tiles of numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import density as D
from .joins import range_join, tasks

#: Spikes, or components, of a source in a group at most; pairs that make one more part of the spikes; spikes and components of a tile.
BLOCK, PAIRS, TILE = 1 << 17, 1 << 28, (256, 256)


@dataclass(frozen=True)
class Options:
    """Bin sizes in seconds, grid step and position bandwidth in centimetres, offset of rates, shuffles (the first is the truth)."""

    run_bin: float = 0.25
    sleep_bin: float = 0.02
    grid_step: float = 5.0
    position_bandwidth: float = 8.5
    offset: float = 1e-10
    shuffles: int = 1001


def grid_of(low: float, high: float, step: float) -> list[float]:
    """From low + step / 2 on in steps, below high - step / 2."""
    n = math.ceil((high - low - step) / step)
    return [low + step / 2 + k * step for k in range(max(n, 0))]


def _occupied(behavior: DataFrame, grid: list[float], bandwidth: float) -> DataFrame:
    """One row: pix, the array of occupancies over the grid."""
    one = behavior.select(F.array(F.col("x").cast("double")).alias("mean"), F.array(F.lit(bandwidth * bandwidth)).alias("var"))
    p = D.grid_sums(one, [], grid, D.marginal_at(0, F.lit(1.0)), F.count(F.lit(1)).alias("n")).select(F.transform("sums", lambda v: F.coalesce(v / F.col("n"), F.lit(0.0))).alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, v: a + v) / (12 * len(grid))
    return p.select(F.transform("p", lambda v: v + mean).alias("pix"))


def _sources(components: DataFrame, pix: DataFrame, grid: list[float], position: int, duration: float, offset: float) -> DataFrame:
    """(source, mu, pix, lx): a row a source with arrays over the grid; pix is one row."""
    own = D.grid_sums(components, ["source"], grid, D.marginal_at(position), (F.count(F.lit(1)) / F.lit(duration)).alias("mu"))
    full = own.join(F.broadcast(pix))  # one row
    return full.select("source", "mu", "pix", F.zip_with("sums", "pix", lambda s, p: F.col("mu") * s / p + offset).alias("lx"))


def occupancy(behavior: DataFrame, grid: list[float], bandwidth: float) -> DataFrame:
    """(g, x, pix): kernel density of positions (x) on the grid, plus a twelfth of its mean."""
    rows = _occupied(behavior, grid, bandwidth).select(F.posexplode("pix").alias("g", "pix"))
    return rows.select("g", F.array(*[F.lit(float(x)) for x in grid])[F.col("g")].alias("x"), "pix")


def rates(components: DataFrame, behavior: DataFrame, grid: list[float], bandwidth: float, position: int, duration: float, offset: float) -> DataFrame:
    """(source, g, mu, pix, lx): mean rate of each source and its rate at each grid point."""
    src = _sources(components, _occupied(behavior, grid, bandwidth), grid, position, duration, offset)
    return src.select("source", "mu", F.posexplode(F.arrays_zip("pix", "lx")).alias("g", "_z")).select("source", "g", "mu", "_z.pix", "_z.lx")


def near_cells(x: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """rows of x in cells of most rows that lie near each other: halves along the widest dimension, again and again."""
    todo, out = [rows] if len(rows) else [], []
    while todo:
        r = todo.pop()
        if len(r) <= most:
            out.append(r)
            continue
        half = len(r) // 2
        order = np.argpartition(x[r, np.argmax(np.ptp(x[r], axis=0))], half)
        todo += [r[order[:half]], r[order[half:]]]
    return out


def kernel_sums(x: np.ndarray, mean: np.ndarray, var: np.ndarray, weight: np.ndarray, centre: np.ndarray, spread: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """(row, grid): for each row of features x the sum over components (mean and var of the features, centre and spread of the position) of their densities there, those within the cutoff of x and grid point together.

    A cell of near rows meets the components of a stretch of centres in order of their least distance from the cell, tile
    by tile. A grid point within the cutoff of the whole tile takes part in one matrix product, one that only some of the
    tile's pairs reach takes these pairs alone, and one that none reaches costs nothing; the bounds round as the
    distances do, so they hold to the last bit. Rows and components that aren't finite add nothing.
    """
    out = np.zeros((len(x), len(grid)))
    cols = np.flatnonzero(np.isfinite(mean).all(axis=1) & np.isfinite(centre))
    cols = cols[np.argsort(centre[cols], kind="stable")]
    if not len(cols):
        return out
    m, v = np.ascontiguousarray(mean[cols].T), np.ascontiguousarray(var[cols].T)
    far = (grid - centre[cols, None]) ** 2 / spread[cols, None]
    left = D.CUTOFF - far
    p = (weight[cols] / np.sqrt(np.prod(2 * math.pi * v, axis=0) * (2 * math.pi * spread[cols])))[:, None] * np.exp(-far / 2)
    n = math.ceil(math.sqrt(len(cols) / TILE[1]))  # as many stretches as tiles in each
    ends = [len(cols) * i // n for i in range(n + 1)]
    stretches = [(i, j, left[i:j].min(axis=0), left[i:j].max(axis=0)) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    held, mask = [np.empty(TILE[0] * TILE[1]) for _ in range(3)], np.empty(TILE[0] * TILE[1], bool)
    for r in near_cells(x, np.flatnonzero(np.isfinite(x).all(axis=1)), TILE[0]):
        at = np.ascontiguousarray(x[r].T)[:, :, None]
        least, most, sums = np.zeros(len(cols)), np.zeros(len(cols)), np.zeros((len(r), len(grid)))
        for d in range(len(m)):
            low, high = at[d].min() - m[d], at[d].max() - m[d]
            least += np.maximum(np.maximum(low, -high), 0) ** 2 / v[d]
            most += np.maximum(-low, high) ** 2 / v[d]
        for i, j, all_left, any_left in stretches:
            own = i + np.flatnonzero(least[i:j] <= any_left.max())
            own = own[np.argsort(least[own])]
            for lo in range(0, len(own), TILE[1]):
                c = own[lo : lo + TILE[1]]
                whole = most[c].max() <= all_left
                some = np.flatnonzero((least[c[0]] <= any_left) & ~whole)
                size = len(r) * len(c)
                q, k, t, near = (h[:size].reshape(len(r), len(c)) for h in (*held, mask))
                for d in range(len(m)):
                    u = t if d else q
                    np.subtract(at[d], m[d, c], out=u)
                    np.multiply(u, u, out=u)
                    np.divide(u, v[d, c], out=u)
                    if d:
                        np.add(q, t, out=q)
                np.exp(np.multiply(q, -0.5, out=k), out=k)
                density = p[c]
                if whole.any():
                    sums[:, whole] += k @ density[:, whole]
                if len(some):
                    within, part = left[c].T.copy(), density.T.copy()
                    for g in some:
                        sums[:, g] += np.multiply(k, np.less_equal(q, within[g], out=near), out=t) @ part[g]
        out[r] = sums
    return out


def spike_grid(spikes: DataFrame, components: DataFrame, grid: list[float], features: list[int], position: int, width: float | None = None) -> DataFrame:
    """(source, bin, id, pax array over the grid) of each spike (source, bin, id, x), zeros where no component is near.

    Equal components are one of their weights together, and spikes of equal features are worked out once. A source's
    features and components are dealt into parts of BLOCK rows at most, and each pair of parts is one group, worked
    through in tiles: a pair of spike and component is a number in a tile, not a row. A component is sent to at
    most as many parts as there are tasks, or as BLOCK spikes make. width isn't needed any more: tiles tell what is near.
    """
    dims, keys, most = len(features), ["source", "bin", "id"], tasks(spikes)
    element = lambda c, d: F.col(c)[d].cast("double")
    names, means = [f"x{i}" for i in range(dims)], [f"m{i}" for i in range(dims)]
    own = [*means, *[f"v{i}" for i in range(dims)], "m", "v"]
    x = spikes.select(*keys, *[element("x", d).alias(n) for n, d in zip(names, features, strict=True)])
    asked = x.select("source", *names).filter(reduce(lambda a, b: a & b, [F.abs(F.col(n)) < float("inf") for n in names])).distinct()
    c = components.select(F.col("source").alias("_s"), *[element("mean", d).alias(f"m{i}") for i, d in enumerate(features)], *[element("var", d).alias(f"v{i}") for i, d in enumerate(features)], element("mean", position).alias("m"), element("var", position).alias("v"), F.col("weight").cast("double").alias("w"))
    c = c.groupBy("_s", *own).agg(F.sum("w").alias("w"))
    ns = asked.groupBy(F.col("source").alias("_z")).agg(F.count(F.lit(1)).alias("_ns"))
    nc = c.groupBy(F.col("_s").alias("_y")).agg(F.count(F.lit(1)).alias("_nc"))
    by_work = F.least(F.ceil(F.col("_ns") * F.col("_nc") / PAIRS), F.lit(most))
    sizes = ns.join(nc, F.col("_z") == F.col("_y")).select("_z", F.greatest(by_work, F.ceil(F.col("_ns") / BLOCK)).alias("_i"), F.ceil(F.col("_nc") / BLOCK).alias("_j"))  # a row a source
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, F.col("source") == F.col("_z")).withColumn("_p", F.pmod(F.xxhash64(*names), F.col("_i"))).withColumn("_b", every("_j")).drop("_i", "_j", "_z")
    right = c.join(sizes, F.col("_s") == F.col("_z")).withColumn("_b", F.pmod(F.xxhash64(*own), F.col("_j"))).withColumn("_p", every("_i")).drop("_i", "_j", "_z")
    points = np.array(grid, float)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        of = lambda t, cs: np.stack([t[n].to_numpy() for n in cs], axis=1).astype(float)
        sums = kernel_sums(of(a, names), of(b, means), of(b, [f"v{i}" for i in range(dims)]), b["w"].to_numpy(), b["m"].to_numpy(), b["v"].to_numpy(), points)
        pax = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * len(points)), pa.array(sums.ravel()))
        return a.select(["source", *names]).append_column("pax", pax)

    schema = StructType([spikes.schema["source"], *[StructField(n, DoubleType()) for n in names], StructField("pax", ArrayType(DoubleType()))])
    deal = lambda df, *group: df.repartition(most, *group).groupBy(*group)  # noqa: E731  # little data and much work: not to be coalesced
    found = deal(left, "source", "_p", "_b").cogroup(deal(right, "_s", "_p", "_b")).applyInArrow(run, schema)
    sums = found.groupBy("source", *names).agg(F.array(*[F.sum(F.col("pax")[g]) for g in range(len(grid))]).alias("sums"))
    return x.join(sums, ["source", *names], "left").select(*keys, F.coalesce("sums", F.array(*[F.lit(0.0)] * len(grid))).alias("pax"))


def posterior(spikes: DataFrame, components: DataFrame, behavior: DataFrame, bins: DataFrame, grid: list[float], features: list[int], position: int, duration: float, options: Options = Options(), delta: float | None = None, width: float | None = None) -> DataFrame:
    """(bin, g, x, logp, p) of every bin; a bin without spikes has the prior less the rates."""
    n = len(grid)
    src = _sources(components, _occupied(behavior, grid, options.position_bandwidth), grid, position, duration, options.offset)
    pax = spike_grid(spikes, components, grid, features, position, width).join(src.select("source", "mu", "pix"), "source")
    logs = pax.select("bin", F.zip_with("pax", "pix", lambda v, q: F.ln(v + options.offset * q / F.col("mu"))).alias("_l"))
    ll = logs.groupBy("bin").agg(F.array(*[F.sum(F.col("_l")[g]) for g in range(n)]).alias("ll"), F.count(F.lit(1)).alias("n"))
    total = src.agg(F.array(*[F.sum(F.col("lx")[g]) for g in range(n)]).alias("total"), F.first("pix").alias("pix"))
    every = bins.select("bin").join(ll, "bin", "left").join(F.broadcast(total))  # total is one row
    d = options.run_bin if delta is None else delta
    point = lambda g: F.coalesce(F.col("ll")[g], F.lit(0.0)) - F.coalesce("n", F.lit(0)) * F.ln(F.col("pix")[g]) - d * F.col("total")[g]
    e = every.select("bin", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point).alias("l")).withColumn("_m", F.array_max("l")).withColumn("e", F.transform("l", lambda v: F.exp(v - F.col("_m"))))
    full = e.withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    rows = full.select("bin", "s", F.posexplode(F.arrays_zip("l", "e")).alias("g", "_z"))
    return rows.select("bin", "g", F.array(*[F.lit(float(x)) for x in grid])[F.col("g")].alias("x"), F.col("_z.l").alias("logp"), (F.col("_z.e") / F.col("s")).alias("p"))


def errors(post: DataFrame, truth: DataFrame) -> DataFrame:
    """(bin, decoded, error): the grid point of largest logp (the first among equals, nan ignored) and its distance from the truth (bin, x)."""
    best = post.filter(~F.isnan("logp")).groupBy("bin").agg(F.max_by(F.col("x"), F.struct("logp", -F.col("g"))).alias("decoded"))
    return best.join(truth.select("bin", F.col("x").alias("_t")), "bin").select("bin", "decoded", F.abs(F.col("decoded") - F.col("_t")).alias("error"))


def bin_spikes(spikes: DataFrame, bins: DataFrame, width: float) -> DataFrame:
    """spikes (source, id, t, x) with the bin (bin, start, stop) that holds them; spikes in none go."""
    return range_join(spikes, bins, width).drop("start", "stop")


def train_segments(behavior: DataFrame, threshold: float, least: float) -> DataFrame:
    """Runs of speed above threshold that last at least so long, from behavior (i, t, speed)."""
    from . import segments as S

    runs = S.from_logical(behavior.withColumn(S.KEY, F.lit("run")), F.col("speed") > threshold)
    return runs.filter(F.col("stop") - F.col("start") >= least)


def attach(spikes: DataFrame, behavior: DataFrame) -> DataFrame:
    """spikes with the position linear_position interpolated at t; those outside the behaviour's time go."""
    from .joins import interpolate

    return interpolate(spikes, behavior, "linear_position").filter("linear_position IS NOT NULL")


def included_sources(spikes: DataFrame, least: int = 10) -> DataFrame:
    """Spikes of the sources that have more than least of them."""
    n = spikes.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least)
    return spikes.join(n.select("source"), "source", "left_semi")
