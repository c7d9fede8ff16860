"""Circular statistics of angles theta (radians) by groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import TWO_PI, circular_diff, wrap


def moment(theta: Column, k: int = 1, weight: Column | None = None) -> tuple[Column, Column]:
    """Real and imaginary part of the k-th trigonometric moment, as aggregates."""
    w = weight if weight is not None else F.when(theta.isNotNull(), F.lit(1.0))
    return F.sum(w * F.cos(k * theta)) / F.sum(w), F.sum(w * F.sin(k * theta)) / F.sum(w)


def summary(df: DataFrame, keys: list[str], theta: str = "theta", weight: str | None = None, alpha: float = 0.05) -> DataFrame:
    """By group: n, mean direction (0 to 2 pi), resultant length r, angular variance, standard deviation, dispersion, half width of the mean's confidence interval (for the sum of weights, if there are any), and Rayleigh's statistic with its p."""
    from statistics import NormalDist

    th, w = F.col(theta), F.col(weight) if weight else None
    (c1, s1), (c2, s2) = moment(th, 1, w), moment(th, 2, w)
    m = df.groupBy(*keys).agg(F.count(th).alias("n"), c1.alias("c"), s1.alias("s"), c2.alias("c2"), s2.alias("s2"), (F.sum(w) if weight else F.count(th)).alias("nw"))
    m = m.withColumns({"mean": wrap(F.atan2("s", "c")), "r": F.hypot("c", "s"), "p2": F.hypot("c2", "s2")})
    m = m.withColumn("dispersion", (1 - F.col("p2")) / (2 * F.col("r") * F.col("r")))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    n, r = F.col("n"), F.col("r")
    stat = (1 - 1 / (2 * n)) * 2 * n * r * r + n * F.pow(r, F.lit(4.0)) / 2
    return m.withColumns({"variance": 1 - r, "std": F.sqrt(-2 * F.ln(r)), "ci": F.asin(F.least(F.lit(1.0), z * F.sqrt(F.col("dispersion") / F.col("nw")))), "rayleigh": stat, "rayleigh_p": F.exp(-stat / 2)}).select(*keys, "n", "mean", "r", "variance", "std", "dispersion", "ci", "rayleigh", "rayleigh_p")


def central_moment(df: DataFrame, keys: list[str], k: int = 1, theta: str = "theta") -> DataFrame:
    """k-th moment about the mean direction, by turning the moment about 0 by k times it."""
    (c1, s1), (c, s) = moment(F.col(theta)), moment(F.col(theta), k)
    m = df.groupBy(*keys).agg(F.atan2(s1, c1).alias("m"), c.alias("c"), s.alias("s"))
    a = k * F.col("m")
    return m.select(*keys, (F.col("c") * F.cos(a) + F.col("s") * F.sin(a)).alias("re"), (F.col("s") * F.cos(a) - F.col("c") * F.sin(a)).alias("im"))


def kuiper(df: DataFrame, keys: list[str], theta: str = "theta") -> DataFrame:
    """Kuiper's V against the uniform circle, corrected for n, and its p."""
    u = wrap(F.col(theta)) / TWO_PI
    w = Window.partitionBy(*keys)
    x = df.filter(F.col(theta).isNotNull()).select(*keys, u.alias("u"), F.row_number().over(w.orderBy(u)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    d = x.groupBy(*keys).agg(F.max("n").alias("n"), (F.max(F.col("i") / F.col("n") - F.col("u")) + F.max(F.col("u") - (F.col("i") - 1) / F.col("n"))).alias("v"))
    root = F.sqrt("n")
    v = F.col("v") * (root + 0.155 + 0.24 / root)
    return d.select(*keys, "n", v.alias("kuiper"), F.least(F.lit(1.0), (8 * v * v - 2) * F.exp(-2 * v * v)).alias("kuiper_p"))


def interval(df: DataFrame, keys: list[str], theta: str = "theta") -> DataFrame:
    """The smallest arc that holds all angles: a turn less the widest gap."""
    w = Window.partitionBy(*keys)
    x = df.select(*keys, wrap(F.col(theta)).alias("u")).filter("u IS NOT NULL")
    gaps = x.withColumn("g", F.coalesce(F.lead("u").over(w.orderBy("u")), F.min("u").over(w) + TWO_PI) - F.col("u"))
    return gaps.groupBy(*keys).agg((TWO_PI - F.max("g")).alias("interval"))


def rank(df: DataFrame, keys: list[str], theta: str = "theta") -> DataFrame:
    """df with rank: average rank of theta times 2 pi over n."""
    w = Window.partitionBy(*keys)
    same = Window.partitionBy(*keys, theta)
    average = F.rank().over(w.orderBy(theta)) + (F.count(F.lit(1)).over(same) - 1) / 2
    return df.withColumn("rank", average * TWO_PI / F.count(theta).over(w))


def histogram(df: DataFrame, keys: list[str], bins: int = 24, theta: str = "theta") -> DataFrame:
    """(keys, bin, n): angles within half a bin of each of bins centres, ends included, so that an edge counts twice."""
    width = TWO_PI / bins
    x = df.withColumn("_u", wrap(F.col(theta)) / width)
    near = F.array(F.floor("_u"), F.floor("_u") + 1)
    hit = x.withColumn("_c", F.explode(near)).filter(F.abs(F.col("_u") - F.col("_c")) <= 0.5)
    return hit.groupBy(*keys, (F.col("_c") % bins).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, keys: list[str], points: int = 24, kappa: float = 10.0, theta: str = "theta") -> DataFrame:
    """(keys, point, density): von Mises kernel density at evenly spaced angles; the grid is a driver constant exploded per row and summed before the shuffle."""
    grid = F.posexplode(F.array(*[F.lit(TWO_PI * k / points) for k in range(points)])).alias("point", "x")
    x = df.filter(F.col(theta).isNotNull()).select(*keys, theta, grid)
    k = F.exp(kappa * F.cos(F.col(theta) - F.col("x"))) / (TWO_PI * float(np.i0(kappa)))
    return x.groupBy(*keys, "point").agg(F.avg(k).alias("density"))


def uniformize(population: DataFrame, sample: DataFrame, key: str, theta: str = "theta") -> DataFrame:
    """sample with uniform: its angles through the population's rank distribution, linear between ranks.

    Ranks are counts of what is smaller, summed in stretches of the angles' range.
    """
    from .joins import interpolate, running, stretches

    each = population.groupBy(key, theta).agg(F.count(F.lit(1)).alias("_m"), F.count(theta).alias("_v"))
    n = each.groupBy(F.col(key).alias("_z")).agg(F.sum("_v").alias("_n"))
    before = running(stretches(each, theta), [key], "_c", [theta], F.col("_m"), "sum", "_before", before=True).join(n, F.col(key).eqNullSafe(F.col("_z")))
    average = F.col("_before") + 1 + (F.col("_m") - 1) / 2
    ranked = before.select(key, F.col(theta).alias("t"), (average * TWO_PI / F.col("_n")).alias("uniform"))
    return interpolate(sample.withColumn("t", F.col(theta)), ranked, "uniform", (key,)).drop("t")


def median(df: DataFrame, key: str, theta: str = "theta") -> DataFrame:
    """The angle of least mean circular distance, searched among the angles themselves, and that distance; a group is one task's work."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        u = np.sort(np.mod(pdf[theta].dropna().to_numpy(), TWO_PI))
        n = len(u)
        if not n:
            return pd.DataFrame({key: pdf[key].iloc[:1], "median": [np.nan], "deviation": [np.nan]})
        # sum of distances to each angle from running sums over the doubled circle
        twice = np.concatenate([u, u + TWO_PI])
        total = np.append(0, np.cumsum(twice))
        far = np.searchsorted(twice, u + math.pi, side="right")
        i = np.arange(n)
        ahead = total[far] - total[i] - (far - i) * u
        behind = (i + n - far) * (u + TWO_PI) - (total[i + n] - total[far])
        dev = (ahead + behind) / n
        j = int(np.argmin(dev))
        return pd.DataFrame({key: pdf[key].iloc[:1], "median": [u[j]], "deviation": [dev[j]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, theta).groupBy(key).applyInPandas(find, f"{key} {kind}, median double, deviation double")


def spatial_information(df: DataFrame, keys: list[str], rate: str = "rate", occupancy: str = "occupancy") -> DataFrame:
    """Bits per spike and per second of rates over bins of occupancy; bins without either add nothing."""
    r, o = F.col(rate), F.col(occupancy)
    m = df.groupBy(*keys).agg(F.sum(o).alias("t"), F.sum(r * o).alias("n"), F.sum(F.when((r > 0) & (o > 0), r * o * F.log2(r))).alias("e"))
    mean = F.col("n") / F.col("t")
    return m.select(*keys, (F.col("e") / F.col("n") - F.log2(mean)).alias("bits_per_spike"), ((F.col("e") / F.col("n") - F.log2(mean)) * mean).alias("bits_per_second"))


def distance(a: Column, b: Column) -> Column:
    return circular_diff(a, b)
