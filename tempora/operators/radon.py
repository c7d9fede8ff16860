"""Integrals along lines x cos + y sin = rho about the middle of small images, one image a task; and slices through one."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Lines:
    """How lines are sampled and summed.

    axis: x or y, the one along which a line has a sample a pixel (None: the one it crosses more of).
    interpolation: nearest or linear pixels across. method: integral, sum, mean, logsum or product of the
    samples. intercept: rho is where a line crosses the middle row, not its distance. pad: what samples
    outside of the image are: None (left out), median, mean or geomean of the pixels of their row or
    column, random (seeded) ones of these, or a number; needs an axis. least: lines with a smaller share
    of samples inside give nan.
    """

    axis: str | None = None
    interpolation: str = "nearest"
    method: str = "sum"
    intercept: bool = False
    pad: str | float | None = None
    dx: float = 1.0
    dy: float = 1.0
    least: float = 0.0
    seed: int = 0


def along_rows(theta: float, how: Lines) -> bool:
    return how.axis == "x" or how.axis is None and abs(math.sin(theta)) > how.dx / math.hypot(how.dx, how.dy)


def samples(image: np.ndarray, theta: float, rhos: np.ndarray, how: Lines) -> np.ndarray:
    """(rho, sample): the image's (x, y) values where each line crosses its columns or rows; nan outside."""
    cos, sin, rows = math.cos(theta), math.sin(theta), along_rows(theta, how)
    nx, ny = image.shape
    x0, y0 = how.dx * (nx - 1) / 2, how.dy * (ny - 1) / 2
    far = rhos * cos if how.intercept else rhos
    if rows:
        x = how.dx * np.arange(nx) - x0
        at, table = ((far[:, None] - x * cos) / sin + y0) / how.dy, image
    else:
        y = how.dy * np.arange(ny) - y0
        at, table = ((far[:, None] - y * sin) / cos + x0) / how.dx, image.T
    line, n = np.arange(len(table)), table.shape[1]
    if how.interpolation == "nearest":
        near = np.floor(at + 0.5)
        inside = (near >= 0) & (near < n)
        return np.where(inside, table[line, np.where(inside, near, 0).astype(int)], np.nan)
    low = np.floor(at)
    inside = (at >= 0) & (at < n - 1)
    k, w = np.where(inside, low, 0).astype(int), at - low
    return np.where(inside, table[line, k] * (1 - w) + table[line, np.minimum(k + 1, n - 1)] * w, np.nan)


def padded(values: np.ndarray, image: np.ndarray, theta: float, how: Lines) -> np.ndarray:
    """values with samples outside replaced as how says."""
    if how.pad is None:
        return values
    if how.axis is None:
        raise ValueError("padding needs lines along one axis")
    table = image if along_rows(theta, how) else image.T
    if how.pad == "random":
        pick = np.random.default_rng([how.seed, int(theta * 1e6) & 0xFFFFFFFF]).integers(0, table.shape[1], values.shape)
        fill = table[np.arange(len(table)), pick]
    elif how.pad == "geomean":
        with np.errstate(divide="ignore"):
            fill = np.exp(np.log(table).mean(axis=1))
    else:
        fill = {"median": np.median, "mean": np.mean}[how.pad](table, axis=1) if isinstance(how.pad, str) else np.full(len(table), float(how.pad))
    return np.where(np.isnan(values), fill, values)


def transform(image: np.ndarray, thetas: np.ndarray, rhos: np.ndarray, how: Lines = Lines()) -> np.ndarray:
    """(theta, rho): integrals along all lines; nan for those without a sample."""
    out = np.full((len(thetas), len(rhos)), np.nan)
    for i, theta in enumerate(thetas):
        raw = samples(image, theta, rhos, how)
        share = (~np.isnan(raw)).mean(axis=1)
        v = padded(raw, image, theta, how)
        n = (~np.isnan(v)).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            if how.method == "product":
                total = np.nanprod(v, axis=1)
            else:
                total = np.nansum(np.log(v) if how.method == "logsum" else v, axis=1)
            if how.method == "mean":
                total = total / n
            if how.method == "integral":
                total = total * (how.dx / abs(math.sin(theta)) if along_rows(theta, how) else how.dy / abs(math.cos(theta)))
        out[i] = np.where((n > 0) & (share >= how.least), total, np.nan)
    return out


def rho_vector(nx: int, ny: int, dx: float = 1.0, dy: float = 1.0, intercept: bool = False, oversampling: int = 1) -> np.ndarray:
    """Distances that cover an image for angles from -pi / 2 to pi / 2, about a pixel apart."""
    step = dy / math.hypot(dy / dx, 1)
    top = dx * (nx - 1) / 2 if intercept else math.hypot(dx * (nx - 1) / 2, dy * (ny - 1) / 2)
    return np.linspace(-top, top, int(2 * top / step + 1) * oversampling)


def theta_vector(nx: int, ny: int, dx: float = 1.0, dy: float = 1.0, low: float = -math.pi / 2, high: float = math.pi / 2, oversampling: int = 1) -> np.ndarray:
    """Angles so near to one another that lines to an image's corners are about a pixel apart."""
    step = dy / (math.hypot(dy / dx, 1) * math.hypot(dx * (nx - 1) / 2, dy * (ny - 1) / 2))
    return np.linspace(low, high, math.ceil((high - low) / step) * oversampling)


def matrix(pdf: pd.DataFrame, nx: int, ny: int) -> np.ndarray:
    out = np.zeros((nx, ny))
    np.add.at(out, (pdf["x"].to_numpy(int), pdf["y"].to_numpy(int)), pdf["v"].to_numpy(float))
    return out


def radon(images: DataFrame, keys: list[str], nx: int, ny: int, thetas: np.ndarray, rhos: np.ndarray, how: Lines = Lines()) -> DataFrame:
    """(keys, theta, rho, value) of images (keys, x, y, v) of nx by ny pixels, those without a row being 0; theta and rho are numbers in the vectors. Lines without a value are left out."""
    kinds = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value = transform(matrix(pdf, nx, ny), thetas, rhos, how)
        t, r = np.nonzero(~np.isnan(value))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(t) for k in keys}, "theta": t.astype(np.int32), "rho": r.astype(np.int32), "value": value[t, r]})

    return images.groupBy(*keys).applyInPandas(run, f"{kinds}, theta int, rho int, value double")


def radon_slice(images: DataFrame, keys: list[str], nx: int, ny: int, theta: float, rho: float, how: Lines = Lines()) -> DataFrame:
    """(keys, k, value): each image's samples along one line, k their row or column; those outside only if padded."""
    kinds = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = matrix(pdf, nx, ny)
        v = padded(samples(image, theta, np.array([rho]), how), image, theta, how)[0]
        k = np.flatnonzero(~np.isnan(v))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(k) for c in keys}, "k": k.astype(np.int32), "value": v[k]})

    return images.groupBy(*keys).applyInPandas(run, f"{kinds}, k int, value double")
