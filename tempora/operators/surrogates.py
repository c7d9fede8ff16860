"""Surrogates of decoded bins: each spike's likelihood row is replaced by a past one from a ring, and the bin is decoded again."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decoding as C
from .significance import TIME_REACH

#: Added to a likelihood before its logarithm; numbers that one step of the gather holds.
TINY, STEP = 1e-13, 1 << 22


@lru_cache(maxsize=4)
def index_table(rows: int, shuffles: int, seed: int) -> np.ndarray:
    """(shuffles, rows): for each surrogate a seeded order of the places of the ring, counted back from the newest row; row 0 stands for the truth, which has places of its own."""
    r, out = np.random.default_rng(seed), np.empty((shuffles, rows), np.int32)
    for k in range(shuffles):
        out[k] = r.permutation(rows)
    return out


@dataclass
class Ring:
    """The logarithms of the newest likelihood rows, oldest first, and the two likeliest grid points of the newest decoded bins, for the truth and each surrogate.

    rows: places of the ring, and what a surrogate draws from; windows: bins that are kept.
    """

    rows: int
    shuffles: int
    seed: int
    windows: int
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    at: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 2), np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 2)))

    def update(self, pax: np.ndarray, own: np.ndarray, minus: np.ndarray) -> np.ndarray | None:
        """Takes a bin in and gives its posteriors (surrogate, grid), the truth first; None until the ring is full.

        pax (row, grid): the bin's likelihood rows, all of its spikes by all sources' models; own: rows of
        spikes by their own source's; minus: what is taken from the sum of logarithms. A bin with more rows
        than the ring has is left out.
        """
        if len(pax) > self.rows:
            return None
        new = np.log(pax + TINY)
        self.logs = np.concatenate([self.logs, new])[-self.rows :] if self.logs.size else new
        if len(self.logs) < self.rows:
            return None
        n, grid, last = len(own), pax.shape[1], len(self.logs) - 1
        out = np.empty((self.shuffles, grid))
        places = index_table(self.rows, self.shuffles, self.seed)[:, :n]
        step = max(1, STEP // max(1, n * grid))
        for lo in range(0, self.shuffles, step):
            out[lo : lo + step] = self.logs[last - places[lo : lo + step]].sum(axis=1)
        out[0] = self.logs[last - (len(pax) - 1 - own)].sum(axis=0)
        out -= minus
        out = np.exp(out - out.max(axis=1, keepdims=True))
        out /= out.sum(axis=1, keepdims=True)
        at = np.argmax(out, axis=1)
        rest = out.copy()
        rest[np.arange(self.shuffles), at] = -1
        second = np.argmax(rest, axis=1)
        top = np.stack([at, second], axis=1).astype(np.int32)
        w = np.take_along_axis(out, top, axis=1)
        w /= w.sum(axis=1, keepdims=True)
        shape = (0, self.shuffles, 2)
        self.at = np.concatenate([self.at.reshape(-1, *shape[1:]) if self.at.size else np.zeros(shape, np.int32), top[None]])[-self.windows :]
        self.weight = np.concatenate([self.weight.reshape(-1, *shape[1:]) if self.weight.size else np.zeros(shape), w[None]])[-self.windows :]
        return out

    def correlations(self, n: int, states: np.ndarray) -> np.ndarray | None:
        """sequence_correlations of the newest n bins; None while there are fewer."""
        return sequence_correlations(self.at[-n:], self.weight[-n:], states) if n <= len(self.at) else None

    def pack(self) -> tuple[int, bytes, bytes, bytes]:
        return self.logs.shape[1], self.logs.tobytes(), self.at.tobytes(), self.weight.tobytes()

    def unpack(self, grid: int, logs: bytes, at: bytes, weight: bytes) -> Ring:
        """This ring with what pack() gave."""
        self.logs = np.frombuffer(logs).reshape(-1, grid) if grid else np.zeros((0, 0))
        self.at, self.weight = np.frombuffer(at, np.int32).reshape(-1, self.shuffles, 2), np.frombuffer(weight).reshape(-1, self.shuffles, 2)
        return self


def sequence_correlations(at: np.ndarray, weight: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Weighted distance correlation of time and place of each surrogate's sequence, at and weight (bin, surrogate, 2).

    Distances in time grow to TIME_REACH bins. Both matrices are double-centred; 0 where the covariance
    isn't positive. Rounded to 12 places, so that equal sequences tie.
    """
    n = len(at)
    a, w = at.transpose(1, 0, 2), weight.transpose(1, 0, 2)  # (surrogate, bin, 2)
    place = np.zeros((len(a), n, n))
    for x in range(2):
        for y in range(2):
            place += w[:, :, None, x] * w[:, None, :, y] * states[a[:, :, None, x], a[:, None, :, y]]
    place[:, np.arange(n), np.arange(n)] = 0
    i = np.arange(n)
    time = np.minimum(np.abs(i[:, None] - i), TIME_REACH) / TIME_REACH
    time = time - time.mean(axis=0) - time.mean(axis=1, keepdims=True) + time.mean()
    place = place - place.mean(axis=1, keepdims=True) - place.mean(axis=2, keepdims=True) + place.mean(axis=(1, 2), keepdims=True)
    cov = (time * place).mean(axis=(1, 2))
    scale = np.sqrt((time * time).mean() * (place * place).mean(axis=(1, 2)))
    return np.round(np.sqrt(np.divide(np.maximum(cov, 0), scale, out=np.zeros(len(a)), where=scale > 0)), 12)


def p_of(correlations: np.ndarray) -> float:
    """Share of surrogates (all but the first) strictly above the truth, plus one over their number."""
    n = len(correlations) - 1
    return float((correlations[1:] > correlations[0]).sum() / n + 1 / n)


def least_p(ring: Ring, windows: tuple[int, ...], states: np.ndarray) -> tuple[float, float]:
    """(the truth's correlation over the longest window there is, the least p over the windows that there are bins for); (0, 1) without any."""
    rwd, least = 0.0, 1.0
    for n in sorted(windows):
        r = ring.correlations(n, states)
        if r is not None:
            rwd, least = float(r[0]), min(least, p_of(r))
    return rwd, least


def likelihood_rows(spikes: DataFrame, components: DataFrame, behavior: DataFrame, grid: list[float], features: list[int], position: int, duration: float, options: C.Options = C.Options(), delta: float | None = None, width: float | None = None) -> DataFrame:
    """(bin, n, pax array of arrays over the grid, own array of places in pax, minus array over the grid) of the bins that have spikes (source, bin, id, x).

    Every spike is measured by every source's components; rows are in order of the measuring source, the
    spike's own and id. A bin's rows are one array: its spikes times the sources.
    """
    models = components.select("source").distinct()  # as many rows as there are sources
    asked = spikes.select(F.struct("source", "id").alias("id"), "bin", "x").crossJoin(F.broadcast(models))
    rows = C.spike_grid(asked, components, grid, features, position, width)
    one = F.struct("source", "id", "pax")
    bins = rows.groupBy("bin").agg(F.array_sort(F.collect_list(one)).alias("_r"))
    src = C._sources(components, C._occupied(behavior, grid, options.position_bandwidth), grid, position, duration, options.offset)
    total = src.agg(F.array(*[F.sum(F.col("lx")[g]) for g in range(len(grid))]).alias("_lx"), F.first("pix").alias("_pix"))  # one row
    own = F.filter(F.sequence(F.lit(0), F.size("_r") - 1), lambda k: F.col("_r")[k]["source"] == F.col("_r")[k]["id"]["source"])
    d = options.sleep_bin if delta is None else delta
    minus = F.zip_with("_pix", "_lx", lambda p, x: F.col("n") * F.ln(p) + d * x)
    out = bins.crossJoin(F.broadcast(total)).withColumn("own", own).withColumn("n", F.size("own"))
    return out.select("bin", "n", F.col("_r.pax").alias("pax"), "own", minus.alias("minus"))
