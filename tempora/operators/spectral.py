"""Filters, envelopes and multitaper spectra by channel, in numpy; and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalar import next_pow2

#: Samples of a channel that one task filters at a time; reach of the quarter turn in lengths of the filter.
CHUNK, HILBERT = 1 << 18, 8
#: Numbers of resamples that are held at a time.
DRAWN = 1 << 23


def kaiser_filter(low: float | None, high: float | None, fs: float, attenuation: float = 60.0, transition: float = 0.25, stop: bool = False) -> np.ndarray:
    """Odd-length linear-phase taps: low pass (low None), high pass (high None), band pass or band stop between low and high."""
    edges = [f for f in (low, high) if f is not None]
    width = transition * min(edges) / (fs / 2)
    beta = 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * (attenuation - 21) ** 0.4 + 0.07886 * (attenuation - 21) if attenuation > 21 else 0.0
    n = math.ceil((attenuation - 7.95) / (2.285 * math.pi * width)) | 1
    k = np.arange(n) - n // 2

    def low_pass(f: float) -> np.ndarray:
        c = 2 * f / fs
        return c * np.sinc(c * k) * np.kaiser(n, beta)

    unit = (k == 0).astype(float)
    if low is None:
        return low_pass(high) / low_pass(high).sum()
    if high is None:
        h = low_pass(low)
        return unit - h / h.sum()
    band = low_pass(high) / low_pass(high).sum() - low_pass(low) / low_pass(low).sum()
    return unit - band if stop else band


def filter_both(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Zero-phase: forwards and backwards, with ends turned about the end samples."""
    pad = min(3 * len(taps), len(x) - 1)
    full = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    for _ in range(2):
        full = np.convolve(full, taps)[: len(full)][::-1]
    return full[pad : pad + len(x)]


def analytic(x: np.ndarray) -> np.ndarray:
    n = 1 << next_pow2(len(x))
    f = np.fft.fft(x, n)
    f[1 : n // 2] *= 2
    f[n // 2 + 1 :] = 0
    return np.fft.ifft(f)[: len(x)]


def envelope(x: np.ndarray, taps: np.ndarray, smoothing: np.ndarray | None = None) -> np.ndarray:
    e = np.abs(analytic(filter_both(x, taps)))
    return e if smoothing is None else np.convolve(e, smoothing / smoothing.sum(), "same")


@lru_cache(maxsize=64)
def tapers(n: int, half_bandwidth: float = 3.0, count: int | None = None) -> np.ndarray:
    """Discrete prolate spheroidal sequences (count, n) of unit energy, by their tridiagonal matrix."""
    count = count or int(2 * half_bandwidth) - 1
    w = half_bandwidth / n
    i = np.arange(n)
    m = np.diag(((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * w)) + np.diag(i[1:] * (n - i[1:]) / 2, 1) + np.diag(i[1:] * (n - i[1:]) / 2, -1)
    v = np.linalg.eigh(m)[1][:, ::-1][:, :count].T
    return v * np.where(v.sum(axis=1, keepdims=True) < 0, -1, 1)


def tapered_fft(x: np.ndarray, fs: float, half_bandwidth: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, transform (taper, frequency)) of a window less its mean."""
    t = tapers(len(x), half_bandwidth) * math.sqrt(fs)
    n = 1 << next_pow2(len(x))
    return np.fft.rfftfreq(n, 1 / fs), np.fft.rfft((x - x.mean()) * t, n) / fs


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: its series below a + 1, its continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > 1e-17 * total:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - h * scale)


def student_cdf(t: float, n: float, steps: int = 4000) -> float:
    """Student's distribution by Simpson's rule over the angle atan(t / sqrt(n))."""
    end = math.atan(abs(t) / math.sqrt(n))
    x = np.linspace(0, end, 2 * steps + 1)
    y = np.cos(x) ** (n - 1)
    area = (y[0] + y[-1] + 4 * y[1::2].sum() + 2 * y[2:-1:2].sum()) * end / (6 * steps)
    half = area * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi)
    return 0.5 + math.copysign(half, t)


def quantile(cdf, p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


@lru_cache(maxsize=256)
def chi2_quantile(p: float, n: float) -> float:
    return quantile(lambda x: gamma_cdf(n / 2, x / 2), p, 0.0, 40 * n + 200)


@lru_cache(maxsize=256)
def student_quantile(p: float, n: float) -> float:
    return quantile(lambda t: student_cdf(t, n), p, -1e4, 1e4)


def degrees(dim: int, spikes: float | None) -> float:
    """Degrees of freedom of so many transforms, fewer for point processes of so many spikes."""
    return 2.0 * dim if spikes is None else float(math.trunc(1 / (1 / (2.0 * dim) + 1 / (2.0 * spikes))))


def spectrum_interval(power: np.ndarray, transforms: np.ndarray, p: float = 0.05, kind: str = "theory", spikes: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) about a spectrum (frequency) of transforms (estimate, frequency): by chi-square (theory) or leaving one out at a time (jackknife)."""
    dim = len(transforms)
    if kind == "theory":
        dof = degrees(dim, spikes)
        return dof * power / chi2_quantile(1 - p / 2, dof), dof * power / chi2_quantile(p / 2, dof)
    own = np.abs(transforms) ** 2
    left = np.log((own.sum(axis=0) - own) / (dim - 1))
    reach = student_quantile(1 - p / 2, dim - 1) * math.sqrt(dim - 1) * left.std(axis=0)
    return power * np.exp(-reach), power * np.exp(reach)


def coherence_error(c: np.ndarray, x: np.ndarray, y: np.ndarray, p: float = 0.05, kind: str = "theory", spikes: tuple[float | None, float | None] = (None, None)) -> tuple[float, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(level that chance exceeds with p, standard deviation of the phase, low, high) of a coherence (frequency) of transforms x and y (estimate, frequency); low and high by jackknife only."""
    dim = len(x)
    dof = min(2.0 * dim if n is None else float(math.trunc(2 * n * 2 * dim / (2 * n + 2 * dim))) for n in spikes)
    level = math.sqrt(1 - p ** (1 / (dof / 2 - 1) if dof > 2 else 1.0))
    if kind == "theory":
        return level, np.sqrt(2 / dof * (1 / c**2 - 1)), None, None
    xx, yy, xy = np.abs(x) ** 2, np.abs(y) ** 2, x * np.conj(y)
    left = (xy.sum(axis=0) - xy) / np.sqrt((xx.sum(axis=0) - xx) * (yy.sum(axis=0) - yy))
    z = math.sqrt(2 * dim - 1) * np.arctanh(np.abs(left))
    reach = student_quantile(1 - p / 2, dof - 1) * math.sqrt(dim - 1) * z.std(axis=0)
    middle = math.sqrt(2 * dim - 2) * np.arctanh(c)
    low, high = np.maximum(np.tanh((middle - reach) / math.sqrt(2 * dim)), 0), np.tanh((middle + reach) / math.sqrt(2 * dim - 2))
    return level, np.sqrt((2 * dim - 2) * (1 - np.abs((left / np.abs(left)).mean(axis=0)))), low, high


def spectrum_errors(windows: DataFrame, fs: float, half_bandwidth: float = 3.0, p: float = 0.05, kind: str = "theory") -> DataFrame:
    """(channel, window, f, power, low, high): spectrograms with their intervals, a window at a time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f, s = tapered_fft(pdf.sort_values("k")["v"].to_numpy(float), fs, half_bandwidth)
        power = 2 * (np.abs(s) ** 2).mean(axis=0)
        low, high = spectrum_interval(power, math.sqrt(2) * s, p, kind)
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], "window": pdf["window"].iloc[0], "f": f, "power": power, "low": low, "high": high})

    return windows.groupBy("channel", "window").applyInPandas(one, "channel string, window long, f double, power double, low double, high double")


def coherogram(x: DataFrame, y: DataFrame, fs: float, half_bandwidth: float = 3.0, p: float = 0.05) -> DataFrame:
    """(window, f, coherence, phase, level, phase_std) of two signals' windows (window, k, v), a window at a time, over tapers; windows of one signal only are left out."""

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = ["window", "f", "coherence", "phase", "level", "phase_std"]
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype=float) for c in cols})
        f, s = tapered_fft(a.sort_values("k")["v"].to_numpy(float), fs, half_bandwidth)
        _, r = tapered_fft(b.sort_values("k")["v"].to_numpy(float), fs, half_bandwidth)
        c = (np.conj(s) * r).mean(axis=0) / np.sqrt((np.abs(s) ** 2).mean(axis=0) * (np.abs(r) ** 2).mean(axis=0))
        level, spread, _, _ = coherence_error(np.abs(c), s, r, p)
        return pd.DataFrame({"window": a["window"].iloc[0], "f": f, "coherence": np.abs(c), "phase": np.angle(c), "level": level, "phase_std": spread})

    return x.groupBy("window").cogroup(y.groupBy("window")).applyInPandas(pair, "window long, f double, coherence double, phase double, level double, phase_std double")


def bandwidth_range(n: int, fs: float = 1.0) -> tuple[float, float]:
    """Bandwidths that n samples allow."""
    return fs / n, fs * (n - 1) / (2 * n)


def spectrum(windows: DataFrame, fs: float, half_bandwidth: float = 3.0) -> DataFrame:
    """(channel, f, power): multitaper power averaged over a channel's windows (channel, window, k, v); each window is a task of its own."""
    from pyspark.sql import functions as F

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("k")["v"].to_numpy(float)
        f, s = tapered_fft(x, fs, half_bandwidth)
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], "window": pdf["window"].iloc[0], "f": f, "power": 2 * (np.abs(s) ** 2).mean(axis=0)})

    own = windows.groupBy("channel", "window").applyInPandas(one, "channel string, window long, f double, power double")
    return own.groupBy("channel", "f").agg(F.avg("power").alias("power"))


def spectrogram(windows: DataFrame, fs: float, half_bandwidth: float = 3.0) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("k")["v"].to_numpy(float)
        f, s = tapered_fft(x, fs, half_bandwidth)
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], "window": pdf["window"].iloc[0], "f": f, "power": 2 * (np.abs(s) ** 2).mean(axis=0)})

    return windows.groupBy("channel", "window").applyInPandas(one, "channel string, window long, f double, power double")


def coherence(x: DataFrame, y: DataFrame, fs: float, half_bandwidth: float = 3.0) -> DataFrame:
    """(f, coherence, phase) of two sets of windows (window, k, v): cross spectra and powers are averaged over windows and tapers."""
    from pyspark.sql import functions as F

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = ["f", "xx", "yy", "re", "im"]
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype=float) for c in cols})
        f, s = tapered_fft(a.sort_values("k")["v"].to_numpy(float), fs, half_bandwidth)
        _, r = tapered_fft(b.sort_values("k")["v"].to_numpy(float), fs, half_bandwidth)
        c = (np.conj(s) * r).mean(axis=0)
        return pd.DataFrame({"f": f, "xx": (np.abs(s) ** 2).mean(axis=0), "yy": (np.abs(r) ** 2).mean(axis=0), "re": c.real, "im": c.imag})

    parts = x.groupBy("window").cogroup(y.groupBy("window")).applyInPandas(pair, "f double, xx double, yy double, re double, im double")
    m = parts.groupBy("f").agg(*[F.avg(c).alias(c) for c in ("xx", "yy", "re", "im")])
    return m.select("f", (F.hypot("re", "im") / F.sqrt(F.col("xx") * F.col("yy"))).alias("coherence"), F.atan2("im", "re").alias("phase"))


def hilbert_taps(reach: int) -> np.ndarray:
    """Odd-length taps, reach on either side, that turn all frequencies but those near 0 and the highest by a quarter turn."""
    k = np.arange(-reach, reach + 1)
    ideal = np.divide(2.0, math.pi * k, out=np.zeros(len(k)), where=k % 2 != 0)
    return ideal * np.kaiser(len(k), 6.0)


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The part of a convolution that all taps reach, by FFT."""
    n = 1 << next_pow2(len(x) + len(taps) - 1)
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(taps, n), n)[len(taps) - 1 : len(x)]


def turned(x: np.ndarray, first: int, lo: int, hi: int, n: int) -> np.ndarray:
    """Samples lo to hi of a signal of n, of which x has those from first on; beyond its ends it is turned about the end samples."""
    left, right = max(0, -lo), max(0, hi - n)
    out = x[max(lo, 0) - first : min(hi, n) - first]
    before = 2 * x[-first] - x[left - first : -first : -1] if left else x[:0]
    end = n - 1 - first
    after = 2 * x[end] - x[end - 1 : end - 1 - right : -1] if right and end - 1 - right >= 0 else 2 * x[end] - x[end - 1 :: -1] if right else x[:0]
    return np.concatenate([before, out, after])


def filtered_part(x: np.ndarray, first: int, lo: int, hi: int, n: int, both: np.ndarray) -> np.ndarray:
    """filter_both of samples lo to hi; both: the taps' correlation with themselves, which is one filter for both ways."""
    reach = len(both) // 2
    return convolved(turned(x, first, lo - reach, hi + reach, n), both)


def envelope_part(x: np.ndarray, first: int, lo: int, hi: int, n: int, both: np.ndarray, hilbert: np.ndarray, smoothing: np.ndarray) -> np.ndarray:
    """The envelope of samples lo to hi: of the filtered signal and its quarter turn, which are 0 beyond the ends, smoothed."""
    half, wide = len(smoothing) // 2, len(hilbert) // 2
    a, b = lo - half, hi + half
    within = lambda p, q: (max(p, 0), min(q, n))
    p, q = within(a - wide, b + wide)
    flat = np.zeros(b - a + 2 * wide)
    flat[p - a + wide : q - a + wide] = filtered_part(x, first, p, q, n, both)
    turn, own = convolved(flat, hilbert), flat[wide : len(flat) - wide]
    e = np.hypot(own, turn)
    p, q = within(a, b)
    e[: p - a] = e[q - a :] = 0
    return convolved(e, smoothing)


def by_chunks(signal: DataFrame, reach: int, whole, part, chunk: int | None = None) -> DataFrame:
    """signal (channel, i, v) with v replaced chunk by chunk: part(x, first, lo, hi, n) of the samples x from first on, which reach so far beyond lo to hi.

    i counts a channel's samples without gaps. A sample goes to its own chunk and those within reach; a
    channel of one chunk only is whole(x).
    """
    from pyspark.sql import functions as F

    size = max(chunk or CHUNK, 4 * reach + 4)
    ends = signal.groupBy(F.col("channel").alias("_c")).agg(F.min("i").alias("_i0"), F.count(F.lit(1)).alias("_n"))
    placed = signal.select("channel", "i", "v").join(ends, F.col("channel").eqNullSafe(F.col("_c"))).withColumn("_k", F.col("i") - F.col("_i0"))
    last = F.floor((F.col("_n") - 1) / size)
    at = F.sequence(F.greatest(F.floor((F.col("_k") - reach) / size), F.lit(0)), F.least(F.floor((F.col("_k") + reach) / size), last))
    sent = placed.select("channel", "i", "v", "_k", "_n", F.explode(at).alias("_chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        n, c, k = int(pdf["_n"].iloc[0]), int(pdf["_chunk"].iloc[0]), pdf["_k"].to_numpy()
        lo, hi, first = c * size, min((c + 1) * size, n), max(c * size - reach, 0)
        if len(k) != min(hi + reach, n) - first or (k != first + np.arange(len(k))).any():
            raise ValueError("a channel's samples have gaps or repeats")
        x = pdf["v"].to_numpy(float)
        own = pdf[(k >= lo) & (k < hi)]
        return own[["channel", "i"]].assign(v=whole(x) if n <= size else part(x, first, lo, hi, n))

    return sent.groupBy("channel", "_chunk").applyInPandas(run, "channel string, i long, v double")


def apply_filter(signal: DataFrame, taps: np.ndarray, chunk: int | None = None) -> DataFrame:
    """signal (channel, i, v) filtered forwards and backwards, chunks of a channel apart, as filter_both does the whole."""
    both = np.correlate(taps, taps, "full")
    return by_chunks(signal, len(taps) - 1, lambda x: filter_both(x, taps), lambda x, first, lo, hi, n: filtered_part(x, first, lo, hi, n, both), chunk)


def apply_envelope(signal: DataFrame, taps: np.ndarray, smoothing: np.ndarray | None = None, chunk: int | None = None, reach: int | None = None) -> DataFrame:
    """signal (channel, i, v) with v the envelope of the filtered signal, smoothed if asked, chunks of a channel apart.

    The quarter turn is by hilbert_taps that reach so far (HILBERT times the filter's length by default): what
    lies farther off, as a transform of the whole channel would weigh it, is left out. smoothing has an odd
    number of taps.
    """
    both = np.correlate(taps, taps, "full")
    turn = hilbert_taps(reach or HILBERT * len(taps))
    smooth = np.ones(1) if smoothing is None else smoothing / smoothing.sum()
    if len(smooth) % 2 == 0:
        raise ValueError("an odd number of smoothing taps")
    part = lambda x, first, lo, hi, n: envelope_part(x, first, lo, hi, n, both, turn, smooth)
    whole = lambda x: envelope(x, taps, smoothing) if len(x) <= 3 * len(taps) else part(x, 0, 0, len(x), len(x))
    return by_chunks(signal, len(both) // 2 + len(turn) // 2 + len(smooth) // 2, whole, part, chunk)


#: Statistics of weighted sums (w, w x, w x x, w y) that poisson_interval knows.
STATISTICS = {
    "mean": lambda w, x, xx, y: x / w,
    "variance": lambda w, x, xx, y: xx / w - (x / w) ** 2,
    "ratio": lambda w, x, xx, y: x / y,
}


def poisson_weights(ids: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """(id, replicate) seeded draws of a Poisson distribution of mean 1, each by itself: how often a resample takes a row."""
    mixed = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    with np.errstate(over="ignore"):
        a = mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 63)))
        b = mixed(replicates.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1))
        h = mixed(mixed(a[:, None] ^ b[None, :]))
        h = h ^ (h >> np.uint64(29))
    u = (h >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(POISSON, u, side="right").astype(float)


POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def poisson_interval(data: DataFrame, key: str, value: str, id: str, statistic: str = "mean", other: str | None = None, samples: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(key, estimate, low, high): percentile interval of a statistic over seeded resamples, in which each row comes a Poisson number of times.

    statistic: mean, variance (population) or ratio (of value's sum to other's). id: whole numbers that
    tell rows apart. Weights are drawn by id and replicate, so that rows of a group lie in any number of
    tasks, and the result doesn't depend on how; a row a group, task and replicate is shuffled. Rows with
    a null among id and values are left out.
    """
    from pyspark.sql import functions as F

    x, y = F.col(value).cast("double"), F.col(other).cast("double") if other else F.lit(1.0)
    rows = data.select(F.col(key).alias("_k"), F.col(id).cast("long").alias("_id"), x.alias("_x"), y.alias("_y")).filter("_id IS NOT NULL AND _x IS NOT NULL AND _y IS NOT NULL")
    kind = rows.schema["_k"].dataType.simpleString()
    replicates = np.arange(samples)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for k, g in f.groupby("_k", dropna=False, sort=False):
                k = None if pd.isna(k) else k
                total = held.setdefault(k, np.zeros((4, samples + 1)))
                for lo in range(0, len(g), 256):
                    part = g.iloc[lo : lo + 256]
                    v, u = part["_x"].to_numpy(), part["_y"].to_numpy()
                    terms = np.stack([np.ones(len(v)), v, v * v, u])
                    total[:, :samples] += terms @ poisson_weights(part["_id"].to_numpy(), replicates, seed)
                    total[:, samples] += terms.sum(axis=1)  # the sample itself
        for k, t in held.items():
            yield pd.DataFrame({"_k": [k] * (samples + 1), "r": np.arange(samples + 1), "w": t[0], "x": t[1], "xx": t[2], "y": t[3]})

    parts = rows.mapInPandas(sums, f"_k {kind}, r int, w double, x double, xx double, y double")
    each = parts.groupBy("_k", "r").agg(*[F.sum(c).alias(c) for c in ("w", "x", "xx", "y")])
    stat = each.select("_k", "r", F.when(F.col("w") > 0, STATISTICS[statistic](*[F.col(c) for c in ("w", "x", "xx", "y")])).alias("s"))
    drawn = F.when(F.col("r") < samples, F.col("s"))
    ends = [F.percentile(drawn, F.lit(q)).alias(n) for n, q in (("low", alpha / 2), ("high", 1 - alpha / 2))]  # of samples numbers
    return stat.groupBy(F.col("_k").alias(key)).agg(F.max(F.when(F.col("r") == samples, F.col("s"))).alias("estimate"), *ends)


def resampled(x: np.ndarray, statistic, samples: int, seed: int) -> np.ndarray:
    """The statistic of so many seeded resamples of x."""
    rng, step = np.random.default_rng(seed), min(64, max(1, DRAWN // max(1, len(x))))
    return np.concatenate([statistic(x[rng.integers(0, len(x), (min(step, samples - k), len(x)))], axis=1) for k in range(0, samples, step)])


def bootstrap_interval(data: DataFrame, key: str, value: str, statistic=np.mean, samples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(key, low, high): percentile interval of a statistic over seeded resamples of each group; any callable of a (samples, n) array and axis.

    A group's numbers, 8 bytes each, are one task's; resamples are drawn DRAWN numbers at a time, or one resample
    of more, from the same run of random numbers whatever their size.
    """

    from pyspark.sql import functions as F

    kind = to_arrow_type(data.schema[key].dataType)

    def run(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(float) for b in batches]
        x = np.concatenate(parts) if parts else np.zeros(0)
        del parts
        x = x[~np.isnan(x)]
        x.sort()
        low, high = np.quantile(resampled(x, statistic, samples, seed), [alpha / 2, 1 - alpha / 2])
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], kind), pa.array([low]), pa.array([high])], names=[key, "low", "high"])

    rows = data.select(F.col(value).cast("double").alias("_x"), F.col(key).alias("_k"))
    return rows.groupBy("_k").applyInArrow(run, StructType([StructField(key, data.schema[key].dataType), StructField("low", DoubleType()), StructField("high", DoubleType())]))


def components_needed(signals: DataFrame, columns: list[str], percent: float = 99.9) -> int:
    """Principal components that explain so much of the variance: covariances are aggregated, the small matrix is solved on the driver."""
    from pyspark.sql import functions as F

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = signals.agg(*[F.covar_pop(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
    m = np.zeros((len(columns), len(columns)))
    for k, (a, b) in enumerate(pairs):
        m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = row[f"c{k}"]
    share = np.cumsum(np.sort(np.linalg.eigvalsh(m))[::-1])
    return int(np.searchsorted(share / share[-1], percent / 100)) + 1


def reconstruct(signals: DataFrame, columns: list[str], mixing: np.ndarray, mean: np.ndarray, names: list[str]) -> DataFrame:
    """signals with the columns names: the components in columns, mixed by mixing (name, component), plus the mean."""
    from pyspark.sql import functions as F

    out = {}
    for k, name in enumerate(names):
        total = F.lit(float(mean[k]))
        for j, c in enumerate(columns):
            total = total + F.col(c) * float(mixing[k, j])
        out[name] = total
    return signals.withColumns(out)
