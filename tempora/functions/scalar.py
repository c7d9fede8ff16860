"""Column functions: ranges, circular arithmetic, coordinates, partitions, packed probe samples and kernels."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def inrange(x: Column, low: float | None = None, high: float | None = None, inclusive: bool = True) -> Column:
    """low to high; outside of it if high < low; None leaves an end open."""
    up = F.lit(True) if low is None else (x >= low if inclusive else x > low)
    down = F.lit(True) if high is None else (x <= high if inclusive else x < high)
    return up | down if low is not None and high is not None and high < low else up & down


def wrap(x: Column, low: float = 0.0, high: float = TWO_PI) -> Column:
    return F.pmod(x - low, F.lit(high - low)) + low


def circular_diff(a: Column, b: Column, low: float = 0.0, high: float = TWO_PI, directed: bool = False) -> Column:
    """Distance of two angles on the circle; directed: b less a, wrapped to half a turn either way."""
    half = (high - low) / 2
    if directed:
        return F.pmod(b - a + half, F.lit(2 * half)) - half
    return half - F.abs(half - F.abs(wrap(b, low, high) - wrap(a, low, high)))


def circular_inrange(theta: Column, low: float, high: float) -> Column:
    """On the arc from low to high, ends included; low == high takes all."""
    if low == high:
        return F.lit(True)
    a, b = low % TWO_PI, high % TWO_PI
    x = wrap(theta)
    return (x >= a) & (x <= b) if a < b else (x >= a) | (x <= b)


def uniform_cdf(theta: Column) -> Column:
    return wrap(theta) / TWO_PI


def uniform_pdf(theta: Column) -> Column:
    return F.when(theta.isNotNull(), F.lit(1 / TWO_PI))


def uniform_ppf(p: Column) -> Column:
    return p * TWO_PI


UNIFORM_ENTROPY = math.log(TWO_PI)


def seeded(seed: int, *ids: Column | str) -> Column:
    """A seeded text of 32 hexadecimal digits for each id, in no order that ids have: the same on every run, however rows are dealt."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]))


def seeded_whole(seed: int, *ids: Column | str) -> Column:
    """A seeded whole number below 2 ** 52 for each id."""
    return F.conv(F.substring(seeded(seed, *ids), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *ids: Column | str) -> Column:
    """A seeded number from 0 to 1 (excluded) for each id."""
    return seeded_whole(seed, *ids) / F.lit(float(1 << 52))


def uniform_random(seed: int, *ids: Column | str) -> Column:
    """Seeded angles, one for each id."""
    return uniform(seed, *ids) * TWO_PI


def to_polar(x: Column, y: Column) -> tuple[Column, Column]:
    return F.atan2(y, x), F.hypot(x, y)


def to_cartesian(theta: Column, rho: Column) -> tuple[Column, Column]:
    return rho * F.cos(theta), rho * F.sin(theta)


def natural_key(s: Column, digits: int = 20) -> Column:
    """A string that sorts as s does with its digits read as whole numbers."""
    parts = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), digits, "0")).otherwise(p)), "")


def part_of(i: Column, n: Column, parts: int | None = None, size: int | None = None, method: str = "block") -> Column:
    """Part of item i of n: blocks of size (or of n over parts, rounded up), or in turn over parts."""
    if method == "sequence":
        return (i % (parts if parts else F.ceil(n / size))).cast("int")
    return F.floor(i / (size if size else F.ceil(n / parts))).cast("int")


def _starts(last: Column, start: int, shift: int) -> tuple[Column, Column]:
    """(number, array) of start, start + shift, ... up to last; the number doesn't make the array."""
    last, first, step = last.cast("long"), F.lit(start).cast("long"), F.lit(shift).cast("long")
    return F.when(last >= first, F.call_function("div", last - first, step) + 1).otherwise(0).cast("int"), F.sequence(first, last, step)


def block_count(n: Column, size: int) -> Column:
    """Number of blocks() of n items."""
    return _starts(n - 1, 0, size)[0]


def blocks(n: Column, size: int) -> Column:
    """Array of (start, n) blocks of n items."""
    count, starts = _starts(n - 1, 0, size)
    return F.when(count > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size).cast("long"), n - s).alias("n")))).otherwise(F.array().cast("array<struct<start:bigint,n:bigint>>"))


def slice_count(n: Column, size: int = 1, start: int = 0, shift: int | None = None, strict: bool = False) -> Column:
    """Number of slices() of n items."""
    return _starts(n - size if strict else n - 1, start, shift or size)[0]


def slices(n: Column, size: int = 1, start: int = 0, shift: int | None = None, strict: bool = False) -> Column:
    """Array of (start, stop) slices, each shift (default size) after the one before; short last ones unless strict."""
    count, starts = _starts(n - size if strict else n - 1, start, shift or size)
    return F.when(count > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("stop")))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))


# Packed probe samples: 32-bit fields of a 2-bit prefix and three 10-bit samples; 1440 channels in 12 regions of 120.


def packed_prefix(word: Column) -> Column:
    return F.shiftrightunsigned(word.bitwiseAND((1 << 32) - 1), 30)


def packed_body(word: Column) -> Column:
    return word.bitwiseAND((1 << 30) - 1)


def packed_samples(word: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(word.bitwiseAND((1 << 32) - 1), 10 * k).bitwiseAND(1023) for k in range(3)])


def probe_region(channel: Column) -> Column:
    """1-based region of a 1-based channel."""
    return F.floor((channel - 1) / 120) + 1


def probe_row(channel: Column) -> Column:
    c = channel - 1
    return 2 * F.floor(c / 8) + c % 2 + 1


def probe_column(channel: Column) -> Column:
    return F.floor((channel - 1) / 2) % 4 + 1


def probe_channel(row: Column, column: Column) -> Column:
    return 8 * F.floor((row - 1) / 2) + 2 * (column - 1) + (row - 1) % 2 + 1


def probe_is_reference(channel: Column) -> Column:
    """Local references: eight channels from offset 56 of each region."""
    return ((channel - 1) % 120).between(56, 63)


# Kernels, of u = distance over bandwidth.


def kernel(name: str, u: Column) -> Column:
    if name == "gaussian":
        return F.exp(-u * u / 2)
    if name == "epanechnikov":
        return F.when(F.abs(u) < 1, 0.75 * (1 - u * u)).otherwise(0.0)
    if name == "uniform":
        return F.when(F.abs(u) < 1, 1.0).otherwise(0.0)
    if name == "triangular":
        return F.when(F.abs(u) < 1, 1 - F.abs(u)).otherwise(0.0)
    raise ValueError(f"no kernel called {name}")


def truncated_gauss_scale(bandwidths: list[float], cutoff: float) -> float:
    """1 over the integral of a product of gaussians that each keep 1 - cutoff of their mass."""
    return TWO_PI ** (-len(bandwidths) / 2) / math.prod(bandwidths) / (1 - cutoff) ** len(bandwidths)


def truncation(cutoff: float) -> float:
    """Bandwidths at which a gaussian is cut so that cutoff of its mass is lost."""
    return -NormalDist().inv_cdf(cutoff / 2)


def epanechnikov_scale(bandwidths: list[float]) -> float:
    n = len(bandwidths)
    return (n / 2 + 1) * math.gamma(n / 2 + 1) / math.pi ** (n / 2) / math.prod(bandwidths)


def box_scale(bandwidths: list[float]) -> float:
    n = len(bandwidths)
    return math.gamma(n / 2 + 1) / math.pi ** (n / 2) / math.prod(bandwidths)


def vonmises_scale(kappas: list[float], cutoff: float = 0.0) -> float:
    return 1 / math.prod(TWO_PI * float(np.i0(k)) for k in kappas) / (1 - cutoff) ** len(kappas)


def next_pow2_of(n: Column) -> Column:
    """next_pow2 of a column of positive whole numbers."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def next_pow2(n: int) -> int:
    """The smallest p with 2 ** p >= n."""
    return max(0, (n - 1).bit_length())
