"""Alignment of two clocks that stamped the same events: the lag by cross-correlation of intervals, then offset, drift and conversion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import interpolate, stretches

#: Values in a block, stretches of a series, and values in a stretch at most; a pair of stretches is one FFT of twice the size.
BLOCK, STRETCHES, LONGEST = 4096, 8, 1 << 21


def numbered(times: DataFrame) -> DataFrame:
    """(i, t, gap): times by position from 0, with the interval since the time before. Rows are numbered inside stretches of time; a row a stretch hands its number and last time on."""
    rows = stretches(times.select("t"), "t")
    inside, before = Window.partitionBy("_c").orderBy("t"), Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"))
    carry = each.select(F.col("_c").alias("_k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.last("last").over(before).alias("_last"))
    own = rows.select("_c", "t", (F.row_number().over(inside) - 1).alias("_i"), F.lag("t").over(inside).alias("_b"))
    return own.join(carry, F.col("_c") == F.col("_k")).select((F.col("_i") + F.col("_n")).cast("long").alias("i"), "t", (F.col("t") - F.coalesce("_b", "_last")).alias("gap"))


def blocks(values: DataFrame, block: int) -> DataFrame:
    """(b, v): arrays of block values (i, v), in order of i; nulls and what is missing are 0."""
    cell = F.struct((F.col("i") % block).cast("int").alias("k"), "v")
    return values.groupBy(F.floor(F.col("i") / block).alias("b")).agg(F.collect_list(cell).alias("v"))


def correlate(x: DataFrame, y: DataFrame, block: int = BLOCK, lags: tuple[int, int] | None = None) -> DataFrame:
    """(lag, c): the sum over i of x at i + lag times y at i, of two series (i from 0, v), for lags (least, most) or all.

    Series are cut into blocks, and these lie in stretches of so many blocks that a series has about STRETCHES, up to
    LONGEST values each. A pair of stretches is correlated by FFT in one group and adds to the lags that it reaches,
    a row a block of lags; such rows are summed by block. A block is sent once for each stretch of the other series
    that the lags need, so that a series up to STRETCHES * LONGEST values is sent about STRETCHES times; for all lags of
    a longer one that is its length over LONGEST.
    """
    n = max(int(df.agg(F.coalesce(F.max("i"), F.lit(-1))).first()[0]) + 1 for df in (x, y))
    low, high = lags or (-n + 1, n - 1)
    many = max(1, min(-(-n // (block * STRETCHES)), LONGEST // block))  # blocks of a stretch
    size, count = many * block, max(1, -(-n // (many * block)))
    # lags of a pair of stretches at distance d lie from (d - 1) * size + 1 to (d + 1) * size - 1
    first, last = -(-(low + 1) // size) - 1, (high - 1) // size + 1
    s = F.floor(F.col("b") / many)
    both = lambda lo, hi: F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")), lambda o: (o >= s + lo) & (o <= s + hi)))
    bx = blocks(x, block).select(s.alias("sx"), both(-last, -first).alias("sy"), (F.col("b") % many).alias("b"), "v")
    by = blocks(y, block).select(both(first, last).alias("tx"), s.alias("ty"), (F.col("b") % many).alias("b"), "v")

    def dense(t: pa.Table) -> np.ndarray:
        out = np.zeros(size)
        for chunk in t.select(["b", "v"]).to_batches():
            cells, at = chunk.column(1), np.repeat(chunk.column(0).to_numpy(), np.diff(chunk.column(1).offsets.to_numpy())).astype(np.int64)
            flat = cells.flatten()
            v = flat.field("v").fill_null(0).to_numpy(zero_copy_only=False)
            out[at * block + flat.field("k").to_numpy()] = np.where(np.isnan(v), 0, v)
        return out

    def multiply(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))})
        c = np.fft.irfft(np.fft.rfft(dense(a), 2 * size) * np.conj(np.fft.rfft(dense(b), 2 * size)), 2 * size)
        c[size] = 0.0
        d = (key[0].as_py() - key[1].as_py()) * many
        q = np.concatenate([np.arange(d, d + many), np.arange(d - many, d)])
        return pa.table({"q": pa.array(q, pa.int64()), "v": pa.ListArray.from_arrays(pa.array(np.arange(2 * many + 1, dtype=np.int32) * block), pa.array(c))})

    def total(t: pa.Table) -> pa.Table:
        return pa.table({"q": t["q"][:1], "v": pa.array([np.sum([v.values.to_numpy() for v in t["v"]], axis=0)], pa.list_(pa.float64()))})

    kind = "q long, v array<double>"
    parts = bx.groupBy("sx", "sy").cogroup(by.groupBy("tx", "ty")).applyInArrow(multiply, kind)
    sums = parts.groupBy("q").applyInArrow(total, kind)  # a row a pair of stretches at one distance
    out = sums.select("q", F.posexplode("v").alias("r", "c")).select((F.col("q") * block + F.col("r")).alias("lag"), "c")
    return out.filter(F.col("lag").between(max(low, -n + 1), min(high, n - 1)))


def intervals_of(numbers: DataFrame) -> DataFrame:
    """(i, v): intervals of numbered(), from the second time on, less their mean."""
    gaps = numbers.filter("gap IS NOT NULL").select((F.col("i") - 1).alias("i"), F.col("gap").alias("v"))
    mean = gaps.agg(F.avg("v").alias("_m"))  # one row
    return gaps.crossJoin(F.broadcast(mean)).select("i", (F.col("v") - F.col("_m")).alias("v"))


def matched(a: DataFrame, b: DataFrame, block: int = BLOCK, lags: tuple[int, int] | None = None) -> DataFrame:
    """(i, ta, tb, lag): times of b with those of a that they are best lined up with: at the lag at which the cross-correlation of the intervals, less their means, is largest (the smallest such lag).

    a and b: times t, in any order, of the same events on two clocks, each of which may miss some at
    either end; lags bounds the positions that a may be ahead. Empty where either has under two times.
    """
    x, y = numbered(a), numbered(b)
    best = correlate(intervals_of(x), intervals_of(y), block, lags).agg(F.max(F.struct("c", (-F.col("lag")).alias("l")))).first()[0]
    lag = F.lit(None if best is None else -best["l"]).cast("long")
    return x.select("i", F.col("t").alias("ta")).join(y.select((F.col("i") + lag).alias("i"), F.col("t").alias("tb")), "i").select("i", "ta", "tb", lag.alias("lag"))


def synchronization(pairs: DataFrame) -> DataFrame:
    """(lag, n, offset, drift): the mean of tb - ta and its slope over ta, in seconds a second; 0 drift where clocks run alike."""
    d = F.col("tb") - F.col("ta")
    return pairs.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("offset"), F.regr_slope(d, F.col("ta")).alias("drift"))


def converted(points: DataFrame, pairs: DataFrame, extrapolate: bool = False) -> DataFrame:
    """points with tb: t on clock a as one on clock b, by linear interpolation between pairs; outside them null, or on the line through the two outermost pairs."""
    p = pairs.select(F.col("ta").alias("t"), F.col("tb").alias("_v"))
    out = interpolate(points, p, "_v").withColumnRenamed("_v", "tb")
    if not extrapolate:
        return out
    last = lambda *order: p.orderBy(*order).limit(2).agg(F.min(F.struct("t", "_v")).alias("u"), F.max(F.struct("t", "_v")).alias("v"))  # noqa: E731  # one row
    ends = last("t").select(F.col("u").alias("a0"), F.col("v").alias("a1")).crossJoin(last(F.desc("t")).select(F.col("u").alias("b0"), F.col("v").alias("b1")))
    line = lambda u, v: u["_v"] + (v["_v"] - u["_v"]) * (F.col("t") - u["t"]) / F.when(v["t"] > u["t"], v["t"] - u["t"])
    ended = out.crossJoin(F.broadcast(ends))
    tb = F.when(F.col("tb").isNotNull(), F.col("tb")).when(F.col("t") < F.col("a0.t"), line(F.col("a0"), F.col("a1"))).when(F.col("t") > F.col("b1.t"), line(F.col("b0"), F.col("b1")))
    return ended.withColumn("tb", tb).drop("a0", "a1", "b0", "b1")
