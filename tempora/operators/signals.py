"""Sampled signals (channel, i, t, v): extrema, crossings, mountains, smoothing, windows, ripples, radon lines. Channels are kept apart."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import kernel
from . import segments as S
from .joins import asof, interval_join, range_join
from .quantiles import quantiles

KEY = "channel"
#: Lines whose |sin theta| is at most this are vertical.
VERTICAL = 1e-9


def by_time() -> Window:
    return Window.partitionBy(KEY).orderBy("i")


def extrema(signal: DataFrame, kind: str = "extrema", low: float | None = None, high: float | None = None) -> DataFrame:
    """(channel, at, v, peak): where the first difference changes sign; a plateau's middle, perhaps a half sample. kind: extrema, max or min; low and high bound |v|."""
    w = by_time()
    d = signal.withColumn("_d", F.col("v") - F.lag("v").over(w)).filter("_d != 0")
    nxt = d.withColumns({"_n": F.lead("_d").over(w), "_ni": F.lead("i").over(w)}).filter("_n IS NOT NULL AND _d * _n < 0")
    out = nxt.select(KEY, ((F.col("i") + F.col("_ni") - 1) / 2).alias("at"), "v", (F.col("_d") > 0).alias("peak"))
    if kind != "extrema":
        out = out.filter(F.col("peak") == (kind == "max"))
    if low is not None:
        out = out.filter(F.abs("v") >= low)
    return out if high is None else out.filter(F.abs("v") <= high)


def gradient_extrema(signal: DataFrame, kind: str = "extrema") -> DataFrame:
    """(channel, at, peak): zero crossings of the central gradient, by linear interpolation."""
    w = by_time()
    g = signal.select(KEY, "i", ((F.lead("v").over(w) - F.lag("v").over(w)) / 2).alias("v")).filter("v IS NOT NULL")
    out = zero_crossings(g).withColumnRenamed("rising", "_r").withColumn("peak", ~F.col("_r")).drop("_r")
    return out if kind == "extrema" else out.filter(F.col("peak") == (kind == "max"))


def zero_crossings(signal: DataFrame) -> DataFrame:
    """(channel, at, rising): fractional sample where v changes sign; zeros are skipped over."""
    w = by_time()
    x = signal.filter("v != 0").select(KEY, "i", "v", F.lead("v").over(w).alias("_v"), F.lead("i").over(w).alias("_i")).filter("_v IS NOT NULL AND v * _v < 0")
    return x.select(KEY, (F.col("i") + F.col("v") / (F.col("v") - F.col("_v")) * (F.col("_i") - F.col("i"))).alias("at"), (F.col("_v") > 0).alias("rising"))


def mountains(signal: DataFrame, low: Column | float, high: float, segs: DataFrame | None = None, width: float | None = None) -> DataFrame:
    """(channel, start, stop, peak): runs above low whose largest value before the last sample is above high; cut to segs if given."""
    w = by_time()
    up = F.col("v") > low
    n = signal.withColumn("_p", F.row_number().over(w)).filter(up)
    runs = n.withColumn("_r", F.col("_p") - F.row_number().over(w))
    last = Window.partitionBy(KEY, "_r")
    inner = F.when(F.col("_p") < F.max("_p").over(last), F.col("v"))
    out = runs.withColumn("_in", inner).groupBy(KEY, "_r").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.max("_in").alias("peak")).filter(F.col("peak") > high).drop("_r")
    if segs is None:
        return out
    cut = interval_join(out, S.remove_overlap(segs.withColumn(S.KEY, F.lit("all"))).select("start", "stop"), width)
    return cut.select(F.col(f"{KEY}_a").alias(KEY), F.greatest("start_a", "start_b").alias("start"), F.least("stop_a", "stop_b").alias("stop"), F.col("peak_a").alias("peak"))


def thresholds(signal: DataFrame, multipliers: list[float] = (1.0,), percentiles: list[float] = (0.5, 0.9)) -> DataFrame:
    """By channel: mean + m * standard deviation (population), median + m * (upper quartile - median), and percentiles. Quantiles are exact, by rounds of counts: no task holds a channel's values."""
    moments = signal.groupBy(KEY).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    exact = quantiles(signal, KEY, "v", [0.5, 0.75, *percentiles]).withColumnRenamed(KEY, "_k")
    med, q = F.col("q")[0], F.col("q")[1]
    out = [(F.col("_m") + m * F.col("_s")).alias(f"zscore_{k}") for k, m in enumerate(multipliers)]
    out += [(med + m * (q - med)).alias(f"median_{k}") for k, m in enumerate(multipliers)]
    out += [F.col("q")[2 + k].alias(f"percentile_{k}") for k in range(len(percentiles))]
    return moments.join(exact, F.col(KEY).eqNullSafe(F.col("_k")), "left").select(KEY, *out)


def gradient_peaks(signal: DataFrame, least: float) -> DataFrame:
    """(channel, t, v): maxima by the gradient's zero crossings, t and v interpolated between samples, of a size of least or more."""
    w = by_time()
    steps = signal.select(KEY, F.col("i").alias("_i"), F.col("t").alias("_t"), F.col("v").alias("_v"), F.lead("t").over(w).alias("_tn"), F.lead("v").over(w).alias("_vn"))
    at = gradient_extrema(signal, "max").select(KEY, F.floor("at").cast("long").alias("_i"), (F.col("at") - F.floor("at")).alias("_f"))
    between = lambda a, b: F.when(F.col("_f") == 0, F.col(a)).otherwise(F.col(a) + F.col("_f") * (F.col(b) - F.col(a)))
    return at.join(steps, [KEY, "_i"]).select(KEY, between("_t", "_tn").alias("t"), between("_v", "_vn").alias("v")).filter(F.abs("v") >= least)


def ripple_segments(signal: DataFrame, low: float, high: float, join_gap: float, least: float, segs: DataFrame | None = None, width: float | None = None) -> DataFrame:
    """(channel, start, stop): runs of an envelope above low that rise above high (cut to segs if given), joined over gaps up to join_gap, at least so long in the end."""
    joined = S.join_gap(mountains(signal, low, high, segs, width).withColumnRenamed(KEY, S.KEY), join_gap)
    return joined.filter(F.col("stop") - F.col("start") >= least).withColumnRenamed(S.KEY, KEY)


def ripples(signal: DataFrame, low: float, high: float, join_gap: float, least: float, segs: DataFrame | None = None, width: float | None = None) -> DataFrame:
    """(channel, start, stop, peaks, peak): ripple_segments with the number of gradient maxima of high or more inside, and the largest one's size, null if none."""
    found = ripple_segments(signal, low, high, join_gap, least, segs, width)
    inside = range_join(gradient_peaks(signal, high), found.select(KEY, "start", "stop"), max(join_gap, least, 1e-9) * 4, (KEY,))
    peaks = inside.groupBy(KEY, "start", "stop").agg(F.count(F.lit(1)).alias("peaks"), F.max("v").alias("peak"))
    return found.join(peaks, [KEY, "start", "stop"], "left").withColumn("peaks", F.coalesce("peaks", F.lit(0)))


def detection_rates(online: DataFrame, offline: DataFrame, lock_out: float | None = None) -> DataFrame:
    """(true_positive, false_negative, false_positive, lock_out): percentages.

    An online time is right if the last offline segment to start at or before it (of equal starts the
    longest) is longer than the time since. True positives are in % of the segments, and what they leave
    of these are false negatives; the other online times, in % of all, false positives. lock_out: the
    segments, in %, that start less than so long after the online time before them.
    """
    starts = offline.groupBy(F.col("start").alias("t")).agg(F.max(F.col("stop") - F.col("start")).alias("d"))
    right = asof(online.select("t"), starts, ["d"]).agg(F.count_if(F.col("t") - F.col("_asof.t") < F.col("_asof.d")).alias("tp"), F.count(F.lit(1)).alias("no"))
    held = F.col("t") - F.col("_asof.t") < lock_out if lock_out is not None else F.lit(None).cast("boolean")
    late = asof(offline.select(F.col("start").alias("t")), online, []).agg(F.count(F.lit(1)).alias("ns"), F.count_if(held).alias("nl"))
    part = lambda x, n: F.try_divide(100.0 * x, F.col(n))
    return right.crossJoin(F.broadcast(late)).select(  # one row each
        part(F.col("tp"), "ns").alias("true_positive"), part(F.col("ns") - F.col("tp"), "ns").alias("false_negative"), part(F.col("no") - F.col("tp"), "no").alias("false_positive"),
        (part(F.col("nl"), "ns") if lock_out is not None else F.lit(None).cast("double")).alias("lock_out"))


def weights(name: str, bandwidth: float, normalize: str = "sum") -> list[tuple[int, float]]:
    """(lag, weight) of a kernel with whole-sample lags: gaussian up to four bandwidths, the others up to one."""
    reach = math.floor(4 * bandwidth) if name == "gaussian" else math.ceil(bandwidth) - 1
    u = np.arange(-reach, reach + 1) / bandwidth
    w = {"gaussian": np.exp(-u * u / 2), "epanechnikov": 0.75 * (1 - u * u), "uniform": np.ones_like(u), "triangular": 1 - np.abs(u)}[name]
    w = w / (w.sum() if normalize == "sum" else w.max() if normalize == "max" else 1.0)
    return list(zip(range(-reach, reach + 1), w.tolist(), strict=True))


def smooth(signal: DataFrame, name: str, bandwidth: float, normalize: str = "sum", unbiased: bool = False, axis: str = "i", keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """signal with v smoothed by a kernel: each sample is sent to its neighbours with its weight and summed before the shuffle. Nulls count as 0; unbiased divides by the weight that falls on samples."""
    ws = weights(name, bandwidth, normalize)
    parts = F.explode(F.array(*[F.struct(F.lit(lag).alias("d"), F.lit(w).alias("w")) for lag, w in ws])).alias("_k")
    sent = signal.select(*keys, axis, "v", parts).select(*keys, (F.col(axis) + F.col("_k.d")).alias(axis), (F.col("_k.w") * F.coalesce("v", F.lit(0.0))).alias("_x"), F.col("_k.w").alias("_w"))
    value = F.sum("_x") / F.sum("_w") if unbiased else F.sum("_x")
    got = sent.groupBy(*keys, axis).agg(value.alias("v"))
    return signal.drop("v").join(got, [*keys, axis])


def sliding_rms(signal: DataFrame, half: int) -> DataFrame:
    """signal with v: root mean square over half samples on either side."""
    return signal.withColumn("v", F.sqrt(F.avg(F.col("v") * F.col("v")).over(by_time().rowsBetween(-half, half))))


def local_integrate(signal: DataFrame, half: int) -> DataFrame:
    return signal.withColumn("v", F.sum("v").over(by_time().rowsBetween(-half, half)))


def upsample(signal: DataFrame, factor: int) -> DataFrame:
    """factor - 1 zeros after each sample."""
    k = F.posexplode(F.array(F.col("v"), *[F.lit(0.0)] * (factor - 1))).alias("_k", "v")
    return signal.select(KEY, "i", k).select(KEY, (F.col("i") * factor + F.col("_k")).alias("i"), "v")


def windows(signal: DataFrame, size: int, shift: int) -> DataFrame:
    """(channel, window, k, v): samples of each whole window of size, window w starting at w * shift; no join, each sample goes to the windows that hold it."""
    n = signal.groupBy(KEY).agg((F.max("i") + 1).alias("_n"))  # one number a channel
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / shift)).cast("long")
    hi = F.floor(F.col("i") / shift).cast("long")
    x = signal.join(F.broadcast(n), KEY).filter(hi >= lo).withColumn("window", F.explode(F.sequence(lo, hi)))
    return x.filter(F.col("window") * shift + size <= F.col("_n")).select(KEY, "window", (F.col("i") - F.col("window") * shift).alias("k"), "v")


def trigger_windows(signal: DataFrame, triggers: DataFrame, before: int, after: int) -> DataFrame:
    """(channel, trigger, k, v): samples from before to after each trigger (channel, trigger, at); triggers too near to an edge are dropped."""
    n = signal.groupBy(KEY).agg(F.max("i").alias("_n"))
    fit = triggers.join(n, KEY).filter((F.col("at") >= before) & (F.col("at") + after <= F.col("_n")))
    want = fit.withColumn("k", F.explode(F.sequence(F.lit(-before), F.lit(after)))).select(KEY, "trigger", "k", (F.col("at") + F.col("k")).alias("i"))
    return want.join(signal.select(KEY, "i", "v"), [KEY, "i"]).select(KEY, "trigger", "k", "v")


def remove_artefacts(signal: DataFrame, artefacts: DataFrame, before: float, after: float, width: float, fill: float | None = None, reflect: bool = False) -> DataFrame:
    """signal with v replaced from before to after (excluded) artefact times (t): by fill, by the line between the good samples on either side, or by reflection.

    reflect: samples a to b, one after another bad, become the weighted mean of the samples before, turned
    about that at a, and of those after, turned about that at b; weights go from one side to the other.
    Where the signal has fewer samples than that on a side they become fill, or not-a-number.
    """
    bad = artefacts.select((F.col("t") - before).alias("start"), (F.col("t") + after).alias("stop"))
    flagged = range_join(signal, bad, width, how="left_semi").withColumn("_bad", F.lit(True)).unionByName(range_join(signal, bad, width, how="left_anti").withColumn("_bad", F.lit(False)))
    is_bad = F.col("_bad")
    if reflect:
        return _reflected(flagged, math.nan if fill is None else fill)
    if fill is not None:
        return flagged.withColumn("v", F.when(is_bad, F.lit(fill)).otherwise(F.col("v"))).drop("_bad")
    good = F.when(~is_bad, F.struct("t", "v"))
    up = by_time().rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(KEY).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    x = flagged.withColumns({"_lo": F.last(good, True).over(up), "_hi": F.last(good, True).over(down)})
    line = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * (F.col("t") - F.col("_lo.t")) / (F.col("_hi.t") - F.col("_lo.t"))
    return x.withColumn("v", F.when(is_bad, line).otherwise(F.col("v"))).drop("_bad", "_lo", "_hi")


def _reflected(flagged: DataFrame, fill: float) -> DataFrame:
    """signal with _bad, whose runs of bad samples are filled by reflection; each bad sample looks four others up by their number."""
    n = flagged.groupBy(F.col(KEY).alias("_kn")).agg(F.count(F.lit(1)).alias("_n"), F.min("i").alias("_i0"))
    run = F.col("i") - F.row_number().over(by_time())
    bad = flagged.filter("_bad").withColumn("_run", run)
    own = Window.partitionBy(KEY, "_run")
    placed = bad.select(KEY, "i", F.min("i").over(own).alias("_a"), F.max("i").over(own).alias("_b")).join(n, F.col(KEY).eqNullSafe(F.col("_kn")))
    size = F.col("_b") - F.col("_a") + 1
    fits = (F.col("_a") - F.col("_i0") >= size) & (F.col("_b") - F.col("_i0") < F.col("_n") - size)
    asked = {"xa": F.col("_a"), "xb": F.col("_b"), "pre": 2 * F.col("_a") - 1 - F.col("i"), "post": 2 * F.col("_b") + 1 - F.col("i")}
    each = placed.filter(fits).select(KEY, "i", "_a", "_b", F.explode(F.array(*[F.struct(F.lit(k).alias("of"), x.alias("at")) for k, x in asked.items()])).alias("_q"))
    there = flagged.select(F.col(KEY).alias("_ks"), F.col("i").alias("_is"), F.col("v").alias("_vs"))
    found = each.join(there, F.col(KEY).eqNullSafe(F.col("_ks")) & (F.col("_q.at") == F.col("_is")))
    wide = found.groupBy(KEY, "i", "_a", "_b").agg(*[F.max(F.when(F.col("_q.of") == k, F.col("_vs"))).alias(f"_{k}") for k in asked])
    w = (F.col("i") - F.col("_a") + 1) / (F.col("_b") - F.col("_a") + 2)
    filled = wide.select(F.col(KEY).alias("_kf"), F.col("i").alias("_if"), ((2 * F.col("_xa") - F.col("_pre")) * (1 - w) + (2 * F.col("_xb") - F.col("_post")) * w).alias("_f"), F.lit(True).alias("_hit"))
    out = flagged.join(filled, F.col(KEY).eqNullSafe(F.col("_kf")) & (F.col("i") == F.col("_if")), "left")
    return out.withColumn("v", F.when(F.col("_hit"), F.col("_f")).when(F.col("_bad"), F.lit(fill)).otherwise(F.col("v"))).drop("_bad", "_kf", "_if", "_f", "_hit")


def cross_correlation(x: DataFrame, y: DataFrame, lags: int, scale: str = "none") -> DataFrame:
    """(channel, lag, value): sum of x[i + lag] * y[i] up to lags either way; scale none, biased, unbiased or coeff. An equi-join on shifted samples."""
    shifted = y.select(KEY, F.col("v").alias("w"), F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), "i").withColumn("i", F.col("i") + F.col("lag"))
    s = x.join(shifted, [KEY, "i"]).groupBy(KEY, "lag").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    if scale == "none":
        return s.withColumnRenamed("s", "value")
    nx = x.groupBy(KEY).agg(F.count("v").alias("n"), F.sum(F.col("v") * F.col("v")).alias("xx"))
    ny = y.groupBy(KEY).agg(F.sum(F.col("v") * F.col("v")).alias("yy"))
    by = {"biased": F.col("n"), "unbiased": F.col("n") - F.abs("lag"), "coeff": F.sqrt(F.col("xx") * F.col("yy"))}[scale]
    return s.join(nx, KEY).join(ny, KEY).select(KEY, "lag", (F.col("s") / by).alias("value"))


def radon_lines(image: DataFrame, thetas: list[float], rhos: list[float], nx: int, ny: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(theta, rho, value): sum of nearest pixels along lines x cos + y sin = rho about the image's middle, one pixel a column, as a line crosses them; of vertical lines, which cross no columns, one pixel a row.

    image (x, y, v). Each pixel works out the one rho of each theta that its column's (or row's) sample may belong
    to, and sums are formed before the shuffle: no pixel meets all lines.
    """
    step, n = rhos[1] - rhos[0], len(rhos)
    turns = [(k, math.cos(t), math.sin(t)) for k, t in enumerate(thetas)]
    lines = [(k, s, c, True) if abs(s) <= VERTICAL else (k, c, s, False) for k, c, s in turns]  # a vertical line is one of the transposed image
    x0, y0 = (nx - 1) / 2, (ny - 1) / 2
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("theta"), F.lit(c).alias("c"), F.lit(s).alias("s"), F.lit(up).alias("up")) for k, c, s, up in lines])).alias("l")
    along = F.when(F.col("l.up"), F.col("y") - y0).otherwise(F.col("x") - x0)
    across, middle = F.when(F.col("l.up"), F.col("x")).otherwise(F.col("y")), F.when(F.col("l.up"), x0).otherwise(y0)
    base = along * F.col("l.c") + (across - middle) * F.col("l.s")
    # rho whose line passes within half a pixel of y in this column: |rho - base| <= |s| / 2
    reach = F.abs(F.col("l.s")) / 2
    lo, hi = F.ceil((base - reach - rhos[0]) / step), F.floor((base + reach - rhos[0]) / step)
    a, b = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n - 1))
    hit = image.select(*keys, "x", "y", "v", grid).filter(a <= b).withColumn("rho", F.explode(F.sequence(a, b)))
    at = middle + (rhos[0] + F.col("rho") * step - along * F.col("l.c")) / F.col("l.s")
    return hit.filter(F.floor(at + 0.5) == across).groupBy(*keys, F.col("l.theta").alias("theta"), F.col("rho").cast("int").alias("rho")).agg(F.sum("v").alias("value"))


def fit_line(lines: DataFrame, thetas: list[float], rhos: list[float], nx: int, ny: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Slope and intercept of the line of the largest value; the first by theta, then rho, among equals. A vertical line has neither: both are null."""
    best = lines.groupBy(*keys).agg(F.max_by(F.struct("theta", "rho"), F.struct("value", -F.col("theta"), -F.col("rho"))).alias("b"), F.max("value").alias("score"))
    th = F.lit(thetas[0]) + F.col("b.theta") * (thetas[1] - thetas[0])
    rho = F.lit(rhos[0]) + F.col("b.rho") * (rhos[1] - rhos[0])
    sin, tan = (F.when(F.abs(F.sin(th)) > VERTICAL, f(th)) for f in (F.sin, F.tan))
    slope = -1 / tan
    return best.select(*keys, slope.alias("slope"), (rho / sin - slope * ((nx - 1) / 2) + (ny - 1) / 2).alias("intercept"), "score")


def window_function(signal: DataFrame, name: str, u: Column) -> DataFrame:
    """signal with weight: a kernel of u."""
    return signal.withColumn("weight", kernel(name, u))
