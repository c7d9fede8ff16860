"""Statistics of event trains (train, t, mark): rates, bins, intervals, bursts and correlograms. Trains are kept apart by the column train."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof, interpolate, range_join
from .segments import remove_overlap

KEY = "train"


def ordered(*tie: str) -> Window:
    return Window.partitionBy(KEY).orderBy("t", *tie)


def rate(events: DataFrame) -> DataFrame:
    """Events over the time from first to last."""
    return events.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / (F.max("t") - F.min("t"))).alias("rate"))


def rate_in(events: DataFrame, segs: DataFrame, width: float, separate: bool = False) -> DataFrame:
    """Events inside segments over their duration: the merged segments' in all, or each segment's own; 0 for trains, and segments of a train, without any."""
    trains = events.select(KEY).distinct()
    if separate:
        own = segs.select("seg_id", "start", "stop")
        found = range_join(events, own, width).groupBy(KEY, "seg_id").agg(F.count(F.lit(1)).alias("n"))
        every = own.crossJoin(trains)  # the result: a row a segment and train
        n = F.coalesce("n", F.lit(0))
        return every.join(found, [KEY, "seg_id"], "left").select(KEY, "seg_id", n.alias("n"), F.try_divide(n, F.col("stop") - F.col("start")).alias("rate"))
    merged = remove_overlap(segs)
    total = merged.agg(F.sum(F.col("stop") - F.col("start")).alias("total"))
    found = range_join(events, merged.select("start", "stop"), width).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return trains.join(found, KEY, "left").crossJoin(F.broadcast(total)).select(KEY,  # total is one row
         n.alias("n"), F.try_divide(n, F.col("total")).alias("rate"))


def bins(events: DataFrame, grid: DataFrame, width: float, kind: str = "count") -> DataFrame:
    """(bin, train, value) of bins (bin, start, stop) that may overlap: count, binary or rate of each train that has an event there."""
    n = range_join(events.select(KEY, "t"), grid, width).groupBy("bin", "start", "stop", KEY).agg(F.count(F.lit(1)).alias("n"))
    value = {"count": F.col("n"), "binary": F.lit(1), "rate": F.col("n") / (F.col("stop") - F.col("start"))}[kind]
    return n.select("bin", KEY, value.alias("value"))


def bin_table(events: DataFrame, grid: DataFrame, width: float, trains: list[str], kind: str = "count") -> DataFrame:
    """A row for each bin, a column for each train; 0 where a bin has none."""
    wide = bins(events, grid, width, kind).groupBy("bin").pivot(KEY, trains).agg(F.first("value"))
    return grid.select("bin").join(wide, "bin", "left").fillna(0)


def regular_bins(events: DataFrame, size: float) -> DataFrame:
    """(bin, train, n) of the bins [k size, (k + 1) size): no join."""
    return events.groupBy(F.floor(F.col("t") / size).alias("bin"), KEY).agg(F.count(F.lit(1)).alias("n"))


def count_until(events: DataFrame, points: DataFrame) -> DataFrame:
    """points with the number n of events at or before t, of equal train."""
    every = events.select(KEY, "t", F.lit(0).alias("_o"), F.lit(1).alias("_d")).unionByName(points.select(KEY, "t", F.lit(1).alias("_o"), F.lit(0).alias("_d"), F.struct("*").alias("_l")), allowMissingColumns=True)
    w = Window.partitionBy(KEY).orderBy("t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("n", F.sum("_d").over(w)).filter("_o = 1").select("_l.*", "n")


def intervals(events: DataFrame, kind: str = "post") -> DataFrame:
    """events with interval: signed time to the next (post) or previous (pre, negative) event, or that of smallest or largest size, null where either is missing; of equal sizes smallest takes the next one's, largest the previous one's."""
    w = ordered("event_id")
    pre, post = F.lag("t").over(w) - F.col("t"), F.lead("t").over(w) - F.col("t")
    both = pre.isNotNull() & post.isNotNull()
    value = {"pre": pre, "post": post, "smallest": F.when(both, F.when(F.abs(pre) < F.abs(post), pre).otherwise(post)), "largest": F.when(both, F.when(F.abs(post) > F.abs(pre), post).otherwise(pre))}[kind]
    return events.withColumn("interval", value)


def cross_intervals(events: DataFrame, other: DataFrame, kind: str = "post", strict: bool = False) -> DataFrame:
    """events with the signed interval to the next or previous event of other; 0 where times are equal."""
    found = asof(events, other.select("t"), [], backward=kind == "pre", strict=strict)
    return found.withColumn("interval", F.col("_asof.t") - F.col("t")).drop("_asof")


def filter_intervals(events: DataFrame, least: float = 0.003) -> DataFrame:
    """events less those that follow the event before them, kept or not, by less than least."""
    gap = F.col("t") - F.lag("t").over(ordered("event_id"))
    return events.withColumn("_g", gap).filter("_g IS NULL OR _g >= %r" % least).drop("_g")


def bursts(events: DataFrame, low: float, high: float, nevents: tuple[int, int] | None = None, marks: bool = False) -> DataFrame:
    """events with burst: 0 none, 1 first, 2 middle, 3 last; intervals from low to high belong to a burst, marks (if used) must not rise in it, and bursts of other lengths than nevents become 0."""
    w = ordered("event_id")
    gap, fall = F.col("t") - F.lag("t").over(w), F.col("mark") <= F.lag("mark").over(w)
    tied = events.withColumn("_in", F.coalesce((gap >= low) & (gap <= high) & (fall if marks else F.lit(True)), F.lit(False)))
    out = F.coalesce(F.lead("_in").over(w), F.lit(False))
    coded = tied.withColumn("burst", F.when(~F.col("_in") & out, 1).when(F.col("_in") & out, 2).when(F.col("_in"), 3).otherwise(0))
    if nevents:
        run = coded.withColumn("_b", F.sum(F.when(F.col("burst") == 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        n = F.sum(F.when(F.col("burst") > 0, 1).otherwise(0)).over(Window.partitionBy(KEY, "_b"))
        coded = run.withColumn("_n", n).withColumn("burst", F.when(F.col("_n").between(*nevents), F.col("burst")).otherwise(0)).drop("_b", "_n")
    return coded.drop("_in")


def filter_bursts(coded: DataFrame, method: str = "reduce") -> DataFrame:
    """reduce: firsts and lone events; remove: lone events; isolate: burst events; isolatereduce: firsts; none: all."""
    keep = {"reduce": F.col("burst") <= 1, "remove": F.col("burst") == 0, "isolate": F.col("burst") != 0, "isolatereduce": F.col("burst") == 1}
    return coded.filter(keep[method]) if method in keep else coded


def _spike_index(near: DataFrame, low: float, high: float, keys: list[str]) -> DataFrame:
    """(keys, _s): right less wrong of rows with dt (own time less the neighbour's) and da (own mark less the neighbour's)."""
    far = F.abs("dt")
    valid, refractory = far <= high, far < low
    right = ((F.col("da") <= 0) & (F.col("dt") > 0)) | ((F.col("da") > 0) & (F.col("dt") < 0))
    wrong = ((F.col("da") <= 0) & (F.col("dt") < 0)) | ((F.col("da") > 0) & (F.col("dt") > 0))
    return near.groupBy(*keys).agg((F.count_if(valid & ~refractory & right) - F.count_if(valid & (refractory | wrong))).alias("_s"))


def complex_spike_index(events: DataFrame, low: float, high: float, cross: bool = False) -> DataFrame:
    """(train, csi), or (train, other, csi) of all pairs of trains if cross: 100 * (right - wrong) // n.

    Each of a train's n events is compared with the nearer of the events before and after it (the later
    one if equally near) in its own train, or the other; an event without either takes no part. Up to
    high apart, an event that follows its neighbour and isn't larger, or comes before it and is larger,
    is right, and the others are wrong; less than low apart all are wrong.
    """
    n = events.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    w = ordered("event_id")
    pre, post = F.struct(F.lag("t").over(w).alias("t"), F.lag("mark").over(w).alias("mark")), F.struct(F.lead("t").over(w).alias("t"), F.lead("mark").over(w).alias("mark"))
    nearer = F.when(F.col("_q.t") - F.col("t") <= F.col("t") - F.col("_p.t"), F.col("_q")).otherwise(F.col("_p"))
    both = F.col("_p.t").isNotNull() & F.col("_q.t").isNotNull()
    gap = lambda df, *keys: df.filter(both).withColumn("_x", nearer).select(*keys, (F.col("t") - F.col("_x.t")).alias("dt"), (F.col("mark") - F.col("_x.mark")).alias("da"))
    index = F.floor(100 * F.coalesce("_s", F.lit(0)) / F.col("_n")).cast("long").alias("csi")
    own = _spike_index(gap(events.select(KEY, "t", "mark", pre.alias("_p"), post.alias("_q")), KEY), low, high, [KEY])
    if not cross:
        return n.join(own, KEY, "left").select(KEY, index)
    trains = events.select(F.col(KEY).alias("other")).distinct()
    asked = events.select(KEY, "t", "mark").crossJoin(trains).filter(F.col(KEY) != F.col("other"))  # an event is compared with every other train
    there = events.select(F.col(KEY).alias("other"), "t", "mark")
    lined = asof(asof(asked, there, ["mark"], ("other",)).withColumnRenamed("_asof", "_p"), there, ["mark"], ("other",), backward=False).withColumnRenamed("_asof", "_q")
    found = _spike_index(gap(lined, KEY, "other"), low, high, [KEY, "other"]).unionByName(own.withColumn("other", F.col(KEY)))
    return n.crossJoin(trains).join(found, [KEY, "other"], "left").select(KEY, "other", index)


def _valid_references(reference: DataFrame, low: float, high: float, segs: DataFrame, width: float, unbiased: bool) -> DataFrame:
    """(ref_train, ref_t, _s, _e): reference events with the segment that they lie in, ends included; unbiased shortens it by the lags."""
    ref = reference.select(F.col(KEY).alias("ref_train"), F.col("t").alias("ref_t"))
    s = segs.select(F.col("start").alias("_s"), F.col("stop").alias("_e"), "start", "stop")
    inner = s.withColumns({"start": F.col("_s") - (low if unbiased else 0), "stop": F.col("_e") - (high if unbiased else 0)}).filter("stop >= start")
    return range_join(ref, inner, width, x="ref_t", closed=True).select("ref_train", "ref_t", "_s", "_e")


def near_reference(events: DataFrame, reference: DataFrame, low: float, high: float, segs: DataFrame | None = None, width: float | None = None, unbiased: bool = False) -> DataFrame:
    """(train, ref_train, ref_t, lag) of events with low <= t - ref_t <= high: a band join on buckets of the band's width.

    With segments, overlapping ones merged, both must lie in the same one, ends included; unbiased
    shortens it for references by the lags.
    """
    if segs is None:
        ref = reference.select(F.col(KEY).alias("ref_train"), F.col("t").alias("ref_t"))
    else:
        ref = _valid_references(reference, low, high, remove_overlap(segs.withColumn("set_id", F.lit("all")), strict=False), width, unbiased)
    band = ref.withColumns({"start": F.col("ref_t") + low, "stop": F.col("ref_t") + high})
    if segs is not None:
        band = band.withColumns({"start": F.greatest("start", "_s"), "stop": F.least("stop", "_e")}).filter("stop >= start").drop("_s", "_e")
    return range_join(events.select(KEY, "t"), band, max(high - low, 1e-9), closed=True).select(KEY, "ref_train", "ref_t", (F.col("t") - F.col("ref_t")).alias("lag"))


NORMALIZATIONS = ("none", "coef", "rate", "conditional mean intensity", "product density", "cross covariance", "cumulant density", "zscore", "zscore_sqrt")


def peri_event_histogram(events: DataFrame, reference: DataFrame, edges: list[float], normalization: str = "none", segs: DataFrame | None = None, width: float | None = None, unbiased: bool = False, remove_zero: bool = False) -> DataFrame:
    """(train, ref_train, bin, value): lags from reference to event, counted between edges; the last bin is closed, and empty bins of all pairs of trains are there.

    Counts are of events and references in the same segment (overlapping ones merged; by default one
    segment from the first to the last of all times). Valid references lie in a segment, ends included;
    unbiased takes only those that see all lags in it, and then scales what isn't divided by their number
    up to the references inside segments (start <= t < stop). With counts c, steps d, the summed
    durations T and the rates l of events and references inside segments, over T:

    coef: c / valid; rate and conditional mean intensity: c / (valid d); product density: c / (d T);
    cross covariance and cumulant density: c / (d T) - l l; zscore: that over l l / (d T), or over its
    root for zscore_sqrt. Null where a divisor is 0.
    """
    if normalization not in NORMALIZATIONS:
        raise ValueError(normalization)
    n, low, high = len(edges) - 1, edges[0], edges[-1]
    refs = reference.select(F.col(KEY).alias("ref_train"), "t")
    lags = near_reference(events, reference, low, high, segs, width, unbiased)
    if segs is None:
        ends = events.select("t").unionByName(reference.select("t")).agg(F.min("t").alias("_s"), F.max("t").alias("_e"))  # one row
        of = lambda df, k: df.crossJoin(F.broadcast(ends)).groupBy(k)
        seen = F.col("t").between(F.col("_s") - (low if unbiased else 0), F.col("_e") - (high if unbiased else 0))
        nr = of(refs, "ref_train").agg(F.count_if(seen).alias("valid"), F.count_if(F.col("t") < F.col("_e")).alias("nr"))
        ne = of(events.select(KEY, "t"), KEY).agg(F.count_if(F.col("t") < F.col("_e")).alias("ne"))
        time = ends.select((F.col("_e") - F.col("_s")).alias("T"))
        if unbiased:
            lags = lags.crossJoin(F.broadcast(ends)).filter(F.col("ref_t").between(F.col("_s") - low, F.col("_e") - high)).drop("_s", "_e")
    else:
        whole = remove_overlap(segs.withColumn("set_id", F.lit("all")), strict=False).select("start", "stop")
        valid = _valid_references(reference, low, high, whole, width, unbiased).groupBy("ref_train").agg(F.count(F.lit(1)).alias("valid"))
        within = lambda df, k, name: range_join(df, whole, width).groupBy(k).agg(F.count(F.lit(1)).alias(name))
        nr = refs.select("ref_train").distinct().join(valid, "ref_train", "left").join(within(refs, "ref_train", "nr"), "ref_train", "left").fillna(0)
        ne = events.select(KEY).distinct().join(within(events.select(KEY, "t"), KEY, "ne"), KEY, "left").fillna(0)
        time = segs.agg(F.sum(F.col("stop") - F.col("start")).alias("T"))
    if remove_zero:
        lags = lags.filter("lag != 0")
    at = sum((F.when(F.col("lag") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    counts = lags.groupBy(KEY, "ref_train", at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    steps = F.array(*[F.lit(float(b - a)) for a, b in zip(edges, edges[1:], strict=False)])
    grid = ne.crossJoin(nr).crossJoin(F.broadcast(time)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # the result: a row a pair of trains and bin
    x = grid.join(counts, [KEY, "ref_train", "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    c, step, valid, total = F.col("c"), steps[F.col("bin")], F.col("valid"), F.col("T")
    if unbiased and normalization not in ("coef", "rate", "conditional mean intensity"):
        c = F.try_divide(c * F.col("nr"), valid)
    density = F.try_divide(c, step * total)
    lone = F.try_divide(F.col("ne"), total) * F.try_divide(F.col("nr"), total)
    value: Column = {
        "none": c,
        "coef": F.try_divide(c, valid),
        "rate": F.try_divide(c, step * valid),
        "conditional mean intensity": F.try_divide(c, step * valid),
        "product density": density,
        "cross covariance": density - lone,
        "cumulant density": density - lone,
        "zscore": F.try_divide(density - lone, F.try_divide(lone, step * total)),
        "zscore_sqrt": F.try_divide(density - lone, F.sqrt(F.try_divide(lone, step * total))),
    }[normalization]
    return x.select(KEY, "ref_train", "bin", value.alias("value"))


def triggered_average(triggers: DataFrame, samples: DataFrame, lags: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(lag, mean, n): samples v interpolated at each trigger's t + lag, averaged; what lies outside the samples is left out."""
    at = triggers.select(*keys, "t", F.explode(F.array(*[F.lit(float(x)) for x in lags])).alias("lag")).withColumn("t", F.col("t") + F.col("lag"))
    return interpolate(at, samples, "v", keys).filter("v IS NOT NULL").groupBy("lag").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


def density(events: DataFrame, grid: DataFrame, bandwidth: float, cutoff: float = 6.0) -> DataFrame:
    """(train, x, density): gaussian kernel density of t at grid (x), events up to cutoff bandwidths away."""
    h = bandwidth
    near = range_join(events.select(KEY, "t"), grid.select("x", (F.col("x") - cutoff * h).alias("start"), (F.col("x") + cutoff * h).alias("stop")), 2 * cutoff * h, closed=True)
    n = events.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    u = (F.col("t") - F.col("x")) / h
    return near.groupBy(KEY, "x").agg(F.sum(F.exp(-u * u / 2)).alias("s")).join(n, KEY).select(KEY, "x", (F.col("s") / (F.col("n") * h * math.sqrt(2 * math.pi))).alias("density"))


def split_by_string(rows: DataFrame, string: str, t: str = "t") -> DataFrame:
    """(string, n, times): a row for each distinct string with its times in order."""
    return rows.groupBy(string).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(t)).alias("times"))
