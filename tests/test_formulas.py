"""Statistics of events, angles and signals against cases worked out by hand, and clock alignment against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import alignment as A
from tempora.operators import circular as C
from tempora.operators import events as E
from tempora.operators import signals as G

SEGS = "set_id string, seg_id long, start double, stop double"


def train(spark, times, name="a", marks=None):
    return spark.createDataFrame([(name, k, float(t), float(m)) for k, (t, m) in enumerate(zip(times, marks or times, strict=True))], "train string, event_id long, t double, mark double")


def segs(spark, *ends):
    return spark.createDataFrame([("s", k, float(a), float(b)) for k, (a, b) in enumerate(ends)], SEGS)


def test_rayleigh_and_weighted_interval(spark):
    angles = [0.1, 0.2, 0.4, 1.0]
    r = abs(np.exp(1j * np.array(angles)).mean())
    df = spark.createDataFrame([("g", x, 2.0) for x in angles], "g string, theta double, w double")
    got = C.summary(df, ["g"]).first()
    assert abs(got["rayleigh"] - 7.75) < 0.01 and abs(got["rayleigh"] - (7 * r**2 + 2 * r**4)) < 1e-12 and abs(got["rayleigh_p"] - math.exp(-got["rayleigh"] / 2)) < 1e-12
    # doubled weights stand for twice as many angles
    weighted = C.summary(df, ["g"], weight="w").first()
    assert weighted["n"] == 4 and abs(math.sin(weighted["ci"]) * math.sqrt(2) - math.sin(got["ci"])) < 1e-12


def test_correlogram_normalisations(spark):
    ev, ref = train(spark, [5, 10, 20, 13, 16, 25]), train(spark, [5, 10, 20], "b")
    edges = [-1.5, -0.5, 0.5, 1.5]
    at = lambda norm, **k: {r["bin"]: r["value"] for r in E.peri_event_histogram(ev, ref, edges, norm, segs(spark, (0, 30)), 30.0, **k).collect()}
    near = lambda got, want: sorted(got) == [0, 1, 2] and np.allclose([got[k] for k in range(3)], want)
    assert near(at("none"), [0, 3, 0]) and near(at("coef"), [0, 1, 0]) and near(at("rate"), [0, 1, 0])
    assert near(at("product density"), [0, 0.1, 0])
    assert near(at("cross covariance"), [-0.02, 0.08, -0.02])
    assert near(at("zscore"), [-30.0, 120.0, -30.0]) and near(at("zscore_sqrt"), np.array([-0.02, 0.08, -0.02]) / math.sqrt(0.02 / 30))
    # without segments time runs from 5 to 25 and the last event is outside it
    whole = {r["bin"]: r["value"] for r in E.peri_event_histogram(ev, ref, edges, "cumulant density").collect()}
    assert near(whole, [-5 / 20 * 3 / 20, 3 / 20 - 5 / 20 * 3 / 20, -5 / 20 * 3 / 20])
    assert near({r["bin"]: r["value"] for r in E.peri_event_histogram(ev, ref, edges, "none", remove_zero=True).collect()}, [0, 0, 0])
    with pytest.raises(ValueError):
        E.peri_event_histogram(ev, ref, edges, "other")


def test_unbiased_correlogram_is_scaled_to_all_references(spark):
    # of references at 1, 5 and 9 only 5 sees lags of 2 either way inside 0 to 10
    ev, ref = train(spark, [1, 3, 5, 7, 9]), train(spark, [1, 5, 9], "b")
    args = ([-2.5, -1.5, 1.5, 2.5], "none", segs(spark, (0, 10)), 10.0)
    assert {r["bin"]: r["value"] for r in E.peri_event_histogram(ev, ref, *args).collect()} == {0: 2, 1: 3, 2: 2}
    assert {r["bin"]: r["value"] for r in E.peri_event_histogram(ev, ref, *args, unbiased=True).collect()} == {0: 3.0, 1: 3.0, 2: 3.0}
    rate = E.peri_event_histogram(ev, ref, args[0], "rate", args[2], 10.0, unbiased=True).collect()
    assert {r["bin"]: r["value"] for r in rate} == {0: 1.0, 1: 1 / 3, 2: 1.0}
    alone = E.peri_event_histogram(ev, ref, args[0], "none", unbiased=True).collect()  # times run from 1 to 9
    assert {r["bin"]: r["value"] for r in alone} == {0: 2.0, 1: 2.0, 2: 2.0}


def test_correlogram_of_uneven_bins_and_overlapping_segments(spark):
    ev, ref = train(spark, [1.0, 2.0, 4.0, 9.0]), train(spark, [1.0, 3.0], "b")
    got = E.peri_event_histogram(ev, ref, [-2.0, 0.0, 1.0, 3.0], "none", segs(spark, (0, 5), (0, 5), (2, 6)), 5.0).collect()
    # lags of 1: 0, 1, 3; of 3: -2, -1, 1; an edge belongs to the bin that it begins, the last one also to the last bin
    assert {r["bin"]: r["value"] for r in got} == {0: 2, 1: 1, 2: 3}
    none = E.peri_event_histogram(train(spark, [100.0], "far"), ref, [-1.0, 0.0, 1.0], "coef").collect()
    assert [(r["train"], r["ref_train"], r["bin"], r["value"]) for r in sorted(none)] == [("far", "b", 0, 0.0), ("far", "b", 1, 0.0)]


def test_rates_of_trains_without_events_are_zero(spark):
    ev = train(spark, [1, 2, 50]).unionByName(train(spark, [70], "b"))
    s = segs(spark, (0, 10), (5, 20), (40, 45))
    assert {tuple(r) for r in E.rate_in(ev, s, 10.0).collect()} == {("a", 2, 0.08), ("b", 0, 0.0)}
    own = {(r["train"], r["seg_id"]): (r["n"], r["rate"]) for r in E.rate_in(ev, s, 10.0, True).collect()}
    assert own == {("a", 0): (2, 0.2), ("a", 1): (0, 0.0), ("a", 2): (0, 0.0), ("b", 0): (0, 0.0), ("b", 1): (0, 0.0), ("b", 2): (0, 0.0)}


def test_intervals_of_equal_size(spark):
    ev = train(spark, [0, 2, 4, 5])
    got = lambda kind: [r["interval"] for r in E.intervals(ev, kind).orderBy("t").collect()]
    assert got("largest") == [None, -2.0, -2.0, None] and got("smallest") == [None, 2.0, 1.0, None]


def plain_index(times, marks, other=None, other_marks=None, low=0.1, high=2.0):
    """100 * (right - wrong) // n, event by event."""
    same, score = other is None, 0
    other, other_marks = (times, marks) if same else (other, other_marks)
    for t, m in zip(times, marks, strict=True):
        before = [(u, v) for u, v in zip(other, other_marks, strict=True) if (u < t if same else u <= t)]
        after = [(u, v) for u, v in zip(other, other_marks, strict=True) if (u > t if same else u >= t)]
        if not before or not after:
            continue
        (p, pm), (q, qm) = max(before), min(after)
        dt, da = (t - q, m - qm) if q - t <= t - p else (t - p, m - pm)
        if abs(dt) > high:
            continue
        if abs(dt) < low:
            score -= 1
        elif (da <= 0 and dt > 0) or (da > 0 and dt < 0):
            score += 1
        elif dt:
            score -= 1
    return math.floor(100 * score / len(times))


def test_complex_spike_index(spark):
    times, marks = [0, 1, 10, 11, 30], [5, 4, 4, 4, 1]
    assert E.complex_spike_index(train(spark, times, marks=marks), 0.1, 2.0).first()["csi"] == 20 == plain_index(times, marks)
    r = np.random.default_rng(3)
    trains = {k: (sorted(r.uniform(0, 60, 50).round(2).tolist()), r.integers(0, 9, 50).tolist()) for k in "abc"}
    df = None
    for k, (t, m) in trains.items():
        df = train(spark, t, k, m) if df is None else df.unionByName(train(spark, t, k, m))
    got = {(x["train"], x["other"]): x["csi"] for x in E.complex_spike_index(df, 0.1, 2.0, cross=True).collect()}
    assert got == {(a, b): plain_index(*trains[a], *(trains[b] if a != b else ())) for a in trains for b in trains}
    assert {x["train"]: x["csi"] for x in E.complex_spike_index(df, 0.1, 2.0).collect()} == {a: got[a, a] for a in trains}


def signal(spark, values, channel="c"):
    return spark.createDataFrame([(channel, k, float(k), float(v)) for k, v in enumerate(values)], "channel string, i long, t double, v double")


def test_ripples_drop_runs_without_a_peak_before_joining(spark):
    got = G.ripples(signal(spark, [0, 2, 9, 2, 0, 2, 2, 0, 0, 0]), 1.0, 5.0, 2.0, 1.0).collect()
    assert [tuple(r) for r in got] == [("c", 1.0, 3.0, 1, 9.0)]
    two = signal(spark, [0, 2, 9, 8, 2, 0, 2, 7, 2, 0, 0, 0, 2, 6, 2, 2]).unionByName(signal(spark, [0] * 8, "flat"))
    assert sorted(tuple(r)[:4] for r in G.ripples(two, 1.0, 5.0, 2.0, 1.0).collect()) == [("c", 1.0, 8.0, 2), ("c", 12.0, 15.0, 1)]
    assert sorted(tuple(r)[:3] for r in G.ripples(two, 1.0, 5.0, 1.0, 2.5).collect()) == [("c", 1.0, 4.0), ("c", 12.0, 15.0)]
    cut = G.ripples(two, 1.0, 5.0, 1.0, 1.0, segs(spark, (2, 3), (7, 14), (7.5, 14)), 5.0).collect()
    assert sorted(tuple(r)[:3] for r in cut) == [("c", 2.0, 3.0), ("c", 7.0, 8.0), ("c", 12.0, 14.0)]
    # the gradient of 0 2 9 8 2 crosses 0 at 2 + 3.5 / (3.5 + 3.5) of the samples 2 and 3
    assert [tuple(r) for r in G.gradient_peaks(signal(spark, [0, 2, 9, 8, 2, 0]), 5.0).collect()] == [("c", 2 + 3 / (3 + 3.5), 9 - 3 / (3 + 3.5))]


def test_detection_rates(spark):
    online = train(spark, [1, 4, 12, 14, 31])
    offline = segs(spark, (0, 3), (10, 15), (20, 22), (30, 31))
    # 1, 12 and 14 fall in a segment, 4 and 31 don't; 10 starts 6 after 4, 20 starts 6 after 14, 30 starts 16 after it
    assert tuple(G.detection_rates(online, offline, 7.0).first()) == (75.0, 25.0, 40.0, 50.0)
    assert tuple(G.detection_rates(online, offline).first()) == (75.0, 25.0, 40.0, None)
    assert tuple(G.detection_rates(online.limit(0), offline, 7.0).first()) == (0.0, 100.0, None, 0.0)


def test_shifted_clock(spark):
    t = np.cumsum(np.random.default_rng(1).exponential(10, 200))
    both = lambda x, y, **k: A.synchronization(A.matched(train(spark, x).select("t"), train(spark, y).select("t"), **k)).first()
    for x, y, lag in ((t, t + 7, 0), (t, t[3:] + 7, 3), (t[5:], t + 7, -5), (t[:150], t[20:] + 7, 20)):
        got = both(x, y)
        assert got["lag"] == lag and abs(got["offset"] - 7) < 1e-9 and abs(got["drift"]) < 1e-12 and got["n"] == min(len(x), len(y) + lag) - max(lag, 0)
    got = both(t, t[3:] * 1.001 + 7, block=16)
    assert got["lag"] == 3 and abs(got["drift"] - 0.001) < 1e-12 and both(t, t[3:] + 7, lags=(-2, 2))["lag"] in range(-2, 3)
    assert both(t[:1], t) is None and both(t[:0], t) is None


@pytest.mark.parametrize("block", [4, 7, 64])
def test_correlation_by_blocks(spark, block):
    r = np.random.default_rng(block)
    x, y = r.normal(size=53), r.normal(size=31)
    df = lambda v: spark.createDataFrame([(k, float(c)) for k, c in enumerate(v)], "i long, v double").repartition(3)
    want = {lag: sum(x[i + lag] * y[i] for i in range(31) if 0 <= i + lag < 53) for lag in range(-52, 53)}
    got = {c["lag"]: c["c"] for c in A.correlate(df(x), df(y), block).collect()}
    assert set(range(-30, 53)) <= set(got) <= set(want) and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    few = {c["lag"]: c["c"] for c in A.correlate(df(x), df(y), block, (-9, 5)).collect()}
    assert set(few) == set(range(-9, 6)) and all(abs(v - want[k]) < 1e-9 for k, v in few.items())


def test_times_on_the_other_clock(spark):
    pairs = spark.createDataFrame([(0, 10.0, 20.0, 0), (1, 20.0, 40.0, 0), (2, 30.0, 50.0, 0)], "i long, ta double, tb double, lag long")
    points = spark.createDataFrame([(t,) for t in (0.0, 10.0, 15.0, 25.0, 30.0, 40.0)], "t double")
    at = lambda more: {r["t"]: r["tb"] for r in A.converted(points, pairs, more).collect()}
    inside = {0.0: None, 10.0: 20.0, 15.0: 30.0, 25.0: 45.0, 30.0: 50.0, 40.0: None}
    assert at(False) == inside and at(True) == inside | {0.0: 0.0, 40.0: 60.0}
    assert A.converted(points, pairs.filter("i = 0"), True).filter("tb IS NOT NULL").count() == 1


def test_empty_tables(spark):
    none, s = train(spark, []), segs(spark)
    for df in (E.rate_in(none, s, 1.0), E.rate_in(none, s, 1.0, True), E.complex_spike_index(none, 0.1, 1.0, True), E.peri_event_histogram(none, none, [0.0, 1.0], "zscore"), G.ripples(signal(spark, []), 1.0, 2.0, 1.0, 1.0)):
        assert df.count() == 0
    assert E.rate_in(train(spark, [1.0]), s, 1.0).select(F.col("rate")).first()[0] is None
