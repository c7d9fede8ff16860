"""Filters in chunks, exact quantiles and bootstraps of large groups against whole-group computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import quantiles as K
from tempora.operators import signals as G
from tempora.operators import spectral as Q

SIGNAL = "channel string, i long, t double, v double"


def channels(spark, **values):
    return spark.createDataFrame([(c, k + off, float(k), float(x)) for c, (off, v) in values.items() for k, x in enumerate(v)], SIGNAL).repartition(5)


def got(df, c):
    return np.array([r["v"] for r in df.filter(F.col("channel") == c).orderBy("i").collect()])


@pytest.mark.parametrize("chunk", [1, 300, 700, 10_000])
def test_filters_in_chunks_equal_the_whole(spark, chunk):
    r, taps = np.random.default_rng(1), Q.kaiser_filter(0.1, 0.2, 1.0)
    x = {"a": (0, r.normal(size=3000).cumsum()), "b": (17, r.normal(size=1201)), "short": (0, r.normal(size=40)), "one": (5, [3.0])}
    df = Q.apply_filter(channels(spark, **x), taps, chunk)
    for c, (_, v) in x.items():
        assert np.allclose(got(df, c), Q.filter_both(np.array(v), taps), atol=1e-9), c
    assert Q.apply_filter(channels(spark, a=(0, [])), taps, chunk).count() == 0


def test_a_channel_is_filtered_in_many_tasks(spark):
    taps = Q.kaiser_filter(None, 0.1, 1.0)
    df = spark.range(50_000).select(F.lit("c").alias("channel"), F.col("id").alias("i"), F.sin(F.col("id") * 0.05).alias("v"))
    sent = Q.apply_filter(df, taps, 1000)
    assert np.allclose(got(sent, "c"), Q.filter_both(np.sin(np.arange(50_000) * 0.05), taps), atol=1e-9)
    with pytest.raises(Exception, match="gaps"):
        Q.apply_filter(df.filter("i <> 777"), taps, 1000).collect()


@pytest.mark.parametrize("chunk", [1, 5000])
def test_envelopes_in_chunks(spark, chunk):
    n, taps = 8000, Q.kaiser_filter(0.1, 0.2, 1.0)
    k = np.arange(n)
    x = (1 + 0.5 * np.sin(k * 0.004)) * np.sin(2 * np.pi * 0.15 * k)
    smooth = np.hanning(33)
    whole = Q.envelope_part(x, 0, 0, n, n, np.correlate(taps, taps, "full"), Q.hilbert_taps(Q.HILBERT * len(taps)), smooth / smooth.sum())
    mine = got(Q.apply_envelope(channels(spark, c=(0, x)), taps, smooth, chunk), "c")
    assert np.allclose(mine, whole, atol=1e-9)
    inner = slice(600, -600)
    assert np.abs(mine - Q.envelope(x, taps, smooth))[inner].max() < 1e-3 and np.abs(mine - (1 + 0.5 * np.sin(k * 0.004)))[inner].max() < 0.01
    assert np.allclose(got(Q.apply_envelope(channels(spark, s=(0, x[:60])), taps, None, chunk), "s"), Q.envelope(x[:60], taps))
    with pytest.raises(ValueError, match="odd"):
        Q.apply_envelope(channels(spark, c=(0, x[:9])), taps, np.ones(2))


def test_exact_quantiles(spark):
    r = np.random.default_rng(2)
    groups = {
        "normal": r.normal(size=2001), "ties": r.integers(0, 3, 500).astype(float), "one": np.array([4.5]), "two": np.array([-1.0, 2.0]), "same": np.full(100, -7.25),
        "wide": np.concatenate([r.normal(size=50) * 10.0 ** r.integers(-300, 300, 50), [0.0, -0.0, 5e-324, -5e-324, 1.7e308]]), None: r.normal(size=33),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("normal", None), ("void", None)]
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0, 1 / 3]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    found = {x["g"]: x["q"] for x in K.quantiles(df, "g", "v", shares).collect()}
    assert set(found) == set(groups)
    for k, v in groups.items():
        want = np.quantile(v, shares)
        assert np.allclose(found[k], want, rtol=1e-13, atol=0), k
    assert {x["g"]: x["median"] for x in K.median(df, "g", "v").collect()}["two"] == 0.5
    infinite = spark.createDataFrame([("i", float(x)) for x in (-math.inf, 1, 2, math.inf)] + [("n", math.nan), ("n", 1.0), ("n", 0.0)], "g string, v double")
    by = {x["g"]: x["q"] for x in K.quantiles(infinite, "g", "v", [0.0, 0.5, 1.0]).collect()}
    assert by["i"] == [-math.inf, 1.5, math.inf] and by["n"][:2] == [0.0, 1.0] and math.isnan(by["n"][2])
    assert K.quantiles(df.limit(0), "g", "v", [0.5]).count() == 0


def test_ranks_among_many_ties(spark):
    df = spark.range(30_000).select(F.lit("g").alias("g"), F.when(F.col("id") < 29_990, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    ranks = lambda n: F.array(F.lit(0), n - 11, n - 10, n - 1)
    assert sorted((x["r"], x["v"]) for x in K.order_statistics(df, "g", "v", ranks).collect()) == [(0, 1.0), (29_989, 1.0), (29_990, 29_990.0), (29_999, 29_999.0)]


def test_thresholds(spark):
    r = np.random.default_rng(3)
    x = {"a": (0, r.normal(size=501)), "b": (0, [1.0, 1.0, 5.0])}
    for t in G.thresholds(channels(spark, **x), [2.0], [0.1]).collect():
        v = np.array(x[t["channel"]][1])
        m, q = np.quantile(v, [0.5, 0.75])
        assert np.allclose([t["zscore_0"], t["median_0"], t["percentile_0"]], [v.mean() + 2 * v.std(), m + 2 * (q - m), np.quantile(v, 0.1)])


def test_bootstrap_of_groups_in_many_tasks(spark):
    r = np.random.default_rng(4)
    n = {"big": 3000, "small": 12, None: 40}
    rows = [(k, j + 10_000 * i, float(r.normal(5, 2)), float(r.uniform(1, 2))) for i, (k, m) in enumerate(n.items()) for j in range(m)]
    df = spark.createDataFrame([*rows, ("big", None, 1.0, 1.0), ("big", 99_999, None, 1.0)], "g string, id long, x double, y double").repartition(9)
    samples = 400
    for statistic, other in (("mean", None), ("variance", None), ("ratio", "y")):
        found = {q["g"]: q for q in Q.poisson_interval(df, "g", "x", "id", statistic, other, samples, 0.1, 7).collect()}
        again = {q["g"]: q for q in Q.poisson_interval(df.repartition(2), "g", "x", "id", statistic, other, samples, 0.1, 7).collect()}
        for k in n:
            mine = [row for row in rows if row[0] == k]
            x, y = np.array([m[2] for m in mine]), np.array([m[3] if other else 1.0 for m in mine])
            w = Q.poisson_weights(np.array([m[1] for m in mine]), np.arange(samples), 7)
            of = lambda w: {"mean": w @ x / w.sum(axis=-1), "variance": w @ (x * x) / w.sum(axis=-1) - (w @ x / w.sum(axis=-1)) ** 2, "ratio": w @ x / (w @ y)}[statistic]  # noqa: B023, E731
            want = [of(np.ones(len(x))), *np.quantile(of(w.T), [0.05, 0.95])]
            assert np.allclose([found[k][c] for c in ("estimate", "low", "high")], want) and np.allclose([again[k][c] for c in ("estimate", "low", "high")], want)
    # the spread is that of the mean
    low, high = found_mean(df, samples)
    assert 0.8 < (high - low) / (2 * 1.645 * 2 / math.sqrt(3000)) < 1.25
    w = Q.poisson_weights(np.arange(5000), np.arange(40), 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01


def found_mean(df, samples):
    got = Q.poisson_interval(df.filter("g = 'big'"), "g", "x", "id", samples=samples, alpha=0.1, seed=1).first()
    return got["low"], got["high"]
