"""Quantiles, spectral intervals, merging variants, formats and checks against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import checks as K
from tempora.functions import formats as X
from tempora.operators import density as D
from tempora.operators import geometry as G
from tempora.operators import shapes as H
from tempora.operators import spectral as Q


def test_quantiles():
    assert abs(Q.chi2_quantile(0.95, 10) - 18.307038053275146) < 1e-8 and abs(Q.chi2_quantile(0.025, 4) - 0.4844185570879303) < 1e-8
    assert abs(Q.student_quantile(0.975, 4) - 2.7764451051977987) < 1e-6 and abs(Q.student_quantile(0.05, 9) + 1.8331129326536335) < 1e-6
    assert Q.bandwidth_range(100, 10.0) == (0.1, 4.95)


def test_spectral_intervals():
    r = np.random.default_rng(1)
    x, y = (r.normal(size=(5, 7)) + 1j * r.normal(size=(5, 7)) for _ in range(2))
    power = (np.abs(x) ** 2).mean(axis=0)
    low, high = Q.spectrum_interval(power, x)
    assert np.allclose(low, 10 * power / Q.chi2_quantile(0.975, 10)) and (low < power).all() and (power < high).all()
    assert Q.degrees(5, 3.0) == math.trunc(1 / (1 / 10 + 1 / 6))
    low, high = Q.spectrum_interval(power, x, kind="jackknife")
    left = np.log([(np.abs(np.delete(x, k, axis=0)) ** 2).sum(axis=0) / 4 for k in range(5)])
    assert np.allclose(high / power, np.exp(Q.student_quantile(0.975, 4) * 2 * left.std(axis=0))) and np.allclose(low * high, power**2)
    c = np.abs((x * np.conj(y)).sum(axis=0)) / np.sqrt((np.abs(x) ** 2).sum(axis=0) * (np.abs(y) ** 2).sum(axis=0))
    level, spread, none, _ = Q.coherence_error(c, x, y)
    assert abs(level - math.sqrt(1 - 0.05 ** 0.25)) < 1e-12 and np.allclose(spread, np.sqrt(0.2 * (1 / c**2 - 1))) and none is None
    _, spread, low, high = Q.coherence_error(c, x, y, kind="jackknife")
    assert (low <= high).all() and (low >= 0).all() and (high <= 1).all() and np.isfinite(spread).all()


def test_merging_variants():
    x = np.random.default_rng(0).normal(size=(150, 2)) @ np.array([[1.0, 0.8], [0.0, 0.6]])
    var = np.array([0.1, 0.1])
    n, m, c = D.merge_source(x, var, 2.0, "full")
    assert n.sum() == 150 and len(n) < 150
    total = sum(k * (v + np.outer(u, u)) for k, u, v in zip(n, m, c, strict=True))
    assert np.allclose(total, x.T @ x + 150 * np.diag(var)) and np.allclose(n @ m, x.sum(axis=0))
    n, m, c = D.merge_source(x, var, 2.0, "constant")
    assert np.allclose(c, var) and np.allclose(n @ m, x.sum(axis=0))
    assert len(D.merge_source(x, var, 0.0, "full")[0]) == 150


def test_unscented_distance():
    one = (np.ones(1), np.zeros((1, 2)), np.eye(2)[None])
    far = (np.ones(1), np.full((1, 2), 50.0), np.eye(2)[None])
    near = (np.ones(1), np.full((1, 2), 0.5), np.eye(2)[None])
    assert D.unscented_hellinger(one, one) == 0 and D.unscented_hellinger(one, far) > 0.99
    exact = math.sqrt(1 - math.exp(-0.5 / 8))
    assert abs(D.unscented_hellinger(one, near) - exact) < 0.05


def test_mixture_of_full_covariance(spark):
    r = np.random.default_rng(3)
    covs = [np.array([[1.0, 0.6], [0.6, 0.9]]), np.array([[0.5, -0.2], [-0.2, 0.4]])]
    comps = spark.createDataFrame([("a", 0.3, [0.0, 0.0], covs[0].tolist()), ("a", 0.7, [1.0, 1.0], covs[1].tolist())], "source string, weight double, mean array<double>, cov array<array<double>>")
    x = r.normal(size=(30, 2))
    points = spark.createDataFrame([("a", k, v.tolist()) for k, v in enumerate(x)], "source string, id long, x array<double>")
    got = {p["id"]: p["density"] for p in D.evaluate_full(points, D.with_factors(comps), [0, 1], 1e9).collect()}
    want = D.mixture_density(x, np.array([0.3, 0.7]), np.array([[0.0, 0.0], [1.0, 1.0]]), np.stack(covs))
    assert np.allclose([got[k] for k in range(30)], want)
    m = D.moment_match_full(comps, ["source"], [0, 1]).first()
    mean = np.array([0.7, 0.7])
    cov = 0.3 * (covs[0] + np.outer(mean, mean)) + 0.7 * (covs[1] + np.outer(1 - mean, 1 - mean))
    assert np.allclose(m["mean"], mean) and np.allclose(np.array(m["cov"]), cov)


def test_formats():
    assert X.file_type({"File Format": "eeg"}) == "eeg" and X.file_type({"Program": "adextract", "Extraction type": "event strings"}) == "event"
    assert X.file_type({"Program": "XClust", "Cluster": "3"}) == "cluster" and X.file_type({"adversion": "2"}) == "ad 2" and X.file_type({}) == X.file_type({"Program": "other"}) == "unknown"
    assert X.enabled_channels(3, {"DisabledSubChannels": ["1", "x"]}) == [True, False, True]
    assert X.may_alias({"DSPHighCutFilterEnabled": True, "DspHighCutFrequency": 6000, "SamplingFrequency": 8000}) and not X.may_alias({"DSPHighCutFilterEnabled": False, "DspHighCutFrequency": 6000, "SamplingFrequency": 8000})
    assert X.code_of(300.0, 400.0) == 8 + 768 and X.epochs_of({"epochs": [{"id": "run"}]}, "/s")["run"]["path"] == "/s/epochs/run"
    assert D.covariance_of_bandwidths(8.5, 0.15) == [72.25, 22500.0, 22500.0, 22500.0, 22500.0]


def test_checks_fail(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("b", 1.0, "z")], "k string, v double, s string")
    with pytest.raises(TypeError):
        K.check_vector(df, "s")
    with pytest.raises(Exception, match="different lengths"):
        K.check_vectors(df, "k", "v", True).collect()
    assert K.check_vectors(df.filter("v = 1"), "k", "v", True).count() == 2
    assert sorted(r["v"] for r in K.shuffle(df, ["k"], "s", "v").collect()) == [1.0, 1.0, 2.0]
    assert K.check_points(df.select(F.col("v").alias("x"), F.col("v").alias("y"))).count() == 3 and K.is_shaped(df, df.schema)


def test_shapes():
    assert H.samples_of([(0.0, 0.0), (3.0, 0.0), (3.0, 3.0)], 2.0) == [(0.0, 0.0), (2.0, 0.0), (3.0, 1.0), (3.0, 3.0)]
    a, b = 3.0, 2.0
    x0, y0, x1, y1 = H.ellipse_box((1.0, 2.0), (a, b), 0.7)
    t = np.linspace(0, 2 * math.pi, 100_001)
    x = 1 + a * np.cos(t) * math.cos(0.7) - b * np.sin(t) * math.sin(0.7)
    y = 2 + a * np.cos(t) * math.sin(0.7) + b * np.sin(t) * math.cos(0.7)
    assert np.allclose([x0, y0, x1, y1], [x.min(), y.min(), x.max(), y.max()], atol=1e-6)
    poly = [(5.0, 10.0), (40.0, 5.0), (45.0, 60.0), (20.0, 30.0), (8.0, 70.0)]
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]], strict=True))) / 2
    assert len(H.triangles(poly)) == 3 and abs(sum(map(area, H.triangles(poly))) - area(poly)) < 1e-9
    g = H.Graph([[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0005), (1.0, 2.0)]], [(0, 1), (1, 2)])
    assert g.snapped([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)]).polylines[1][0] == (1.0, 0.0) and g.bounding_box() == (0.0, 0.0, 1.0, 2.0)
    with pytest.raises(ValueError):
        g.snapped([(0.0, 0.0), (1.0, 0.1), (1.0, 2.0)])
    assert H.scaled([(0.0, 0.0), (2.0, 0.0)], 2.0) == [(-1.0, 0.0), (3.0, 0.0)] and H.box_corners((0, 0, 1, 2))[2] == (1, 2)
    assert G.length(g.polylines[0]) == 1.0
