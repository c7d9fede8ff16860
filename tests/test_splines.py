"""Splines through nodes: what defines them, and places on them against a search over the samples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import splines as S

NODES = [(0.0, 0.0), (20.0, 40.0), (45.0, 40.0), (50.0, 90.0), (20.0, 110.0)]


@pytest.mark.parametrize("shut", [False, True])
def test_curve_is_smooth_through_its_nodes(shut):
    c = S.spline(NODES, shut)
    p = np.array(NODES + NODES[:1] if shut else NODES)
    assert np.allclose(c.point(c.u), p) and np.allclose(c.samples[:: S.FINE], p) and len(c.samples) == S.FINE * (len(p) - 1) + 1
    for q in (c.x, c.y):
        h = np.diff(c.u)
        end = np.stack([q[:, 0] + h * (q[:, 1] + h * (q[:, 2] + h * q[:, 3])), q[:, 1] + h * (2 * q[:, 2] + 3 * h * q[:, 3]), 2 * q[:, 2] + 6 * h * q[:, 3]], axis=1)
        start = np.stack([q[:, 0], q[:, 1], 2 * q[:, 2]], axis=1)
        assert np.allclose(end[:-1], start[1:])
        if shut:
            assert np.allclose(end[-1], start[0])
        else:  # no knot where one would be second and last but one
            assert np.isclose(q[0, 3], q[1, 3]) and np.isclose(q[-1, 3], q[-2, 3])
    assert abs(c.edge_lengths.sum() - c.length) < 1e-9 and c.length > np.hypot(*np.diff(p, axis=0).T).sum()


def test_cubics_and_circles():
    t = np.array([0.0, 0.1, 0.35, 0.6, 1.0])
    m = S.curvatures(t, t**3 - 2 * t**2 + 1)
    assert np.allclose(m, 6 * t - 4)
    c = S.spline([(math.cos(k), math.sin(k)) for k in np.arange(12) * math.pi / 6], True)
    assert abs(c.length - 2 * math.pi) < 2e-3 and np.abs(np.hypot(*c.samples.T) - 1).max() < 2e-3
    line = S.spline([(float(k), 2.0 * k) for k in range(5)])
    assert abs(line.length - math.hypot(4, 8)) < 1e-9 and np.allclose(line.samples[:, 1], 2 * line.samples[:, 0])
    for bad in (NODES[:3], [*NODES, NODES[-1]]):
        with pytest.raises(ValueError):
            S.spline(bad)


@pytest.mark.parametrize("shut", [False, True])
def test_places_on_the_curve(spark, shut):
    c = S.spline(NODES, shut)
    r = np.random.default_rng(2)
    xy = [*r.uniform(-20, 130, (40, 2)).tolist(), [20.0, 40.0], [0.0, 0.0]]
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(xy)], "id long, x double, y double")
    for row in S.to_spline(df, c).collect():
        p, a, b = np.array([row["x"], row["y"]]), c.samples[:-1], np.diff(c.samples, axis=0)
        s = np.clip(((p - a) * b).sum(axis=1) / (b * b).sum(axis=1), 0, 1)
        near = a + s[:, None] * b
        d = np.hypot(*(p - near).T)
        k = int(np.argmin(np.round(d, 12)))
        got = row["path"]
        assert abs(got["ad"] - d[k]) < 1e-9 and got["edge"] == k // S.FINE and np.allclose([got["px"], got["py"]], near[k]) and abs(got["along"] - c.along[k] - s[k] * np.hypot(*b[k])) < 1e-9
        assert abs(abs(got["d"]) - got["ad"]) < 1e-9
    places = [0.0, *r.uniform(0, c.length, 30).tolist(), c.length, -1.0, c.length + 1]
    df = spark.createDataFrame([(k, a, 3.0 if k % 2 else None) for k, a in enumerate(places)], "id long, along double, off double")
    for row in S.from_spline(df, c, off="off").collect():
        if not 0 <= row["along"] <= c.length:
            assert row["point"] is None
            continue
        u = np.interp(row["along"], c.along, c.at)
        x, y = (np.interp(row["along"], c.along, c.samples[:, j]) for j in (0, 1))
        dx, dy = c.point(np.array([u]), 1)[0]
        t, off = math.atan2(dy, dx), row["off"] or 0.0
        got = row["point"]
        assert np.allclose([got["x"], got["y"]], [x - off * math.sin(t), y + off * math.cos(t)], atol=1e-8) and abs(math.sin(got["tangent"] - t)) < 1e-9
    back = S.to_spline(S.from_spline(df.filter(F.col("along").between(0, c.length)).drop("off"), c).select("along", "point.x", "point.y"), c).collect()
    assert all(abs(b["path"]["along"] - b["along"]) < 1e-6 or shut for b in back)
    assert np.allclose(S.spline_box(c), [*c.samples.min(axis=0), *c.samples.max(axis=0)])
