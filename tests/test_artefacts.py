"""Artefacts filled by reflection against a plain loop."""

import math

import numpy as np

from tempora.operators import signals as G


def plain(v, bad, fill):
    out, k = list(v), 0
    while k < len(v):
        if not bad[k]:
            k += 1
            continue
        b = k
        while b + 1 < len(v) and bad[b + 1]:
            b += 1
        n = b - k + 1
        for j in range(n):
            w = (j + 1) / (n + 1)
            out[k + j] = fill if k < n or b >= len(v) - n else (2 * v[k] - v[k - 1 - j]) * (1 - w) + (2 * v[b] - v[b + n - j]) * w
        k = b + 1
    return out


def test_reflection(spark):
    r = np.random.default_rng(1)
    data = {"a": r.normal(size=60), "b": np.arange(40.0)}
    signal = spark.createDataFrame([(c, k, float(k), float(x)) for c, v in data.items() for k, x in enumerate(v)], "channel string, i long, t double, v double").repartition(4)
    times = [1.0, 10.0, 13.0, 25.0, 38.0]
    artefacts = spark.createDataFrame([(t,) for t in times], "t double")
    for fill in (None, -5.0):
        got = G.remove_artefacts(signal, artefacts, 1.0, 2.0, 3.0, fill, True).collect()
        for c, v in data.items():
            bad = [any(t - 1 <= k < t + 2 for t in times) for k in range(len(v))]
            want = plain(v, bad, math.nan if fill is None else fill)
            mine = [x["v"] for x in sorted((x for x in got if x["channel"] == c), key=lambda x: x["i"])]
            assert np.allclose(mine, want, equal_nan=True) and len(mine) == len(v)
    # the end of a window is not in it
    line = G.remove_artefacts(signal, artefacts, 1.0, 2.0, 3.0, 0.0).filter("channel = 'b' AND i IN (26, 27)").orderBy("i").collect()
    assert [x["v"] for x in line] == [0.0, 27.0]
