"""op13 against exact sums in Python and numpy's covariance of the distinct vectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tempora.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int, x int, label int"


def rows_of(vectors):
    return [(i, v, "clash", 1, 2, 3) for i, v in vectors]


def plain(vectors, k=16):
    """{row number: (vec_id, deviation, whitened)}, explained shares; the fit over distinct vectors of integers."""
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(t) for t in sorted({tuple(x) for _, x in xs})]
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda x: np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, total, strict=True)])
    z = np.array([centre(x) for x in fit])
    e, axes = np.linalg.eigh(z.T @ z / n)
    best = np.argsort(-e)[:k]
    best = best[e[best] > 1e-9 * e.max()]
    rows = [(i, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)), centre(x) @ axes[:, best] / np.sqrt(e[best])) for i, x in xs]
    return n, rows, e[best] / e.sum()


def check(got, vectors, k=16):
    n, rows, shares = plain(vectors, k)
    assert len(got) == len(rows) * len(shares) and all(r["n"] == n and r["identity_error"] < 1e-6 for r in got)
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append((str(r["vec_id"]), r["deviation"], r["whitened"], r["explained"]))
    assert sorted(by_component) == list(range(1, len(shares) + 1))
    for c, mine in by_component.items():
        want = sorted((str(i), d, w[c - 1]) for i, d, w in rows)
        mine.sort()
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        a, b = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
        pairs = [sorted(map(round_, s * a)) == sorted(map(round_, b)) or np.abs(np.sort(s * a) - np.sort(b)).max() < 1e-6 for s in (1, -1)]
        assert any(pairs) and np.abs([m[3] for m in mine] - shares[c - 1]).max() < 1e-9


def round_(x):
    return round(x, 6)


def sample(seed, n=300, dims=40):
    r = np.random.default_rng(seed)
    scale = np.linspace(2, 0.1, dims)
    rows = [(int(k), [float(c) for c in r.normal(size=dims) * scale]) for k in range(n)]
    rows += [(1000 + k, rows[5][1]) for k in range(n // 2)]  # a third of all rows alike
    rows += [(None, rows[7][1]), (4, rows[9][1]), (4, rows[9][1]), (9000, None)]
    rows += [(9001, [math.nan] * dims), (9002, [math.inf] + [0.0] * (dims - 1)), (9003, [None] + [0.0] * (dims - 1))]
    return rows


@pytest.mark.parametrize(("seed", "dims"), [(1, 40), (2, 5)])
def test_query_equals_exact_sums(spark, tables, seed, dims):
    vectors = sample(seed, dims=dims)
    d = tables("embeddings", rows_of(vectors), SCHEMA)
    out = whitening.op13_whitening(spark, d)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), vectors)


def test_tiles_row_blocks_and_strips(spark):
    r = np.random.default_rng(5)
    z = r.normal(size=(500, 23)) @ r.normal(size=(23, 23))
    rows = spark.createDataFrame([(x.tolist(),) for x in z], "z array<double>").repartition(3)
    for tile, block, strip in ((32, 2048, 1 << 23), (5, 7, 1 << 23), (5, 7, 1), (23, 100, 50), (1, 64, 60)):
        assert np.allclose(whitening.covariance(rows, 23, 500, tile, block, strip), z.T @ z / 500, rtol=1e-12, atol=1e-10)


def test_what_has_no_variance(spark):
    one = spark.createDataFrame(rows_of([(k, [1.0, 2.0, 3.0]) for k in range(5)]), SCHEMA)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    flat = [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)] + [(99, [1.0])] + [(98, [])]
    got = whitening.whiten(spark.createDataFrame(rows_of(flat), SCHEMA)).collect()
    assert len(got) == 9 and {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert set(whitening.whiten(one).columns) == {"vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_deviations_beyond_a_long(spark):
    r = random.Random(6)
    vectors = [(k, [r.uniform(-1e8, 1e8), r.uniform(-1, 1)]) for k in range(50)] + [(50, [3e38, 0.0])]
    got = {x["vec_id"]: x["deviation"] for x in whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA)).collect()}
    xs = {i: [math.floor(min(64 * float(np.float32(c)), 2.0**40)) + 1_000_000 for c in v] for i, v in vectors}
    n, total = len(xs), [sum(c) for c in zip(*xs.values(), strict=True)]
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for i, x in xs.items()}
    assert got == {i: w if w < 1 << 63 else None for i, w in want.items()} and got[50] is None
