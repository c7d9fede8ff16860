"""As-of joins without keys against a search: ties, ends beyond the other side, infinite and missing times, empty sides."""

import math
import random

import pytest

from tempora.operators import joins as J


def search(left, right, backward, strict):
    out = []
    for t in left:
        if t is None:
            out.append(None)
            continue
        fits = [r for r in right if r[0] is not None and ((r[0] < t or (r[0] == t and not strict)) if backward else (r[0] > t or (r[0] == t and not strict)))]
        out.append((max if backward else min)(x[0] for x in fits) if fits else None)
    return out


@pytest.mark.parametrize("backward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_without_keys(spark, backward, strict):
    r = random.Random(3)
    right = [(float(r.randrange(200, 700)), k) for k in range(150)] + [(r_, -1) for r_ in (250.5, 250.5)]
    left = [float(r.randrange(0, 1000)) for _ in range(300)] + [None, math.inf, -math.inf, 200.0, 699.0]
    for a, b in ((left, right), (left, []), ([], right), (left, [(400.0, 1)]), (left, [*right, (math.inf, 5), (-math.inf, 6), (None, 7)])):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(a)], "id long, t double").repartition(4)
        other = spark.createDataFrame(b, "t double, v long").repartition(3)
        got = {x["id"]: x["_asof"] for x in J.asof(df, other, ["v"], backward=backward, strict=strict).collect()}
        want = search(a, b, backward, strict)
        assert [None if got[k] is None else got[k]["t"] for k in range(len(a))] == want
        held = {(t, v) for t, v in b}
        assert all(x is None or (x["t"], x["v"]) in held for x in got.values()) and len(got) == len(a)


def test_the_left_side_is_scanned_once(spark):
    df = spark.range(100).selectExpr("double(id * 3) AS t", "id * 7 AS left_value")
    plan = J.interpolate(df, spark.range(40).selectExpr("double(id * 5) AS t", "double(id) AS v"), "v")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (0, 100,") == 1
    got = {x["t"]: x["v"] for x in plan.collect() if x["t"] <= 195}
    assert len(got) == 66 and all(abs(v - t / 5) < 1e-12 for t, v in got.items())
