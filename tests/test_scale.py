"""Joins and windows over segments of any length, infinite ones included, against brute force; and that no window holds a whole table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import joins, segments

INF = math.inf


def segs(spark, rows, name="s"):
    return spark.createDataFrame([(name, i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "set_id string, seg_id long, start double, stop double").repartition(3)


def any_length(r, n):
    out = []
    for _ in range(n):
        a = r.uniform(0, 1000)
        out.append((a, a + r.choice([0, 0.5, 3, 40, 300, 5000, 1e6, 1e12])))
    return [*out, (-INF, 20.0), (990.0, INF), (-INF, INF), (500.0, 500.0), (-1e9, 3.0)]


@pytest.mark.parametrize("closed", [False, True])
def test_interval_join(spark, closed):
    r = random.Random(3)
    a, b = any_length(r, 60), any_length(r, 60)
    b += a[:5]
    got = joins.interval_join(segs(spark, a), segs(spark, b), 5.0, closed=closed).select("seg_id_a", "seg_id_b").collect()
    over = (lambda x, y: x[0] <= y[1] and y[0] <= x[1]) if closed else (lambda x, y: x[0] < y[1] and y[0] < x[1])
    assert sorted(map(tuple, got)) == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if over(x, y)]


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_range_join(spark, how):
    r = random.Random(4)
    s = any_length(r, 40)[:-3]
    points = [float(r.randrange(-50, 1100)) for _ in range(80)]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "id long, t double")
    got = joins.range_join(p, segs(spark, s).select("seg_id", "start", "stop"), 5.0, how=how).collect()
    pairs = [(i, j) for i, x in enumerate(points) for j, (a, b) in enumerate(s) if a <= x < b]
    hit = {i for i, _ in pairs}
    want = {"inner": pairs, "left_semi": [(i,) for i in hit], "left_anti": [(i,) for i in range(80) if i not in hit], "left": pairs + [(i, None) for i in range(80) if i not in hit]}[how]
    assert sorted((tuple(x[c] for c in ("id", "seg_id") if c in x) for x in got), key=str) == sorted(want, key=str)


def brute_merge(rows, touch=True, gap=0.0):
    out = []
    for a, b in sorted(rows):
        if out and (a <= out[-1][1] + gap if touch or gap else a < out[-1][1]):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pairs_of(df):
    return sorted((r["start"], r["stop"]) for r in df.collect())


@pytest.mark.parametrize("strict,gap", [(True, 0.0), (False, 0.0), (True, 4.0)])
def test_chunks_merge_alike(spark, strict, gap):
    r = random.Random(5)
    rows = [(a, a + r.choice([0.5, 2, 9, 120])) for a in (float(r.randrange(3000)) for _ in range(300))] + [(-INF, -10.0), (2995.0, INF)]
    want = brute_merge(rows, strict, gap)
    for chunk in (None, 7.0, 100.0, 1e9):
        assert pairs_of(segments.remove_overlap(segs(spark, rows), strict, gap, chunk)) == want


def test_algebra_of_inverted_sets(spark):
    a, b = [(0, 10), (20, 30), (50, 100)], [(4, 6), (15, 25), (40, 200)]
    x, y = segs(spark, a, "a"), segs(spark, b, "b")
    for chunk in (None, 8.0):
        assert pairs_of(segments.invert(x, chunk)) == [(-INF, 0), (10, 20), (30, 50), (100, INF)]
    assert pairs_of(segments.intersection(segments.invert(x), segments.invert(y), 10.0)) == [(-INF, 0), (10, 15), (30, 40), (200, INF)]
    assert pairs_of(segments.exclusive(segments.invert(x), [y], 10.0)) == [(-INF, 0), (10, 15), (30, 40), (200, INF)]
    assert pairs_of(segments.difference([segments.invert(x), y], 10.0)) == [(-INF, 0), (4, 6), (10, 15), (20, 25), (30, 40), (50, 100), (200, INF)]
    found = segments.overlap_pairs(segments.invert(x).withColumn("seg_id", F.lit(0)), y, 10.0)
    assert found.count() == 3


@pytest.mark.parametrize("backward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_without_keys(spark, backward, strict):
    r = random.Random(6)
    left = [(i, float(r.randrange(400))) for i in range(120)]
    right = [(float(t), k) for k, t in enumerate(r.sample(range(100, 380), 40))]
    got = joins.asof(spark.createDataFrame(left, "id long, t double"), spark.createDataFrame(right, "t double, k long"), ["k"], backward=backward, strict=strict)
    fits = {(True, True): lambda x, t: x < t, (True, False): lambda x, t: x <= t, (False, True): lambda x, t: x > t, (False, False): lambda x, t: x >= t}[backward, strict]
    for row in got.collect():
        near = [x for x in right if fits(x[0], row["t"])]
        want = (max if backward else min)(near, default=None)
        assert (tuple(row["_asof"]) if row["_asof"] else None) == want
    assert got.count() == 120
    assert joins.asof(spark.createDataFrame(left[:0], "id long, t double"), spark.createDataFrame(right, "t double, k long"), ["k"]).count() == 0


def test_cover_count_without_keys(spark):
    r = random.Random(7)
    s = [(a, a + r.choice([1, 30, 500])) for a in (float(r.randrange(1000)) for _ in range(90))]
    p = [(float(r.randrange(-5, 1600)),) for _ in range(100)]
    got = segments.cover_count(spark.createDataFrame(p, "t double"), segs(spark, s)).collect()
    assert sorted((x["t"], x["n"]) for x in got) == sorted((t, sum(a <= t < b for a, b in s)) for (t,) in p)


def windows_of_rows(df):
    """Window nodes of the plan without a partition, over anything but rows of chunks."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "Window [" in x and "_carry" not in x and "windowspecdefinition(_t#" in x.replace("windowspecdefinition(_c#", "")]


def test_no_window_holds_a_whole_table(spark):
    p = spark.createDataFrame([(1, 2.0)], "id long, t double")
    s = segs(spark, [(0, 1)])
    assert windows_of_rows(joins.asof(p, p, ["id"])) == [] and windows_of_rows(segments.cover_count(p, s)) == []
