"""Merging and inverting in stretches against a plain loop, with plans that don't gather a set in one task."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import joins as J
from tempora.operators import segments as S
from tempora.plans import segments as P

SCHEMA = "set_id string, start double, stop double"
INF = float("inf")


def merged(segs, strict=True, gap=0.0):
    out = []
    for a, b in sorted(segs):
        apart = not out or (a > out[-1][1] + gap if strict or gap else a >= out[-1][1])
        if apart:
            out.append([a, b])
        else:
            out[-1][1] = max(out[-1][1], b)
    return [tuple(x) for x in out]


def some(seed):
    r, rows = random.Random(seed), []
    for s in ("a", "b", None):
        for _ in range(120):
            a = float(r.randrange(0, 400))
            rows.append((s, a, a + r.choice([0, 0, 1, 2, 5, 40 if r.random() < 0.2 else 3])))
        rows += rows[-5:]
    rows += [("c", -INF, 3.0), ("c", 2.0, 8.0), ("c", 20.0, INF), ("d", -INF, INF), ("e", 5.0, 5.0), ("e", 5.0, 9.0), ("e", 9.0, 9.0), ("f", 0.0, 300.0), *[("f", float(k), k + 0.5) for k in range(0, 290, 7)]]
    return rows


def by_set(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["set_id"], []).append((r["start"], r["stop"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("more", [{}, {"chunk": 1.0}, {"chunk": 37.0}, {"chunk": 1e6}, {"cuts": [3.0, 5.0, 5.5, 100.0, 250.0]}])
def test_merging_in_stretches(spark, seed, more):
    rows = some(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sets = {s: [x[1:] for x in rows if x[0] == s] for s in {x[0] for x in rows}}
    for how in ({}, {"strict": False}, {"gap": 4.0}):
        assert by_set(S.remove_overlap(df, **how, **more)) == {s: sorted(merged(v, **how)) for s, v in sets.items()}


@pytest.mark.parametrize("chunk", [None, 1.0, 50.0])
def test_inverting_in_stretches(spark, chunk):
    rows = some(3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for s in {x[0] for x in rows}:
        m = merged([x[1:] for x in rows if x[0] == s])
        ends = [-INF, *[e for x in m for e in x], INF]
        gaps = [(a, b) for a, b in zip(ends[::2], ends[1::2], strict=True) if b != -INF and a != INF]
        want |= {s: gaps} if gaps else {}
    assert by_set(S.invert(df, chunk)) == want and S.invert(df.limit(0), chunk).count() == 0


def windows_of(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Window [" in line]


def test_no_window_gathers_a_set(spark):
    """The one window by set has a row a stretch; all others are by set and stretch."""
    d = "/root/testdata/sf0.001"
    for name in ("seg_union", "seg_invert"):
        for line in windows_of(P.QUERIES[name](spark, d)):
            by_stretch, carried = "_c" in line.split("windowspecdefinition(")[1].split("ASC")[0], "_reach" in line or "_held" in line or "_carry" in line or "_stop" in line
            assert by_stretch or carried, line


def test_a_set_of_disjoint_segments_uses_all_tasks(spark):
    many = spark.range(100_000).select(F.lit("x").alias("set_id"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 1).alias("stop"))
    got = S.remove_overlap(many)
    assert got.count() == 100_000 and got.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] == 100_000
    parts = S._stretched(many, None).groupBy("_c").count().collect()
    assert len(parts) >= J.STRETCHES and max(p["count"] for p in parts) < 500
    crowded = many.withColumn("start", F.when(F.col("start") == 0, -1e12).otherwise(F.col("start")))  # even stretches would hold nearly all in one
    at = J.cuts(crowded, "start", 16)
    sizes = J.stretches(crowded, "start", at=at).groupBy("_c").count().collect()
    assert len(sizes) == 16 and max(p["count"] for p in sizes) < 8000
    assert S.remove_overlap(crowded, cuts=at).count() == 100_000 and S.remove_overlap(many, cuts=at).count() == 100_000


def test_points_are_listed_on_levels_that_have_segments(spark):
    points = spark.range(1000).select(F.col("id").cast("double").alias("t"), F.lit("own").alias("start"), F.lit("end").alias("stop"))
    segs = spark.createDataFrame([(5.0, 9.0), (8.0, 20.0), (500.0, 500.0), (900.0, INF), (30.0, 700.0)], "start double, stop double")
    got = S.contains(points, segs, 4.0)
    assert got.columns == ["t", "start", "stop"] and sorted(r["t"] for r in got.collect()) == [float(k) for k in range(1000) if 5 <= k < 20 or 30 <= k < 700 or k >= 900]
    assert S.contains(points, segs.limit(0), 4.0).count() == 0
    only = J.range_join(points.select("t"), segs.limit(1), 4.0)
    assert "_used" in only._jdf.queryExecution().optimizedPlan().toString() and only.count() == 4
