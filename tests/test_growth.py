"""Steps whose cost once grew faster than their input: equal results by brute force, and plans that don't hold a whole group or all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import alignment, circular
from tempora.operators import decoding as C
from tempora.operators import density as D
from tempora.operators import joins, segments
from tempora.operators import spectral as Q


def test_kernel_sums_by_tiles(monkeypatch):
    monkeypatch.setattr(C, "TILE", (3, 5))
    r = np.random.default_rng(2)
    x, mean, centre = r.normal(0, 0.4, (17, 2)), r.normal(0, 0.4, (23, 2)), r.normal(0, 12, 23)
    var, spread, weight, grid = r.uniform(0.005, 0.02, (23, 2)), r.uniform(20, 90, 23), r.random(23), np.arange(-50.0, 51, 10)
    x[3, 1], mean[4, 0] = np.nan, np.nan
    got = C.kernel_sums(x, mean, var, weight, centre, spread, grid)
    want = np.zeros((17, len(grid)))
    for i in range(17):
        for j in range(23):
            for g, at in enumerate(grid):
                q = ((x[i] - mean[j]) ** 2 / var[j]).sum() + (at - centre[j]) ** 2 / spread[j]
                if q <= 16:
                    want[i, g] += weight[j] * math.exp(-q / 2) / math.sqrt((2 * math.pi) ** 3 * var[j].prod() * spread[j])
    assert np.allclose(got, want, atol=1e-12) and (want > 0).any() and (got[3] == 0).all()


def test_spike_grid_has_no_row_a_pair(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)  # several parts of spikes and of components
    r = np.random.default_rng(3)
    rows = [("a" if k % 3 else "b", k // 7, k, [*r.normal(0, 0.1, 2).tolist(), float(r.normal(0, 12))]) for k in range(150)] + [("c", 1, 900, [9.0, 9.0, 9.0])]
    spikes = spark.createDataFrame(rows, "source string, bin long, id long, x array<double>")
    comps = D.samples_to_components(spikes.filter("source <> 'c'"), [0.01, 0.01, 72.25], [0, 1, 2])
    df = C.spike_grid(spikes, comps, [-5.0, 5.0], [0, 1], 2, 0.8)
    assert "_bucket" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {x["id"]: x["pax"] for x in df.collect()}
    assert sorted(got) == sorted(x[2] for x in rows) and got[900] == [0.0, 0.0]
    for s, _, i, x in rows[:150]:
        own = np.array([y[3] for y in rows if y[0] == s])
        for g, at in enumerate((-5.0, 5.0)):
            q = ((own[:, :2] - x[:2]) ** 2 / 0.01).sum(axis=1) + (at - own[:, 2]) ** 2 / 72.25
            want = np.exp(-q[q <= 16] / 2).sum() / len(own) / math.sqrt((2 * math.pi) ** 3 * 0.0001 * 72.25)
            assert math.isclose(got[i][g], want, rel_tol=1e-9)


def test_equal_spikes_and_components_are_worked_out_once(spark):
    r = np.random.default_rng(11)
    rows = [("ab"[k % 2], k // 7, k, [*r.normal(0, 0.1, 2).tolist(), float(r.normal(0, 12))]) for k in range(40)]
    once = spark.createDataFrame([*rows, ("a", 90, 900, [math.nan, 0.0, 0.0]), ("b", 90, 901, [None, 0.0, 0.0])], "source string, bin long, id long, x array<double>")
    comps = D.samples_to_components(spark.createDataFrame(rows, once.schema), [0.01, 0.01, 72.25], [0, 1, 2])
    copies = lambda df, c: df.crossJoin(spark.range(6).withColumnRenamed("id", "_c")).withColumn(c, F.col(c) + 1000 * F.col("_c")).drop("_c")
    grid = lambda a, b: C.spike_grid(a, b, [-5.0, 5.0], [0, 1], 2)
    df = grid(copies(once, "id"), copies(comps, "comp_id").withColumn("weight", F.col("weight") / 6))
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "CoGroup" in line)
    depth = plan[at].find("FlatMapCoGroups")
    below = [line for line in plan[at + 1 :] if len(line) - len(line.lstrip(" :+-")) > depth]
    assert any("Aggregate [source#" in line and "x0#" in line for line in below) and any("Aggregate [_s#" in line and "m0#" in line for line in below)
    want = {x["id"]: x["pax"] for x in grid(once, comps).collect()}
    got = {x["id"]: x["pax"] for x in df.collect()}
    assert len(got) == 6 * len(want) == 252 and want[900] == want[901] == [0.0, 0.0] and max(want[0]) > 0
    assert all(np.allclose(v, want[i % 1000], rtol=1e-12, atol=0) for i, v in got.items())


def test_kernel_masks_only_what_a_tile_reaches_in_part(monkeypatch):
    r = np.random.default_rng(12)
    x, mean, centre = r.normal(0, 0.1, (900, 2)), r.normal(0, 0.1, (3000, 2)), r.normal(0, 12, 3000)
    grid, masked, own = np.arange(-50.0, 51, 5), [], np.less_equal
    monkeypatch.setattr(C, "TILE", (16, 32))
    monkeypatch.setattr(C.np, "less_equal", lambda q, left, out: masked.append(q.size) or own(q, left, out=out))
    got = C.kernel_sums(x, mean, np.full((3000, 2), 0.01), np.ones(3000), centre, np.full(3000, 72.25), grid)
    monkeypatch.undo()
    q = ((x[:50, None] - mean) ** 2 / 0.01).sum(axis=2)[:, None] + ((grid[:, None] - centre) ** 2 / 72.25)
    assert np.allclose(got[:50], np.where(q <= 16, np.exp(-q / 2), 0).sum(axis=2) / math.sqrt((2 * math.pi) ** 3 * 0.0001 * 72.25), rtol=1e-12)
    assert 0 < sum(masked) < 0.6 * len(x) * (((grid[:, None] - centre) ** 2 / 72.25) <= 16).sum()  # a mask for each grid point within reach before


def test_resamples_are_held_few_at_a_time(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in (("a", 300), ("b", 7)) for v in r.normal(size=n)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wide = {x["k"]: (x["low"], x["high"]) for x in Q.bootstrap_interval(df, "k", "v", samples=200).collect()}
    assert sorted(wide) == ["a", "b"]
    for k, got in wide.items():  # drawn 64 at a time, as ever
        x, rng = np.sort([v for s, v in rows if s == k and v is not None]), np.random.default_rng(0)
        means = np.concatenate([x[rng.integers(0, len(x), (min(64, 200 - i), len(x)))].mean(axis=1) for i in range(0, 200, 64)])
        assert got == tuple(np.quantile(means, [0.025, 0.975]))
    most = []

    def mean(x, axis):
        most.append(x.size)
        return x.mean(axis=axis)

    monkeypatch.setattr(Q, "DRAWN", 1000)
    run = Q.resampled(np.arange(300.0), mean, 200, 0)
    monkeypatch.setattr(Q, "DRAWN", 1 << 23)
    assert max(most) <= 1000 and np.array_equal(run, Q.resampled(np.arange(300.0), mean, 200, 0))


def test_quantiles_of_intervals_are_worked_out_once(monkeypatch):
    Q.student_quantile.cache_clear()
    calls = []
    monkeypatch.setattr(Q, "student_cdf", lambda t, n, own=Q.student_cdf: calls.append(t) or own(t, n))
    s = np.random.default_rng(5).normal(size=(5, 9)) + 1j
    first = Q.spectrum_interval((np.abs(s) ** 2).mean(axis=0), s, kind="jackknife")
    once = len(calls)
    again = Q.spectrum_interval((np.abs(s) ** 2).mean(axis=0), s, kind="jackknife")
    assert once == len(calls) > 0 and np.array_equal(first, again)


def test_pairs_of_equal_segments_are_listed_last(spark, monkeypatch):
    monkeypatch.setattr(segments, "ALIKE", 4)  # several rows of equal segments
    inf = math.inf
    a = [(k, float(k % 7), float(k % 7) + 1.5) for k in range(80)] + [(None, 2.0, 3.5), (90, -inf, inf), (91, None, 4.0), (92, 3.0, math.nan), (93, 0.0, 0.0), (94, -0.0, 0.0)]
    b = [(k, float(k % 5), float(k % 5) + 0.7) for k in range(60)] + [(7, 0.0, 0.7), (90, 1.0, inf), (91, -1.0, 900.0)]
    of = lambda rows: spark.createDataFrame(rows, "seg_id long, start double, stop double")
    df = segments.overlap_pairs(of(a), of(b), 2.0, 5)
    key = lambda x: str(tuple(x))
    want = []
    for i, s, t in a:
        for j, u, v in b:
            if s is not None and not math.isnan(t) and s < v and u < t:
                o = min(t, v) - max(s, u)
                share = lambda n: None if n == 0 else math.nan if o == n == inf else o / n
                want.append((i, j, *(None if x is None else x if math.isnan(x) else round(x, 5) for x in (o, share(t - s), share(v - u)))))
    assert sorted(map(key, df.collect())) == sorted(map(key, want))
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(i for i, line in enumerate(plan) if "Join Inner" in line and "_ea" in line)
    assert sum("Generate explode(ids_" in line for line in plan[:joined]) == 2


def test_short_segments_meet_on_their_own_level_only(spark):
    a = spark.createDataFrame([(k, float(k % 97), float(k % 97) + 1.5) for k in range(300)], "seg_id long, start double, stop double")
    df = joins.interval_join(a, a, 2.0)
    rows = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftSemi" in x]
    assert len(rows) == 2 and df.count() == sum(x % 97 < y % 97 + 1.5 and y % 97 < x % 97 + 1.5 for x in range(300) for y in range(300))


@pytest.mark.parametrize("backward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_with_keys_is_cut_into_stretches(spark, backward, strict):
    r = np.random.default_rng(6)
    inf = math.inf
    left = [(i, "abc"[i % 3] if i % 10 else None, float(t)) for i, t in enumerate(r.integers(0, 400, 150))] + [(200, "a", inf), (201, "b", -inf), (202, "d", 5.0), (203, "a", None)]
    right = [("ab"[k % 2] if k % 9 else None, float(t), k) for k, t in enumerate(r.choice(np.arange(90, 380), 60, replace=False))] + [("a", -inf, 900), ("b", inf, 901)]
    got = joins.asof(spark.createDataFrame(left, "id long, k string, t double"), spark.createDataFrame(right, "k string, t double, v long"), ["v"], ("k",), backward=backward, strict=strict)
    fits = {(True, True): lambda x, t: x < t, (True, False): lambda x, t: x <= t, (False, True): lambda x, t: x > t, (False, False): lambda x, t: x >= t}[backward, strict]
    rows = got.collect()
    assert sorted(x["id"] for x in rows) == sorted(x[0] for x in left)
    for x in rows:
        near = [(t, v) for k, t, v in right if k == x["k"] and x["t"] is not None and fits(t, x["t"])]
        assert (tuple(x["_asof"]) if x["_asof"] else None) == (max if backward else min)(near, default=None)
    own = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "_t#" in x.split("windowspecdefinition", 1)[1]]
    assert own and all("_c#" in x.split("windowspecdefinition", 1)[1] for x in own)


def test_uniformized_ranks_come_by_stretches(spark):
    r = np.random.default_rng(7)
    people = [("x", float(v)) for v in r.choice(np.round(r.uniform(0, 6.28, 60), 3), 200)] + [("y", 1.0)]
    df = spark.createDataFrame(people, "k string, theta double")
    got = circular.uniformize(df, df.distinct(), "k")
    mine = [v for k, v in people if k == "x"]
    for x in got.collect():
        of = mine if x["k"] == "x" else [1.0]
        want = (sum(v < x["theta"] for v in of) + 1 + (sum(v == x["theta"] for v in of) - 1) / 2) * 2 * math.pi / len(of)
        assert math.isclose(x["uniform"], want, rel_tol=1e-12)
    assert "rank(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_of_segments_without_their_pairs(spark):
    r = np.random.default_rng(8)
    points = [(float(t), None if t % 13 == 0 else float(v)) for t, v in zip(r.integers(0, 4000, 700), r.integers(0, 40, 700), strict=True)]
    segs = [(k, float(a), float(a + n)) for k, (a, n) in enumerate(zip(r.integers(-50, 4000, 200), r.choice([0, 1, 7, 60, 900, 3000, 20000], 200), strict=True))] + [(999, -math.inf, math.inf), (1000, 9e6, 9e6 + 5)]
    df = segments.apply_quantile(spark.createDataFrame(points, "t double, v double"), spark.createDataFrame(segs, "seg_id long, start double, stop double"), 5.0, "v", 0.75)
    rows = df.collect()
    assert len(rows) == len(segs)
    for x in rows:
        own = [v for t, v in points if v is not None and x["start"] <= t < x["stop"]]
        assert x["q"] is None if not own else math.isclose(x["q"], np.quantile(own, 0.75), rel_tol=1e-12)
    sent = segments.apply_quantile(spark.createDataFrame(points, "t double, v double"), spark.range(50).selectExpr("id AS seg_id", "0.5D AS start", "5.5D AS stop"), 5.0, "v", 0.75)
    assert "CoGroup" in sent._jdf.queryExecution().optimizedPlan().toString() and sent.count() == 50


def test_order_in_ranges():
    r = np.random.default_rng(9)
    v = r.integers(0, 9, 50).astype(float)
    first = r.integers(0, 49, 300)
    last = first + 1 + (r.random(300) * (50 - first)).astype(int).clip(0, 49 - first)
    k = (r.random(300) * (last - first)).astype(int)
    assert segments.order_in_ranges(v, first, last, k).tolist() == [np.sort(v[a:b])[i] for a, b, i in zip(first, last, k, strict=True)]
    assert segments.order_in_ranges(np.array([3.0]), np.array([0]), np.array([1]), np.array([0])).tolist() == [3.0]


def test_correlation_sends_blocks_to_few_stretches(spark, monkeypatch):
    r = np.random.default_rng(10)
    x, y = r.normal(size=230), r.normal(size=200)
    df = lambda v: spark.createDataFrame([(i, float(z)) for i, z in enumerate(v)], "i long, v double")
    want = {k: float(sum(x[i + k] * y[i] for i in range(200) if 0 <= i + k < 230)) for k in range(-199, 230)}
    for most, few in ((1 << 21, 3), (16, 8)):
        monkeypatch.setattr(alignment, "LONGEST", most)
        monkeypatch.setattr(alignment, "STRETCHES", few)
        got = {c["lag"]: c["c"] for c in alignment.correlate(df(x), df(y), 4).collect()}
        assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items()) and all(abs(c) < 1e-9 for k, c in got.items() if k not in want)
        some = {c["lag"]: c["c"] for c in alignment.correlate(df(x), df(y), 4, (-30, 21)).collect()}
        assert sorted(some) == list(range(-30, 22)) and all(math.isclose(some[k], want[k], abs_tol=1e-9) for k in some)


def test_unmerged_samples_need_no_group(spark):
    r = np.random.default_rng(11)
    rows = [("ab"[k % 2], int(k), r.normal(size=3).tolist()) for k in r.permutation(60)]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(s, i if kind == "long" else f"{i:03}", x) for s, i, x in rows], f"source string, id {kind}, x array<double>")
        got = D.merge_samples(df, [1.0, 2.0], [0, 2], 0.0, "full")
        assert "MapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
        for s in "ab":
            own = sorted((i, x) for k, i, x in rows if k == s)
            mine = sorted((x for x in got.collect() if x["source"] == s), key=lambda x: x["comp_id"])
            assert [x["comp_id"] for x in mine] == list(range(30)) and [x["mean"] for x in mine] == [[x[0], x[2]] for _, x in own]
            assert all(x["weight"] == 1 / 30 and x["var"] == [1.0, 2.0] and x["cov"] == [[1.0, 0.0], [0.0, 2.0]] for x in mine)
