"""Streams against batches, numeric routines against identities, record files against their bytes."""

import datetime
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import scalar as X
from tempora.operators import circular as C
from tempora.operators import density as D
from tempora.operators import events as E
from tempora.operators import geometry as G
from tempora.operators import signals as S
from tempora.operators import spectral as Q
from tempora.plans import circular as P_CIRCULAR
from tempora.plans import decoding as V
from tempora.plans import signals as P_SIGNALS
from tempora.sources import records as R
from tempora.sources import tables as T
from tempora.streaming import online as O


def test_windowed_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:{m}0:00", "x", 1.0) for h in range(5) for m in range(6)], "ts string, train string, mark double").select(F.to_timestamp("ts").alias("ts"), "train", "mark").coalesce(1)
    got = O.replay(rows, str(tmp_path), O.windowed_rates).collect()
    assert got and all(r["n"] == 6 for r in got)


def test_spectra():
    t = Q.tapers(64)
    assert np.allclose(t @ t.T, np.eye(len(t)), atol=1e-9)
    x = np.sin(2 * np.pi * 0.1 * np.arange(512))
    f, s = Q.tapered_fft(x, 1.0)
    assert abs(f[np.argmax((np.abs(s) ** 2).mean(axis=0))] - 0.1) < 0.01
    low = Q.filter_both(x + np.sin(2 * np.pi * 0.4 * np.arange(512)), Q.kaiser_filter(None, 0.2, 1.0))
    assert np.abs(low[50:-50] - x[50:-50]).max() < 0.02
    assert np.allclose(np.abs(Q.analytic(x))[100:400], 1, atol=0.1)


def test_median_and_geometry(spark):
    df = spark.createDataFrame([("a", v) for v in (0.1, 0.2, 6.2, 0.15)], "k string, theta double")
    assert abs(C.median(df, "k").first()["median"] - 0.1) < 1e-9
    assert G.shortest_path(np.array([[0, 1, 5], [1, 0, 1], [5, 1, 0]]), 0, 2) == (2.0, [0, 1, 2])
    assert abs(G.ellipse_length(3, 3) - 6 * math.pi) < 1e-9 and abs(G.ellipse_length(2, 1) - 9.688448220547675) < 1e-9
    assert G.bresenham(0, 0, 3, 1) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_merging_keeps_moments():
    x = np.random.default_rng(0).normal(size=(200, 2))
    n, m, v = D.merge_source(x, np.array([0.1, 0.1]), 1.0)
    assert n.sum() == 200 and len(n) < 200
    w = n / 200
    assert np.allclose(w @ m, x.mean(axis=0))
    assert np.allclose(w @ (v + m * m) - (w @ m) ** 2, 0.1 + x.var(axis=0))
    assert len(D.merge_source(x, np.array([0.1, 0.1]), 0.0)[0]) == 200


def test_mixtures_are_made_of_all_vectors(spark):
    d, of = "/root/testdata/sf0.001", {}
    for r in T.table(spark, d, "embeddings").select("vec_id", "label", "embedding").orderBy("vec_id").collect():
        of.setdefault(r["label"], []).append([float(r["embedding"][0]), float(r["embedding"][1]), float(r["embedding"][2]) * 100])
    merged, compressed = [], []
    for source, x in of.items():
        x, var, w = np.array(x), np.array(V.VAR), np.full(len(x), 1 / len(x))
        n = D.merge_source(x, var, 1.0)[0]
        merged += [(source, k, round(float(c), 7)) for k, c in enumerate(n / n.sum())]
        compressed += [(source, k, round(float(w[g].sum()), 7)) for k, g in enumerate(D.compress_source(w, x, np.tile(var, (len(x), 1)), 0.5))]
    for name, want in (("mix_merge", merged), ("mix_compress", compressed)):
        assert sorted((r["source"], r["comp_id"], round(r["weight"], 7)) for r in V.QUERIES[name](spark, d).collect()) == sorted(want), name


def test_compression_keeps_moments_and_ellipses_turn_round(spark):
    r = np.random.default_rng(2)
    m = np.vstack([r.normal(0, 0.1, (40, 2)), r.normal(5, 0.1, (40, 2))])
    groups = D.compress_source(np.full(80, 1 / 80), m, np.full((80, 2), 0.05), 0.4)
    assert 2 <= len(groups) < 20 and sorted(np.concatenate(groups).tolist()) == list(range(80))
    assert all(len({k < 40 for k in g.tolist()}) == 1 for g in groups)
    rows = spark.createDataFrame([(float(k),) for k in range(0, 150, 7)], "along double")
    on = G.from_ellipse(rows, (1.0, 2.0), (30.0, 12.0), 0.3).withColumnRenamed("along", "want")
    for x in G.to_ellipse(on, (1.0, 2.0), (30.0, 12.0), 0.3).collect():
        gap = abs(x["along"] - x["want"] % G.ellipse_length(30, 12))
        assert min(gap, G.ellipse_length(30, 12) - gap) < 0.01 and abs(x["d"]) < 1e-3


def test_vertical_radon_lines(spark):
    v = np.arange(20.0).reshape(4, 5) ** 2  # (y, x)
    v[:, 3] += 1000
    image = spark.createDataFrame([(x, y, float(v[y, x])) for y in range(4) for x in range(5)], "x int, y int, v double")
    thetas, rhos = [0.0, math.pi / 2, math.pi], [-3.0 + k for k in range(7)]
    lines = S.radon_lines(image, thetas, rhos, 5, 4)
    got = {(r["theta"], r["rho"]): r["value"] for r in lines.collect()}
    assert all(abs(got[0, k] - v[:, k - 1].sum()) < 1e-9 and abs(got[2, k] - v[:, 5 - k].sum()) < 1e-9 for k in range(1, 6))
    assert {k for k in got if k[0] != 1} == {(t, k) for t in (0, 2) for k in range(1, 6)}
    best = S.fit_line(lines, thetas, rhos, 5, 4).first()
    assert (best["slope"], best["intercept"], best["score"]) == (None, None, v[:, 3].sum())


def test_cases_of_events(spark):
    ev = spark.createDataFrame([("x", k, t, 0.0) for k, t in enumerate((0.0, 0.005, 0.010, 0.1, 0.104, 0.3))], "train string, event_id long, t double, mark double")
    got = [r["interval"] for r in E.intervals(ev, "pre").orderBy("t").collect()]
    assert got[0] is None and np.allclose(got[1:], [-0.005, -0.005, -0.09, -0.004, -0.196])
    assert E.filter_intervals(ev, 0.0045).count() == 5
    h = spark.createDataFrame([("x", k, float(k), 0.0) for k in range(4)], "train string, event_id long, t double, mark double")
    counts = {r["bin"]: r["value"] for r in E.peri_event_histogram(h, h, [-1.0, 0.0, 1.0]).collect()}
    assert counts == {0: 3, 1: 7}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "train string, event_id long, t double, mark double")
    for f in (E.rate, lambda x: E.intervals(x), lambda x: E.bursts(x, 0, 1), lambda x: E.complex_spike_index(x, 0, 1)):
        assert f(none).count() == 0


def test_record_files(spark, tmp_path):
    layout = R.layout_of("time,8,4,1\tpos,4,4,2\tlabel,10,1,8")
    assert R.layout_of(R.fields_of(layout)) == layout
    rows = np.zeros(5000, layout)
    rows["time"], rows["pos"], rows["label"] = np.arange(5000), np.arange(10000).reshape(-1, 2), b"ab"
    (tmp_path / "x.rec").write_bytes(R.write_records(rows, b"%%BEGIN\n%%END\n"))
    df = R.read_records(spark, f"{tmp_path}/x.rec", layout, 14)
    assert df.count() == 5000 and df.filter("time = 4999").first()["pos"] == [9998.0, 9999.0] and df.first()["label"] == "ab"
    csc = np.zeros(2, np.dtype(R.LAYOUTS["csc"]))
    csc["timestamp"], csc["samplefreq"], csc["numvalidsamples"] = [0, 1_000_000], 100, [512, 3]
    (tmp_path / "a.ncs").write_bytes(R.write_records(csc, b" " * R.ACQUISITION_HEADER))
    assert R.read_csc(spark, f"{tmp_path}/a.ncs").count() == 515
    comps = [(0.25, [1.0, 2.0], [[1.0, 0.0], [0.0, 4.0]]), (0.75, [3.0, 4.0], [[2.0, 0.5], [0.5, 2.0]])]
    (tmp_path / "tt1.mixture").write_bytes(R.mixture_bytes(comps, 2.0, 1.0, [[1.0, 0.0], [0.0, 1.0]]))
    got = R.read_mixtures(spark, f"{tmp_path}/tt1.mixture").orderBy("comp_id").collect()
    assert [(r["weight"], r["mean"], r["cov"]) for r in got] == comps and got[0]["source"] == "tt1"
    assert R.parse_header("% rate: 3\n% name: x y\n") == {"rate": "3", "name": "x y"}


def test_probe_words(spark):
    w = spark.createDataFrame([((1 << 30) | 5 | 7 << 10 | 9 << 20,)], "word long")
    assert w.select(X.packed_prefix(F.col("word"))).first()[0] == 1
    assert [r["v"] for r in R.unpack_words(w).orderBy("k").collect()] == [5, 7, 9]


def test_too_few_spikes_fail(spark):
    with pytest.raises(Exception, match="too few"):
        R.check_sources(spark.createDataFrame([("a",)], "source string")).collect()


def test_blocks_are_counted_without_their_arrays(spark):
    n, small = F.col("id"), spark.range(-2, 70)
    both = [(X.block_count(n, 8), X.blocks(n, 8)), (X.slice_count(n, 10, 0, 5, True), X.slices(n, 10, 0, 5, True)), (X.slice_count(n, 4, 3), X.slices(n, 4, 3))]
    for count, array in both:
        assert small.filter(count != F.size(array)).count() == 0
    assert [tuple(x) for x in small.filter("id = 19").select(both[0][1].alias("x")).first()["x"]] == [(0, 8), (8, 8), (16, 3)]
    assert tuple(spark.range(10**15, 10**15 + 1).select(X.block_count(n, 10**9), X.slice_count(n, 10**9, 0, 10**9, True)).first()) == (10**6, 10**6)
    plan = P_CIRCULAR.QUERIES["fn_partitions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


def test_window_means_round_like_their_sql(spark, tmp_path):
    """Ties of the fourth digit, and more than 400 windows."""
    cents = [(k, 307624 if k % 64 == 0 else 0) for k in range(13_000)]
    rows = [(k, 1, "view", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k), c / 100) for k, c in cents]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in P_SIGNALS.QUERIES["sig_windows"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = set(con.execute(P_SIGNALS.ORACLE_SQL["sig_windows"]).fetchall())
    assert want == got and len(want) > 400
    assert {r[1] for r in got} == set(range((13_000 - 64) // 32 + 1))
