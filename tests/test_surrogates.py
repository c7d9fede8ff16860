"""The ring of likelihood rows, its surrogates and the online loop against a plain loop over all rows so far."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import decoding as C
from tempora.operators import density as D
from tempora.operators import surrogates as R
from tempora.plans import decoding as V
from tempora.plans import loops as L
from tempora.streaming import online as O

GRID = 7
STATES = np.abs(np.subtract.outer(np.arange(float(GRID)), np.arange(float(GRID))))
SCHEMA = "session string, bin long, mua double, pax array<array<double>>, own array<int>, minus array<double>"


def some_bins(seed, n=40, session="a"):
    """Bins of a few spikes by three models, drifting over the grid; some without spikes."""
    r, out = np.random.default_rng(seed), []
    for b in range(n):
        spikes = int(r.integers(0, 5))
        pax = r.random((3 * spikes, GRID)) * np.exp(-np.abs(np.arange(GRID) - b % GRID))
        own = sorted(int(m * spikes + k) for k, m in enumerate(r.integers(0, 3, spikes)))
        out.append((session, b, float(r.integers(0, 14)), pax.tolist(), own, (r.random(GRID) * spikes).tolist()))
    return out


def plain_rwd(sequence):
    """Distance correlation of a sequence of posteriors, element by element."""
    n, top = len(sequence), []
    for p in sequence:
        a = int(np.argmax(p))
        b = int(np.argmax([-1 if k == a else v for k, v in enumerate(p)]))
        top.append([(a, p[a] / (p[a] + p[b])), (b, p[b] / (p[a] + p[b]))])
    place = [[0.0 if j == k else sum(u * v * STATES[x][y] for x, u in top[j] for y, v in top[k]) for k in range(n)] for j in range(n)]
    time = [[min(abs(j - k), 3) * 2.8 / 3 for k in range(n)] for j in range(n)]

    def centre(m):
        row, col, all_ = [sum(x) / n for x in m], [sum(x) / n for x in zip(*m, strict=True)], sum(map(sum, m)) / n / n
        return [[m[j][k] - row[j] - col[k] + all_ for k in range(n)] for j in range(n)]

    a, b = centre(time), centre(place)
    mean = lambda x, y: sum(u * v for p, q in zip(x, y, strict=True) for u, v in zip(p, q, strict=True)) / n / n
    cov, scale = mean(a, b), math.sqrt(mean(a, a) * mean(b, b))
    return round(math.sqrt(cov / scale), 12) if cov > 0 and scale > 0 else 0.0


def plain_loop(rows, rules):
    """Verdicts (bin, mua, detected, p, score) and, where the ring is full, (bin, rwd, p) without gate; all rows are kept and every surrogate is decoded by itself."""
    table = R.index_table(rules.ring, rules.shuffles, rules.seed)
    history, decoded, verdicts, tests = [], [], [], []
    run, armed, detected, skips, score = 0, True, False, 0, 0.0
    for _, b, mua, pax, own, minus in rows:
        ready = False
        if mua >= rules.threshold:
            run += armed
        else:
            run, armed = 0, True
        if run >= rules.consecutive:
            run, armed, detected, score = 0, False, True, 0.0
        if mua < rules.least or not pax:
            skips += 1
            if skips >= rules.skips:
                detected, score = False, 0.0
            verdicts.append((b, mua, detected, 1.0, score))
            continue
        skips = 0
        history += pax
        if len(history) >= rules.ring:
            ready, now = True, []
            for s in range(rules.shuffles):
                picked = [pax[k] for k in own] if s == 0 else [history[-1 - table[s][i]] for i in range(len(own))]
                log = [sum(math.log(row[g] + 1e-13) for row in picked) - minus[g] for g in range(GRID)]
                e = [math.exp(v - max(log)) for v in log]
                now.append([v / sum(e) for v in e])
            decoded.append(now)
        p, rwd = 1.0, 0.0
        for n in rules.windows if ready else ():
            if len(decoded) >= n:
                c = [plain_rwd([d[s] for d in decoded[-n:]]) for s in range(rules.shuffles)]
                rwd, p = c[0], min(p, (sum(x > c[0] for x in c[1:]) + 1) / (rules.shuffles - 1))
        if ready:
            tests.append((b, rwd, p))
        p = p if detected else 1.0
        score -= math.log(p) if p < rules.level else 0
        verdicts.append((b, mua, detected, p, score))
    return verdicts, tests


RULES = O.Rules(threshold=6.0, consecutive=2, least=1, windows=(3, 4, 5), shuffles=41, ring=30, level=0.5)


def near(got, want):
    return len(got) == len(want) and all(x[:-2] == y[:-2] and np.allclose(x[-2:], y[-2:]) for x, y in zip(got, want, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_loop_equals_a_plain_loop(spark, seed):
    rows = {s: some_bins(seed + k, session=s) for k, s in enumerate("ab")}
    bins = spark.createDataFrame(rows["a"] + rows["b"], SCHEMA).repartition(3)
    got = O.assess_batch(bins, STATES, RULES).collect()
    for s, mine in rows.items():
        want, _ = plain_loop(mine, RULES)
        assert near(sorted(tuple(r)[1:] for r in got if r["session"] == s), want) and any(v[2] and v[3] < 1 for v in want)
    every = O.Rules(**{**RULES.__dict__, "least": 0})
    got = O.shuffle_test(bins, STATES, every).collect()
    for s, mine in rows.items():
        assert near(sorted(tuple(r)[1:] for r in got if r["session"] == s), plain_loop(mine, every)[1])


def test_stream_of_several_batches_equals_the_table(spark, tmp_path):
    rows = some_bins(5, session="a") + some_bins(6, session="b")
    parts = [spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 14], SCHEMA).coalesce(1) for lo in (0, 14, 28)]
    want = sorted(map(tuple, O.assess_batch(spark.createDataFrame(rows, SCHEMA), STATES, RULES).collect()))
    got = sorted(map(tuple, O.replay(parts, str(tmp_path), lambda s: O.assess_stream(s, STATES, RULES)).collect()))
    assert got == want and len(got) == 80


def test_ring_keeps_its_newest_rows():
    ring = R.Ring(6, 5, 0, 3)
    r = np.random.default_rng(0)
    blocks = [r.random((k, GRID)) for k in (2, 3, 0, 4, 7, 2, 1)]
    for b in blocks:
        ring.update(b, np.arange(min(len(b), 1)), np.zeros(GRID))
    whole = np.concatenate([b for b in blocks if len(b) <= 6])
    assert np.allclose(ring.logs, np.log(whole[-6:] + 1e-13)) and len(ring.at) == 3
    again = R.Ring(6, 5, 0, 3).unpack(*ring.pack())
    assert (again.logs == ring.logs).all() and (again.at == ring.at).all() and (again.weight == ring.weight).all()
    table = R.index_table(6, 5, 0)
    assert (np.sort(table, axis=1) == np.arange(6)).all() and (table == R.index_table(6, 5, 0)).all()


def test_a_run_beats_its_surrogates():
    ring, rules = R.Ring(60, 201, 3, 6), O.Rules(windows=(6,))
    r = np.random.default_rng(1)
    for _ in range(15):
        ring.update(r.random((4, GRID)), np.arange(2), np.zeros(GRID))
    for b in range(6):
        pax = np.full((4, GRID), 1e-6)
        pax[:, b] = 1
        ring.update(pax, np.arange(2), np.zeros(GRID))
    rwd, p = R.least_p(ring, rules.windows, STATES)
    assert rwd > 0.9 and p <= 0.1


def test_rows_of_all_spikes_by_all_models(spark):
    d = "/root/testdata/sf0.001"
    v = V.vectors(spark, d).filter("id < 60")
    comps = D.samples_to_components(v, V.VAR, [0, 1, 2])
    behavior = v.select(F.col("x")[2].alias("x"))
    got = {r["bin"]: r for r in R.likelihood_rows(v, comps, behavior, V.GRID, [0, 1], 2, 500.0, V.OPTIONS, 0.25, 0.8).collect()}
    spikes, models = v.collect(), {}
    for c in comps.collect():
        models.setdefault(c["source"], []).append(c)
    assert sorted(got) == sorted({s["bin"] for s in spikes})
    pix = {r["g"]: r["pix"] for r in C.occupancy(behavior, V.GRID, V.OPTIONS.position_bandwidth).collect()}
    lx = {}
    for r in C.rates(comps, behavior, V.GRID, V.OPTIONS.position_bandwidth, 2, 500.0, V.OPTIONS.offset).collect():
        lx[r["g"]] = lx.get(r["g"], 0) + r["lx"]
    for b, r in got.items():
        mine = sorted((s for s in spikes if s["bin"] == b), key=lambda s: (s["source"], s["id"]))
        want, own = [], []
        for m in sorted(models):
            for s in mine:
                own += [len(want)] if s["source"] == m else []
                row = np.zeros(len(V.GRID))
                for c in models[m]:
                    q = sum((s["x"][k] - c["mean"][k]) ** 2 / c["var"][k] for k in (0, 1))
                    q = q + (np.array(V.GRID) - c["mean"][2]) ** 2 / c["var"][2]
                    scale = np.prod([1 / math.sqrt(2 * math.pi * u) for u in c["var"]])
                    row += np.where(q <= 16, c["weight"] * scale * np.exp(-q / 2), 0)
                want.append(row)
        assert r["own"] == own and r["n"] == len(mine) and np.allclose(r["pax"], want, atol=1e-9)
        assert np.allclose(r["minus"], [len(mine) * math.log(pix[g]) + 0.25 * lx[g] for g in range(len(V.GRID))])


def test_queries_fill_their_ring(spark):
    got = L.shuffle(spark, "/root/testdata/sf0.01").collect()
    assert got and any(r["p"] < 1 for r in got)
