"""op7 and op9 on small Parquet tables and on the driver's, against brute force; and that their bounds and stopping tests leave work out."""

import math

import numpy as np
import pyarrow.parquet as pq

from tempora.llm import ann, exact_search
from tempora.llm.vectors import Best, first_least

SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, every, k, score):
    """(query_id, rank, vec_id, score) of the k best by scalar arithmetic."""
    out = []
    for q in sorted({i for i, _ in rows if i is not None and i % every == 0}):
        own = min(v for i, v in rows if i == q)
        best = sorted((-score(own, v), i) for i, v in rows if i is not None and i != q and len(v) == len(own))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def odd_rows(r):
    x = [r.integers(-3, 4, 6) / 64.0 + 0.001 for _ in range(150)]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200 + k, [0.25, 0.5, 0.0, 0.0, -0.5, 1.0]) for k in range(160)]  # equal vectors tie
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[4][1]), (500, [1.0, 2.0]), (501, [2.0, 1.0])]
    bad = [(600, None), (700, []), (800, [None] + [1.0] * 5), (900, [math.nan] * 6), (1000, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    return rows, bad


def test_op7_equals_brute_force(spark, tables):
    rows, bad = odd_rows(np.random.default_rng(5))
    rows += [(1100, [2.0**20, 3.0, 1.0]), (1101, [2.0**28, 1.0, 0.0]), (1102, [2.0**28, 1.0, 1 / 64])]
    d = tables("embeddings", [(i, v, "clash", 7) for i, v in rows + bad], SCHEMA)
    whole = [(i, [math.floor(64 * c) for c in v]) for i, v in rows]
    got = exact_search.op7_exact_topk(spark, d)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(whole, 20, 20, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    assert exact_search.op7_exact_topk(spark, tables("embeddings", [], SCHEMA)).count() == 0


def test_products_beyond_a_long_are_held():
    big = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**40), 0.0]])
    got = exact_search.pair_products(np.array([[2.0**20, 3.0]] * 2 + [[2.0**40, 0.0]]), big)
    assert got.tolist() == [2**60 + 3, 2**60 + 6, -(2**63 - 1)]


def tiles(ids, x, n):
    return ((ids[k : k + n], x[k : k + n]) for k in range(0, len(x), n))


def test_bounds_drop_pairs():
    # vectors about few directions, as learned embeddings are
    r = np.random.default_rng(6)
    x = np.floor(64 * (r.normal(size=(6000, 6)) @ r.normal(size=(6, 64)) + 0.2 * r.normal(size=(6000, 64)) + 0.5))
    ids = np.arange(6000)
    q = x[::20]
    best = Best(len(q), 20, first_least(q, 20, exact_search.products), np.int64)
    count = exact_search.best_products(exact_search.LEVELS, ids[::20], q, tiles(ids, x, 2048), best)
    tried, left = (sum(c[i] for c in count.values()) for i in (0, 1))
    assert tried > 0 and left < 0.2 * tried
    s = q @ x.T
    s[np.arange(len(q)), ids[::20]] = -np.inf
    for n, row in enumerate(s):
        order = np.lexsort((ids, -row))[:20]
        mine = best.query == n
        assert dict(zip(best.id[mine].tolist(), best.score[mine].tolist(), strict=True)) == {int(i): int(row[i]) for i in order}


def test_bounds_hold_in_any_basis():
    r = np.random.default_rng(2)
    for scale in (1.0, 1e6):
        q, x = np.floor(scale * r.normal(size=(40, 9))), np.floor(scale * (r.normal(size=(70, 9)) + 1))
        q[3] = 0
        res = exact_search.Resolutions(q, (1, 3, 9, 12))
        stats, norms = res.of(x)
        for level in range(4):
            for j in range(len(x)):
                assert res.may(level, np.arange(40), [s[j : j + 1] for s in stats], norms[j : j + 1], q @ x[j]).all()


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_op9_ties_and_odd_rows(spark, tables):
    rows, bad = odd_rows(np.random.default_rng(7))
    d = tables("embeddings", [(i, v, "clash", 7) for i, v in rows + bad + [(1200, [0.0] * 6)]], SCHEMA)
    got = sorted(map(tuple, ann.op9_nearest_neighbours(spark, d).collect()))
    want = brute(rows, 50, 5, lambda a, b: round(cosine(a, b), 12))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    least = {q: s for q, _, _, s in want}
    hits = 0
    for q, _, i, s in got:
        assert any(abs(s - cosine(min(v for j, v in rows if j == q), v)) < 1e-12 for j, v in rows if j == i and len(v) == len(min(u for j, u in rows if j == q)))
        hits += s >= least[q] - 1e-9
    assert hits >= 0.9 * len(got)
    for q in (200, 250, 300, 350):  # all of these are equal vectors: the smallest ids win, in order
        assert [i for x, _, i, _ in got if x == q] == [i for i in range(200, 207) if i != q][:5]
    assert ann.op9_nearest_neighbours(spark, tables("embeddings", [], SCHEMA)).count() == 0


def test_op9_recall_on_the_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
        rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
        want = brute([(i, np.array(v, float)) for i, v in rows], 50, 5, cosine) if sf == "sf0.01" else None
        x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
        u = x / np.linalg.norm(x, axis=1)[:, None]
        found = {}
        for q, _, i, s in map(tuple, ann.op9_nearest_neighbours(spark, f"/root/testdata/{sf}").collect()):
            found.setdefault(q, set()).add(i)
            assert abs(s - float(u[ids == i][0] @ u[ids == q][0])) < 1e-12
        hits = 0
        for q, ours in found.items():
            s = u @ u[ids == q][0]
            s[ids == q] = -2
            hits += len(ours & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        assert want is None or {q for q, *_ in want} == set(found)
        assert hits >= 0.9 * 5 * len(found)


def test_few_points_are_verified():
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 64))
    x = centres[r.integers(0, 40, 20_000)] + 0.5 * r.normal(size=(20_000, 64))
    ids, q = np.arange(20_000), x[::200]
    best = Best(len(q), 5, first_least(q, 5, ann.cosines))
    verified, pairs = ann.nearest(ann.DIMS, ann.CHANCE, ids[::200], q, tiles(ids, x, 8192), best)
    assert pairs == 100 * 20_000 and verified < 0.1 * pairs
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u[::200] @ u.T
    s[np.arange(100), ids[::200]] = -2
    kth = np.sort(s, axis=1)[:, -5]
    assert np.mean(best.score >= kth[best.query] - 1e-12) >= 0.9
