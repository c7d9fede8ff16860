"""Queries of graphs, collections of shapes and random points: line items are points of quantity and price, events' values distances along paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import shapes as H
from ..operators import splines as L_
from ..sources import tables as T
from .events import rounded
from .geometry import PATH, POLY, PT, along, points

MAZE = H.Graph([[(0.0, 0.0), (20.0, 40.0), (45.0, 40.0)], [(45.0, 40.0), (50.0, 90.0)], [(45.0, 40.0), (10.0, 80.0), (0.0, 0.0)]], [(0, 1), (1, 2), (1, 0)])
SHAPES = [PATH, [(0.0, 90.0), (50.0, 0.0)], [(10.0, 10.0), (10.0, 60.0), (30.0, 60.0)]]
#: A curve through the nodes of the path.
CURVE = L_.spline(PATH)


def ids(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select(F.col("event_id").alias("id"))


def inside(df: DataFrame, test) -> DataFrame:
    """Rows and those inside."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(test).alias("n_inside"))


QUERIES = {
    "geo_graph_project": lambda s, d: H.to_graph(points(s, d), MAZE).select("l_orderkey", "l_linenumber", F.col("place.edge").alias("edge"), *[F.round(F.col("place." + c), 6).alias(c) for c in ("d", "px", "py", "s", "along")]),
    "geo_graph_point": lambda s, d: H.from_graph(along(s, d), MAZE).filter("point IS NOT NULL").select("event_id", F.col("point.edge").alias("edge"), *[F.round(F.col("point." + c), 6).alias(c) for c in ("x", "y", "tangent")]),
    "geo_graph_parts": lambda s, d: rounded(along(s, d).withColumn("p", H.part_of(F.col("along"), MAZE.lengths)).filter("p IS NOT NULL").select("event_id", "p.edge", F.col("p.s").alias("s"), H.along_of(F.col("p.edge"), F.col("p.s"), MAZE.lengths).alias("back")), "s", "back"),
    "geo_graph_gradient": lambda s, d: rounded(H.graph_gradient(T.events(s, d).select("event_id", "user_id", F.pmod(F.col("mark"), F.lit(MAZE.length)).alias("along")), MAZE, ["user_id"], "event_id", 0.5).select("event_id", "gradient"), "gradient", places=5),
    "geo_shape_project": lambda s, d: rounded(H.to_shape(points(s, d), SHAPES, 1).select("l_orderkey", "l_linenumber", "along", F.col("path.d").alias("d")), "along", "d"),
    "geo_shape_point": lambda s, d: rounded(H.from_shapes(along(s, d), SHAPES).filter("point IS NOT NULL").select("event_id", "shape", "point.x", "point.y"), "x", "y"),
    "geo_path_edges": lambda s, d: rounded(along(s, d).withColumn("e", G.path_to_edge(PATH, F.col("along"))).filter("e IS NOT NULL").select("event_id", "e.edge", F.col("e.s").alias("s"), G.edge_to_path(PATH, F.col("e.edge"), F.col("e.s")).alias("back")), "s", "back"),
    "geo_eccentricity": lambda s, d: rounded(points(s, d).filter("x > 0 AND y > 0").select("l_orderkey", "l_linenumber", H.eccentricity(F.col("x"), F.col("y")).alias("e")), "e"),
    "geo_circle_tangent": lambda s, d: rounded(H.ellipse_tangent(along(s, d), (20.0, 20.0), 0.3).select("event_id", F.sin("tangent").alias("sin"), F.cos("tangent").alias("cos")), "sin", "cos"),
    "geo_ellipse_tangent": lambda s, d: rounded(H.ellipse_tangent(along(s, d), (20.0, 30.0), 0.3).select("event_id", "tangent"), "tangent"),
    "geo_random_rectangle": lambda s, d: rounded(H.random_in_rectangle(ids(s, d), (5.0, 1.0), 8.0, 2.0), "x", "y"),
    "geo_random_ellipse": lambda s, d: rounded(H.random_in_ellipse(ids(s, d), (5.0, 1.0), (4.0, 2.0), 0.5), "x", "y"),
    "geo_spline_project": lambda s, d: L_.to_spline(points(s, d), CURVE).select("l_orderkey", "l_linenumber", *[F.round(F.col("path." + c), 6).alias(c) for c in ("ad", "px", "py", "along")]),
    "geo_spline_point": lambda s, d: L_.from_spline(along(s, d), CURVE).filter("point IS NOT NULL").select("event_id", F.col("point.edge").alias("edge"), *[F.round(F.col("point." + c), 6).alias(c) for c in ("x", "y", "tangent")]),
    "geo_random_polygon": lambda s, d: inside(H.random_in_polygon(ids(s, d), POLY), G.in_polygon(POLY, F.col("x"), F.col("y"))),
    "geo_random_on": lambda s, d: rounded(H.random_on(ids(s, d), PATH).select("id", "point.x", "point.y"), "x", "y"),
}

L = [float(x) for x in MAZE.lengths]
ALL = [(k, *e[1:6], MAZE.before[k] + e[6], L[k], MAZE.before[k], e[6]) for k, p in enumerate(MAZE.polylines) for e in G.edges(p)]
GE = "e(o, k, x0, y0, dx, dy, n, t, len, base, own) AS (VALUES " + ", ".join("(" + ", ".join([str(i), str(e[0]), *(f"{v!r}::DOUBLE" for v in map(float, e[1:]))]) + ")" for i, e in enumerate(ALL)) + ")"
PARTS = lambda lengths: "q(k, a, b) AS (VALUES " + ", ".join(f"({k}, {float(a)!r}::DOUBLE, {float(a + n)!r}::DOUBLE)" for k, (a, n) in enumerate(zip(np.concatenate([[0.0], np.cumsum(lengths)[:-1]]), lengths, strict=True))) + ")"
SE = [(k, *e[1:6], sum(G.length(x) for x in SHAPES[:k]) + e[6]) for k, p in enumerate(SHAPES) for e in G.edges(p)]
SHE = "e(o, k, x0, y0, dx, dy, n, t) AS (VALUES " + ", ".join("(" + ", ".join([str(i), str(e[0]), *(f"{v!r}::DOUBLE" for v in map(float, e[1:]))]) + ")" for i, e in enumerate(SE)) + ")"
V = "v AS (SELECT event_id, value AS a FROM events)"
ONE = SHAPES[1]
(OX, OY), (EX, EY) = ONE
DX, DY, N, BEFORE = EX - OX, EY - OY, G.length(ONE), G.length(SHAPES[0])
WAYS = "w(ea, eb, w00, w01, w10, w11, la, lb) AS (VALUES " + ", ".join("(" + ", ".join([str(a), str(b), *(f"{float(MAZE.apart[MAZE.ends[a][i], MAZE.ends[b][j]])!r}::DOUBLE" for i in (0, 1) for j in (0, 1)), f"{L[a]!r}::DOUBLE", f"{L[b]!r}::DOUBLE"]) + ")" for a in range(3) for b in range(3)) + ")"


def _signed(name: str, a: str, b: str) -> str:
    """The signed distance between the places a and b of a row of g."""
    x = f"SELECT g.event_id, unnest([-(w00 + {a}s + {b}s), -(w01 + {a}s + lb - {b}s), w10 + la - {a}s + {b}s, w11 + la - {a}s + lb - {b}s, CASE WHEN {a}e = {b}e THEN {b}s - {a}s ELSE 1e300 END]) AS d, unnest([0, 1, 2, 3, 4]) AS i FROM g JOIN w ON w.ea = {a}e AND w.eb = {b}e"
    return f"{name} AS (SELECT event_id, d FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(d), 9), i) AS r FROM ({x})) WHERE r = 1)"


def _uniform(seed: int, of: str = "event_id") -> str:
    return f"(('0x' || substr(md5('{seed}|' || {of}), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE)"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"{v}" if isinstance(v, int) else f"{float(v)!r}::DOUBLE" for v in r) + ")" for r in rows)


_STEP = np.diff(CURVE.samples, axis=0)
#: Short edges of the curve, with its parameter at their starts, and its polynomials by the edge between nodes.
FINE = "e(k, x0, y0, dx, dy, n, t, u0, du) AS (VALUES " + _rows((k, *CURVE.samples[k], *_STEP[k], np.hypot(*_STEP[k]), CURVE.along[k], CURVE.at[k], CURVE.at[k + 1] - CURVE.at[k]) for k in range(len(_STEP))) + "), kn(j, ku, bx, cx, gx, by_, cy, gy) AS (VALUES " + _rows((j, CURVE.u[j], *CURVE.x[j, 1:], *CURVE.y[j, 1:]) for j in range(len(CURVE.u) - 1)) + ")"
#: Edges of the path: start, direction, length and the length before each.
PE = "e(o, k, x0, y0, dx, dy, n, t) AS (VALUES " + ", ".join("(" + ", ".join([str(i), str(i), *(f"{float(v)!r}::DOUBLE" for v in e[1:7])]) + ")" for i, e in enumerate(G.edges(PATH))) + ")"
ORACLE_SQL = {
    "geo_graph_project": f"WITH {PT}, {GE}, s AS (SELECT p.*, o, k, x0, y0, dx, dy, n, len, base, own, least(greatest(((x - x0) * dx + (y - y0) * dy) / n, 0), n) AS s FROM p, e), q AS (SELECT *, x0 + s * dx / n AS px, y0 + s * dy / n AS py, least(s + own, len - 1e-4) AS z FROM s), m AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) * CASE WHEN dx * (y - y0) - (x - x0) * dy < 0 THEN -1 ELSE 1 END AS d FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(d), 12), k, d, px, py) AS r FROM m) SELECT l_orderkey, l_linenumber, k AS edge, round(d, 6) AS d, round(px, 6) AS px, round(py, 6) AS py, round(z, 6) AS s, round(z + base, 6) AS along FROM r WHERE r = 1",
    "geo_graph_point": f"WITH {V}, {GE}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o) AS r FROM v JOIN e ON a >= t AND a - t <= n) SELECT event_id, k AS edge, round(x0 + (a - t) * dx / n, 6) AS x, round(y0 + (a - t) * dy / n, 6) AS y, round(atan2(dy, dx), 6) AS tangent FROM r WHERE r = 1",
    "geo_graph_parts": f"WITH v AS (SELECT event_id, value AS x FROM events), {PARTS(L)}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k) AS r FROM v JOIN q ON x >= a AND x <= b) SELECT event_id, k AS edge, round(x - a, 6) AS s, round(x, 6) AS back FROM r WHERE r = 1",
    "geo_graph_gradient": f"WITH {PARTS(L)}, {WAYS}, v AS (SELECT event_id, user_id, value - floor(value / {MAZE.length!r}) * {MAZE.length!r} AS x FROM events), pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k) AS r FROM v JOIN q ON x >= a AND x <= b) WHERE r = 1), g AS (SELECT event_id, k AS pe, x - a AS ps, lag(k) OVER u AS be, lag(x - a) OVER u AS bs, lead(k) OVER u AS ne, lead(x - a) OVER u AS ns FROM pr WINDOW u AS (PARTITION BY user_id ORDER BY event_id)), {_signed("fw", "p", "n")}, {_signed('bw', 'p', 'b')}, {_signed('ib', 'b', 'p')} SELECT g.event_id, round(CASE WHEN be IS NULL THEN fw.d / 0.5 WHEN ne IS NULL THEN ib.d / 0.5 ELSE (fw.d - bw.d) / 1.0 END, 5) AS gradient FROM g LEFT JOIN fw USING (event_id) LEFT JOIN bw USING (event_id) LEFT JOIN ib USING (event_id)",
    "geo_shape_project": f"WITH {PT}, s AS (SELECT *, least(greatest(((x - {OX}) * {DX} + (y - {OY}) * {DY}) / {N!r}, 0), {N!r}) AS s FROM p) SELECT l_orderkey, l_linenumber, round(s + {BEFORE!r}, 6) AS along, round(sqrt(pow(x - ({OX} + s * {DX} / {N!r}), 2) + pow(y - ({OY} + s * {DY} / {N!r}), 2)) * CASE WHEN {DX} * (y - {OY}) - (x - {OX}) * {DY} < 0 THEN -1 ELSE 1 END, 6) AS d FROM s",
    "geo_shape_point": f"WITH {V}, {SHE}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o) AS r FROM v JOIN e ON a >= t AND a - t <= n) SELECT event_id, k AS shape, round(x0 + (a - t) * dx / n, 6) AS x, round(y0 + (a - t) * dy / n, 6) AS y FROM r WHERE r = 1",
    "geo_path_edges": f"WITH v AS (SELECT event_id, value AS x FROM events), {PARTS([e[5] for e in G.edges(PATH)])}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k) AS r FROM v JOIN q ON x >= a AND x <= b) SELECT event_id, k AS edge, round(x - a, 6) AS s, round(x, 6) AS back FROM r WHERE r = 1",
    "geo_eccentricity": f"WITH {PT} SELECT l_orderkey, l_linenumber, round(sqrt(1 - pow(least(x, y) / greatest(x, y), 2)), 6) AS e FROM p WHERE x > 0 AND y > 0",
    "geo_circle_tangent": f"WITH {V} SELECT event_id, round(cos(a / 20.0 + 0.3), 6) AS sin, round(-sin(a / 20.0 + 0.3), 6) AS cos FROM v",
    "geo_spline_project": f"WITH {PT}, {FINE}, pr AS (SELECT row_number() OVER () AS row, * FROM p), s AS (SELECT pr.*, k, x0, y0, dx, dy, n, t, least(greatest(((x - x0) * dx + (y - y0) * dy) / n, 0), n) AS s FROM pr, e), q AS (SELECT row, l_orderkey, l_linenumber, k, x0 + s * dx / n AS px, y0 + s * dy / n AS py, t + s AS along, round(sqrt(pow(x - x0 - s * dx / n, 2) + pow(y - y0 - s * dy / n, 2)), 12) AS ad FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY ad, k) AS r FROM q) SELECT l_orderkey, l_linenumber, round(ad, 6) AS ad, round(px, 6) AS px, round(py, 6) AS py, round(along, 6) AS along FROM r WHERE r = 1",
    "geo_spline_point": f"WITH {V}, {FINE}, g AS (SELECT * FROM v ASOF JOIN e ON a >= t WHERE a <= {CURVE.length!r}), w AS (SELECT event_id, k // {L_.FINE} AS edge, x0 + (a - t) * dx / n AS x, y0 + (a - t) * dy / n AS y, u0 + (a - t) / n * du AS u FROM g), z AS (SELECT w.*, u - ku AS s, bx, cx, gx, by_, cy, gy FROM w JOIN kn ON edge = j) SELECT event_id, edge::INTEGER AS edge, round(x, 6) AS x, round(y, 6) AS y, round(atan2(by_ + s * (2 * cy + 3 * s * gy), bx + s * (2 * cx + 3 * s * gx)), 6) AS tangent FROM z",
    "geo_random_rectangle": f"SELECT event_id AS id, round(5.0 + ({_uniform(0)} - 0.5) * 8.0, 6) AS x, round(1.0 + ({_uniform(1)} - 0.5) * 2.0, 6) AS y FROM events",
    "geo_random_ellipse": f"WITH r AS (SELECT event_id AS id, sqrt({_uniform(0)}) AS r, 2 * pi() * {_uniform(1)} AS t FROM events) SELECT id, round(5.0 + 4.0 * r * cos(t) * cos(0.5) - 2.0 * r * sin(t) * sin(0.5), 6) AS x, round(1.0 + 4.0 * r * cos(t) * sin(0.5) + 2.0 * r * sin(t) * cos(0.5), 6) AS y FROM r",
    "geo_random_on": f"WITH {PE}, r AS (SELECT event_id AS id, {_uniform(0)} * {float(G.length(PATH))!r} AS a FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS r FROM r JOIN e ON a >= t AND a - t <= n) SELECT id, round(x0 + (a - t) * dx / n, 6) AS x, round(y0 + (a - t) * dy / n, 6) AS y FROM w WHERE r = 1",
}
