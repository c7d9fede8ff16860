"""Queries of geometry: line items are points of quantity and price."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..sources import tables as T
from .events import rounded

PATH = [(0.0, 0.0), (20.0, 40.0), (45.0, 40.0), (50.0, 90.0)]
POLY = [(5.0, 10.0), (40.0, 5.0), (45.0, 60.0), (20.0, 30.0), (8.0, 70.0)]


def points(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


def along(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).select("event_id", F.col("mark").alias("along"))


STACK = G.TransformStack().scale(2.0, 0.5, (1.0, 1.0)).rotate(0.3).translate(5.0, -2.0)
ENDS, LENGTHS = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 3)], [10.0, 20.0, 15.0, 30.0, 12.0]


def graph_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    a, b = (F.col("event_id") % 5).cast("int"), (F.col("user_id") % 5).cast("int")
    return G.graph_distance(e.select("event_id", a.alias("edge_a"), F.pmod(F.col("mark"), F.lit(10.0)).alias("s_a"), b.alias("edge_b"), F.pmod(F.col("mark") * 3, F.lit(9.0)).alias("s_b")), ENDS, LENGTHS)


QUERIES = {
    "geo_polyline_project": lambda s, d: G.to_polyline(points(s, d), PATH).select("l_orderkey", "l_linenumber", F.col("path.edge").alias("edge"), *[F.round(F.col("path." + c), 6).alias(c) for c in ("d", "px", "py", "along")]),
    "geo_path_point": lambda s, d: G.from_polyline(along(s, d), PATH).filter("point IS NOT NULL").select("event_id", F.col("point.edge").alias("edge"), *[F.round(F.col("point." + c), 6).alias(c) for c in ("x", "y", "tangent")]),
    "geo_inpoly": lambda s, d: points(s, d).select("l_orderkey", "l_linenumber", G.in_polygon(POLY, F.col("x"), F.col("y")).alias("inside")),
    "geo_in_ellipse": lambda s, d: points(s, d).select("l_orderkey", "l_linenumber", G.in_ellipse(F.col("x"), F.col("y"), (25.0, 40.0), (20.0, 30.0), 0.0).alias("inside")),
    "geo_area": lambda s, d: rounded(G.polygon_area(points(s, d).withColumnRenamed("l_linenumber", "i"), ["l_orderkey"]), "area", places=7),
    "geo_bounding_box": lambda s, d: rounded(G.bounding_box(points(s, d), ["l_orderkey"]), "x0", "y0", "x1", "y1"),
    "geo_transform": lambda s, d: rounded(points(s, d).select("l_orderkey", "l_linenumber", STACK.apply(F.col("x"), F.col("y"))[0].alias("u"), STACK.apply(F.col("x"), F.col("y"))[1].alias("v")), "u", "v", places=5),
    "geo_transform_inverse": lambda s, d: rounded(points(s, d).select("l_orderkey", "l_linenumber", STACK.inverse().apply(*STACK.apply(F.col("x"), F.col("y")))[0].alias("u")), "u", places=5),
    "geo_loop_distance": lambda s, d: rounded(along(s, d).select("event_id", G.loop_distance(F.col("along"), F.lit(33.0), 120.0).alias("distance")), "distance"),
    "geo_circle_project": lambda s, d: rounded(G.to_ellipse(points(s, d), (25.0, 40.0), (20.0, 20.0)), "along", "d").select("l_orderkey", "l_linenumber", "along", "d"),
    "geo_ellipse_project": lambda s, d: rounded(G.to_ellipse(points(s, d), (25.0, 40.0), (20.0, 30.0), 0.4), "along", "d").select("l_orderkey", "l_linenumber", "along", "d"),
    "geo_graph_distance": lambda s, d: rounded(graph_pairs(s, d), "distance").select("event_id", "distance"),
}

PT = "p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, row_number() OVER () AS id FROM lineitem)"
ES = "e(k, x0, y0, dx, dy, n, t) AS (VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in e) + ")" for e in G.edges(PATH)) + ")"
PS = "e(k, x0, y0, dx, dy, n, t) AS (VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in e) + ")" for e in G.edges(G.closed(POLY))) + ")"
M = STACK.matrix.tolist()
GD, _ = G.floyd_warshall(np.array([[0, 10, 0, 30], [10, 0, 20, 12], [0, 20, 0, 15], [30, 12, 15, 0]]))
ND = "nd(a, b, la, lb, w00, w01, w10, w11) AS (VALUES " + ", ".join(f"({a}, {b}, {LENGTHS[a]}, {LENGTHS[b]}, {GD[ENDS[a][0], ENDS[b][0]]}, {GD[ENDS[a][0], ENDS[b][1]]}, {GD[ENDS[a][1], ENDS[b][0]]}, {GD[ENDS[a][1], ENDS[b][1]]})" for a in range(5) for b in range(5)) + ")"

ORACLE_SQL = {
    "geo_polyline_project": f"WITH {PT}, {ES}, s AS (SELECT p.*, k, x0, y0, dx, dy, n, t, least(greatest(((x - x0) * dx + (y - y0) * dy) / n, 0), n) AS s FROM p, e), q AS (SELECT *, x0 + s * dx / n AS px, y0 + s * dy / n AS py FROM s), d AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS ad FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(ad, 12), k) AS r FROM d) SELECT l_orderkey, l_linenumber, k AS edge, round(CASE WHEN dx * (y - y0) - (x - x0) * dy < 0 THEN -ad ELSE ad END, 6) AS d, round(px, 6) AS px, round(py, 6) AS py, round(s + t, 6) AS along FROM r WHERE r = 1",
    "geo_path_point": f"WITH {ES}, v AS (SELECT event_id, value AS a FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k) AS r FROM v JOIN e ON a >= t AND a - t <= n) SELECT event_id, k AS edge, round(x0 + (a - t) * dx / n, 6) AS x, round(y0 + (a - t) * dy / n, 6) AS y, round(atan2(dy, dx), 6) AS tangent FROM r WHERE r = 1",
    "geo_inpoly": f"WITH {PT}, {PS} SELECT l_orderkey, l_linenumber, sum(CASE WHEN y0 <= y AND y0 + dy > y AND dx * (y - y0) - (x - x0) * dy > 0 THEN 1 WHEN y0 > y AND y0 + dy <= y AND dx * (y - y0) - (x - x0) * dy < 0 THEN -1 ELSE 0 END) <> 0 AS inside FROM p, e GROUP BY id, l_orderkey, l_linenumber",
    "geo_in_ellipse": f"WITH {PT} SELECT l_orderkey, l_linenumber, ((x - 25.0) / 20.0) * ((x - 25.0) / 20.0) + ((y - 40.0) / 30.0) * ((y - 40.0) / 30.0) <= 1 AS inside FROM p",
    "geo_area": f"WITH {PT}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT l_orderkey, round(CASE WHEN count(*) > 2 THEN sum(x * ny - nx * y) / 2 ELSE 0 END, 7) AS area FROM n GROUP BY l_orderkey",
    "geo_bounding_box": f"WITH {PT} SELECT l_orderkey, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM p GROUP BY l_orderkey",
    "geo_transform": f"WITH {PT} SELECT l_orderkey, l_linenumber, round({M[0][0]!r}::DOUBLE * x + {M[0][1]!r}::DOUBLE * y + {M[0][2]!r}::DOUBLE, 5) AS u, round({M[1][0]!r}::DOUBLE * x + {M[1][1]!r}::DOUBLE * y + {M[1][2]!r}::DOUBLE, 5) AS v FROM p",
    "geo_transform_inverse": f"WITH {PT} SELECT l_orderkey, l_linenumber, round(x, 5) AS u FROM p",
    "geo_loop_distance": "WITH v AS (SELECT event_id, 33.0 - value + 60.0 AS a FROM events) SELECT event_id, round(a - floor(a / 120.0) * 120.0 - 60.0, 6) AS distance FROM v",
    "geo_circle_project": f"WITH {PT}, a AS (SELECT *, atan2(y - 40.0, x - 25.0) AS a, sqrt((x - 25.0) * (x - 25.0) + (y - 40.0) * (y - 40.0)) AS r FROM p) SELECT l_orderkey, l_linenumber, round((CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END) * 20.0, 6) AS along, round(r - 20.0, 6) AS d FROM a",
    "geo_graph_distance": f"WITH {ND}, v AS (SELECT event_id, event_id % 5 AS a, value - floor(value / 10.0) * 10.0 AS sa, user_id % 5 AS b, value * 3 - floor(value * 3 / 9.0) * 9.0 AS sb FROM events) SELECT event_id, round(least(sa + w00 + sb, sa + w01 + lb - sb, la - sa + w10 + sb, la - sa + w11 + lb - sb, CASE WHEN v.a = v.b THEN abs(sb - sa) END), 6) AS distance FROM v JOIN nd USING (a, b)",
}
