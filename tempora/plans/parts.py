"""Queries of operators that the others don't call: slices, seeded draws, measures of shapes, packed points, stretches of running."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import decoding as C
from ..operators import geometry as G
from ..operators import segments as S
from ..sources import records as R
from ..sources import tables as T
from .events import rounded
from .geometry import ENDS, LENGTHS
from .segments import EV, SEGS, a, b, merged

NODES = 4


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user."""
    return T.events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest ways between the nodes that an event's numbers name."""
    import numpy as np

    w = np.zeros((NODES, NODES))
    for (i, j), x in zip(ENDS, LENGTHS, strict=True):
        w[i, j] = w[j, i] = x
    table = spark.createDataFrame([(i, j, *(lambda r: (r[0], len(r[1])))(G.shortest_path(w, i, j))) for i in range(NODES) for j in range(NODES)], "a int, b int, distance double, n_nodes int")
    asked = T.events(spark, d).select("event_id", (F.col("user_id") % NODES).cast("int").alias("a"), (F.col("event_id") % NODES).cast("int").alias("b"))
    return asked.join(table, ["a", "b"]).select("event_id", "distance", "n_nodes")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers k, u and v of each supplier."""
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 23).cast("int").alias("u"), F.col("s_nationkey").cast("int").alias("v"))


def nodes_about(spark: SparkSession, d: str, nodes: G.Nodes, size: Column) -> DataFrame:
    """A shape's nodes, scaled by size, about each supplier's place (u, v)."""
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in nodes])
    rows = suppliers(spark, d).select("k", "u", "v", size.alias("r"), F.posexplode(points).alias("node", "p"))
    return rounded(rows.select("k", "node", (F.col("u") + F.col("r") * F.col("p.x")).alias("x"), (F.col("v") + F.col("r") * F.col("p.y")).alias("y")), "x", "y")


def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pixels of each supplier's line from (u, 3) to (v, k modulo 17)."""
    for f in frames:
        yield pd.DataFrame([(k, i, x, y) for k, u, v in zip(f["k"], f["u"], f["v"], strict=True) for i, (x, y) in enumerate(G.bresenham(u, 3, v, k % 17))], columns=["k", "i", "x", "y"])


def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Area and length of each supplier's ellipse, of axes 1 + u and 5 + v."""
    for f in frames:
        yield pd.DataFrame([(k, G.ellipse_area(1.0 + u, 5.0 + v), G.ellipse_length(1.0 + u, 5.0 + v)) for k, u, v in zip(f["k"], f["u"], f["v"], strict=True)], columns=["k", "area", "length"])


def running(spark: SparkSession, d: str) -> DataFrame:
    v = T.signal(spark, d).filter("channel = 'view'")
    return C.train_segments(v.select("i", "t", F.col("v").alias("speed")), 30.0, 600.0)


def word(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("event_id") % 4096, F.col("user_id") % 4096
    return T.events(spark, d).select("event_id", F.array((x + 1).bitwiseAND(4095) + F.shiftleft(y, 16) + F.shiftleft(F.lit(1).cast("long"), 28), F.lit(0).cast("long"), x.bitwiseAND(4095) + F.lit(1 << 12)).alias("w"))


QUERIES = {
    "fn_blocks": lambda s, d: counts(s, d).select("user_id", F.explode(X.blocks(F.col("n"), 7)).alias("p")).select("user_id", "p.start", F.col("p.n").alias("size")),
    "fn_slices": lambda s, d: counts(s, d).select("user_id", F.explode(X.slices(F.col("n"), 5, 1, 3)).alias("p")).select("user_id", "p.start", F.col("p.stop").alias("stop")),
    "fn_slices_strict": lambda s, d: counts(s, d).select("user_id", F.explode(X.slices(F.col("n"), 5, 1, 3, True)).alias("p")).select("user_id", "p.start", F.col("p.stop").alias("stop")),
    "fn_video_points": lambda s, d: word(s, d).select("event_id", F.posexplode(R.video_points(F.col("w"))).alias("k", "p")).select("event_id", "k", *[F.col("p." + c).cast("long").alias(c) for c in ("x", "y", "low", "high")]),
    "fn_next_pow2": lambda s, d: counts(s, d).select("user_id", "n", X.next_pow2_of(F.col("n")).alias("p")),
    "seg_random_draws": lambda s, d: rounded(S.uniform_random(a(s, d), 400, 3), "t", places=4),
    "seg_equal": lambda s, d: s.createDataFrame([(S.equal(a(s, d), a(s, d)), S.equal(a(s, d), b(s, d)))], "same boolean, other boolean"),
    "geo_ellipse_measures": lambda s, d: rounded(suppliers(s, d).mapInPandas(measured, "k long, area double, length double"), "area", "length"),
    "geo_ngon": lambda s, d: nodes_about(s, d, G.ngon(7), 1.0 + F.col("k") % 5),
    "geo_rectangle": lambda s, d: nodes_about(s, d, G.rectangle((0.0, 0.0), 4.0, 2.0, 0.5), F.lit(1.0)),
    "geo_shortest_path": paths,
    "geo_line_pixels": lambda s, d: suppliers(s, d).mapInPandas(lines, "k long, i int, x int, y int"),
    "dec_train_segments": lambda s, d: rounded(running(s, d).select("start", "stop"), "start", "stop", places=4),
    "dec_included_sources": lambda s, d: C.included_sources(T.events(s, d).select(F.col("user_id").alias("source"), "event_id"), 12).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    "ev_event_times": lambda s, d: rounded(R.event_times(T.events(s, d).withColumnRenamed("train", "eventstring"), "signup"), "t", places=4),
    "ev_timeslice": lambda s, d: R.timeslice(T.events(s, d), 1000.0, 90000.0).select("event_id"),
}

CORNERS = "(VALUES (0, -2.0::DOUBLE, -1.0::DOUBLE), (1, 2, -1), (2, 2, 1), (3, -2, 1)) c(node, u, v)"
SUP = "su AS (SELECT s_suppkey AS k, s_suppkey % 23 AS u, s_nationkey AS v FROM supplier)"
#: Squares of the binomial coefficients of a half: an ellipse's length by powers of ((a - b) / (a + b)) ** 2.
HALVES = [math.prod((1.5 - j) / j for j in range(1, k + 1)) ** 2 for k in range(90)]
LINKS = "e(a, b, w) AS (VALUES " + ", ".join(f"({i}, {j}, {x}::DOUBLE), ({j}, {i}, {x}::DOUBLE)" for (i, j), x in zip(ENDS, LENGTHS, strict=True)) + ")"
ORACLE_SQL = {
    "fn_blocks": "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, s AS start, least(7, n - s) AS size FROM (SELECT user_id, n, unnest(range(0, n, 7)) AS s FROM c)",
    "fn_slices": "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, s AS start, least(s + 5, n) AS stop FROM (SELECT user_id, n, unnest(range(1, n, 3)) AS s FROM c)",
    "fn_slices_strict": "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, s AS start, s + 5 AS stop FROM (SELECT user_id, n, unnest(range(1, n, 3)) AS s FROM c) WHERE s + 5 <= n",
    "fn_video_points": "SELECT event_id, 0 AS k, (event_id % 4096 + 1) & 4095 AS x, user_id % 4096 AS y, 0::BIGINT AS low, 1::BIGINT AS high FROM events UNION ALL SELECT event_id, 1 AS k, event_id % 4096 AS x, 0 AS y, 1 AS low, 0 AS high FROM events",
    "fn_next_pow2": "SELECT user_id, n, (SELECT min(p) FROM range(62) r(p) WHERE 1::BIGINT << p >= n)::INTEGER AS p FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)",
    "seg_random_draws": f"WITH {SEGS}, {merged('m', 'SELECT start, stop FROM a')}, l AS (SELECT start, sum(stop - start) OVER (ORDER BY start ROWS UNBOUNDED PRECEDING) AS hi, stop - start AS n FROM m), u AS (SELECT id, (('0x' || substr(md5('3|' || id), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE) * (SELECT max(hi) FROM l) AS u FROM range(400) r(id)) SELECT id, round(start + u - (hi - n), 4) AS t FROM u JOIN l ON u >= hi - n AND u < hi",
    "seg_equal": f"WITH {SEGS}, x AS (SELECT start, stop FROM a EXCEPT ALL SELECT start, stop FROM a), y AS (SELECT start, stop FROM a EXCEPT ALL SELECT start, stop FROM b), z AS (SELECT start, stop FROM b EXCEPT ALL SELECT start, stop FROM a) SELECT (SELECT count(*) FROM x) = 0 AS same, (SELECT count(*) FROM y) + (SELECT count(*) FROM z) = 0 AS other",
    "geo_ngon": f"WITH {SUP} SELECT k, j::INTEGER AS node, round(u + (1 + k % 5) * cos(2 * pi() * j / 7), 6) AS x, round(v + (1 + k % 5) * sin(2 * pi() * j / 7), 6) AS y FROM su, range(7) r(j)",
    "geo_rectangle": f"WITH {SUP} SELECT su.k, node, round(su.u + c.u * cos(0.5) - c.v * sin(0.5), 6) AS x, round(su.v + c.u * sin(0.5) + c.v * cos(0.5), 6) AS y FROM su, {CORNERS}",
    "geo_shortest_path": f"WITH RECURSIVE {LINKS}, p(a, b, d, n) AS (SELECT a, a, 0::DOUBLE, 1 FROM (SELECT DISTINCT a FROM e) UNION ALL SELECT p.a, e.b, p.d + e.w, p.n + 1 FROM p JOIN e ON e.a = p.b WHERE p.n < 5), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d, n) AS r FROM p) SELECT event_id, d AS distance, n AS n_nodes FROM events JOIN r ON user_id % 4 = a AND event_id % 4 = b WHERE r = 1",
    "geo_ellipse_measures": f"WITH {SUP}, c AS (SELECT unnest({HALVES!r}::DOUBLE[]) AS c, unnest(range({len(HALVES)})) AS j), x AS (SELECT k, 1.0::DOUBLE + u AS a, 5.0::DOUBLE + v AS b FROM su) SELECT k, round(pi() * any_value(a) * any_value(b), 6) AS area, round(pi() * any_value(a + b) * sum(c * pow((a - b) / (a + b), 2 * j)), 6) AS length FROM x, c GROUP BY k",
    "geo_line_pixels": f"""WITH RECURSIVE {SUP}, p(k, i, x, y, x1, y1, dx, dy, err) AS (SELECT k, 0, u::INTEGER, 3, v::INTEGER, (k % 17)::INTEGER, abs(v - u)::INTEGER, -abs(k % 17 - 3)::INTEGER, (abs(v - u) - abs(k % 17 - 3))::INTEGER FROM su
UNION ALL SELECT k, i + 1, x + CASE WHEN 2 * err >= dy THEN sign(x1 - x) ELSE 0 END::INTEGER, y + CASE WHEN 2 * err <= dx THEN sign(y1 - y) ELSE 0 END::INTEGER, x1, y1, dx, dy, err + CASE WHEN 2 * err >= dy THEN dy ELSE 0 END + CASE WHEN 2 * err <= dx THEN dx ELSE 0 END FROM p WHERE x <> x1 OR y <> y1) SELECT k, i, x, y FROM p""",
    "dec_train_segments": f"WITH {EV}, sg AS (SELECT t, mark AS v, row_number() OVER (ORDER BY t, event_id) - 1 AS i FROM ev WHERE train = 'view'), r AS (SELECT t, i - row_number() OVER (ORDER BY i) AS g FROM sg WHERE v > 30), x AS (SELECT min(t) AS start, max(t) AS stop FROM r GROUP BY g) SELECT round(start, 4) AS start, round(stop, 4) AS stop FROM x WHERE stop - start >= 600",
    "dec_included_sources": "SELECT user_id AS source, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 12",
    "ev_event_times": f"WITH {EV} SELECT round(t, 4) AS t FROM ev WHERE train = 'signup'",
    "ev_timeslice": f"WITH {EV} SELECT event_id FROM ev WHERE t BETWEEN 1000.0 AND 90000.0",
}
