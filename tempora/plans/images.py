"""Queries of lines through images: each event type's hours of day by 24 value classes, counting events."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import radon as R
from ..operators import signals as G
from ..sources import tables as T
from .events import rounded
from .segments import EV

N = 24
THETAS = np.array([math.pi * (k + 0.5) / 12 for k in range(12)])
RHOS = np.array([-16.0 + k for k in range(33)])


def images(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.floor(F.pmod(F.col("t"), F.lit(86400.0)) / 3600.0).cast("int"), F.least(F.floor(F.col("mark") / 10.0), F.lit(N - 1)).cast("int")
    return T.events(spark, d).groupBy("train", x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def run(**how):
    return lambda s, d: rounded(R.radon(images(s, d), ["train"], N, N, THETAS, RHOS, R.Lines(**how)), "value")


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    """All pixels of each image, smoothed along x and then along y."""
    every = T.events(spark, d).select("train").distinct().join(spark.range(N * N).select(F.floor(F.col("id") / N).cast("int").alias("x"), (F.col("id") % N).cast("int").alias("y")))  # 576 rows a train
    full = every.join(images(spark, d), ["train", "x", "y"], "left").select("train", "x", "y", F.coalesce("v", F.lit(0.0)).alias("v"))
    return G.smooth(G.smooth(full, "gaussian", 1.0, axis="x", keys=("train", "y")), "triangular", 3.0, axis="y", keys=("train", "x"))


QUERIES = {
    "img_radon_x": run(axis="x"),
    "img_radon_linear": run(axis="x", interpolation="linear", method="mean"),
    "img_radon_integral": run(interpolation="linear", method="integral"),
    "img_radon_padded": run(axis="x", method="mean", pad="mean"),
    "img_radon_constant": run(axis="x", pad=2.0),
    "img_slice": lambda s, d: rounded(R.radon_slice(images(s, d), ["train"], N, N, 1.2, 2.0, R.Lines(axis="x", interpolation="linear")), "value"),
    "img_slice_padded": lambda s, d: rounded(R.radon_slice(images(s, d), ["train"], N, N, 1.2, 9.0, R.Lines(axis="x", pad="mean")), "value"),
    "img_smooth_2d": lambda s, d: rounded(smoothed(s, d), "v").select("train", "x", "y", "v"),
}

IMG = f"{EV}, im AS (SELECT train, floor((t - floor(t / 86400.0) * 86400.0) / 3600.0)::INTEGER AS x, least(floor(mark / 10.0), 23)::INTEGER AS y, count(*)::DOUBLE AS v FROM ev GROUP BY 1, 2, 3), tr AS (SELECT DISTINCT train FROM ev), px AS (SELECT tr.train, a.x::INTEGER AS x, b.y::INTEGER AS y, coalesce(v, 0) AS v FROM tr, range(24) a(x), range(24) b(y) LEFT JOIN im ON im.train = tr.train AND im.x = a.x AND im.y = b.y)"
AT = "l AS (SELECT k::INTEGER AS theta, r::INTEGER AS rho, x::INTEGER AS x, (r - 16.0 - (x - 11.5) * cos(pi() * (k + 0.5) / 12)) / sin(pi() * (k + 0.5) / 12) + 11.5 AS pos FROM range(12) a(k), range(33) b(r), range(24) c(x))"
NEAR = f"WITH {IMG}, {AT}, m AS (SELECT train, x, avg(v) AS m FROM px GROUP BY train, x), q AS (SELECT tr.train, theta, rho, l.x, v FROM tr, l LEFT JOIN px ON px.train = tr.train AND px.x = l.x AND px.y = floor(pos + 0.5))"
LIN = "px.v * (1 - (pos - floor(pos))) + nx.v * (pos - floor(pos))"
ORACLE_SQL = {
    "img_radon_x": NEAR + " SELECT train, theta, rho, round(sum(v), 6) AS value FROM q WHERE v IS NOT NULL GROUP BY train, theta, rho",
    "img_radon_linear": f"WITH {IMG}, {AT} SELECT px.train, theta, rho, round(avg({LIN}), 6) AS value FROM l JOIN px ON px.x = l.x AND px.y = floor(pos) JOIN px nx ON nx.train = px.train AND nx.x = l.x AND nx.y = px.y + 1 WHERE pos >= 0 AND pos < 23 GROUP BY px.train, theta, rho",
    "img_radon_padded": NEAR + " SELECT q.train, theta, rho, round(avg(coalesce(v, m)), 6) AS value FROM q JOIN m ON m.train = q.train AND m.x = q.x GROUP BY q.train, theta, rho",
    "img_radon_constant": NEAR + " SELECT train, theta, rho, round(sum(coalesce(v, 2)), 6) AS value FROM q GROUP BY train, theta, rho",
    "img_slice": f"WITH {IMG}, l AS (SELECT x::INTEGER AS x, (2.0 - (x - 11.5) * cos(1.2::DOUBLE)) / sin(1.2::DOUBLE) + 11.5 AS pos FROM range(24) c(x)) SELECT px.train, l.x AS k, round({LIN}, 6) AS value FROM l JOIN px ON px.x = l.x AND px.y = floor(pos) JOIN px nx ON nx.train = px.train AND nx.x = l.x AND nx.y = px.y + 1 WHERE pos >= 0 AND pos < 23",
    "img_slice_padded": f"WITH {IMG}, l AS (SELECT x::INTEGER AS x, (9.0 - (x - 11.5) * cos(1.2::DOUBLE)) / sin(1.2::DOUBLE) + 11.5 AS pos FROM range(24) c(x)), m AS (SELECT train, x, avg(v) AS m FROM px GROUP BY train, x) SELECT m.train, m.x AS k, round(coalesce(v, m), 6) AS value FROM m JOIN l ON l.x = m.x LEFT JOIN px ON px.train = m.train AND px.x = m.x AND px.y = floor(pos + 0.5)",
}


def _weights(name: str, bandwidth: float) -> str:
    return "(VALUES " + ", ".join(f"({lag}, {w!r}::DOUBLE)" for lag, w in G.weights(name, bandwidth)) + ")"


ORACLE_SQL["img_smooth_2d"] = f"WITH {IMG}, a(d, w) AS {_weights('gaussian', 1.0)}, b(d, w) AS {_weights('triangular', 3.0)}, h AS (SELECT p.train, p.x, p.y, sum(w * s.v) AS v FROM px p, a JOIN px s ON s.train = p.train AND s.y = p.y AND s.x = p.x - a.d GROUP BY p.train, p.x, p.y) SELECT p.train, p.x, p.y, round(sum(w * s.v), 6) AS v FROM h p, b JOIN h s ON s.train = p.train AND s.x = p.x AND s.y = p.y - b.d GROUP BY p.train, p.x, p.y"
