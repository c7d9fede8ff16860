"""Queries of mixtures of full covariance, merging variants and spectral intervals: vectors and signals as in the other queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density as D
from ..operators import signals as G
from ..operators import spectral as Q
from ..sources import tables as T
from .decoding import CTE, VAR, components, samples_of_sources, vectors
from .events import rounded


def matched(spark: SparkSession, d: str) -> DataFrame:
    """One component of full covariance for each source, over the first two elements."""
    cov = F.array(*[F.array(*[F.lit(VAR[0] if i == j else 0.0) for j in (0, 1)]) for i in (0, 1)])
    flat = components(spark, d).select("source", "weight", F.slice("mean", 1, 2).alias("mean"), cov.alias("cov"))
    return D.moment_match_full(flat, ["source"], [0, 1])


def two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Windows of the views' and of the clicks' signals."""
    own = lambda name: G.windows(T.signal(spark, d), 128, 64).filter(F.col("channel") == name)
    return own("view"), own("click")


def hellinger(spark: SparkSession, d: str) -> DataFrame:
    """Unscented distances of sources' matched components to the first one's; a component a source."""
    rows = [(r["source"], np.array(r["mean"]), np.array(r["cov"])) for r in matched(spark, d).orderBy("source").collect()]
    of = lambda r: (np.ones(1), r[1][None], r[2][None])
    return spark.createDataFrame([(int(r[0]), round(D.unscented_hellinger(of(rows[0]), of(r)), 6)) for r in rows], "source int, distance double")


QUERIES = {
    "dens_moment_match_full": lambda s, d: matched(s, d).select("source", F.round("weight", 6).alias("weight"), F.round(F.col("mean")[0], 6).alias("m0"), F.round(F.col("mean")[1], 6).alias("m1"), F.round(F.col("cov")[0][0], 6).alias("c00"), F.round(F.col("cov")[0][1], 6).alias("c01"), F.round(F.col("cov")[1][1], 6).alias("c11")),
    "dens_eval_full": lambda s, d: rounded(D.evaluate_full(vectors(s, d), D.with_factors(matched(s, d)), [0, 1]).select("id", "density"), "density"),
    "dens_eval_marginal": lambda s, d: rounded(D.evaluate(vectors(s, d).withColumn("x", F.slice("x", 3, 1)), D.marginalize(components(s, d), [2]), [0], 72.0).select("id", "density"), "density", places=8),
    "dens_subtract": lambda s, d: D.without_components(components(s, d), components(s, d).filter(F.col("mean")[0] > 0)).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    "dens_unscented": hellinger,
    "mix_merge_full": lambda s, d: D.merge_samples(samples_of_sources(s, d), VAR, [0, 1, 2], 1.0, "full").select("source", "comp_id", F.round("weight", 9).alias("weight")),
    "mix_merge_constant": lambda s, d: D.merge_samples(samples_of_sources(s, d), VAR, [0, 1, 2], 1.0, "constant").select("source", "comp_id", F.round("weight", 9).alias("weight")),
    "mix_curve": lambda s, d: D.merge_curve(samples_of_sources(s, d), VAR, [0, 1, 2], 1.0, 200),
    "mix_sparsify": lambda s, d: D.sparsify(samples_of_sources(s, d), [0, 1], 0.1).select("source", "comp_id", "weight"),
    "spec_gram": lambda s, d: rounded(Q.spectrogram(G.windows(T.signal(s, d), 128, 64), 1.0), "power"),
    "spec_errors": lambda s, d: rounded(Q.spectrum_errors(G.windows(T.signal(s, d), 128, 64), 1.0), "power", "low", "high"),
    "spec_errors_jackknife": lambda s, d: rounded(Q.spectrum_errors(G.windows(T.signal(s, d), 128, 64), 1.0, kind="jackknife"), "power", "low", "high"),
    "spec_coherogram": lambda s, d: rounded(Q.coherogram(*two(s, d), 1.0), "coherence", "phase", "level", "phase_std"),
    "sig_reconstruct": lambda s, d: rounded(Q.reconstruct(T.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("u"), F.col("l_tax").alias("v")), ["u", "v"], np.array([[2.0, 1.0], [0.5, -3.0]]), np.array([1.0, 2.0]), ["a", "b"]).select("l_orderkey", "l_linenumber", "a", "b"), "a", "b"),
}

FULL = "mf AS (SELECT source, sum(w) AS weight, sum(w * ma) / sum(w) AS m0, sum(w * mb) / sum(w) AS m1, sum(w * (0.01 + ma * ma)) / sum(w) - pow(sum(w * ma) / sum(w), 2) AS c00, sum(w * ma * mb) / sum(w) - sum(w * ma) / sum(w) * sum(w * mb) / sum(w) AS c01, sum(w * (0.01 + mb * mb)) / sum(w) - pow(sum(w * mb) / sum(w), 2) AS c11 FROM comp GROUP BY source)"
ORACLE_SQL = {
    "dens_moment_match_full": f"WITH {CTE}, {FULL} SELECT source, round(weight, 6) AS weight, round(m0, 6) AS m0, round(m1, 6) AS m1, round(c00, 6) AS c00, round(c01, 6) AS c01, round(c11, 6) AS c11 FROM mf",
    "dens_eval_full": f"WITH {CTE}, {FULL}, q AS (SELECT v.id, weight, c00 * c11 - c01 * c01 AS det, ((a - m0) * (a - m0) * c11 - 2 * (a - m0) * (b - m1) * c01 + (b - m1) * (b - m1) * c00) / (c00 * c11 - c01 * c01) AS q FROM v JOIN mf USING (source)) SELECT id, round(sum(CASE WHEN q <= 16 THEN weight * exp(-q / 2) / (2 * pi() * sqrt(det)) ELSE 0 END), 6) AS density FROM q GROUP BY id",
    "dens_eval_marginal": f"WITH {CTE}, q AS (SELECT te.id, w, (te.c - mc) * (te.c - mc) / 72.25 AS q FROM te JOIN comp USING (source)) SELECT id, round(sum(CASE WHEN q <= 16 THEN w / sqrt(72.25 * (2 * pi())) * exp(-q / 2) ELSE 0 END), 8) AS density FROM q GROUP BY id",
    "dens_subtract": f"WITH {CTE} SELECT source, count(*) AS n FROM comp WHERE NOT ma > 0 GROUP BY source",
    "sig_reconstruct": "SELECT l_orderkey, l_linenumber, round(1.0 + 2.0 * l_quantity + l_tax, 6) AS a, round(2.0 + 0.5 * l_quantity - 3.0 * l_tax, 6) AS b FROM lineitem",
}
