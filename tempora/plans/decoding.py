"""Queries of densities and decoding: vectors are spikes of their label's source, all of them both samples and what is decoded; the third element is the position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decoding as C
from ..operators import density as D
from ..sources import tables as T
from .events import rounded

GRID = [-52.5 + 5.0 * k for k in range(22)]
VAR = [0.01, 0.01, 72.25]
OPTIONS = C.Options(offset=1e-6)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "embeddings")
    x = F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), F.col("embedding")[2].cast("double") * 100)
    return e.select(F.col("label").alias("source"), F.col("vec_id").alias("id"), x.alias("x"), F.floor(F.col("vec_id") / 25).alias("bin"))


def components(spark: SparkSession, d: str) -> DataFrame:
    return D.samples_to_components(vectors(spark, d), VAR, [0, 1, 2])


def posterior(spark: SparkSession, d: str) -> DataFrame:
    behavior = vectors(spark, d).select(F.col("x")[2].alias("x"))
    return C.posterior(vectors(spark, d), components(spark, d), behavior, vectors(spark, d).select("bin").distinct(), GRID, [0, 1], 2, 500.0, OPTIONS, 0.25, 0.8)


def truth(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).groupBy("bin").agg(F.avg(F.col("x")[2]).alias("x"))


def samples_of_sources(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("source", "id", "x")


QUERIES = {
    "dens_eval": lambda s, d: rounded(D.evaluate(vectors(s, d), components(s, d), [0, 1, 2], 0.8).select("id", "density"), "density", places=8),
    "dens_marginal": lambda s, d: rounded(D.on_grid(D.marginalize(components(s, d), [2]), GRID), "density", places=9),
    "dens_moment_match": lambda s, d: D.moment_match(components(s, d), ["source"], [0, 1, 2]).select("source", F.round("weight", 6).alias("weight"), *[F.round(F.col("mean")[k], 6).alias(f"m{k}") for k in range(3)], *[F.round(F.col("var")[k], 5).alias(f"v{k}") for k in range(3)]),
    "dens_mixed": lambda s, d: rounded(D.mixed_density(vectors(s, d), vectors(s, d).select("source", F.col("x").alias("y"), F.lit(1.0).alias("weight")), [("gaussian", 0.1), ("epanechnikov", 0.4), ("vonmises", 2.0)], 0.8), "value", places=8),
    "dens_distances": lambda s, d: rounded(
        components(s, d).alias("a").join(D.moment_match(components(s, d), ["source"], [0, 1, 2]).alias("b"), "source").select("comp_id", D.hellinger(F.col("a.mean"), F.col("a.var"), F.col("b.mean"), F.col("b.var"), [0, 1]).alias("hellinger"), D.kullback_leibler(F.col("b.mean"), F.col("b.var"), F.col("a.mean"), F.col("a.var"), [0, 1]).alias("divergence")), "hellinger", "divergence"
    ),
    "dec_occupancy": lambda s, d: rounded(C.occupancy(vectors(s, d).select(F.col("x")[2].alias("x")), GRID, 8.5), "pix", places=9),
    "dec_rates": lambda s, d: rounded(C.rates(components(s, d), vectors(s, d).select(F.col("x")[2].alias("x")), GRID, 8.5, 2, 500.0, 1e-6).select("source", "g", "mu", "lx"), "mu", "lx"),
    "dec_posterior": lambda s, d: rounded(posterior(s, d), "logp", "p").select("bin", "g", "x", "logp", "p"),
    "dec_error": lambda s, d: rounded(C.errors(posterior(s, d), truth(s, d)), "error", "decoded"),
    "dec_attach": lambda s, d: rounded(C.attach(T.train(s, d, "purchase").select("event_id", "t"), T.train(s, d, "view").select("t", F.col("mark").alias("linear_position"))), "linear_position").select("event_id", "linear_position"),
    "mix_compress": lambda s, d: D.compress(D.samples_to_components(samples_of_sources(s, d), VAR, [0, 1, 2]), 0.5).select("source", "comp_id", F.round("weight", 9).alias("weight")),
    "mix_merge": lambda s, d: D.merge_samples(samples_of_sources(s, d), VAR, [0, 1, 2], 1.0).select("source", "comp_id", F.round("weight", 9).alias("weight")),
}

CTE = """v AS (SELECT label AS source, vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE * 100 AS c, vec_id // 25 AS bin FROM embeddings),
n AS (SELECT source, count(*) AS n FROM v GROUP BY source),
comp AS (SELECT source, id AS comp_id, 1 / n AS w, a AS ma, b AS mb, c AS mc FROM v JOIN n USING (source)),
te AS (SELECT * FROM v),
gr AS (SELECT g::INTEGER AS g, -52.5 + 5.0 * g AS x FROM range(22) r(g)),
pi0 AS (SELECT gr.g, any_value(gr.x) AS x, coalesce(sum(1 / (SELECT count(*) FROM comp) / sqrt(72.25 * (2 * pi())) * exp(-(gr.x - mc) * (gr.x - mc) / 72.25 / 2)) FILTER (WHERE (gr.x - mc) * (gr.x - mc) / 72.25 <= 16), 0) AS p FROM gr, comp GROUP BY gr.g),
px AS (SELECT g, x::DOUBLE AS x, p + (SELECT avg(p) FROM pi0) / 12 AS pix FROM pi0),
mg AS (SELECT source, g, sum(w / sqrt(72.25 * (2 * pi())) * exp(-(gr.x - mc) * (gr.x - mc) / 72.25 / 2)) AS density FROM comp, gr WHERE (gr.x - mc) * (gr.x - mc) / 72.25 <= 16 GROUP BY source, g),
mu AS (SELECT source, count(*) / 500.0::DOUBLE AS mu FROM comp GROUP BY source),
lx AS (SELECT mu.source, px.g, mu, pix, mu * coalesce(density, 0) / pix + 1e-6 AS lx FROM mu CROSS JOIN px LEFT JOIN mg ON mg.source = mu.source AND mg.g = px.g),
sg AS (SELECT te.id, te.bin, te.source, g, sum(w / sqrt(0.01 * (2 * pi()) * (0.01 * (2 * pi())) * (72.25 * (2 * pi()))) * exp(-q / 2)) AS pax FROM (SELECT te.id, te.bin, te.source, g, w, (te.a - ma) * (te.a - ma) / 0.01 + (te.b - mb) * (te.b - mb) / 0.01 + (gr.x - mc) * (gr.x - mc) / 72.25 AS q FROM te JOIN comp USING (source), gr) te WHERE q <= 16 GROUP BY ALL),
ll AS (SELECT te.bin, lx.g, sum(ln(coalesce(pax, 0) + 1e-6 * pix / mu)) AS ll, count(*) AS n FROM te JOIN lx USING (source) LEFT JOIN sg ON sg.id = te.id AND sg.g = lx.g GROUP BY te.bin, lx.g),
tot AS (SELECT g, sum(lx) AS total FROM lx GROUP BY g),
lp AS (SELECT b.bin, px.g, px.x, coalesce(ll, 0) - coalesce(n, 0) * ln(pix) - 0.25 * total AS logp FROM (SELECT DISTINCT bin FROM v) b CROSS JOIN px JOIN tot USING (g) LEFT JOIN ll ON ll.bin = b.bin AND ll.g = px.g),
po AS (SELECT bin, g, x, logp, exp(logp - max(logp) OVER (PARTITION BY bin)) AS e FROM lp)"""
MM = "mm AS (SELECT source, sum(w) AS weight, sum(w * ma) / sum(w) AS m0, sum(w * mb) / sum(w) AS m1, sum(w * mc) / sum(w) AS m2, sum(w * (0.01 + ma * ma)) / sum(w) - pow(sum(w * ma) / sum(w), 2) AS v0, sum(w * (0.01 + mb * mb)) / sum(w) - pow(sum(w * mb) / sum(w), 2) AS v1, sum(w * (72.25 + mc * mc)) / sum(w) - pow(sum(w * mc) / sum(w), 2) AS v2 FROM comp GROUP BY source)"

ORACLE_SQL = {
    "dens_eval": f"WITH {CTE}, q AS (SELECT te.id, w, (te.a - ma) * (te.a - ma) / 0.01 + (te.b - mb) * (te.b - mb) / 0.01 + (te.c - mc) * (te.c - mc) / 72.25 AS q FROM te JOIN comp USING (source)) SELECT te.id, round(coalesce(sum(w / sqrt(0.01 * (2 * pi()) * (0.01 * (2 * pi())) * (72.25 * (2 * pi()))) * exp(-q / 2)), 0), 8) AS density FROM te LEFT JOIN q ON q.id = te.id AND q <= 16 GROUP BY te.id",
    "dens_marginal": f"WITH {CTE} SELECT source, g, round(density, 9) AS density FROM mg",
    "dens_moment_match": f"WITH {CTE}, {MM} SELECT source, round(weight, 6) AS weight, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2, round(v0, 5) AS v0, round(v1, 5) AS v1, round(v2, 5) AS v2 FROM mm",
    "dens_mixed": f"WITH {CTE}, k AS (SELECT source, te.id, (te.a - ma) / 0.1 AS u, (te.b - mb) / 0.4 AS z, exp(2.0 * cos(te.c - mc)) AS m FROM te JOIN comp USING (source)) SELECT k.source, id, round(sum(CASE WHEN u * u <= 16 AND z * z <= 1 THEN exp(-u * u / 2) * (1 - z * z) * m ELSE 0 END) / any_value(n), 8) AS value FROM k JOIN n USING (source) WHERE abs(u) <= 4 GROUP BY k.source, id",
    "dens_distances": f"WITH {CTE}, {MM} SELECT comp_id, round(sqrt(greatest(0, 1 - sqrt(2 * sqrt(0.01 * v0) / (0.01 + v0)) * exp(-(ma - m0) * (ma - m0) / (4 * (0.01 + v0))) * sqrt(2 * sqrt(0.01 * v1) / (0.01 + v1)) * exp(-(mb - m1) * (mb - m1) / (4 * (0.01 + v1))))), 6) AS hellinger, round((ln(v0 / 0.01) + 0.01 / v0 + (ma - m0) * (ma - m0) / v0 - 1 + ln(v1 / 0.01) + 0.01 / v1 + (mb - m1) * (mb - m1) / v1 - 1) / 2, 6) AS divergence FROM comp JOIN mm USING (source)",
    "dec_occupancy": f"WITH {CTE} SELECT g, x, round(pix, 9) AS pix FROM px",
    "dec_rates": f"WITH {CTE} SELECT source, g, round(mu, 6) AS mu, round(lx, 6) AS lx FROM lx",
    "dec_posterior": f"WITH {CTE} SELECT bin, g, x, round(logp, 6) AS logp, round(e / sum(e) OVER (PARTITION BY bin), 6) AS p FROM po",
    "dec_error": f"WITH {CTE}, best AS (SELECT bin, x, row_number() OVER (PARTITION BY bin ORDER BY logp DESC, g) AS r FROM po), tr AS (SELECT bin, avg(c) AS t FROM te GROUP BY bin) SELECT best.bin, x AS decoded, round(abs(x - t), 6) AS error FROM best JOIN tr USING (bin) WHERE r = 1",
    "dec_attach": "WITH ev AS (SELECT event_id, event_type AS train, epoch_us(ts) / 1e6 - 1704067200 AS t, value AS mark FROM events), v AS (SELECT t, mark FROM ev WHERE train = 'view'), p AS (SELECT event_id, t FROM ev WHERE train = 'purchase'), lo AS (SELECT p.*, v.t AS t0, v.mark AS v0 FROM p ASOF JOIN v ON p.t >= v.t), hi AS (SELECT lo.*, v.t AS t1, v.mark AS v1 FROM lo ASOF JOIN v ON lo.t <= v.t) SELECT event_id, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS linear_position FROM hi",
}
