"""Queries of significance tests, the online loop, spectra and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals as G
from ..operators import significance as P
from ..operators import spectral as Q
from ..operators import surrogates as R
from ..sources import tables as T
from ..streaming import online as O
from . import decoding as V
from .events import rounded
from .segments import EV
from .signals import SIG

STATES = np.abs(np.subtract.outer(V.GRID, V.GRID))


def bins(spark: SparkSession, d: str) -> DataFrame:
    """Events per quarter hour and user group: sessions of bins."""
    e = T.events(spark, d).select((F.col("user_id") % 4).cast("string").alias("session"), F.floor(F.col("t") / 3600.0).alias("bin"))
    return e.groupBy("session", "bin").agg(F.count(F.lit(1)).cast("double").alias("mua"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Gated bins with p made of their numbers."""
    return P.event_gate(bins(spark, d), 4.0, 2).withColumn("p", (F.pmod(F.col("bin") * 37, F.lit(100)) + 1) / 500.0)


def loop_bins(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood rows in sessions of twenty bins, with activity that rises twice in each."""
    v = V.vectors(spark, d)
    rows = R.likelihood_rows(v, V.components(spark, d), v.select(F.col("x")[2].alias("x")), V.GRID, [0, 1], 2, 500.0, V.OPTIONS, 0.25, 0.8)
    return rows.select(F.floor(F.col("bin") / 20).cast("string").alias("session"), "bin", (4.0 + (F.col("bin") % 10) * 2).alias("mua"), "pax", "own", "minus")


#: A ring that a few bins fill, as a session of these tables has few.
RULES = O.Rules(ring=500)


def online(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.assess_batch(loop_bins(spark, d), STATES, RULES), "p", "score")


def shuffle(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.shuffle_test(loop_bins(spark, d), STATES, RULES), "rwd", "p")


QUERIES = {
    "sig_event_gate": lambda s, d: P.event_gate(bins(s, d), 4.0, 2),
    "sig_low_activity": lambda s, d: P.low_activity(bins(s, d), 4, 2),
    "sig_score": lambda s, d: rounded(P.cumulative_score(scored(s, d)), "score").select("session", "bin", "score"),
    "sig_shuffle_test": shuffle,
    "online_loop": online,
    "spec_psd": lambda s, d: rounded(Q.spectrum(G.windows(T.signal(s, d), 128, 64), 1.0), "power"),
    "spec_coherence": lambda s, d: rounded(Q.coherence(G.windows(T.signal(s, d), 128, 64).filter("channel = 'view'"), G.windows(T.signal(s, d), 128, 64).filter("channel = 'click'"), 1.0), "coherence", "phase"),
    "spec_filter": lambda s, d: rounded(Q.apply_filter(T.signal(s, d), Q.kaiser_filter(None, 0.1, 1.0)), "v"),
    "spec_envelope": lambda s, d: rounded(Q.apply_envelope(T.signal(s, d), Q.kaiser_filter(0.1, 0.2, 1.0)), "v"),
    "boot_poisson": lambda s, d: rounded(Q.poisson_interval(T.events(s, d), "train", "mark", "event_id", samples=500), "estimate", "low", "high"),
    "boot_ci": lambda s, d: rounded(Q.bootstrap_interval(T.events(s, d), "train", "mark"), "low", "high"),
    "ev_explained_components": lambda s, d: s.createDataFrame([(Q.components_needed(T.table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 99.9),)], "n int"),
}

BINS = f"{EV}, bi AS (SELECT (user_id % 4)::VARCHAR AS session, floor(t / 3600.0)::BIGINT AS bin, count(*)::DOUBLE AS mua FROM ev GROUP BY 1, 2)"
GATE = f"{BINS}, r AS (SELECT *, sum((mua < 4)::INTEGER) OVER (PARTITION BY session ORDER BY bin) AS r FROM bi), g AS (SELECT session, bin, mua, mua >= 4 AND sum((mua >= 4)::INTEGER) OVER (PARTITION BY session, r ORDER BY bin) = 2 AS start FROM r)"

LOW_PASS = Q.kaiser_filter(None, 0.1, 1.0)
BOTH = np.correlate(LOW_PASS, LOW_PASS, "full").tolist()
REACH = len(LOW_PASS) - 1

ORACLE_SQL = {
    "spec_filter": f"""WITH {SIG}, n AS (SELECT channel, max(i) AS m, max(v) FILTER (WHERE i = 0) AS a FROM sg GROUP BY channel), b AS (SELECT n.*, v AS z FROM n JOIN sg ON sg.channel = n.channel AND i = m), w AS (SELECT unnest({BOTH!r}::DOUBLE[]) AS w, unnest(range(-{REACH}, {REACH + 1})) AS lag),
e AS (SELECT channel, i, w, i + lag AS e, m, a, z FROM sg JOIN b USING (channel), w), k AS (SELECT *, CASE WHEN e < 0 THEN -e WHEN e > m THEN 2 * m - e ELSE e END AS k FROM e)
SELECT k.channel, k.i, round(sum(w * CASE WHEN e < 0 THEN 2 * a - sg.v WHEN e > m THEN 2 * z - sg.v ELSE sg.v END), 6) AS v FROM k JOIN sg ON sg.channel = k.channel AND sg.i = k.k GROUP BY k.channel, k.i""",
    "sig_event_gate": f"WITH {GATE} SELECT * FROM g",
    "sig_low_activity": f"WITH {BINS}, r AS (SELECT *, sum((mua >= 4)::INTEGER) OVER (PARTITION BY session ORDER BY bin) AS r FROM bi) SELECT session, bin, mua, mua < 4 AS skipped, mua < 4 AND sum((mua < 4)::INTEGER) OVER (PARTITION BY session, r ORDER BY bin) >= 2 AS cleared FROM r",
    "sig_score": f"WITH {GATE}, p AS (SELECT *, (bin * 37 % 100 + 1) / 500.0::DOUBLE AS p FROM g), i AS (SELECT *, sum(start::INTEGER) OVER (PARTITION BY session ORDER BY bin) AS i FROM p) SELECT session, bin, round(sum(CASE WHEN p < 0.05 THEN -ln(p) ELSE 0 END) OVER (PARTITION BY session, i ORDER BY bin), 6) AS score FROM i",
}
