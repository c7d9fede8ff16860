"""Queries of sampled signals: each event type's values, numbered in time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals as G
from ..sources import tables as T
from .events import rounded
from .segments import EV, SEGS, WIDTH, a, merged


def centred(spark: SparkSession, d: str) -> DataFrame:
    return T.signal(spark, d).withColumn("v", F.col("v") - 50.0)


def image(spark: SparkSession, d: str) -> DataFrame:
    """Hours of day by 24 value classes, counting events."""
    return T.events(spark, d).groupBy(F.floor(F.pmod(F.col("t"), F.lit(86400.0)) / 3600.0).cast("int").alias("x"), F.least(F.floor(F.col("mark") / 10.0), F.lit(23)).cast("int").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def half_up(x: Column, places: int) -> Column:
    """x rounded as the SQL engine does, by the scaled double rather than the digits printed; they differ in ties."""
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled)
    near = F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / 10.0**places
    return F.when(scaled < 2.0**52, near).otherwise(x)  # beyond, infinity and NaN included, no digit is left to round


THETAS = [math.pi * (k + 0.5) / 12 for k in range(12)]
RHOS = [-16.0 + k for k in range(33)]

QUERIES = {
    "sig_extrema": lambda s, d: rounded(G.extrema(T.signal(s, d)), "v"),
    "sig_maxima": lambda s, d: rounded(G.extrema(T.signal(s, d), "max", 100.0, 300.0), "v"),
    "sig_minima": lambda s, d: rounded(G.extrema(T.signal(s, d), "min"), "v"),
    "sig_gradient_extrema": lambda s, d: rounded(G.gradient_extrema(T.signal(s, d)), "at"),
    "sig_zero_cross": lambda s, d: rounded(G.zero_crossings(centred(s, d)), "at"),
    "sig_mountains": lambda s, d: rounded(G.mountains(T.signal(s, d), 60.0, 120.0), "start", "stop", "peak", places=4),
    "sig_thresholds": lambda s, d: rounded(G.thresholds(T.signal(s, d), [1.0, 2.5]), "zscore_0", "zscore_1", "median_0", "median_1", "percentile_0", "percentile_1"),
    "sig_ripple": lambda s, d: rounded(G.ripples(T.signal(s, d), 60.0, 150.0, 600.0, 900.0), "start", "stop", "peak", places=4),
    "sig_ripple_segments": lambda s, d: rounded(G.ripples(T.signal(s, d), 60.0, 150.0, 600.0, 900.0, a(s, d), WIDTH), "start", "stop", "peak", places=4),
    "sig_detection": lambda s, d: rounded(G.detection_rates(T.train(s, d, "view"), a(s, d), 600.0), "true_positive", "false_negative", "false_positive", "lock_out"),
    "sig_smooth": lambda s, d: rounded(G.smooth(T.signal(s, d), "gaussian", 2.0), "v").select("channel", "i", "v"),
    "sig_smooth_unbiased": lambda s, d: rounded(G.smooth(T.signal(s, d), "epanechnikov", 4.0, unbiased=True), "v").select("channel", "i", "v"),
    "sig_smooth_triangular": lambda s, d: rounded(G.smooth(T.signal(s, d), "triangular", 5.0, "max"), "v").select("channel", "i", "v"),
    "sig_rms": lambda s, d: rounded(G.sliding_rms(T.signal(s, d), 3), "v").select("channel", "i", "v"),
    "sig_integrate": lambda s, d: rounded(G.local_integrate(T.signal(s, d), 4), "v").select("channel", "i", "v"),
    "sig_upsample": lambda s, d: G.upsample(T.signal(s, d), 3),
    "sig_windows": lambda s, d: G.windows(T.signal(s, d), 64, 32).groupBy("channel", "window").agg(F.count("v").alias("n"), half_up(F.avg("v"), 4).alias("mean")),
    "sig_trigger_windows": lambda s, d: rounded(G.trigger_windows(T.signal(s, d), T.signal(s, d).filter("v > 250").select("channel", F.col("i").alias("trigger"), F.col("i").alias("at")), 3, 5).groupBy("channel", "k").agg(F.avg("v").alias("v"), F.count("v").alias("n")), "v"),
    "sig_artefacts_fill": lambda s, d: rounded(G.remove_artefacts(T.signal(s, d), T.train(s, d, "error"), 60.0, 120.0, 180.0, 0.0), "v").select("channel", "i", "v"),
    "sig_artefacts_reflect": lambda s, d: rounded(G.remove_artefacts(T.signal(s, d), T.train(s, d, "error"), 60.0, 120.0, 180.0, -1.0, True), "v").select("channel", "i", "v"),
    "sig_artefacts_line": lambda s, d: rounded(G.remove_artefacts(T.signal(s, d), T.train(s, d, "error"), 60.0, 120.0, 180.0), "v").select("channel", "i", "v"),
    "sig_xcorr": lambda s, d: rounded(G.cross_correlation(centred(s, d), centred(s, d), 5), "value", places=4),
    "sig_xcorr_coeff": lambda s, d: rounded(G.cross_correlation(centred(s, d), centred(s, d), 5, "coeff"), "value"),
    "sig_radon": lambda s, d: rounded(G.radon_lines(image(s, d), THETAS, RHOS, 24, 24), "value"),
    "sig_radon_fit": lambda s, d: rounded(G.fit_line(G.radon_lines(image(s, d), THETAS, RHOS, 24, 24), THETAS, RHOS, 24, 24), "slope", "intercept", "score"),
}

SIG = f"{EV}, sg AS (SELECT train AS channel, row_number() OVER (PARTITION BY train ORDER BY t, event_id) - 1 AS i, t, mark AS v FROM ev)"
EXT = f"WITH {SIG}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY channel ORDER BY i) AS d FROM sg), z AS (SELECT * FROM d WHERE d <> 0), n AS (SELECT *, lead(d) OVER (PARTITION BY channel ORDER BY i) AS n, lead(i) OVER (PARTITION BY channel ORDER BY i) AS ni FROM z), x AS (SELECT channel, (i + ni - 1) / 2 AS at, round(v, 6) AS v, d > 0 AS peak FROM n WHERE n IS NOT NULL AND d * n < 0)"
CROSS = "n AS (SELECT channel, i, v, lead(v) OVER (PARTITION BY channel ORDER BY i) AS w, lead(i) OVER (PARTITION BY channel ORDER BY i) AS j FROM {0} WHERE v <> 0)"
BAD = f"WITH {SIG}, e AS (SELECT t - 60.0 AS a, t + 120.0 AS b FROM ev WHERE train = 'error'), f AS (SELECT *, EXISTS (SELECT 1 FROM e WHERE sg.t >= a AND sg.t < b) AS bad FROM sg)"
IMG = f"{EV}, im AS (SELECT floor((t - floor(t / 86400.0) * 86400.0) / 3600.0) AS x, least(floor(mark / 10.0), 23) AS y, count(*)::DOUBLE AS v FROM ev GROUP BY 1, 2)"
RADON = f"WITH {IMG}, l AS (SELECT k AS theta, cos(pi() * (k + 0.5) / 12) AS c, sin(pi() * (k + 0.5) / 12) AS s, r AS rho FROM range(12) a(k), range(33) b(r)), h AS (SELECT theta, rho, x, floor(11.5 + (rho - 16.0 - (x - 11.5) * c) / s + 0.5) AS y FROM l, range(24) z(x)), q AS (SELECT theta::INTEGER AS theta, rho::INTEGER AS rho, sum(v) AS value FROM h JOIN im USING (x, y) GROUP BY theta, rho)"


def _ripples(first: str, runs: str = "SELECT channel, start, stop FROM z WHERE peak > 150") -> str:
    """Runs above 60 with a peak, joined over 600 s, of 900 s or more; with the gradient's maxima inside."""
    return f"""{first}, r AS (SELECT *, i - row_number() OVER (PARTITION BY channel ORDER BY i) AS g FROM sg WHERE v > 60), lr AS (SELECT *, max(i) OVER (PARTITION BY channel, g) AS l FROM r),
z AS (SELECT channel, min(t) AS start, max(t) AS stop, max(v) FILTER (WHERE i < l) AS peak FROM lr GROUP BY channel, g), f AS ({runs}),
mx AS (SELECT *, max(stop) OVER (PARTITION BY channel ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f), nr AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m + 600.0 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM mx),
j AS (SELECT channel, min(start) AS start, max(stop) AS stop FROM nr GROUP BY channel, k HAVING max(stop) - min(start) >= 900.0),
gr AS (SELECT channel, i, (lead(v) OVER (PARTITION BY channel ORDER BY i) - lag(v) OVER (PARTITION BY channel ORDER BY i)) / 2 AS v FROM sg), h AS (SELECT * FROM gr WHERE v IS NOT NULL), {CROSS.format('h')},
top AS (SELECT channel, i + v / (v - w) * (j - i) AS x FROM n WHERE w < 0 AND v > 0), st AS (SELECT channel, i, t, v, lead(t) OVER q AS tn, lead(v) OVER q AS vn FROM sg WINDOW q AS (PARTITION BY channel ORDER BY i)),
pk AS (SELECT top.channel, t + (x - floor(x)) * coalesce(tn - t, 0) AS t, v + (x - floor(x)) * coalesce(vn - v, 0) AS v FROM top JOIN st ON top.channel = st.channel AND floor(x)::BIGINT = i)
SELECT j.channel, round(start, 4) AS start, round(stop, 4) AS stop, count(pk.v) AS peaks, round(max(pk.v), 4) AS peak FROM j LEFT JOIN pk ON pk.channel = j.channel AND pk.t >= start AND pk.t < stop AND abs(pk.v) >= 150 GROUP BY j.channel, start, stop"""


def _smooth(name: str, bandwidth: float, normalize: str = "sum", unbiased: bool = False) -> str:
    ws = ", ".join(f"({lag}, {w!r}::DOUBLE)" for lag, w in G.weights(name, bandwidth, normalize))
    value = "sum(w * y.v) / sum(w)" if unbiased else "sum(w * y.v)"
    return f"WITH {SIG}, k(d, w) AS (VALUES {ws}) SELECT x.channel, x.i, round({value}, 6) AS v FROM sg x, k JOIN sg y ON y.channel = x.channel AND y.i = x.i - k.d GROUP BY x.channel, x.i"


ORACLE_SQL = {
    "sig_extrema": EXT + " SELECT * FROM x",
    "sig_maxima": EXT + " SELECT * FROM x WHERE peak AND abs(v) BETWEEN 100 AND 300",
    "sig_minima": EXT + " SELECT * FROM x WHERE NOT peak",
    "sig_gradient_extrema": f"WITH {SIG}, g AS (SELECT channel, i, (lead(v) OVER (PARTITION BY channel ORDER BY i) - lag(v) OVER (PARTITION BY channel ORDER BY i)) / 2 AS v FROM sg), h AS (SELECT * FROM g WHERE v IS NOT NULL), {CROSS.format('h')} SELECT channel, round(i + v / (v - w) * (j - i), 6) AS at, w < 0 AS peak FROM n WHERE w IS NOT NULL AND v * w < 0",
    "sig_zero_cross": f"WITH {SIG}, h AS (SELECT channel, i, v - 50.0 AS v FROM sg), {CROSS.format('h')} SELECT channel, round(i + v / (v - w) * (j - i), 6) AS at, w > 0 AS rising FROM n WHERE w IS NOT NULL AND v * w < 0",
    "sig_mountains": f"WITH {SIG}, r AS (SELECT *, i - row_number() OVER (PARTITION BY channel ORDER BY i) AS g FROM sg WHERE v > 60), m AS (SELECT *, max(i) OVER (PARTITION BY channel, g) AS l FROM r), z AS (SELECT channel, min(t) AS start, max(t) AS stop, max(v) FILTER (WHERE i < l) AS peak FROM m GROUP BY channel, g) SELECT channel, round(start, 4) AS start, round(stop, 4) AS stop, round(peak, 4) AS peak FROM z WHERE peak > 120",
    "sig_thresholds": f"WITH {SIG}, q AS (SELECT channel, avg(v) AS m, stddev_pop(v) AS s, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.9) AS q9 FROM sg GROUP BY channel) SELECT channel, round(m + s, 6) AS zscore_0, round(m + 2.5 * s, 6) AS zscore_1, round(q2 + (q3 - q2), 6) AS median_0, round(q2 + 2.5 * (q3 - q2), 6) AS median_1, round(q2, 6) AS percentile_0, round(q9, 6) AS percentile_1 FROM q",
    "sig_ripple": _ripples(f"WITH {SIG}"),
    "sig_ripple_segments": _ripples(f"WITH {SEGS}, {merged('s', 'SELECT start, stop FROM a')}, {SIG[len(EV) + 2:]}", "SELECT channel, greatest(z.start, s.start) AS start, least(z.stop, s.stop) AS stop FROM z JOIN s ON z.start < s.stop AND s.start < z.stop WHERE peak > 150"),
    "sig_detection": f"WITH {SEGS}, o AS (SELECT t FROM ev WHERE train = 'view'), l AS (SELECT start, max(stop - start) AS d FROM a GROUP BY start), r AS (SELECT count(*) FILTER (WHERE t - start < d) AS tp FROM o ASOF LEFT JOIN l ON o.t >= l.start), k AS (SELECT count(*) FILTER (WHERE start - t < 600.0) AS nl FROM a ASOF LEFT JOIN o ON a.start >= o.t), n AS (SELECT (SELECT count(*) FROM a) AS ns, (SELECT count(*) FROM o) AS no) SELECT round(100.0 * tp / ns, 6) AS true_positive, round(100.0 * (ns - tp) / ns, 6) AS false_negative, round(100.0 * (no - tp) / no, 6) AS false_positive, round(100.0 * nl / ns, 6) AS lock_out FROM r, k, n",
    "sig_smooth": _smooth("gaussian", 2.0),
    "sig_smooth_unbiased": _smooth("epanechnikov", 4.0, unbiased=True),
    "sig_smooth_triangular": _smooth("triangular", 5.0, "max"),
    "sig_rms": f"WITH {SIG} SELECT channel, i, round(sqrt(avg(v * v) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS v FROM sg",
    "sig_integrate": f"WITH {SIG} SELECT channel, i, round(sum(v) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS v FROM sg",
    "sig_upsample": f"WITH {SIG} SELECT channel, i * 3 + k AS i, CASE WHEN k = 0 THEN v ELSE 0.0::DOUBLE END AS v FROM sg, range(3) r(k)",
    "sig_windows": f"WITH {SIG}, n AS (SELECT channel, max(i) + 1 AS n FROM sg GROUP BY channel), w AS (SELECT channel, unnest(range(greatest((n - 64) // 32 + 1, 0))) AS \"window\" FROM n) SELECT w.channel, \"window\", count(v) AS n, round(avg(v), 4) AS mean FROM w JOIN sg ON sg.channel = w.channel AND i >= \"window\" * 32 AND i < \"window\" * 32 + 64 GROUP BY w.channel, \"window\"",
    "sig_trigger_windows": f"WITH {SIG}, n AS (SELECT channel, max(i) AS n FROM sg GROUP BY channel), g AS (SELECT sg.channel, i AS at FROM sg JOIN n USING (channel) WHERE v > 250 AND i >= 3 AND i + 5 <= n) SELECT g.channel, k::INTEGER AS k, round(avg(v), 6) AS v, count(v) AS n FROM g, range(-3, 6) r(k) JOIN sg ON sg.channel = g.channel AND sg.i = g.at + k GROUP BY g.channel, k",
    "sig_artefacts_fill": BAD + " SELECT channel, i, round(CASE WHEN bad THEN 0.0 ELSE v END, 6) AS v FROM f",
    "sig_artefacts_reflect": BAD + """, r AS (SELECT *, i - row_number() OVER (PARTITION BY channel ORDER BY i) AS r FROM f WHERE bad), ab AS (SELECT channel, i, v, min(i) OVER w AS a, max(i) OVER w AS b FROM r WINDOW w AS (PARTITION BY channel, r)), n AS (SELECT channel, count(*) AS n FROM f GROUP BY channel), q AS (SELECT ab.*, b - a + 1 AS k, n FROM ab JOIN n USING (channel)),
z AS (SELECT q.channel, q.i, (2 * xa.v - pre.v) * (1 - (q.i - a + 1) / (k + 1)) + (2 * xb.v - post.v) * (q.i - a + 1) / (k + 1) AS v FROM q JOIN sg xa ON xa.channel = q.channel AND xa.i = a JOIN sg xb ON xb.channel = q.channel AND xb.i = b JOIN sg pre ON pre.channel = q.channel AND pre.i = 2 * a - 1 - q.i JOIN sg post ON post.channel = q.channel AND post.i = 2 * b + 1 - q.i WHERE a >= k AND b < n - k)
SELECT f.channel, f.i, round(CASE WHEN z.v IS NOT NULL THEN z.v WHEN bad THEN -1 ELSE f.v END, 6) AS v FROM f LEFT JOIN z ON z.channel = f.channel AND z.i = f.i""",
    "sig_artefacts_line": BAD + ", g AS (SELECT * FROM f WHERE NOT bad), lo AS (SELECT f.*, g.t AS t0, g.v AS v0 FROM f ASOF LEFT JOIN g ON f.channel = g.channel AND f.i >= g.i), hi AS (SELECT lo.*, g.t AS t1, g.v AS v1 FROM lo ASOF LEFT JOIN g ON lo.channel = g.channel AND lo.i <= g.i) SELECT channel, i, round(CASE WHEN bad THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE v END, 6) AS v FROM hi",
    "sig_xcorr": f"WITH {SIG} SELECT x.channel, l::INTEGER AS lag, round(sum((x.v - 50.0) * (y.v - 50.0)), 4) AS value FROM sg x, range(-5, 6) r(l) JOIN sg y ON y.channel = x.channel AND y.i = x.i - l GROUP BY x.channel, l",
    "sig_xcorr_coeff": f"WITH {SIG}, n AS (SELECT channel, sum((v - 50.0) * (v - 50.0)) AS n FROM sg GROUP BY channel) SELECT x.channel, l::INTEGER AS lag, round(sum((x.v - 50.0) * (y.v - 50.0)) / any_value(n), 6) AS value FROM sg x JOIN n USING (channel), range(-5, 6) r(l) JOIN sg y ON y.channel = x.channel AND y.i = x.i - l GROUP BY x.channel, l",
    "sig_radon": RADON + " SELECT theta, rho, round(value, 6) AS value FROM q",
    "sig_radon_fit": RADON + ", b AS (SELECT * FROM q ORDER BY value DESC, theta, rho LIMIT 1), p AS (SELECT pi() * (theta + 0.5) / 12 AS th, rho - 16.0 AS r, value FROM b) SELECT round(-1 / tan(th), 6) AS slope, round(r / sin(th) + 1 / tan(th) * 11.5 + 11.5, 6) AS intercept, round(value, 6) AS score FROM p",
}
