"""Queries of event statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import events as E
from ..operators import segments as S
from ..sources import tables as T
from .segments import EV, SEGS, WIDTH, a, merged


def days(spark: SparkSession, d: str) -> DataFrame:
    """Bins of a day that start every half day, for thirty days."""
    k = F.col("id")
    return spark.range(60).select(k.alias("bin"), (k * 43200.0).alias("start"), (k * 43200.0 + 86400.0).alias("stop"))


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def peh(norm: str, **more):
    edges = [-600.0 + 60.0 * k for k in range(21)]
    return lambda s, d: rounded(E.peri_event_histogram(T.train(s, d, "view"), T.train(s, d, "click"), edges, norm, **more), "value", places=9)


def peh_in(norm: str, unbiased: bool = False):
    """In the half hours about purchases."""
    edges = [-600.0 + 60.0 * k for k in range(21)]
    return lambda s, d: rounded(E.peri_event_histogram(T.train(s, d, "view"), T.train(s, d, "click"), edges, norm, a(s, d), WIDTH, unbiased), "value", places=9)


TRAINS = ["click", "error", "purchase", "signup", "view"]
DAYS = "k AS (SELECT unnest(range(60)) AS bin), g AS (SELECT bin, bin * 43200.0 AS start, bin * 43200.0 + 86400.0 AS stop FROM k)"
#: Right less wrong of x (train, dt, da), by train.
CSI = "y AS (SELECT *, abs(dt) <= 1200 AND abs(dt) < 60 AS refractory, abs(dt) <= 1200 AND abs(dt) >= 60 AS usable, (da <= 0 AND dt > 0) OR (da > 0 AND dt < 0) AS good FROM x), i AS (SELECT train, count(*) FILTER (WHERE usable AND good) - count(*) FILTER (WHERE refractory OR (usable AND NOT good)) AS s FROM y GROUP BY train)"
BASE = "SELECT ev.*, lag(t) OVER w AS p, lead(t) OVER w AS q, lag(mark) OVER w AS mp, lead(mark) OVER w AS mq FROM ev WINDOW w AS (PARTITION BY train ORDER BY t, event_id)"

QUERIES = {
    "ev_rate": lambda s, d: rounded(E.rate(T.events(s, d)), "rate", places=9),
    "ev_rate_segments": lambda s, d: rounded(E.rate_in(T.events(s, d), a(s, d), WIDTH), "rate", places=9),
    "ev_rate_separate": lambda s, d: rounded(E.rate_in(T.train(s, d, "view"), a(s, d), WIDTH, True), "rate", places=9),
    "ev_bin_count": lambda s, d: E.bins(T.events(s, d), days(s, d), 86400.0),
    "ev_bin_binary": lambda s, d: E.bins(T.events(s, d), days(s, d), 86400.0, "binary").withColumn("value", F.col("value").cast("int")),
    "ev_bin_rate": lambda s, d: rounded(E.bins(T.events(s, d), days(s, d), 86400.0, "rate"), "value", places=9),
    "ev_bin_table": lambda s, d: E.bin_table(T.events(s, d), days(s, d), 86400.0, TRAINS),
    "ev_bin_regular": lambda s, d: E.regular_bins(T.events(s, d), 3600.0),
    "ev_count": lambda s, d: E.count_until(T.events(s, d), days(s, d).select(F.lit("view").alias("train"), "bin", F.col("start").alias("t"))).select("bin", "n"),
    "ev_interval_pre": lambda s, d: rounded(E.intervals(T.events(s, d), "pre"), "interval").select("event_id", "interval"),
    "ev_interval_post": lambda s, d: rounded(E.intervals(T.events(s, d), "post"), "interval").select("event_id", "interval"),
    "ev_interval_smallest": lambda s, d: rounded(E.intervals(T.events(s, d), "smallest"), "interval").select("event_id", "interval"),
    "ev_interval_largest": lambda s, d: rounded(E.intervals(T.events(s, d), "largest"), "interval").select("event_id", "interval"),
    "ev_cross_interval_pre": lambda s, d: rounded(E.cross_intervals(T.train(s, d, "view"), T.train(s, d, "click"), "pre"), "interval").select("event_id", "interval"),
    "ev_cross_interval_post": lambda s, d: rounded(E.cross_intervals(T.train(s, d, "view"), T.train(s, d, "click"), "post"), "interval").select("event_id", "interval"),
    "ev_filter_intervals": lambda s, d: E.filter_intervals(T.events(s, d), 300.0).select("event_id"),
    "ev_bursts": lambda s, d: E.bursts(T.events(s, d), 1.0, 900.0).select("event_id", "burst"),
    "ev_bursts_marks": lambda s, d: E.bursts(T.events(s, d), 1.0, 1800.0, marks=True).select("event_id", "burst"),
    "ev_bursts_length": lambda s, d: E.bursts(T.events(s, d), 1.0, 1500.0, (3, 6)).select("event_id", "burst"),
    "ev_filter_bursts": lambda s, d: E.filter_bursts(E.bursts(T.events(s, d), 1.0, 900.0)).select("event_id"),
    "ev_filter_bursts_isolate": lambda s, d: E.filter_bursts(E.bursts(T.events(s, d), 1.0, 900.0), "isolate").select("event_id"),
    "ev_csi": lambda s, d: E.complex_spike_index(T.events(s, d), 60.0, 1200.0),
    "ev_csi_pairs": lambda s, d: E.complex_spike_index(T.events(s, d), 60.0, 1200.0, cross=True),
    "ev_near_reference": lambda s, d: rounded(E.near_reference(T.train(s, d, "view"), T.train(s, d, "click"), -120.0, 300.0), "lag", "ref_t").select("ref_t", "lag"),
    "ev_near_reference_segments": lambda s, d: rounded(E.near_reference(T.train(s, d, "view"), T.train(s, d, "click"), -120.0, 300.0, a(s, d), WIDTH, True), "lag", "ref_t").select("ref_t", "lag"),
    "ev_peh_none": peh("none"),
    "ev_peh_coef": peh("coef"),
    "ev_peh_rate": peh("rate"),
    "ev_peh_product_density": peh("product density"),
    "ev_peh_cross_covariance": peh("cross covariance"),
    "ev_peh_zscore": lambda s, d: rounded(peh("zscore")(s, d), "value", places=5),
    "ev_peh_segments": peh_in("rate"),
    "ev_peh_unbiased": peh_in("none", True),
    "ev_peh_unbiased_covariance": peh_in("cross covariance", True),
    "ev_triggered_average": lambda s, d: rounded(E.triggered_average(T.train(s, d, "error").select("t"), T.train(s, d, "view").select("t", F.col("mark").alias("v")), [-600.0, -300.0, 0.0, 300.0, 600.0]), "mean"),
    "ev_density": lambda s, d: rounded(E.density(T.events(s, d), days(s, d).select(F.col("start").alias("x")), 3600.0), "density", places=12),
    "ev_split_strings": lambda s, d: E.split_by_string(T.events(s, d), "train").select("train", "n", F.round(F.col("times")[0], 6).alias("first"), F.round(F.element_at("times", -1), 6).alias("last")),
    "ev_synchronization": lambda s, d: rounded(A.synchronization(clocks(s, d)), "offset", "drift"),
    "ev_clock_converted": lambda s, d: rounded(A.converted(T.train(s, d, "click").select("event_id", "t"), clocks(s, d), True).select("event_id", "tb"), "tb", places=4),
}


def clocks(spark: SparkSession, d: str) -> DataFrame:
    """Views by the clock of the table and, from the second day on, by one that is 5 s ahead and gains 0.1 s a 1,000 s."""
    v = T.train(spark, d, "view").select("t")
    return A.matched(v, v.filter("t > 86400").select((F.col("t") * 1.0001 + 5.0).alias("t")))


#: Histogram of the whole time: one segment from the first to the last of both trains' times.
PAIRS = """e AS (SELECT t FROM ev WHERE train = 'view'), r AS (SELECT t FROM ev WHERE train = 'click'), z AS (SELECT min(t) AS lo, max(t) AS hi FROM ev WHERE train IN ('view', 'click')),
k AS (SELECT hi - lo AS total, (SELECT count(*) FROM e WHERE t < hi) AS ne, (SELECT count(*) FROM r WHERE t < hi) AS nr, (SELECT count(*) FROM r) AS valid FROM z),
h AS (SELECT least(floor((e.t - r.t + 600.0) / 60.0), 19)::INTEGER AS bin, count(*) AS c FROM e JOIN r ON e.t >= r.t - 600.0 AND e.t <= r.t + 600.0 GROUP BY 1)"""
#: That of the half hours about purchases, merged unless they only touch; of references that see all lags, if {0} is 600.
WITHIN = SEGS + ", " + merged("m", "SELECT start, stop FROM a", ">=") + """, e AS (SELECT t FROM ev WHERE train = 'view'), r AS (SELECT t FROM ev WHERE train = 'click'),
q AS (SELECT t, start, stop FROM r JOIN m ON t >= start + {0} AND t <= stop - {0}),
k AS (SELECT (SELECT sum(stop - start) FROM a) AS total, (SELECT count(*) FROM e JOIN m ON start <= t AND t < stop) AS ne, (SELECT count(*) FROM r JOIN m ON start <= t AND t < stop) AS nr, (SELECT count(*) FROM q) AS valid),
h AS (SELECT least(floor((e.t - q.t + 600.0) / 60.0), 19)::INTEGER AS bin, count(*) AS c FROM q JOIN e ON e.t >= q.t - 600.0 AND e.t <= q.t + 600.0 AND e.t >= start AND e.t <= stop GROUP BY 1)"""
CLOCKS = f"""{EV}, x AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, t FROM ev WHERE train = 'view'), y AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, t * 1.0001::DOUBLE + 5.0 AS t FROM ev WHERE train = 'view' AND t > 86400),
u AS (SELECT i, t - lag(t) OVER (ORDER BY i) AS v FROM x), w AS (SELECT i, t - lag(t) OVER (ORDER BY i) AS v FROM y), mu AS (SELECT avg(v) AS m FROM u), mw AS (SELECT avg(v) AS m FROM w),
c AS (SELECT u.i - w.i AS lag, sum((u.v - mu.m) * (w.v - mw.m)) AS c FROM u, w, mu, mw WHERE u.v IS NOT NULL AND w.v IS NOT NULL GROUP BY 1),
p AS (SELECT lag, x.t AS ta, y.t AS tb FROM (SELECT lag FROM c ORDER BY c DESC, lag LIMIT 1), x JOIN y ON x.i = y.i + lag)"""


def _peh(value: str, places: int = 9, pairs: str = f"{EV}, {PAIRS}") -> str:
    return f"WITH {pairs}, g AS (SELECT unnest(range(20))::INTEGER AS bin), f AS (SELECT bin, coalesce(c, 0) AS c FROM g LEFT JOIN h USING (bin)) SELECT 'view' AS train, 'click' AS ref_train, bin, round({value}, {places}) AS value FROM f, k"


def _bursts(low: float, high: float, marks: str = "") -> str:
    return f"b AS ({BASE}), i AS (SELECT *, coalesce(t - p >= {low} AND t - p <= {high}{marks}, false) AS x FROM b), o AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY train ORDER BY t, event_id), false) AS y FROM i), r AS (SELECT *, CASE WHEN NOT x AND y THEN 1 WHEN x AND y THEN 2 WHEN x THEN 3 ELSE 0 END AS burst FROM o)"


ORACLE_SQL = {
    "ev_rate": f"WITH {EV} SELECT train, count(*) AS n, round(count(*) / (max(t) - min(t)), 9) AS rate FROM ev GROUP BY train",
    "ev_rate_segments": f"WITH {SEGS}, {merged('m', 'SELECT start, stop FROM a')}, f AS (SELECT train, count(*) AS n FROM ev JOIN m ON m.start <= t AND t < m.stop GROUP BY train) SELECT train, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(stop - start) FROM m), 9) AS rate FROM (SELECT DISTINCT train FROM ev) LEFT JOIN f USING (train)",
    "ev_rate_separate": f"WITH {SEGS} SELECT 'view' AS train, seg_id, count(t) AS n, round(count(t) / any_value(stop - start), 9) AS rate FROM a LEFT JOIN (SELECT t FROM ev WHERE train = 'view') v ON start <= t AND t < stop GROUP BY seg_id",
    "ev_bin_count": f"WITH {EV}, {DAYS} SELECT bin, train, count(*) AS value FROM ev JOIN g ON start <= t AND t < stop GROUP BY bin, train",
    "ev_bin_binary": f"WITH {EV}, {DAYS} SELECT DISTINCT bin, train, 1 AS value FROM ev JOIN g ON start <= t AND t < stop",
    "ev_bin_rate": f"WITH {EV}, {DAYS} SELECT bin, train, round(count(*) / 86400.0, 9) AS value FROM ev JOIN g ON start <= t AND t < stop GROUP BY bin, train",
    "ev_bin_table": f"WITH {EV}, {DAYS} SELECT bin, " + ", ".join(f"count(*) FILTER (WHERE train = '{t}') AS {t}" for t in TRAINS) + " FROM g LEFT JOIN ev ON start <= t AND t < stop GROUP BY bin",
    "ev_bin_regular": f"WITH {EV} SELECT floor(t / 3600.0)::BIGINT AS bin, train, count(*) AS n FROM ev GROUP BY 1, 2",
    "ev_count": f"WITH {EV}, {DAYS} SELECT bin, count(t) AS n FROM g LEFT JOIN ev ON train = 'view' AND t <= start GROUP BY bin",
    "ev_interval_pre": f"WITH {EV}, b AS ({BASE}) SELECT event_id, round(p - t, 6) AS interval FROM b",
    "ev_interval_post": f"WITH {EV}, b AS ({BASE}) SELECT event_id, round(q - t, 6) AS interval FROM b",
    "ev_interval_smallest": f"WITH {EV}, b AS ({BASE}) SELECT event_id, round(CASE WHEN p IS NULL OR q IS NULL THEN NULL WHEN t - p < q - t THEN p - t ELSE q - t END, 6) AS interval FROM b",
    "ev_interval_largest": f"WITH {EV}, b AS ({BASE}) SELECT event_id, round(CASE WHEN p IS NULL OR q IS NULL THEN NULL WHEN q - t > t - p THEN q - t ELSE p - t END, 6) AS interval FROM b",
    "ev_cross_interval_pre": f"WITH {EV} SELECT v.event_id, round(c.t - v.t, 6) AS interval FROM (SELECT * FROM ev WHERE train = 'view') v ASOF LEFT JOIN (SELECT t FROM ev WHERE train = 'click') c ON v.t >= c.t",
    "ev_cross_interval_post": f"WITH {EV} SELECT v.event_id, round(c.t - v.t, 6) AS interval FROM (SELECT * FROM ev WHERE train = 'view') v ASOF LEFT JOIN (SELECT t FROM ev WHERE train = 'click') c ON v.t <= c.t",
    "ev_filter_intervals": f"WITH {EV}, b AS ({BASE}) SELECT event_id FROM b WHERE p IS NULL OR t - p >= 300.0",
    "ev_bursts": f"WITH {EV}, {_bursts(1.0, 900.0)} SELECT event_id, burst FROM r",
    "ev_bursts_marks": f"WITH {EV}, {_bursts(1.0, 1800.0, ' AND mark <= mp')} SELECT event_id, burst FROM r",
    "ev_bursts_length": f"WITH {EV}, {_bursts(1.0, 1500.0)}, s AS (SELECT *, sum((burst = 1)::INTEGER) OVER (PARTITION BY train ORDER BY t, event_id) AS i FROM r), n AS (SELECT *, sum((burst > 0)::INTEGER) OVER (PARTITION BY train, i) AS n FROM s) SELECT event_id, CASE WHEN n BETWEEN 3 AND 6 THEN burst ELSE 0 END AS burst FROM n",
    "ev_filter_bursts": f"WITH {EV}, {_bursts(1.0, 900.0)} SELECT event_id FROM r WHERE burst <= 1",
    "ev_filter_bursts_isolate": f"WITH {EV}, {_bursts(1.0, 900.0)} SELECT event_id FROM r WHERE burst <> 0",
    "ev_csi": f"WITH {EV}, b AS ({BASE}), x AS (SELECT train, CASE WHEN q - t <= t - p THEN t - q ELSE t - p END AS dt, CASE WHEN q - t <= t - p THEN mark - mq ELSE mark - mp END AS da FROM b WHERE p IS NOT NULL AND q IS NOT NULL), {CSI} SELECT train, floor(100 * s / n)::BIGINT AS csi FROM i JOIN (SELECT train, count(*) AS n FROM ev GROUP BY train) USING (train)",
    "ev_csi_pairs": f"""WITH {EV}, l AS (SELECT ev.*, other FROM ev, (SELECT DISTINCT train AS other FROM ev)), o AS (SELECT event_id AS oid, train AS other, t AS ot, mark AS om FROM ev),
lo AS (SELECT l.*, o.ot AS p, o.om AS mp FROM l ASOF JOIN o ON l.other = o.other AND l.t >= o.ot WHERE l.train <> l.other), hi AS (SELECT lo.*, o.ot AS q, o.om AS mq FROM lo ASOF JOIN o ON lo.other = o.other AND lo.t <= o.ot),
b AS ({BASE}), j AS (SELECT train, other, t, mark, p, mp, q, mq FROM hi UNION ALL SELECT train, train, t, mark, p, mp, q, mq FROM b WHERE p IS NOT NULL AND q IS NOT NULL),
x AS (SELECT train || ' ' || other AS train, CASE WHEN q - t <= t - p THEN t - q ELSE t - p END AS dt, CASE WHEN q - t <= t - p THEN mark - mq ELSE mark - mp END AS da FROM j), {CSI},
n AS (SELECT train, count(*) AS n FROM ev GROUP BY train)
SELECT n.train, m.train AS other, floor(100 * coalesce(s, 0) / n.n)::BIGINT AS csi FROM n, n m LEFT JOIN i ON i.train = n.train || ' ' || m.train""",
    "ev_near_reference": f"WITH {EV} SELECT round(c.t, 6) AS ref_t, round(v.t - c.t, 6) AS lag FROM ev v JOIN ev c ON v.train = 'view' AND c.train = 'click' AND v.t >= c.t - 120.0 AND v.t <= c.t + 300.0",
    "ev_near_reference_segments": f"WITH {SEGS}, {merged('m', 'SELECT start, stop FROM a')} SELECT round(c.t, 6) AS ref_t, round(v.t - c.t, 6) AS lag FROM ev c JOIN m ON c.train = 'click' AND c.t >= m.start + 120.0 AND c.t <= m.stop - 300.0 JOIN ev v ON v.train = 'view' AND v.t >= c.t - 120.0 AND v.t <= c.t + 300.0 AND v.t >= m.start AND v.t <= m.stop",
    "ev_peh_none": _peh("c"),
    "ev_peh_coef": _peh("c / valid"),
    "ev_peh_rate": _peh("c / (60.0 * valid)"),
    "ev_peh_product_density": _peh("c / (60.0 * total)"),
    "ev_peh_cross_covariance": _peh("c / (60.0 * total) - ne / total * nr / total"),
    "ev_peh_zscore": _peh("(c / (60.0 * total) - ne / total * nr / total) / (ne / total * nr / total / (60.0 * total))", 5),
    "ev_peh_segments": _peh("c / (60.0 * valid)", 9, WITHIN.format("0.0")),
    "ev_peh_unbiased": _peh("c * nr / valid", 9, WITHIN.format("600.0")),
    "ev_peh_unbiased_covariance": _peh("c * nr / valid / (60.0 * total) - ne / total * nr / total", 9, WITHIN.format("600.0")),
    "ev_triggered_average": f"""WITH {EV}, v AS (SELECT t, mark AS v FROM ev WHERE train = 'view'), l AS (SELECT t + lag AS t, lag FROM ev, (VALUES (-600.0::DOUBLE), (-300.0), (0.0), (300.0), (600.0)) x(lag) WHERE train = 'error'),
lo AS (SELECT l.t, l.lag, v.t AS t0, v.v AS v0 FROM l ASOF JOIN v ON l.t >= v.t), hi AS (SELECT lo.*, v.t AS t1, v.v AS v1 FROM lo ASOF JOIN v ON lo.t <= v.t)
SELECT lag, round(avg(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END), 6) AS mean, count(*) AS n FROM hi GROUP BY lag""",
    "ev_density": f"WITH {EV}, {DAYS}, n AS (SELECT train, count(*) AS n FROM ev GROUP BY train) SELECT train, start AS x, round(sum(exp(-((t - start) / 3600.0) * ((t - start) / 3600.0) / 2)) / (any_value(n) * 3600.0 * sqrt(2 * pi())), 12) AS density FROM ev JOIN n USING (train) JOIN g ON t >= start - 21600.0 AND t <= start + 21600.0 GROUP BY train, start",
    "ev_split_strings": f"WITH {EV} SELECT train, count(*) AS n, round(min(t), 6) AS first, round(max(t), 6) AS last FROM ev GROUP BY train",
    "ev_synchronization": f"WITH {CLOCKS} SELECT lag, count(*) AS n, round(avg(tb - ta), 6) AS \"offset\", round(regr_slope(tb - ta, ta), 6) AS drift FROM p GROUP BY lag",
    "ev_clock_converted": f"""WITH {CLOCKS}, s AS (SELECT event_id, t FROM ev WHERE train = 'click'), n AS (SELECT ta, tb, row_number() OVER (ORDER BY ta) AS i, count(*) OVER () AS n FROM p),
seg AS (SELECT ta AS a0, tb AS b0, lead(ta) OVER (ORDER BY ta) AS a1, lead(tb) OVER (ORDER BY ta) AS b1, i, n FROM n), cut AS (SELECT CASE WHEN i = 1 THEN -1e300 ELSE a0 END AS lo, * FROM seg WHERE i < n)
SELECT event_id, round(b0 + (b1 - b0) * (t - a0) / (a1 - a0), 4) AS tb FROM s ASOF JOIN cut ON s.t >= cut.lo""",
}
