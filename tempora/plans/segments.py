"""Queries of segment algebra: A is half an hour about each purchase, B twenty minutes from each signup, C ten minutes about each error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments as S
from ..sources import tables as T

WIDTH = 1800.0

EV = "ev AS (SELECT event_id, user_id, event_type AS train, epoch_us(ts) / 1e6 - 1704067200 AS t, value AS mark FROM events)"
SEGS = f"""{EV},
a AS (SELECT event_id AS seg_id, t - 0.5 * 1800.0 AS start, t + 0.5 * 1800.0 AS stop FROM ev WHERE train = 'purchase'),
b AS (SELECT event_id AS seg_id, t - 0.0 * 1200.0 AS start, t + 1.0 * 1200.0 AS stop FROM ev WHERE train = 'signup'),
c AS (SELECT event_id AS seg_id, t - 0.5 * 600.0 AS start, t + 0.5 * 600.0 AS stop FROM ev WHERE train = 'error')"""


def merged(name: str, of: str, apart: str = ">", gap: str = "") -> str:
    return f"""{name}_m AS (SELECT start, stop, max(stop) OVER (ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({of})),
{name}_i AS (SELECT start, stop, sum(CASE WHEN m IS NULL OR start {apart} m{gap} THEN 1 ELSE 0 END) OVER (ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM {name}_m),
{name} AS (SELECT min(start) AS start, max(stop) AS stop FROM {name}_i GROUP BY i)"""


def a(spark: SparkSession, d: str) -> DataFrame:
    return T.segments(spark, d, "purchase", 1800.0)


def b(spark: SparkSession, d: str) -> DataFrame:
    return T.segments(spark, d, "signup", 1200.0, 0.0)


def c(spark: SparkSession, d: str) -> DataFrame:
    return T.segments(spark, d, "error", 600.0)


def out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.round("start", 4).alias("start"), F.round("stop", 4).alias("stop"), *more)


ROUND = "round(start, 4) AS start, round(stop, 4) AS stop"
ABC_SWEEP = """edges AS (SELECT start AS t FROM {x} UNION SELECT stop FROM {x} UNION SELECT start FROM {y} UNION SELECT stop FROM {y}),
cells AS (SELECT t AS start, lead(t) OVER (ORDER BY t) AS stop FROM edges),
inx AS (SELECT cells.start, cells.stop FROM cells JOIN {x} ON {x}.start <= cells.start AND cells.stop <= {x}.stop WHERE cells.stop > cells.start),
iny AS (SELECT cells.start, cells.stop FROM cells JOIN {y} ON {y}.start <= cells.start AND cells.stop <= {y}.stop WHERE cells.stop > cells.start)"""

QUERIES = {
    "seg_union": lambda s, d: out(S.union(a(s, d), b(s, d), c(s, d), chunk=S.STRETCH * WIDTH)),
    "seg_union_chunked": lambda s, d: out(S.remove_overlap(S.concatenate(a(s, d), b(s, d), name="u"), chunk=86400.0)),
    "seg_remove_overlap_nonstrict": lambda s, d: out(S.remove_overlap(a(s, d), strict=False)),
    "seg_join_gap": lambda s, d: out(S.join_gap(a(s, d), 900.0)),
    "seg_invert": lambda s, d: out(S.invert(a(s, d), S.STRETCH * WIDTH)),
    "seg_intersection": lambda s, d: out(S.intersection(a(s, d), b(s, d), WIDTH)),
    "seg_exclusive": lambda s, d: out(S.exclusive(a(s, d), [b(s, d)], WIDTH)),
    "seg_difference": lambda s, d: out(S.difference([a(s, d), b(s, d)], WIDTH)),
    "seg_concatenate": lambda s, d: out(S.concatenate(a(s, d), b(s, d)), "set_id"),
    "seg_scale": lambda s, d: out(S.scale(a(s, d), 2.5, 0.25), "seg_id"),
    "seg_offset": lambda s, d: out(S.offset(a(s, d), 12.5), "seg_id"),
    "seg_measures": lambda s, d: S.measures(a(s, d)).select("seg_id", F.round("duration", 4).alias("duration"), F.round("center", 4).alias("center"), F.round("interval", 4).alias("interval"), F.col("position").cast("long").alias("position")),
    "seg_has_overlap": lambda s, d: S.has_overlap(S.concatenate(a(s, d), c(s, d))),
    "seg_contains_mask": lambda s, d: S.contains(T.train(s, d, "view"), a(s, d), WIDTH).select("event_id"),
    "seg_contains_count": lambda s, d: S.contains_counts(T.train(s, d, "view"), a(s, d), WIDTH).select("seg_id", "n", "first", "last"),
    "seg_count_sweep": lambda s, d: S.cover_count(T.train(s, d, "view"), S.concatenate(a(s, d), b(s, d), name="x")).select("event_id", "n"),
    "seg_overlap_pairs": lambda s, d: S.overlap_pairs(a(s, d), c(s, d), WIDTH, 5),
    "seg_split": lambda s, d: out(S.split(a(s, d), 420.0), "parent", "part"),
    "seg_split_overlap": lambda s, d: out(S.split(a(s, d), 600.0, 0.5), "parent", "part"),
    "seg_apply_mean": lambda s, d: S.apply(T.train(s, d, "view"), a(s, d), WIDTH, mean=F.avg("mark"), n=F.count(F.lit(1))).select("seg_id", F.round("mean", 6).alias("mean"), F.coalesce("n", F.lit(0)).alias("n")),
    "seg_apply_percentile": lambda s, d: S.apply_quantile(T.train(s, d, "view"), a(s, d), WIDTH, "mark", 0.75, "p").select("seg_id", F.round("p", 6).alias("p")),
    "seg_from_logical": lambda s, d: out(S.from_logical(T.signal(s, d), F.col("v") > 250, ("channel",)), "channel", "n"),
    "seg_from_indices": lambda s, d: S.from_indices(T.events(s, d).filter("mark > 120").select(F.lit("x").alias("set_id"), F.col("event_id").alias("i"))).select("start", "stop"),
    "seg_from_events": lambda s, d: out(S.from_events(T.train(s, d, "signup").withColumn("set_id", F.lit("x")), T.train(s, d, "error").withColumn("set_id", F.lit("x")))),
    "seg_from_events_greedy": lambda s, d: out(S.from_events(T.train(s, d, "signup").withColumn("set_id", F.lit("x")), T.train(s, d, "error").withColumn("set_id", F.lit("x")), True, True)),
    "seg_from_duration": lambda s, d: out(S.from_duration(T.train(s, d, "error"), 90.0, 0.25), "event_id"),
    "seg_as_index": lambda s, d: S.as_index(T.train(s, d, "view"), a(s, d), WIDTH).select("start", "stop"),
    "seg_partition": lambda s, d: S.partition(a(s, d), 7).select("seg_id", "part"),
    "seg_partition_sequence": lambda s, d: S.partition(a(s, d), 7, "sequence").select("seg_id", "part"),
    "seg_calendar_union": lambda s, d: calendar(s, d),
}


def calendar(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's merged ten-day stretches after orders, with their number and days."""
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6).alias("start"))
    m = S.remove_overlap(o.withColumn("stop", F.col("start") + 10.0))
    return m.groupBy(F.col("set_id").alias("custkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("stop") - F.col("start")), 4).alias("days"))


def _x(body: str) -> str:
    return f"WITH {SEGS},\n{body}"


POS = "v AS (SELECT event_id, t, mark, row_number() OVER (ORDER BY t) - 1 AS k FROM ev WHERE train = 'view')"
ON_OFF = "e AS (SELECT t, CASE WHEN train = 'signup' THEN 0 ELSE 1 END AS f FROM ev WHERE train IN ('signup', 'error')), n AS (SELECT t, f, lag(f) OVER (ORDER BY t, f) AS p, lead(f) OVER (ORDER BY t, f) AS q FROM e)"

ORACLE_SQL = {
    "seg_union": _x(merged("u", "SELECT start, stop FROM a UNION ALL SELECT start, stop FROM b UNION ALL SELECT start, stop FROM c") + f" SELECT {ROUND} FROM u"),
    "seg_union_chunked": _x(merged("u", "SELECT start, stop FROM a UNION ALL SELECT start, stop FROM b") + f" SELECT {ROUND} FROM u"),
    "seg_remove_overlap_nonstrict": _x(merged("u", "SELECT start, stop FROM a", ">=") + f" SELECT {ROUND} FROM u"),
    "seg_join_gap": _x(merged("u", "SELECT start, stop FROM a", ">", " + 900.0") + f" SELECT {ROUND} FROM u"),
    "seg_invert": _x(merged("u", "SELECT start, stop FROM a") + f", r AS (SELECT '-inf'::DOUBLE AS start, min(start) AS stop FROM u UNION ALL SELECT stop, coalesce(lead(start) OVER (ORDER BY start), 'inf'::DOUBLE) FROM u) SELECT {ROUND} FROM r"),
    "seg_intersection": _x(merged("x", "SELECT start, stop FROM a") + "," + merged("y", "SELECT start, stop FROM b") + " SELECT round(greatest(x.start, y.start), 4) AS start, round(least(x.stop, y.stop), 4) AS stop FROM x JOIN y ON x.start < y.stop AND y.start < x.stop"),
    "seg_exclusive": _x(merged("x", "SELECT start, stop FROM a") + "," + merged("y", "SELECT start, stop FROM b") + "," + ABC_SWEEP.format(x="x", y="y") + ", k AS (SELECT * FROM inx EXCEPT SELECT * FROM iny)," + merged("z", "SELECT start, stop FROM k") + f" SELECT {ROUND} FROM z"),
    "seg_difference": _x(merged("x", "SELECT start, stop FROM a") + "," + merged("y", "SELECT start, stop FROM b") + "," + ABC_SWEEP.format(x="x", y="y") + ", k AS ((SELECT * FROM inx EXCEPT SELECT * FROM iny) UNION (SELECT * FROM iny EXCEPT SELECT * FROM inx))," + merged("z", "SELECT start, stop FROM k") + f" SELECT {ROUND} FROM z"),
    "seg_concatenate": _x(f"k AS (SELECT 'purchase' AS set_id, start, stop FROM a UNION ALL SELECT 'signup', start, stop FROM b) SELECT {ROUND}, set_id FROM k"),
    "seg_scale": _x("k AS (SELECT seg_id, start - 0.25 * ((stop - start) * 1.5) AS start, stop + 0.75 * ((stop - start) * 1.5) AS stop FROM a) SELECT " + ROUND + ", seg_id FROM k"),
    "seg_offset": _x("k AS (SELECT seg_id, start + 12.5 AS start, stop + 12.5 AS stop FROM a) SELECT " + ROUND + ", seg_id FROM k"),
    "seg_measures": _x("k AS (SELECT 1) SELECT seg_id, round(stop - start, 4) AS duration, round((start + stop) / 2, 4) AS center, round(lead(start) OVER (ORDER BY start, stop) - stop, 4) AS interval, row_number() OVER (ORDER BY start, stop) - 1 AS position FROM a"),
    "seg_has_overlap": _x("k AS (SELECT 'purchase' AS set_id, lead(start) OVER (ORDER BY start, stop) < stop AS o FROM a UNION ALL SELECT 'error', lead(start) OVER (ORDER BY start, stop) < stop FROM c) SELECT set_id, coalesce(bool_or(o), false) AS overlaps FROM k GROUP BY set_id"),
    "seg_contains_mask": _x("k AS (SELECT 1) SELECT event_id FROM ev WHERE train = 'view' AND EXISTS (SELECT 1 FROM a WHERE a.start <= ev.t AND ev.t < a.stop)"),
    "seg_contains_count": _x(POS + " SELECT seg_id, count(k) AS n, coalesce(min(k), -1) AS first, coalesce(max(k), -1) AS last FROM a LEFT JOIN v ON a.start <= v.t AND v.t < a.stop GROUP BY seg_id"),
    "seg_count_sweep": _x("k AS (SELECT start, stop FROM a UNION ALL SELECT start, stop FROM b) SELECT event_id, count(k.start) AS n FROM (SELECT * FROM ev WHERE train = 'view') v LEFT JOIN k ON k.start <= v.t AND v.t < k.stop GROUP BY event_id"),
    "seg_overlap_pairs": _x("k AS (SELECT a.seg_id AS seg_id_a, c.seg_id AS seg_id_b, least(a.stop, c.stop) - greatest(a.start, c.start) AS o, a.stop - a.start AS la, c.stop - c.start AS lc FROM a JOIN c ON a.start < c.stop AND c.start < a.stop) SELECT seg_id_a, seg_id_b, round(o, 5) AS overlap, round(o / la, 5) AS relative_a, round(o / lc, 5) AS relative_b FROM k"),
    "seg_split": _x("k AS (SELECT seg_id AS parent, unnest(range(4)) AS part, start AS s FROM a), r AS (SELECT parent, part::INTEGER AS part, s + part * 420.0 AS start, s + part * 420.0 + 420.0 AS stop FROM k) SELECT " + ROUND + ", parent, part FROM r"),
    "seg_split_overlap": _x("k AS (SELECT seg_id AS parent, unnest(range(5)) AS part, start AS s FROM a), r AS (SELECT parent, part::INTEGER AS part, s + part * 300.0 AS start, s + part * 300.0 + 600.0 AS stop FROM k) SELECT " + ROUND + ", parent, part FROM r"),
    "seg_apply_mean": _x(POS + " SELECT seg_id, round(avg(v.mark), 6) AS mean, count(v.k) AS n FROM a LEFT JOIN v ON a.start <= v.t AND v.t < a.stop GROUP BY seg_id"),
    "seg_apply_percentile": _x(POS + " SELECT seg_id, round(quantile_cont(v.mark, 0.75), 6) AS p FROM a LEFT JOIN v ON a.start <= v.t AND v.t < a.stop GROUP BY seg_id"),
    "seg_from_logical": f"WITH {EV}, s AS (SELECT train AS channel, t, mark AS v, row_number() OVER (PARTITION BY train ORDER BY t, event_id) AS i FROM ev), r AS (SELECT *, i - row_number() OVER (PARTITION BY channel ORDER BY i) AS g FROM s WHERE v > 250), z AS (SELECT channel, min(t) AS start, max(t) AS stop, count(*) AS n FROM r GROUP BY channel, g) SELECT {ROUND}, channel, n FROM z",
    "seg_from_indices": "WITH r AS (SELECT event_id AS i, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE value > 120) SELECT min(i) AS start, max(i) AS stop FROM r GROUP BY g",
    "seg_from_events": f"WITH {EV}, {ON_OFF}, z AS (SELECT t AS start, lead(t) OVER (ORDER BY t, f) AS stop, f FROM n WHERE (f = 0 AND q = 1) OR (f = 1 AND p = 0)) SELECT {ROUND} FROM z WHERE f = 0 AND stop IS NOT NULL",
    "seg_from_events_greedy": f"WITH {EV}, {ON_OFF}, z AS (SELECT t AS start, lead(t) OVER (ORDER BY t, f) AS stop, lead(f) OVER (ORDER BY t, f) AS nf, f FROM n WHERE (f = 0 AND (p IS NULL OR p = 1)) OR (f = 1 AND (q IS NULL OR q = 0))) SELECT {ROUND} FROM z WHERE f = 0 AND nf = 1",
    "seg_from_duration": f"WITH {EV}, z AS (SELECT event_id, t - 0.25 * 90.0 AS start, t + 0.75 * 90.0 AS stop FROM ev WHERE train = 'error') SELECT {ROUND}, event_id FROM z",
    "seg_as_index": _x(POS + ", k AS (SELECT k FROM v WHERE EXISTS (SELECT 1 FROM a WHERE a.start <= v.t AND v.t < a.stop)), g AS (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM k) SELECT min(k) AS start, max(k) AS stop FROM g GROUP BY g"),
    "seg_partition": _x("k AS (SELECT seg_id, row_number() OVER (ORDER BY start, stop) - 1 AS i, count(*) OVER () AS n FROM a) SELECT seg_id, floor(i / ceil(n / 7))::INTEGER AS part FROM k"),
    "seg_partition_sequence": _x("k AS (SELECT seg_id, row_number() OVER (ORDER BY start, stop) - 1 AS i FROM a) SELECT seg_id, (i % 7)::INTEGER AS part FROM k"),
    "seg_calendar_union": "WITH s AS (SELECT o_custkey AS c, o_orderkey AS k, epoch_us(o_orderdate) / 86400e6 AS start FROM orders), m AS (SELECT c, k, start, start + 10.0 AS stop, max(start + 10.0) OVER (PARTITION BY c ORDER BY start, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s), i AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY start, k ROWS UNBOUNDED PRECEDING) AS i FROM m), g AS (SELECT c, i, min(start) AS start, max(stop) AS stop FROM i GROUP BY c, i) SELECT c AS custkey, count(*) AS n, round(sum(stop - start), 4) AS days FROM g GROUP BY c",
}
