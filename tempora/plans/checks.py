"""Queries of checks, choices of rows, and conversions of recorded values: events' values as samples, their ids as words and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks as K
from ..functions import formats as X
from ..functions import scalar as S
from ..sources import tables as T
from .events import rounded
from .segments import EV

AXIS = [0.0, 10.0, 25.0, 60.0, 200.0, 1000.0]
TABLE = [[0.0, 1.5, 4.0], [1.5, 0.0, 2.0], [4.0, 2.0, 0.0]]
CODES = [0, 3, 33, 258, 516, 296, 560, 776, 824, 64, 129, 200]


def ev(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d)


def wave(spark: SparkSession, d: str) -> DataFrame:
    """Four samples of two channels from each event."""
    row = lambda k: F.array(F.col("mark") * k - 50, F.col("mark") - 30.0 * k)
    return ev(spark, d).select("event_id", F.array(*[row(k) for k in range(4)]).alias("w"))


def masked(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).select(F.when(F.col("event_id") % 7 != 0, F.col("mark")).alias("red"), F.when(F.col("mark") > 5, F.col("mark")).otherwise(F.lit(float("nan"))).alias("blue"))


def code(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).select("event_id", F.array(*[F.lit(c) for c in CODES])[(F.col("event_id") % len(CODES)).cast("int")].alias("code"))


def scales(spark: SparkSession, d: str) -> DataFrame:
    """Scales of products of two kernels, whose bandwidths are a part's size and price."""
    a, b = F.col("p_size").cast("double"), F.col("p_retailprice") / 1000
    one = [1.0, 1.0]
    return T.table(spark, d, "part").select("p_partkey", *[(F.lit(x) / a / b).alias(n) for n, x in (("gauss", S.truncated_gauss_scale(one, 0.01)), ("epanechnikov", S.epanechnikov_scale(one)), ("box", S.box_scale(one)))])


QUERIES = {
    "chk_vector": lambda s, d: rounded(K.check_vectors(K.check_vector(ev(s, d), "mark"), "train", "mark").groupBy("train").agg(F.count("mark").alias("n"), F.avg("mark").alias("mean")), "mean"),
    "chk_sorted": lambda s, d: K.sortedness(ev(s, d), ["train"], "event_id", "t"),
    "chk_positions": lambda s, d: K.at_positions(ev(s, d), ["train"], ["t", "event_id"], 5, -10, 3).select("train", "event_id"),
    "chk_positions_left": lambda s, d: K.at_positions(ev(s, d), ["train"], ["t", "event_id"], 5, -10, 3, keep=False).select("train", "event_id"),
    "chk_shuffle": lambda s, d: K.shuffle(ev(s, d), ["train"], "event_id", "mark").select("train", "event_id", "mark"),
    "chk_roll": lambda s, d: K.roll(ev(s, d), ["train"], "event_id", "mark").select("train", "event_id", "mark"),
    "chk_axis": lambda s, d: rounded(ev(s, d).select("event_id", K.value_to_index(F.col("mark"), AXIS).alias("i")).withColumn("back", K.index_to_value(F.col("i"), AXIS)), "i", "back", places=9),
    "chk_distance_table": lambda s, d: K.distances_of(ev(s, d).select("event_id", (F.col("event_id") % 3).cast("int").alias("a"), (F.col("user_id") % 3).cast("int").alias("b")), TABLE).select("event_id", "distance"),
    "chk_validity": lambda s, d: rounded(K.validity(masked(s, d), ["red", "blue"]), "red", "blue"),
    "chk_same_rows": lambda s, d: s.createDataFrame([(K.same_rows(T.train(s, d, "view"), T.train(s, d, "view")), K.same_rows(T.train(s, d, "view"), T.train(s, d, "click")), K.has_rows(T.train(s, d, "view")))], "same boolean, other boolean, full boolean"),
    "fn_timestamps": lambda s, d: ev(s, d).select("event_id", X.seconds_to_ticks(F.col("mark")).alias("ticks"), X.seconds_to_micros(F.col("mark")).alias("micros")),
    "fn_volts": lambda s, d: rounded(ev(s, d).select("event_id", X.to_volts(F.col("mark"), 500.0, True, "uV").alias("v")), "v", places=9),
    "fn_waveform_volts": lambda s, d: rounded(wave(s, d).select("event_id", F.posexplode(X.waveform_to_volts(F.col("w"), F.array(F.lit(500.0), F.lit(1000.0)), False, "mV")).alias("k", "_v")).select("event_id", "k", F.col("_v")[0].alias("a"), F.col("_v")[1].alias("b")), "a", "b", places=12),
    "fn_waveform_peaks": lambda s, d: rounded(wave(s, d).select("event_id", X.peaks(F.col("w")).alias("p"), X.peaks(F.col("w"), False).alias("q")).select("event_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.col("q")[0].alias("c"), F.col("q")[1].alias("d")), "a", "b", "c", "d"),
    "fn_sample_times": lambda s, d: ev(s, d).select("event_id", F.posexplode(X.sample_times(F.col("event_id") * 100, F.array(*[F.lit(0)] * 3), 400.0)).alias("k", "ticks")),
    "fn_records": lambda s, d: ev(s, d).withColumn("r", X.record_of(F.col("event_id"), 512)).select("event_id", "r.record", F.col("r.offset").alias("place"), X.sample_of(F.col("r.record"), F.col("r.offset"), 512).alias("back")),
    "fn_filter_code": lambda s, d: code(s, d).select("event_id", "code", X.filter_of(F.col("code")).alias("f")).select("event_id", "code", "f.low", "f.high"),
    "fn_kernel_scales": lambda s, d: rounded(scales(s, d), "gauss", "epanechnikov", "box", places=12),
}

LOW = " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in X.HIGH_PASS.items())
HIGH = " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in X.LOW_PASS.items())
POS = f"WITH {EV}, p AS (SELECT train, event_id, row_number() OVER (PARTITION BY train ORDER BY t, event_id) - 1 AS p, count(*) OVER (PARTITION BY train) AS n FROM ev), h AS (SELECT *, p >= 5 AND p < greatest(n - 10, 0) AND (p - 5) % 3 = 0 AS hit FROM p)"
WAVE = f"WITH {EV}, w AS (SELECT event_id, k, mark * k - 50 AS a, mark - 30.0 * k AS b FROM ev, range(4) r(k))"
STEPS = " ".join(f"WHEN mark < {hi} THEN {k} + (mark - {lo}) / ({hi} - {lo})" for k, (lo, hi) in enumerate(zip(AXIS, AXIS[1:], strict=False)))
ORACLE_SQL = {
    "chk_vector": f"WITH {EV} SELECT train, count(mark) AS n, round(avg(mark), 6) AS mean FROM ev GROUP BY train",
    "chk_sorted": f"WITH {EV}, d AS (SELECT train, t - lag(t) OVER (PARTITION BY train ORDER BY event_id) AS d FROM ev), b AS (SELECT train, coalesce(bool_or(d > 0), false) AS u, coalesce(bool_or(d < 0), false) AS w, coalesce(bool_or(d = 0), false) AS s FROM d GROUP BY train) SELECT train, NOT w AS ascending, NOT u AS descending, NOT s AND (NOT w OR NOT u) AS strictly, NOT w OR NOT u AS sorted FROM b",
    "chk_positions": POS + " SELECT train, event_id FROM h WHERE hit",
    "chk_positions_left": POS + " SELECT train, event_id FROM h WHERE NOT hit",
    "chk_shuffle": f"WITH {EV}, a AS (SELECT train, event_id, row_number() OVER (PARTITION BY train ORDER BY event_id) AS p FROM ev), b AS (SELECT train, mark, row_number() OVER (PARTITION BY train ORDER BY md5('0|' || train || '|' || event_id), event_id) AS p FROM ev) SELECT train, event_id, mark FROM a JOIN b USING (train, p)",
    "chk_roll": f"WITH {EV}, a AS (SELECT train, event_id, mark, row_number() OVER (PARTITION BY train ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY train) AS n FROM ev), b AS (SELECT train, mark, (p + ('0x' || substr(md5('0|' || train), 1, 13))::BIGINT % n) % n AS p FROM a) SELECT train, event_id, b.mark FROM a JOIN b USING (train, p)",
    "chk_axis": f"WITH {EV} SELECT event_id, round(CASE WHEN mark <= 0 THEN 0 {STEPS} ELSE 5 END, 9) AS i, round(least(greatest(mark, 0), 1000.0), 9) AS back FROM ev",
    "chk_distance_table": "SELECT event_id, [[0.0::DOUBLE, 1.5, 4.0], [1.5, 0.0, 2.0], [4.0, 2.0, 0.0]][event_id % 3 + 1][user_id % 3 + 1] AS distance FROM events",
    "chk_validity": f"WITH {EV} SELECT round(100 * avg((event_id % 7 <> 0)::INTEGER), 6) AS red, round(100 * avg((mark > 5)::INTEGER), 6) AS blue FROM ev",
    "chk_same_rows": f"WITH {EV}, v AS (SELECT * FROM ev WHERE train = 'view'), c AS (SELECT * FROM ev WHERE train = 'click'), x AS (SELECT * FROM v EXCEPT ALL SELECT * FROM v), y AS (SELECT * FROM v EXCEPT ALL SELECT * FROM c), z AS (SELECT * FROM c EXCEPT ALL SELECT * FROM v) SELECT (SELECT count(*) FROM x) = 0 AS same, (SELECT count(*) FROM y) + (SELECT count(*) FROM z) = 0 AS other, (SELECT count(*) FROM v) > 0 AS \"full\"",
    "fn_timestamps": f"WITH {EV} SELECT event_id, trunc(mark * 10000)::BIGINT AS ticks, trunc(mark * 1000000)::BIGINT AS micros FROM ev",
    "fn_volts": f"WITH {EV} SELECT event_id, round(mark * ((10.0::DOUBLE / 2048) / 500.0) * -1e6, 9) AS v FROM ev",
    "fn_waveform_volts": WAVE + " SELECT event_id, k::INTEGER AS k, round(a * ((10.0::DOUBLE / 2048) / 500.0) * 1e3, 12) AS a, round(b * ((10.0::DOUBLE / 2048) / 1000.0) * 1e3, 12) AS b FROM w",
    "fn_waveform_peaks": WAVE + " SELECT event_id, round(max(a), 6) AS a, round(max(b), 6) AS b, round(max(-a), 6) AS c, round(max(-b), 6) AS d FROM w GROUP BY event_id",
    "fn_sample_times": "SELECT event_id, k::INTEGER AS k, event_id * 100 + k * 25 AS ticks FROM events, range(3) r(k)",
    "fn_records": "SELECT event_id, event_id // 512 AS record, event_id % 512 AS place, event_id AS back FROM events",
    "fn_filter_code": f"WITH c AS (SELECT event_id, {CODES!r}[event_id % {len(CODES)} + 1]::INTEGER AS code FROM events) SELECT event_id, code, CASE code & 31 {LOW} END AS low, CASE code & 992 {HIGH} END AS high FROM c",
    "fn_kernel_scales": "SELECT p_partkey, round(1 / (2 * pi()) / a / b / pow(0.99, 2), 12) AS gauss, round(2 / pi() / a / b, 12) AS epanechnikov, round(1 / pi() / a / b, 12) AS box FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice / 1000 AS b FROM part)",
}
