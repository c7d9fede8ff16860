"""Queries of record files and of training a decoder: events written as records and read again by time, and merged with the views' values as positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encoding as N
from ..sources import recordfiles as X
from ..sources import tables as T
from .events import rounded
from .segments import EV, SEGS, WIDTH, a

#: Two days of the table, both ends in.
START, STOP = 86400.0, 259200.0
FIELDS = "timestamp,8,4,1\tevent_id,12,8,1\tmark,5,8,1\ttrain,10,1,16"


def recorded(spark: SparkSession, d: str) -> str:
    """A folder of all events as records, in order of time, with a tick a second."""
    folder = T.scratch(spark)
    rows = T.events(spark, d).select(F.floor("t").cast("long").alias("timestamp"), "event_id", "mark", "train")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    X.write(rows.repartitionByRange(parts, "timestamp", "event_id").sortWithinPartitions("timestamp", "event_id"), folder, FIELDS, timescale="1")
    return folder


def timeslice(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, recorded(spark, d), START, STOP).select("record", "time", "event_id", "mark", "train")


def encoded(spark: SparkSession, d: str) -> N.Encoded:
    e = T.events(spark, d)
    spikes = e.filter("train <> 'view'").select(F.col("train").alias("source"), F.col("event_id").alias("id"), "t", F.array("mark").alias("x"))
    return N.encode(spikes, T.train(spark, d, "view").select("t", F.col("mark").alias("linear_position")), a(spark, d), [1.0, 1.0], 0.0, WIDTH)


QUERIES = {
    "rec_timeslice": timeslice,
    "enc_counts": lambda s, d: encoded(s, d).counts,
    "enc_components": lambda s, d: rounded(encoded(s, d).components.select("source", "weight", F.col("mean")[0].alias("mark"), F.col("mean")[1].alias("position")), "weight", "mark", "position"),
}

TRAINED = f"{SEGS}, i AS (SELECT * FROM ev WHERE EXISTS (SELECT 1 FROM a WHERE start <= t AND t < stop)), n AS (SELECT train AS source, count(*) AS n FROM i WHERE train <> 'view' GROUP BY train)"

ORACLE_SQL = {
    "rec_timeslice": f"WITH {EV}, r AS (SELECT row_number() OVER (ORDER BY floor(t), event_id) - 1 AS record, floor(t) AS time, event_id, mark, train FROM ev) SELECT * FROM r WHERE time >= {START} AND time <= {STOP}",
    "enc_counts": f"WITH {TRAINED} SELECT * FROM n",
    "enc_components": f"""WITH {TRAINED}, v AS (SELECT t, mark AS v FROM i WHERE train = 'view'), s AS (SELECT train AS source, t, mark FROM i JOIN n ON train = source WHERE n > 10),
lo AS (SELECT s.*, v.t AS t0, v.v AS v0 FROM s ASOF JOIN v ON s.t >= v.t), hi AS (SELECT lo.*, v.t AS t1, v.v AS v1 FROM lo ASOF JOIN v ON lo.t <= v.t)
SELECT source, round(1 / count(*) OVER (PARTITION BY source), 6) AS weight, round(mark, 6) AS mark, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS position FROM hi""",
}
