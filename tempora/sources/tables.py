"""The driver's tables as trains of events, segments and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the folder that the cluster's checkpoints go to, or, on a local master that names none, in a temporary one."""
    import tempfile
    import uuid

    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    top = held.get() if held.nonEmpty() else spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that executors share")
    return f"{top or tempfile.mkdtemp(prefix='tempora-')}/{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, train, t, mark): t in seconds of 2024."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("train"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - EPOCH).alias("t"), F.col("value").alias("mark"))


def train(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("train") == name)


def segments(spark: SparkSession, sf_dir: str, name: str, seconds: float, reference: float = 0.5) -> DataFrame:
    """(set_id, seg_id, start, stop): a segment of so many seconds about each event of a train."""
    return train(spark, sf_dir, name).select(F.lit(name).alias("set_id"), F.col("event_id").alias("seg_id"), (F.col("t") - reference * seconds).alias("start"), (F.col("t") + (1 - reference) * seconds).alias("stop"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, i, t, v): the events' values as samples; one channel per event type, numbered in time."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("train").orderBy("t", "event_id")) - 1
    return events(spark, sf_dir).select(F.col("train").alias("channel"), i.cast("long").alias("i"), "t", F.col("mark").alias("v"))
