"""Event gate, low-activity skips and cumulative score of bins, in batch; surrogates.py has the test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins beyond which the distance in time no longer grows.
TIME_REACH = 3


def event_gate(bins: DataFrame, threshold: float = 8.1, consecutive: int = 3) -> DataFrame:
    """bins (session, bin, mua) with start: true where so many consecutive bins first reach the threshold; once a run."""
    w = Window.partitionBy("session").orderBy("bin")
    high = F.col("mua") >= threshold
    run = bins.withColumn("_r", F.sum(F.when(high, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.when(high, 1).otherwise(0)).over(Window.partitionBy("session", "_r").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("start", high & (nth == consecutive)).drop("_r")


def cumulative_score(bins: DataFrame, level: float = 0.05, reset: Column | None = None) -> DataFrame:
    """bins (session, bin, p) with score: running sum of -ln p where p < level, from 0 again at each reset."""
    w = Window.partitionBy("session").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    part = bins.withColumn("_i", F.sum(F.when(F.col("start") if reset is None else reset, 1).otherwise(0)).over(w))
    own = Window.partitionBy("session", "_i").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return part.withColumn("score", F.sum(F.when(F.col("p") < level, -F.ln("p")).otherwise(0.0)).over(own)).drop("_i")


def low_activity(bins: DataFrame, least: int = 3, skips: int = 3) -> DataFrame:
    """bins (session, bin, mua) with skipped (fewer than least spikes) and cleared (the skips-th or a later skip in a row)."""
    w = Window.partitionBy("session").orderBy("bin")
    low = F.col("mua") < least
    run = bins.withColumn("_r", F.sum(F.when(low, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.when(low, 1).otherwise(0)).over(Window.partitionBy("session", "_r").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumns({"skipped": low, "cleared": low & (nth >= skips)}).drop("_r")
