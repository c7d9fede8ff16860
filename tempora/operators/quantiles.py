"""Exact quantiles of large groups: the bits of order statistics are pinned round by round, by counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, LongType

#: Bits that a round pins, a divisor of 64; a group has at most two to their power of counts then.
BITS = 16


@arrow_udf(LongType())
def _ordered(v: pa.Array) -> pa.Array:
    """Whole numbers in the order of the doubles v; both zeros are one, and not-a-number is the largest."""
    bits = (v.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF))


@arrow_udf(DoubleType())
def _double(x: pa.Array) -> pa.Array:
    bits = x.to_numpy(zero_copy_only=False)
    return pa.array((bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.float64))


def order_statistics(data: DataFrame, key: str, value: str, ranks) -> DataFrame:
    """(key, r, v) of the r-th smallest values (from 0) of each group, nulls left out; ranks(n) gives an array of columns r of a group of n.

    Each round scans the data once, counts the values that share a rank's bits so far by their next BITS
    bits, and goes on with those that hold the rank: after four rounds all bits are known. A task's counts
    are summed before they are sent, and a group's window has at most 2 ** BITS rows, whatever its size.
    """
    rows = data.filter(F.col(value).isNotNull()).select(F.col(key).alias("_k"), _ordered(F.col(value).cast("double")).alias("_x"))

    def narrowed(counts: DataFrame) -> DataFrame:
        """counts (_k, _p, _d, n, ranks) to the digits that hold ranks: (_k, _p, ranks), with what is left of the ranks in there."""
        w = Window.partitionBy("_k", "_p").orderBy("_d")
        upto = counts.withColumn("_upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        inside = F.filter("ranks", lambda r: (r["rest"] < F.col("_upto")) & (r["rest"] >= F.col("_upto") - F.col("n")))
        left = F.transform(inside, lambda r: F.struct(r["r"].alias("r"), (r["rest"] - F.col("_upto") + F.col("n")).alias("rest")))
        return upto.select("_k", (F.shiftleft("_p", BITS) + F.col("_d")).alias("_p"), left.alias("ranks")).filter(F.size("ranks") > 0)

    digit = lambda done: F.shiftright("_x", 64 - BITS * (done + 1)).bitwiseAND((1 << BITS) - 1)
    first = rows.groupBy("_k", F.shiftright("_x", 64 - BITS).alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("_k"))
    asked = F.transform(ranks(F.col("_n")), lambda r: F.struct(r.cast("long").alias("r"), r.cast("long").alias("rest")))
    state = narrowed(first.withColumn("_n", total).withColumn("_p", F.lit(0).cast("long")).withColumn("ranks", F.array_distinct(asked)))
    for done in range(1, 64 // BITS):
        s = state.select(F.col("_k").alias("_sk"), F.col("_p").alias("_sp"), "ranks")
        held = rows.join(s, F.col("_k").eqNullSafe(F.col("_sk")) & (F.shiftright("_x", 64 - BITS * done) == F.col("_sp")))
        counts = held.groupBy("_k", F.col("_sp").alias("_p"), digit(done).alias("_d")).agg(F.count(F.lit(1)).alias("n"), F.first("ranks").alias("ranks"))
        state = narrowed(counts)
    return state.select(F.col("_k").alias(key), _double("_p").alias("v"), F.explode("ranks.r").alias("r"))


def quantiles(data: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, q: array of doubles) of each group: its quantiles at shares, between two values linear; nulls are left out, and a group of nulls only has no row."""
    at = lambda n: [F.lit(float(s)) * (n - 1) for s in shares]
    both = lambda n: F.array(*[f(x).cast("long") for x in at(n) for f in (F.floor, F.ceil)])
    found = order_statistics(data, key, value, both).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("_v"))  # two values a share
    n = data.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    rows = found.join(n, F.col(key).eqNullSafe(F.col("_k")))

    def between(x: Column) -> Column:
        low, high = F.col("_v")[F.floor(x).cast("long")], F.col("_v")[F.ceil(x).cast("long")]
        return F.when(low == high, low).otherwise(low + (high - low) * (x - F.floor(x)))

    return rows.select(key, F.array(*[between(x) for x in at(F.col("_n"))]).alias("q"))


def median(data: DataFrame, key: str, value: str) -> DataFrame:
    return quantiles(data, key, value, [0.5]).select(key, F.col("q")[0].alias("median"))
