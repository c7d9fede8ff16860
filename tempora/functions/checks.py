"""Checks and choices of rows by position: vectors are a numeric column in order of another one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import seeded, seeded_whole
from pyspark.sql.types import NumericType, StructType


def check_vector(df: DataFrame, column: str) -> DataFrame:
    """df; a column that isn't real numbers is an error, null and nan are kept."""
    if not isinstance(df.schema[column].dataType, NumericType):
        raise TypeError(f"{column} doesn't hold real numbers")
    return df


def check_vectors(df: DataFrame, key: str, column: str, same_length: bool = False) -> DataFrame:
    """df, as check_vector; with same_length keys of different numbers of rows fail the query."""
    check_vector(df, column)
    if not same_length:
        return df
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))  # one row
    ok = F.when(F.col("_lo") < F.col("_hi"), F.raise_error(F.lit("vectors of different lengths")).cast("boolean")).otherwise(F.lit(True))
    return df.join(F.broadcast(n)).filter(ok).drop("_lo", "_hi")


def check_points(df: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    for c in columns:
        check_vector(df, c)
    return df


def is_shaped(df: DataFrame, schema: StructType) -> bool:
    """Whether df has the fields of schema, in any order."""
    have = {f.name: f.dataType for f in df.schema}
    return all(have.get(f.name) == f.dataType for f in schema)


def sortedness(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """(keys, ascending, descending, strictly, sorted): whether values rise or fall in order, equals allowed but for strictly; sorted: either way. One row has all."""
    d = F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy(order))
    up, down, same = (F.coalesce(F.bool_or(x), F.lit(False)) for x in (F.col("_d") > 0, F.col("_d") < 0, F.col("_d") == 0))
    got = df.withColumn("_d", d).groupBy(*keys).agg(up.alias("_u"), down.alias("_w"), same.alias("_s"))
    asc, desc = ~F.col("_w"), ~F.col("_u")
    return got.select(*keys, asc.alias("ascending"), desc.alias("descending"), (~F.col("_s") & (asc | desc)).alias("strictly"), (asc | desc).alias("sorted"))


def at_positions(df: DataFrame, keys: list[str], order: list[str], start: int | None = None, stop: int | None = None, step: int = 1, keep: bool = True) -> DataFrame:
    """The rows of each key at positions start to stop (excluded, negative ones count from the end) in steps; keep False: all others."""
    w = Window.partitionBy(*keys)
    p, n = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    place = lambda k, none: none if k is None else F.lit(k) if k >= 0 else F.greatest(F.col("_n") + k, F.lit(0))
    lo, hi = place(start, F.lit(0)), place(stop, F.col("_n"))
    hit = (F.col("_p") >= lo) & (F.col("_p") < hi) & ((F.col("_p") - lo) % step == 0)
    return df.withColumns({"_p": p, "_n": n}).filter(hit if keep else ~hit).drop("_p", "_n")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def shuffle(df: DataFrame, keys: list[str], order: str, column: str, seed: int = 0) -> DataFrame:
    """df with column's values dealt anew among the rows of each key, by a seeded hash of key and order: the same on every run."""
    own = Window.partitionBy(*keys)
    by = seeded(seed, *keys, order)
    rows = df.withColumn("_p", F.row_number().over(own.orderBy(order)))
    values = df.select(*keys, F.col(column).alias("_v"), F.row_number().over(own.orderBy(by, order)).alias("_p"))
    return rows.join(values, [*keys, "_p"]).withColumn(column, F.col("_v")).drop("_v", "_p")


def roll(df: DataFrame, keys: list[str], order: str, column: str, seed: int = 0) -> DataFrame:
    """df with column's values moved on along each key's rows, around the end, by a seeded offset of the key."""
    own = Window.partitionBy(*keys)
    rows = df.withColumns({"_p": F.row_number().over(own.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(own)})
    values = rows.select(*keys, F.col(column).alias("_v"), F.pmod(F.col("_p") + F.pmod(seeded_whole(seed, *keys), F.col("_n")), F.col("_n")).alias("_p"))
    return rows.join(values, [*keys, "_p"]).withColumn(column, F.col("_v")).drop("_v", "_p", "_n")


def value_to_index(x: Column, values: list[float]) -> Column:
    """Fractional index of x on an axis of rising values; beyond its ends the end's."""
    out = F.lit(float(len(values) - 1))
    for k in range(len(values) - 2, -1, -1):
        out = F.when(x < values[k + 1], k + (x - values[k]) / (values[k + 1] - values[k])).otherwise(out)
    return F.when(x <= values[0], 0.0).otherwise(out)


def index_to_value(i: Column, values: list[float]) -> Column:
    at = F.array(*[F.lit(float(v)) for v in values])
    j = F.least(F.greatest(i, F.lit(0.0)), F.lit(len(values) - 1.0))
    k = F.least(F.floor(j), F.lit(max(len(values) - 2, 0))).cast("int")
    return at[k] + (j - k) * (at[F.least(k + 1, F.lit(len(values) - 1))] - at[k])


def distances_of(pairs: DataFrame, table: list[list[float]], a: str = "a", b: str = "b") -> DataFrame:
    """pairs with distance: the entry of a driver-side table at the numbers a and b."""
    n = len(table)
    flat = F.array(*[F.lit(float(v)) for row in table for v in row])
    return pairs.withColumn("distance", flat[F.col(a) * n + F.col(b)])


def validity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: of each column the percentage of rows that hold a number."""
    return rows.agg(*[(100 * F.avg(F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(1.0))).alias(c) for c in columns])
