"""Range, interval, band and as-of joins as equi-joins on buckets or as windows; none plans a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A level's buckets are so many times as wide as those of the level below.
STEP = 16
#: Least number of parts that points meet very long segments in; each such segment is listed in all of them.
SALTS = 32
#: Least number of stretches of time that a window without keys is cut into, and those for each task.
STRETCHES, STRETCHES_PER_TASK = 256, 4


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salts(df: DataFrame) -> int:
    """Parts of the extra level: as many as there are tasks, SALTS at least."""
    return max(SALTS, tasks(df))


def _bucket(x: Column, width: float, level: Column) -> Column:
    return F.floor(x / (F.lit(float(width)) * F.pow(F.lit(float(STEP)), level)))


def by_bucket(segs: DataFrame, width: float, levels: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """segs with _level and _bucket: a segment is listed in the buckets that it touches on the level of its length.

    Lengths up to STEP * width * STEP ** level stay on a level, so a segment is in STEP + 1 buckets at
    most; what is longer than the top level allows, infinite ends included, is in all parts of the extra
    level `levels`, over which points are dealt by hash.
    """
    length = F.col(stop) - F.col(start)
    level = F.lit(levels)
    for k in range(levels - 1, -1, -1):
        level = F.when(length <= float(width) * STEP ** (k + 1), k).otherwise(level)
    lo, hi = _bucket(F.col(start), width, F.col("_level")), _bucket(F.col(stop), width, F.col("_level"))
    listed = F.when(F.col("_level") < levels, F.sequence(lo, hi)).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(salts(segs) - 1).cast("long")))
    return segs.withColumn("_level", level.cast("int")).withColumn("_bucket", F.explode(listed))


def _salt(x: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(parts).cast("long"))


def range_join(points: DataFrame, segs: DataFrame, width: float, keys: tuple[str, ...] = (), x: str = "t", closed: bool = False, how: str = "inner", levels: int = 2) -> DataFrame:
    """Rows of points with each segment of equal keys that has start <= x < stop (closed: <= stop).

    width: about the usual length of a segment. how: inner, left, left_semi or left_anti. Each point is
    listed once a level that has segments; a pair meets in one bucket only, so none comes twice. Null ends
    or x match nothing.
    """
    parts = salts(segs)
    s = by_bucket(segs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in segs.columns if c not in keys]), width, levels)
    every = F.array(*[F.struct(F.lit(k).alias("l"), _bucket(F.col(x), width, F.lit(float(k))).alias("b")) for k in range(levels)], F.struct(F.lit(levels).alias("l"), _salt(F.col(x), parts).alias("b")))
    inside = (F.col(x) >= F.col("start")) & ((F.col(x) <= F.col("stop")) if closed else (F.col(x) < F.col("stop")))
    on = (F.col("_p.l") == F.col("_level")) & (F.col("_p.b") == F.col("_bucket")) & inside
    for i, c in enumerate(keys):
        on = on & (F.col(c) == F.col(f"_k{i}"))
    if how == "inner":
        used = s.select(F.col("_level").alias("_used")).distinct()  # levels + 1 rows at most
        listed = points.withColumn("_p", F.explode(every)).join(F.broadcast(used), F.col("_p.l") == F.col("_used"), "left_semi")
        return listed.join(s, on).drop("_p", "_level", "_bucket", *[f"_k{i}" for i in range(len(keys))])
    # the others go level by level: what no level matches, and what one of them does
    def at(rows: DataFrame, k: int, kind: str) -> DataFrame:
        bucket = _bucket(F.col(x), width, F.lit(float(k))) if k < levels else _salt(F.col(x), parts)
        cond = (bucket == F.col("_bucket")) & inside
        for i, c in enumerate(keys):
            cond = cond & (F.col(c) == F.col(f"_k{i}"))
        return rows.join(s.filter(F.col("_level") == k), cond, kind)

    none, some = points, None
    for k in range(levels + 1):
        hit = at(none, k, "left_semi")
        some = hit if some is None else some.unionByName(hit)
        none = at(none, k, "left_anti")
    if how == "left_semi":
        return some
    if how == "left_anti":
        return none
    return range_join(points, segs, width, keys, x, closed, "inner", levels).unionByName(none, allowMissingColumns=True)


def interval_join(a: DataFrame, b: DataFrame, width: float, keys: tuple[str, ...] = (), closed: bool = False, levels: int = 2) -> DataFrame:
    """Pairs of overlapping segments of equal keys: a's columns with suffix _a, b's with _b.

    Open overlap a.start < b.stop and b.start < a.stop; closed also takes touching ends. A segment lies
    on the level of its length and is listed in the few buckets that it touches there and on all coarser
    levels; a pair meets on the coarser one's level and is kept in the first bucket that both touch. What
    is too long for the levels, infinite ends included, meets all others of its keys, dealt by hash; two
    such segments meet in the part of the first one.
    """
    side = lambda df, s: df.select(*[F.col(c).alias(c if c in keys else f"{c}_{s}") for c in df.columns])

    def listed(df: DataFrame, s: str) -> DataFrame:
        """df with level _n (of its length), _l (of a listing) and _b (bucket)."""
        lo, hi = F.col(f"start_{s}"), F.col(f"stop_{s}")
        own = F.lit(levels)
        for k in range(levels - 1, -1, -1):
            own = F.when(hi - lo <= float(width) * STEP ** (k + 1), k).otherwise(own)
        parts = F.array(*[F.lit(k) for k in range(levels)])
        seen = F.flatten(F.transform(F.filter(parts, lambda k: k >= F.col(f"_n{s}")), lambda k: F.transform(F.sequence(_bucket(lo, width, k.cast("double")), _bucket(hi, width, k.cast("double"))), lambda b: F.struct(k.alias("l"), b.alias("b")))))
        salt = F.pmod(F.xxhash64(lo, hi), F.lit(salts(a)).cast("long"))
        long_ = lambda at: F.struct(F.lit(levels).alias("l"), at.alias("b"))
        every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(salts(a) - 1).cast("long")), long_)
        # on the extra level a's long segments lie in all parts, b's in their own; shorter ones of either side in their own
        top = F.when(F.col(f"_n{s}") < levels, F.array(long_(salt))).otherwise(every)
        out = df.filter(lo.isNotNull() & hi.isNotNull() & ~F.isnan(lo) & ~F.isnan(hi)).withColumn(f"_n{s}", own)
        out = out.withColumn(f"_e{s}", F.explode(F.concat(F.when(F.col(f"_n{s}") < levels, seen).otherwise(F.array().cast("array<struct<l:int,b:bigint>>")), top)))
        return out.withColumn(f"_s{s}", salt)

    # a listing above a segment's own level meets only what has that level as its own
    used = lambda df, s: df.select(F.col(f"_n{s}").alias("_used")).distinct()  # noqa: E731  # levels + 1 rows at most
    def wanted(df: DataFrame, s: str, other: DataFrame, o: str) -> DataFrame:
        on = (F.col(f"_e{s}.l") == F.col(f"_n{s}")) | (F.col(f"_e{s}.l") == F.col("_used"))
        return df.join(F.broadcast(used(other, o)), on, "left_semi")

    x, y = listed(side(a, "a"), "a"), listed(side(b, "b"), "b")
    x, y = wanted(x, "a", y, "b"), wanted(y, "b", x, "a")
    for i, c in enumerate(keys):
        y = y.withColumnRenamed(c, f"_k{i}")
    at = F.greatest("_na", "_nb")
    first = F.greatest(_bucket(F.col("start_a"), width, at.cast("double")), _bucket(F.col("start_b"), width, at.cast("double")))
    # of two long segments the part of a's counts; of a long and a shorter one the shorter one's
    part = F.when((F.col("_na") == levels) & (F.col("_nb") < levels), F.col("_sb")).otherwise(F.col("_sa"))
    on = (F.col("_ea.l") == F.col("_eb.l")) & (F.col("_ea.b") == F.col("_eb.b"))
    on = on & (F.col("_ea.l") == at) & (F.col("_ea.b") == F.when(at < levels, first).otherwise(part))
    on = on & ((F.col("start_a") <= F.col("stop_b")) & (F.col("start_b") <= F.col("stop_a")) if closed else (F.col("start_a") < F.col("stop_b")) & (F.col("start_b") < F.col("stop_a")))
    for i, c in enumerate(keys):
        on = on & (F.col(c) == F.col(f"_k{i}"))
    return x.join(y, on).drop("_na", "_nb", "_ea", "_eb", "_sa", "_sb", *[f"_k{i}" for i in range(len(keys))])


def cuts(df: DataFrame, t: str, parts: int | None = None) -> list[float]:
    """Times that cut df into parts (a few for each task, by default) of about as many rows: quantiles, as the driver's constants. For times that crowd; stretches takes them."""
    n = parts or STRETCHES_PER_TASK * tasks(df)
    x = df.filter(F.abs(F.col(t)) < float("inf")).agg(F.percentile_approx(t, [k / n for k in range(1, n)], 100 * n)).first()[0]
    return sorted(set(x or []))


def _place(t: Column, at: list[float], lo: int = 0) -> Column:
    """How many of the sorted times at are at or before t, by halving."""
    if not at:
        return F.lit(lo)
    mid = len(at) // 2
    return F.when(t < at[mid], _place(t, at[:mid], lo)).otherwise(_place(t, at[mid + 1 :], lo + mid + 1))


def stretches(df: DataFrame, t: str, name: str = "_c", parts: int | None = None, at: list[float] | None = None) -> DataFrame:
    """df with the number of the stretch that t lies in: between the times at, or of parts even ones; what isn't finite is in the first or last one."""
    if at is not None:
        return df.withColumn(name, _place(F.col(t), sorted(at)).cast("int"))
    parts = parts or max(STRETCHES, STRETCHES_PER_TASK * tasks(df))
    x = F.when(F.abs(F.col(t)) < float("inf"), F.col(t))
    ends = df.agg(F.min(x).alias("_t0"), F.max(x).alias("_t1"))  # one row
    at = F.floor((F.col(t) - F.col("_t0")) * parts / F.when(F.col("_t1") > F.col("_t0"), F.col("_t1") - F.col("_t0")))
    bound = F.when(F.col(t) == float("-inf"), 0).when(F.col(t) == float("inf"), parts).otherwise(F.coalesce(at, F.lit(0)))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, bound.cast("int")).drop("_t0", "_t1")


def running(df: DataFrame, keys: list[str], chunk: str, order: list, value: Column, kind: str, name: str, before: bool = False) -> DataFrame:
    """df with name: the running sum, max or last non-null of value in order, row by row inside the chunks and one row a chunk between them.

    before: without the row itself. chunk rises with order; only the chunks' totals of equal keys meet in one task.
    """
    of = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    marked = df.withColumns({"_v": value}).withColumn("_own", of(F.col("_v")).over(inside))
    if kind == "last":
        held = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        totals = marked.withColumn("_all", of(F.col("_v")).over(held)).groupBy(*keys, chunk).agg(F.first("_all").alias("_t"))
    else:
        totals = marked.groupBy(*keys, chunk).agg(of(F.col("_v")).alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate([*keys, chunk])], of(F.col("_t")).over(earlier).alias("_carry"))
    on = F.lit(True)
    for i, k in enumerate([*keys, chunk]):
        on = on & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    both = {"sum": F.coalesce("_own", F.lit(0)) + F.coalesce("_carry", F.lit(0)), "max": F.greatest("_own", "_carry"), "last": F.coalesce("_own", "_carry")}[kind]
    return marked.join(carry, on).withColumn(name, both).drop("_v", "_own", "_carry", *[f"_j{i}" for i in range(len(keys) + 1)])


def asof(left: DataFrame, right: DataFrame, values: list[str], keys: tuple[str, ...] = (), t: str = "t", backward: bool = True, strict: bool = False) -> DataFrame:
    """left with the struct _asof (t, *values) of the last right row at or before its t (backward) or the first at or after.

    One union and one window; equal times match unless strict. Null where there is none, or t is. The
    window is cut into stretches of right's time, which hand their last right row on: a row a stretch, and
    key. left rows before or after all of right are dealt by hash.
    """
    place = 1 if (backward != strict) else 0  # left rows sort after (1) or before right rows of the same time
    held = right.select(F.struct(F.col(t).alias("t"), *values)).schema[0].dataType
    a = left.select(F.struct("*").alias("_l"), *keys, F.col(t).alias("_t"), F.lit(place).alias("_o"), F.lit(None).cast(held).alias("_r"))
    b = right.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), *keys, F.col(t).alias("_t"), F.lit(1 - place).alias("_o"), F.struct(F.col(t).alias("t"), *values).alias("_r"))
    order = ["_t", "_o"] if backward else [F.desc("_t"), F.desc("_o")]  # a frame that grows from the start is linear, one up to the end isn't
    parts = max(STRETCHES, STRETCHES_PER_TASK * tasks(left))
    finite = F.when(F.abs(F.col(t)) < float("inf"), F.col(t))
    ends = right.agg(F.min(finite).alias("_t0"), F.max(finite).alias("_t1"))  # one row

    def placed(df: DataFrame) -> DataFrame:
        x, (t0, t1), salt = F.col("_t"), (F.col("_t0"), F.col("_t1")), F.pmod(F.xxhash64("_t"), F.lit(parts).cast("long"))
        inside = F.least(F.floor((x - t0) * parts / F.when(t1 > t0, t1 - t0)), F.lit(parts - 1))
        at = F.when(x < t0, -1 - salt).when(x > t1, parts + salt).otherwise(F.coalesce(inside, F.lit(0)))
        return df.crossJoin(F.broadcast(ends)).withColumn("_c", at.cast("long")).drop("_t0", "_t1")

    far = F.col("_t").isin(float("inf"), float("-inf"))  # infinite right rows have stretches of their own beyond all others
    edge = F.when(F.col("_t") == float("inf"), 2 * parts).when(F.col("_t") == float("-inf"), -parts - 1)
    both = placed(a.unionByName(b)).withColumn("_c", F.coalesce(edge, F.col("_c")))
    own = F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    each = placed(b.filter(F.col("_t").isNotNull()).select(*keys, "_t", "_r")).withColumn("_c", F.coalesce(F.when(far, edge), F.col("_c"))).groupBy(*keys, "_c").agg((F.max("_r") if backward else F.min("_r")).alias("_r"))
    if keys:
        # a row a key and stretch of right's; a stretch of both looks for the nearest such stretch before it
        held = [F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]
        w = Window.partitionBy(*[f"_h{i}" for i in range(len(keys))]).orderBy("_k" if backward else F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
        seen = placed(a).withColumn("_c", F.coalesce(edge, F.col("_c"))).select(*held, F.col("_c").alias("_k"), F.lit(None).cast(each.schema["_r"].dataType).alias("_r")).distinct()
        line = seen.unionByName(each.select(*held, F.col("_c").alias("_k"), "_r")).groupBy(*[f"_h{i}" for i in range(len(keys))], "_k").agg(F.max("_r").alias("_r"), F.max(F.col("_r").isNull()).alias("_asked"))
        carry = line.withColumn("_carry", F.last("_r", ignorenulls=True).over(w)).filter("_asked").drop("_r", "_asked")
        on = F.col("_c") == F.col("_k")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_h{i}"))
        lined = both.withColumn("_own", own).filter("_l IS NOT NULL").join(carry, on)
        return lined.select("_l.*", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carry")).alias("_asof"))
    every = left.sparkSession.range(-parts - 1, 2 * parts + 1).withColumnRenamed("id", "_k")
    handed = F.last("_r", ignorenulls=True).over(Window.orderBy("_k" if backward else F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1))
    carry = every.join(each, F.col("_k") == F.col("_c"), "left").select("_k", handed.alias("_carry"))  # 3 * parts + 2 rows
    lined = both.withColumn("_own", own).filter("_l IS NOT NULL").join(F.broadcast(carry), F.col("_c") == F.col("_k"))
    return lined.select("_l.*", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carry")).alias("_asof"))


def interpolate(points: DataFrame, samples: DataFrame, value: str, keys: tuple[str, ...] = (), t: str = "t") -> DataFrame:
    """points with value linearly interpolated from samples at t; null outside the samples' range."""
    both = asof(asof(points, samples, [value], keys, t).withColumnRenamed("_asof", "_lo"), samples, [value], keys, t, backward=False).withColumnRenamed("_asof", "_hi")
    lo, hi = F.col("_lo"), F.col("_hi")
    at = F.when(lo["t"] == hi["t"], lo[value]).otherwise(lo[value] + (hi[value] - lo[value]) * (F.col(t) - lo["t"]) / (hi["t"] - lo["t"]))
    return both.withColumn(value, at).drop("_lo", "_hi")
