"""Sharding by histogram sort: exact byte counts below probe keys are refined until splitters meet the tolerance, then rows are exchanged once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, partitions, table, thrifty, without

#: Keys are 63-bit longs: 32 bits of the group's hash, then 31 bits that spread the rows of a group.
KEY_END, GROUP = 1 << 63, 31
#: Groups of more than this share of a shard are placed one by one; there are shards / HEAVY of them at most.
HEAVY = 0.02


def heavy_mask(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Whether each key is of one of the sorted heavy groups."""
    if not len(heavy):
        return np.zeros(len(keys), bool)
    group = keys >> GROUP
    at = np.minimum(np.searchsorted(heavy, group), len(heavy) - 1)
    return heavy[at] == group


def below(keyed: DataFrame, probes: np.ndarray, heavy: np.ndarray, is_heavy: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) of keyed (key, size) below each of the sorted probes, of the heavy groups only or of all others; each task sends one partial histogram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(probes) + 1, np.int64)
        rows = np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            meant = heavy_mask(key, heavy) == is_heavy
            at = np.searchsorted(probes, key[meant], side="right")
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False)[meant])
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], names=["at", "size", "rows"])

    parts = keyed.mapInArrow(thrifty(count), "at long, size long, rows long")
    size = np.zeros(len(probes) + 1, np.int64)
    rows = np.zeros(len(probes) + 1, np.int64)
    for r in parts.groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect():  # one row a probe at most
        size[r["at"]], rows[r["at"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keyed: DataFrame, want: list[int], tolerance: int, unit: int, heavy: np.ndarray, is_heavy: bool, first: int = 48, probes: int = 48) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """((key, bytes and rows below) for each of the wanted numbers of bytes below, rows below all probes by key).

    Each round puts probes keys, whole multiples of unit, into every open splitter's interval (first ones
    into the first) and counts exactly what lies below; the interval shrinks to the two probes around the
    target. A splitter closes once its bytes are within tolerance of the target, or no multiple lies
    inside its interval: then it is the nearer of the two.
    """
    lo, hi = [0] * len(want), [KEY_END // unit - 1] * len(want)
    best = [(abs(w), 0, 0, 0) for w in want]
    ready, seen, turn = [False] * len(want), {}, first
    while not all(ready):
        inner = {lo[i] + (hi[i] - lo[i]) * k // (turn + 1) for i, done in enumerate(ready) if not done for k in range(1, turn + 1)}
        keys = np.array(sorted(inner | {hi[i] for i, done in enumerate(ready) if not done}), dtype=np.int64) * unit
        size, rows = below(keyed, keys, heavy, is_heavy)
        seen.update(zip(keys.tolist(), rows.tolist(), strict=True))
        for i, done in enumerate(ready):
            if done:
                continue
            near = int(np.searchsorted(size, want[i]))
            for j in (near - 1, near):
                if 0 <= j < len(keys):
                    best[i] = min(best[i], (abs(int(size[j]) - want[i]), int(keys[j]), int(size[j]), int(rows[j])))
            new = (max(lo[i], int(keys[near - 1]) // unit) if near else lo[i], min(hi[i], int(keys[near]) // unit) if near < len(keys) else hi[i])
            ready[i] = best[i][0] <= tolerance or new[1] - new[0] <= 1
            lo[i], hi[i] = new
        turn = probes
    return [x[1:] for x in best], seen


@dataclass
class Layout:
    """Which part, shard and first slot each key has: heavy keys by the piece that they lie in, others by the range."""

    heavy: np.ndarray
    pieces: np.ndarray
    ranges: np.ndarray
    shard: np.ndarray
    first: np.ndarray

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = len(self.pieces) + np.searchsorted(self.ranges, keys, side="right")
        if len(self.pieces):
            part = np.where(heavy_mask(keys, self.heavy), np.searchsorted(self.pieces, keys, side="right") - 1, part)
        return part.astype(np.int32), self.shard[part], self.first[part]


def level(loads: list[int], rest: int) -> float:
    """Up to what size rest fills the least loaded shards evenly."""
    full, left = sorted(loads), rest
    for k in range(1, len(full)):
        if left < (gap := (full[k] - full[k - 1]) * k):
            return full[k - 1] + left / k
        left -= gap
    return full[-1] + left / len(full)


def lay_out(keyed: DataFrame, shards: int, total: int, count: int, tolerance: float, tasks: int) -> Layout:
    """Heavy groups go, largest first, to the shard with least so far; what is more than a shard's share fills whole shards first. All others are ranged by splitters between groups, so that shards become even."""
    share = max(1, total // shards)
    k, s = keyed.columns
    groups = keyed.groupBy(F.shiftright(k, GROUP).alias("g")).agg(F.sum(s).alias("size"), F.count(F.lit(1)).alias("rows")).filter(F.col("size") > HEAVY * share).collect()
    groups = sorted((r["g"], r["size"], r["rows"]) for r in groups)
    heavy = np.array([g for g, _, _ in groups], np.int64)
    queue = [(0, i) for i in range(shards)]  # (load, shard)
    pieces: list[list] = []  # [group, offset inside it, size, shard]
    for size, g in sorted(((-z, g) for g, z, _ in groups)):
        at, left = 0, -size
        while left > 0:
            load, shard = heapq.heappop(queue)
            own = share if left > share and not load else left
            pieces.append([g, at, own, shard])
            heapq.heappush(queue, (load + own, shard))
            at, left = at + own, left - own
    pieces.sort()
    bytes_before = dict(zip(heavy.tolist(), np.cumsum([0] + [z for _, z, _ in groups]).tolist(), strict=False))
    rows_before = dict(zip(heavy.tolist(), np.cumsum([0] + [n for _, _, n in groups]).tolist(), strict=False))
    # pieces are cut into so many ranges that each has about as many rows as those of other rows; cuts inside a group are searched for
    per_range = max(1, min(total // tasks if tasks else total, total * (1 << 20) // max(count, 1)))
    lines = [(g, at + own * j // n, shard) for g, at, own, shard in pieces for n in [-(-own // per_range)] for j in range(n)]
    inner = [bytes_before[g] + at for g, at, _ in lines if at]
    cuts, _ = splitters(keyed, inner, int(tolerance * share / 2), 1, heavy, True) if inner else ([], {})
    found, last, edges = iter(cuts), (0, 0, 0), []
    for g, at, shard in lines:
        last = max(last, next(found) if at else (g << GROUP, bytes_before[g], rows_before[g]))
        edges.append((*last, shard))
    heavy_bytes = sum(z for _, z, _ in groups)
    ends = [e[1:3] for e in edges[1:]] + [(heavy_bytes, sum(n for _, _, n in groups))] * bool(edges)
    loads, used, part_shard, part_first = [0] * shards, [0] * shards, [], []
    for (_, low, rows, shard), (high, end) in zip(edges, ends, strict=True):
        part_shard.append(shard)
        part_first.append(used[shard])
        loads[shard] += high - low
        used[shard] += end - rows
    # the other rows, up to an even level
    top = level(loads, total - heavy_bytes)
    want = np.cumsum([max(0.0, top - x) for x in loads])[:-1].astype(np.int64).tolist()
    first = 4 * max(tasks, 12)
    bounds, seen = splitters(keyed, want, int(tolerance * share / 2), 1 << GROUP, heavy, False, first) if want else ([], {})
    bounds = np.maximum.accumulate(np.array(bounds, np.int64).reshape(-1, 3), axis=0).tolist()  # bytes and rows rise with keys
    even = sorted(seen.items())[:: max(1, len(seen) // max(1, 2 * tasks))] if tasks > shards else []
    cuts = sorted([(key, 0, rows) for key, _, rows in bounds] + [(key, 1, rows) for key, rows in even])
    shard, start, before = 0, 0, 0
    part_shard.append(0)
    part_first.append(used[0])
    for key, inside, before in cuts:
        if not inside:
            shard, start = shard + 1, before
        part_shard.append(shard)
        part_first.append(used[shard] + before - start)
    return Layout(heavy, np.array([e[0] for e in edges], np.int64), np.array([c[0] for c in cuts], np.int64), np.array(part_shard, np.int32), np.array(part_first, np.int64))


def shard_by_bytes(df: DataFrame, shards: int, key: Column, size: Column, tie: list[Column], tolerance: float = 0.002) -> DataFrame:
    """df with shard int (0 to shards - 1) and slot long (gapless from 0 in each shard); sizes of shards are near equal.

    key: long from 0 to 2**63 - 1 whose upper 32 bits tell a row's group; size: long bytes of a row; tie:
    what orders rows of equal keys. A group stays in one shard unless it is larger than the mean shard;
    then it fills whole shards, and a rest goes on to one more. Each shard's bytes are within tolerance of the
    mean shard, plus HEAVY of it, unless groups too large to be evened out lie in one; rows of one key
    are never parted. Null keys and sizes count as 0. Repeated rows get slots of their own. An empty
    table gives no rows. Columns of df that are called shard or slot are replaced; all others stay.

    Only (key, size) is kept for the counting rounds; the rows themselves move in one exchange, in which
    each shard is dealt out in several ranges whose exact row counts give the slots.
    """
    spark = df.sparkSession
    df = without(df, "shard", "slot")
    k, s, part, n, at_shard = fresh(df, "_key", "_size", "_part", "_n", "_shard")
    keyed = cut(df.select(F.coalesce(key, F.lit(0)).cast("long").alias(k), F.coalesce(size, F.lit(0)).cast("long").alias(s)))
    total, count = keyed.agg(F.coalesce(F.sum(s), F.lit(0)), F.count(F.lit(1))).first()
    laid = spark.sparkContext.broadcast(lay_out(keyed, shards, total, count, tolerance, max(partitions(spark), -(-count >> 20))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, own, first = laid.value.place(b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False))
            yield b.append_column(part, pa.array(parts)).append_column(at_shard, pa.array(own)).append_column(n, pa.array(first))

    whole = df.withColumn(k, F.coalesce(key, F.lit(0)).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema) + f", `{part}` int, `{at_shard}` int, `{n}` long"
    placed = whole.mapInArrow(thrifty(place), kinds)
    w = Window.partitionBy(part).orderBy(k, *tie)
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col(at_shard).alias("shard"),
        (F.col(n) + F.row_number().over(w) - 1).cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null: the law is not by key).

    Rows are keyed by (crc32 of the text, hash of doc_id), so a group of equal texts lies in one shard,
    unless it is larger than the mean shard: then in as few as can be. Null text has no bytes and the
    crc32 of none, 0; null doc_id is hashed as such. Ties are ordered by doc_id, then by size and text.
    Columns of the new names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = without(docs, "size", "text_crc32", "law", "grown_shard")
    rows = docs.withColumns({"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(text), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    key = F.shiftleft(F.col("text_crc32"), 31) + F.xxhash64("doc_id").bitwiseAND((1 << 31) - 1)
    return shard_by_bytes(rows, shards, key, F.col("size"), [F.col("doc_id"), F.col("size"), F.xxhash64("text")], tolerance)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without their texts, in 24 shards by the law bytes, in the manner of shard_documents."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.shiftleft(F.col("text_crc32"), 31) + F.xxhash64("doc_id").bitwiseAND((1 << 31) - 1)
    out = shard_by_bytes(light, 24, key, F.col("size"), [F.col("doc_id"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
