"""Embedding whitening: tiled covariance. Column blocks of rows are shuffled by row-block, pairs of blocks multiplied and summed by tile, and the assembled matrix is decomposed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, partitions, table, thrifty, without

#: An entry c counts as floor(UNIT * c) + SHIFT; larger ones than MOST either way count as that.
UNIT, SHIFT, MOST = 64, 1_000_000, 1 << 40
#: Dimensions of a column block, rows of a row-block, components that are returned.
TILE, BLOCK_ROWS, COMPONENTS = 32, 2048, 16
#: Numbers of the matrix that a task sums; a larger matrix is cut into strips of tiles, each with its own tasks.
STRIP = 1 << 23
#: Dimensions up to which the driver holds and decomposes the matrix (2 GB).
MOST_DIMS = 16_384
#: Components with less of the largest eigenvalue than this have no variance but rounding's.
RANK = 1e-12
MOST_LONG = (1 << 63) - 1


def rounded(vectors: DataFrame) -> DataFrame:
    """vectors with x: array<long> of floor(UNIT * c) + SHIFT, less rows whose embedding is null or holds null or non-finite entries."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    entry = lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * UNIT))) + F.lit(SHIFT)
    return vectors.filter(F.col("embedding").isNotNull() & finite).withColumn("x", F.transform(v, entry))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Sums:
    """n vectors of the fit list and their exact sums by dimension."""

    n: int
    total: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - total, exact: as 64-bit integers where these suffice, else as Python's."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.total), default=0))
        kind = np.int64 if 2 * most < MOST_LONG else object
        return x.astype(kind) * self.n - np.array(self.total, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n


def sums(fit: DataFrame, dims: int) -> Sums:
    """Of fit (x); a task sends one row a dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in batches:
            x = matrix(b.column(0), dims)
            n += len(x)
            high, low = x >> 20, x & 0xFFFFF  # a batch's sums of either part fit 64 bits
            total = [t + (int(h) << 20) + int(w) for t, h, w in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * dims, pa.int64())], names=["i", "s", "n"])

    got = fit.select("x").mapInArrow(thrifty(part), "i int, s string, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # dims rows
    total = {r["i"]: int(r["s"]) for r in got}
    return Sums(got[0]["n"] if got else 0, [total.get(i, 0) for i in range(dims)])


def covariance(rows: DataFrame, dims: int, n: int, tile: int = TILE, block_rows: int = BLOCK_ROWS, strip: int = STRIP) -> np.ndarray:
    """Mean products, by the divisor n, of the dimensions of rows (z: array<double> of centred entries).

    Pairs of dimensions are the tiles (a, b), a <= b, of pairs of column blocks of tile dimensions. Each
    row-block of block_rows rows is cut into column blocks, which go to the task that their row-block and
    strip (some rows a of tiles) are dealt to; with up to 2,896 dimensions there is one strip. There pairs
    of blocks are multiplied and added to the task's sums of tiles; a row a task and tile is sent on, and
    tiles are summed by key. A task holds one row-block and the sums of one strip.
    """
    count = -(-dims // tile)
    high = max(1, strip // (tile * dims))
    strips = range(0, count, high)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for lo in range(0, b.num_rows, block_rows):
                z = matrix(b.column(0).slice(lo, block_rows), dims)
                parts = [np.ascontiguousarray(z[:, c * tile : (c + 1) * tile]).tobytes() for c in range(count)]
                for a in strips:
                    m = count - a
                    yield pa.RecordBatch.from_arrays([pa.array([first + k] * m, pa.int64()), pa.array([a] * m, pa.int32()), pa.array(range(a, count), pa.int32()), pa.array([len(z)] * m, pa.int32()), pa.array(parts[a:], pa.binary())], names=["row_block", "strip", "c", "rows", "z"])
                k += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        now, columns = None, {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (a, b), m in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["a", "b", "tile"])
            held.clear()

        def add() -> None:
            for a in range(now[0], min(now[0] + high, count)) if now else ():
                for b in range(a, count):
                    product = columns[a].T @ columns[b]
                    held[a, b] = held[a, b] + product if (a, b) in held else product

        for batch in batches:
            for block, a, c, rows_, z in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (a, block) != now:
                    add()
                    if now and a != now[0]:
                        yield from sent()
                    now, columns = (a, block), {}
                columns[c] = np.frombuffer(z).reshape(rows_, -1)
        add()
        yield from sent()

    def add_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["a", "b", "tile"])
        for batch in batches:
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                m = batch.column(2)[i].values.to_numpy()
                if key != now:
                    if now:
                        yield done()
                    now, total = key, m.copy()
                else:
                    total += m
        if now:
            yield done()

    n_parts, schema = partitions(rows.sparkSession), "a int, b int, tile array<double>"
    dealt = rows.select("z").mapInArrow(thrifty(blocks), "row_block long, strip int, c int, rows int, z binary").repartition(n_parts, "strip", "row_block").sortWithinPartitions("strip", "row_block")
    tiles = dealt.mapInArrow(thrifty(multiply), schema).repartition(n_parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(thrifty(add_tiles), schema)
    out = np.zeros((dims, dims))
    for r in tiles.toLocalIterator():  # dims squared numbers
        la, lb = r["a"] * tile, r["b"] * tile
        m = np.array(r["tile"]).reshape(min(tile, dims - la), -1)
        out[la : la + m.shape[0], lb : lb + m.shape[1]] = m
        out[lb : lb + m.shape[1], la : la + m.shape[0]] = m.T
    return out / n


def mapped(fit: DataFrame, dims: int, function) -> DataFrame:
    """(z): function of the matrix of each batch of fit's x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(function(matrix(b.column(0), dims))), pa.list_(pa.float64()))], names=["z"])

    return fit.select("x").mapInArrow(thrifty(run), "z array<double>")


@dataclass
class Whitening:
    """Centres, projects on the leading components and scales to variance 1: n and sums of the fit list, components as columns (already over the square roots of their variances) and their shares of all variance."""

    sums: Sums
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.sums.centred(x) @ self.axes


def fit_whitening(rows: DataFrame, dims: int, components: int = COMPONENTS, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> Whitening:
    """The whitening of the distinct x of rows. Components are numbered by falling variance; those without any are left out."""
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions: the driver decomposes {MOST_DIMS} at most")
    fit = cut(rows.select("x").distinct())
    s = sums(fit, dims)
    v = covariance(mapped(fit, dims, s.centred), dims, s.n, tile, block_rows)
    e, axes = np.linalg.eigh(v)
    best = np.argsort(-e, kind="stable")[:components]
    best = best[e[best] > RANK * max(e.max(initial=0), 0)]
    out = Whitening(s, axes[:, best] / np.sqrt(e[best]), e[best] / np.trace(v) if len(best) else np.zeros(0), 0.0)
    k = len(best)
    if k:
        mean = np.array(mapped(fit, dims, out.apply).agg(F.array(*[F.avg(F.col("z")[i]) for i in range(k)]).alias("m")).first()["m"])
        again = covariance(mapped(fit, dims, lambda x: out.apply(x) - mean), k, s.n, tile, block_rows)
        out.identity_error = float(np.abs(again - np.eye(k)).max())
    discard(fit)
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors less embedding, one row a component (from 1), with component int, n, deviation long, whitened, explained and identity_error double.

    Rows with a null vector, or null or non-finite entries, go; other nulls stay. The fit takes each
    distinct vector of floor(64 c) + 1000000 once, so copies carry no weight. n: distinct vectors;
    deviation: the sum over dimensions of (n x - S) ** 2, null where a long can't hold it; whitened: the
    centred vector projected on the component, over its deviation, for either sign of the component;
    explained: the component's share of all variance; identity_error: how far the fit's whitened
    covariance is from the identity. Equal eigenvalues leave their components' axes open. Components
    without variance have no row: a table of one distinct vector, or of none, gives none. Vectors of
    another length than the commonest (the longer one of a tie) go, too. Entries beyond 2 ** 40 either
    way count as that. Columns of the names above are replaced.
    """
    vectors = without(vectors, "component", "n", "deviation", "whitened", "explained", "identity_error", "x")
    rows = rounded(vectors)
    length = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    names = [c for c in vectors.columns if c != "embedding"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "embedding"] + ["component int, n long, deviation long, whitened double, explained double, identity_error double"])
    if length is None or not length["dims"]:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = length["dims"]
    rows = rows.filter(F.size("x") == dims)
    w = fit_whitening(rows, dims, components, tile, block_rows)
    k = len(w.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(len(names)), dims)
            d = w.sums.deviations(x)
            wide = d.dtype == object or dims * float(np.abs(d).max(initial=0)) ** 2 >= MOST_LONG
            square = (d.astype(object) ** 2).sum(axis=1) if wide else (d**2).sum(axis=1)
            deviation = pa.array([int(v) if v <= MOST_LONG else None for v in square], pa.int64())
            which = pa.array(np.repeat(np.arange(len(x)), k))
            old = [c.take(which) for c in b.columns[: len(names)]]
            per = len(x)
            new = [np.tile(np.arange(1, k + 1, dtype=np.int32), per), np.full(per * k, w.sums.n), deviation.take(which), w.apply(x).ravel(), np.tile(w.explained, per), np.full(per * k, w.identity_error)]
            yield pa.RecordBatch.from_arrays([*old, *(v if isinstance(v, pa.Array) else pa.array(v) for v in new)], names=[*names, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.select(*[F.col(f"`{c}`") for c in names], "x").mapInArrow(thrifty(run), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector with finite entries, for 16 components."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
