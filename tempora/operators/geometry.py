"""Points and paths: polygons, polylines, graphs and transforms. Shapes are small driver-side lists of nodes; points are DataFrames (x, y)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Nodes = list[tuple[float, float]]


def closed(nodes: Nodes) -> Nodes:
    return nodes if len(nodes) and nodes[0] == nodes[-1] else [*nodes, nodes[0]]


def edges(nodes: Nodes) -> list[tuple[int, float, float, float, float, float, float]]:
    """(edge, x0, y0, dx, dy, length, length before)."""
    out, total = [], 0.0
    for k, ((x0, y0), (x1, y1)) in enumerate(zip(nodes, nodes[1:], strict=False)):
        n = math.hypot(x1 - x0, y1 - y0)
        out.append((k, x0, y0, x1 - x0, y1 - y0, n, total))
        total += n
    return out


def length(nodes: Nodes) -> float:
    return sum(e[5] for e in edges(nodes))


def polygon_area(rows: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """(keys, area): signed shoelace area of each group's nodes (x, y) in order; two nodes or fewer have none."""
    nodes = F.array_sort(F.collect_list(F.struct(order, "x", "y")))
    n = rows.groupBy(*keys).agg(nodes.alias("_n"))  # a polygon's nodes
    pairs = F.zip_with("_n", F.concat(F.slice("_n", 2, F.size("_n")), F.slice("_n", 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return n.select(*keys, F.when(F.size("_n") > 2, F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b) / 2).otherwise(0.0).alias("area"))


def winding(nodes: Nodes, x: Column, y: Column) -> Column:
    """Winding number of a closed polygon about a point; 0 is outside."""
    def turn(e: tuple) -> Column:
        _, x0, y0, dx, dy, _, _ = e
        side = dx * (y - y0) - (x - x0) * dy
        return F.when((y0 <= y) & (F.lit(y0 + dy) > y) & (side > 0), 1).when((F.lit(y0) > y) & (F.lit(y0 + dy) <= y) & (side < 0), -1).otherwise(0)

    return reduce(lambda a, b: a + b, map(turn, edges(closed(nodes))))


def in_polygon(nodes: Nodes, x: Column, y: Column) -> Column:
    return winding(nodes, x, y) != 0


def in_ellipse(x: Column, y: Column, center: tuple[float, float], size: tuple[float, float], angle: float = 0.0) -> Column:
    c, s = math.cos(angle), math.sin(angle)
    u, v = (x - center[0]) * c + (y - center[1]) * s, (y - center[1]) * c - (x - center[0]) * s
    return (u / size[0]) * (u / size[0]) + (v / size[1]) * (v / size[1]) <= 1


def ellipse_area(a: float, b: float) -> float:
    return math.pi * a * b


def ellipse_length(a: float, b: float) -> float:
    """Perimeter by the arithmetic-geometric mean."""
    a, b = max(a, b), min(a, b)
    if b == 0:
        return 4 * a
    x, y, total, k = a, b, a * a - (a * a - b * b) / 2, 1.0
    while x - y > 1e-15 * x:
        x, y, d = (x + y) / 2, math.sqrt(x * y), (x - y) / 2
        total -= k * d * d
        k *= 2
    return 2 * math.pi * total / x


def ellipse_table(a: float, b: float, n: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(angle parameters, arc lengths from 0) around an ellipse, by the midpoint rule."""
    t = np.linspace(0, 2 * math.pi, n + 1)
    mid = (t[1:] + t[:-1]) / 2
    s = np.append(0, np.cumsum(np.hypot(a * np.sin(mid), b * np.cos(mid)) * (t[1] - t[0])))
    return t, s * ellipse_length(a, b) / s[-1]


def to_ellipse(points: DataFrame, center: tuple[float, float], size: tuple[float, float], angle: float = 0.0) -> DataFrame:
    """points with along and d: distance along an ellipse to its nearest point, and from it (negative inside). Exact for a circle, whose plan has no Python; else Newton steps in batches."""
    c, s = math.cos(angle), math.sin(angle)
    a, b = size
    if a == b:
        u, v = (F.col("x") - center[0]) * c + (F.col("y") - center[1]) * s, (F.col("y") - center[1]) * c - (F.col("x") - center[0]) * s
        return points.withColumns({"along": F.pmod(F.atan2(v, u), F.lit(2 * math.pi)) * a, "d": F.hypot(u, v) - a})

    def run(frames):
        t0, s0 = ellipse_table(a, b)
        grid = t0[:-1:64]
        for f in frames:
            x, y = f["x"].to_numpy(float) - center[0], f["y"].to_numpy(float) - center[1]
            u, v = x * c + y * s, y * c - x * s
            t = grid[np.argmin(np.square(a * np.cos(grid) - u[:, None]) + np.square(b * np.sin(grid) - v[:, None]), axis=1)]
            for _ in range(20):
                cos, sin = np.cos(t), np.sin(t)
                g = (b * b - a * a) * sin * cos + a * u * sin - b * v * cos
                h = (b * b - a * a) * (cos * cos - sin * sin) + a * u * cos + b * v * sin
                t = t - np.where(np.abs(h) > 1e-12, g / np.where(np.abs(h) > 1e-12, h, 1), 0)
            far = np.hypot(a * np.cos(t) - u, b * np.sin(t) - v)
            inside = np.square(u / a) + np.square(v / b) < 1
            yield f.assign(along=np.interp(np.mod(t, 2 * math.pi), t0, s0), d=np.where(inside, -far, far))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInPandas(run, f"{kinds}, along double, d double")


def from_ellipse(rows: DataFrame, center: tuple[float, float], size: tuple[float, float], angle: float = 0.0, along: str = "along") -> DataFrame:
    """rows with x and y at a distance along an ellipse, by its table of arc lengths."""
    c, s = math.cos(angle), math.sin(angle)

    def run(frames):
        t0, s0 = ellipse_table(*size)
        for f in frames:
            t = np.interp(np.mod(f[along].to_numpy(float), s0[-1]), s0, t0)
            u, v = size[0] * np.cos(t), size[1] * np.sin(t)
            yield f.assign(x=center[0] + u * c - v * s, y=center[1] + u * s + v * c)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, x double, y double")


def rectangle(center: tuple[float, float], width: float, height: float, angle: float = 0.0) -> Nodes:
    c, s = math.cos(angle), math.sin(angle)
    corners = [(-width / 2, -height / 2), (width / 2, -height / 2), (width / 2, height / 2), (-width / 2, height / 2)]
    return [(center[0] + x * c - y * s, center[1] + x * s + y * c) for x, y in corners]


def ngon(n: int, radius: float = 1.0, center: tuple[float, float] = (0.0, 0.0)) -> Nodes:
    return [(center[0] + radius * math.cos(2 * math.pi * k / n), center[1] + radius * math.sin(2 * math.pi * k / n)) for k in range(n)]


def to_line(x: Column, y: Column, e: tuple, clip: tuple[str, str] = ("full", "full")) -> Column:
    """struct(d signed distance, px, py nearest point, s distance along) of a point and an edge.

    clip at either end: full stops at the end, normal goes on along the line, blunt goes on but measures
    to the end.
    """
    _, x0, y0, dx, dy, n, _ = e
    s = ((x - x0) * dx + (y - y0) * dy) / n
    lo = F.greatest(s, F.lit(0.0)) if clip[0] == "full" else s
    at = F.least(lo, F.lit(n)) if clip[1] == "full" else lo
    px, py = x0 + at * dx / n, y0 + at * dy / n
    side = F.when(dx * (y - y0) - (x - x0) * dy < 0, -1.0).otherwise(1.0)
    end = at
    if "blunt" in clip:
        end = F.greatest(at, F.lit(0.0)) if clip[0] == "blunt" else end
        end = F.least(end, F.lit(n)) if clip[1] == "blunt" else end
    qx, qy = x0 + end * dx / n, y0 + end * dy / n
    return F.struct((side * F.hypot(x - qx, y - qy)).alias("d"), px.alias("px"), py.alias("py"), at.alias("s"))


def to_polyline(points: DataFrame, nodes: Nodes, shut: bool = False) -> DataFrame:
    """points with path: struct(ad distance, edge, d signed, px, py, s along the edge, along the whole); the first of equally near edges."""
    every = []
    for e in edges(closed(nodes) if shut else nodes):
        line = to_line(F.col("x"), F.col("y"), e)
        every.append(F.struct(F.round(F.abs(line["d"]), 12).alias("ad"), F.lit(e[0]).alias("edge"), line["d"].alias("d"), line["px"].alias("px"), line["py"].alias("py"), line["s"].alias("s"), (line["s"] + e[6]).alias("along")))
    return points.withColumn("path", F.array_min(F.array(*every)))


def from_polyline(rows: DataFrame, nodes: Nodes, shut: bool = False, along: str = "along", off: str | None = None) -> DataFrame:
    """rows with x, y at a distance along the line, and off to its left if a column says so; null beyond the ends."""
    es = edges(closed(nodes) if shut else nodes)
    a, o = F.col(along), F.col(off) if off else F.lit(0.0)
    out = F.lit(None).cast("struct<edge:int,x:double,y:double,tangent:double>")
    for k, x0, y0, dx, dy, n, total in reversed(es):
        s = a - total
        x, y = x0 + s * dx / n - o * dy / n, y0 + s * dy / n + o * dx / n
        out = F.when((s >= 0) & (s <= n), F.struct(F.lit(k).alias("edge"), x.alias("x"), y.alias("y"), F.lit(math.atan2(dy, dx)).alias("tangent"))).otherwise(out)
    return rows.withColumn("point", out)


def path_to_edge(nodes: Nodes, along: Column) -> Column:
    """struct(edge, s) of a distance along a polyline."""
    out = F.lit(None).cast("struct<edge:int,s:double>")
    for k, _, _, _, _, n, total in reversed(edges(nodes)):
        out = F.when((along >= total) & (along <= total + n), F.struct(F.lit(k).alias("edge"), (along - total).alias("s"))).otherwise(out)
    return out


def edge_to_path(nodes: Nodes, edge: Column, s: Column) -> Column:
    before = F.array(*[F.lit(e[6]) for e in edges(nodes)])
    return before[edge] + s


def loop_distance(a: Column, b: Column, around: float) -> Column:
    """Directed distance from a to b on a loop, to half its length either way."""
    return F.pmod(b - a + around / 2, F.lit(around)) - around / 2


def bounding_box(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def floyd_warshall(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances, next nodes) of all pairs; zeros off the diagonal are no edge."""
    d = np.where(weights > 0, weights.astype(float), np.inf)
    np.fill_diagonal(d, 0)
    nxt = np.where(np.isfinite(d), np.arange(len(d)), -1)
    for k in range(len(d)):
        via = d[:, k, None] + d[None, k]
        better = via < d
        d = np.where(better, via, d)
        nxt = np.where(better, nxt[:, k, None], nxt)
    return d, nxt


def shortest_path(weights: np.ndarray, a: int, b: int) -> tuple[float, list[int]]:
    d, nxt = floyd_warshall(weights)
    path = [a] if np.isfinite(d[a, b]) else []
    while path and path[-1] != b:
        path.append(int(nxt[path[-1], b]))
    return float(d[a, b]), path


def graph_distance(pairs: DataFrame, ends: list[tuple[int, int]], lengths: list[float]) -> DataFrame:
    """pairs (edge_a, s_a, edge_b, s_b) with distance: the shortest of the ways over either end of both edges, and along the edge if it is the same one."""
    n = max(max(e) for e in ends) + 1
    w = np.zeros((n, n))
    for (i, j), x in zip(ends, lengths, strict=True):
        w[i, j] = w[j, i] = min(x, w[i, j] or np.inf)
    d, _ = floyd_warshall(w)
    node = pairs.sparkSession.createDataFrame([(a, b, float(lengths[a]), float(lengths[b]), *[float(d[ends[a][i], ends[b][j]]) for i in (0, 1) for j in (0, 1)]) for a in range(len(ends)) for b in range(len(ends))], "edge_a int, edge_b int, _la double, _lb double, _00 double, _01 double, _10 double, _11 double")
    a0, a1, b0, b1 = F.col("s_a"), F.col("_la") - F.col("s_a"), F.col("s_b"), F.col("_lb") - F.col("s_b")
    ways = F.least(a0 + F.col("_00") + b0, a0 + F.col("_01") + b1, a1 + F.col("_10") + b0, a1 + F.col("_11") + b1)
    same = F.when(F.col("edge_a") == F.col("edge_b"), F.abs(F.col("s_b") - F.col("s_a")))
    return pairs.join(F.broadcast(node), ["edge_a", "edge_b"]).withColumn("distance", F.least(ways, same)).drop("_la", "_lb", "_00", "_01", "_10", "_11")


class TransformStack:
    """Scalings, rotations and translations as one matrix, applied as one projection."""

    def __init__(self, matrix: np.ndarray | None = None) -> None:
        self.matrix = np.eye(3) if matrix is None else matrix

    def scale(self, sx: float, sy: float, origin: tuple[float, float] = (0.0, 0.0)) -> TransformStack:
        return self._about(np.diag([sx, sy, 1.0]), origin)

    def rotate(self, angle: float, origin: tuple[float, float] = (0.0, 0.0)) -> TransformStack:
        c, s = math.cos(angle), math.sin(angle)
        return self._about(np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]]), origin)

    def translate(self, dx: float, dy: float) -> TransformStack:
        return TransformStack(np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]]) @ self.matrix)

    def _about(self, m: np.ndarray, origin: tuple[float, float]) -> TransformStack:
        to = np.array([[1, 0, origin[0]], [0, 1, origin[1]], [0, 0, 1.0]])
        return TransformStack(to @ m @ np.linalg.inv(to) @ self.matrix)

    def inverse(self) -> TransformStack:
        return TransformStack(np.linalg.inv(self.matrix))

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        m = self.matrix.tolist()
        return m[0][0] * x + m[0][1] * y + m[0][2], m[1][0] * x + m[1][1] * y + m[1][2]


def bresenham(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Pixels of a line."""
    dx, dy, sx, sy = abs(x1 - x0), -abs(y1 - y0), 1 if x0 < x1 else -1, 1 if y0 < y1 else -1
    out, err = [(x0, y0)], dx + dy
    while (x0, y0) != (x1, y1):
        e = 2 * err
        if e >= dy:
            err += dy
            x0 += sx
        if e <= dx:
            err += dx
            y0 += sy
        out.append((x0, y0))
    return out
