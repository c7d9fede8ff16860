"""Graphs of polylines, collections of shapes, ellipse measures and seeded random points. Shapes are driver-side lists of nodes; a place on one is its distance along all of it, or a part and a distance along that."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from . import geometry as G

#: How far before its end a projection onto an edge of a graph stops, so that a place belongs to one edge.
END = 1e-4


class Graph:
    """Polylines between numbered nodes: ends[k] are the nodes of polyline k."""

    def __init__(self, polylines: list[G.Nodes], ends: list[tuple[int, int]]) -> None:
        self.polylines, self.ends = polylines, ends
        self.lengths = [G.length(p) for p in polylines]
        self.before = np.concatenate([[0.0], np.cumsum(self.lengths)]).tolist()
        n = max(max(e) for e in ends) + 1
        w = np.zeros((n, n))
        for (i, j), x in zip(ends, self.lengths, strict=True):
            w[i, j] = w[j, i] = min(x, w[i, j] or np.inf)
        self.apart, _ = G.floyd_warshall(w)

    @property
    def length(self) -> float:
        return self.before[-1]

    def nodes(self) -> list[tuple[float, float]]:
        out: dict[int, tuple[float, float]] = {}
        for (i, j), p in zip(self.ends, self.polylines, strict=True):
            out.setdefault(i, p[0])
            out.setdefault(j, p[-1])
        return [out[k] for k in sorted(out)]

    def bounding_box(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*(n for p in self.polylines for n in p), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def snapped(self, nodes: list[tuple[float, float]], tolerance: float = 1e-3) -> Graph:
        """The graph with polyline ends moved to their nodes; an end farther than tolerance from its node is an error."""
        out = []
        for (i, j), p in zip(self.ends, self.polylines, strict=True):
            if math.dist(p[0], nodes[i]) > tolerance or math.dist(p[-1], nodes[j]) > tolerance:
                raise ValueError(f"a polyline from {i} to {j} doesn't end at its nodes")
            out.append([nodes[i], *p[1:-1], nodes[j]])
        return Graph(out, self.ends)


def part_of(along: Column, lengths: list[float]) -> Column:
    """struct(edge, s): the part that a distance along all parts lies in (the first of two that meet there), and the rest; null beyond the ends."""
    out, total = F.lit(None).cast("struct<edge:int,s:double>"), sum(lengths)
    for k in reversed(range(len(lengths))):
        total -= lengths[k]
        out = F.when((along >= total) & (along <= total + lengths[k]), F.struct(F.lit(k).alias("edge"), (along - total).alias("s"))).otherwise(out)
    return out


def along_of(edge: Column, s: Column, lengths: list[float]) -> Column:
    """Inverse of part_of."""
    return F.array(*[F.lit(float(x)) for x in np.concatenate([[0.0], np.cumsum(lengths)[:-1]])])[edge] + s


def to_graph(points: DataFrame, graph: Graph) -> DataFrame:
    """points with place: struct(ad distance, edge, d signed, px, py, s along the edge, along the whole); the first of equally near edges."""
    every = []
    for k, p in enumerate(graph.polylines):
        for e in G.edges(p):
            line = G.to_line(F.col("x"), F.col("y"), e)
            s = F.least(line["s"] + e[6], F.lit(graph.lengths[k] - END))
            every.append(F.struct(F.round(F.abs(line["d"]), 12).alias("ad"), F.lit(k).alias("edge"), line["d"].alias("d"), line["px"].alias("px"), line["py"].alias("py"), s.alias("s"), (s + graph.before[k]).alias("along")))
    return points.withColumn("place", F.array_min(F.array(*every)))


def from_graph(rows: DataFrame, graph: Graph, along: str = "along") -> DataFrame:
    """rows with point: struct(edge, x, y, tangent) at a distance along the whole graph; null beyond it."""
    out, a = F.lit(None).cast("struct<edge:int,x:double,y:double,tangent:double>"), F.col(along)
    for k in reversed(range(len(graph.polylines))):
        for _, x0, y0, dx, dy, n, before in reversed(G.edges(graph.polylines[k])):
            s = a - (graph.before[k] + before)
            out = F.when((s >= 0) & (s <= n), F.struct(F.lit(k).alias("edge"), (x0 + s * dx / n).alias("x"), (y0 + s * dy / n).alias("y"), F.lit(math.atan2(dy, dx)).alias("tangent"))).otherwise(out)
    return rows.withColumn("point", out)


def signed_distance(graph: Graph, a: Column, b: Column) -> Column:
    """Distance from place a to place b (structs of part_of): the shortest way, negative if it leaves a's edge by its start, or along the edge, with that direction's sign; the first of equally short ways."""
    at = lambda table, *key: F.array(*[F.lit(float(x)) for x in table])[key[0] * len(graph.ends) + key[1] if len(key) > 1 else key[0]]
    way = lambda i, j: at([graph.apart[x[i], y[j]] for x in graph.ends for y in graph.ends], a["edge"], b["edge"])
    rest_a, rest_b = at(graph.lengths, a["edge"]) - a["s"], at(graph.lengths, b["edge"]) - b["s"]
    own = F.when(a["edge"] == b["edge"], b["s"] - a["s"]).otherwise(F.lit(float("inf")))
    ways = [-(way(0, 0) + a["s"] + b["s"]), -(way(0, 1) + a["s"] + rest_b), way(1, 0) + rest_a + b["s"], way(1, 1) + rest_a + rest_b, own]
    return F.array_min(F.array(*[F.struct(F.round(F.abs(w), 9).alias("k"), F.lit(i).alias("i"), w.alias("d")) for i, w in enumerate(ways)]))["d"]


def graph_gradient(rows: DataFrame, graph: Graph, keys: list[str], order: str, dx: float = 1.0, along: str = "along") -> DataFrame:
    """rows with gradient: central differences of places along the graph, in order; one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = rows.withColumn("_p", part_of(F.col(along), graph.lengths))
    p = p.withColumns({"_b": F.lag("_p").over(w), "_a": F.lead("_p").over(w)})
    ahead, back = signed_distance(graph, F.col("_p"), F.col("_a")), signed_distance(graph, F.col("_p"), F.col("_b"))
    before = signed_distance(graph, F.col("_b"), F.col("_p"))
    g = F.when(F.col("_b").isNull(), ahead / dx).when(F.col("_a").isNull(), before / dx).otherwise((ahead - back) / (2 * dx))
    return p.withColumn("gradient", g).drop("_p", "_b", "_a")


def to_shape(points: DataFrame, shapes: list[G.Nodes], context: int) -> DataFrame:
    """points with path, as to_polyline gives for the shape of that number, and along from the first shape's start."""
    before = sum(G.length(s) for s in shapes[:context])
    return G.to_polyline(points, shapes[context]).withColumn("along", F.col("path.along") + before)


def from_shapes(rows: DataFrame, shapes: list[G.Nodes], along: str = "along") -> DataFrame:
    """rows with shape (its number) and point, as from_polyline gives it, at a distance along all shapes."""
    lengths = [G.length(s) for s in shapes]
    graph = Graph(shapes, [(2 * k, 2 * k + 1) for k in range(len(shapes))])
    return from_graph(rows, graph, along).withColumn("shape", part_of(F.col(along), lengths)["edge"])


def samples_of(nodes: G.Nodes, step: float) -> list[tuple[float, float]]:
    """Points at even distances of about step along a polyline, both ends included."""
    total = G.length(nodes)
    n = max(1, round(total / step))
    es, out = G.edges(nodes), []
    for k in range(n + 1):
        a = total * k / n
        _, x0, y0, dx, dy, length, before = next((e for e in es if a <= e[6] + e[5]), es[-1])
        out.append((x0 + (a - before) * dx / length, y0 + (a - before) * dy / length))
    return out


def normal(tangent: Column, left: bool = True) -> Column:
    return tangent + (math.pi / 2 if left else -math.pi / 2)


def scaled(nodes: G.Nodes, factor: float) -> G.Nodes:
    """Nodes moved from or to their middle."""
    cx, cy = (sum(n[i] for n in nodes) / len(nodes) for i in (0, 1))
    return [(cx + factor * (x - cx), cy + factor * (y - cy)) for x, y in nodes]


def box_corners(box: tuple[float, float, float, float]) -> G.Nodes:
    x0, y0, x1, y1 = box
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def ellipse_box(center: tuple[float, float], size: tuple[float, float], angle: float = 0.0) -> tuple[float, float, float, float]:
    c, s = math.cos(angle), math.sin(angle)
    w, h = math.hypot(size[0] * c, size[1] * s), math.hypot(size[0] * s, size[1] * c)
    return center[0] - w, center[1] - h, center[0] + w, center[1] + h


def eccentricity(a: Column | float, b: Column | float) -> Column:
    """Of half axes a and b in any order."""
    r = F.least(F.lit(a) if not isinstance(a, Column) else a, F.lit(b) if not isinstance(b, Column) else b) / F.greatest(F.lit(a) if not isinstance(a, Column) else a, F.lit(b) if not isinstance(b, Column) else b)
    return F.sqrt(1 - r * r)


def ellipse_tangent(rows: DataFrame, size: tuple[float, float], angle: float = 0.0, along: str = "along") -> DataFrame:
    """rows with tangent, the direction at a distance along an ellipse, from -pi to pi. A circle's needs no Python."""
    a, b = size
    if a == b:
        turn = F.col(along) / a + math.pi / 2 + angle
        return rows.withColumn("tangent", F.pmod(turn + math.pi, F.lit(2 * math.pi)) - math.pi)

    def run(frames):
        t0, s0 = G.ellipse_table(a, b)
        for f in frames:
            t = np.interp(np.mod(f[along].to_numpy(float), s0[-1]), s0, t0)
            yield f.assign(tangent=np.mod(np.arctan2(b * np.cos(t), -a * np.sin(t)) + angle + math.pi, 2 * math.pi) - math.pi)

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", tangent double")


def random_along(ids: DataFrame, length: float, seed: int = 0, id: str = "id") -> DataFrame:
    """ids with along, uniform on a path of that length."""
    return ids.withColumn("along", uniform(seed, id) * length)


def random_on(ids: DataFrame, nodes: G.Nodes, shut: bool = False, seed: int = 0) -> DataFrame:
    """ids with along and point, uniform on a polyline, or around a polygon or rectangle."""
    return G.from_polyline(random_along(ids, G.length(G.closed(nodes) if shut else nodes), seed), nodes, shut)


def random_in_rectangle(ids: DataFrame, center: tuple[float, float], width: float, height: float, angle: float = 0.0, seed: int = 0, id: str = "id") -> DataFrame:
    u, v = (uniform(seed + k, id) - 0.5 for k in (0, 1))
    c, s = math.cos(angle), math.sin(angle)
    return ids.withColumns({"x": center[0] + u * width * c - v * height * s, "y": center[1] + u * width * s + v * height * c})


def random_in_ellipse(ids: DataFrame, center: tuple[float, float], size: tuple[float, float], angle: float = 0.0, seed: int = 0, id: str = "id") -> DataFrame:
    r, t = F.sqrt(uniform(seed, id)), 2 * math.pi * uniform(seed + 1, id)
    u, v, c, s = size[0] * r * F.cos(t), size[1] * r * F.sin(t), math.cos(angle), math.sin(angle)
    return ids.withColumns({"x": center[0] + u * c - v * s, "y": center[1] + u * s + v * c})


def random_in_polygon(ids: DataFrame, nodes: G.Nodes, seed: int = 0, id: str = "id") -> DataFrame:
    """Uniform points of a simple polygon: a triangle of its fan by area, then a point of it. Triangles come by ear clipping on the driver, so none is rejected."""
    tri = triangles(nodes)
    area = np.cumsum([abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) for a, b, c in tri])
    u, v = uniform(seed + 1, id), uniform(seed + 2, id)
    fold = u + v > 1
    u, v = F.when(fold, 1 - u).otherwise(u), F.when(fold, 1 - v).otherwise(v)
    which, x, y = uniform(seed, id) * float(area[-1]), F.lit(None).cast("double"), F.lit(None).cast("double")
    for (a, b, c), top in reversed(list(zip(tri, area.tolist(), strict=True))):
        x = F.when(which <= top, a[0] + u * (b[0] - a[0]) + v * (c[0] - a[0])).otherwise(x)
        y = F.when(which <= top, a[1] + u * (b[1] - a[1]) + v * (c[1] - a[1])).otherwise(y)
    return ids.withColumns({"x": x, "y": y})


def triangles(nodes: G.Nodes) -> list[tuple]:
    """A simple polygon's triangles by ear clipping."""
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])
    left = list(nodes[:-1] if nodes[0] == nodes[-1] else nodes)
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(left, left[1:] + left[:1], strict=True)) < 0:
        left.reverse()
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if cross(a, b, c) > 0 and not any(cross(a, b, p) >= 0 and cross(b, c, p) >= 0 and cross(c, a, p) >= 0 for p in left if p not in (a, b, c)):
                break
        else:
            k = next(i for i in range(len(left)) if cross(left[i - 1], left[i], left[(i + 1) % len(left)]) >= 0)
        out.append((left[k - 1], left[k], left[(k + 1) % len(left)]))
        del left[k]
    return [*out, tuple(left)]
