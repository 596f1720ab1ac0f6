"""Spatial partitioning: cells from a bounded sample, or from arithmetic alone.

``partition`` adds ``cell_id`` and deals the rows out by it.  Trees are built on
the driver from at most ``SAMPLE`` boxes and turned into a nested expression of
comparisons, so that placing a row needs no Python.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import native as N
from geoloom.operators.geometry import box

#: Rows of the sample at most.
SAMPLE = 10_000

Rect = tuple[float, float, float, float]


def sample_size(count: int, partitions: int, wanted: int | None = None) -> int:
    """All rows below 1000; else a hundredth, or twice the partitions if that is more."""
    if wanted is not None:
        return min(wanted, count)
    if count < 1000:
        return count
    if partitions > (count + 1) // 2:
        raise ValueError("more partitions than half the rows")
    return max(2 * partitions, count // 100)


@dataclass
class Cells:
    """Disjoint half-open rectangles that cover the plane between them; ids are their places."""

    rects: list[Rect]

    def _all(self) -> Column:
        """The cells as one constant, so that the plan's size does not depend on their number."""
        text = json.dumps([{"k": k, "x0": r[0], "y0": r[1], "x1": r[2], "y1": r[3]} for k, r in enumerate(self.rects)])
        return F.from_json(F.lit(text), "array<struct<k:int,x0:double,y0:double,x1:double,y1:double>>")

    def id_of(self, x: Column, y: Column) -> Column:
        return F.get(F.filter(self._all(), lambda c: (x >= c["x0"]) & (x < c["x1"]) & (y >= c["y0"]) & (y < c["y1"])), F.lit(0))["k"]

    def ids_of(self, b: Column) -> Column:
        """All cells that a box meets."""
        met = F.filter(self._all(), lambda c: (b["xmin"] < c["x1"]) & (b["xmax"] >= c["x0"]) & (b["ymin"] < c["y1"]) & (b["ymax"] >= c["y0"]))
        return F.transform(met, lambda c: c["k"])

    def owner_of(self, a: Column, b: Column) -> Column:
        """The one cell that speaks for two boxes that meet: that of their common part's lower left corner."""
        return self.id_of(F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]))


INF = float("inf")


def kdb_tree(points: list[tuple[float, float]], partitions: int) -> Cells:
    """Halves at the median of the longer side until there are enough cells."""
    cells: list[tuple[Rect, list]] = [((-INF, -INF, INF, INF), points)]
    while len(cells) < partitions:
        cells.sort(key=lambda c: len(c[1]))
        rect, own = cells.pop()
        done = False
        xs, ys = sorted(p[0] for p in own), sorted(p[1] for p in own)
        if own:
            spread = [xs[-1] - xs[0], ys[-1] - ys[0]]
            for axis in sorted((0, 1), key=lambda a: -spread[a]):
                cut = (xs, ys)[axis][len(own) // 2]
                low = [p for p in own if p[axis] < cut]
                if low:
                    a, b = list(rect), list(rect)
                    a[2 + axis] = b[axis] = cut
                    cells += [(tuple(a), low), (tuple(b), [p for p in own if p[axis] >= cut])]
                    done = True
                    break
        if not done:  # all points equal: it cannot be halved
            cells.append((rect, own))
            break
    return Cells(sorted(c[0] for c in cells))


def quad_tree(points: list[tuple[float, float]], partitions: int, bounds: Rect, levels: int = 12) -> Cells:
    """Quarters of the bounds where a cell holds more than its share; outer cells reach to infinity."""
    most = max(1, len(points) // max(1, partitions))
    out: list[Rect] = []

    def split(r: Rect, own: list, level: int) -> None:
        if len(own) <= most or level == levels:
            out.append(r)
            return
        mx, my = (r[0] + r[2]) / 2, (r[1] + r[3]) / 2
        for q in ((r[0], r[1], mx, my), (mx, r[1], r[2], my), (r[0], my, mx, r[3]), (mx, my, r[2], r[3])):
            split(q, [p for p in own if q[0] <= p[0] < q[2] and q[1] <= p[1] < q[3]], level + 1)

    x0, y0, x1, y1 = bounds
    x1, y1 = x1 + (x1 - x0 or 1) * 1e-9, y1 + (y1 - y0 or 1) * 1e-9
    split((x0, y0, x1, y1), points, 0)
    wide = lambda r: (-INF if r[0] == x0 else r[0], -INF if r[1] == y0 else r[1], INF if r[2] == x1 else r[2], INF if r[3] == y1 else r[3])
    return Cells([wide(r) for r in out])


def str_tree(points: list[tuple[float, float]], partitions: int) -> Cells:
    """Slices of equal numbers of points from left to right, each cut into cells of equal numbers from below: a packed R-tree's leaves, without gaps."""
    slices = max(1, math.ceil(math.sqrt(partitions)))
    points = sorted(points)
    cuts = lambda v, n: sorted({v[len(v) * k // n] for k in range(1, n)}) if v else []
    xs = [-INF, *cuts([p[0] for p in points], slices), INF]
    out = []
    for x0, x1 in zip(xs, xs[1:], strict=False):
        ys = [-INF, *cuts(sorted(p[1] for p in points if x0 <= p[0] < x1), max(1, round(partitions / (len(xs) - 1)))), INF]
        out += [(x0, y0, x1, y1) for y0, y1 in zip(ys, ys[1:], strict=False)]
    return Cells(out)


def equal_grid(partitions: int, bounds: Rect) -> Cells:
    n = max(1, round(partitions**0.5))
    xs = [-INF, *(bounds[0] + (bounds[2] - bounds[0]) * k / n for k in range(1, n)), INF]
    ys = [-INF, *(bounds[1] + (bounds[3] - bounds[1]) * k / n for k in range(1, n)), INF]
    return Cells([(xs[i], ys[j], xs[i + 1], ys[j + 1]) for j in range(n) for i in range(n)])


def hilbert(cx: Column, cy: Column, bits: int = 16) -> Column:
    """Place on the Hilbert curve of a 2^bits grid: a fold over the bits, the highest first."""
    start = F.struct(F.lit(0).cast("long").alias("d"), cx.cast("long").alias("x"), cy.cast("long").alias("y"))

    def step(s: Column, k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        rx, ry = F.when(s["x"] >= side, 1).otherwise(0), F.when(s["y"] >= side, 1).otherwise(0)
        x, y = s["x"] - rx * side, s["y"] - ry * side
        d = s["d"] + side * side * ((3 * rx).bitwiseXOR(ry)).cast("long")
        fx, fy = F.when(rx == 1, side - 1 - x).otherwise(x), F.when(rx == 1, side - 1 - y).otherwise(y)
        return F.struct(d.alias("d"), F.when(ry == 0, fy).otherwise(x).alias("x"), F.when(ry == 0, fx).otherwise(y).alias("y"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda s: s["d"])


def build(df: DataFrame, geom: str, kind: str, partitions: int, seed: int = 7) -> Cells:
    """Cells of a kind (kdbtree, quadtree, rtree, equalgrid) for a frame."""
    b = df.select(box(df, geom).alias("b")).where("b.xmin is not null")
    s = b.agg(F.count("*").alias("n"), F.min("b.xmin").alias("x0"), F.min("b.ymin").alias("y0"), F.max("b.xmax").alias("x1"), F.max("b.ymax").alias("y1")).first()
    if not s.n:
        return Cells([(-INF, -INF, INF, INF)])
    bounds = (s.x0, s.y0, s.x1, s.y1)
    if kind == "equalgrid":
        return equal_grid(partitions, bounds)
    want = min(SAMPLE, sample_size(s.n, partitions))
    # the rows of smallest hash: neither the files' order nor their cut plays a part
    part = b if want >= s.n else b.orderBy(F.xxhash64("b", F.lit(seed)), "b").limit(want)
    points = [(r.b.xmin, r.b.ymin) for r in part.collect()]
    random.Random(seed).shuffle(points)
    if kind == "kdbtree":
        return kdb_tree(points, partitions)
    if kind == "rtree":
        return str_tree(points, partitions)
    if kind == "quadtree":
        return quad_tree(points, partitions, bounds)
    raise ValueError(f"unknown partitioning {kind}")


def partition(df: DataFrame, geom: str = "geom", kind: str = "kdbtree", partitions: int = 16, cells: Cells | None = None) -> tuple[DataFrame, Cells]:
    """The rows with ``cell_id``, dealt out by it; extended geometries appear in every cell they meet.

    Pass the cells of one side to place the other side alike.  A column that is
    called cell_id already is replaced.
    """
    cells = cells or build(df, geom, kind, partitions)
    packed = df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), box(df, geom).alias("_box"))
    placed = packed.select("_row", F.explode(cells.ids_of(F.col("_box"))).alias("cell_id")).select(*(F.col("_row").getField(c).alias(c) for c in df.columns if c != "cell_id"), "cell_id")
    return placed.repartition(len(cells.rects), "cell_id"), cells


def curve_order(df: DataFrame, geom: str, bounds: Rect, kind: str = "hilbert", partitions: int = 16, bits: int = 16) -> DataFrame:
    """The rows range-partitioned along a space-filling curve (hilbert or morton) over box corners."""
    b = box(df, geom)
    place = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) / (hi - lo or 1) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    cx, cy = place(b["xmin"], bounds[0], bounds[2]), place(b["ymin"], bounds[1], bounds[3])
    code = hilbert(cx, cy, bits) if kind == "hilbert" else N.morton(cx, cy, bits)
    return df.withColumn("curve", code).repartitionByRange(partitions, "curve").sortWithinPartitions("curve")
