"""Aggregates over geometry columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import native as N
from geoloom.kernel.geometry import POLYGON, Geom, bbox, rectangle
from geoloom.kernel.measure import envelope
from geoloom.kernel.overlay import intersection, union
from geoloom.operators.geometry import box


def fold_union(geoms: list[Geom]) -> Geom | None:
    """Union by pairs of neighbours in the plane, so that operands stay small; rectangles in a row are joined first."""
    if not geoms:
        return None
    if len(geoms) > 1:
        geoms = sorted(_joined(geoms), key=lambda g: bbox(g) or ())
    while len(geoms) > 1:
        geoms = [union(geoms[i : i + 2]) for i in range(0, len(geoms), 2)]
    return geoms[0]


def _joined(geoms: list[Geom]) -> list[Geom]:
    """The geometries, with upright rectangles of one height (then width) that meet in a row as one: what their union is."""
    boxes, others = set(), []
    for g in geoms:
        b = bbox(g) if g.kind == POLYGON and len(g.data) == 1 and len(g.data[0]) == 5 else None
        if b and b[0] < b[2] and b[1] < b[3] and rectangle(*b).data[0] == list(map(tuple, g.data[0])):
            boxes.add(tuple(b))
        else:
            others.append(g)
    before = None
    while before != len(boxes):
        before = len(boxes)
        for k in (0, 1):  # the axis along which a row runs
            row = []
            for b in sorted(boxes, key=lambda b: (b[1 - k], b[3 - k], b[k])):
                last = row[-1] if row else None
                if last and (last[1 - k], last[3 - k]) == (b[1 - k], b[3 - k]) and b[k] <= last[2 + k]:
                    last[2 + k] = max(last[2 + k], b[2 + k])
                else:
                    row.append(list(b))
            boxes = set(map(tuple, row))
    return [rectangle(*b) for b in sorted(boxes)] + others


def fold_intersection(geoms: list[Geom]) -> Geom | None:
    """Once empty, it stays empty."""
    return reduce(intersection, geoms) if geoms else None


def fold_envelope(geoms: list[Geom]) -> Geom | None:
    boxes = [b for g in geoms if (b := bbox(g))]
    if not boxes:
        return None
    return envelope(rectangle(min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)))


def envelope_aggregate(df: DataFrame, geom: str = "geom", *keys: str) -> DataFrame:
    """Bounding box of each group: four minima and maxima, combined map-side."""
    b = df.select(*keys, box(df, geom).alias("_b"))
    return b.groupBy(*keys).agg(F.min("_b.xmin").alias("xmin"), F.min("_b.ymin").alias("ymin"), F.max("_b.xmax").alias("xmax"), F.max("_b.ymax").alias("ymax"))


def rect_intersection_aggregate(df: DataFrame, geom: str = "geom", *keys: str) -> DataFrame:
    """Common rectangle of each group of rectangles; null where there is none."""
    g = df.groupBy(*keys).agg(F.max(f"{geom}.xmin").alias("xmin"), F.max(f"{geom}.ymin").alias("ymin"), F.min(f"{geom}.xmax").alias("xmax"), F.min(f"{geom}.ymax").alias("ymax"))
    some = (F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax"))
    return g.select(*keys, F.when(some, N.rectangle("xmin", "ymin", "xmax", "ymax")).alias(geom))


def union_aggregate(df: DataFrame, geom: str = "geom", *keys: str) -> DataFrame:
    """Union of a WKB column, in two steps: what lies together in a cell of a grid first, then the cells' parts."""
    from geoloom.functions.register import aggregates

    union_udf = aggregates()["ST_Union_Aggr"]
    boxed = df.select(*keys, df[geom].alias(geom), box(df, geom).alias("_box"))
    b = F.col("_box")
    s = boxed.agg(F.count("*").alias("n"), F.min(b["xmin"]).alias("x0"), F.min(b["ymin"]).alias("y0"), F.max(b["xmin"]).alias("x1"), F.max(b["ymin"]).alias("y1")).first()
    parts = max(64, s.n // 256)
    w, h = (s.x1 - s.x0, s.y1 - s.y0) if s.x0 is not None else (0.0, 0.0)
    size = max(math.sqrt(w * h / parts), max(w, h) / parts) or 1.0
    at = [F.coalesce(F.floor((b[c] - F.lit(v or 0.0)) / F.lit(size)), F.lit(-1).cast("long")).alias(n) for c, v, n in (("xmin", s.x0, "_px"), ("ymin", s.y0, "_py"))]
    first = boxed.select(*keys, geom, *at).groupBy(*keys, "_px", "_py").agg(union_udf(F.col(geom)).alias(geom))
    return first.groupBy(*keys).agg(union_udf(F.col(geom)).alias(geom))


def analyze(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Count and boundary in one aggregation."""
    b = df.select(box(df, geom).alias("_b"))
    return b.agg(F.count("*").alias("count"), F.min("_b.xmin").alias("xmin"), F.min("_b.ymin").alias("ymin"), F.max("_b.xmax").alias("xmax"), F.max("_b.ymax").alias("ymax"))


def count_distinct(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.select(geom).distinct().agg(F.count("*").alias("count"))
