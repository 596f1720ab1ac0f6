"""Geometry columns: which kind they are, their boxes, and exact predicates on pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import native as N
from geoloom.functions.fast import read_boxes
from geoloom.functions.kernels import FUNCTIONS, batched
from geoloom.kernel.geometry import POLYGON, Geom, bbox, from_wkb, leaves, point, to_wkb
from geoloom.kernel.overlay import OUTSIDE, covers, locate_point

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def kind_of(df: DataFrame, name: str) -> str:
    """'point', 'rect' or 'wkb' by the column's type."""
    t = df.schema[name].dataType
    if isinstance(t, T.StructType):
        names = {f.name for f in t.fields}
        if {"x", "y"} <= names:
            return "point"
        if {"xmin", "ymin", "xmax", "ymax"} <= names:
            return "rect"
    if isinstance(t, T.BinaryType):
        return "wkb"
    raise TypeError(f"{name} is no geometry column: {t.simpleString()}")


def _boxes(g: pd.Series) -> pd.DataFrame:
    found = read_boxes(g)
    if found is not None:
        return pd.DataFrame(found, columns=["xmin", "ymin", "xmax", "ymax"])
    boxes = [None if x is None else bbox(from_wkb(bytes(x))) for x in g]
    return pd.DataFrame([b or (None,) * 4 for b in boxes], columns=["xmin", "ymin", "xmax", "ymax"], dtype="float64")


def wkb_box(g: Column) -> Column:
    return F.pandas_udf(_boxes, BOX)(g)


def box(df: DataFrame, name: str) -> Column:
    """Bounding box of a geometry column; native for points and rectangles."""
    kind = kind_of(df, name)
    if kind == "point":
        return N.point_box(df[name])
    return df[name] if kind == "rect" else wkb_box(df[name])


_AS_WKB = {
    "point": lambda c: batched(FUNCTIONS["ST_Point"][1], "binary")(c["x"], c["y"]),
    "rect": lambda c: batched(FUNCTIONS["ST_PolygonFromEnvelope"][1], "binary")(c["xmin"], c["ymin"], c["xmax"], c["ymax"]),
    "wkb": lambda c: c,
}

#: Predicates that no native form covers go to the kernel, behind the boxes.
KERNEL = {"contains": "ST_Contains", "within": "ST_Within", "intersects": "ST_Intersects", "crosses": "ST_Crosses", "overlaps": "ST_Overlaps", "touches": "ST_Touches", "equals": "ST_Equals"}


def exact(predicate: str, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """The predicate on a pair of columns of the given kinds."""
    if predicate == "within":
        return exact("contains", b, a, kinds[::-1])
    if kinds == ("point", "point"):
        same = (a["x"] == b["x"]) & (a["y"] == b["y"])
        return same if predicate in ("contains", "intersects", "equals") else F.lit(False)
    if kinds == ("rect", "point") and predicate in ("contains", "intersects"):
        return N.rect_covers_point(a, b)
    if kinds == ("point", "rect") and predicate == "intersects":
        return N.rect_covers_point(b, a)
    if kinds == ("rect", "rect"):
        if predicate == "crosses":
            return F.lit(False)
        return {"contains": N.rect_covers, "intersects": N.rect_intersects, "overlaps": N.rect_overlaps, "touches": N.rect_touches, "equals": N.rect_equals}[predicate](a, b)
    if kinds == ("wkb", "point") and predicate in ("contains", "intersects"):
        return F.pandas_udf(covers_points, "boolean")(a, b["x"], b["y"])
    if kinds == ("point", "wkb") and predicate == "intersects":
        return F.pandas_udf(covers_points, "boolean")(b, a["x"], a["y"])
    return batched(FUNCTIONS[KERNEL[predicate]][1], "boolean")(_AS_WKB[kinds[0]](a), _AS_WKB[kinds[1]](b))


def covers_points(g: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Whether geometries cover points: each distinct geometry of a batch is read once, its points are told by crossings at once."""
    code, shapes = pd.factorize(g)
    out = np.zeros(len(g), dtype=bool)
    xs, ys = x.to_numpy(dtype=float), y.to_numpy(dtype=float)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(shapes) + 1))
    for k, shape in enumerate(shapes):
        at = order[cuts[k] : cuts[k + 1]]
        out[at] = _covered(from_wkb(bytes(shape)), xs[at], ys[at])
    missing = g.isna() | x.isna() | y.isna()
    return pd.Series(out, index=g.index).astype("boolean").mask(missing) if missing.any() else pd.Series(out, index=g.index)


def _covered(g: Geom, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=bool)
    for part in leaves(g):
        if part.kind != POLYGON:
            out |= np.array([covers(part, point(a, b)) for a, b in zip(x, y, strict=True)], dtype=bool)
            continue
        rings = [np.array(r, dtype=float) for r in part.data if len(r) > 1]
        step = max(1, 1_000_000 // max(map(len, rings)))  # bounded intermediates
        for at in range(0, len(x), step):
            px, py = x[at : at + step, None], y[at : at + step, None]
            inside, close = np.ones(len(px), dtype=bool), np.zeros(len(px), dtype=bool)
            for k, ring in enumerate(rings):
                (ax, ay), (bx, by) = ring[:-1].T, ring[1:].T
                left, right = (bx - ax) * (py - ay), (by - ay) * (px - ax)
                side = left - right
                within = (((ay > py) != (by > py)) & ((side > 0) == (by > ay))).sum(1) % 2 == 1
                inside &= within if k == 0 else ~within
                # next to an edge floating point can't tell: those few are located exactly
                level = (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
                close |= (level & (np.abs(side) <= 1e-12 * (np.abs(left) + np.abs(right)) + 1e-300)).any(1)
            for i in np.flatnonzero(close):
                inside[i] = locate_point((float(px[i, 0]), float(py[i, 0])), part) != OUTSIDE
            out[at : at + step] |= inside
    return out


def distance(a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    if kinds == ("point", "point"):
        return N.distance(a, b)
    if kinds == ("rect", "point"):
        return N.rect_point_distance(a, b)
    if kinds == ("point", "rect"):
        return N.rect_point_distance(b, a)
    return batched(FUNCTIONS["ST_Distance"][1], "double")(_AS_WKB[kinds[0]](a), _AS_WKB[kinds[1]](b))


def literal(g: Geom) -> Column:
    """A geometry as a WKB literal."""
    return F.lit(to_wkb(g))
