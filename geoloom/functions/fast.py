"""NumPy forms of kernel functions for whole Arrow batches of the commonest geometries.

A plain point is 21 bytes of WKB and a plain rectangle 93, so batches of them
are arrays.  Each function gives None where a batch holds anything else, and the
general one takes over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from geoloom.kernel.geometry import point, rectangle, to_wkb

_POINT = np.dtype([("head", "V5"), ("x", "<f8"), ("y", "<f8")])
_RECT = np.dtype([("head", "V13"), ("c", "<f8", (10,))])
_POINT_HEAD = to_wkb(point(0.0, 0.0))[:5]
_RECT_HEAD = to_wkb(rectangle(0.0, 1.0, 2.0, 3.0))[:13]
#: Which side (xmin, ymin, xmax, ymax) each of the ten numbers of a rectangle's ring is.
_RING = [int(v) for p in rectangle(0, 1, 2, 3).data[0] for v in p]


def _split(data: np.ndarray, missing: np.ndarray) -> pd.Series:
    raw, n = data.tobytes(), data.dtype.itemsize
    return pd.Series([None if m else raw[i : i + n] for i, m in zip(range(0, len(raw), n), missing, strict=True)], dtype="object")


def _numbers(*columns) -> tuple[list[np.ndarray], np.ndarray]:
    out = [pd.to_numeric(c).to_numpy(dtype=float, na_value=np.nan) for c in columns]
    return out, np.any([np.isnan(v) for v in out], axis=0)


def make_points(x: pd.Series, y: pd.Series) -> pd.Series:
    (xs, ys), missing = _numbers(x, y)
    data = np.empty(len(xs), dtype=_POINT)
    data["head"], data["x"], data["y"] = np.void(_POINT_HEAD), xs, ys
    return _split(data, missing)


def make_rectangles(*sides: pd.Series) -> pd.Series:
    values, missing = _numbers(*sides)
    data = np.empty(len(missing), dtype=_RECT)
    data["head"] = np.void(_RECT_HEAD)
    data["c"] = np.stack(values, 1)[:, _RING] if len(missing) else 0
    return _split(data, missing)


def read_points(g: pd.Series) -> tuple[np.ndarray, np.ndarray] | None:
    """x and y of a batch of plain points, NaN where null."""
    missing = g.isna().to_numpy()
    own = [bytes(v) for v in g[~missing]]
    if any(len(v) != 21 for v in own):
        return None
    data = np.frombuffer(b"".join(own), dtype=_POINT)
    if len(own) and (data["head"] != np.void(_POINT_HEAD)).any():
        return None
    x, y = np.full(len(g), np.nan), np.full(len(g), np.nan)
    x[~missing], y[~missing] = data["x"], data["y"]
    return x, y


def read_boxes(g: pd.Series) -> np.ndarray | None:
    """(xmin, ymin, xmax, ymax) of a batch of plain points, or of plain rectangles' rings of five corners; NaN where null."""
    found = read_points(g)
    if found is not None:
        return np.stack([found[0], found[1], found[0], found[1]], 1)
    missing = g.isna().to_numpy()
    own = [bytes(v) for v in g[~missing]]
    if any(len(v) != 93 or v[:13] != _RECT_HEAD for v in own):
        return None
    c = np.frombuffer(b"".join(own), dtype=_RECT)["c"].reshape(-1, 5, 2)
    out = np.full((len(g), 4), np.nan)
    out[~missing] = np.concatenate([c.min(1), c.max(1)], 1)
    return out


def _value(v: np.ndarray) -> pd.Series:
    return pd.Series(v).astype("object").where(~np.isnan(v), None)


def x_of(g: pd.Series) -> pd.Series | None:
    found = read_points(g)
    return None if found is None else _value(found[0])


def y_of(g: pd.Series) -> pd.Series | None:
    found = read_points(g)
    return None if found is None else _value(found[1])


def distances(a: pd.Series, b: pd.Series) -> pd.Series | None:
    p, q = read_points(a), read_points(b)
    return None if p is None or q is None else _value(np.hypot(p[0] - q[0], p[1] - q[1]))


def flipped(g: pd.Series) -> pd.Series | None:
    found = read_points(g)
    return None if found is None else make_points(pd.Series(found[1]), pd.Series(found[0]))


def read_rectangles(g: pd.Series) -> tuple[np.ndarray, np.ndarray] | None:
    """Sides (in columns) of a batch of plain rectangles with an area, and which are null."""
    found = read_boxes(g)
    if found is None:
        return None
    missing = g.isna().to_numpy()
    own = found[~missing]
    if not ((own[:, 0] < own[:, 2]) & (own[:, 1] < own[:, 3])).all():
        return None
    corners = np.frombuffer(b"".join(bytes(v) for v in g[~missing]), dtype=_RECT)["c"]
    if (corners != own[:, _RING]).any():  # rings of five corners that are no upright rectangles, or run otherwise
        return None
    return found.T, missing


def _inside(a, b):
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def _meet(a, b):
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def _hold(a, b):
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def of_rectangles(told):
    """An array form of a predicate on two plain rectangles."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series | None:
        p = read_rectangles(a)
        q = None if p is None else read_rectangles(b)
        if q is None:
            return None
        with np.errstate(invalid="ignore"):
            found = told(p[0], q[0])
        return pd.Series(found).astype("object").where(~(p[1] | q[1]), None)

    return run


def intersections(a: pd.Series, b: pd.Series) -> pd.Series | None:
    """Common rectangles; where rectangles only touch or lie apart, the kernel tells."""
    from geoloom.kernel.geometry import from_wkb
    from geoloom.kernel.overlay import intersection

    p = read_rectangles(a)
    q = None if p is None else read_rectangles(b)
    if q is None:
        return None
    with np.errstate(invalid="ignore"):
        area = _inside(p[0], q[0])
    sides = np.concatenate([np.maximum(p[0][:2], q[0][:2]), np.minimum(p[0][2:], q[0][2:])])
    out = make_rectangles(*(pd.Series(v) for v in sides))
    for i in np.flatnonzero(~area & ~p[1] & ~q[1]):
        out.iat[i] = to_wkb(intersection(from_wkb(bytes(a.iat[i])), from_wkb(bytes(b.iat[i]))))
    return out


def areas(g: pd.Series) -> pd.Series | None:
    found = read_rectangles(g)
    return None if found is None else _value((found[0][2] - found[0][0]) * (found[0][3] - found[0][1]))


FAST = {"ST_Point": make_points, "ST_PolygonFromEnvelope": make_rectangles, "ST_X": x_of, "ST_Y": y_of, "ST_Distance": distances, "ST_FlipCoordinates": flipped, "ST_Intersection": intersections, "ST_Area": areas}
FAST |= {
    "ST_Contains": of_rectangles(_hold),
    "ST_Within": of_rectangles(lambda a, b: _hold(b, a)),
    "ST_Intersects": of_rectangles(_meet),
    "ST_Touches": of_rectangles(lambda a, b: _meet(a, b) & ~_inside(a, b)),
    "ST_Overlaps": of_rectangles(lambda a, b: _inside(a, b) & ~_hold(a, b) & ~_hold(b, a)),
    "ST_Equals": of_rectangles(lambda a, b: (a == b).all(0)),
}

__all__ = ["FAST", "read_boxes", "read_points"]
