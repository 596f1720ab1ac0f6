"""Geometries, and their WKB, WKT and GeoJSON forms.

``Geom(kind, data, srid)``: kind is the WKB code.  data of a POINT is (x, y) or
None, of a LINESTRING a list of points, of a POLYGON a list of rings, of a
MULTI* a list of the parts' data, of a GEOMETRYCOLLECTION a list of Geom.
"""

from __future__ import annotations

import json
import re
import struct
from typing import Any, NamedTuple

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString", MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}
BY_NAME = {v.upper(): k for k, v in NAMES.items()}


class Geom(NamedTuple):
    kind: int
    data: Any
    srid: int = 0


def point(x: float, y: float) -> Geom:
    return Geom(POINT, (float(x), float(y)))


def rectangle(x0: float, y0: float, x1: float, y1: float) -> Geom:
    """Corners in the order lower left, upper left, upper right, lower right."""
    return Geom(POLYGON, [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]])


def is_empty(g: Geom) -> bool:
    if g.kind == COLLECTION:
        return all(is_empty(x) for x in g.data)
    return not g.data or (g.kind >= MULTIPOINT and not any(g.data))


def parts(g: Geom) -> list[Geom]:
    """The geometries a collection is made of; a single one is its own part."""
    if g.kind < MULTIPOINT:
        return [g]
    if g.kind == COLLECTION:
        return [x._replace(srid=g.srid) for x in g.data]
    return [Geom(g.kind - 3, x, g.srid) for x in g.data]


def leaves(g: Geom) -> list[Geom]:
    """All single geometries within, through nested collections."""
    if g.kind < MULTIPOINT:
        return [] if is_empty(g) else [g]
    return [y for x in parts(g) for y in leaves(x)]


def collect(geoms: list[Geom], srid: int = 0) -> Geom:
    """The simplest geometry that holds the given single ones."""
    kinds = {g.kind for g in geoms}
    if len(geoms) == 1:
        return geoms[0]._replace(srid=srid)
    if len(kinds) == 1 and next(iter(kinds)) < MULTIPOINT:
        return Geom(next(iter(kinds)) + 3, [g.data for g in geoms], srid)
    return Geom(COLLECTION, list(geoms), srid)


def vertices(g: Geom) -> list[tuple[float, float]]:
    """All coordinates in order."""
    if g.kind == COLLECTION:
        return [p for x in g.data for p in vertices(x)]
    if g.kind == POINT:
        return [g.data] if g.data else []
    if g.kind in (LINE, MULTIPOINT):
        return [p for p in g.data if p]
    if g.kind in (POLYGON, MULTILINE):
        return [p for r in g.data for p in r]
    return [p for poly in g.data for r in poly for p in r]


def transform(g: Geom, f) -> Geom:
    """The geometry with f(x, y) in place of every coordinate."""
    if g.kind == COLLECTION:
        return g._replace(data=[transform(x, f) for x in g.data])

    def walk(d):
        if isinstance(d, tuple):
            return tuple(map(float, f(*d)))
        return [walk(x) for x in d]

    return g if is_empty(g) else g._replace(data=walk(g.data))


def bbox(g: Geom) -> tuple[float, float, float, float] | None:
    v = vertices(g)
    if not v:
        return None
    xs, ys = zip(*v, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


# --- WKB -----------------------------------------------------------------

_SRID = 0x20000000


def to_wkb(g: Geom, srid: bool = True) -> bytes:
    """Little-endian WKB; with the SRID (EWKB) if there is one."""
    flag = _SRID if srid and g.srid else 0
    out = [struct.pack("<BI", 1, g.kind | flag)]
    if flag:
        out.append(struct.pack("<i", g.srid))
    ring = lambda r: struct.pack(f"<I{2 * len(r)}d", len(r), *(c for p in r for c in p))
    if g.kind == POINT:
        out.append(struct.pack("<2d", *(g.data or (float("nan"), float("nan")))))
    elif g.kind == LINE:
        out.append(ring(g.data))
    elif g.kind == POLYGON:
        out.append(struct.pack("<I", len(g.data)))
        out += map(ring, g.data)
    else:
        out.append(struct.pack("<I", len(g.data)))
        out += [to_wkb(x._replace(srid=0), False) for x in parts(g)]
    return b"".join(out)


def from_wkb(data: bytes) -> Geom:
    """WKB or EWKB in either byte order; Z and M are dropped."""
    g, end = _read_wkb(memoryview(data), 0)
    if end != len(data):
        raise ValueError("bytes after the geometry")
    return g


def _read_wkb(b: memoryview, at: int) -> tuple[Geom, int]:
    if b[at] > 1:
        raise ValueError("unknown byte order")
    order = "<" if b[at] else ">"
    (code,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    srid = 0
    if code & _SRID:
        (srid,) = struct.unpack_from(order + "i", b, at)
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    iso, kind = divmod(code & 0x0FFFFFFF, 1000)
    dims = max(dims, {0: 2, 1: 3, 2: 3, 3: 4}[iso])

    def line(at: int):
        (n,) = struct.unpack_from(order + "I", b, at)
        flat = struct.unpack_from(f"{order}{n * dims}d", b, at + 4)
        return [(flat[i], flat[i + 1]) for i in range(0, n * dims, dims)], at + 4 + 8 * n * dims

    if kind == POINT:
        c = struct.unpack_from(f"{order}{dims}d", b, at)
        return Geom(POINT, None if c[0] != c[0] else (c[0], c[1]), srid), at + 8 * dims
    if kind == LINE:
        data, at = line(at)
        return Geom(LINE, data, srid), at
    if kind not in NAMES:
        raise ValueError(f"unknown geometry code {kind}")
    (n,) = struct.unpack_from(order + "I", b, at)
    at += 4
    out = []
    for _ in range(n):
        if kind == POLYGON:
            r, at = line(at)
            out.append(r)
        else:
            g, at = _read_wkb(b, at)
            out.append(g if kind == COLLECTION else g.data)
    return Geom(kind, out, srid), at


# --- WKT -----------------------------------------------------------------

_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),;=]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")


def from_wkt(text: str) -> Geom:
    """WKT, with an optional SRID=n; in front; Z and M are dropped."""
    srid = 0
    m = re.match(r"\s*SRID=(\d+);", text, re.I)
    if m:
        srid, text = int(m[1]), text[m.end() :]
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not WKT at {at}: {text[at : at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.append("")
    pos = 0

    def take(want: str | None = None) -> str:
        nonlocal pos
        t = tokens[pos]
        if want is not None and t != want:
            raise ValueError(f"expected {want!r}, found {t!r}")
        pos += 1
        return t

    def coordinate() -> tuple[float, float]:
        c = []
        while tokens[pos] not in ("", ",", ")", "("):
            c.append(float(take()))
        if len(c) < 2:
            raise ValueError("a coordinate needs two numbers")
        return c[0], c[1]

    def listed(item):
        take("(")
        out = [item()]
        while tokens[pos] == ",":
            take()
            out.append(item())
        take(")")
        return out

    def maybe_point():
        if tokens[pos] == "(":
            take()
            c = coordinate()
            take(")")
            return c
        return coordinate()

    line = lambda: listed(coordinate)
    polygon = lambda: listed(line)

    def geometry() -> Geom:
        name = take().upper()
        if name not in BY_NAME:
            raise ValueError(f"unknown geometry {name!r}")
        kind = BY_NAME[name]
        if tokens[pos].upper() in ("Z", "M", "ZM"):
            take()
        if tokens[pos].upper() == "EMPTY":
            take()
            return Geom(kind, None if kind == POINT else [])
        if kind == POINT:
            take("(")
            c = coordinate()
            take(")")
            return Geom(POINT, c)
        reader = {LINE: line, POLYGON: polygon, MULTIPOINT: lambda: listed(maybe_point), MULTILINE: lambda: listed(line), MULTIPOLYGON: lambda: listed(polygon), COLLECTION: lambda: listed(geometry)}[kind]
        return Geom(kind, reader())

    g = geometry()
    if tokens[pos] != "":
        raise ValueError(f"text after the geometry: {tokens[pos]!r}")
    check_rings(g)
    return g._replace(srid=srid)


def check_rings(g: Geom) -> None:
    """Rings must be closed and have four points or more; lines two."""
    for x in leaves(g):
        if x.kind == POLYGON:
            for r in x.data:
                if r and (len(r) < 4 or r[0] != r[-1]):
                    raise ValueError("a ring must be closed and have at least four points")
        elif x.kind == LINE and len(x.data) == 1:
            raise ValueError("a line needs two points")


def number(v: float) -> str:
    """Shortest decimal form, without exponent and without a trailing .0"""
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    s = repr(float(v))
    return s if "e" not in s else f"{v:.17f}".rstrip("0").rstrip(".")


def to_wkt(g: Geom) -> str:
    name = NAMES[g.kind].upper()
    if g.kind == COLLECTION:
        return f"{name} EMPTY" if not g.data else f"{name} ({', '.join(map(to_wkt, g.data))})"
    if not g.data:
        return f"{name} EMPTY"

    def walk(d) -> str:
        if d is None or d == []:
            return "EMPTY"
        if isinstance(d, tuple):
            return f"{number(d[0])} {number(d[1])}"
        if g.kind == MULTIPOINT:
            return "(" + ", ".join(f"({walk(x)})" for x in d) + ")"
        return "(" + ", ".join(map(walk, d)) + ")"

    return f"{name} ({walk(g.data)})" if g.kind == POINT else f"{name} {walk(g.data)}"


# --- GeoJSON -------------------------------------------------------------


def to_geojson(g: Geom) -> str:
    def value(x: Geom) -> dict:
        if x.kind == COLLECTION:
            return {"type": "GeometryCollection", "geometries": [value(y) for y in x.data]}
        return {"type": NAMES[x.kind], "coordinates": x.data if x.data is not None else []}

    return json.dumps(value(g), separators=(",", ":"))


def from_geojson(text: str | dict) -> Geom:
    """A GeoJSON geometry, or the geometry of a Feature."""
    d = json.loads(text) if isinstance(text, str) else text
    if not isinstance(d, dict) or "type" not in d:
        raise ValueError("not a GeoJSON object")
    if d["type"] == "Feature":
        d = d["geometry"]
    if d["type"] == "GeometryCollection":
        return Geom(COLLECTION, [from_geojson(x) for x in d["geometries"]])
    kind = BY_NAME.get(d["type"].upper())
    if kind is None:
        raise ValueError(f"unknown geometry {d['type']!r}")

    def walk(x, depth: int):
        if depth == 0:
            return (float(x[0]), float(x[1]))
        return [walk(y, depth - 1) for y in x]

    depth = {POINT: 0, LINE: 1, MULTIPOINT: 1, POLYGON: 2, MULTILINE: 2, MULTIPOLYGON: 3}[kind]
    c = d["coordinates"]
    g = Geom(kind, None if kind == POINT and not c else walk(c, depth))
    check_rings(g)
    return g
