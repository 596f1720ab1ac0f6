"""Points, rectangles, circles, cells, geohashes and pixels as plain Catalyst expressions.

Points are structs (x, y), rectangles structs (xmin, ymin, xmax, ymax); nothing
here leaves the JVM, so filters are pushed down and joins are equi-joins.
A null operand gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _whole(made: Column, *given: Column) -> Column:
    missing = given[0].isNull()
    for g in given[1:]:
        missing = missing | g.isNull()
    return F.when(~missing, made)


def point(x: ColumnOrName, y: ColumnOrName) -> Column:
    x, y = col(x).cast("double"), col(y).cast("double")
    return _whole(F.struct(x.alias("x"), y.alias("y")), x, y)


def rectangle(xmin: ColumnOrName, ymin: ColumnOrName, xmax: ColumnOrName, ymax: ColumnOrName) -> Column:
    sides = [col(c).cast("double") for c in (xmin, ymin, xmax, ymax)]
    return _whole(F.struct(*(s.alias(n) for s, n in zip(sides, ("xmin", "ymin", "xmax", "ymax"), strict=True))), *sides)


def point_box(p: Column) -> Column:
    """The rectangle of a point; of a null one, a rectangle of nulls (no case distinction stands in the way of the optimizer)."""
    return F.struct(p["x"].alias("xmin"), p["y"].alias("ymin"), p["x"].alias("xmax"), p["y"].alias("ymax"))


#: What a side that was computed may lack, as a part of the numbers it was made of: some units in the last place.
ROUNDING = 1e-14


def _reach(v: Column, by: Column) -> Column:
    """How far from a coordinate something at a distance of ``by`` may lie, when both sums and distances are rounded."""
    return by + (F.abs(v) + F.abs(by)) * F.lit(ROUNDING)


def grow(r: Column, by: ColumnOrName | float) -> Column:
    """A rectangle that holds all that is told to be within a distance, also where rounding brought it there."""
    by = F.lit(by) if isinstance(by, (int, float)) else col(by)
    return rectangle(r["xmin"] - _reach(r["xmin"], by), r["ymin"] - _reach(r["ymin"], by), r["xmax"] + _reach(r["xmax"], by), r["ymax"] + _reach(r["ymax"], by))


def rect_area(r: Column) -> Column:
    return (r["xmax"] - r["xmin"]) * (r["ymax"] - r["ymin"])


def rect_perimeter(r: Column) -> Column:
    return 2 * ((r["xmax"] - r["xmin"]) + (r["ymax"] - r["ymin"]))


def rect_centre(r: Column) -> Column:
    return point((r["xmin"] + r["xmax"]) / 2, (r["ymin"] + r["ymax"]) / 2)


def rect_covers_point(r: Column, p: Column) -> Column:
    return p["x"].between(r["xmin"], r["xmax"]) & p["y"].between(r["ymin"], r["ymax"])


def rect_covers(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmin"]) & (a["ymin"] <= b["ymin"]) & (a["xmax"] >= b["xmax"]) & (a["ymax"] >= b["ymax"])


def rect_intersects(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def _inner(a: Column, b: Column) -> Column:
    return (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])


def rect_touches(a: Column, b: Column) -> Column:
    return rect_intersects(a, b) & ~_inner(a, b)


def rect_equals(a: Column, b: Column) -> Column:
    return (a["xmin"] == b["xmin"]) & (a["ymin"] == b["ymin"]) & (a["xmax"] == b["xmax"]) & (a["ymax"] == b["ymax"])


def rect_overlaps(a: Column, b: Column) -> Column:
    return _inner(a, b) & ~rect_covers(a, b) & ~rect_covers(b, a)


def rect_intersection(a: Column, b: Column) -> Column:
    """The common rectangle; null where there is none."""
    return F.when(rect_intersects(a, b), rectangle(F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]), F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"])))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def rect_point_distance(r: Column, p: Column) -> Column:
    dx = F.greatest(r["xmin"] - p["x"], F.lit(0.0), p["x"] - r["xmax"])
    dy = F.greatest(r["ymin"] - p["y"], F.lit(0.0), p["y"] - r["ymax"])
    return F.sqrt(dx * dx + dy * dy)


def circle(centre: Column, radius: ColumnOrName | float) -> Column:
    """Struct (x, y, r) of a point and a radius of at least 0."""
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else col(radius).cast("double")
    return F.when(r >= 0, F.struct(centre["x"].alias("x"), centre["y"].alias("y"), r.alias("r")))


def circle_box(c: Column) -> Column:
    """A rectangle that holds all that the circle's tests find in it, also where rounding brought it there."""
    x, y = _reach(c["x"], c["r"]), _reach(c["y"], c["r"])
    return F.struct((c["x"] - x).alias("xmin"), (c["y"] - y).alias("ymin"), (c["x"] + x).alias("xmax"), (c["y"] + y).alias("ymax"))


def circle_covers_point(c: Column, p: Column) -> Column:
    return distance(c, p) <= c["r"]


def circle_covers_rect(c: Column, b: Column) -> Column:
    """All of a rectangle lies in the circle if its farthest corner does."""
    dx = F.greatest(F.abs(b["xmin"] - c["x"]), F.abs(b["xmax"] - c["x"]))
    dy = F.greatest(F.abs(b["ymin"] - c["y"]), F.abs(b["ymax"] - c["y"]))
    return F.sqrt(dx * dx + dy * dy) <= c["r"]


def circle_intersects_rect(c: Column, b: Column) -> Column:
    return rect_point_distance(b, c) <= c["r"]


def azimuth(p: Column, q: Column) -> Column:
    """Radians clockwise from north, from 0 to 2 pi."""
    a = F.atan2(q["x"] - p["x"], q["y"] - p["y"])
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def text(p: Column) -> Column:
    """WKT of a point."""
    n = lambda v: F.when(v == F.floor(v), F.floor(v).cast("long").cast("string")).otherwise(v.cast("string"))
    return F.concat(F.lit("POINT ("), n(p["x"]), F.lit(" "), n(p["y"]), F.lit(")"))


def precision(p: Column, digits: int) -> Column:
    k = 10.0**digits
    half_up = lambda v: F.floor(v * k + 0.5) / k
    return point(half_up(p["x"]), half_up(p["y"]))


def flip(p: Column) -> Column:
    return point(p["y"], p["x"])


def cell(v: ColumnOrName, size: float) -> Column:
    """Index of the grid cell, half open, that holds a coordinate."""
    return F.floor(col(v) / F.lit(float(size))).cast("long")


def morton(cx: Column, cy: Column, bits: int = 16) -> Column:
    """Interleaved bits of two non-negative cell numbers: x in the even places."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(cx, k).bitwiseAND(F.lit(1)).cast("long"), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(cy, k).bitwiseAND(F.lit(1)).cast("long"), 2 * k + 1))
    return out


def quadkey(cx: Column, cy: Column, zoom: int) -> Column:
    """One digit a level, the coarsest first: 1 for the right half, 2 for the lower."""
    return F.concat(*((F.shiftright(cx, k).bitwiseAND(F.lit(1)) + 2 * F.shiftright(cy, k).bitwiseAND(F.lit(1))).cast("string") for k in reversed(range(zoom))))


#: Digits of a geohash (fixed values).
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(p: Column, length: int = 10) -> Column:
    """Geohash of a point (x longitude, y latitude); null outside the globe, empty for lengths below 1, at most 20."""
    length = min(length, 20)
    if length <= 0:
        return F.when(p.isNotNull(), F.lit(""))
    # numbers of up to 50 bits each: exact in a double and a long
    bits = 5 * length
    xbits, ybits = (bits + 1) // 2, bits // 2
    cx = F.least(F.floor((p["x"] + 180) / 360 * float(1 << xbits)), F.lit(float((1 << xbits) - 1))).cast("long")
    cy = F.least(F.floor((p["y"] + 90) / 180 * float(1 << ybits)), F.lit(float((1 << ybits) - 1))).cast("long")
    digits = []
    for d in range(length):
        value = F.lit(0)
        for b in range(5):
            k = 5 * d + b  # even places belong to x
            source, shift = (cx, xbits - 1 - k // 2) if k % 2 == 0 else (cy, ybits - 1 - k // 2)
            value = value + F.shiftright(source, shift).bitwiseAND(F.lit(1)).cast("int") * (1 << (4 - b))
        digits.append(F.substring(F.lit(BASE32), value + 1, F.lit(1)))
    return F.when((F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90), F.concat(*digits))


def geohash_box(code: ColumnOrName, length: int | None = None) -> Column:
    """Rectangle of a geohash (its first ``length`` characters); null if a character is none of the digits."""
    code = F.lower(col(code))
    if length is not None:
        code = F.substring(code, 1, max(0, min(length, 20)))
    start = F.struct(F.lit(-180.0).alias("x0"), F.lit(180.0).alias("x1"), F.lit(-90.0).alias("y0"), F.lit(90.0).alias("y1"), F.lit(True).alias("e"))

    def half(box: Column, bit: Column) -> Column:
        mx, my = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
        e = box["e"]
        return F.struct(
            F.when(e & (bit == 1), mx).otherwise(box["x0"]).alias("x0"),
            F.when(e & (bit == 0), mx).otherwise(box["x1"]).alias("x1"),
            F.when(~e & (bit == 1), my).otherwise(box["y0"]).alias("y0"),
            F.when(~e & (bit == 0), my).otherwise(box["y1"]).alias("y1"),
            (~e).alias("e"),
        )

    bits = F.flatten(F.transform(F.split(code, ""), lambda c: F.transform(F.array(*map(F.lit, (16, 8, 4, 2, 1))), lambda w: F.when((F.position(c, F.lit(BASE32)) - 1).bitwiseAND(w) > 0, 1).otherwise(0))))
    box = F.aggregate(bits, start, half)
    return F.when(code.rlike(f"^[{BASE32}]+$"), rectangle(box["x0"], box["y0"], box["x1"], box["y1"]))


def web_mercator(p: Column) -> Column:
    """EPSG:4326 longitude and latitude to EPSG:3857 metres."""
    r = 6378137.0
    return point(F.radians(p["x"]) * r, F.log(F.tan(math.pi / 4 + F.radians(p["y"]) / 2)) * r)


def lon_lat(p: Column) -> Column:
    """EPSG:3857 to EPSG:4326."""
    r = 6378137.0
    return point(F.degrees(p["x"] / r), F.degrees(2 * F.atan(F.exp(p["y"] / r)) - math.pi / 2))


# --- pixels ------------------------------------------------------------------


def pixel(p: Column, res_x: int, res_y: int, box: tuple[float, float, float, float]) -> Column:
    """The pixel of a point in a picture of the box; the right and upper edges belong to the last pixels; null outside."""
    x0, y0, x1, y1 = box
    px = F.least(F.floor((p["x"] - x0) / (x1 - x0) * res_x), F.lit(res_x - 1)).cast("int")
    py = F.least(F.floor((p["y"] - y0) / (y1 - y0) * res_y), F.lit(res_y - 1)).cast("int")
    inside = p["x"].between(x0, x1) & p["y"].between(y0, y1)
    return F.when(inside, F.struct(px.alias("x"), py.alias("y"), F.lit(res_x).alias("res_x"), F.lit(res_y).alias("res_y")))


def pixel_id(px: Column) -> Column:
    """A pixel's place in its picture as one number: row by row."""
    return px["x"].cast("long") + px["y"].cast("long") * px["res_x"]


def pixel_of(number: ColumnOrName, res_x: int, res_y: int) -> Column:
    """The pixel of such a number."""
    n = col(number).cast("long")
    return F.struct((n % res_x).cast("int").alias("x"), F.floor(n / res_x).cast("int").alias("y"), F.lit(res_x).alias("res_x"), F.lit(res_y).alias("res_y"))


def flipped_pixel(px: Column) -> Column:
    """The pixel with its rows counted from the other side."""
    return F.struct(px["x"].alias("x"), (px["res_y"] - 1 - px["y"]).alias("y"), px["res_x"].alias("res_x"), px["res_y"].alias("res_y"))


def tile_of_lineage(lineage: ColumnOrName) -> Column:
    """zoom-x-y of a path of quarters, a digit a level: 1 for the right half, 2 for the lower one."""
    digits = F.split(col(lineage), "")
    start = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))
    step = lambda a, d: F.struct((a["x"] * 2 + d.cast("int") % 2).alias("x"), (a["y"] * 2 + F.floor(d.cast("int") / 2).cast("int")).alias("y"))
    return F.aggregate(digits, start, step, lambda a: F.concat_ws("-", F.length(col(lineage)).cast("string"), a["x"].cast("string"), a["y"].cast("string")))


def tile_name(px: Column, zoom: int) -> Column:
    """zoom-x-y of the tile that holds a pixel; rows of tiles count from the top."""
    n = 1 << zoom
    tx = F.floor(px["x"] * n / px["res_x"]).cast("int")
    ty = F.floor(px["y"] * n / px["res_y"]).cast("int")
    return F.concat_ws("-", F.lit(zoom).cast("string"), tx.cast("string"), (n - 1 - ty).cast("string"))
