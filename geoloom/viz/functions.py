"""Drawing functions of plain values; registered with the other SQL functions."""

from __future__ import annotations

import base64

from geoloom.kernel.geometry import LINE, POINT, Geom, bbox, leaves

# Upper bounds of a weight scaled to 255, and the colour (red, green, blue) below each.
STEPS = [(5, (0, 255, 0)), (15, (85, 255, 0)), (25, (170, 255, 0)), (35, (255, 255, 0)), (45, (255, 255, 0)), (60, (255, 170, 0)), (80, (255, 85, 0)), (float("inf"), (255, 0, 0))]
# Fixed value: opacity of these colours. A weight of 0 is transparent white.
ALPHA = 150
#: Named colours.
COLORS = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "lime": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "orange": (255, 165, 0), "gray": (128, 128, 128), "grey": (128, 128, 128),
    "purple": (128, 0, 128), "pink": (255, 192, 203), "brown": (165, 42, 42), "cyan": (0, 255, 255), "magenta": (255, 0, 255), "navy": (0, 0, 128), "teal": (0, 128, 128), "maroon": (128, 0, 0), "olive": (128, 128, 0), "silver": (192, 192, 192),
}
PIXEL = "struct<x:int,y:int,res_x:int,res_y:int>"

FUNCTIONS: dict = {}


def argb(r: int, g: int, b: int, a: int = 255) -> int:
    """The signed 32-bit number of a colour."""
    v = (a << 24) | (r << 16) | (g << 8) | b
    return v - (1 << 32) if v >> 31 else v


def colour(weight: float, most: float) -> int:
    """The step colour of a weight, given the largest one."""
    v = weight * 255.0 / most if most else 0.0
    if v == 0:
        return argb(255, 255, 255, 0)
    return argb(*next(rgb for top, rgb in STEPS if v < top), ALPHA)


def st_colorize(weight, most, name=None):
    if name is None:
        return colour(float(weight), float(most))
    name = str(name).lower()
    if name.startswith("#"):
        v = int(name[1:], 16)
        return argb(v >> 16 & 255, v >> 8 & 255, v & 255)
    return argb(*COLORS[name])


def to_pixel(x: float, y: float, res_x: int, res_y: int, box) -> tuple[int, int]:
    """Pixel of a coordinate; the right and upper edges belong to the last pixels. Outside the box it lies outside the picture."""
    x0, y0, x1, y1 = box

    def one(v, lo, hi, res):
        at = int((v - lo) / (hi - lo) * res // 1) if hi > lo else 0
        return res - 1 if v == hi else at

    return one(x, x0, x1, res_x), one(y, y0, y1, res_y)


def line_pixels(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
    """Bresenham's pixels from a up to, without, b (a itself where both are one)."""
    (x, y), (tx, ty) = a, b
    dx, dy = abs(tx - x), -abs(ty - y)
    sx, sy = (1 if tx > x else -1), (1 if ty > y else -1)
    err, out = dx + dy, []
    while (x, y) != (tx, ty):
        out.append((x, y))
        e = 2 * err
        if e >= dy:
            err, x = err + dy, x + sx
        if e <= dx:
            err, y = err + dx, y + sy
    return out or [a]


def pixels(g: Geom, res_x: int, res_y: int, box) -> list[tuple[int, int]]:
    """Pixels of points, of lines, and of the outlines of polygons, that lie in the picture; each once, in order."""
    out: dict[tuple[int, int], None] = {}
    for part in leaves(g):
        if part.kind == POINT:
            out[to_pixel(*part.data, res_x, res_y, box)] = None
            continue
        for line in [part.data] if part.kind == LINE else part.data:
            spots = [to_pixel(*p, res_x, res_y, box) for p in line]
            for a, b in zip(spots, spots[1:], strict=False):
                out.update(dict.fromkeys(line_pixels(a, b)))
    return [p for p in out if 0 <= p[0] < res_x and 0 <= p[1] < res_y]


def fill(g: Geom, res_x: int, res_y: int, box) -> list[tuple[int, int]]:
    """Pixels whose centre lies in the geometry's polygons."""
    from geoloom.kernel.measure import in_polygon

    x0, y0, x1, y1 = box
    out: dict[tuple[int, int], None] = {}
    for part in leaves(g):
        if part.kind in (POINT, LINE):
            continue
        b = bbox(part)
        (ax, ay), (bx, by) = to_pixel(b[0], b[1], res_x, res_y, box), to_pixel(b[2], b[3], res_x, res_y, box)
        for py in range(max(ay, 0), min(by, res_y - 1) + 1):
            for px in range(max(ax, 0), min(bx, res_x - 1) + 1):
                c = (x0 + (px + 0.5) / res_x * (x1 - x0), y0 + (py + 0.5) / res_y * (y1 - y0))
                if in_polygon(c, part.data) >= 0:
                    out[px, py] = None
    return list(out)


def st_pixelize(g, res_x, res_y, boundary):
    box = bbox(boundary)
    return [{"x": x, "y": y, "res_x": int(res_x), "res_y": int(res_y)} for x, y in pixels(g, int(res_x), int(res_y), box)]


def st_tilename(px, zoom):
    n = 1 << int(zoom)
    return f"{int(zoom)}-{px['x'] * n // px['res_x']}-{n - 1 - px['y'] * n // px['res_y']}"


def draw(width: int, height: int, spots) -> bytes:
    """PNG of (x, y, argb) spots; y counts from below, later spots lie on top."""
    import numpy as np

    from geoloom.functions.kernels import png

    image = np.zeros((height, width, 4), dtype=np.uint8)
    for x, y, c in spots:
        if 0 <= x < width and 0 <= y < height:
            c &= 0xFFFFFFFF
            image[height - 1 - y, x] = (c >> 16 & 255, c >> 8 & 255, c & 255, c >> 24)
    return png(width, height, (r.tobytes() for r in image), True)


FUNCTIONS["ST_Colorize"] = ("int", st_colorize)
FUNCTIONS["ST_Pixelize"] = (f"array<{PIXEL}>", st_pixelize)
FUNCTIONS["ST_TileName"] = ("string", st_tilename)
FUNCTIONS["ST_EncodeImage"] = ("string", lambda image: base64.b64encode(bytes(image)).decode())
