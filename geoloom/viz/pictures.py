"""Pipelines from geometries to pictures, as DataFrame plans.

Weights are gathered by pixel with map-side combining; filters spread each
pixel's weight to its neighbours and sum again.  Only rendering, at most one row
a pixel, draws - a task a tile, so no picture needs one machine to see the data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import native as N
from geoloom.functions.kernels import batched
from geoloom.operators.geometry import kind_of
from geoloom.viz.functions import ALPHA, STEPS, argb, draw, fill, pixels

Box = tuple[float, float, float, float]


def pixelize(df: DataFrame, res_x: int, res_y: int, box: Box, geom: str = "geom", filled: bool = False) -> DataFrame:
    """The rows with ``px`` and ``py``, one for each pixel of their geometry; y counts from below."""
    if kind_of(df, geom) == "point":
        px = N.pixel(df[geom], res_x, res_y, box)
        return df.withColumn("_p", px).where("_p is not null").withColumn("px", F.col("_p.x")).withColumn("py", F.col("_p.y")).drop("_p")
    f = fill if filled else pixels
    spots = batched(lambda g: [{"x": x, "y": y} for x, y in f(g, res_x, res_y, box)], "array<struct<x:int,y:int>>")
    return df.withColumn("_p", F.explode(spots(df[geom]))).withColumn("px", F.col("_p.x")).withColumn("py", F.col("_p.y")).drop("_p")


def weigh(spots: DataFrame, weight: str | None = None, how: str = "sum") -> DataFrame:
    """(px, py, weight): number of rows a pixel, or sum, average or count of a column."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    agg = {"sum": F.sum(w), "avg": F.avg(w), "count": F.count(w).cast("double")}[how]
    return spots.groupBy("px", "py").agg(agg.alias("weight"))


def gaussian(radius: int, sigma: float = 0.5) -> dict[tuple[int, int], float]:
    import math

    k = {(x, y): math.exp(-(x * x + y * y) / (2 * sigma * sigma)) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1)}
    total = sum(k.values())
    return {p: v / total for p, v in k.items()}


def box_blur(radius: int) -> dict[tuple[int, int], float]:
    n = (2 * radius + 1) ** 2
    return {(x, y): 1.0 / n for x in range(-radius, radius + 1) for y in range(-radius, radius + 1)}


def _three(rows: list[list[float]]) -> dict[tuple[int, int], float]:
    return {(x - 1, 1 - y): rows[y][x] for y in range(3) for x in range(3)}


# Three by three weights, the upper row first.
EMBOSS = _three([[-2, -1, 0], [-1, 1, 1], [0, 1, 2]])
OUTLINE = _three([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]])
SHARPEN = _three([[0, -1, 0], [-1, 5, -1], [0, -1, 0]])


def convolve(weights: DataFrame, kernel: dict[tuple[int, int], float], res_x: int, res_y: int) -> DataFrame:
    """Each pixel's weight spread to its neighbours by the kernel, and summed."""
    items = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in sorted(kernel.items()) if w]
    spread = weights.withColumn("_k", F.explode(F.array(*items))).select((F.col("px") + F.col("_k.dx")).alias("px"), (F.col("py") + F.col("_k.dy")).alias("py"), (F.col("weight") * F.col("_k.w")).alias("weight"))
    inside = F.col("px").between(0, res_x - 1) & F.col("py").between(0, res_y - 1)
    return spread.where(inside).groupBy("px", "py").agg(F.sum("weight").alias("weight"))


def colour(weight: Column, most: Column) -> Column:
    """Step colours as a native expression."""
    v = F.try_divide(weight * 255.0, most)
    out = F.lit(argb(*STEPS[-1][1], ALPHA))
    for top, rgb in reversed(STEPS[:-1]):
        out = F.when(v < top, argb(*rgb, ALPHA)).otherwise(out)
    return F.when(v.isNull() | (v == 0), argb(255, 255, 255, 0)).otherwise(out)


def linear_colour(weight: Column, most: Column, channel: str = "red", inverse: bool = False, alpha: int = ALPHA) -> Column:
    """The share of the largest weight as the strength of one channel (red, green or blue), or its opposite; clear where it is 0."""
    shift = {"red": 16, "green": 8, "blue": 0}[channel.lower()]
    v = F.coalesce(F.try_divide(F.least(weight, most) * 255.0, most), F.lit(0.0)).cast("int")
    value = F.lit(255) - v if inverse else v
    return (F.shiftleft(value.cast("long"), shift) + F.when(v == 0, F.lit(0)).otherwise(F.lit(alpha << 24)).cast("long")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def signed(color: Column) -> Column:
    """A 32-bit colour as the signed number that pictures hold."""
    return F.when(color >= 1 << 31, color - (1 << 32)).otherwise(color).cast("int")


def partition_by_tile(pixels: DataFrame, res_x: int, res_y: int, zoom: int, partitions: int | None = None) -> DataFrame:
    """(px, py) rows with the ``tile`` that holds them and its place on the quad-tree's path (``lineage``), dealt out by tile."""
    n = 1 << zoom
    tx, ty = F.floor(F.col("px") * n / res_x).cast("int"), F.floor(F.col("py") * n / res_y).cast("int")
    row = F.lit(n - 1) - ty  # rows of tiles count from the top
    digit = lambda k: (F.shiftright(tx, k).bitwiseAND(F.lit(1)) + 2 * F.shiftright(row, k).bitwiseAND(F.lit(1))).cast("string")
    lineage = F.concat(*(digit(k) for k in reversed(range(zoom)))) if zoom else F.lit("")
    out = pixels.withColumn("tile", F.concat_ws("-", F.lit(zoom).cast("string"), tx.cast("string"), row.cast("string"))).withColumn("lineage", lineage)
    return out.repartition(partitions or n * n, "tile")


def colorize(weights: DataFrame, most: float | None = None) -> DataFrame:
    """Adds ``color`` by the share of the largest weight (or of ``most``, which larger ones are cut to)."""
    if most is None:
        top = weights.agg(F.max("weight").alias("_most"))
        return weights.join(F.broadcast(top)).withColumn("color", colour(F.col("weight"), F.col("_most"))).drop("_most")  # one row
    return weights.withColumn("color", colour(F.least(F.col("weight"), F.lit(float(most))), F.lit(float(most))))


def render(colors: DataFrame, res_x: int, res_y: int, zoom: int = 0) -> DataFrame:
    """(tile, image): a PNG for each tile of 2^zoom by 2^zoom; tile names count rows from the top."""
    n = 1 << zoom
    width, height = res_x // n, res_y // n
    p = F.struct(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(res_x).alias("res_x"), F.lit(res_y).alias("res_y"))
    tiled = colors.select(N.tile_name(p, zoom).alias("tile"), "px", "py", "color")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, tx, ty = (int(v) for v in key[0].split("-"))
        spots = zip((pdf.px - tx * width).tolist(), (pdf.py - (n - 1 - ty) * height).tolist(), pdf.color.tolist(), strict=True)
        return pd.DataFrame({"tile": [key[0]], "image": [draw(width, height, spots)]})

    return tiled.groupBy("tile").applyInPandas(one, "tile string, image binary")


def scatter_plot(df: DataFrame, res_x: int, res_y: int, box: Box, geom: str = "geom", color: tuple[int, int, int] = (255, 0, 0), zoom: int = 0) -> DataFrame:
    spots = pixelize(df, res_x, res_y, box, geom).select("px", "py").distinct()
    return render(spots.withColumn("color", F.lit(argb(*color))), res_x, res_y, zoom)


def heat_map(df: DataFrame, res_x: int, res_y: int, box: Box, geom: str = "geom", radius: int = 1, zoom: int = 0) -> DataFrame:
    weights = weigh(pixelize(df, res_x, res_y, box, geom))
    blurred = convolve(weights, gaussian(radius), res_x, res_y) if radius else weights
    return render(colorize(blurred), res_x, res_y, zoom)


def choropleth(counts: DataFrame, res_x: int, res_y: int, box: Box, geom: str = "geom", count: str = "count", zoom: int = 0) -> DataFrame:
    """Filled polygons coloured by a count; where they overlap the counts add up."""
    return render(colorize(weigh(pixelize(counts, res_x, res_y, box, geom, filled=True), count)), res_x, res_y, zoom)


def overlay(below: bytes, above: bytes) -> bytes:
    """One PNG of this module blended over another of the same size."""
    import numpy as np

    from geoloom.functions.kernels import png

    a, b = decode(below).astype(float), decode(above).astype(float)
    alpha = b[..., 3:] / 255
    out_alpha = alpha + a[..., 3:] / 255 * (1 - alpha)
    rgb = np.where(out_alpha > 0, (b[..., :3] * alpha + a[..., :3] * a[..., 3:] / 255 * (1 - alpha)) / np.maximum(out_alpha, 1e-9), 0)
    out = np.concatenate([rgb, out_alpha * 255], 2).round().astype(np.uint8)
    return png(out.shape[1], out.shape[0], (r.tobytes() for r in out), True)


def stitch(tiles: dict[str, bytes]) -> bytes:
    """The whole picture from all tiles of a zoom level; missing ones stay clear."""
    import numpy as np

    from geoloom.functions.kernels import png

    zoom = int(next(iter(tiles)).split("-")[0])
    first = decode(next(iter(tiles.values())))
    h, w = first.shape[:2]
    n = 1 << zoom
    out = np.zeros((h * n, w * n, 4), dtype=np.uint8)
    for name, image in tiles.items():
        _, tx, ty = (int(v) for v in name.split("-"))
        out[ty * h : (ty + 1) * h, tx * w : (tx + 1) * w] = decode(image)
    return png(w * n, h * n, (r.tobytes() for r in out), True)


def decode(image: bytes):
    """RGBA array of a PNG that ``draw`` made (8 bits, no filter)."""
    import struct
    import zlib

    import numpy as np

    at, data = 8, b""
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind = image[at + 4 : at + 8]
        if kind == b"IHDR":
            w, h = struct.unpack_from(">II", image, at + 8)
            channels = {2: 3, 6: 4}[image[at + 17]]
        elif kind == b"IDAT":
            data += image[at + 8 : at + 8 + n]
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(h, 1 + w * channels)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    out = rows[:, 1:].reshape(h, w, channels)
    return out if channels == 4 else np.concatenate([out, np.full((h, w, 1), 255, dtype=np.uint8)], 2)


def save_images(images: DataFrame, path: str) -> None:
    """Writes (tile, image) rows as a Parquet table to any store Spark can write; one row a picture."""
    images.write.mode("overwrite").parquet(path)


def write_png(images: DataFrame, uri: str, suffix: str = "png") -> DataFrame:
    """Writes a file for each (tile, image) row below a folder, in the tasks; (tile, file) of what was written.

    The folder is a path or address that all executors share.
    """

    def run(batches):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
        store.create_dir(at, recursive=True)
        for b in batches:
            names = [f"{at}/{t}.{suffix}" for t in b["tile"]]
            for name, image in zip(names, b["image"], strict=True):
                with store.open_output_stream(name) as out:
                    out.write(bytes(image))
            yield pd.DataFrame({"tile": b["tile"], "file": names})

    from geoloom.plans.durable import stored

    return stored(images.select("tile", "image").mapInPandas(run, "tile string, file string"))


def to_svg(colors: DataFrame, res_x: int, res_y: int) -> DataFrame:
    """(line): an SVG picture as rows of text, a square a pixel, to be written with ``write.text``; the head comes first."""
    c = F.col("color").cast("long").bitwiseAND(F.lit(0xFFFFFF))
    square = F.format_string(f'<rect x="%d" y="%d" width="1" height="1" fill="#%06x"/>', F.col("px"), F.lit(res_y - 1) - F.col("py"), c)
    spots = colors.where(F.col("color").cast("long").bitwiseAND(F.lit(0xFF000000)) != 0).select(F.lit(1).alias("place"), square.alias("line"))
    spark = colors.sparkSession
    ends = spark.createDataFrame([(0, f'<svg xmlns="http://www.w3.org/2000/svg" width="{res_x}" height="{res_y}">'), (2, "</svg>")], "place int, line string")
    return ends.union(spots)


def overlay_svg(below: DataFrame, above: DataFrame) -> DataFrame:
    """One SVG's squares drawn over another's; (place, line) rows of both, the head and the end once."""
    return below.where("place < 2").union(above.where("place = 1").select((F.col("place")).alias("place"), "line")).union(below.where("place = 2"))
