"""GeoTIFF: a decoder for baseline files, behind Spark's binary reader.

Strips and tiles, chunky or planar, 8 to 64 bits, uncompressed, Deflate or
PackBits.  Bands are band-sequential in ``data``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from geoloom.functions.crs import reproject
from geoloom.kernel.geometry import POLYGON, Geom, to_wkt

SCHEMA = "image struct<origin:string,wkt:string,height:int,width:int,nBands:int,data:array<double>>"

# Tags of the format, sizes and struct letters of its types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_COUNTS, FORMAT, PIXEL_SCALE, TIEPOINT, GEO_KEYS = 322, 323, 324, 325, 339, 33550, 33922, 34735
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}


def _packbits(b: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(b):
        n = b[i]
        if n < 128:
            out += b[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += b[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def decode(data: bytes) -> dict:
    """height, width, bands, data (band after band) and footprint of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        size, letter = TYPES[kind]
        where = at + 10 + 12 * k
        if size * count > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        tags[tag] = (data[where : where + count],) if letter == "s" else struct.unpack_from(f"{order}{count * len(letter)}{letter[0]}", data, where)
    w, h, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, form = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
    kind = np.dtype(f"{order}{'uif'[form - 1]}{bits // 8}")
    how, planar = tags.get(COMPRESSION, (1,))[0], tags.get(PLANAR, (1,))[0] == 2
    if tags.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError("predictors are not read")

    def block(offset: int, size: int) -> np.ndarray:
        raw = data[offset : offset + size]
        if how in (8, 32946):
            raw = zlib.decompress(raw)
        elif how == 32773:
            raw = _packbits(raw)
        elif how != 1:
            raise ValueError(f"compression {how} is not read")
        return np.frombuffer(raw, dtype=kind)

    out = np.zeros((bands, h, w))
    if TILES in tags:
        tw, th = tags[TILE_W][0], tags[TILE_H][0]
        offsets, counts = tags[TILES], tags[TILE_COUNTS]
    else:
        tw, th = w, min(h, tags.get(ROWS, (h,))[0])
        offsets, counts = tags[STRIPS], tags[COUNTS]
    across, down = -(-w // tw), -(-h // th)
    for i, (o, c) in enumerate(zip(offsets, counts, strict=True)):
        band, place = divmod(i, across * down) if planar else (0, i)
        ty, tx = divmod(place, across)
        rows, cols = min(th, h - ty * th), min(tw, w - tx * tw)
        part = block(o, c)
        if planar:
            part = part[: len(part) // tw * tw].reshape(-1, tw)[:rows, :cols]
            out[band, ty * th : ty * th + rows, tx * tw : tx * tw + cols] = part
        else:
            part = part[: len(part) // (tw * bands) * tw * bands].reshape(-1, tw, bands)[:rows, :cols]
            out[:, ty * th : ty * th + rows, tx * tw : tx * tw + cols] = np.moveaxis(part, 2, 0)
    return {"height": h, "width": w, "bands": bands, "data": out.ravel(), "wkt": _footprint(tags, w, h)}


def _footprint(tags: dict[int, tuple], w: int, h: int) -> str | None:
    """Outline of the image in longitude and latitude; None if the file does not say where it lies."""
    if PIXEL_SCALE not in tags or TIEPOINT not in tags:
        return None
    sx, sy = tags[PIXEL_SCALE][:2]
    i, j, _, x, y, _ = tags[TIEPOINT][:6]
    x0, y1 = x - i * sx, y + j * sy
    x1, y0 = x0 + w * sx, y1 - h * sy
    g = Geom(POLYGON, [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]])
    keys = tags.get(GEO_KEYS, ())
    code = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in (2048, 3072)), 4326)
    if code != 4326:
        try:
            g = reproject(g, f"epsg:{code}", "epsg:4326")
        except ValueError:
            return None
    return to_wkt(g)


def read_geotiff(spark: SparkSession, path: str, drop_invalid: bool = False, glob: str = "*") -> DataFrame:
    """One row (image struct) a file; files that cannot be read raise, or go with ``drop_invalid``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    d = decode(bytes(content))
                except (ValueError, KeyError, struct.error, zlib.error):
                    if not drop_invalid:
                        raise
                    continue
                rows.append({"origin": origin, "wkt": d["wkt"], "height": d["height"], "width": d["width"], "nBands": d["bands"], "data": d["data"]})
            yield pd.DataFrame({"origin": [r["origin"] for r in rows], "wkt": [r["wkt"] for r in rows], "height": [r["height"] for r in rows], "width": [r["width"] for r in rows], "nBands": [r["nBands"] for r in rows], "data": [r["data"] for r in rows]})

    flat = files.mapInPandas(run, "origin string, wkt string, height int, width int, nBands int, data array<double>")
    return flat.selectExpr("struct(origin, wkt, height, width, nBands, data) AS image")


def register_format(spark: SparkSession) -> None:
    """Makes ``spark.read.format("geotiff").load(path)`` read pictures, a task a file."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            from pyarrow import fs

            path = self.options["path"]
            store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            found = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.extension.lower() in ("tif", "tiff")] if store.get_file_info(at).type == fs.FileType.Directory else [at]
            return [InputPartition(f) for f in sorted(found)]

        def read(self, partition):
            from pyarrow import fs

            path = self.options["path"]
            store = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
            with store.open_input_stream(partition.value) as f:
                d = decode(f.readall())
            yield ((partition.value, d["wkt"], d["height"], d["width"], d["bands"], [float(v) for v in d["data"]]),)

    class GeoTiff(DataSource):
        @classmethod
        def name(cls):
            return "geotiff"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(GeoTiff)
