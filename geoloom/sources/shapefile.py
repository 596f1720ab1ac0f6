"""Shapefiles: .shp with its .dbf, grouped by base name; a task reads one whole set.

Files come through Spark's binary reader, so any store that Spark reads will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.kernel.geometry import LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geom, to_wkb
from geoloom.kernel.measure import in_ring, signed_area

# Codes of shapes.
NULL_SHAPE, SHAPE_POINT, SHAPE_LINE, SHAPE_POLYGON, SHAPE_MULTIPOINT = 0, 1, 3, 5, 8
# Size and magic number of the header.
HEADER, MAGIC = 100, 9994


def _shape(b: memoryview) -> Geom | None:
    (code,) = struct.unpack_from("<i", b, 0)
    if code == NULL_SHAPE:
        return None
    if code == SHAPE_POINT:
        return Geom(POINT, struct.unpack_from("<2d", b, 4))
    if code == SHAPE_MULTIPOINT:
        (n,) = struct.unpack_from("<i", b, 36)
        flat = struct.unpack_from(f"<{2 * n}d", b, 40)
        return Geom(MULTIPOINT, list(zip(flat[::2], flat[1::2], strict=True)))
    if code not in (SHAPE_LINE, SHAPE_POLYGON):
        raise ValueError(f"unknown shape {code}")
    n, m = struct.unpack_from("<2i", b, 36)
    starts = [*struct.unpack_from(f"<{n}i", b, 44), m]
    flat = struct.unpack_from(f"<{2 * m}d", b, 44 + 4 * n)
    points = list(zip(flat[::2], flat[1::2], strict=True))
    rings = [points[i:j] for i, j in zip(starts, starts[1:], strict=False)]
    if code == SHAPE_LINE:
        return Geom(LINE, rings[0]) if n == 1 else Geom(MULTILINE, rings)
    rings = [r for r in rings if len(r) > 3]
    if not rings:
        return Geom(POLYGON, [])
    way = signed_area(rings[0]) > 0  # the first ring says how shells run
    shells = [[r] for r in rings if (signed_area(r) > 0) == way]
    for r in rings:
        if (signed_area(r) > 0) != way:
            own = next((s for s in shells if all(in_ring(p, s[0]) >= 0 for p in r)), shells[-1])
            own.append(r)
    return Geom(POLYGON, shells[0]) if len(shells) == 1 else Geom(MULTIPOLYGON, shells)


def parse_shp(data: bytes) -> list[Geom | None]:
    if struct.unpack_from(">i", data, 0)[0] != MAGIC:
        raise ValueError("not a shapefile")
    out, at, b = [], HEADER, memoryview(data)
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        out.append(_shape(b[at + 8 : at + 8 + 2 * words]))
        at += 8 + 2 * words
    return out


def header_box(data: bytes) -> tuple[float, ...]:
    """xmin, ymin, xmax, ymax, zmin, zmax, mmin, mmax of a header."""
    return struct.unpack_from("<8d", data, 36)


def dbf_fields(data: bytes) -> list[tuple[str, str, int]]:
    """(name, type letter, width) of the columns."""
    (size,) = struct.unpack_from("<H", data, 8)
    out = []
    for at in range(32, size - 1, 32):
        if data[at] == 0x0D:
            break
        out.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace").strip(), chr(data[at + 11]), data[at + 16]))
    return out


def parse_dbf(data: bytes, encoding: str = "latin-1") -> tuple[list[str], list[list[str] | None]]:
    """Names, and trimmed text of each record; None for a deleted one."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields = dbf_fields(data)
    rows: list[list[str] | None] = []
    for k in range(n):
        at = head + k * size
        if at >= len(data):
            break
        if data[at : at + 1] == b"*":
            rows.append(None)
            continue
        row, pos = [], at + 1
        for _, _, width in fields:
            row.append(data[pos : pos + width].decode(encoding, "replace").strip())
            pos += width
        rows.append(row)
    return [f[0] for f in fields], rows


def _sets(spark: SparkSession, path: str, suffixes: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{suffixes}}}").load(path)
    return files.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("base"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), "content")


def read_shapefile(spark: SparkSession, path: str, encoding: str = "latin-1") -> DataFrame:
    """(geom, attributes map) of all shapefiles below a path; deleted records are left out."""
    sets = _sets(spark, path, "shp,SHP,dbf,DBF").groupBy("base").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shp, dbf in zip(batch["shp"], batch["dbf"], strict=True):
                if shp is None:
                    continue
                shapes = parse_shp(bytes(shp))
                names, rows = parse_dbf(bytes(dbf), encoding) if dbf is not None else ([], [[]] * len(shapes))
                keep = [(g, r) for g, r in zip(shapes, rows, strict=False) if r is not None]
                yield pd.DataFrame({"geom": [None if g is None else to_wkb(g) for g, _ in keep], "attributes": [dict(zip(names, r, strict=False)) for _, r in keep]})

    return sets.mapInPandas(run, "geom binary, attributes map<string,string>")


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """One row: the union of the headers' boxes; only headers are used."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def head(c: pd.Series) -> pd.Series:
        return pd.Series([np.array(header_box(bytes(x)[:HEADER])) for x in c])

    b = _sets(spark, path, "shp,SHP").select(head(F.substring("content", 1, HEADER)).alias("b"))
    return b.agg(F.min(F.col("b")[0]).alias("xmin"), F.min(F.col("b")[1]).alias("ymin"), F.max(F.col("b")[2]).alias("xmax"), F.max(F.col("b")[3]).alias("ymax"))


def read_field_names(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first table below a path."""
    first = _sets(spark, path, "dbf,DBF").orderBy("base").limit(1).collect()
    return [f[0] for f in dbf_fields(bytes(first[0].content))] if first else []
