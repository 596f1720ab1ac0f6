"""Delimited text, WKT, WKB and GeoJSON: readers that give a WKB column ``geom``, and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.kernels import FUNCTIONS, batched
from geoloom.kernel.geometry import LINE, POLYGON, Geom, from_geojson, from_wkb, from_wkt, parts, to_wkb

# Names of delimiters.
SPLITTERS = {"CSV": ",", "TSV": "\t", "GEOJSON": "", "WKT": "\t", "WKB": "\t", "COMMA": ",", "TAB": "\t", "QUESTIONMARK": "?", "SINGLEQUOTE": "'", "QUOTE": '"', "UNDERSCORE": "_", "DASH": "-", "PERCENT": "%", "TILDE": "~", "PIPE": "|", "SEMICOLON": ";"}


def splitter(name: str) -> str:
    """A delimiter by its name, or itself."""
    return SPLITTERS.get(name.upper(), name)


def _lines(spark: SparkSession, path: str, partitions: int | None) -> DataFrame:
    df = spark.read.text(path)
    return df.repartition(partitions) if partitions else df


def _fields(sep: str) -> Column:
    quoted = "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in sep)
    return F.split("value", quoted, -1)


def read_points(spark: SparkSession, path: str, sep: str = "CSV", offset: int = 0, attributes: bool = False, partitions: int | None = None) -> DataFrame:
    """Points as native structs: x and y at ``offset`` and the field after it; with ``attributes`` the other fields as an array."""
    f = _fields(splitter(sep))
    x, y = F.get(f, F.lit(offset)).cast("double"), F.get(f, F.lit(offset + 1)).cast("double")
    df = _lines(spark, path, partitions).where(F.length(F.trim("value")) > 0)
    cols = [F.struct(x.alias("x"), y.alias("y")).alias("geom")]
    if attributes:
        cols.append(F.filter(f, lambda v, i: (i < offset) | (i > offset + 1)).alias("attributes"))
    return df.select(*cols)


def read_rectangles(spark: SparkSession, path: str, sep: str = "CSV", offset: int = 0, attributes: bool = False, partitions: int | None = None) -> DataFrame:
    """Rectangles as native structs, from two diagonal corners."""
    f = _fields(splitter(sep))
    v = [F.get(f, F.lit(offset + k)).cast("double") for k in range(4)]
    box = F.struct(F.least(v[0], v[2]).alias("xmin"), F.least(v[1], v[3]).alias("ymin"), F.greatest(v[0], v[2]).alias("xmax"), F.greatest(v[1], v[3]).alias("ymax"))
    cols = [box.alias("geom")]
    if attributes:
        cols.append(F.filter(f, lambda _, i: (i < offset) | (i > offset + 3)).alias("attributes"))
    return _lines(spark, path, partitions).where(F.length(F.trim("value")) > 0).select(*cols)


def read_shapes(spark: SparkSession, path: str, kind: str, sep: str = "CSV", start: int = 0, end: int | None = None, attributes: bool = False, partitions: int | None = None) -> DataFrame:
    """Lines or polygons (``kind``: linestring, polygon) from a flat list of x and y in the fields from ``start`` to before ``end``."""
    f = _fields(splitter(sep))
    last = F.size(f) if end is None else F.lit(end)
    own = F.slice(f, F.lit(start + 1), last - start)
    make = lambda v: _flat(list(v), kind)
    cols = [batched(make, "binary")(own).alias("geom")]
    if attributes:
        cols.append(F.filter(f, lambda _, i: (i < start) | (i >= last)).alias("attributes"))
    return _lines(spark, path, partitions).where(F.length(F.trim("value")) > 0).select(*cols)


def _flat(values: list[str], kind: str) -> Geom:
    v = [float(x) for x in values]
    points = list(zip(v[::2], v[1::2], strict=True))
    if kind.lower() == "linestring":
        return Geom(LINE, points)
    return Geom(POLYGON, [points if points[0] == points[-1] else [*points, points[0]]])


def _parsed(df: DataFrame, text: Column, parse: Callable, allow_invalid: bool, skip_errors: bool, flatten: bool) -> DataFrame:
    """The frame with ``geom``; with ``skip_errors`` rows that cannot be read go, otherwise they raise."""

    def one(s):
        try:
            g = parse(s)
        except (ValueError, KeyError, TypeError, IndexError, AttributeError):
            if not skip_errors:
                raise
            return None
        return parts(g) if flatten else [g]

    out = df.withColumn("geom", F.explode(batched(one, "array<binary>")(text)))
    if not allow_invalid:
        out = out.where(batched(FUNCTIONS["ST_IsValid"][1], "boolean")(F.col("geom")))
    return out


def read_wkt(spark: SparkSession, path: str, column: int = 0, sep: str = "TAB", allow_invalid: bool = True, skip_errors: bool = False, flatten: bool = False, partitions: int | None = None) -> DataFrame:
    """(geom, attributes) of delimited lines whose field ``column`` is WKT; ``flatten`` gives a row for each part of a multi-geometry."""
    f = _fields(splitter(sep))
    df = _lines(spark, path, partitions).where(F.length(F.trim("value")) > 0).select(F.get(f, F.lit(column)).alias("_t"), F.filter(f, lambda _, i: i != column).alias("attributes"))
    return _parsed(df, F.col("_t"), from_wkt, allow_invalid, skip_errors, flatten).select("geom", "attributes")


def read_wkb(spark: SparkSession, path: str, column: int = 0, sep: str = "TAB", allow_invalid: bool = True, skip_errors: bool = False, flatten: bool = False, partitions: int | None = None) -> DataFrame:
    """The same with hexadecimal WKB."""
    f = _fields(splitter(sep))
    df = _lines(spark, path, partitions).where(F.length(F.trim("value")) > 0).select(F.get(f, F.lit(column)).alias("_t"), F.filter(f, lambda _, i: i != column).alias("attributes"))
    return _parsed(df, F.col("_t"), lambda s: from_wkb(bytes.fromhex(s)), allow_invalid, skip_errors, flatten).select("geom", "attributes")


def read_geojson(spark: SparkSession, path: str, allow_invalid: bool = True, skip_errors: bool = False, flatten: bool = False, partitions: int | None = None) -> DataFrame:
    """(geom, id, properties map) of one Feature or geometry a line; null property values become "null"."""
    df = _lines(spark, path, partitions).where(F.length(F.trim("value")) > 0)

    kind = F.get_json_object("value", "$.type") == "Feature"
    id_ = F.when(kind, F.get_json_object("value", "$.id"))
    own = F.from_json(F.get_json_object("value", "$.properties"), "map<string,string>")
    properties = F.when(kind, F.transform_values(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v, F.lit("null")))).otherwise(F.create_map().cast("map<string,string>"))
    out = _parsed(df.select("value", id_.alias("id"), properties.alias("properties")), F.col("value"), from_geojson, allow_invalid, skip_errors, flatten)
    return out.select("geom", "id", "properties")


def read_mapped(spark: SparkSession, path: str, mapper: Callable[[str], list[Geom]], partitions: int | None = None) -> DataFrame:
    """Geometries that a function makes of each line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"geom": [to_wkb(g) for line in b["value"] for g in mapper(line)]})

    return _lines(spark, path, partitions).mapInPandas(run, "geom binary")


def read_hdf(*_args, **_kwargs):
    raise NotImplementedError("HDF needs a library that is not available here")


# --- writers -------------------------------------------------------------------


def _attributes(df: DataFrame, geom: str) -> list[Column]:
    return [F.coalesce(df[c].cast("string"), F.lit("null")) for c in df.columns if c != geom]


def write_wkt(df: DataFrame, path: str, geom: str = "geom") -> None:
    """Lines of WKT and, tab-separated, the other columns."""
    text = batched(FUNCTIONS["ST_AsText"][1], "string")(df[geom])
    df.select(F.concat_ws("\t", text, *_attributes(df, geom)).alias("value")).write.text(path)


def write_wkb(df: DataFrame, path: str, geom: str = "geom") -> None:
    """The same with hexadecimal WKB; no Python."""
    df.select(F.concat_ws("\t", F.hex(df[geom]), *_attributes(df, geom)).alias("value")).write.text(path)


def write_geojson(df: DataFrame, path: str, geom: str = "geom") -> None:
    """Lines of Features whose properties are the other columns."""
    text = batched(FUNCTIONS["ST_AsGeoJSON"][1], "string")(df[geom])
    others = [c for c in df.columns if c != geom]
    props = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    line = F.concat(F.lit('{"type":"Feature","geometry":'), text, F.lit(',"properties":'), props, F.lit("}"))
    df.select(line.alias("value")).write.text(path)


