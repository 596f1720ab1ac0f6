"""Registered queries of SQL joins, sources and sinks, kernel functions, partitioning, streams and pictures."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.frame import JoinParams, SpatialFrame
from geoloom.functions import native as N
from geoloom.functions.kernels import batched
from geoloom.functions.register import register
from geoloom.operators import joins as J
from geoloom.operators import partitioning as P
from geoloom.operators.geometry import wkb_box
from geoloom.plans import derived as D
from geoloom.plans.durable import folder, put
from geoloom.plans.queries import _IN, C, IT, NA, PA, S, WORLD, _r, _wkb_rects, query, st
from geoloom.plans.sql import spatial_sql
from geoloom.sources import geotiff, shapefile
from geoloom.sources import text as X
from geoloom.streaming import geofence as G
from geoloom.viz import functions as VF
from geoloom.viz import pictures as V


def _views(s: SparkSession, d: str) -> None:
    register(s)
    D.customers(s, d).select("c_custkey", "c_nationkey", "c_acctbal", "geom.x", "geom.y").createOrReplaceTempView("geo_customers")
    D.suppliers(s, d).select("s_suppkey", "r", "geom.x", "geom.y").createOrReplaceTempView("geo_suppliers")
    D.parts(s, d).select("p_partkey", F.col("geom.xmin").alias("x0"), F.col("geom.ymin").alias("y0"), F.col("geom.xmax").alias("x1"), F.col("geom.ymax").alias("y1")).createOrReplaceTempView("geo_parts")
    D.nations(s, d).select("n_nationkey", F.col("geom.xmin").alias("x0"), F.col("geom.ymin").alias("y0"), F.col("geom.xmax").alias("x1"), F.col("geom.ymax").alias("y1")).createOrReplaceTempView("geo_nations")


_RECTS = "(SELECT *, ST_PolygonFromEnvelope(x0, y0, x1, y1) AS g FROM geo_parts)"
_POINTS = "(SELECT *, ST_Point(x, y) AS g FROM geo_customers)"


# --- joins written in SQL --------------------------------------------------------------


@query("sql_range_join", f"SELECT p_partkey, c_custkey FROM {PA} a JOIN {C} p ON {_IN}")
def sql_range_join(s, d):
    _views(s, d)
    return spatial_sql(s, f"SELECT p_partkey, c_custkey FROM {_RECTS} a JOIN {_POINTS} p ON ST_Contains(a.g, p.g)")


@query("sql_range_join_where", f"SELECT p_partkey, c_custkey FROM {PA} a JOIN {C} p ON {_IN}")
def sql_range_join_where(s, d):
    _views(s, d)
    return spatial_sql(s, f"SELECT p_partkey, c_custkey FROM {_RECTS} a, {_POINTS} p WHERE ST_Within(p.g, a.g)")


@query("sql_intersects_join", f"SELECT n_nationkey, p_partkey FROM {NA} a JOIN {PA} b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def sql_intersects_join(s, d):
    _views(s, d)
    return spatial_sql(s, f"SELECT n_nationkey, p_partkey FROM geo_nations n JOIN {_RECTS} p ON ST_Intersects(ST_PolygonFromEnvelope(n.x0, n.y0, n.x1, n.y1), p.g)")


@query("sql_join_extra_condition", f"SELECT p_partkey, c_custkey FROM {PA} a JOIN {C} p ON {_IN} AND p.c_acctbal > 0 AND a.p_partkey % 3 = p.c_custkey % 3")
def sql_join_extra_condition(s, d):
    _views(s, d)
    return spatial_sql(s, f"SELECT p_partkey, c_custkey FROM {_RECTS} a JOIN {_POINTS} p ON ST_Contains(a.g, p.g) AND p.c_acctbal > 0 AND a.p_partkey % 3 = p.c_custkey % 3")


_DISTANCE = "sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y))"


@query("sql_distance_join", f"SELECT c_custkey, s_suppkey FROM {C} c JOIN {S} s ON {_DISTANCE} <= 10")
def sql_distance_join(s, d):
    _views(s, d)
    return spatial_sql(s, "SELECT c_custkey, s_suppkey FROM geo_customers c JOIN geo_suppliers s ON ST_Distance(ST_Point(c.x, c.y), ST_Point(s.x, s.y)) <= 10")


@query("sql_distance_join_row_radius", f"SELECT c_custkey, s_suppkey FROM {C} c JOIN {S} s ON {_DISTANCE} < s.r")
def sql_distance_join_row_radius(s, d):
    _views(s, d)
    return spatial_sql(s, "SELECT c_custkey, s_suppkey FROM geo_customers c JOIN geo_suppliers s ON s.r > ST_Distance(ST_Point(c.x, c.y), ST_Point(s.x, s.y))")


@query("sql_left_join", f"SELECT c_custkey, n_nationkey FROM {C} p LEFT JOIN {NA} a ON {_IN} AND p.c_nationkey = a.n_nationkey")
def sql_left_join(s, d):
    _views(s, d)
    return spatial_sql(s, "SELECT c_custkey, n_nationkey FROM geo_customers p LEFT JOIN geo_nations a ON ST_Contains(ST_PolygonFromEnvelope(a.x0, a.y0, a.x1, a.y1), ST_Point(p.x, p.y)) AND p.c_nationkey = a.n_nationkey")


@query("sql_semi_join", f"SELECT c_custkey FROM {C} p WHERE EXISTS (SELECT 1 FROM {PA} a WHERE {_IN})")
def sql_semi_join(s, d):
    _views(s, d)
    return spatial_sql(s, f"SELECT c_custkey FROM {_POINTS} p LEFT SEMI JOIN {_RECTS} a ON ST_Contains(a.g, p.g)")


@query("sql_anti_join", f"SELECT c_custkey FROM {C} p WHERE NOT EXISTS (SELECT 1 FROM {PA} a WHERE {_IN})")
def sql_anti_join(s, d):
    _views(s, d)
    return spatial_sql(s, f"SELECT c_custkey FROM {_POINTS} p LEFT ANTI JOIN {_RECTS} a ON ST_Contains(a.g, p.g)")


@query("sql_join_fallback", f"SELECT n_nationkey, count(*) AS n FROM {NA} a JOIN {C} p ON ({_IN}) OR p.c_custkey % 100 = a.n_nationkey GROUP BY n_nationkey")
def sql_join_fallback(s, d):
    """A predicate under OR is no cell join: it runs as Spark plans it."""
    _views(s, d)
    return spatial_sql(s, "SELECT n_nationkey, count(*) AS n FROM geo_nations a JOIN geo_customers p ON ST_Contains(ST_PolygonFromEnvelope(a.x0, a.y0, a.x1, a.y1), ST_Point(p.x, p.y)) OR p.c_custkey % 100 = a.n_nationkey GROUP BY n_nationkey")


@query("sql_scalar_subquery", f"SELECT c_custkey FROM {C} WHERE y > (SELECT avg(y) FROM {S}) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def sql_scalar_subquery(s, d):
    _views(s, d)
    D.table(s, d, "nation").createOrReplaceTempView("geo_nation_names")
    return s.sql("SELECT c_custkey FROM geo_customers WHERE y > (SELECT avg(y) FROM geo_suppliers) AND c_nationkey IN (SELECT n_nationkey FROM geo_nation_names WHERE n_regionkey = 1)")


@query("spatial_full_join", f"SELECT c_custkey, p_partkey FROM {C} p FULL JOIN {PA} a ON {_IN}")
def spatial_full_join(s, d):
    return J.spatial_join(D.customers(s, d), D.parts(s, d), "within", how="full").select("c_custkey", "p_partkey")


# --- sources and sinks: written to the shared folder and read again ------------------------


def _written(s: SparkSession, lines: DataFrame) -> str:
    at = folder(s)
    lines.write.text(at)
    return at


@query("source_point_csv", f"SELECT CAST(c_custkey AS VARCHAR) AS id, x, y FROM {C}")
def source_point_csv(s, d):
    at = _written(s, D.customers(s, d).select(F.concat_ws(",", "c_custkey", "geom.x", "geom.y", F.lit("more"))))
    return X.read_points(s, at, "CSV", offset=1, attributes=True).select(F.col("attributes")[0].alias("id"), "geom.x", "geom.y")


@query("source_rectangle_tsv", f"SELECT CAST(p_partkey AS VARCHAR) AS id, x0, y0, x1, y1 FROM {PA}")
def source_rectangle_tsv(s, d):
    b = F.col("geom")  # the corners in the wrong order: read_rectangles sorts them
    at = _written(s, D.parts(s, d).select(F.concat_ws("\t", b["xmax"], b["ymin"], b["xmin"], b["ymax"], F.col("p_partkey"))))
    return X.read_rectangles(s, at, "TSV", attributes=True).select(F.col("attributes")[0].alias("id"), F.col("geom.xmin").alias("x0"), F.col("geom.ymin").alias("y0"), F.col("geom.xmax").alias("x1"), F.col("geom.ymax").alias("y1"))


def _corners() -> Column:
    x, y, r = F.col("geom.x"), F.col("geom.y"), F.col("r")
    return F.concat_ws("|", x, y, x + r, y, x + r, y + 2 * r, F.col("s_suppkey"))


@query("source_polygon_pipe", f"SELECT CAST(s_suppkey AS VARCHAR) AS id, round(r * r, 6) AS area, 4 AS corners FROM {S}")
def source_polygon_pipe(s, d):
    t = X.read_shapes(s, _written(s, D.suppliers(s, d).select(_corners())), "polygon", "PIPE", 0, 6, attributes=True)
    return t.select(F.col("attributes")[0].alias("id"), _r(st("ST_Area", F.col("geom"))).alias("area"), st("ST_NPoints", F.col("geom")).alias("corners"))


@query("source_linestring_pipe", f"SELECT CAST(s_suppkey AS VARCHAR) AS id, round(3 * r, 6) AS length FROM {S}")
def source_linestring_pipe(s, d):
    t = X.read_shapes(s, _written(s, D.suppliers(s, d).select(_corners())), "linestring", "PIPE", 0, 6, attributes=True)
    return t.select(F.col("attributes")[0].alias("id"), _r(st("ST_Length", F.col("geom"))).alias("length"))


def _box_of(df: DataFrame, *more: Column) -> DataFrame:
    b = df.select(*more, wkb_box(F.col("geom")).alias("b"))
    return b.select(*(c for c in b.columns if c != "b"), *(_r(F.col(f"b.{f}")).alias(f) for f in ("xmin", "ymin", "xmax", "ymax")))


_BOXES = "round(x0, 6) AS xmin, round(y0, 6) AS ymin, round(x1, 6) AS xmax, round(y1, 6) AS ymax"


@query("sink_source_wkt", f"SELECT CAST(p_partkey AS VARCHAR) AS id, {_BOXES} FROM {PA}")
def sink_source_wkt(s, d):
    at = folder(s)
    X.write_wkt(_wkb_rects(D.parts(s, d)).select("p_partkey", "geom"), at)
    return _box_of(X.read_wkt(s, at), F.col("attributes")[0].alias("id"))


@query("sink_source_wkb", f"SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS VARCHAR) AS size, {_BOXES} FROM {PA}")
def sink_source_wkb(s, d):
    at = folder(s)
    X.write_wkb(_wkb_rects(D.parts(s, d)).select("p_partkey", "p_size", "geom"), at)
    return _box_of(X.read_wkb(s, at), F.col("attributes")[0].alias("id"), F.col("attributes")[1].alias("size"))


@query("sink_source_geojson", f"SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'null' END AS size, {_BOXES} FROM {PA}")
def sink_source_geojson(s, d):
    at = folder(s)
    z = F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size")
    X.write_geojson(_wkb_rects(D.parts(s, d)).select("p_partkey", z, "geom"), at)
    return _box_of(X.read_geojson(s, at), F.col("properties")["p_partkey"].alias("id"), F.col("properties")["p_size"].alias("size"))


@query("source_geojson_features", f"SELECT CAST(s_suppkey AS VARCHAR) AS id, 'n' || s_suppkey AS name, x, y FROM {S}")
def source_geojson_features(s, d):
    k, p = F.col("s_suppkey").cast("string"), F.col("geom")
    line = F.concat(F.lit('{"type":"Feature","id":'), k, F.lit(',"properties":{"name":"n'), k, F.lit('"},"geometry":{"type":"Point","coordinates":['), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]}}"))
    t = X.read_geojson(s, _written(s, D.suppliers(s, d).select(line)))
    return t.select("id", F.col("properties")["name"].alias("name"), st("ST_X", F.col("geom")).alias("x"), st("ST_Y", F.col("geom")).alias("y"))


@query("source_invalid_shapes", "SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 2 THEN 8.0 ELSE 4.0 END::DOUBLE AS area FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def source_invalid_shapes(s, d):
    """Every fifth line is broken text, every third of the others a bow tie: both are left out."""
    k = F.col("s_suppkey")
    wkt = F.when(k % 5 == 0, "POLYGON ((0 0, 0 1").when(k % 3 == 0, "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))").when(k % 3 == 1, "POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))").otherwise("POLYGON ((0 0, 0 4, 2 4, 2 0, 0 0))")
    t = X.read_wkt(s, _written(s, D.suppliers(s, d).select(F.concat_ws("\t", wkt, k))), allow_invalid=False, skip_errors=True)
    return t.select(F.col("attributes")[0].alias("id"), st("ST_Area", F.col("geom")).alias("area"))


@query("source_flattened_parts", "SELECT CAST(s_suppkey AS VARCHAR) AS id, i::DOUBLE AS x FROM supplier, range(3) t(i)")
def source_flattened_parts(s, d):
    t = X.read_wkt(s, _written(s, D.suppliers(s, d).select(F.concat_ws("\t", F.lit("MULTIPOINT ((0 1), (1 1), (2 1))"), "s_suppkey"))), flatten=True)
    return t.select(F.col("attributes")[0].alias("id"), st("ST_X", F.col("geom")).alias("x"))


def _two_points(line: str):
    from geoloom.kernel.geometry import point

    x, y = map(float, line.split(";"))
    return [point(x, y), point(y, x)]


@query("source_user_mapper", f"SELECT x, y FROM {S} UNION ALL SELECT y AS x, x AS y FROM {S}")
def source_user_mapper(s, d):
    t = X.read_mapped(s, _written(s, D.suppliers(s, d).select(F.concat_ws(";", "geom.x", "geom.y"))), _two_points)
    return t.select(st("ST_X", F.col("geom")).alias("x"), st("ST_Y", F.col("geom")).alias("y"))


def _shapefile(s: SparkSession, d: str) -> str:
    """A point shapefile with a table of keys and names, made from the regions' and nations' keys."""
    keys = sorted(r.n_nationkey for r in D.table(s, d, "nation").select("n_nationkey").collect())  # 25
    shapes = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<idd", 1, float(k), k / 2) for i, k in enumerate(keys))
    box = (float(min(keys)), min(keys) / 2, float(max(keys)), max(keys) / 2)
    head = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, 50 + len(shapes) // 2) + struct.pack("<ii4d4d", 1000, 1, *box, 0, 0, 0, 0)
    field = lambda name, kind, size: name.encode().ljust(11, b"\0") + kind + bytes(4) + bytes([size, 0]) + bytes(14)
    fields = field("KEY", b"N", 6) + field("NAME", b"C", 8)
    table = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(keys), 32 + len(fields) + 1, 15) + fields + b"\r"
    table += b"".join(b" " + str(k).rjust(6).encode() + f"n{k}".ljust(8).encode() for k in keys) + b"\x1a"
    at = folder(s)
    put(s, f"{at}/places.shp", head + shapes)
    put(s, f"{at}/places.dbf", table)
    return at


@query("source_shapefile", "SELECT n_nationkey::DOUBLE AS x, n_nationkey::DOUBLE / 2 AS y, CAST(n_nationkey AS VARCHAR) AS key, 'n' || n_nationkey AS name FROM nation")
def source_shapefile(s, d):
    t = shapefile.read_shapefile(s, _shapefile(s, d))
    return t.select(st("ST_X", F.col("geom")).alias("x"), st("ST_Y", F.col("geom")).alias("y"), F.trim(F.col("attributes")["KEY"]).alias("key"), F.trim(F.col("attributes")["NAME"]).alias("name"))


@query("source_shapefile_bounds", "SELECT min(n_nationkey)::DOUBLE AS xmin, max(n_nationkey)::DOUBLE AS xmax, max(n_nationkey)::DOUBLE / 2 AS ymax FROM nation")
def source_shapefile_bounds(s, d):
    return shapefile.read_bounds(s, _shapefile(s, d)).select("xmin", "xmax", "ymax")


@query("source_shapefile_fields", "SELECT unnest(['KEY', 'NAME']) AS field")
def source_shapefile_fields(s, d):
    return s.createDataFrame([(f,) for f in shapefile.read_field_names(s, _shapefile(s, d))], "field string")


def _tiff(width: int, height: int, bands: list[list[int]]) -> bytes:
    """An uncompressed picture of 16-bit numbers, band by band."""
    data = b"".join(struct.pack(f"<{len(b)}H", *b) for b in bands)
    n = len(bands)
    tags = [(256, 3, [width]), (257, 3, [height]), (258, 3, [16] * n), (259, 3, [1]), (262, 3, [1]), (273, 4, [0] * n), (277, 3, [n]), (278, 3, [height]), (279, 4, [2 * width * height] * n), (284, 3, [2]), (339, 3, [1] * n)]
    at = 8 + 2 + 12 * len(tags) + 4
    extra = b""
    code = {3: "H", 4: "I"}
    sizes = [struct.calcsize("<" + code[k] * len(v)) for _, k, v in tags]
    start = at + sum(x for x in sizes if x > 4)
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for (tag, kind, values), size in zip(tags, sizes, strict=True):
        if tag == 273:
            values = [start + 2 * width * height * i for i in range(n)]
        raw = struct.pack("<" + code[kind] * len(values), *values)
        if size > 4:
            out += struct.pack("<HHII", tag, kind, len(values), at + len(extra))
            extra += raw
        else:
            out += struct.pack("<HHI4s", tag, kind, len(values), raw.ljust(4, b"\0"))
    return out + bytes(4) + extra + data


@query("source_geotiff", "SELECT 5 AS width, 5 AS height, 2 AS bands, sum(n_nationkey)::DOUBLE AS first, 2 * sum(n_nationkey)::DOUBLE AS second FROM nation")
def source_geotiff(s, d):
    keys = sorted(r.n_nationkey for r in D.table(s, d, "nation").select("n_nationkey").collect())  # 25
    at = folder(s)
    put(s, f"{at}/one.tif", _tiff(5, 5, [keys, [2 * k for k in keys]]))
    from geoloom.functions import raster as R

    t = geotiff.read_geotiff(s, at).select("image.*")
    total = lambda band: F.aggregate(band, F.lit(0.0), lambda a, v: a + v)
    return t.select("width", "height", F.col("nBands").alias("bands"), total(R.rs_getband("data", 1, 2)).alias("first"), total(R.rs_getband("data", 2, 2)).alias("second"))


# --- kernel functions ------------------------------------------------------------------


@query("st_geomfromgeohash", f"SELECT c_custkey, floor((x + 180) / 360 * 1024) * 360 / 1024 - 180 AS xmin, floor((y + 90) / 180 * 1024) * 180 / 1024 - 90 AS ymin FROM {C}")
def st_geomfromgeohash(s, d):
    g = D.customers(s, d).select("c_custkey", wkb_box(st("ST_GeomFromGeoHash", N.geohash(F.col("geom"), 4))).alias("b"))
    return g.select("c_custkey", "b.xmin", "b.ymin")


def _line(*numbers: Column) -> Column:
    return st("ST_LineStringFromText", F.concat_ws(",", *(n.cast("string") for n in numbers)), F.lit(","))


@query("st_crosses", "SELECT s_suppkey, s_suppkey % 7 < 3 AS line_line, s_suppkey % 5 < 2 AS line_polygon FROM supplier")
def st_crosses(s, d):
    """A line of length 6 from (0, 0) against a short upright one at k % 7 * 2 + 1, and against a square from k % 5 * 2 + 3 on."""
    k, z = F.col("s_suppkey"), F.lit(0.0)
    flat = _line(z, z, F.lit(6.0), z)
    up = _line(k % 7 * 2 + 1.0, F.lit(-1.0), k % 7 * 2 + 1.0, F.lit(1.0))
    square = st("ST_PolygonFromEnvelope", k % 5 * 2 + 3.0, F.lit(-1.0), k % 5 * 2 + 20.0, F.lit(1.0))
    return D.suppliers(s, d).select("s_suppkey", st("ST_Crosses", flat, up).alias("line_line"), st("ST_Crosses", flat, square).alias("line_polygon"))


@query("st_within_distance_kernel", f"SELECT s_suppkey, x >= 0 AND x <= 90 AND y >= -45 AND y <= 45 AS inside, round(sqrt(greatest(0 - x, 0, x - 90) ** 2 + greatest(-45 - y, 0, y - 45) ** 2), 6) AS distance FROM {S}")
def st_within_distance_kernel(s, d):
    """Against an L-shaped pair of rectangles that make up one rectangle: no box answers it."""
    whole = F.lit("MULTIPOLYGON (((0 -45, 0 45, 45 45, 45 -45, 0 -45)), ((45 -45, 45 45, 90 45, 90 -45, 45 -45)))")
    p, g = st("ST_Point", F.col("geom.x"), F.col("geom.y")), st("ST_GeomFromWKT", whole)
    return D.suppliers(s, d).select("s_suppkey", st("ST_Within", p, g).alias("inside"), _r(st("ST_Distance", p, g)).alias("distance"))


@query("st_boundary", f"SELECT p_partkey, 'ST_LineString' AS kind, round(2 * (x1 - x0 + y1 - y0), 6) AS length, 2 AS ends FROM {PA}")
def st_boundary(s, d):
    g = _wkb_rects(D.parts(s, d)).select("p_partkey", st("ST_Boundary", F.col("geom")).alias("b"), F.col("geom"))
    ends = st("ST_NumGeometries", st("ST_Boundary", _line(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))))
    return g.select("p_partkey", st("ST_GeometryType", F.col("b")).alias("kind"), _r(st("ST_Length", F.col("b"))).alias("length"), ends.alias("ends"))


@query("st_linemerge", "SELECT s_suppkey, 'ST_LineString' AS kind, 4.0::DOUBLE + s_suppkey AS length, 0 AS other FROM supplier")
def st_linemerge(s, d):
    k = (F.col("s_suppkey") + 1).cast("string")
    wkt = F.concat(F.lit("MULTILINESTRING ((1 0, 3 0), (0 0, 1 0), (3 0, 3 "), k, F.lit("))"))
    g = st("ST_LineMerge", st("ST_GeomFromWKT", wkt))
    return D.suppliers(s, d).select("s_suppkey", st("ST_GeometryType", g).alias("kind"), st("ST_Length", g).alias("length"), st("ST_NumGeometries", st("ST_LineMerge", st("ST_Point", F.lit(1.0), F.lit(2.0)))).alias("other"))


@query("st_makepolygon", f"SELECT s_suppkey, round(16 * r * r - r * r, 6) AS area, 1 AS holes FROM {S}")
def st_makepolygon(s, d):
    x, y, r = F.col("geom.x"), F.col("geom.y"), F.col("r")
    ring = lambda a, b: _line(x + a * r, y + a * r, x + a * r, y + b * r, x + b * r, y + b * r, x + b * r, y + a * r, x + a * r, y + a * r)
    t = D.suppliers(s, d).select("s_suppkey", ring(0, 4).alias("shell"), ring(1, 2).alias("hole"))
    g = st("ST_MakePolygon", F.col("shell"), F.array("hole"))
    return t.select("s_suppkey", _r(st("ST_Area", g)).alias("area"), st("ST_NumInteriorRings", g).alias("holes"))


@query("st_isring_isclosed", "SELECT s_suppkey, s_suppkey % 3 = 0 AS ring, s_suppkey % 3 <> 2 AS closed FROM supplier")
def st_isring_isclosed(s, d):
    """Closed and simple, closed and crossing itself, open."""
    k = F.col("s_suppkey")
    wkt = F.when(k % 3 == 0, "LINESTRING (0 0, 0 2, 2 2, 0 0)").when(k % 3 == 1, "LINESTRING (0 0, 2 2, 2 0, 0 2, 0 0)").otherwise("LINESTRING (0 0, 0 2, 2 2)")
    g = D.suppliers(s, d).select("s_suppkey", st("ST_GeomFromWKT", wkt).alias("g"))
    return g.select("s_suppkey", st("ST_IsRing", F.col("g")).alias("ring"), st("ST_IsClosed", F.col("g")).alias("closed"))


@query("st_isvalid_issimple", "SELECT s_suppkey, s_suppkey % 2 = 0 AS valid, s_suppkey % 3 = 0 AS simple FROM supplier")
def st_isvalid_issimple(s, d):
    k = F.col("s_suppkey")
    polygon = F.when(k % 2 == 0, "POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))").otherwise("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))")
    line = F.when(k % 3 == 0, "LINESTRING (0 0, 1 1, 2 0)").otherwise("LINESTRING (0 0, 2 2, 2 0, 0 2)")
    return D.suppliers(s, d).select("s_suppkey", st("ST_IsValid", st("ST_GeomFromWKT", polygon)).alias("valid"), st("ST_IsSimple", st("ST_GeomFromWKT", line)).alias("simple"))


@query("st_convexhull_star", f"SELECT s_suppkey, round(4 * r * r, 6) AS area, s_suppkey % 2 = 0 AS same FROM {S}")
def st_convexhull_star(s, d):
    """The hull of a square with its sides pressed in is the square; it equals the shape only where nothing was pressed in."""
    x, y, r = F.col("geom.x"), F.col("geom.y"), F.col("r")
    press = F.when(F.col("s_suppkey") % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.25))
    at = lambda a, b: F.concat_ws(" ", (x + a * r).cast("string"), (y + b * r).cast("string"))
    ring = [at(-1, -1), at(-press, F.lit(0.0)), at(-1, 1), at(1, 1), at(1, -1), at(-1, -1)]
    g = D.suppliers(s, d).select("s_suppkey", st("ST_GeomFromWKT", F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *ring), F.lit("))"))).alias("g"))
    hull = st("ST_ConvexHull", F.col("g"))
    return g.select("s_suppkey", _r(st("ST_Area", hull)).alias("area"), st("ST_Equals", hull, F.col("g")).alias("same"))


@query("st_simplify_zigzag", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 >= 2 THEN 5 ELSE 2 END AS n FROM supplier")
def st_simplify_zigzag(s, d):
    """A zigzag of height k % 4 loses its inner corners if the tolerance of 1.5 is above it."""
    h = F.col("s_suppkey") % 4
    line = _line(F.lit(0.0), F.lit(0.0), F.lit(10.0), h.cast("double"), F.lit(20.0), (-h).cast("double"), F.lit(30.0), h.cast("double"), F.lit(40.0), F.lit(0.0))
    return D.suppliers(s, d).select("s_suppkey", st("ST_NPoints", st("ST_SimplifyPreserveTopology", line, F.lit(1.5))).alias("n"))


@query("st_points_kernel", f"SELECT s_suppkey, y AS x, x AS y, round(floor(x * 10 + 0.5::DOUBLE) / 10, 6) AS px, round(CASE WHEN a < 0 THEN a + {2 * math.pi!r}::DOUBLE ELSE a END, 6) AS azimuth FROM (SELECT *, atan2(0.05::DOUBLE - x, 0.05::DOUBLE - y) AS a FROM {S})")
def st_points_kernel(s, d):
    t = D.suppliers(s, d).select("s_suppkey", st("ST_Point", F.col("geom.x"), F.col("geom.y")).alias("g"))
    f = st("ST_FlipCoordinates", F.col("g"))
    return t.select("s_suppkey", st("ST_X", f).alias("x"), st("ST_Y", f).alias("y"), _r(st("ST_X", st("ST_PrecisionReduce", F.col("g"), F.lit(1)))).alias("px"), _r(st("ST_Azimuth", F.col("g"), st("ST_Point", F.lit(0.05), F.lit(0.05)))).alias("azimuth"))


@query("st_minimumboundingcircle", f"SELECT p_partkey, round(((x1 - x0) ** 2 + (y1 - y0) ** 2) / 8 * 32 * sin(2 * pi() / 32), 4) AS area FROM {PA}")
def st_minimumboundingcircle(s, d):
    return _wkb_rects(D.parts(s, d)).select("p_partkey", _r(st("ST_Area", st("ST_MinimumBoundingCircle", F.col("geom"))), 4).alias("area"))


@query("st_dump_lateral", "SELECT s_suppkey, i + 1 AS x FROM supplier, range(3) t(i)")
def st_dump_lateral(s, d):
    register(s)
    D.table(s, d, "supplier").createOrReplaceTempView("geo_supplier_rows")
    return s.sql("SELECT s_suppkey, CAST(ST_X(g) AS BIGINT) AS x FROM geo_supplier_rows LATERAL VIEW explode(ST_Dump(ST_GeomFromWKT('MULTIPOINT ((1 1), (2 1), (3 1))'))) t AS g")


@query("st_makevalid_table", "SELECT n_nationkey, count(*) AS parts, sum(a)::DOUBLE AS area FROM nation, (SELECT unnest([1, 1]) AS a) GROUP BY n_nationkey")
def st_makevalid_table(s, d):
    register(s)
    D.table(s, d, "nation").createOrReplaceTempView("geo_nation_rows")
    return s.sql("SELECT n_nationkey, count(*) AS parts, round(sum(ST_Area(v.geom)), 6) AS area FROM geo_nation_rows, LATERAL ST_MakeValid(ST_GeomFromWKT('POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))')) v GROUP BY n_nationkey")


@query("st_subdivideexplode_table", "SELECT n_nationkey, 16.0::DOUBLE AS area, true AS many FROM nation")
def st_subdivideexplode_table(s, d):
    register(s)
    D.table(s, d, "nation").createOrReplaceTempView("geo_nation_rows")
    return s.sql("SELECT n_nationkey, round(sum(ST_Area(v.geom)), 6) AS area, count(*) > 1 AND max(ST_NPoints(v.geom)) <= 5 AS many FROM geo_nation_rows, LATERAL ST_SubDivideExplode(ST_GeomFromWKT('POLYGON ((0 0, 0 2, 0 4, 2 4, 4 4, 4 2, 4 0, 2 0, 0 0))'), 5) v GROUP BY n_nationkey")


@query("st_transform_utm", "SELECT s_suppkey, round(500000 + 0.9996 * a * (l + l * l * l / 6 * 1.006739496742276), 0) AS x FROM (SELECT s_suppkey, 6378137::DOUBLE AS a, radians((s_suppkey % 11)::DOUBLE / 10) AS l FROM supplier)")
def st_transform_utm(s, d):
    """On the equator the easting follows from the first terms of the projection's series."""
    g = st("ST_Transform", st("ST_Point", F.col("s_suppkey") % 11 / 10 + 9, F.lit(0.0)), F.lit("epsg:4326"), F.lit("epsg:32632"))
    return D.suppliers(s, d).select("s_suppkey", _r(st("ST_X", g), 0).alias("x"))


@query("st_union_aggr_overlap", f"SELECT k, round(2 * n + 2, 6) AS area FROM (SELECT s_suppkey % 5 AS k, count(*)::DOUBLE AS n FROM supplier GROUP BY 1)")
def st_union_aggr_overlap(s, d):
    """Squares of side 2 in a row, each shifted by 1: they overlap."""
    from geoloom.operators import aggregates as A

    order = F.row_number().over(_by_group())
    t = D.suppliers(s, d).withColumn("k", F.col("s_suppkey") % 5).withColumn("i", order)
    t = t.select("k", st("ST_PolygonFromEnvelope", F.col("i").cast("double"), F.lit(0.0), F.col("i") + 2.0, F.lit(2.0)).alias("geom"))
    return A.union_aggregate(t, "geom", "k").select("k", _r(st("ST_Area", F.col("geom"))).alias("area"))


def _by_group():
    from pyspark.sql import Window

    return Window.partitionBy("k").orderBy("s_suppkey")


@query("st_aggregates_sql", f"SELECT n_regionkey, round((max(x1) - min(x0)) * (max(y1) - min(y0)), 6) AS envelope, round(sum((x1 - x0) * (y1 - y0)), 6) AS joined FROM {NA} GROUP BY n_regionkey")
def st_aggregates_sql(s, d):
    _views(s, d)
    D.nations(s, d).select("n_nationkey", "n_regionkey").createOrReplaceTempView("geo_regions")
    return s.sql("SELECT n_regionkey, round(ST_Area(ST_Envelope_Aggr(ST_PolygonFromEnvelope(x0, y0, x1, y1))), 6) AS envelope, round(ST_Area(ST_Union_Aggr(ST_PolygonFromEnvelope(x0, y0, x1, y1))), 6) AS joined FROM geo_nations JOIN geo_regions USING (n_nationkey) GROUP BY n_regionkey")


# --- partitioning ----------------------------------------------------------------------


def _partitioned_join(kind: str):
    def run(s, d):
        a, cells = P.partition(D.parts(s, d), "geom", kind, 16)
        b, same = P.partition(D.customers(s, d).withColumnRenamed("geom", "at"), "at", cells=cells)
        assert same is cells
        j = J.dealt_join(a, b, cells, "contains", right_geom="at")
        return j.select("p_partkey", "c_custkey")

    return run


for _kind in ("kdbtree", "quadtree", "rtree", "equalgrid"):
    query(f"partitioned_join_{_kind}", f"SELECT p_partkey, c_custkey FROM {PA} a JOIN {C} p ON {_IN}")(_partitioned_join(_kind))


@query("equalgrid_cells", f"SELECT CAST(least(floor((x - x0) / (x1 - x0) * 4), 3) + 4 * least(floor((y - y0) / (y1 - y0) * 4), 3) AS INTEGER) AS cell_id, count(*) AS n FROM {C}, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {C}) GROUP BY 1")
def equalgrid_cells(s, d):
    placed, _ = P.partition(D.customers(s, d), "geom", "equalgrid", 16)
    return placed.groupBy("cell_id").agg(F.count("*").alias("n"))


@query("partition_balance", "SELECT true AS balanced, true AS whole")
def partition_balance(s, d):
    """No cell of a KDB-tree over all points holds more than twice its share, and every row has one cell."""
    c = D.customers(s, d)
    placed, cells = P.partition(c, "geom", "kdbtree", 8)
    n = c.count()
    by = placed.groupBy("cell_id").agg(F.count("*").alias("n"))
    return by.agg((F.max("n") <= 2 * n / 8 + 50).alias("balanced"), (F.sum("n") == n).alias("whole"))


@query("curve_order_ranges", f"SELECT c_custkey, least(floor((x + 180) / 360 * 16), 15)::BIGINT AS cx, least(floor((y + 90) / 180 * 16), 15)::BIGINT AS cy, true AS ordered FROM {C}")
def curve_order_ranges(s, d):
    """Rows come range-partitioned along the Morton curve: partitions do not overlap, and codes give the cells back."""
    o = P.curve_order(D.customers(s, d), "geom", WORLD, "morton", 8, 4).withColumn("part", F.spark_partition_id())
    o = J.stored(o)
    bounds = o.groupBy("part").agg(F.min("curve").alias("lo"), F.max("curve").alias("hi"))
    clash = bounds.alias("a").join(F.broadcast(bounds.alias("b")), (F.col("a.part") < F.col("b.part")) & (F.col("a.hi") >= F.col("b.lo"))).agg((F.count("*") == 0).alias("ordered"))
    take = lambda shift: sum((F.shiftright("curve", 2 * k + shift).bitwiseAND(F.lit(1)) * (1 << k) for k in range(4)), F.lit(0)).cast("long")
    return o.join(F.broadcast(clash)).select("c_custkey", take(0).alias("cx"), take(1).alias("cy"), "ordered")


# --- streams -----------------------------------------------------------------------------


@query("sliding_counts", "SELECT strftime(date_trunc('hour', ts) - to_minutes(30 * i), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT ts, unnest(CASE WHEN date_part('minute', ts) < 30 THEN [0, 1] ELSE [0, -1] END) AS i FROM events) GROUP BY 1")
def sliding_counts(s, d):
    g = G.windowed_counts(D.table(s, d, "events"), "ts", [], "1 hour", slide="30 minutes")
    return g.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    kind = D.table(s, d, "events").schema
    return s.readStream.schema(kind).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_hourly_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(s, d):
    """The windowed counts of a stream that is read to its end."""
    at, name = folder(s), "geo_stream_hourly"
    g = G.windowed_counts(_streamed(s, d), "ts", ["event_type"], "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
    g.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.table(name).select("start", "event_type", "n")


_EVENTS = "(SELECT user_id, event_type, ts, ((user_id * 37) % 3600)::DOUBLE / 10.0::DOUBLE - 180::DOUBLE AS x, ((user_id * 91) % 1800)::DOUBLE / 10.0::DOUBLE - 90::DOUBLE AS y FROM events)"


@query("stream_static_join", f"SELECT n_nationkey, event_type, count(*) AS n FROM {NA} a JOIN {_EVENTS} p ON {_IN} GROUP BY n_nationkey, event_type")
def stream_static_join(s, d):
    """Points of a stream against static rectangles, appended to a table."""
    at, k = folder(s), F.col("user_id")
    e = _streamed(s, d).select("event_type", N.point((k * 37 % 3600).cast("double") / 10.0 - 180.0, (k * 91 % 1800).cast("double") / 10.0 - 90.0).alias("geom"))
    met = G.fence(e, D.nations(s, d), 1.0).select("event_type", F.col("fence.n_nationkey").alias("n_nationkey"))
    met.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(met.schema).parquet(f"{at}/rows").groupBy("n_nationkey", "event_type").agg(F.count("*").alias("n"))


@query("windowed_geofence", f"SELECT n_nationkey, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM {NA} a JOIN {_EVENTS} p ON {_IN} GROUP BY 1, 2")
def windowed_geofence(s, d):
    k = F.col("user_id")
    e = D.table(s, d, "events").select("ts", N.point((k * 37 % 3600).cast("double") / 10.0 - 180.0, (k * 91 % 1800).cast("double") / 10.0 - 90.0).alias("geom"))
    met = G.fence(e, D.nations(s, d), 1.0).select("ts", F.col("fence.n_nationkey").alias("n_nationkey"))
    g = G.windowed_counts(met, "ts", ["n_nationkey"], "1 day")
    return g.select("n_nationkey", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


# --- pictures --------------------------------------------------------------------------

_PX = "least(floor((x + 180) / 360 * 64), 63)::INTEGER AS px, least(floor((y + 90) / 180 * 32), 31)::INTEGER AS py"


def _drawn(images: DataFrame) -> DataFrame:
    """(tile, opaque pixels, their red summed) of each picture, decoded again."""
    def count(image):
        a = V.decode(bytes(image)).astype(int)
        return [int((a[..., 3] > 0).sum()), int(a[..., 0][a[..., 3] > 0].sum())]

    n = batched(count, "array<long>")(F.col("image"))
    return images.select("tile", n.alias("n")).select("tile", F.col("n")[0].alias("pixels"), F.col("n")[1].alias("red"))


@query("render_scatter_pixels", f"SELECT '1-' || (px // 32) || '-' || (1 - py // 16) AS tile, count(*) AS pixels, 255 * count(*) AS red FROM (SELECT DISTINCT {_PX} FROM {C}) GROUP BY 1")
def render_scatter_pixels(s, d):
    return _drawn(V.scatter_plot(D.customers(s, d), 64, 32, WORLD, zoom=1))


@query("render_heatmap_pixels", f"SELECT '0-0-0' AS tile, count(*) AS pixels FROM (SELECT DISTINCT {_PX} FROM {IT})")
def render_heatmap_pixels(s, d):
    return _drawn(V.heat_map(D.items(s, d), 64, 32, WORLD, radius=0)).select("tile", "pixels")


@query("st_pixelize_points", f"SELECT s_suppkey, {_PX} FROM {S}")
def st_pixelize_points(s, d):
    kind, f = VF.FUNCTIONS["ST_Pixelize"]
    world = st("ST_PolygonFromEnvelope", *(F.lit(v) for v in WORLD))
    p = batched(f, kind)(st("ST_Point", F.col("geom.x"), F.col("geom.y")), F.lit(64), F.lit(32), world)
    return D.suppliers(s, d).select("s_suppkey", F.explode(p).alias("p")).select("s_suppkey", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("st_pixelize_lines", "SELECT s_suppkey, i::INTEGER AS px, (s_suppkey % 32)::INTEGER AS py FROM supplier, range(64) t(i) WHERE i < 10 + s_suppkey % 20")
def st_pixelize_lines(s, d):
    """Level lines: Bresenham's pixels from the first up to, without, the last."""
    y = (F.col("s_suppkey") % 32 + 0.5) / 32 * 180 - 90
    line = _line(F.lit(0.5) / 64 * 360 - 180, y, (F.col("s_suppkey") % 20 + 10.5) / 64 * 360 - 180, y)
    return V.pixelize(D.suppliers(s, d).select("s_suppkey", line.alias("geom")), 64, 32, WORLD).select("s_suppkey", "px", "py")


@query("fill_rectangle_pixels", "SELECT n_nationkey, count(*) AS n FROM nation, range(20) a(i), range(10) b(j) GROUP BY n_nationkey")
def fill_rectangle_pixels(s, d):
    """Each nation's rectangle of 60 by 30 degrees holds the centres of 20 by 10 pixels of 3 degrees."""
    p = V.pixelize(_wkb_rects(D.nations(s, d)), 120, 60, WORLD, filled=True)
    return p.groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("st_encodeimage", "SELECT vec_id, 'iVBORw0KGgo' AS head, 16::BIGINT AS pixels FROM embeddings")
def st_encodeimage(s, d):
    """Pictures of four by four pixels as base64: decoded again they have their pixels."""
    b = lambda i: F.transform(F.slice("a", 1 + 16 * i, 16), lambda v: F.abs(v) % 256)
    image = D.bands(s, d).select("vec_id", F.unbase64(st("RS_Base64", F.lit(4), F.lit(4), b(0), b(1), b(2))).alias("image"))
    kind, f = VF.FUNCTIONS["ST_EncodeImage"]
    n = batched(lambda image: V.decode(bytes(image)).shape[0] * V.decode(bytes(image)).shape[1], "long")(F.col("image"))
    return image.select("vec_id", F.substring(batched(f, kind)(F.col("image")), 1, 11).alias("head"), n.alias("pixels"))


@query("rs_base64_decoded", "SELECT vec_id, sum(v)::BIGINT AS red FROM (SELECT vec_id, unnest(list_transform(embedding[1:16], lambda v: abs(floor(v::DOUBLE * 1000)) % 256)) AS v FROM embeddings) GROUP BY vec_id")
def rs_base64_decoded(s, d):
    b = lambda i: F.transform(F.slice("a", 1 + 16 * i, 16), lambda v: F.abs(v) % 256)
    image = D.bands(s, d).select("vec_id", F.unbase64(st("RS_Base64", F.lit(4), F.lit(4), b(0), b(1), b(2))).alias("image"))
    return image.select("vec_id", batched(lambda image: int(V.decode(bytes(image))[..., 0].sum()), "long")(F.col("image")).alias("red"))



# --- circles, projections ------------------------------------------------------------------

_FAR = "sqrt(greatest(abs(b.x0 - c.x), abs(b.x1 - c.x)) ** 2 + greatest(abs(b.y0 - c.y), abs(b.y1 - c.y)) ** 2)"
_NEAR = "sqrt(greatest(b.x0 - c.x, 0, c.x - b.x1) ** 2 + greatest(b.y0 - c.y, 0, c.y - b.y1) ** 2)"


@query("circle_rects", f"SELECT s_suppkey, p_partkey, {_FAR} <= r AS covers FROM {S} c JOIN {PA} b ON {_NEAR} <= r")
def circle_rects(s, d):
    """Circles that meet rectangles, and whether they cover them: boxes by cells, then the circle's own tests."""
    c = D.suppliers(s, d).select("s_suppkey", N.circle(F.col("geom"), "r").alias("circle")).withColumn("geom", N.circle_box(F.col("circle")))
    j = J.spatial_join(c, D.parts(s, d).select("p_partkey", "geom"), "intersects")
    j = j.where(N.circle_intersects_rect(F.col("circle"), F.col("geom_right")))
    return j.select("s_suppkey", "p_partkey", N.circle_covers_rect(F.col("circle"), F.col("geom_right")).alias("covers"))


@query("circle_shapes", "SELECT s_suppkey, s_suppkey % 10 >= 5 AS covers, s_suppkey % 10 >= 3 AS meets FROM supplier")
def circle_shapes(s, d):
    """A circle of radius k % 10 around the origin against a line from (0, 3) to (4, 3)."""
    from geoloom.kernel.geometry import Geom
    from geoloom.kernel.measure import circle_covers, circle_intersects

    def both(g: Geom, r):
        return [circle_covers((0.0, 0.0), float(r), g), circle_intersects((0.0, 0.0), float(r), g)]

    line = _line(F.lit(0.0), F.lit(3.0), F.lit(4.0), F.lit(3.0))
    t = D.suppliers(s, d).select("s_suppkey", batched(both, "array<boolean>")(line, F.col("s_suppkey") % 10).alias("b"))
    return t.select("s_suppkey", F.col("b")[0].alias("covers"), F.col("b")[1].alias("meets"))


_ECC = "0.08181919084262149::DOUBLE"


@query("st_transform_ellipsoidal_mercator", f"SELECT s_suppkey, round(6378137 * radians(x), 2) AS x, round(6378137 * (ln(tan(pi() / 4 + radians(y) / 2)) - {_ECC} * 0.5 * ln((1 + {_ECC} * sin(radians(y))) / (1 - {_ECC} * sin(radians(y))))), 2) AS y FROM (SELECT s_suppkey, x, y * 0.9 AS y FROM {S})")
def st_transform_ellipsoidal_mercator(s, d):
    g = st("ST_Transform", st("ST_Point", F.col("geom.x"), F.col("geom.y") * 0.9), F.lit("epsg:4326"), F.lit("epsg:3395"))
    return D.suppliers(s, d).select("s_suppkey", _r(st("ST_X", g), 2).alias("x"), _r(st("ST_Y", g), 2).alias("y"))


# --- frames --------------------------------------------------------------------------------


@query("frame_partitioned_join", f"SELECT p_partkey, c_custkey FROM {PA} a JOIN {C} p ON {_IN}")
def frame_partitioned_join(s, d):
    a, b = SpatialFrame(D.parts(s, d)), SpatialFrame(D.customers(s, d))
    return a.partition("kdbtree", 8).join(b, JoinParams(partitioning="kdbtree")).select("p_partkey", "c_custkey")


@query("frame_saved_and_loaded", f"SELECT c_custkey, x, y FROM {C}")
def frame_saved_and_loaded(s, d):
    at = folder(s)
    SpatialFrame(D.customers(s, d)).partition("rtree", 8).save(at)
    back = SpatialFrame.load(s, at)
    assert len(back.cells.rects) > 1
    return back.df.select("c_custkey", "geom.x", "geom.y")


@query("frame_adapter", f"SELECT CAST(c_custkey AS VARCHAR) AS id, x, y FROM {C}")
def frame_adapter(s, d):
    """Columns to a frame, to attributes as text, and back to columns."""
    flat = D.customers(s, d).select("c_custkey", F.col("geom.x").alias("lon"), F.col("geom.y").alias("lat"))
    text = SpatialFrame.points(flat, "lon", "lat").to_text(",")
    again = SpatialFrame.from_text(text.withColumn("attributes", F.split("attributes", ",")), ["id", "lon", "lat"])
    return again.df.select("id", F.col("geom.x").alias("x"), F.col("geom.y").alias("y"))


@query("frame_join_metrics", f"SELECT (SELECT count(*) FROM part) AS l, (SELECT count(*) FROM customer) AS r, count(*) AS candidates, count(*) AS pairs FROM {PA} a JOIN {C} p ON {_IN}")
def frame_join_metrics(s, d):
    m = SpatialFrame(D.parts(s, d)).join_metrics(SpatialFrame(D.customers(s, d)))
    return s.createDataFrame([(m["left"], m["right"], m["candidates"], m["pairs"])], "l long, r long, candidates long, pairs long")


# --- more pictures -------------------------------------------------------------------------

_W = f"(SELECT px, py, count(*)::DOUBLE AS weight FROM (SELECT {_PX} FROM {IT}) GROUP BY px, py)"
for _name, _kernel in (("gaussian", V.gaussian(1)), ("emboss", V.EMBOSS), ("outline", V.OUTLINE), ("sharpen", V.SHARPEN)):
    _union = " UNION ALL ".join(f"SELECT px + {x} AS px, py + {y} AS py, weight * {w!r}::DOUBLE AS weight FROM w" for (x, y), w in sorted(_kernel.items()) if w)

    def _filtered(s, d, kernel=_kernel):
        w = V.weigh(V.pixelize(D.items(s, d), 64, 32, WORLD))
        return V.convolve(w, kernel, 64, 32).select("px", "py", _r(F.col("weight"), 4).alias("weight"))

    query(f"filter_{_name}", f"WITH w AS {_W} SELECT px, py, round(sum(weight), 4) AS weight FROM ({_union}) WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 31 GROUP BY px, py")(_filtered)


@query("linear_colours", f"WITH w AS {_W} SELECT px, py, CAST(trunc(weight * 255.0 / m) * 65536 + CASE WHEN trunc(weight * 255.0 / m) = 0 THEN 0 ELSE 150::BIGINT * 16777216 END AS BIGINT) AS color FROM w, (SELECT max(weight) AS m FROM w)")
def linear_colours(s, d):
    w = V.weigh(V.pixelize(D.items(s, d), 64, 32, WORLD))
    top = w.agg(F.max("weight").alias("m"))
    return w.join(F.broadcast(top)).select("px", "py", V.linear_colour(F.col("weight"), F.col("m"), "red").alias("color"))


@query("pixel_codecs", f"SELECT s_suppkey, px + py * 64::BIGINT AS id, px AS x, py AS y, 31 - py AS flipped FROM (SELECT s_suppkey, {_PX} FROM {S})")
def pixel_codecs(s, d):
    p = D.suppliers(s, d).select("s_suppkey", N.pixel(F.col("geom"), 64, 32, WORLD).alias("p")).withColumn("id", N.pixel_id(F.col("p")))
    back = N.pixel_of("id", 64, 32)
    return p.select("s_suppkey", "id", back["x"].alias("x"), back["y"].alias("y"), N.flipped_pixel(F.col("p"))["y"].alias("flipped"))


@query("viz_partition_tiles", f"SELECT '3-' || (px * 8 // 64) || '-' || (7 - py * 8 // 32) AS tile, count(*) AS n, true AS decoded FROM (SELECT {_PX} FROM {C}) GROUP BY 1")
def viz_partition_tiles(s, d):
    p = V.partition_by_tile(V.pixelize(D.customers(s, d), 64, 32, WORLD), 64, 32, 3)
    return p.groupBy("tile").agg(F.count("*").alias("n"), F.bool_and(N.tile_of_lineage("lineage") == F.col("tile")).alias("decoded"))


@query("st_render_sql", f"SELECT '1-' || (px // 32) || '-' || (1 - py // 16) AS tile, count(*) AS pixels, 255 * count(*) AS red FROM (SELECT DISTINCT {_PX} FROM {C}) GROUP BY 1")
def st_render_sql(s, d):
    """Tiles drawn by the SQL aggregate, a group a tile."""
    register(s)
    px = N.pixel(F.col("geom"), 64, 32, WORLD)
    p = D.customers(s, d).select(px.alias("pixel")).distinct().withColumn("tile", N.tile_name(F.col("pixel"), 1))
    p.createOrReplaceTempView("geo_pixels")
    return _drawn(s.sql("SELECT tile, ST_Render(pixel, ST_Colorize(1.0D, 1.0D, 'red'), 1) AS image FROM geo_pixels GROUP BY tile"))


@query("png_files", f"SELECT '1-' || (px // 32) || '-' || (1 - py // 16) AS tile, count(*) AS pixels FROM (SELECT DISTINCT {_PX} FROM {C}) GROUP BY 1")
def png_files(s, d):
    at = folder(s)
    V.write_png(V.scatter_plot(D.customers(s, d), 64, 32, WORLD, zoom=1), at)
    files = s.read.format("binaryFile").load(at).select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("tile"), F.col("content").alias("image"))
    return _drawn(files).select("tile", "pixels")


@query("svg_overlay", f"SELECT (SELECT count(*) FROM (SELECT DISTINCT {_PX} FROM {C})) + (SELECT count(*) FROM (SELECT DISTINCT {_PX} FROM {S})) AS squares, 1::BIGINT AS heads")
def svg_overlay(s, d):
    layer = lambda df, rgb: V.to_svg(V.pixelize(df, 64, 32, WORLD).select("px", "py").distinct().withColumn("color", F.lit(VF.argb(*rgb))), 64, 32)
    at = folder(s)
    V.overlay_svg(layer(D.customers(s, d), (0, 0, 255)), layer(D.suppliers(s, d), (255, 0, 0))).orderBy("place").select("line").write.text(at)
    lines = s.read.text(at)
    return lines.agg(F.sum(F.col("value").startswith("<rect").cast("long")).alias("squares"), F.sum(F.col("value").startswith("<svg").cast("long")).alias("heads"))


@query("geotiff_format", "SELECT 5 AS width, 5 AS height, 2 AS bands, sum(n_nationkey)::DOUBLE * 3 AS total FROM nation")
def geotiff_format(s, d):
    keys = sorted(r.n_nationkey for r in D.table(s, d, "nation").select("n_nationkey").collect())  # 25
    at = folder(s)
    put(s, f"{at}/one.tif", _tiff(5, 5, [keys, [2 * k for k in keys]]))
    geotiff.register_format(s)
    t = s.read.format("geotiff").load(at.removeprefix("file:")).select("image.*")
    return t.select("width", "height", F.col("nBands").alias("bands"), F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total"))


# --- entering and leaving, as a state ---------------------------------------------------------

_WALK = f"(SELECT event_id, user_id, ts, ((event_id * 37) % 3600)::DOUBLE / 10.0::DOUBLE - 180::DOUBLE AS x, ((event_id * 91) % 1800)::DOUBLE / 10.0::DOUBLE - 90::DOUBLE AS y FROM events)"
_MOVES = f"WITH p AS (SELECT user_id, ts, min(n_nationkey) AS f FROM {_WALK} p LEFT JOIN {NA} a ON {_IN} GROUP BY user_id, ts), q AS (SELECT *, lag(f) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM p), m AS (SELECT b AS fence, 'leave' AS event FROM q WHERE b IS NOT NULL AND f IS DISTINCT FROM b UNION ALL SELECT f AS fence, 'enter' AS event FROM q WHERE f IS NOT NULL AND f IS DISTINCT FROM b) SELECT fence::BIGINT AS fence, event, count(*) AS n FROM m GROUP BY 1, 2"


def _walk(e: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), N.point((k * 37 % 3600).cast("double") / 10.0 - 180.0, (k * 91 % 1800).cast("double") / 10.0 - 90.0).alias("geom"))


@query("geofence_crossings", _MOVES)
def geofence_crossings(s, d):
    c = G.crossings(_walk(D.table(s, d, "events")), D.nations(s, d), "user_id", "ts", "n_nationkey", 1.0)
    return c.groupBy("fence", "event").agg(F.count("*").alias("n"))


@query("stream_geofence_crossings", _MOVES)
def stream_geofence_crossings(s, d):
    """The same as a stateful operator over a stream that is read to its end."""
    at = folder(s)
    c = G.crossings(_walk(_streamed(s, d)), D.nations(s, d), "user_id", "ts", "n_nationkey", 1.0)
    c.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(c.schema).parquet(f"{at}/rows").groupBy("fence", "event").agg(F.count("*").alias("n"))
