"""The registered spatial queries, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import native as N
from geoloom.functions import raster as R
from geoloom.functions.kernels import FUNCTIONS, batched
from geoloom.operators import aggregates as A
from geoloom.operators import joins as J
from geoloom.operators import partitioning as P
from geoloom.plans import derived as D
from geoloom.streaming import geofence as G
from geoloom.viz import pictures as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WORLD = (-180.0, -90.0, 180.0, 90.0)
C, S, NA, PA, IT, OR, BA = D.CUSTOMERS, D.SUPPLIERS, D.NATIONS, D.PARTS, D.ITEMS, D.ORDERS, D.BANDS


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def st(name: str, *cols: Column) -> Column:
    kind, f = FUNCTIONS[name]
    return batched(f, kind)(*cols)


def _r(v: Column, digits: int = 6) -> Column:
    return F.round(v, digits)


# --- constructors and accessors --------------------------------------------------


@query("st_point_xy", f"SELECT c_custkey, x, y FROM {C}")
def st_point_xy(s, d):
    return D.customers(s, d).select("c_custkey", F.col("geom.x").alias("x"), F.col("geom.y").alias("y"))


@query("st_x_y_wkb", f"SELECT s_suppkey, x, y FROM {S}")
def st_x_y_wkb(s, d):
    g = D.suppliers(s, d).select("s_suppkey", st("ST_Point", F.col("geom.x"), F.col("geom.y")).alias("g"))
    return g.select("s_suppkey", st("ST_X", F.col("g")).alias("x"), st("ST_Y", F.col("g")).alias("y"))


@query("st_polygonfromenvelope_area", f"SELECT p_partkey, round((x1 - x0) * (y1 - y0), 6) AS area, round(2 * ((x1 - x0) + (y1 - y0)), 6) AS perimeter, 5 AS n_points FROM {PA}")
def st_polygonfromenvelope_area(s, d):
    b = F.col("geom")
    g = D.parts(s, d).select("p_partkey", st("ST_PolygonFromEnvelope", b["xmin"], b["ymin"], b["xmax"], b["ymax"]).alias("g"))
    return g.select("p_partkey", _r(st("ST_Area", F.col("g"))).alias("area"), _r(st("ST_Length", F.col("g"))).alias("perimeter"), st("ST_NPoints", F.col("g")).alias("n_points"))


@query("st_pointfromtext_csv", f"SELECT c_custkey, x, y FROM {C}")
def st_pointfromtext_csv(s, d):
    t = D.customers(s, d).select("c_custkey", st("ST_PointFromText", F.concat_ws(",", "geom.x", "geom.y"), F.lit(",")).alias("g"))
    return t.select("c_custkey", st("ST_X", F.col("g")).alias("x"), st("ST_Y", F.col("g")).alias("y"))


def _wkt_number(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


@query("st_astext_point", f"SELECT o_orderkey, 'POINT (' || {_wkt_number('x')} || ' ' || {_wkt_number('y')} || ')' AS wkt FROM (SELECT o_orderkey, (o_orderkey % 360 - 180)::DOUBLE / 4 AS x, (o_orderkey % 180 - 90)::DOUBLE / 2 AS y FROM orders)")
def st_astext_point(s, d):
    k = F.col("o_orderkey")
    p = N.point((k % 360 - 180) / 4, (k % 180 - 90) / 2)
    return D.table(s, d, "orders").select("o_orderkey", N.text(p).alias("wkt"))


@query("st_astext_wkb", ORACLES["st_astext_point"])
def st_astext_wkb(s, d):
    k = F.col("o_orderkey")
    return D.table(s, d, "orders").select("o_orderkey", st("ST_AsText", st("ST_Point", (k % 360 - 180) / 4, (k % 180 - 90) / 2)).alias("wkt"))


@query("st_geomfromwkt_roundtrip", f"SELECT s_suppkey, 'ST_Polygon' AS kind, 5 AS n, round(4 * r * r, 6) AS area FROM {S}")
def st_geomfromwkt_roundtrip(s, d):
    x, y, r = F.col("geom.x"), F.col("geom.y"), F.col("r")
    at = lambda a, b: F.concat_ws(" ", (x + a * r).cast("string"), (y + b * r).cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", at(-1, -1), at(-1, 1), at(1, 1), at(1, -1), at(-1, -1)), F.lit("))"))
    g = D.suppliers(s, d).select("s_suppkey", st("ST_GeomFromWKB", F.hex(st("ST_AsBinary", st("ST_GeomFromWKT", wkt)))).alias("g"))
    return g.select("s_suppkey", st("ST_GeometryType", F.col("g")).alias("kind"), st("ST_NPoints", F.col("g")).alias("n"), _r(st("ST_Area", F.col("g"))).alias("area"))


@query("st_geojson_roundtrip", f"SELECT s_suppkey, x, y FROM {S}")
def st_geojson_roundtrip(s, d):
    g = D.suppliers(s, d).select("s_suppkey", st("ST_GeomFromGeoJSON", st("ST_AsGeoJSON", st("ST_Point", F.col("geom.x"), F.col("geom.y")))).alias("g"))
    return g.select("s_suppkey", st("ST_X", F.col("g")).alias("x"), st("ST_Y", F.col("g")).alias("y"))


@query("st_srid", "SELECT s_suppkey, (4000 + s_suppkey % 100)::INTEGER AS srid, 0 AS bare FROM supplier")
def st_srid(s, d):
    g = D.suppliers(s, d).select("s_suppkey", st("ST_SetSRID", st("ST_Point", F.col("geom.x"), F.col("geom.y")), (4000 + F.col("s_suppkey") % 100).cast("int")).alias("g"))
    return g.select("s_suppkey", st("ST_SRID", st("ST_AsEWKB", F.col("g"))).alias("srid"), st("ST_SRID", st("ST_AsBinary", F.col("g"))).alias("bare"))


def _trajectories(s, d) -> DataFrame:
    """A WKB line of each customer's orders by date (customers with two or more)."""
    o = D.orders(s, d).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "geom"))).alias("v")).where(F.size("v") > 1)
    text = F.array_join(F.transform("v", lambda p: F.concat_ws(",", p["geom"]["x"].cast("string"), p["geom"]["y"].cast("string"))), ",")
    return o.select("o_custkey", st("ST_LineStringFromText", text, F.lit(",")).alias("line"))


_LINES = f"(SELECT o_custkey, list(x ORDER BY o_orderdate, o_orderkey) AS xs, list(y ORDER BY o_orderdate, o_orderkey) AS ys, count(*) AS n FROM {OR} GROUP BY o_custkey HAVING count(*) > 1)"


@query("st_linestring_ends", f"SELECT o_custkey, n::INTEGER AS n, xs[1] AS x_first, ys[1] AS y_first, xs[-1] AS x_last, ys[-1] AS y_last FROM {_LINES}")
def st_linestring_ends(s, d):
    t = _trajectories(s, d)
    a, b = st("ST_StartPoint", F.col("line")), st("ST_EndPoint", F.col("line"))
    return t.select("o_custkey", st("ST_NPoints", F.col("line")).alias("n"), a.alias("a"), b.alias("b")).select("o_custkey", "n", st("ST_X", F.col("a")).alias("x_first"), st("ST_Y", F.col("a")).alias("y_first"), st("ST_X", F.col("b")).alias("x_last"), st("ST_Y", F.col("b")).alias("y_last"))


@query("st_length_traj", f"SELECT o_custkey, round(list_sum(list_transform(range(1, n), lambda i: sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2))), 4) AS length FROM {_LINES}")
def st_length_traj(s, d):
    return _trajectories(s, d).select("o_custkey", _r(st("ST_Length", F.col("line")), 4).alias("length"))


@query("st_addpoint_removepoint", f"SELECT o_custkey, (n + 1)::INTEGER AS n_added, CASE WHEN n > 2 THEN (n - 1)::INTEGER END AS n_removed, 0.5::DOUBLE AS x_added FROM {_LINES}")
def st_addpoint_removepoint(s, d):
    t = _trajectories(s, d).select("o_custkey", st("ST_AddPoint", F.col("line"), st("ST_Point", F.lit(0.5), F.lit(1.5)), F.lit(1)).alias("more"), st("ST_RemovePoint", F.col("line"), F.lit(0)).alias("less"))
    return t.select("o_custkey", st("ST_NPoints", F.col("more")).alias("n_added"), st("ST_NPoints", F.col("less")).alias("n_removed"), st("ST_X", F.element_at(st("ST_DumpPoints", F.col("more")), 2)).alias("x_added"))


@query("st_envelope_line", f"SELECT o_custkey, list_max(xs) - list_min(xs) AS w, list_max(ys) - list_min(ys) AS h FROM {_LINES}")
def st_envelope_line(s, d):
    from geoloom.operators.geometry import wkb_box

    t = _trajectories(s, d).select("o_custkey", wkb_box(st("ST_Envelope", F.col("line"))).alias("b"))
    return t.select("o_custkey", (F.col("b.xmax") - F.col("b.xmin")).alias("w"), (F.col("b.ymax") - F.col("b.ymin")).alias("h"))


@query("st_flipcoordinates", f"SELECT c_custkey, y AS x, x AS y FROM {C}")
def st_flipcoordinates(s, d):
    return D.customers(s, d).select("c_custkey", N.flip(F.col("geom")).alias("p")).select("c_custkey", "p.x", "p.y")


@query("st_precisionreduce", f"SELECT c_custkey, floor(x * 1 + 0.5::DOUBLE) / 1 AS x, floor(y * 1 + 0.5::DOUBLE) / 1 AS y FROM {C}")
def st_precisionreduce(s, d):
    return D.customers(s, d).select("c_custkey", N.precision(F.col("geom"), 0).alias("p")).select("c_custkey", "p.x", "p.y")


@query("st_collections", "SELECT s_suppkey, 2 AS parts, s_suppkey::DOUBLE AS x1, 'ST_MultiPoint' AS kind FROM supplier")
def st_collections(s, d):
    k = F.col("s_suppkey")
    g = D.suppliers(s, d).select("s_suppkey", st("ST_GeomFromText", F.concat(F.lit("MULTIPOINT ((0 0), ("), k.cast("string"), F.lit(" 1))"))).alias("g"))
    return g.select("s_suppkey", st("ST_NumGeometries", F.col("g")).alias("parts"), st("ST_X", st("ST_GeometryN", F.col("g"), F.lit(1))).alias("x1"), st("ST_GeometryType", F.col("g")).alias("kind"))


@query("st_rings", "SELECT s_suppkey, 1 AS holes, 16.0::DOUBLE AS shell, 4.0::DOUBLE AS hole, true AS closed FROM supplier")
def st_rings(s, d):
    x = lambda v: F.concat((F.col("s_suppkey") + v).cast("string"))
    ring = lambda a, b: F.concat(F.lit("("), F.concat_ws(", ", *(F.concat(x(i), F.lit(f" {j}")) for i, j in ((a, a), (a, b), (b, b), (b, a), (a, a)))), F.lit(")"))
    g = D.suppliers(s, d).select("s_suppkey", st("ST_GeomFromText", F.concat(F.lit("POLYGON ("), ring(0, 4), F.lit(", "), ring(1, 2), F.lit(")"))).alias("g"))
    return g.select("s_suppkey", st("ST_NumInteriorRings", F.col("g")).alias("holes"), st("ST_Length", st("ST_ExteriorRing", F.col("g"))).alias("shell"), st("ST_Length", st("ST_InteriorRingN", F.col("g"), F.lit(0))).alias("hole"), st("ST_IsClosed", F.col("g")).alias("closed"))


# --- measures ----------------------------------------------------------------------


@query("st_distance_points", f"SELECT c_custkey, s_suppkey, round(sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)), 6) AS distance FROM {C} c JOIN {S} s ON c.c_nationkey = s.s_suppkey % 25")
def st_distance_points(s, d):
    """Customers and suppliers of a nation: rows that share place and nation are measured as one and spelled out behind the join."""
    c = J.bundled(D.customers(s, d).select("c_custkey", "c_nationkey", "geom"), "geom", "c_nationkey").alias("c")
    u = J.bundled(D.suppliers(s, d).select("s_suppkey", (F.col("s_suppkey") % 25).alias("nation"), "geom"), "geom", "nation").alias("u")
    j = c.join(u, F.col("c_nationkey") == F.col("nation")).select(F.col("c._rows").alias("customers"), F.col("u._rows").alias("suppliers"), _r(N.distance(F.col("c.geom"), F.col("u.geom"))).alias("distance"))
    j = j.withColumn("c", F.explode("customers")).withColumn("u", F.explode("suppliers"))
    return j.select("c.c_custkey", "u.s_suppkey", "distance")


@query("st_azimuth_points", f"SELECT c_custkey, round(CASE WHEN a < 0 THEN a + {2 * math.pi!r}::DOUBLE ELSE a END, 6) AS azimuth FROM (SELECT c_custkey, atan2(0.05::DOUBLE - x, 0.05::DOUBLE - y) AS a FROM {C})")
def st_azimuth_points(s, d):
    return D.customers(s, d).select("c_custkey", _r(N.azimuth(F.col("geom"), N.point(F.lit(0.05), F.lit(0.05)))).alias("azimuth"))


@query("st_centroid_rect", f"SELECT p_partkey, round((x0 + x1) / 2, 6) AS x, round((y0 + y1) / 2, 6) AS y FROM {PA}")
def st_centroid_rect(s, d):
    b = F.col("geom")
    g = D.parts(s, d).select("p_partkey", st("ST_Centroid", st("ST_PolygonFromEnvelope", b["xmin"], b["ymin"], b["xmax"], b["ymax"])).alias("g"))
    return g.select("p_partkey", _r(st("ST_X", F.col("g"))).alias("x"), _r(st("ST_Y", F.col("g"))).alias("y"))


@query("rect_measures", f"SELECT p_partkey, round((x1 - x0) * (y1 - y0), 6) AS area, round(2 * (x1 - x0 + y1 - y0), 6) AS perimeter FROM {PA}")
def rect_measures(s, d):
    return D.parts(s, d).select("p_partkey", _r(N.rect_area(F.col("geom"))).alias("area"), _r(N.rect_perimeter(F.col("geom"))).alias("perimeter"))


@query("st_minimumboundingradius_rect", f"SELECT p_partkey, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 2, 6) AS radius FROM {PA}")
def st_minimumboundingradius_rect(s, d):
    b = F.col("geom")
    g = st("ST_MinimumBoundingRadius", st("ST_PolygonFromEnvelope", b["xmin"], b["ymin"], b["xmax"], b["ymax"]))
    return D.parts(s, d).select("p_partkey", g.alias("c")).select("p_partkey", _r(F.col("c.radius")).alias("radius"))


@query("st_interpolate", f"SELECT s_suppkey, round(x + 2.5::DOUBLE, 6) AS x_quarter, 5.0::DOUBLE AS middle FROM {S}")
def st_interpolate(s, d):
    x, y = F.col("geom.x"), F.col("geom.y")
    line = st("ST_LineStringFromText", F.concat_ws(",", x.cast("string"), y.cast("string"), (x + 10).cast("string"), y.cast("string")), F.lit(","))
    g = D.suppliers(s, d).select("s_suppkey", line.alias("g"))
    return g.select("s_suppkey", _r(st("ST_X", st("ST_LineInterpolatePoint", F.col("g"), F.lit(0.25)))).alias("x_quarter"), _r(st("ST_Length", st("ST_LineSubstring", F.col("g"), F.lit(0.25), F.lit(0.75)))).alias("middle"))


# --- predicates, as filters ----------------------------------------------------------

_PAIR = f"{NA} a CROSS JOIN (SELECT * FROM {PA}) b"
_MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_INNER = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_COVER = "a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1"
_COVERED = "b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1"


def _rect_join(predicate: str, how: str = "inner"):
    def run(s, d):
        return J.spatial_join(D.nations(s, d), D.parts(s, d), predicate, how=how).select("n_nationkey", "p_partkey")

    return run


for _name, _predicate, _sql in (
    ("intersects_rect_rect", "intersects", _MEET),
    ("overlaps_rect_rect", "overlaps", f"{_INNER} AND NOT ({_COVER}) AND NOT ({_COVERED})"),
    ("contains_rect_rect", "contains", _COVER),
    ("within_rect_rect", "within", _COVERED),
    ("touches_rect_rect", "touches", f"{_MEET} AND NOT ({_INNER})"),
):
    query(_name, f"SELECT n_nationkey, p_partkey FROM {_PAIR} WHERE {_sql}")(_rect_join(_predicate))


@query("equals_rect_rect", f"SELECT a.p_partkey AS p1, b.p_partkey AS p2 FROM {PA} a JOIN {PA} b ON a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1")
def equals_rect_rect(s, d):
    p = D.parts(s, d).select(F.col("p_partkey").alias("p1"), "geom")
    return J.spatial_join(p, p.withColumnRenamed("p1", "p2"), "equals").select("p1", "p2")


@query("covers_boundary_point", f"SELECT n_nationkey, count(*) AS n FROM {NA} a JOIN {C} c ON (c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1) AND (c.x = x0 OR c.x = x1 OR c.y = y0 OR c.y = y1) GROUP BY n_nationkey")
def covers_boundary_point(s, d):
    j = J.spatial_join(D.nations(s, d), D.customers(s, d), "contains")
    a, p = F.col("geom"), F.col("geom_right")
    edge = (p["x"] == a["xmin"]) | (p["x"] == a["xmax"]) | (p["y"] == a["ymin"]) | (p["y"] == a["ymax"])
    return j.where(edge).groupBy("n_nationkey").agg(F.count("*").alias("n"))


def _wkb_rects(df: DataFrame) -> DataFrame:
    b = F.col("geom")
    return df.withColumn("geom", st("ST_PolygonFromEnvelope", b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


for _name, _predicate, _sql in (("wkb_intersects", "intersects", _MEET), ("wkb_touches", "touches", f"{_MEET} AND NOT ({_INNER})"), ("wkb_overlaps", "overlaps", f"{_INNER} AND NOT ({_COVER}) AND NOT ({_COVERED})"), ("wkb_contains", "contains", _COVER)):

    def _run(s, d, predicate=_predicate):
        return J.spatial_join(_wkb_rects(D.nations(s, d)), _wkb_rects(D.parts(s, d)), predicate).select("n_nationkey", "p_partkey")

    query(_name, f"SELECT n_nationkey, p_partkey FROM {_PAIR} WHERE {_sql}")(_run)


# --- joins -----------------------------------------------------------------------------

_IN = "p.x BETWEEN a.x0 AND a.x1 AND p.y BETWEEN a.y0 AND a.y1"


@query("range_join_contains", f"SELECT n_nationkey, count(*) AS n FROM {NA} a JOIN {IT} p ON {_IN} GROUP BY n_nationkey")
def range_join_contains(s, d):
    """How many line items lie in each nation's rectangle: the flagship."""
    return J.count_by_key(J.spatial_join(D.nations(s, d), D.items(s, d), "contains"), "n_nationkey").withColumnRenamed("count", "n")


@query("range_join_pairs", f"SELECT p_partkey, c_custkey FROM {PA} a JOIN {C} p ON {_IN}")
def range_join_pairs(s, d):
    return J.spatial_join(D.parts(s, d), D.customers(s, d), "contains").select("p_partkey", "c_custkey")


@query("range_join_within", f"SELECT c_custkey, n_nationkey FROM {NA} a JOIN {C} p ON {_IN}")
def range_join_within(s, d):
    return J.spatial_join(D.customers(s, d), D.nations(s, d), "within").select("c_custkey", "n_nationkey")


@query("range_join_extra_condition", f"SELECT n_nationkey, c_custkey FROM {NA} a JOIN {C} p ON {_IN} AND p.c_nationkey = a.n_nationkey AND p.c_acctbal > 0")
def range_join_extra_condition(s, d):
    j = J.spatial_join(D.nations(s, d), D.customers(s, d).where("c_acctbal > 0"), "contains")
    return j.where("c_nationkey = n_nationkey").select("n_nationkey", "c_custkey")


def _distance(op: str) -> str:
    return f"SELECT c_custkey, s_suppkey FROM {C} c JOIN {S} s ON sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) {op}"


@query("distance_join_le", _distance("<= 10"))
def distance_join_le(s, d):
    return J.distance_join(D.customers(s, d), D.suppliers(s, d), 10.0).select("c_custkey", "s_suppkey")


@query("distance_join_lt", _distance("< 10"))
def distance_join_lt(s, d):
    return J.distance_join(D.customers(s, d), D.suppliers(s, d), 10.0, strict=True).select("c_custkey", "s_suppkey")


@query("distance_join_row_radius", _distance("<= s.r"))
def distance_join_row_radius(s, d):
    return J.distance_join(D.suppliers(s, d), D.customers(s, d), "r").select("c_custkey", "s_suppkey")


@query("distance_self_join", f"SELECT count(*) AS n FROM {C} a JOIN {C} b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5")
def distance_self_join(s, d):
    c = D.customers(s, d)
    return J.distance_join(c, c.select(F.col("c_custkey").alias("other"), "geom"), 5.0).agg(F.count("*").alias("n"))


@query("distance_rect_point", f"SELECT n_nationkey, s_suppkey FROM {NA} a JOIN {S} p ON sqrt(greatest(a.x0 - p.x, 0, p.x - a.x1) ** 2 + greatest(a.y0 - p.y, 0, p.y - a.y1) ** 2) <= 3")
def distance_rect_point(s, d):
    return J.distance_join(D.nations(s, d), D.suppliers(s, d), 3.0).select("n_nationkey", "s_suppkey")


@query("join_count_by_key", f"SELECT p_partkey, count(*) AS count FROM {PA} a JOIN {C} p ON {_IN} GROUP BY p_partkey")
def join_count_by_key(s, d):
    return J.count_by_key(J.spatial_join(D.parts(s, d), D.customers(s, d), "contains"), "p_partkey")


@query("join_collect_by_key", f"SELECT n_nationkey, array_to_string(list(s_suppkey ORDER BY s_suppkey), ',') AS suppliers FROM {NA} a JOIN {S} p ON {_IN} GROUP BY n_nationkey")
def join_collect_by_key(s, d):
    j = J.collect_by_key(J.spatial_join(D.nations(s, d), D.suppliers(s, d), "contains"), ["n_nationkey"], "s_suppkey")
    return j.select("n_nationkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("suppliers"))


@query("spatial_semi_join", f"SELECT c_custkey FROM {C} p WHERE EXISTS (SELECT 1 FROM {PA} a WHERE {_IN})")
def spatial_semi_join(s, d):
    return J.spatial_join(D.customers(s, d), D.parts(s, d), "within", how="left_semi").select("c_custkey")


@query("spatial_anti_join", f"SELECT c_custkey FROM {C} p WHERE NOT EXISTS (SELECT 1 FROM {PA} a WHERE {_IN})")
def spatial_anti_join(s, d):
    return J.spatial_join(D.customers(s, d), D.parts(s, d), "within", how="left_anti").select("c_custkey")


@query("spatial_left_join", f"SELECT c_custkey, n_nationkey FROM {C} p LEFT JOIN {NA} a ON {_IN}")
def spatial_left_join(s, d):
    return J.spatial_join(D.customers(s, d), D.nations(s, d), "within", how="left").select("c_custkey", "n_nationkey")


@query("legacy_touches_join", f"SELECT n_nationkey, p_partkey FROM {_PAIR} WHERE {_MEET}")
def legacy_touches_join(s, d):
    return J.spatial_join(D.nations(s, d), D.parts(s, d), "touches", compat=True).select("n_nationkey", "p_partkey")


@query("range_query_covered", f"SELECT c_custkey FROM {C} WHERE x BETWEEN -60 AND 60 AND y BETWEEN -30 AND 30")
def range_query_covered(s, d):
    return J.range_query(D.customers(s, d), (-60.0, -30.0, 60.0, 30.0)).select("c_custkey")


@query("range_query_intersects", f"SELECT p_partkey FROM {PA} WHERE x0 <= 60 AND x1 >= -60 AND y0 <= 30 AND y1 >= -30")
def range_query_intersects(s, d):
    return J.range_query(D.parts(s, d), (-60.0, -30.0, 60.0, 30.0), boundary=True).select("p_partkey")


@query("knn_query_k", f"SELECT c_custkey, round(sqrt(x * x + y * y), 6) AS distance FROM {C} ORDER BY sqrt(x * x + y * y), c_custkey LIMIT 10")
def knn_query_k(s, d):
    return J.knn_query(D.customers(s, d), 0.0, 0.0, 10, tie="c_custkey").select("c_custkey", _r(F.col("distance")).alias("distance"))


@query(
    "knn_join_k",
    f"SELECT query_id, object_id, distance, rank FROM (SELECT s_suppkey AS query_id, c_custkey AS object_id, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS INTEGER) AS rank FROM (SELECT s_suppkey, c_custkey, sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) AS d FROM {S} s CROSS JOIN {C} c)) WHERE rank <= 5",
)
def knn_join_k(s, d):
    return J.knn_join(D.suppliers(s, d), D.customers(s, d), 5, "s_suppkey", "c_custkey").withColumn("distance", _r(F.col("distance")))


@query("colocation_counts", " UNION ALL ".join(f"SELECT {r}::DOUBLE AS radius, count(*) AS n FROM {S} s JOIN {C} c ON sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) <= {r}" for r in (2, 4, 8)))
def colocation_counts(s, d):
    """Pairs of two kinds within growing radii: one join at the largest, counted cumulatively."""
    j = J.distance_join(D.suppliers(s, d), D.customers(s, d), 8.0)
    j = j.select(N.distance(F.col("geom"), F.col("geom_right")).alias("d"))
    row = j.agg(*(F.count(F.when(F.col("d") <= r, 1)).alias(f"n{r}") for r in (2, 4, 8)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(float(r)).alias("radius"), F.col(f"n{r}").alias("n")) for r in (2, 4, 8)))).alias("k")).select("k.*")


# --- aggregates ------------------------------------------------------------------------


@query("st_envelope_aggr", f"SELECT c_nationkey, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {C} GROUP BY c_nationkey")
def st_envelope_aggr(s, d):
    return A.envelope_aggregate(D.customers(s, d), "geom", "c_nationkey")


@query("st_intersection_aggr_rects", f"SELECT k, CASE WHEN x0 <= x1 AND y0 <= y1 THEN round((x1 - x0) * (y1 - y0), 6) END AS area FROM (SELECT p_partkey % 50 AS k, max(x0) AS x0, max(y0) AS y0, min(x1) AS x1, min(y1) AS y1 FROM (SELECT p_partkey, 0 - p_size::DOUBLE AS x0, 0 - p_size::DOUBLE AS y0, 1 + p_size::DOUBLE AS x1, p_size::DOUBLE AS y1 FROM part) GROUP BY p_partkey % 50)")
def st_intersection_aggr_rects(s, d):
    z = F.col("p_size").cast("double")
    p = D.table(s, d, "part").select((F.col("p_partkey") % 50).alias("k"), N.rectangle(0 - z, 0 - z, 1 + z, z).alias("geom"))
    return A.rect_intersection_aggregate(p, "geom", "k").select("k", _r(N.rect_area(F.col("geom"))).alias("area"))


@query("st_union_aggr_nations", f"SELECT n_regionkey, round(sum((x1 - x0) * (y1 - y0)), 6) AS area FROM {NA} GROUP BY n_regionkey")
def st_union_aggr_nations(s, d):
    u = A.union_aggregate(_wkb_rects(D.nations(s, d)), "geom", "n_regionkey")
    return u.select("n_regionkey", _r(st("ST_Area", F.col("geom"))).alias("area"))


@query("stats_analyze", f"SELECT count(*) AS count, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {IT}")
def stats_analyze(s, d):
    return A.analyze(D.items(s, d))


@query("count_without_duplicates", f"SELECT count(*) AS count FROM (SELECT DISTINCT x, y FROM {IT})")
def count_without_duplicates(s, d):
    return A.count_distinct(D.items(s, d))


# --- raster ----------------------------------------------------------------------------


def _list(expr: str) -> str:
    return f"list_transform(range(1, len(a) + 1), lambda i: {expr})"


def _round2(e: str) -> str:
    return f"floor(({e}) * 100 + 0.5::DOUBLE) / 100"


_X, _Y = "a[i]", "b[i]"
_NX, _NY = "CASE WHEN a[i] = 0 THEN -1 ELSE a[i] END", "CASE WHEN b[i] = 0 THEN -1 ELSE b[i] END"
_RASTER: list[tuple[str, Callable[[], Column], str]] = [
    ("rs_addbands", lambda: R.rs_addbands("a", "b"), _list(f"{_X} + {_Y}")),
    ("rs_subtractbands", lambda: R.rs_subtractbands("a", "b"), _list(f"{_Y} - {_X}")),
    ("rs_multiplybands", lambda: R.rs_multiplybands("a", "b"), _list(f"{_X} * {_Y}")),
    ("rs_dividebands", lambda: R.rs_dividebands("a", "b"), _list(f"CASE WHEN {_Y} <> 0 THEN {_round2(f'{_X} / {_Y}')} END")),
    ("rs_multiplyfactor", lambda: R.rs_multiplyfactor("a", 3), _list(f"{_X} * 3")),
    ("rs_modulo", lambda: R.rs_modulo("a", 7), _list(f"{_X} - trunc({_X} / 7) * 7")),
    ("rs_squareroot", lambda: R.rs_squareroot(F.transform("a", F.abs)), _list(_round2(f"sqrt(abs({_X}))"))),
    ("rs_bitwiseand", lambda: R.rs_bitwiseand("a", "b"), _list(f"({_X}::INTEGER & {_Y}::INTEGER)::DOUBLE")),
    ("rs_bitwiseor", lambda: R.rs_bitwiseor("a", "b"), _list(f"({_X}::INTEGER | {_Y}::INTEGER)::DOUBLE")),
    ("rs_logicaldifference", lambda: R.rs_logicaldifference("a", "b"), _list(f"CASE WHEN {_X} <> {_Y} THEN {_X} ELSE 0 END")),
    ("rs_logicalover", lambda: R.rs_logicalover("a", "b"), _list(f"CASE WHEN {_X} <> 0 THEN {_X} ELSE {_Y} END")),
    ("rs_normalizeddifference", lambda: R.rs_normalizeddifference("a", "b"), _list(f"CASE WHEN {_NY} + {_NX} <> 0 THEN {_round2(f'({_NY} - {_NX}) / ({_NY} + {_NX})')} END")),
    ("rs_greaterthan", lambda: R.rs_greaterthan("a", 10), _list(f"CASE WHEN {_X} > 10 THEN 1 ELSE 0 END::DOUBLE")),
    ("rs_greaterthanequal", lambda: R.rs_greaterthanequal("a", 10), _list(f"CASE WHEN {_X} >= 10 THEN 1 ELSE 0 END::DOUBLE")),
    ("rs_lessthan", lambda: R.rs_lessthan("a", 10), _list(f"CASE WHEN {_X} < 10 THEN 1 ELSE 0 END::DOUBLE")),
    ("rs_lessthanequal", lambda: R.rs_lessthanequal("a", 10), _list(f"CASE WHEN {_X} <= 10 THEN 1 ELSE 0 END::DOUBLE")),
    ("rs_normalize", lambda: R.rs_normalize(F.transform("a", F.abs)), "list_transform(range(1, len(a) + 1), lambda i: trunc(abs(a[i]) / (list_max(list_transform(a, lambda v: abs(v))) / 255)))"),
    ("rs_fetchregion", lambda: R.rs_fetchregion("a", [1, 2, 3, 4], [8, 8]), "list_transform([11, 12, 13, 19, 20, 21, 27, 28, 29], lambda i: a[i])"),
    ("rs_getband", lambda: R.rs_getband("a", 2, 4), "a[17:32]"),
    ("rs_mode", lambda: R.rs_mode(F.transform("a", lambda v: F.pmod(v, F.lit(4.0)))), "(SELECT list(v ORDER BY v) FROM (SELECT v, count(*) AS n, max(count(*)) OVER () AS m FROM unnest(list_transform(a, lambda x: fmod(fmod(x, 4) + 4, 4))) AS t(v) GROUP BY v) WHERE n = m)"),
    ("rs_array", lambda: R.rs_array(3, F.col("vec_id")), "[vec_id::DOUBLE, vec_id::DOUBLE, vec_id::DOUBLE]"),
]
for _name, _column, _sql in _RASTER:

    def _run(s, d, column=_column):
        # a digest of each band: its length, its sum and its values as text
        v = D.bands(s, d).select("vec_id", column().alias("v"))
        whole = F.array_join(F.transform("v", lambda x: F.coalesce(F.round(x * 100).cast("long").cast("string"), F.lit("-"))), ",")
        return v.select("vec_id", F.size("v").alias("n"), whole.alias("v"))

    query(_name, f"SELECT vec_id, len(v)::INTEGER AS n, array_to_string(list_transform(v, lambda x: coalesce(CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR), '-')), ',') AS v FROM (SELECT vec_id, {_sql} AS v FROM {BA})")(_run)


@query("rs_count_mean", f"SELECT vec_id, len(list_filter(a, lambda x: x = 10))::INTEGER AS n, {_round2('list_sum(a) / len(a)')} AS mean FROM {BA}")
def rs_count_mean(s, d):
    return D.bands(s, d).select("vec_id", R.rs_count("a", 10).alias("n"), R.rs_mean("a").alias("mean"))


@query("rs_html", "SELECT vec_id, '<img src=\"data:image/png;base64,' || vec_id || '\" width=\"300\" />' AS html FROM embeddings")
def rs_html(s, d):
    return D.bands(s, d).select("vec_id", R.rs_html(F.col("vec_id").cast("string"), 300).alias("html"))


# --- geohashes, cells, pixels ------------------------------------------------------------


def _hash_sql(length: int) -> tuple[str, int, int]:
    bits, out = 5 * length, []
    xb, yb = (bits + 1) // 2, bits // 2
    for k in range(length):
        v = []
        for b in range(5):
            n = 5 * k + b
            src, sh = ("cx", xb - 1 - n // 2) if n % 2 == 0 else ("cy", yb - 1 - n // 2)
            v.append(f"(({src} >> {sh}) & 1) * {1 << (4 - b)}")
        out.append(f"substr('{N.BASE32}', (1 + {' + '.join(v)})::INTEGER, 1)")
    return " || ".join(out), xb, yb


_GH, _XB, _YB = _hash_sql(8)


@query("geohash_encode", f"SELECT c_custkey, {_GH} AS geohash FROM (SELECT c_custkey, floor((x + 180) / 360 * {1 << _XB})::BIGINT AS cx, floor((y + 90) / 180 * {1 << _YB})::BIGINT AS cy FROM {C})")
def geohash_encode(s, d):
    return D.customers(s, d).select("c_custkey", N.geohash(F.col("geom"), 8).alias("geohash"))


@query("geohash_wkb", ORACLES["geohash_encode"])
def geohash_wkb(s, d):
    return D.customers(s, d).select("c_custkey", st("ST_GeoHash", st("ST_Point", F.col("geom.x"), F.col("geom.y")), F.lit(8)).alias("geohash"))


@query("geohash_decode_bbox", f"SELECT c_custkey, floor((x + 180) / 360 * 1024) * 360 / 1024 - 180 AS xmin, floor((y + 90) / 180 * 1024) * 180 / 1024 - 90 AS ymin FROM {C}")
def geohash_decode_bbox(s, d):
    g = D.customers(s, d).select("c_custkey", N.geohash_box(N.geohash(F.col("geom"), 4)).alias("b"))
    return g.select("c_custkey", "b.xmin", "b.ymin")


def _interleave(bits: int) -> str:
    return " + ".join(f"(((cx >> {k}) & 1) << {2 * k}) + (((cy >> {k}) & 1) << {2 * k + 1})" for k in range(bits))


_CELLS = f"(SELECT c_custkey, floor((x + 180) / 360 * 256)::BIGINT AS cx, floor((y + 90) / 180 * 256)::BIGINT AS cy FROM {C})"


def _cells(s, d) -> DataFrame:
    p = F.col("geom")
    return D.customers(s, d).select("c_custkey", F.floor((p["x"] + 180) / 360 * 256).cast("long").alias("cx"), F.floor((p["y"] + 90) / 180 * 256).cast("long").alias("cy"))


@query("morton_order", f"SELECT c_custkey, {_interleave(8)} AS code FROM {_CELLS}")
def morton_order(s, d):
    return _cells(s, d).select("c_custkey", N.morton(F.col("cx"), F.col("cy"), 8).alias("code"))


@query("quadkey", f"SELECT c_custkey, {' || '.join(f'(((cx >> {k}) & 1) + 2 * ((cy >> {k}) & 1))::VARCHAR' for k in reversed(range(8)))} AS key FROM {_CELLS}")
def quadkey(s, d):
    return _cells(s, d).select("c_custkey", N.quadkey(F.col("cx"), F.col("cy"), 8).alias("key"))


@query("hilbert_bijection", "SELECT 65536::BIGINT AS cells, 65536::BIGINT AS codes, 0::BIGINT AS lowest, 65535::BIGINT AS highest, 65535::BIGINT AS steps")
def hilbert_bijection(s, d):
    """Every cell of a 256 x 256 grid has its own code, and neighbours on the curve are neighbours in the plane."""
    grid = s.range(65536).select((F.col("id") % 256).alias("cx"), F.floor(F.col("id") / 256).alias("cy"))
    h = grid.select("cx", "cy", P.hilbert(F.col("cx"), F.col("cy"), 8).alias("h"))
    nxt = h.select((F.col("h") - 1).alias("h"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    near = h.join(nxt, "h", "left").withColumn("near", (F.abs(F.col("cx") - F.col("nx")) + F.abs(F.col("cy") - F.col("ny")) == 1).cast("long"))
    return near.agg(F.count("*").alias("cells"), F.countDistinct("h").alias("codes"), F.min("h").alias("lowest"), F.max("h").alias("highest"), F.sum("near").alias("steps"))


_PIXELS = f"(SELECT least(floor((x + 180) / 360 * 64), 63)::INTEGER AS px, least(floor((y + 90) / 180 * 32), 31)::INTEGER AS py FROM {IT})"


@query("pixel_counts", f"SELECT px, py, count(*)::DOUBLE AS weight FROM {_PIXELS} GROUP BY px, py")
def pixel_counts(s, d):
    return V.weigh(V.pixelize(D.items(s, d), 64, 32, WORLD))


@query("st_tilename", f"SELECT '2-' || (px * 4 // 64) || '-' || (3 - py * 4 // 32) AS tile, count(*) AS n FROM {_PIXELS} GROUP BY 1")
def st_tilename(s, d):
    px = N.pixel(F.col("geom"), 64, 32, WORLD)
    return D.items(s, d).select(N.tile_name(px, 2).alias("tile")).groupBy("tile").agg(F.count("*").alias("n"))


def _ladder(v: str) -> str:
    from geoloom.viz.functions import ALPHA, STEPS, argb

    steps = " ".join(f"WHEN {v} < {top} THEN {argb(*rgb, ALPHA)}" for top, rgb in STEPS[:-1])
    return f"CASE WHEN {v} = 0 THEN {argb(255, 255, 255, 0)} {steps} ELSE {argb(*STEPS[-1][1], ALPHA)} END::INTEGER"


@query("st_colorize", f"WITH w AS (SELECT px, py, count(*)::DOUBLE AS weight FROM {_PIXELS} GROUP BY px, py) SELECT px, py, {_ladder('(weight * 255.0::DOUBLE / (SELECT max(weight) FROM w))')} AS color FROM w")
def st_colorize(s, d):
    return V.colorize(pixel_counts(s, d)).select("px", "py", "color")


_BLUR = " UNION ALL ".join(f"SELECT px + {x} AS px, py + {y} AS py, weight / 9 AS weight FROM w" for x in (-1, 0, 1) for y in (-1, 0, 1))


@query("heatmap_box_blur", f"WITH w AS (SELECT px, py, count(*)::DOUBLE AS weight FROM {_PIXELS} GROUP BY px, py) SELECT px, py, round(sum(weight), 6) AS weight FROM ({_BLUR}) WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 31 GROUP BY px, py")
def heatmap_box_blur(s, d):
    return V.convolve(pixel_counts(s, d), V.box_blur(1), 64, 32).select("px", "py", _r(F.col("weight")).alias("weight"))


# --- the host's operators over spatial data ----------------------------------------------

_TILES = f"(SELECT c_nationkey, c_acctbal, floor(x / 60)::BIGINT AS cx, floor(y / 30)::BIGINT AS cy FROM {C})"


def _tiles(s, d) -> DataFrame:
    p = F.col("geom")
    return D.customers(s, d).select("c_nationkey", "c_acctbal", N.cell(p["x"], 60).alias("cx"), N.cell(p["y"], 30).alias("cy"))


@query("cube_by_cell", f"SELECT cx, cy, count(*) AS n FROM {_TILES} GROUP BY CUBE (cx, cy)")
def cube_by_cell(s, d):
    return _tiles(s, d).cube("cx", "cy").agg(F.count("*").alias("n"))


@query("rollup_by_cell", f"SELECT cx, cy, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM {_TILES} GROUP BY ROLLUP (cx, cy)")
def rollup_by_cell(s, d):
    return _tiles(s, d).rollup("cx", "cy").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("grouping_sets_cell", f"SELECT cx, cy, count(*) AS n FROM {_TILES} GROUP BY GROUPING SETS ((cx), (cy), ())")
def grouping_sets_cell(s, d):
    return _tiles(s, d).groupingSets([["cx"], ["cy"], []], "cx", "cy").agg(F.count("*").alias("n")).select("cx", "cy", "n")


@query("rank_by_distance", f"SELECT c_custkey, rank FROM (SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY x * x + y * y) AS INTEGER) AS rank FROM {C}) WHERE rank <= 3")
def rank_by_distance(s, d):
    p = F.col("geom")
    w = Window.partitionBy("c_nationkey").orderBy(p["x"] * p["x"] + p["y"] * p["y"])
    return D.customers(s, d).select("c_custkey", F.rank().over(w).alias("rank")).where("rank <= 3")


@query("running_path_length", f"SELECT o_orderkey, round(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0), 6) AS step FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM {OR} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))")
def running_path_length(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = D.orders(s, d).withColumn("before", F.lag("geom").over(w))
    return o.select("o_orderkey", _r(F.coalesce(N.distance(F.col("geom"), F.col("before")), F.lit(0.0))).alias("step"))


def _cell_sets(s, d) -> tuple[DataFrame, DataFrame]:
    cut = lambda df: df.select(N.cell(F.col("geom.x"), 10).alias("cx"), N.cell(F.col("geom.y"), 10).alias("cy"))
    return cut(D.customers(s, d)), cut(D.suppliers(s, d))


_CUT = "floor(x / 10)::BIGINT AS cx, floor(y / 10)::BIGINT AS cy"


@query("union_cells", f"SELECT {_CUT} FROM {C} UNION SELECT {_CUT} FROM {S}")
def union_cells(s, d):
    a, b = _cell_sets(s, d)
    return a.union(b).distinct()


@query("intersect_cells", f"SELECT {_CUT} FROM {C} INTERSECT SELECT {_CUT} FROM {S}")
def intersect_cells(s, d):
    a, b = _cell_sets(s, d)
    return a.intersect(b)


@query("except_cells", f"SELECT {_CUT} FROM {C} EXCEPT SELECT {_CUT} FROM {S}")
def except_cells(s, d):
    a, b = _cell_sets(s, d)
    return a.subtract(b)


@query("scalar_subquery_cell", f"SELECT c_custkey FROM {C} WHERE x > (SELECT avg(x) FROM {S})")
def scalar_subquery_cell(s, d):
    mean = D.suppliers(s, d).agg(F.avg("geom.x").alias("m"))
    return D.customers(s, d).join(F.broadcast(mean)).where(F.col("geom.x") > F.col("m")).select("c_custkey")


@query("asof_last_position", "SELECT event_id, o_orderkey FROM (SELECT e.event_id, arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS o_orderkey FROM events e JOIN orders o ON e.user_id = o.o_custkey AND o.o_orderdate <= e.ts GROUP BY e.event_id)")
def asof_last_position(s, d):
    e, o = D.table(s, d, "events"), D.table(s, d, "orders")
    both = e.select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("struct<d:timestamp,o:bigint>").alias("at"))
    both = both.unionByName(o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), F.struct(F.col("o_orderdate").cast("timestamp").alias("d"), F.col("o_orderkey").alias("o")).alias("at")))
    w = Window.partitionBy("k").orderBy("t", "side", "at.o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.last("at", ignorenulls=True).over(w)).where("side = 1 and last is not null").select("event_id", F.col("last.o").alias("o_orderkey"))


@query("tumbling_geofence", f"SELECT n_nationkey, count(*) AS n FROM {NA} a JOIN (SELECT ((user_id * 37) % 3600)::DOUBLE / 10.0::DOUBLE - 180::DOUBLE AS x, ((user_id * 91) % 1800)::DOUBLE / 10.0::DOUBLE - 90::DOUBLE AS y FROM events) p ON {_IN} GROUP BY n_nationkey")
def tumbling_geofence(s, d):
    k = F.col("user_id")
    e = D.table(s, d, "events").select("ts", N.point((k * 37 % 3600).cast("double") / 10.0 - 180.0, (k * 91 % 1800).cast("double") / 10.0 - 90.0).alias("geom"))
    return G.fence(e, D.nations(s, d), 30.0).groupBy(F.col("fence.n_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))


@query("hourly_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(s, d):
    g = G.windowed_counts(D.table(s, d, "events"), "ts", ["event_type"], "1 hour")
    return g.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("session_users", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events) WHERE f = 1 GROUP BY user_id")
def session_users(s, d):
    return G.sessions(D.table(s, d, "events"), "ts", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("sessions"))


# --- without SQL: kernels and pictures -----------------------------------------------------


def _ngons(s, d) -> DataFrame:
    """A regular polygon of 3 to 12 corners for each supplier."""
    n = F.col("s_suppkey") % 10 + 3
    corner = lambda i: F.concat_ws(",", (F.col("geom.x") + F.col("r") * F.cos(2 * math.pi * i / n)).cast("string"), (F.col("geom.y") + F.col("r") * F.sin(2 * math.pi * i / n)).cast("string"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), corner), ",")
    return D.suppliers(s, d).select("s_suppkey", "r", st("ST_PolygonFromText", text, F.lit(",")).alias("geom"))


@query("st_area_ngon", "SELECT s_suppkey, round(r * r * n / 2 * sin(2 * pi() / n), 4) AS area FROM (SELECT s_suppkey, (1 + s_suppkey % 20)::DOUBLE AS r, (s_suppkey % 10 + 3)::DOUBLE AS n FROM supplier)")
def st_area_ngon(s, d):
    return _ngons(s, d).select("s_suppkey", _r(st("ST_Area", F.col("geom")), 4).alias("area"))


@query("st_intersection_rects", f"SELECT n_nationkey, p_partkey, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS area FROM {_PAIR} WHERE {_MEET}")
def st_intersection_rects(s, d):
    j = J.spatial_join(_wkb_rects(D.nations(s, d)), _wkb_rects(D.parts(s, d)), "intersects")
    return j.select("n_nationkey", "p_partkey", _r(st("ST_Area", st("ST_Intersection", F.col("geom"), F.col("geom_right")))).alias("area"))


@query("st_buffer_point", "SELECT s_suppkey, round(16 * r * r * sin(2 * pi() / 32), 4) AS area FROM (SELECT s_suppkey, (1 + s_suppkey % 20)::DOUBLE AS r FROM supplier)")
def st_buffer_point(s, d):
    p = F.col("geom")
    return D.suppliers(s, d).select("s_suppkey", _r(st("ST_Area", st("ST_Buffer", st("ST_Point", p["x"], p["y"]), F.col("r"))), 4).alias("area"))


@query("st_subdivide_area", "SELECT s_suppkey, true AS whole, true AS small FROM supplier")
def st_subdivide_area(s, d):
    g = _ngons(s, d).select("s_suppkey", st("ST_Area", F.col("geom")).alias("whole"), F.explode(st("ST_SubDivide", F.col("geom"), F.lit(6))).alias("part"))
    out = g.withColumn("a", st("ST_Area", F.col("part"))).withColumn("n", st("ST_NPoints", F.col("part"))).groupBy("s_suppkey").agg(F.max("whole").alias("w"), F.sum("a").alias("p"), F.max("n").alias("n"))
    return out.select("s_suppkey", (F.abs(F.col("w") - F.col("p")) < 1e-6).alias("whole"), (F.col("n") <= 6).alias("small"))


@query("st_makevalid_bowtie", "SELECT s_suppkey, 2 AS parts, round(r * r * 2, 6) AS area FROM (SELECT s_suppkey, (1 + s_suppkey % 20)::DOUBLE AS r FROM supplier)")
def st_makevalid_bowtie(s, d):
    wkt = F.concat(F.lit("POLYGON ((0 0, "), F.concat((F.col("r") * 2).cast("string"), F.lit(" "), (F.col("r") * 2).cast("string")), F.lit(", "), (F.col("r") * 2).cast("string"), F.lit(" 0, 0 "), (F.col("r") * 2).cast("string"), F.lit(", 0 0))"))
    g = D.suppliers(s, d).select("s_suppkey", st("ST_MakeValidParts", st("ST_GeomFromWKT", wkt)).alias("v")).select("s_suppkey", F.size("v").alias("parts"), F.explode("v").alias("g"))
    return g.withColumn("a", st("ST_Area", F.col("g"))).groupBy("s_suppkey", "parts").agg(_r(F.sum("a")).alias("area"))


@query("st_transform_mercator", f"SELECT c_custkey, round(radians(x) * 6378137, 2) AS x, round(ln(tan(pi() / 4 + radians(y * 0.9) / 2)) * 6378137, 2) AS y FROM {C}")
def st_transform_mercator(s, d):
    p = N.point(F.col("geom.x"), F.col("geom.y") * 0.9)
    return D.customers(s, d).select("c_custkey", N.web_mercator(p).alias("m")).select("c_custkey", _r(F.col("m.x"), 2).alias("x"), _r(F.col("m.y"), 2).alias("y"))


_EDGE = "((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x))"
_NGON = f"(SELECT s_suppkey, k, x + r * cos(2 * {math.pi!r}::DOUBLE * k / n) AS x, y + r * sin(2 * {math.pi!r}::DOUBLE * k / n) AS y, n FROM (SELECT *, s_suppkey % 10 + 3 AS n FROM {S}), range(13) t(k) WHERE k <= n)"


@query("polygon_point_join", f"SELECT a.s_suppkey, c_custkey FROM {_NGON} a JOIN {_NGON} b ON a.s_suppkey = b.s_suppkey AND b.k = a.k + 1 CROSS JOIN {C} p GROUP BY a.s_suppkey, c_custkey HAVING min({_EDGE}) >= 0")
def polygon_point_join(s, d):
    """Regular polygons against points; in SQL a point is left of every edge."""
    return J.spatial_join(_ngons(s, d), D.customers(s, d), "contains").select("s_suppkey", "c_custkey")


@query("choropleth_pixels", f"SELECT px, py, sum(n)::DOUBLE AS weight FROM (SELECT a.n_nationkey, x0, y0, x1, y1, count(*) AS n FROM {NA} a JOIN {IT} p ON {_IN} GROUP BY ALL) a, (SELECT i::INTEGER AS px, j::INTEGER AS py, -180 + (i + 0.5) * 360 / 128 AS cx, -90 + (j + 0.5) * 180 / 64 AS cy FROM range(128) t(i), range(64) u(j)) WHERE cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY px, py")
def choropleth_pixels(s, d):
    counts = range_join_contains(s, d).join(_wkb_rects(D.nations(s, d)), "n_nationkey")
    return V.weigh(V.pixelize(counts, 128, 64, WORLD, filled=True), "n")
