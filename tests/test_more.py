"""SQL joins' plans, user columns in joins, array forms of functions, projections, frames."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.frame import JoinParams, SpatialFrame
from geoloom.functions import fast, kernels
from geoloom.functions import native as N
from geoloom.functions.crs import _pair, reproject
from geoloom.functions.register import register
from geoloom.kernel.geometry import POLYGON, Geom, from_wkt, point, rectangle, to_wkb
from geoloom.kernel.overlay import covers
from geoloom.operators import joins as J
from geoloom.operators import partitioning as P
from geoloom.operators.geometry import covers_points
from geoloom.plans.sql import spatial_sql


@pytest.fixture(scope="module")
def views(spark):
    register(spark)
    k = F.col("id")
    spark.range(300).select(k.alias("pid"), (k * 37 % 100).cast("double").alias("x"), (k * 91 % 80).cast("double").alias("y"), (k % 3).alias("c")).createOrReplaceTempView("more_points")
    spark.range(60).select(k.alias("rid"), (k * 53 % 90).cast("double").alias("x0"), (k * 17 % 70).cast("double").alias("y0"), (k % 9).cast("double").alias("w"), (k % 3).alias("c")).createOrReplaceTempView("more_rects")
    return spark


RECT, POINT = "ST_PolygonFromEnvelope(r.x0, r.y0, r.x0 + r.w, r.y0 + r.w)", "ST_Point(p.x, p.y)"
INSIDE = "p.x BETWEEN r.x0 AND r.x0 + r.w AND p.y BETWEEN r.y0 AND r.y0 + r.w"


@pytest.mark.parametrize(
    "fast_one,plain",
    [
        (f"SELECT * FROM more_rects r JOIN more_points p ON ST_Contains({RECT}, {POINT})", f"SELECT * FROM more_rects r JOIN more_points p ON {INSIDE}"),
        (f"SELECT rid, count(*) FROM more_points p, more_rects r WHERE ST_Intersects({RECT}, {POINT}) AND p.c = r.c GROUP BY rid", f"SELECT rid, count(*) FROM more_points p, more_rects r WHERE {INSIDE} AND p.c = r.c GROUP BY rid"),
        ("SELECT a.pid, b.pid FROM more_points a JOIN more_points b ON ST_Distance(ST_Point(a.x, a.y), ST_Point(b.x, b.y)) < 5 AND a.pid < b.pid", "SELECT a.pid, b.pid FROM more_points a JOIN more_points b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 5 AND a.pid < b.pid"),
        (f"SELECT pid, rid FROM more_points p LEFT JOIN more_rects r ON ST_Within({POINT}, {RECT}) AND p.c = r.c", f"SELECT pid, rid FROM more_points p LEFT JOIN more_rects r ON {INSIDE} AND p.c = r.c"),
        (f"SELECT pid FROM more_points p LEFT ANTI JOIN more_rects r ON ST_Within({POINT}, {RECT})", f"SELECT pid FROM more_points p LEFT ANTI JOIN more_rects r ON {INSIDE}"),
        (f"WITH j AS (SELECT r.rid, p.pid, p.x FROM more_rects r JOIN more_points p ON ST_Contains({RECT}, {POINT})) SELECT j.rid, q.pid FROM j JOIN more_points q ON q.pid = j.pid + 1", f"WITH j AS (SELECT r.rid, p.pid, p.x FROM more_rects r JOIN more_points p ON {INSIDE}) SELECT j.rid, q.pid FROM j JOIN more_points q ON q.pid = j.pid + 1"),
    ],
)
def test_sql_joins_run_by_cells(views, fast_one, plain):
    df = spatial_sql(views, fast_one)
    want = views.sql(plain)
    assert df.columns == want.columns or "count" in fast_one
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "ArrowEval" not in plan


def test_sql_joins_of_stored_wkb(views):
    views.sql(f"SELECT rid, {RECT} AS g FROM more_rects r").write.mode("overwrite").saveAsTable("more_stored_rects")
    try:
        got = spatial_sql(views, f"SELECT rid, pid FROM more_stored_rects r JOIN more_points p ON ST_Contains(r.g, {POINT})").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, views.sql(f"SELECT rid, pid FROM more_rects r JOIN more_points p ON {INSIDE}").collect()))
    finally:
        views.sql("DROP TABLE more_stored_rects")


def test_other_shapes_stay_as_they_are(views):
    q = f"SELECT count(*) n FROM more_rects r JOIN more_points p ON ST_Contains({RECT}, {POINT}) OR p.c = 7"
    assert spatial_sql(views, q).first().n == views.sql(f"SELECT count(*) n FROM more_rects r JOIN more_points p ON {INSIDE}").first().n
    assert spatial_sql(views, "SELECT count(*) n FROM more_points").first().n == 300


def test_joins_keep_every_column(spark):
    rects = spark.createDataFrame([(1, 2, 3, 4, 0.0, 0.0, 2.0, 2.0)], "_id int, _radius int, _row int, x_right int, a double, b double, c double, d double").select("_id", "_radius", "_row", "x_right", F.lit(5).alias("x"), N.rectangle("a", "b", "c", "d").alias("geom"))
    points = spark.range(3).select(F.col("id").alias("x"), F.lit(9).alias("_box"), N.point(F.col("id").cast("double"), F.lit(1.0)).alias("geom"))
    inner = J.spatial_join(rects, points, "contains")
    assert inner.columns == ["_id", "_radius", "_row", "x_right", "x", "geom", "x_right_right", "_box", "geom_right"]
    assert sorted(r.x_right_right for r in inner.collect()) == [0, 1, 2] and inner.first()._radius == 2
    for how in ("left", "full"):
        assert J.spatial_join(rects, points, "contains", how=how).columns == inner.columns
    for how in ("left_semi", "left_anti"):
        assert J.spatial_join(rects, points, "contains", how=how).columns == rects.columns
    near = J.distance_join(rects, points, 1.0)
    assert near.columns == inner.columns and near.first()._radius == 2
    placed, _ = P.partition(points.withColumnRenamed("_box", "_b"), "geom", "kdbtree", 2)
    assert placed.columns == ["x", "_b", "geom", "cell_id"]


def test_array_forms_equal_the_general_ones():
    rng = random.Random(1)
    geoms = [to_wkb(point(rng.uniform(-9, 9), rng.uniform(-9, 9))) for _ in range(20)] + [None]
    for extra in ([], [to_wkb(from_wkt("LINESTRING (0 0, 1 2)"))], [to_wkb(point(1.0, 2.0)._replace(srid=4326))]):
        g = pd.Series(geoms + extra, dtype="object")
        for name in ("ST_X", "ST_Y", "ST_FlipCoordinates"):
            kind, f = kernels.FUNCTIONS[name]
            plain = [None if v is None else kernels._out(f(kernels._in(v))) for v in g]
            got = fast.FAST[name](g)
            assert (got is None) == bool(extra)
            assert got is None or [v if v == v else None for v in got] == plain
    sides = [pd.Series([0.0, 1.5, None]), pd.Series([1.0, 2, 3]), pd.Series([4.0, 5, 6]), pd.Series([7.0, 8, 9])]
    made = fast.make_rectangles(*sides)
    assert made[0] == to_wkb(rectangle(0.0, 1.0, 4.0, 7.0)) and made[1] == to_wkb(rectangle(1.5, 2.0, 5.0, 8.0)) and made[2] is None
    assert fast.read_boxes(made)[:2].tolist() == [[0, 1, 4, 7], [1.5, 2, 5, 8]]


def test_points_in_polygons_equal_the_kernel():
    rng = random.Random(2)
    shapes = [rectangle(0.0, 0.0, 2.0, 2.0), from_wkt("MULTIPOLYGON (((0 0, 0 1, 1 1, 1 0, 0 0)), ((1 1, 1 2, 2 2, 2 1, 1 1)))"), from_wkt("LINESTRING (0 0, 2 2)"), point(1.0, 1.0)]
    for _ in range(6):
        n = rng.randint(3, 9)
        ring = [(math.cos(2 * math.pi * i / n) * rng.choice([1, 2]), math.sin(2 * math.pi * i / n) * rng.choice([1, 2])) for i in range(n)]
        shapes.append(Geom(POLYGON, [[*ring, ring[0]], [(x / 4, y / 4) for x, y in [*ring, ring[0]]]]))
    pairs = [(g, rng.choice([rng.uniform(-2, 2), 0.0, 1.0, 0.5, 2.0]), rng.choice([rng.uniform(-2, 2), 0.0, 1.0, 0.5, 2.0])) for g in shapes for _ in range(60)]
    pairs += [(g, *p) for g in shapes if g.kind == POLYGON for r in g.data for p in r]
    rng.shuffle(pairs)
    got = covers_points(pd.Series([to_wkb(g) for g, _, _ in pairs]), pd.Series([x for _, x, _ in pairs]), pd.Series([y for _, _, y in pairs]))
    assert got.tolist() == [covers(g, point(x, y)) for g, x, y in pairs]


PROJECTIONS = {"epsg:3395": "conformal", "epsg:2154": "conformal", "epsg:3034": "conformal", "epsg:102004": "conformal", "epsg:3413": "conformal", "epsg:3031": "conformal", "epsg:32633": "conformal", "epsg:5070": "equal area"}


@pytest.mark.parametrize("code", PROJECTIONS)
def test_projections_have_their_properties(code):
    """Angles or areas on the ellipsoid are kept, and the way back leads back."""
    forward, back, _ = _pair(code)
    lon0 = {"epsg:2154": 3, "epsg:3034": 10, "epsg:102004": -96, "epsg:5070": -96, "epsg:32633": 15}.get(code, 20)
    e2 = 0.0066943799901413165
    for lat in (-62.0, -75.5) if code == "epsg:3031" else (33.3, 41.0, 64.0):
        for lon in (lon0 - 2.5, lon0, lon0 + 2.0):
            x, y = forward(lon, lat)
            assert back(x, y) == pytest.approx((lon, lat), abs=2e-7)
            h = 1e-5
            dx = [(a - b) / (2 * math.radians(h)) for a, b in zip(forward(lon + h, lat), forward(lon - h, lat))]
            dy = [(a - b) / (2 * math.radians(h)) for a, b in zip(forward(lon, lat + h), forward(lon, lat - h))]
            s = math.sin(math.radians(lat))
            east, north = 6378137 * math.cos(math.radians(lat)) / math.sqrt(1 - e2 * s * s), 6378137 * (1 - e2) / (1 - e2 * s * s) ** 1.5
            u, v = (dx[0] / east, dx[1] / east), (dy[0] / north, dy[1] / north)
            if PROJECTIONS[code] == "conformal":
                assert (u[0], u[1]) == pytest.approx((v[1], -v[0]), abs=2e-5)
            else:
                assert u[0] * v[1] - u[1] * v[0] == pytest.approx(1, abs=2e-5)


def test_standard_parallels_and_datums():
    for code, lats, lon in (("epsg:2154", (44, 49), 3), ("epsg:5070", (29.5, 45.5), -96), ("epsg:3413", (70,), -45), ("epsg:3031", (-71,), 0)):
        forward, _, _ = _pair(code)
        for lat in lats:  # along these the scale is one
            s = math.sin(math.radians(lat))
            east = 6378137 * math.cos(math.radians(lat)) / math.sqrt(1 - 0.0066943799901413165 * s * s)
            a, b = forward(lon - 1e-4, lat), forward(lon + 1e-4, lat)
            assert math.dist(a, b) == pytest.approx(east * math.radians(2e-4), rel=1e-6)
    assert reproject(point(3.0, 46.5), "epsg:4326", "epsg:2154").data == pytest.approx((700_000, 6_600_000))
    with pytest.raises(ValueError):
        reproject(point(3.0, 46.5), "epsg:4326", "epsg:2154", lenient=False)
    with pytest.raises(ValueError):
        reproject(point(3.0, 46.5), "epsg:4326", "epsg:99999")


def test_frames(spark, tmp_path):
    k = F.col("id")
    p = SpatialFrame.points(spark.range(200), k * 7 % 50, k * 3 % 40)
    r = SpatialFrame.rectangles(spark.range(30).withColumnRenamed("id", "rid"), F.col("rid"), F.col("rid"), F.col("rid") + 5, F.col("rid") + 5)
    want = sorted((x.rid, x.id) for x in r.join(p).collect())
    for kind in ("kdbtree", "quadtree", "rtree", "equalgrid"):
        params = JoinParams(partitioning=kind, partitions=6)
        assert sorted((x.rid, x.id) for x in r.join(p, params).collect()) == want
        dealt = r.partition(kind, 6)
        assert sorted((x.rid, x.id) for x in dealt.join(p.partition(like=dealt), params).collect()) == want
        assert dealt.cells == r.partition(kind, 6).cells
    with pytest.raises(ValueError):
        r.partition("kdbtree", 6).join(p.partition("equalgrid", 6), JoinParams(partitioning="kdbtree"))
    assert p.kind == "point" and p.count_without_duplicates() == 200 and p.analyze().first()["count"] == 200
    assert p.range((0.0, 0.0, 10.0, 10.0)).df.count() == p.df.where("geom.x between 0 and 10 and geom.y between 0 and 10").count()
    r.partition("rtree", 6).save(str(tmp_path / "f"))
    assert SpatialFrame.load(spark, str(tmp_path / "f")).cells == r.partition("rtree", 6).cells
