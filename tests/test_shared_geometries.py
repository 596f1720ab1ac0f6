"""Joins of rows that share their geometries, told once and spelled out behind the join."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import native as N
from geoloom.functions.kernels import FUNCTIONS, batched
from geoloom.functions.register import register, unregister
from geoloom.operators import joins as J
from geoloom.operators import partitioning as P
from geoloom.plans.sql import spatial_sql


@pytest.fixture
def sides(spark, monkeypatch):
    """300 rectangles at 30 places (some null) and 300 points at 40, met as shared ones of some rows at a time."""
    monkeypatch.setattr(J, "SMALL", 0)
    monkeypatch.setattr(J, "TINY", 0)
    monkeypatch.setattr(J, "TOGETHER", 500)
    r = random.Random(5)
    places = [(x := r.randint(0, 40), y := r.randint(0, 40), x + r.randint(1, 9), y + r.randint(1, 9)) for _ in range(30)]
    spots = [(r.randint(0, 50), r.randint(0, 50)) for _ in range(40)]
    a = [(i, *(map(float, places[i % 30]) if i % 50 else (None,) * 4)) for i in range(300)]
    b = [(i, *map(float, spots[i % 40])) for i in range(300)]
    rects = spark.createDataFrame(a, "a int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame(b, "b int, x double, y double")
    want = sorted((i, k) for i, x0, y0, x1, y1 in a for k, x, y in b if x0 is not None and x0 <= x <= x1 and y0 <= y <= y1)
    return rects, points, want


def test_shared_geometries_join_like_any(spark, sides):
    rects, points, want = sides
    a, b = rects.select("a", N.rectangle("x0", "y0", "x1", "y1").alias("geom")), points.select("b", N.point("x", "y").alias("geom"))
    j = J.spatial_join(a, b, "contains")
    assert "Generate explode" in j._jdf.queryExecution().toString()
    assert sorted((r.a, r.b) for r in j.collect()) == want
    left = J.spatial_join(a, b, "contains", how="left").select("a", "b").collect()
    met = {x for x, _ in want}
    assert sorted((r.a, r.b) for r in left if r.b is not None) == want
    assert sorted(r.a for r in left if r.b is None) == [i for i in range(300) if i not in met]
    assert sorted(r.a for r in J.spatial_join(a, b, "contains", how="left_semi").collect()) == sorted(met)
    assert sorted(r.a for r in J.spatial_join(a, b, "contains", how="left_anti").collect()) == [i for i in range(300) if i not in met]
    as_wkb = batched(FUNCTIONS["ST_PolygonFromEnvelope"][1], "binary")
    w = rects.select("a", as_wkb("x0", "y0", "x1", "y1").alias("geom"))
    assert sorted((r.a, r.b) for r in J.spatial_join(w, b, "contains").collect()) == want
    near = J.distance_join(b.withColumn("r", F.lit(0.0)), b.withColumnRenamed("b", "c"), "r").select("b", "c")
    assert near.count() == sum(x * x for x in (r["count"] for r in points.groupBy("x", "y").count().collect()))
    # dealt by cells: copies in several cells count once
    dealt, cells = P.partition(a.where("geom is not null"), "geom", "kdbtree", 5)
    other, _ = P.partition(b, "geom", cells=cells)
    assert sorted((r.a, r.b) for r in J.dealt_join(dealt, other, cells, "contains").collect()) == want


def test_shared_geometries_in_sql(spark, sides):
    rects, points, want = sides
    register(spark)
    rects.createOrReplaceTempView("shared_r")
    points.createOrReplaceTempView("shared_p")
    made = "(SELECT a, ST_PolygonFromEnvelope(x0, y0, x1, y1) AS g FROM shared_r) r"
    at = "(SELECT b, ST_Point(x, y) AS g FROM shared_p) p"
    try:
        inner = spatial_sql(spark, f"SELECT a, b FROM {made} JOIN {at} ON ST_Contains(r.g, p.g)")
        assert sorted((r.a, r.b) for r in inner.collect()) == want
        for kind, keep in (("SEMI", True), ("ANTI", False)):
            got = spatial_sql(spark, f"SELECT a FROM {made} LEFT {kind} JOIN {at} ON ST_Contains(r.g, p.g)")
            assert sorted(r.a for r in got.collect()) == [i for i in range(300) if (i in {x for x, _ in want}) == keep]
            more = spatial_sql(spark, f"SELECT a FROM {made} LEFT {kind} JOIN {at} ON ST_Contains(r.g, p.g) AND p.b < r.a")
            assert sorted(r.a for r in more.collect()) == [i for i in range(300) if (i in {x for x, y in want if y < x}) == keep]
    finally:
        unregister(spark)


def test_equal_rectangles_meet_by_their_boxes(spark):
    """Rectangles around one centre all meet; only equal ones may be compared."""
    k = F.col("id")
    rects = spark.range(40_000).select("id", N.rectangle(-1 - k % 20_000, F.lit(-1), 1 + k % 20_000, F.lit(1)).alias("geom"))
    j = J.spatial_join(rects, rects.withColumnRenamed("id", "other"), "equals")
    assert "_cx" not in j._jdf.queryExecution().toString()
    assert j.count() == 80_000
    assert j.where((F.col("id") - F.col("other")) % 20_000 != 0).count() == 0


def test_bundles_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(J, "TOGETHER", 1000)
    k = F.col("id")
    df = spark.range(500).select("id", (k % 3).alias("key"), F.when(k % 2 == 0, N.point(k % 4, F.lit(1))).alias("geom"))
    got = J.bundled(df, "geom", "key")
    assert got.agg(F.max(F.size("_rows"))).first()[0] < 30
    assert sorted(map(str, got.select(F.explode("_rows").alias("r"), "key", "geom").select("r.id", "key", "geom").collect())) == sorted(map(str, df.collect()))
