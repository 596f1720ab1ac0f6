"""Geometry columns derived from the test tables' keys, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import native as N


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(key: Column, k: int, m: int, off: float) -> Column:
    return (key * k % m).cast("double") / 10.0 - off


def _point(x: Column, y: Column) -> Column:
    """As a stored column would be: keys are never null."""
    return F.struct(x.alias("x"), y.alias("y"))


def _sql_at(key: str, k: int, m: int, off: float) -> str:
    return f"((({key}) * {k}) % {m})::DOUBLE / 10.0::DOUBLE - {off}::DOUBLE"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", "c_nationkey", "c_acctbal", _point(_at(k, 37, 3600, 180.0), _at(k, 91, 1800, 90.0)).alias("geom"))


CUSTOMERS = f"(SELECT c_custkey, c_nationkey, c_acctbal, {_sql_at('c_custkey', 37, 3600, 180)} AS x, {_sql_at('c_custkey', 91, 1800, 90)} AS y FROM customer)"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select("s_suppkey", _point(_at(k, 53, 3600, 180.0), _at(k, 71, 1800, 90.0)).alias("geom"), (1 + k % 20).cast("double").alias("r"))


SUPPLIERS = f"(SELECT s_suppkey, {_sql_at('s_suppkey', 53, 3600, 180)} AS x, {_sql_at('s_suppkey', 71, 1800, 90)} AS y, (1 + s_suppkey % 20)::DOUBLE AS r FROM supplier)"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    x, y = (k % 5 * 72 - 180).cast("double"), (F.floor(k / 5) * 36 - 90).cast("double")
    return n.select("n_nationkey", "n_regionkey", N.rectangle(x, y, x + 60, y + 30).alias("geom"))


NATIONS = "(SELECT n_nationkey, n_regionkey, (n_nationkey % 5 * 72 - 180)::DOUBLE AS x0, (n_nationkey // 5 * 36 - 90)::DOUBLE AS y0, (n_nationkey % 5 * 72 - 120)::DOUBLE AS x1, (n_nationkey // 5 * 36 - 60)::DOUBLE AS y1 FROM nation)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, half = F.col("p_partkey"), 1 + F.col("p_size") / 10.0
    x, y = _at(k, 17, 3600, 180.0), _at(k, 29, 1800, 90.0)
    return p.select("p_partkey", "p_size", N.rectangle(x - half, y - half, x + half, y + half).alias("geom"))


_PX, _PY = _sql_at("p_partkey", 17, 3600, 180), _sql_at("p_partkey", 29, 1800, 90)
PARTS = f"(SELECT p_partkey, p_size, {_PX} - h AS x0, {_PY} - h AS y0, {_PX} + h AS x1, {_PY} + h AS y1 FROM (SELECT *, 1::DOUBLE + p_size::DOUBLE / 10.0::DOUBLE AS h FROM part))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    x = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 3600
    y = (F.col("l_partkey") * 91 + F.col("l_linenumber") * 7) % 1800
    return t.select("l_orderkey", "l_linenumber", "l_partkey", _point(x.cast("double") / 10.0 - 180.0, y.cast("double") / 10.0 - 90.0).alias("geom"))


ITEMS = "(SELECT l_orderkey, l_linenumber, l_partkey, ((l_partkey * 37 + l_linenumber * 11) % 3600)::DOUBLE / 10.0::DOUBLE - 180::DOUBLE AS x, ((l_partkey * 91 + l_linenumber * 7) % 1800)::DOUBLE / 10.0::DOUBLE - 90::DOUBLE AS y FROM lineitem)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", "o_custkey", "o_orderdate", _point(_at(k, 37, 3600, 180.0), _at(k, 91, 1800, 90.0)).alias("geom"))


ORDERS = f"(SELECT o_orderkey, o_custkey, o_orderdate, {_sql_at('o_orderkey', 37, 3600, 180)} AS x, {_sql_at('o_orderkey', 91, 1800, 90)} AS y FROM orders)"


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("double"))
    return e.select("vec_id", a.alias("a"), F.reverse(a).alias("b"))


_BAND = "list_transform(embedding, lambda v: floor(v::DOUBLE * 1000))"
BANDS = f"(SELECT vec_id, a, list_reverse(a) AS b FROM (SELECT vec_id, {_BAND} AS a FROM embeddings))"
