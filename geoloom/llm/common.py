"""Helpers that the operators share: column picking, durable intermediates, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch. Texts may be long, so that a number of rows does not bound a worker's memory.
BATCH = 2_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def pick(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text): extra columns, whatever their names, play no part."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark, "_geoloom_dir", None) or tempfile.mkdtemp(prefix="geoloom-")
        spark._geoloom_dir = at
    return at


def save(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._geoloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes what ``save`` wrote, once nothing reads it any more."""
    path = getattr(df, "_geoloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


#: Ids that are broadcast at most (8 bytes each).
FEW = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """The ids, stored, to be broadcast if there are few, so that what they are joined with needs no shuffle."""
    ids = save(ids)
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) pairs of longs: (id, component), the component being its smallest id.

    Alternates large-star and small-star steps until the edges no longer change;
    every step is one aggregation with map-side combining and one equi-join of
    two stored tables, so that a hub with very many edges is split like any
    skewed join key.  Ids without an
    edge are not returned; self loops, repeated and null pairs are ignored.
    """
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        # large star: what hangs on b hangs on b's smallest neighbour instead, if b has a smaller one
        least = save(edges.groupBy("a").agg(F.min("b").alias("m")))
        moved = edges.join(least.select(F.col("a").alias("k"), "m"), F.col("b") == F.col("k"), "left")
        large = save(moved.select("a", F.coalesce("m", "b").alias("b")).distinct())
        drop(least)
        # small star: all smaller neighbours of a, and a itself, hang on the smallest of them
        least = save(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        new = save(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        for old in (edges, large, least):
            drop(old)
        edges, after = new, state(new)
        if after == before:
            break
        before = after
    # each id now has one edge, to its component's smallest id
    tops = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(tops)
