"""A DataFrame with a geometry column as one object: typed constructors, adapters, partitioning, joins, save and load."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import native as N
from geoloom.operators import aggregates as A
from geoloom.operators import joins as J
from geoloom.operators import partitioning as P
from geoloom.operators.geometry import box, exact, kind_of


@dataclass(frozen=True)
class JoinParams:
    """How two frames are joined; ``partitioning`` is None for the level grid, or a kind of cells both sides are dealt by."""

    predicate: str = "contains"
    how: str = "inner"
    compat: bool = False
    partitioning: str | None = None
    partitions: int = 16


@dataclass(frozen=True)
class SpatialFrame:
    """Rows with a geometry; nothing runs until rows or statistics are asked for."""

    df: DataFrame
    geom: str = "geom"
    cells: P.Cells | None = None

    # --- adapters ---

    @classmethod
    def points(cls, df: DataFrame, x: str | Column, y: str | Column, geom: str = "geom") -> SpatialFrame:
        return cls(df.withColumn(geom, N.point(x, y)), geom)

    @classmethod
    def rectangles(cls, df: DataFrame, xmin, ymin, xmax, ymax, geom: str = "geom") -> SpatialFrame:
        return cls(df.withColumn(geom, N.rectangle(xmin, ymin, xmax, ymax)), geom)

    @classmethod
    def circles(cls, df: DataFrame, x, y, radius, geom: str = "geom") -> SpatialFrame:
        return cls(df.withColumn(geom, N.circle(N.point(x, y), radius)), geom)

    @classmethod
    def from_text(cls, df: DataFrame, attributes: list[str], text: str = "attributes", geom: str = "geom") -> SpatialFrame:
        """The array of attributes that the readers give, as named columns."""
        return cls(df.select(df[geom], *(F.get(df[text], F.lit(i)).alias(c) for i, c in enumerate(attributes))), geom)

    def to_text(self, sep: str = "\t") -> DataFrame:
        """(geom, attributes): the other columns joined as text, as the legacy frames carry them."""
        return self.df.select(self.geom, F.concat_ws(sep, *(F.coalesce(self.df[c].cast("string"), F.lit("null")) for c in self.df.columns if c != self.geom)).alias("attributes"))

    @property
    def kind(self) -> str:
        return kind_of(self.df, self.geom)

    # --- statistics, queries, joins ---

    def analyze(self) -> DataFrame:
        return A.analyze(self.df, self.geom)

    def count_without_duplicates(self) -> int:
        return A.count_distinct(self.df, self.geom).first()[0]

    def range(self, window, boundary: bool = False) -> SpatialFrame:
        return replace(self, df=J.range_query(self.df, window, self.geom, boundary))

    def nearest(self, x: float, y: float, k: int, tie: str | None = None) -> DataFrame:
        return J.knn_query(self.df, x, y, k, self.geom, tie)

    def partition(self, kind: str = "kdbtree", partitions: int = 16, like: SpatialFrame | None = None) -> SpatialFrame:
        """Dealt out by cells; with ``like`` by those of another frame."""
        df, cells = P.partition(self.df, self.geom, kind, partitions, like.cells if like else None)
        return replace(self, df=df, cells=cells)

    def join(self, other: SpatialFrame, params: JoinParams = JoinParams()) -> DataFrame:
        if params.partitioning is None:
            return J.spatial_join(self.df, other.df, params.predicate, self.geom, other.geom, params.how, params.compat)
        if params.how != "inner":
            raise ValueError("joins by shared cells are inner joins")
        return partitioned_join(self, other, params)

    def join_metrics(self, other: SpatialFrame, params: JoinParams = JoinParams()) -> dict[str, int]:
        """Rows of both sides, candidates whose boxes meet, and pairs: what a join's work is made of."""
        boxes = [f.df.select(box(f.df, f.geom).alias("b")).where("b.xmin is not null").withColumn("geom", F.struct("b.*")).select("geom") for f in (self, other)]
        return {"left": self.df.count(), "right": other.df.count(), "candidates": J.spatial_join(boxes[0], boxes[1], "intersects").count(), "pairs": self.join(other, params).count()}

    # --- files ---

    def save(self, path: str) -> None:
        """Parquet with the cells beside it; partitioned frames come back partitioned alike."""
        self.df.write.parquet(f"{path}/rows")
        note = json.dumps({"geom": self.geom, "cells": None if self.cells is None else self.cells.rects})
        self.df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SpatialFrame:
        note = json.loads(spark.read.text(f"{path}/about").first()[0])
        cells = note["cells"] and P.Cells([tuple(r) for r in note["cells"]])
        df = spark.read.parquet(f"{path}/rows")
        return cls(df.repartition(len(cells.rects), "cell_id") if cells else df, note["geom"], cells or None)


def partitioned_join(left: SpatialFrame, right: SpatialFrame, params: JoinParams) -> DataFrame:
    """Both sides dealt by the cells of the left one; a pair counts in the cell of its boxes' common corner."""

    def packed(f: SpatialFrame) -> DataFrame:
        own = [f.df["cell_id"].alias("_c")] if f.cells is not None and "cell_id" in f.df.columns else []
        return f.df.select(F.struct(*(f.df[c] for c in f.df.columns if c != "cell_id")).alias("_row"), box(f.df, f.geom).alias("_box"), f.df[f.geom].alias("_geom"), *own)

    if right.cells is not None and right.cells != left.cells:
        raise ValueError("the right side is dealt by other cells")
    a, b = packed(left), packed(right)
    cells = left.cells or P.build(left.df, left.geom, params.partitioning, params.partitions)
    n = len(cells.rects)
    # a side that is dealt by these cells already has its rows in all of them
    there = lambda f: f.cells is not None and f.cells == cells and "cell_id" in f.df.columns
    l, r = (s if there(f) else s.withColumn("_c", F.explode(cells.ids_of(F.col("_box")))).repartition(n, "_c") for s, f in ((a, left), (b, right)))
    met = F.col("l._c") == cells.owner_of(F.col("l._box"), F.col("r._box"))
    if (params.predicate, left.kind, right.kind) not in J.SAID_BY_BOXES:
        met = met & exact(params.predicate, F.col("l._geom"), F.col("r._geom"), (left.kind, right.kind))
    pairs = J._pairs(l, r, (left.kind == "point", right.kind == "point"), met, also="_c")
    names = [[c for c in f.df.columns if c != "cell_id"] for f in (left, right)]
    return pairs.select(*J._fields("l._row", names[0], []), *J._fields("r._row", names[1], names[0]))
