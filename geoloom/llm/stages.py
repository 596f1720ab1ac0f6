"""The operators as stages of a corpus pipeline: each takes documents and gives documents (the last, their pieces).

A stage keeps all rows it does not decide against, with their columns.  Rows
with a null id are kept by the filters, as nothing is known of them.  Of rows
that repeat an id exactly one stays after near-dedup; the other stages judge each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import few, save
from geoloom.llm.decontaminate import without_contaminated
from geoloom.llm.neardup import near_duplicates
from geoloom.llm.toxicity import Model, learn, without_toxic


def drop_toxic(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, model: Model | None = None, cut: float = 0.7) -> DataFrame:
    """Documents whose toxicity score is below ``cut``; decided row by row, without a shuffle."""
    model = model or learn(train if train is not None else docs, labels)
    return without_toxic(docs, model, cut)


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest id.

    Rows with a null id, and null or blank texts, are in no group and stay; of
    rows that repeat an id the one of the smallest text stays (a null one after
    all); an empty table stays empty.
    """
    groups = save(near_duplicates(docs, **parameters).where("doc_id is not null"))
    out = docs.join(few(groups.where("not kept").select(F.col("doc_id").alias("_id")).distinct()), docs["doc_id"].cast("long") == F.col("_id"), "left_anti")
    repeated = save(groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")))
    if repeated.limit(1).count() == 0:
        return out
    alone = out.join(few(repeated), out["doc_id"].cast("long") == F.col("_id"), "left_anti")
    several = out.join(few(repeated), out["doc_id"].cast("long") == F.col("_id"), "left_semi")
    rank = F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long")).orderBy(F.col("text").asc_nulls_last()))
    packed = several.select(F.struct(*several.columns).alias("_row"), rank.alias("_rank")).where("_rank = 1")
    return alone.unionByName(packed.select(*(F.col("_row").getField(c).alias(c) for c in several.columns)))


def drop_contaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """Documents that hold no benchmark item; see ``without_contaminated``."""
    return without_contaminated(docs, items, **parameters)
