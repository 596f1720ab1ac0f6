"""Points of a stream against static rectangles, and windowed counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import native as N
from geoloom.operators.joins import _levels, _width

#: Rows and bytes of the static side that may be broadcast.
STATIC_ROWS, STATIC_BYTES = 200_000, 64_000_000


def fence(points: DataFrame, rects: DataFrame, cell: float, geom: str = "geom", rect_geom: str = "geom") -> DataFrame:
    """Pairs of points (stream or table) and static rectangles that cover them: an equi-join on cells, without state.

    A rectangle lies on the level whose cells (``cell`` times a power of two) are
    as long as its longer side, so in four cells at most, however large it is; a
    point is looked up on every level that some rectangle has.
    """
    size = float(cell)
    r = rects.select(F.struct(*(rects[c] for c in rects.columns)).alias("fence"), rects[rect_geom].alias("_box")).where("_box is not null")
    r = r.withColumn("_l", _levels(r, size))
    levels = sorted(x[0] for x in r.select("_l").distinct().collect()) or [0]  # at most about 60
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("_l"))
    at = lambda v: F.floor(v / step).cast("long")
    r = r.withColumn("_cx", F.explode(F.sequence(at(F.col("_box.xmin")), at(F.col("_box.xmax"))))).withColumn("_cy", F.explode(F.sequence(at(F.col("_box.ymin")), at(F.col("_box.ymax")))))
    width = _width(r.schema["fence"].dataType, F.col("fence"))
    some = r.limit(STATIC_ROWS + 1).agg(F.count("*").alias("n"), (F.lit(None).cast("long") if width is None else F.sum(width)).alias("bytes")).first()
    if some.n <= STATIC_ROWS and width is not None and (some.bytes or 0) <= STATIC_BYTES:
        r = F.broadcast(r)
    p = points.select(F.struct(*(points[c] for c in points.columns)).alias("_row"), points[geom].alias("_p"), *([] if len(levels) > 1 else [F.lit(levels[0]).alias("_l")]), *([F.explode(F.array(*map(F.lit, levels))).alias("_l")] if len(levels) > 1 else []))
    p = p.withColumn("_cx", at(F.col("_p.x"))).withColumn("_cy", at(F.col("_p.y")))
    met = p.join(r, ["_l", "_cx", "_cy"]).where(N.rect_covers_point(F.col("_box"), F.col("_p")))
    return met.select(*(F.col("_row").getField(c).alias(c) for c in points.columns), "fence")


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts a window and key; later events than the watermark allows are left out on a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def crossings(points: DataFrame, rects: DataFrame, key: str, time: str, rect_id: str, cell: float, geom: str = "geom") -> DataFrame:
    """(key, time, fence, event): where each key's points enter and leave static rectangles, in the order of time.

    Works on tables and, as a stateful operator, on streams: there the last
    fences of each key are its state, and points that come too late for the
    order count when they arrive.  A point in several rectangles counts for the
    one of the smallest id.
    """
    inner = rects.select(F.col(rect_id).alias("_fence"), rects["geom"].alias("geom"))
    own = points.select(F.col(key).alias("k"), F.col(time).alias("t"), points[geom].alias("geom"))
    met = fence(own, inner, cell).select("k", "t", F.col("fence._fence").cast("long").alias("f"))
    placed = own.select("k", "t").withColumn("f", F.lit(None).cast("long")).union(met)
    kind = f"{key} {points.schema[key].dataType.simpleString()}, {time} {points.schema[time].dataType.simpleString()}, fence long, event string"
    if not points.isStreaming:
        # every point once, with the smallest fence or none; then the one before it
        one = placed.groupBy("k", "t").agg(F.min("f").alias("f"))
        before = F.lag("f").over(Window.partitionBy("k").orderBy("t"))
        moves = one.withColumn("b", before).where(~F.col("f").eqNullSafe(F.col("b")))
        events = F.array_compact(F.array(F.when(F.col("b").isNotNull(), F.struct(F.col("b").alias("fence"), F.lit("leave").alias("event"))), F.when(F.col("f").isNotNull(), F.struct(F.col("f").alias("fence"), F.lit("enter").alias("event")))))
        return moves.select(F.col("k").alias(key), F.col("t").alias(time), F.explode(events).alias("e")).select(key, time, "e.fence", "e.event")

    def step(keys, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames))
        one = rows.groupby("t", sort=True)["f"].min()
        out = []
        for t, f in one.items():
            f = None if f != f else int(f)
            if f != last:
                out += [(keys[0], t, last, "leave")] if last is not None else []
                out += [(keys[0], t, f, "enter")] if f is not None else []
            last = f
        state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=[key, time, "fence", "event"])

    return placed.groupBy("k").applyInPandasWithState(step, kind, "last long", "append", "NoTimeout")
