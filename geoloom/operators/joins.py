"""Range, distance and nearest-neighbour queries and joins.

Joins run on a grid of several levels.  A geometry's level is the one whose
cells are at least as long as its longer side, so that it covers four cells at
most; a pair meets on the coarser of its two levels.  This makes every join an
equi-join on (level, cx, cy) with the boxes as residual condition; a pair that
meets in several cells is kept in the one that holds the lower left corner of
the common box.  Hot cells are skewed join keys, which adaptive execution splits.
Rows that share a geometry are met as one: they travel in arrays of bounded
size, and their pairs are spelled out behind the join.  Equal geometries meet
by their boxes alone.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import native as N
from geoloom.kernel.geometry import Geom
from geoloom.operators.geometry import box, distance, exact, kind_of, literal
from geoloom.operators.partitioning import Cells
from geoloom.plans.durable import stored

#: How a side's boxes are made from its frame.
Boxed = Callable[[DataFrame], Column]
#: Points aimed at in a cell of the finest level.
PER_CELL = 64
#: Against a side of up to so many rows every box is compared directly: cheaper than any grid.
TINY = 32
#: A side of up to so many grid rows, and of so many bytes in them, is sent to all executors.
SMALL, SMALL_BYTES = 50_000, 16_000_000
#: Bytes of the rows that travel together with the geometry they share (one row at least).
TOGETHER = 65_536


def _levels(boxes: DataFrame, size: float) -> Column:
    b = F.col("_box")
    side = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    return F.greatest(F.lit(0), F.ceil(F.log2(side / F.lit(size)))).cast("int")


def _width(t: T.DataType, c: Column) -> Column | None:
    """Bytes of a value; None for kinds without a cheap answer."""
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(t, T.StructType):
        parts = [_width(f.dataType, c.getField(f.name)) for f in t.fields]
        return None if any(p is None for p in parts) else reduce(operator.add, parts, F.lit(8).cast("long"))
    return None if isinstance(t, (T.ArrayType, T.MapType, T.VariantType)) else F.lit(8).cast("long")


def _grid(a: DataFrame, b: DataFrame) -> tuple[float, tuple[int, int], tuple[int, int]]:
    """Finest cell size, rows and bytes of both sides, from one aggregation over each."""
    stats = []
    for df in (a, b):
        x = F.col("_box")
        width = _width(df.schema["_row"].dataType, F.col("_row"))
        size = F.lit(None).cast("long") if width is None else F.sum(width)
        stats.append(df.agg(F.count("*").alias("n"), size.alias("bytes"), F.min(x["xmin"]).alias("x0"), F.min(x["ymin"]).alias("y0"), F.max(x["xmax"]).alias("x1"), F.max(x["ymax"]).alias("y1")).first())
    some = [s for s in stats if s.x0 is not None]
    if not some:
        return 1.0, (0, 0), (0, 0)
    w = max(s.x1 for s in some) - min(s.x0 for s in some)
    h = max(s.y1 for s in some) - min(s.y0 for s in some)
    n = max(s.n for s in stats)
    size = math.sqrt(max(w, 1e-9) * max(h, 1e-9) * PER_CELL / max(n, PER_CELL)) if n else 1.0
    size = max(size, max(w, h) / 2**24, 1e-9)
    return size, (stats[0].n, stats[1].n), tuple(math.inf if s.bytes is None and s.n else s.bytes or 0 for s in stats)


def _cells(df: DataFrame, size: float, others: list[int], point: bool) -> DataFrame:
    """A row for each (level, cell) in which a geometry may meet one of the other side's levels.

    A point is of the finest level and in one cell of each: with one level on
    the other side its row is only extended, not exploded.
    """
    if point:
        level = F.lit(others[0]) if len(others) == 1 else F.explode(F.array(*map(F.lit, others)))
        df = df.withColumn("_l", level)
        step = F.lit(size) * F.pow(F.lit(2.0), F.col("_l"))
        at = lambda v: F.floor(v / step).cast("long")
        return df.withColumn("_cx", at(F.col("_box.xmin"))).withColumn("_cy", at(F.col("_box.ymin")))
    own = F.col("_level")
    finer = F.exists(F.array(*map(F.lit, others)), lambda x: x <= own)
    coarser = F.filter(F.array(*map(F.lit, others)), lambda x: x > own)
    levels = F.concat(F.when(finer, F.array(own)).otherwise(F.array().cast("array<int>")), coarser)
    df = df.withColumn("_l", F.explode(levels))
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("_l"))
    at = lambda v: F.floor(v / step).cast("long")
    b = F.col("_box")
    return df.withColumn("_cx", F.explode(F.sequence(at(b["xmin"]), at(b["xmax"])))).withColumn("_cy", F.explode(F.sequence(at(b["ymin"]), at(b["ymax"]))))


def _tiny(left: DataFrame, right: DataFrame) -> int | None:
    """Which side has ``TINY`` rows of few bytes at most; looks at no more rows than that tells."""
    for k, df in enumerate((left, right)):
        width = _width(df.schema["_row"].dataType, F.col("_row"))
        if width is not None:
            some = df.select(width.alias("bytes")).limit(TINY + 1).collect()  # one stage that stops early
            if len(some) <= TINY and sum(r.bytes or 0 for r in some) <= SMALL_BYTES:
                return k
    return None


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores, where the files are too few for that."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _shapes(df: DataFrame, keys: list[str], rows: bool) -> DataFrame:
    """A row for each geometry (and what else is in ``keys``), with its rows in ``_rows``, some kilobytes of them at a time."""
    flat = _flat(df, keys)
    names = [c for c in flat.columns if c.startswith("_k")]
    some = [F.first(c).alias(c) for c in ["_box", *keys]]
    if not rows:
        return flat.groupBy(*names).agg(*some).drop(*names)
    held = F.struct(*(F.col(c) for c in df.columns if c in ("_row", "_id")))
    return _bundled(flat.withColumn("_held", held), names, some, "_row")


def _bundled(flat: DataFrame, names: list[str], some: list[Column], sized: str) -> DataFrame:
    """Rows with equal values of ``names`` as arrays ``_rows`` of what ``_held`` has, ``TOGETHER`` bytes of them at a time."""
    width = _width(flat.schema[sized].dataType, F.col(sized)) + 64
    running = F.sum(width).over(Window.partitionBy(*names).orderBy(F.xxhash64(sized)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flat = flat.withColumn("_chunk", F.floor(running / F.lit(TOGETHER)))
    return flat.groupBy(*names, "_chunk").agg(*some, F.collect_list("_held").alias("_rows")).drop(*names, "_chunk")


def bundled(df: DataFrame, *keys: str) -> DataFrame:
    """The keys' columns and ``_rows``: an array of the other columns of rows that share them, some kilobytes at a time; nulls are a value."""
    flat = _flat(df, list(keys)).withColumn("_held", F.struct(*(F.col(c) for c in df.columns if c not in keys)))
    return _bundled(flat, [c for c in flat.columns if c.startswith("_k")], [F.first(c).alias(c) for c in keys], "_held")


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame with its keys once more as plain columns _k..., which compare as fast as they can."""
    out = []
    for c in keys:
        t = df.schema[c].dataType
        out += [F.col(c).getField(f.name) for f in t.fields] if isinstance(t, T.StructType) else [F.col(c)]
    return df.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(out)))


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("_row", "_box", "_id")]


def _copies(df: DataFrame) -> bool:
    """Whether the rows of a frame share their geometries, two at least on the average."""
    if _width(df.schema["_row"].dataType, F.col("_row")) is None:
        return False
    s = df.where(F.col("_box.xmin").isNotNull()).agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*_keys(df))).alias("d")).first()
    return s.n > SMALL and 2 * s.d <= s.n


def _pairs(left: DataFrame, right: DataFrame, points: tuple[bool, bool], condition: Column | None = None, equal: bool = False, also: str | None = None) -> DataFrame:
    """Pairs of the columns of both sides (left prefixed l., right r.) whose boxes meet and for which the condition holds, each once.

    The condition may use all but ``_row`` and ``_id``.  With ``equal`` the boxes are equal; so are the values of ``also``.
    """
    if equal:
        return _met(left, right, points, condition, True, also)
    tiny = _tiny(left, right)
    # against a side of some rows only what runs in Python is worth a look for copies
    shared = [False, False] if tiny is not None and not _in_python(left, right) else [_copies(df) for df in (left, right)]
    if not any(shared):
        return _met(left, right, points, condition, False, also, (tiny,))
    sides = [_shapes(df.where(F.col("_box.xmin").isNotNull()), _keys(df), True).withColumnRenamed("_rows", "_row") if s else df for df, s in zip((left, right), shared, strict=True)]
    met = _met(*sides, points, condition, False, also)
    held = []
    for side, df, s in zip("lr", (left, right), shared, strict=True):
        if s:
            met = met.withColumn(f"_{side}held", F.explode(F.col(f"{side}._row")))
        held.append(F.struct(*(F.col(f"_{side}held" if s else side)[c].alias(c) if s else F.col(f"{side}.{c}") for c in df.columns if c in ("_row", "_id"))).alias(side))
    return met.select(*held)


def _in_python(left: DataFrame, right: DataFrame) -> bool:
    return any("_geom" in df.columns and kind_of(df, "_geom") == "wkb" for df in (left, right))


def _met(left: DataFrame, right: DataFrame, points: tuple[bool, bool], condition: Column | None, equal: bool, also: str | None, known: tuple = ()) -> DataFrame:
    """``_pairs`` row by row; ``known`` has what ``_tiny`` said of these sides."""
    # plain columns for the boxes: comparisons on fields of structs are several times slower
    sides_of = [F.col(f"_box.{f}").alias(f"_{f}") for f in ("xmin", "ymin", "xmax", "ymax")]
    some = [df.where(F.col("_box.xmin").isNotNull()).select("*", *sides_of) for df in (left, right)]
    c = F.col
    boxes_meet = (c("l._xmin") <= c("r._xmax")) & (c("r._xmin") <= c("l._xmax")) & (c("l._ymin") <= c("r._ymax")) & (c("r._ymin") <= c("l._ymax"))
    together = F.lit(True) if also is None else c(f"l.{also}") == c(f"r.{also}")
    kept = lambda df: df if condition is None else df.where(condition)
    if equal:
        l, r = some[0].alias("l"), some[1].alias("r")
        same = reduce(operator.and_, (c(f"l.{x}") == c(f"r.{x}") for x in ("_xmin", "_ymin", "_xmax", "_ymax")))
        return kept(l.join(r, same & together))
    tiny = known[0] if known else _tiny(left, right)
    if tiny is not None:
        if _in_python(left, right):
            some[1 - tiny] = _spread(some[1 - tiny])
        l, r = some[0].alias("l"), some[1].alias("r")
        l, r = (F.broadcast(l), r) if tiny == 0 else (l, F.broadcast(r))
        return kept(l.join(r, boxes_meet & together))
    size, rows, size_of = _grid(left, right)
    side = 0 if rows[0] < rows[1] else 1
    sides = [df.withColumn("_level", F.lit(0) if p else _levels(df, size)) for df, p in zip(some, points, strict=True)]
    levels = [[0] if p else [r[0] for r in s.select("_level").distinct().collect()] for s, p in zip(sides, points, strict=True)]  # at most about 30
    if not all(levels):
        levels = [[0], [0]]
    l, r = (_cells(s, size, levels[1 - k], points[k]).alias("lr"[k]) for k, s in enumerate(sides))
    # checked: the smaller side's rows and bytes, in up to four cells on each of the other side's levels
    copies = 4 * (1 + len(levels[1 - side]))
    if rows[side] * copies <= SMALL and size_of[side] * copies <= SMALL_BYTES:
        l, r = (F.broadcast(l), r) if side == 0 else (l, F.broadcast(r))
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("l._l"))
    meet = (F.col("l._l") == F.col("r._l")) & (F.col("l._cx") == F.col("r._cx")) & (F.col("l._cy") == F.col("r._cy")) & together
    meet = meet & (F.col("l._l") == F.greatest(F.col("l._level"), F.col("r._level"))) & boxes_meet
    # the cell of the common box's corner speaks for the pair
    corner = (F.floor(F.greatest("l._xmin", "r._xmin") / step) == c("l._cx")) & (F.floor(F.greatest("l._ymin", "r._ymin") / step) == c("l._cy"))
    return kept(l.join(r, meet if any(points) else meet & corner))


def _having(base: DataFrame, left: DataFrame, right: DataFrame, points: tuple[bool, bool], condition: Column | None, how: str, equal: bool = False) -> DataFrame:
    """The rows of ``base`` (as l, the left side's own) that have a partner or none, told geometry by geometry."""
    keys = _keys(left)
    shapes = [_shapes(df.where(F.col("_box.xmin").isNotNull()), _keys(df), False).withColumn("_row", F.struct(F.lit(0))) for df in (left, right)]
    met = _flat(_met(*shapes, points, condition, equal, None).select(*(F.col(f"l.{c}").alias(c) for c in keys)), keys)
    names = [c for c in met.columns if c.startswith("_k")]
    met = met.select(*(F.col(c).alias(f"_m{c}") for c in names)).distinct()
    same = reduce(operator.and_, (F.col(f"l.{c}") == F.col(f"_m{c}") for c in names))
    return _flat(base, keys).alias("l").join(met, same, how)


def _packed(df: DataFrame, geom: str, boxed: Column, **more: Column) -> DataFrame:
    """The frame's rows as one column, so that no name of the user's columns matters."""
    return df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), boxed.alias("_box"), df[geom].alias("_geom"), *(c.alias(n) for n, c in more.items()))


def _fields(row: str, names: list[str], taken: list[str]) -> list[Column]:
    """The columns of a packed row; names that are taken get the suffix _right, as often as needed."""
    out, used = [], {t.lower() for t in taken}
    for c in names:
        name = c
        while name.lower() in used:
            name += "_right"
        used.add(name.lower())
        out.append(F.col(row).getField(c).alias(name))
    return out


def _join(left: DataFrame, right: DataFrame, lg: str, rg: str, boxes: tuple[Boxed, Boxed], condition: Column | None, how: str, grown: bool = False, equal: bool = False, **more: Column) -> DataFrame:
    if how == "right":
        raise ValueError("turn the sides round and join left")
    kinds = {"inner", "left", "left_semi", "left_anti", "full"}
    if how not in kinds:
        raise ValueError(f"no spatial join of type {how}")
    a, b = _packed(left, lg, boxes[0](left), **more), _packed(right, rg, boxes[1](right))
    if how != "inner":
        a = stored(a.withColumn("_id", F.monotonically_increasing_id()))
    if how == "full":
        b = stored(b.withColumn("_id", F.monotonically_increasing_id()))
    points = (kind_of(left, lg) == "point" and not grown, kind_of(right, rg) == "point")
    own, other = _fields("l._row", left.columns, []), _fields("r._row", right.columns, left.columns)
    if how in ("left_semi", "left_anti"):
        return _having(a, a, b, points, condition, how, equal).select(*own)
    pairs = _pairs(a, b, points, condition, equal)
    if how == "inner":
        return pairs.select(*own, *other)
    l = a.alias("l")
    met = pairs.select(F.col("l._id").alias("_met"), F.col("r._row").alias("_row"), *([F.col("r._id").alias("_rid")] if how == "full" else [])).alias("r")
    if how == "full":
        met = stored(met).alias("r")
    out = l.join(met, F.col("l._id") == F.col("r._met"), "left").select(*own, *other)
    if how == "left":
        return out
    alone = b.alias("r").join(met.select(F.col("_rid")).distinct(), F.col("r._id") == F.col("_rid"), "left_anti")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields]
    return out.unionByName(alone.select(*empty, *other))


#: Predicates and kinds for which the meeting of the boxes is the answer.
SAID_BY_BOXES = {("contains", "rect", "point"), ("within", "point", "rect"), ("intersects", "rect", "point"), ("intersects", "point", "rect"), ("intersects", "rect", "rect"), ("intersects", "point", "point"), ("equals", "point", "point"), ("contains", "point", "point"), ("within", "point", "point")}


def spatial_join(left: DataFrame, right: DataFrame, predicate: str, left_geom: str = "geom", right_geom: str = "geom", how: str = "inner", compat: bool = False) -> DataFrame:
    """Pairs for which predicate(left, right) holds; predicates: contains, within, intersects, overlaps, touches, equals, crosses.

    All columns of both sides come out; those of the right whose name the left
    has get the suffix _right.
    ``contains`` means covers and ``within`` covered by.  ``how``: inner, left,
    full, left_semi, left_anti.  With ``compat``, predicates other than intersects and
    touches run as covers, those two as intersects, as the legacy join did.
    Null and empty geometries join with nothing.
    """
    kinds = (kind_of(left, left_geom), kind_of(right, right_geom))
    if compat:
        predicate = {"touches": "intersects", "overlaps": "contains", "equals": "contains", "crosses": "contains"}.get(predicate, predicate)
    equal = predicate == "equals"
    condition = exact(predicate, F.col("l._geom"), F.col("r._geom"), kinds)
    if (predicate, *kinds) in SAID_BY_BOXES or (equal and kinds == ("rect", "rect")):
        condition = None
    return _join(left, right, left_geom, right_geom, (lambda df: box(df, left_geom), lambda df: box(df, right_geom)), condition, how, equal=equal)


def dealt_join(left: DataFrame, right: DataFrame, cells: Cells, predicate: str = "intersects", left_geom: str = "geom", right_geom: str = "geom") -> DataFrame:
    """Pairs of two frames that ``partitioning.partition`` dealt by the same cells: within a cell as any join; a pair counts in the cell of its boxes' common corner."""
    kinds = (kind_of(left, left_geom), kind_of(right, right_geom))
    names = [[c for c in df.columns if c != "cell_id"] for df in (left, right)]
    sides = [df.select(F.struct(*(df[c] for c in n)).alias("_row"), box(df, g).alias("_box"), df[g].alias("_geom"), df["cell_id"].alias("_cell")) for df, g, n in zip((left, right), (left_geom, right_geom), names, strict=True)]
    met = F.col("l._cell") == cells.owner_of(F.col("l._box"), F.col("r._box"))
    if (predicate, *kinds) not in SAID_BY_BOXES:
        met = met & exact(predicate, F.col("l._geom"), F.col("r._geom"), kinds)
    pairs = _pairs(*sides, (kinds[0] == "point", kinds[1] == "point"), met, predicate == "equals", "_cell")
    return pairs.select(*_fields("l._row", names[0], []), *_fields("r._row", names[1], names[0]))


def distance_join(left: DataFrame, right: DataFrame, radius: float | str | Column, left_geom: str = "geom", right_geom: str = "geom", strict: bool = False, how: str = "inner") -> DataFrame:
    """Pairs at a distance of at most ``radius`` (less, if strict): a number, or a column of the left side."""
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else N.col(radius)
    kinds = (kind_of(left, left_geom), kind_of(right, right_geom))
    d = distance(F.col("l._geom"), F.col("r._geom"), kinds)
    condition = d < F.col("l._radius") if strict else d <= F.col("l._radius")
    boxes = (lambda df: N.grow(box(df, left_geom), r), lambda df: box(df, right_geom))
    return _join(left, right, left_geom, right_geom, boxes, condition, how, grown=True, _radius=r)


def count_by_key(joined: DataFrame, *keys: str) -> DataFrame:
    return joined.groupBy(*keys).agg(F.count("*").alias("count"))


def collect_by_key(joined: DataFrame, keys: list[str], value: str) -> DataFrame:
    return joined.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values"))


def range_query(df: DataFrame, window: Geom | tuple[float, float, float, float], geom: str = "geom", boundary: bool = False, covers_window: bool = False) -> DataFrame:
    """Rows covered by the window (a rectangle, or a geometry); with ``boundary`` those that intersect it; with ``covers_window`` those that cover it.

    Boxes are compared first, natively, so that statistics of the files apply.
    """
    from geoloom.kernel.geometry import bbox

    rect = window if not isinstance(window, Geom) else bbox(window)
    if rect is None:
        return df.where(F.lit(False))
    w = N.rectangle(*(F.lit(float(v)) for v in rect))
    kind = kind_of(df, geom)
    if kind == "point":  # plain comparisons on the fields: pushed down
        p = df[geom]
        near = (p["x"] >= rect[0]) & (p["x"] <= rect[2]) & (p["y"] >= rect[1]) & (p["y"] <= rect[3])
    else:
        near = N.rect_intersects(box(df, geom), w)
    other = "rect" if not isinstance(window, Geom) else "wkb"
    shape = w if other == "rect" else literal(window)
    if covers_window:
        return df.where(near).where(exact("contains", df[geom], shape, (kind, other)))
    if boundary:
        return df.where(near).where(exact("intersects", df[geom], shape, (kind, other)))
    return df.where(near).where(exact("contains", shape, df[geom], (other, kind)))


def knn_query(df: DataFrame, x: float, y: float, k: int, geom: str = "geom", tie: str | None = None) -> DataFrame:
    """The k rows nearest to a point, with their distance; ties by ``tie``. Each task keeps k rows."""
    d = distance(df[geom], N.point(F.lit(float(x)), F.lit(float(y))), (kind_of(df, geom), "point"))
    order = [F.col("distance"), *([F.col(tie)] if tie else [])]
    return df.withColumn("distance", d).where(F.col("distance").isNotNull()).orderBy(*order).limit(k)


def knn_join(queries: DataFrame, objects: DataFrame, k: int, query_id: str, object_id: str, query_geom: str = "geom", object_geom: str = "geom") -> DataFrame:
    """(query_id, object_id, distance, rank): the k nearest objects of each query, ties by object id.

    Searches with a radius that doubles: within it every object is found, so a
    query with k or more is settled; the others go on.  The first radius aims at
    a few times k objects; the last covers everything.
    """
    q = queries.select(F.col(query_id).alias("_q"), F.col(query_geom).alias("geom"))
    o = objects.select(F.col(object_id).alias("_o"), F.col(object_geom).alias("geom"))
    kinds = (kind_of(q, "geom"), kind_of(o, "geom"))
    both = q.select(box(q, "geom").alias("b")).union(o.select(box(o, "geom").alias("b")))
    s = both.agg(F.min("b.xmin").alias("x0"), F.min("b.ymin").alias("y0"), F.max("b.xmax").alias("x1"), F.max("b.ymax").alias("y1")).first()
    n = o.count()
    if s.x0 is None or not n:
        kind = T.StructType([T.StructField("query_id", q.schema["_q"].dataType), T.StructField("object_id", o.schema["_o"].dataType), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return queries.sparkSession.createDataFrame([], kind)
    w, h = max(s.x1 - s.x0, 1e-9), max(s.y1 - s.y0, 1e-9)
    whole = math.hypot(w, h)
    radius = min(math.sqrt(2.0 * k * w * h / (math.pi * n)), whole)
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_o"))
    open_, out = q, None
    while True:
        pairs = distance_join(open_, o, radius)
        d = distance(F.col("geom"), F.col("geom_right"), kinds)
        near = stored(pairs.withColumn("distance", d).select("_q", "_o", "distance").withColumn("rank", rank).where(F.col("rank") <= k))
        if radius >= whole:
            part = near
        else:
            full = near.where(F.col("rank") == k).select("_q")
            part = near.join(full, "_q", "left_semi")
        out = part if out is None else out.union(part)
        if radius >= whole:
            break
        open_ = open_.join(full, "_q", "left_anti")
        if open_.limit(1).count() == 0:
            break
        radius = min(radius * 2, whole)
    return out.select(F.col("_q").alias("query_id"), F.col("_o").alias("object_id"), "distance", "rank")
