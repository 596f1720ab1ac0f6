"""SQL names for all functions: ``register(spark)``; ``unregister(spark)`` drops them."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import SparkSession

from geoloom.functions.kernels import FUNCTIONS, batched

# Band functions are inlined as SQL expressions: name, parameters, type of the result, body.
_BANDS = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_ZIP = "CASE WHEN size(a) = size(b) THEN zip_with(a, b, (x, y) -> {}) WHEN a IS NULL OR b IS NULL THEN NULL ELSE CAST(raise_error('bands differ in length') AS ARRAY<DOUBLE>) END"
_R = "floor(({}) * 100 + 0.5D) / 100"
SQL_FUNCTIONS = [
    ("RS_AddBands", _BANDS, "ARRAY<DOUBLE>", _ZIP.format("x + y")),
    ("RS_SubtractBands", _BANDS, "ARRAY<DOUBLE>", _ZIP.format("y - x")),
    ("RS_MultiplyBands", _BANDS, "ARRAY<DOUBLE>", _ZIP.format("x * y")),
    ("RS_DivideBands", _BANDS, "ARRAY<DOUBLE>", _ZIP.format(_R.format("try_divide(x, y)"))),
    ("RS_BitwiseAnd", _BANDS, "ARRAY<DOUBLE>", _ZIP.format("CAST(CAST(x AS INT) & CAST(y AS INT) AS DOUBLE)")),
    ("RS_BitwiseOr", _BANDS, "ARRAY<DOUBLE>", _ZIP.format("CAST(CAST(x AS INT) | CAST(y AS INT) AS DOUBLE)")),
    ("RS_LogicalDifference", _BANDS, "ARRAY<DOUBLE>", _ZIP.format("CASE WHEN x <> y THEN x ELSE 0D END")),
    ("RS_LogicalOver", _BANDS, "ARRAY<DOUBLE>", _ZIP.format("CASE WHEN x <> 0 THEN x ELSE y END")),
    ("RS_NormalizedDifference", _BANDS, "ARRAY<DOUBLE>", _ZIP.format(_R.format("try_divide(CASE WHEN y = 0 THEN -1D ELSE y END - CASE WHEN x = 0 THEN -1D ELSE x END, CASE WHEN y = 0 THEN -1D ELSE y END + CASE WHEN x = 0 THEN -1D ELSE x END)"))),
    ("RS_MultiplyFactor", "a ARRAY<DOUBLE>, k DOUBLE", "ARRAY<DOUBLE>", "transform(a, x -> x * k)"),
    ("RS_Modulo", "a ARRAY<DOUBLE>, m DOUBLE", "ARRAY<DOUBLE>", "transform(a, x -> try_mod(x, m))"),
    ("RS_SquareRoot", "a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", f"transform(a, x -> {_R.format('sqrt(x)')})"),
    ("RS_GreaterThan", "a ARRAY<DOUBLE>, t DOUBLE", "ARRAY<DOUBLE>", "transform(a, x -> CASE WHEN x > t THEN 1D ELSE 0D END)"),
    ("RS_GreaterThanEqual", "a ARRAY<DOUBLE>, t DOUBLE", "ARRAY<DOUBLE>", "transform(a, x -> CASE WHEN x >= t THEN 1D ELSE 0D END)"),
    ("RS_LessThan", "a ARRAY<DOUBLE>, t DOUBLE", "ARRAY<DOUBLE>", "transform(a, x -> CASE WHEN x < t THEN 1D ELSE 0D END)"),
    ("RS_LessThanEqual", "a ARRAY<DOUBLE>, t DOUBLE", "ARRAY<DOUBLE>", "transform(a, x -> CASE WHEN x <= t THEN 1D ELSE 0D END)"),
    ("RS_Count", "a ARRAY<DOUBLE>, t DOUBLE", "INT", "CASE WHEN a IS NOT NULL THEN size(filter(a, x -> x = t)) END"),
    ("RS_Mean", "a ARRAY<DOUBLE>", "DOUBLE", _R.format("try_divide(aggregate(a, 0D, (s, x) -> s + x), size(a))")),
    ("RS_Mode", "a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "aggregate(array_sort(a), named_struct('v', CAST(NULL AS DOUBLE), 'n', 0, 'best', 0, 'all', CAST(array() AS ARRAY<DOUBLE>)), (s, x) -> named_struct('v', x, 'n', CASE WHEN s.v = x THEN s.n + 1 ELSE 1 END, 'best', greatest(s.best, CASE WHEN s.v = x THEN s.n + 1 ELSE 1 END), 'all', CASE WHEN CASE WHEN s.v = x THEN s.n + 1 ELSE 1 END > s.best THEN array(x) WHEN CASE WHEN s.v = x THEN s.n + 1 ELSE 1 END = s.best THEN concat(s.all, array(x)) ELSE s.all END), s -> s.all)"),
    ("RS_Normalize", "a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(a, x -> CAST(CAST(try_divide(x, array_max(a) / 255) AS INT) AS DOUBLE))"),
    ("RS_FetchRegion", "a ARRAY<DOUBLE>, r ARRAY<INT>, s ARRAY<INT>", "ARRAY<DOUBLE>", "flatten(transform(sequence(r[0], r[2]), i -> slice(a, i * s[0] + r[1] + 1, r[3] - r[1] + 1)))"),
    ("RS_GetBand", "d ARRAY<DOUBLE>, i INT, n INT", "ARRAY<DOUBLE>", "slice(d, CAST((i - 1) * floor(size(d) / n) + 1 AS INT), CAST(floor(size(d) / n) AS INT))"),
    ("RS_Array", "n INT, v DOUBLE", "ARRAY<DOUBLE>", "array_repeat(v, n)"),
    ("RS_HTML", "image STRING, width STRING DEFAULT '200'", "STRING", "concat('<img src=\"data:image/png;base64,', image, '\" width=\"', width, '\" />')"),
]


def _aggregate(fold):
    from pyspark.sql.functions import pandas_udf

    from geoloom.kernel.geometry import from_wkb, to_wkb

    def run(g: pd.Series) -> bytes:
        found = fold([from_wkb(bytes(x)) for x in g if x is not None])
        return None if found is None else to_wkb(found)

    return pandas_udf(run, "binary")


def _render():
    """Pixels (struct x, y, res_x, res_y), their colours and, if given, a zoom level: a PNG of the group, a tile's size at that level."""
    from pyspark.sql.functions import pandas_udf

    from geoloom.viz.functions import draw

    def run(pixel: pd.Series, color: pd.Series, zoom: pd.Series) -> bytes:
        none = dict.fromkeys(("x", "y", "res_x", "res_y"))
        pixel = pd.DataFrame([none if p is None else p if isinstance(p, dict) else p.asDict() for p in pixel], columns=list(none), index=color.index)
        keep = pixel["x"].notna() & color.notna()
        pixel, color = pixel[keep], color[keep]
        if not len(pixel):
            return None
        n = 1 << int(zoom.iloc[0] if len(zoom) and zoom.iloc[0] == zoom.iloc[0] else 0)
        width, height = int(pixel["res_x"].iloc[0]) // n, int(pixel["res_y"].iloc[0]) // n
        x, y = (pixel["x"] % width if n > 1 else pixel["x"]), (pixel["y"] % height if n > 1 else pixel["y"])
        return draw(width, height, zip(x.astype(int).tolist(), y.astype(int).tolist(), color.astype(int).tolist(), strict=True))

    return pandas_udf(run, "binary")


def aggregates() -> dict:
    """Grouped-aggregate functions on WKB; an empty group, or one of nulls, gives null."""
    from geoloom.operators import aggregates as A

    return {"ST_Render": _render(), "ST_Union_Aggr": _aggregate(A.fold_union), "ST_Envelope_Aggr": _aggregate(A.fold_envelope), "ST_Intersection_Aggr": _aggregate(A.fold_intersection)}


def generators() -> dict:
    """Table functions: one row (geom) for each part."""
    from pyspark.sql.functions import udtf

    from geoloom.kernel.geometry import from_wkb, to_wkb
    from geoloom.kernel.overlay import make_valid, subdivide

    @udtf(returnType="geom: binary")
    class MakeValid:
        def eval(self, g: bytes, remove_holes: bool = False):
            if g is not None:
                for x in make_valid(from_wkb(bytes(g)), bool(remove_holes)):
                    yield (to_wkb(x),)

    @udtf(returnType="geom: binary")
    class SubDivide:
        def eval(self, g: bytes, most: int):
            if g is not None and most is not None:
                for x in subdivide(from_wkb(bytes(g)), int(most)):
                    yield (to_wkb(x),)

    return {"ST_MakeValid": MakeValid, "ST_SubDivideExplode": SubDivide}


def function(name: str):
    """The function of that SQL name, for use on columns."""
    from geoloom.viz.functions import FUNCTIONS as PICTURES

    kind, f = {**FUNCTIONS, **PICTURES}[name]
    return batched(f, kind)


def register(spark: SparkSession) -> None:
    """Registers every function under its SQL name; may be called again."""
    from geoloom.viz.functions import FUNCTIONS as PICTURES

    for name, (kind, f) in {**FUNCTIONS, **PICTURES}.items():
        spark.udf.register(name, batched(f, kind))
    for name, f in aggregates().items():
        spark.udf.register(name, f)
    for name, f in generators().items():
        spark.udtf.register(name, f)
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


#: Names that Spark has functions for itself: SQL cannot drop what was put over them.
BUILT_IN = {"ST_GeomFromWKB", "ST_AsBinary", "ST_SRID", "ST_SetSRID"}


def unregister(spark: SparkSession) -> None:
    """Drops what ``register`` made, but for the names in ``BUILT_IN``, which stay as they are until the session ends."""
    from geoloom.viz.functions import FUNCTIONS as PICTURES

    for name in sorted({*FUNCTIONS, *PICTURES, *aggregates(), *generators(), *(x[0] for x in SQL_FUNCTIONS)} - BUILT_IN):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


__all__ = ["function", "register", "unregister"]
