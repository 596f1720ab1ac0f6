"""Band algebra on ARRAY<DOUBLE> columns, all as higher-order expressions.

Names are those of the SQL functions in lower case.  Binary functions need
bands of one length (otherwise they raise); null bands give null.  Results that
are rounded are rounded to two places, halves up: floor(v * 100 + 0.5) / 100.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.native import ColumnOrName, col


def _round(v: Column) -> Column:
    return F.floor(v * 100 + 0.5) / 100


def _zip(a: ColumnOrName, b: ColumnOrName, f) -> Column:
    a, b = col(a), col(b)
    wrong = F.raise_error(F.lit("bands differ in length")).cast("array<double>")
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(wrong))


def rs_addbands(a, b) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def rs_subtractbands(a, b) -> Column:
    """The second less the first."""
    return _zip(a, b, lambda x, y: y - x)


def rs_multiplybands(a, b) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def rs_dividebands(a, b) -> Column:
    return _zip(a, b, lambda x, y: _round(F.try_divide(x, y)))


def rs_bitwiseand(a, b) -> Column:
    return _zip(a, b, lambda x, y: x.cast("int").bitwiseAND(y.cast("int")).cast("double"))


def rs_bitwiseor(a, b) -> Column:
    return _zip(a, b, lambda x, y: x.cast("int").bitwiseOR(y.cast("int")).cast("double"))


def rs_logicaldifference(a, b) -> Column:
    return _zip(a, b, lambda x, y: F.when(x != y, x).otherwise(0.0))


def rs_logicalover(a, b) -> Column:
    return _zip(a, b, lambda x, y: F.when(x != 0, x).otherwise(y))


def rs_normalizeddifference(a, b) -> Column:
    """(b - a) / (b + a), zeros counting as -1."""

    def one(x: Column, y: Column) -> Column:
        x, y = F.when(x == 0, -1.0).otherwise(x), F.when(y == 0, -1.0).otherwise(y)
        return _round(F.try_divide(y - x, y + x))

    return _zip(a, b, one)


def rs_multiplyfactor(a, k) -> Column:
    return F.transform(col(a), lambda x: x * _value(k))


def rs_modulo(a, m) -> Column:
    return F.transform(col(a), lambda x: F.try_mod(x, _value(m).cast("double")))


def rs_squareroot(a) -> Column:
    return F.transform(col(a), lambda x: _round(F.sqrt(x)))


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _mask(a, t, f) -> Column:
    return F.transform(col(a), lambda x: F.when(f(x, _value(t)), 1.0).otherwise(0.0))


def rs_greaterthan(a, t) -> Column:
    return _mask(a, t, lambda x, v: x > v)


def rs_greaterthanequal(a, t) -> Column:
    return _mask(a, t, lambda x, v: x >= v)


def rs_lessthan(a, t) -> Column:
    return _mask(a, t, lambda x, v: x < v)


def rs_lessthanequal(a, t) -> Column:
    return _mask(a, t, lambda x, v: x <= v)


def rs_count(a, t) -> Column:
    return F.when(col(a).isNotNull(), F.size(F.filter(col(a), lambda x: x == _value(t))))


def rs_mean(a) -> Column:
    a = col(a)
    return _round(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a)))


def rs_mode(a) -> Column:
    """All most frequent values, ascending: one walk over the sorted band."""
    a = col(a)
    kind = "struct<v:double,n:int,best:int,all:array<double>>"
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("best"), F.array().cast("array<double>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(s["v"] == x, s["n"] + 1).otherwise(1)
        every = F.when(n > s["best"], F.array(x)).when(n == s["best"], F.concat(s["all"], F.array(x))).otherwise(s["all"])
        return F.struct(x.alias("v"), n.alias("n"), F.greatest(s["best"], n).alias("best"), every.alias("all")).cast(kind)

    return F.aggregate(F.array_sort(a), start.cast(kind), step, lambda s: s["all"])


def rs_normalize(a) -> Column:
    """Values scaled so that the largest becomes 255, cut to whole numbers."""
    a = col(a)
    return F.transform(a, lambda x: F.try_divide(x, F.array_max(a) / 255).cast("int").cast("double"))


def rs_fetchregion(a, region, size) -> Column:
    """The window [row0, column0, row1, column1] (inclusive) of a band; size[0] is the length of a row."""
    a, region, size = col(a), _ints(region), _ints(size)
    width = F.get(size, F.lit(0))
    rows = F.sequence(F.get(region, F.lit(0)), F.get(region, F.lit(2)))
    c0, c1 = F.get(region, F.lit(1)), F.get(region, F.lit(3))
    return F.flatten(F.transform(rows, lambda r: F.slice(a, r * width + c0 + 1, c1 - c0 + 1)))


def _ints(v) -> Column:
    return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else col(v)


def rs_getband(data, i, n) -> Column:
    """The i-th (from 1) of n bands that stand one behind the other."""
    data = col(data)
    each = F.floor(F.size(data) / _value(n)).cast("int")
    return F.slice(data, ((_value(i) - 1) * each + 1).cast("int"), each)


def rs_array(n, v) -> Column:
    return F.array_repeat(_value(v).cast("double"), _value(n).cast("int"))


def rs_html(image, width="200") -> Column:
    return F.concat(F.lit('<img src="data:image/png;base64,'), col(image), F.lit('" width="'), F.lit(str(width)), F.lit('" />'))
