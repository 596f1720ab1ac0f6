"""Spatial joins written in SQL: ``spatial_sql(spark, text)``.

Spark alone answers ``JOIN ... ON ST_Contains(a.g, b.g)`` with a nested loop.
Here the analysed plan is searched for joins (inner, left, semi, anti) whose
condition has a spatial predicate (or ``ST_Distance(a, b) < r``) between the two sides; such a join is
replaced by the cell join of ``operators.joins``, which delivers the very same
attributes, and the other conjuncts become a filter above it.  Points and
rectangles that a side makes by ``ST_Point`` or ``ST_PolygonFromEnvelope`` are
taken as native columns, without Python.  Whatever has another shape - right
and full joins, predicates under OR, radii of both sides - stays as Spark plans
it, or refuses it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import native as N
from geoloom.operators import joins as J
from geoloom.operators.geometry import box, distance, exact, kind_of
from geoloom.plans.durable import stored

#: SQL names of the predicates, and what they mean for (first argument, second argument).
PREDICATES = {"st_contains": "contains", "st_within": "within", "st_intersects": "intersects", "st_crosses": "crosses", "st_overlaps": "overlaps", "st_touches": "touches", "st_equals": "equals"}


#: Kinds of joins that are rewritten.
HOW = {"INNER": "inner", "CROSS": "inner", "LEFT OUTER": "left", "LEFT SEMI": "left_semi", "LEFT ANTI": "left_anti"}


@dataclass
class Found:
    predicate: str | None  # None: a distance
    left: object
    right: object
    radius: object = None
    strict: bool = False
    radius_on_right: bool = False


class Rewriter:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm
        self.joins = 0
        self.column_of = getattr(self.jvm.org.apache.spark.sql.classic, "ExpressionUtils").column

    # --- plans and expressions of the JVM ---

    def seq(self, values: list):
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(values)

    def items(self, seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def frame(self, plan) -> DataFrame:
        made = getattr(getattr(self.jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$").ofRows(self.spark._jsparkSession, plan)
        return DataFrame(made, self.spark)

    def column(self, expression) -> Column:
        return Column(self.column_of(expression))

    @staticmethod
    def is_a(node, name: str) -> bool:
        return node.getClass().getSimpleName() == name

    def udf_name(self, e) -> str:
        return e.name().lower() if self.is_a(e, "PythonUDF") else ""

    def conjuncts(self, e) -> list:
        return [x for side in (e.left(), e.right()) for x in self.conjuncts(side)] if self.is_a(e, "And") else [e]

    def side(self, e, left, right) -> str | None:
        """Which side all columns of an expression come from; "any" for a constant."""
        refs = e.references()
        if refs.isEmpty():
            return "any"
        return "left" if refs.subsetOf(left.outputSet()) else "right" if refs.subsetOf(right.outputSet()) else None

    # --- recognition ---

    def detect(self, e, left, right) -> Found | None:
        name = self.udf_name(e)
        if name in PREDICATES and e.children().size() == 2:
            a, b = self.items(e.children())
            sides = (self.side(a, left, right), self.side(b, left, right))
            if sides == ("left", "right"):
                return Found(PREDICATES[name], a, b)
            if sides == ("right", "left"):  # the predicate with its arguments exchanged
                turned = {"contains": "within", "within": "contains"}
                return Found(turned.get(PREDICATES[name], PREDICATES[name]), b, a)
        if any(self.is_a(e, x) for x in ("LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual")):
            d, r = (e.left(), e.right()) if e.getClass().getSimpleName().startswith("Less") else (e.right(), e.left())
            if self.udf_name(d) != "st_distance":
                return None
            a, b = self.items(d.children())
            sides, of = (self.side(a, left, right), self.side(b, left, right)), self.side(r, left, right)
            if set(sides) == {"left", "right"} and of is not None and r.deterministic():
                a, b = (a, b) if sides == ("left", "right") else (b, a)
                return Found(None, a, b, r, not e.getClass().getSimpleName().endswith("OrEqual"), of == "right")
        return None

    def bare(self, plan):
        """The plan below names and views, which deliver the same attributes."""
        while self.is_a(plan, "SubqueryAlias") or self.is_a(plan, "View"):
            child = plan.child()
            if [a.exprId() for a in self.items(child.output())] != [a.exprId() for a in self.items(plan.output())]:
                return plan
            plan = child
        return plan

    def made_by(self, plan, e):
        """What an attribute is made of by a projection or alias below, with the plan that has its inputs."""
        if not self.is_a(e, "AttributeReference"):
            return None
        plan = self.bare(plan)
        while self.is_a(plan, "Filter"):
            plan = self.bare(plan.child())
        if self.is_a(plan, "Project"):
            for x in self.items(plan.projectList()):
                if x.exprId() == e.exprId() and self.is_a(x, "Alias"):
                    return x.child()
                if x.exprId() == e.exprId():
                    return self.made_by(plan.child(), e)
        return None

    def native(self, made) -> Column | None:
        """A native point or rectangle for a call that makes one."""
        name = self.udf_name(made) if made is not None else ""
        args = [self.column(x).cast("double") for x in self.items(made.children())] if name in ("st_point", "st_polygonfromenvelope") else []
        return N.point(*args) if len(args) == 2 else N.rectangle(*args) if len(args) == 4 else None

    def with_geometry(self, plan, e) -> DataFrame:
        """The side with its geometry as ``_geom``, native where it can be."""
        shape = self.native(e)
        if shape is not None:
            return self.frame(plan).withColumn("_geom", shape)
        shape = self.native(self.made_by(plan, e))
        if shape is not None:
            extended = self.extended(plan, e, shape)
            if extended is not None:
                return extended
        return self.frame(plan).withColumn("_geom", self.column(e))

    def extended(self, plan, e, shape: Column) -> DataFrame | None:
        """The plan with one more column, made in the projection that makes the attribute."""
        plan = self.bare(plan)
        if self.is_a(plan, "Filter"):
            below = self.extended(plan.child(), e, shape)
            if below is None:
                return None
            inner = below._jdf.queryExecution().analyzed()
            return self.frame(self.jvm.org.apache.spark.sql.catalyst.plans.logical.Filter(plan.condition(), inner))
        if self.is_a(plan, "Project"):
            for x in self.items(plan.projectList()):
                if x.exprId() == e.exprId() and self.is_a(x, "Alias"):
                    own = self.items(plan.projectList())
                    made = self.frame(plan.child()).select(shape.alias("_geom"))._jdf.queryExecution().analyzed()
                    return self.frame(self.jvm.org.apache.spark.sql.catalyst.plans.logical.Project(self.seq([*own, made.projectList().apply(0)]), plan.child()))
        return None

    # --- rewriting ---

    def rewritten(self, plan):
        children = self.items(plan.children())
        fresh = [self.rewritten(c) for c in children]
        if any(a is not b for a, b in zip(children, fresh, strict=True)):
            plan = plan.withNewChildren(self.seq(fresh))
        if self.is_a(plan, "Join") and plan.condition().isDefined() and plan.joinType().sql().upper() in HOW:
            parts = self.conjuncts(plan.condition().get())
            for k, e in enumerate(parts):
                found = self.detect(e, plan.left(), plan.right())
                if found is not None:
                    return self.joined(plan, found, parts[:k] + parts[k + 1 :])
        if self.is_a(plan, "Filter"):  # FROM a, b WHERE ...: a cross join below its condition
            join = self.bare(plan.child())
            if self.is_a(join, "Join") and join.joinType().sql().upper() in ("INNER", "CROSS") and join.condition().isEmpty():
                parts = self.conjuncts(plan.condition())
                for k, e in enumerate(parts):
                    found = self.detect(e, join.left(), join.right())
                    if found is not None:
                        return self.joined(join, found, parts[:k] + parts[k + 1 :])
        return plan

    def packed(self, side: DataFrame, plan, radius: Column | None) -> tuple[DataFrame, list]:
        attributes = self.items(plan.output())
        row = F.struct(F.lit(0).alias("none"), *(self.column(a).alias(f"c{i}") for i, a in enumerate(attributes)))
        boxed = box(side, "_geom")
        boxed = boxed if radius is None else N.grow(boxed, radius)
        more = [] if radius is None else [radius.alias("_radius")]
        return side.select(row.alias("_row"), boxed.alias("_box"), F.col("_geom"), *more), attributes

    def joined(self, plan, found: Found, others: list):
        self.joins += 1
        sides = [self.with_geometry(p, e) for p, e in ((plan.left(), found.left), (plan.right(), found.right))]
        kinds = tuple(kind_of(s, "_geom") for s in sides)
        radius = None if found.radius is None else self.column(found.radius).cast("double")
        grown = [None, None]
        if radius is not None:
            grown[1 if found.radius_on_right else 0] = radius
        how = HOW[plan.joinType().sql().upper()]
        packed = [self.packed(s, p, r) for s, p, r in zip(sides, (plan.left(), plan.right()), grown, strict=True)]
        if how != "inner":
            packed[0] = (stored(packed[0][0].withColumn("_id", F.monotonically_increasing_id())), packed[0][1])
        l, r = F.col("l._geom"), F.col("r._geom")
        points = tuple(k == "point" and r is None for k, r in zip(kinds, grown, strict=True))
        equal = found.predicate == "equals"
        condition = None
        if radius is None:
            if (found.predicate, *kinds) not in J.SAID_BY_BOXES:
                condition = exact(found.predicate, l, r, kinds)
        else:
            limit, d = F.col("r._radius" if found.radius_on_right else "l._radius"), distance(l, r, kinds)
            condition = d < limit if found.strict else d <= limit
        own = [("l._row", i, a) for i, a in enumerate(packed[0][1])]
        other = [("r._row", i, a) for i, a in enumerate(packed[1][1])]
        if how in ("left_semi", "left_anti") and not others:
            return self.unpacked(J._having(packed[0][0], packed[0][0], packed[1][0], points, condition, how, equal), own)
        pairs = J._pairs(packed[0][0], packed[1][0], points, condition, equal)
        if how == "inner":
            new = self.unpacked(pairs, own + other)
            for e in others:
                new = self.jvm.org.apache.spark.sql.catalyst.plans.logical.Filter(e, new)
            return new
        met = self.unpacked(pairs, own + other, [F.col("l._id").alias("_met"), F.col("r._row").alias("_row")])
        for e in others:
            met = self.jvm.org.apache.spark.sql.catalyst.plans.logical.Filter(e, met)
        met = self.frame(met).select("_met", "_row").alias("r")
        base = packed[0][0].select("_id", "_row").alias("l")
        if how == "left":
            return self.unpacked(base.join(met, F.col("l._id") == F.col("r._met"), "left"), own + other)
        return self.unpacked(base.join(met.select("_met").distinct(), F.col("l._id") == F.col("_met"), how), own)

    def unpacked(self, df: DataFrame, fields: list, more: list[Column] = ()):
        """A projection onto attributes of a packed row, under the ids they had: what stands above needs no change."""
        flat = df.select(*(F.col(row).getField(f"c{i}").alias(f"x{n}") for n, (row, i, _) in enumerate(fields)), *more)._jdf.queryExecution().analyzed()
        made = self.items(flat.projectList())
        expressions = self.jvm.org.apache.spark.sql.catalyst.expressions
        out = [expressions.Alias(x.child(), a.name(), a.exprId(), a.qualifier(), getattr(self.jvm.scala, "Option").empty(), self.seq([])) for x, (_, _, a) in zip(made, fields, strict=False)]
        return self.jvm.org.apache.spark.sql.catalyst.plans.logical.Project(self.seq(out + made[len(fields) :]), flat.child())


def spatial_sql(spark: SparkSession, text: str) -> DataFrame:
    """``spark.sql(text)`` with its spatial joins run by cells; the functions must be registered.

    The joins' statistics are gathered here, so this starts jobs.
    """
    df = spark.sql(text)
    rewriter = Rewriter(spark)
    plan = df._jdf.queryExecution().analyzed()
    new = rewriter.rewritten(plan)
    return rewriter.frame(new) if rewriter.joins else df
