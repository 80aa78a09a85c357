"""Functions of single values: comparison, arithmetic, rounding, texts, names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.breaks import class_breaks
from ..plans.model import PlanError, Row, col, fresh, merged
from ..plans.planner import derived, function
from .aggregates import equals, literal, number

BOOL, INT, DOUBLE, TEXT = T.BooleanType(), T.IntegerType(), T.DoubleType(), T.StringType()


@function("GET", 1, pack="default")
def get(p, table, tree):
    return replace(p.value(table, tree.args[0]), name=tree.name)


@function("WHERE", 2, pack="default")
def where(p, table, tree):
    value = literal(tree.args[1])
    return p.mapped(table, tree, lambda v, k: F.when(equals(v, k, value), v), None, 0)


@function("GREATERTHAN", 2, pack="compare")
def greater_than(p, table, tree):
    n = number(tree.args[1])
    return p.mapped(table, tree, lambda v, k: v > F.lit(n), BOOL, False)


@function("MATH_EQUAL", 2, pack="math")
def math_equal(p, table, tree):
    value = literal(tree.args[1])
    return p.mapped(table, tree, lambda v, k: equals(v, k, value), BOOL, False)


@function("MATH_NOTNULL", 1, pack="math")
def math_not_null(p, table, tree):
    return p.mapped(table, tree, lambda v, k: v.isNotNull(), BOOL, False)


@function("MATH_DIVIDE", 2, pack="math")
def math_divide(p, table, tree):
    """a / (b + 0.001) on the filled rows of the current table."""
    a, b = (p.row(table, p.value(table, x)) for x in tree.args)
    return Row(lambda: F.try_divide(a.make().cast("double"), b.make().cast("double") + F.lit(0.001)), DOUBLE, tree.name, merged(a.joins, b.joins))


@function("ROUND_FLOAT", 2, pack="round")
def round_float(p, table, tree):
    n = int(number(tree.args[1]))
    return p.mapped(table, tree, lambda v, k: F.bround(v.cast("double"), n).try_cast("int"), INT, -1)


@function("ROUND_CLUSTER", (2, 3), pack="round")
def round_cluster(p, table, tree):
    """The upper break of a value's natural class, as an integer; with "compat" the value itself."""
    k = int(number(tree.args[1]))
    compat = len(tree.args) > 2 and literal(tree.args[2]) == "compat"
    frame = p.frame(table, p.value(table, tree.args[0]))
    if compat:
        return p.mapped(table, tree, lambda v, kind: v.cast("double").try_cast("int"), INT, -1)

    def make(df, keys, value):
        edges = class_breaks(df.select(col(value).cast("double").alias("v")), k)
        out = F.lit(None).cast("int")
        for edge in reversed(edges):
            out = F.when(col(value).cast("double") <= F.lit(edge), F.lit(int(edge))).otherwise(out)
        return df.select(*(col(c) for c in keys), out.alias(value))

    return derived(p, replace(frame, sparse=True), tree, make, INT, -1)


@function("EMAIL_DOMAIN", 1, pack="formatter")
def email_domain(p, table, tree):
    return p.mapped(table, tree, lambda v, k: F.when(F.contains(v, F.lit("@")), F.lower(F.split(v, "@")[1])), TEXT, "")


@function("DOMAIN_EXT", 1, pack="formatter")
def domain_ext(p, table, tree):
    return p.mapped(table, tree, lambda v, k: F.when(F.instr(v, ".") > 0, F.substr(v, F.instr(v, ".") + F.lit(1))), TEXT, "")


@function("PEOPLE_GENDER", 1, pack="people")
def people_gender(p, table, tree):
    """The dictionary's gender of a first name, whatever its case; 'unknown' for other names, '' for none."""
    if p.genders is None:
        raise PlanError("PEOPLE_GENDER needs a dictionary: assemble(..., genders=DataFrame of name, gender)")
    names = p.genders.select(F.lower(F.trim("name")).alias("name"), "gender").where("name IS NOT NULL").groupBy("name").agg(F.min("gender").alias("gender"))
    value = p.value(table, tree.args[0])
    first = lambda v: F.lower(F.split(F.trim(v), r"\s+")[0])
    if isinstance(value, Row):
        out, key = fresh("g"), len(p.lookups)
        p.lookups[key] = names
        # the looked-up column must be on the row before it is joined
        own = fresh("n")
        joins = merged(value.joins, {("column", own): {own: Row(lambda: first(value.make()), TEXT, own)}, ("lookup", key, own): {out: None}})
        return Row(lambda: F.when(value.make().isNotNull(), F.coalesce(col(out), F.lit("unknown"))).otherwise(""), TEXT, tree.name, joins)

    def make(df, keys, v):
        key = fresh("n")
        joined = df.withColumn(key, first(col(v))).join(names.withColumnRenamed("name", key), key, "left")
        return joined.select(*(col(c) for c in keys), F.coalesce("gender", F.lit("unknown")).alias(v))

    return derived(p, replace(value, sparse=True), tree, make, TEXT, "")
