"""JSON texts taken apart on the JVM: VARIANT values and ``variant_explode`` under a recursive query, no Python."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Containers may lie so deep in each other.
DEEPEST = 100


def parsed(text: Column) -> Column:
    """The JSON value that ``text`` is, as a variant; null if it is malformed, or has anything behind the value.

    The parser stops where a value ends, so the text is read as the one member of a list.
    """
    members = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(members) == 1, F.get(members, F.lit(0)))


def leaves(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, key, value, kind, place`` of every leaf of the JSON in ``text``: parts of its path joined by ``_``, places in lists
    are parts, empty containers vanish. Members of an outermost list are records of their own; malformed texts and
    bare values give nothing.

    ``kind``: string, number, boolean or null. ``place``: where the leaf stands, so that leaves can be put in order. A level of the
    recursion takes containers apart and goes on with what was in them, so each value is touched once. Keys of an object
    come in order of their names; a text with a key twice in one object counts as malformed.
    """
    spark, name = rows.sparkSession, f"json_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # as many rows as there are
    rows.select(F.col(ident).alias("ident"), parsed(F.col(text)).alias("v")).createOrReplaceTempView(name)
    holds = lambda v, *kinds: "(" + " or ".join(f"schema_of_variant({v}) like '{k}%'" for k in kinds) + ")"
    found = spark.sql(f"""
        with recursive tops as (
          select ident, 0 as pos, v from {name} where {holds('v', 'OBJECT')}
          union all
          select ident, e.pos, e.value from (select * from {name} where {holds('v', 'ARRAY')}), lateral variant_explode(v) e where {holds('e.value', 'OBJECT', 'ARRAY')}
        ), parts(ident, key, place, v) max recursion level {DEEPEST} as (
          select ident, '', array(format_string('%09d', pos)), v from tops
          union all
          select ident, concat_ws('_', nullif(parts.key, ''), coalesce(e.key, cast(e.pos as string))), array_append(place, coalesce(e.key, format_string('%09d', e.pos))), e.value
          from parts, lateral variant_explode(parts.v) e
        )
        select ident, key, v, place, schema_of_variant(v) as type from parts where key <> '' and not {holds('v', 'OBJECT', 'ARRAY')}""")
    kind = F.expr("case type when 'STRING' then 'string' when 'BOOLEAN' then 'boolean' when 'VOID' then 'null' else 'number' end")
    return found.select(F.col("ident").alias(ident), "key", F.expr("case when type <> 'VOID' then cast(v as string) end").alias("value"), kind.alias("kind"), "place")


def merged(found: DataFrame, ident: str) -> DataFrame:
    """One leaf for each key of a record; of several texts and places the last."""
    last = F.max_by(F.struct("value", "kind"), "place").alias("leaf")
    return found.groupBy(ident, "key").agg(last).select(ident, "key", "leaf.value", "leaf.kind")
