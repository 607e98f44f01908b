"""Ordered operators on keys of any length: a key's rows are cut into ranges of its order,
judged range by range in many tasks, and what crosses an edge is carried over in a second,
small pass of one row for each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 18


def range_of(rows: DataFrame, order: str) -> Column:
    """The range that a row is in, in order with it: a day of times and dates, WIDTH numbers
    of whole ones."""
    kind = rows.schema[order].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.datediff(F.to_date(order), F.lit("1970-01-01").cast("date")).cast("bigint")
    if kind == "date":
        return F.trunc(order, "month")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.floor(F.col(order) / WIDTH).cast("bigint")
    raise TypeError(f"no ranges of {kind}")


def with_previous(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Adds ``before_<c>`` of the row before in a key's order, null for the first: what
    lag gives over the whole key, where ``order`` tells rows apart. Rows of a null order
    come first, as one range."""
    dealt = rows.withColumn("_range", range_of(rows, order)).repartition(key, "_range")
    inner = Window.partitionBy(key, "_range").orderBy(order)
    lagged = dealt.withColumn("_place", F.row_number().over(inner)).withColumns({f"before_{c}": F.lag(c).over(inner) for c in columns})
    row = F.struct(*(F.col(c).alias(f"_of_{c}") for c in columns))
    last = F.coalesce(F.max_by(row, order), F.first(row))  # the second in a range of null orders
    ends = dealt.groupBy(key, "_range").agg(last.alias("_last"))
    carried = ends.select(key, "_range", F.lag("_last").over(Window.partitionBy(key).orderBy(F.asc_nulls_first("_range"))).alias("_carried"))
    same = F.col(f"l.{key}").eqNullSafe(F.col(f"c.{key}")) & F.col("l._range").eqNullSafe(F.col("c._range"))
    joined = lagged.alias("l").join(carried.alias("c"), same, "left")
    first = F.col("l._place") == 1
    return joined.select(*(F.col(f"l.`{c}`") for c in rows.columns), *(F.when(first, F.col(f"c._carried._of_{c}")).otherwise(F.col(f"l.before_{c}")).alias(f"before_{c}") for c in columns))
