"""Places of rows in a global order, without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.sources.tables import materialize


def numbered(df: DataFrame, scope: list[str], order: list[str | Column], name: str, first: int = 1) -> DataFrame:
    """Adds the place of each row in the order of its scope, counted from `first`; NULL is a scope of its own.

    Rows are cut into ranges of scope and order and sorted range by range, so that a scope of any size is spread over
    tasks. The ids that a sorted range gives its rows are consecutive; the rows of a scope in the ranges before are added.
    Ties get different places; the order should name enough columns to have none. An empty table stays empty.
    """
    by = [F.col(s).asc_nulls_first() for s in scope] + [F.col(o).asc() if isinstance(o, str) else o for o in order]
    if df.isEmpty():
        return df.withColumn(name, F.lit(first).cast("long"))
    ordered = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    marks = [F.coalesce(F.col(s).cast("string"), F.lit("\0")).alias(f"_s{i}") for i, s in enumerate(scope)]
    keys = [f"_s{i}" for i in range(len(scope))]
    sizes = ordered.select(*marks, part, "_id").groupBy(*keys, "_part").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    # one row per scope and range
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ordered.select("*", *marks, part).join(starts, [*keys, "_part"])
    return placed.select(*df.columns, (F.col("_id") - F.col("_least") + F.col("_before") + first).alias(name))


def dense_ranks(values: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Distinct rows with their rank from 0."""
    return numbered(values.distinct(), [], order, name, 0)
