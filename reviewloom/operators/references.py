"""References to records that do not exist, or that arrived after the record that refers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_id(column: str | F.Column) -> F.Column:
    """Identifier without surrounding white space (any script's), lower-cased; blank ones become NULL."""
    value = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def orphan_references(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Children whose parent is missing or late.

    parents: scope, id, created_at. children: ref_table, scope, id, ref_key, created_at.
    Result: distinct (ref_table, ref_month, scope, ref_key, id, kind); kind `missing` if the scope has no such parent, `late`
    if its earliest parent is younger than the earliest reference of that month. NULL ids and scopes are no references;
    repeated rows count once; a parent or child without created_at is never late.

    Both sides go into one long form and are grouped by key once, with partial sums before the shuffle, so that a key that
    is repeated in a third of all rows still reaches its group as one row per task. Only keys without a timely parent are
    joined back to their references.
    """
    month = F.date_format("created_at", "yyyy-MM")
    refs = children.where("id is not null and scope is not null").groupBy("ref_table", month.alias("ref_month"), "scope", "ref_key", "id").agg(F.min("created_at").alias("ref_at"))
    marks = parents.where("id is not null and scope is not null").select("scope", "id", F.lit(1).alias("is_parent"), F.col("created_at").alias("parent_at"), F.lit(None).cast("timestamp").alias("ref_at"))
    # from the grouped references, whose shuffle is shared, so that children are read and decoded once
    long = marks.unionByName(refs.select("scope", "id", F.lit(0).alias("is_parent"), F.lit(None).cast("timestamp").alias("parent_at"), F.col("ref_at").cast("timestamp").alias("ref_at")))
    keys = long.groupBy("scope", "id").agg(F.max("is_parent").alias("is_parent"), F.min("parent_at").alias("parent_at"), F.min("ref_at").alias("first_ref_at"))
    suspect = keys.where("is_parent = 0 or parent_at > first_ref_at").select("scope", "id", "is_parent", "parent_at")
    found = refs.join(suspect, ["scope", "id"]).withColumn("kind", F.when(F.col("is_parent") == 0, "missing").when(F.col("parent_at") > F.col("ref_at").cast("timestamp"), "late"))
    return found.where("kind is not null").select("ref_table", "ref_month", "scope", "ref_key", "id", "kind")


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Counts of orphan references per table, month and kind."""
    return orphans.groupBy("ref_table", "ref_month", "kind").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("id").alias("n_ids"))
