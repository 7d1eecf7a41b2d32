"""Steering the optimiser where its default would repeat costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_above(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that meet a condition on computed columns, which are computed once.

    A plain filter is pushed below the projection and takes copies of its expressions along; list tests then read the
    text's expression once per entry. It stops at a generator.
    """
    test = F.expr(condition) if isinstance(condition, str) else condition
    return df.select("*", F.explode(F.array(test)).alias("_kept")).where("_kept").drop("_kept")
