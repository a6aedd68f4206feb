"""Whole-table totals next to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate as a scalar subquery: no join, and the rows are not moved."""
    packed = totals.select(F.struct(*totals.columns).alias("t")).scalar()
    wide = df.withColumn("_totals", packed)
    return wide.select(*df.columns, *[F.col("_totals")[c].alias(c) for c in totals.columns])
