"""Joins on time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` that holds at its time.

    A right row holds from ``since`` on, until the next one of the same
    ``by``; of rows since the same moment the one with the greatest values
    holds.  Rows with a null key or time take no part on the right and get
    nulls on the left.  One shuffle by key: both sides are put in one order
    and the last right row is carried along, so no pair is ever made.
    """
    kept = [c for c in left.columns if c not in values]
    last = F.struct(F.col(since).alias("_t"), *[F.col(c) for c in values])
    marks = right.where(F.col(since).isNotNull()).select(*by, F.col(since).alias("_at"), last.alias("_v"), F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in kept])
    rows = left.select(*by, F.col(at).alias("_at"), F.lit(None).cast(marks.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"), *[F.col(c).alias(f"_l_{c}") for c in kept])
    # The greatest mark so far is the latest one; marks come before rows of the same moment.
    order = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.lit(True)
    for c in [*by, "_at"]:
        known = known & F.col(c).isNotNull()
    carried = marks.unionByName(rows).withColumn("_held", F.max("_v").over(order)).where("_side = 1")
    return carried.select(*[F.col(f"_l_{c}").alias(c) for c in kept], *[F.when(known, F.col("_held").getField(c)).alias(c) for c in values])
