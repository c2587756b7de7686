"""Sequence numbers in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: list[str], order: list[str], key: Column, name: str, width: int = 4096, base: DataFrame | None = None) -> DataFrame:
    """df with `name`: 1, 2, 3, ... inside each group, in `order`. key is a long that never falls along
    `order`; each range of `width` keys is numbered by itself and shifted by the counts of the ranges before it, so a
    group of any size is spread over tasks. base (group columns, last) starts a group after its last number."""
    ranged = df.withColumn("_lamina_range", F.coalesce(F.floor(key / width), F.lit(0)))
    counts = ranged.groupBy(*group, "_lamina_range").agg(F.count(F.lit(1)).alias("_lamina_n"))
    before = Window.partitionBy(*group).orderBy("_lamina_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group, "_lamina_range", F.coalesce(F.sum("_lamina_n").over(before), F.lit(0)).alias("_lamina_shift"))
    if base is not None:
        shift = shift.join(base.select(*group, "last"), group, "left").withColumn("_lamina_shift", F.col("_lamina_shift") + F.coalesce("last", F.lit(0))).drop("last")
    inside = Window.partitionBy(*group, "_lamina_range").orderBy(*order)
    out = ranged.withColumn("_lamina_at", F.row_number().over(inside)).join(shift, [*group, "_lamina_range"])
    return out.withColumn(name, (F.col("_lamina_at") + F.col("_lamina_shift")).cast("int")).drop("_lamina_range", "_lamina_at", "_lamina_shift")
