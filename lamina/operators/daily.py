"""L2: one summary per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import lines


def latest(writes: DataFrame, arrival: str) -> DataFrame:
    """Rows of `daily` from writes (date, summary_md): the last writer of a date wins."""
    last = Window.partitionBy("date").orderBy(F.desc(arrival))
    return writes.withColumn("_at", F.row_number().over(last)).where("_at = 1").select("date", "summary_md")


def topics(summary: Column) -> Column:
    """Backticked topics of the summary's topic line; empty without one."""
    return lines.quoted(lines.field(lines.of(summary), fixed.DAY_TOPICS))
