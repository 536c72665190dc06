"""Running totals that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds, as ``name``, the sum of ``value`` over the rows before each row of its key.

    ``bucket`` is a number that rises with ``order``: totals are taken over buckets first, so that a
    task sorts one bucket of a key, never a whole key. Null values count 0. An empty table stays empty.
    The window over bucket totals has one row for each bucket.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_value", F.coalesce(value, F.lit(0)))
    per_key, within = Window.partitionBy(*keys).orderBy("_bucket"), Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = Window.unboundedPreceding, -1
    base = (
        df.groupBy(*keys, "_bucket")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(per_key.rowsBetween(*before)), F.lit(0)))
        .drop("_sum")
    )
    return (
        df.join(base, [*keys, "_bucket"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum("_value").over(within.rowsBetween(*before)), F.lit(0)))
        .drop("_bucket", "_value", "_base")
    )
