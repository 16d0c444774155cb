"""Neighbouring readings of long series without one task per series.

A window over a whole station would put a hot station into one task.  ``with_neighbours`` cuts each series into time
buckets, and gives every bucket the last and first k readings of the buckets around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_halo(df: DataFrame, keys: list[str], time: str, bucket: str, k: int) -> DataFrame:
    """``df`` (one row per key and time) plus copies of the k rows before and after each bucket; ``__halo`` marks copies.

    Only the first and last k rows of each bucket take part in the search over the whole key, by a window that keeps
    2k rows a bucket; a bucket with less than k rows is passed through, so that the k neighbours may lie further away.
    """
    inside = Window.partitionBy(*keys, bucket)
    edges = df.withColumns({"__a": F.row_number().over(inside.orderBy(time)), "__n": F.count("*").over(inside)})
    edges = edges.withColumn("__z", F.col("__n") + 1 - F.col("__a")).filter(f"__a <= {k} OR __z <= {k}")
    row = F.struct(*df.columns)
    line = Window.partitionBy(*keys).orderBy(time)
    edges = edges.select(*keys, bucket, "__a", "__z", F.when(F.col("__a") == 1, F.collect_list(row).over(line.rowsBetween(-k, -1))).alias("__p"), F.when(F.col("__z") == 1, F.collect_list(row).over(line.rowsBetween(1, k))).alias("__f"))
    both = edges.filter("__a = 1 OR __z = 1").select(F.col(bucket).alias("__to"), F.explode(F.concat(F.coalesce("__p", F.array()), F.coalesce("__f", F.array()))).alias("__r"))
    copies = both.select(*[F.col("__to" if c == bucket else f"__r.{c}").alias(c) for c in df.columns], F.lit(True).alias("__halo"))
    return df.withColumn("__halo", F.lit(False)).unionByName(copies)
