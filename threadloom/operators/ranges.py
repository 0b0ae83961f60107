"""Joins of points in time with spans, by buckets: an equi-join on thread and bucket, whatever a thread's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(spans: DataFrame, points: DataFrame, start: str, stop: str, at: str, bucket_ms: int, by: str = "thread_id", how: str = "inner") -> DataFrame:
    """Rows of spans with each point of the same thread for which start <= at <= stop (bounds in milliseconds).

    Spans are copied to each bucket of bucket_ms that they touch, points lie in one. Rows without thread or bounds meet
    nothing. Columns of points other than `by` must not be named like those of spans. With how = "left", spans without
    points stay once, with nulls.
    """
    reach = F.sequence(F.floor(F.col(start) / bucket_ms), F.floor(F.col(stop) / bucket_ms))
    copied = spans.filter(F.col(start) <= F.col(stop)).withColumn("_bucket", F.explode(reach))
    placed = points.withColumn("_bucket", F.floor(F.col(at) / bucket_ms))
    found = copied.join(placed, [by, "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop))).drop("_bucket")
    if how == "inner":
        return found
    keys = spans.columns
    met = found.select(*keys).distinct().alias("met")
    alone = spans.alias("all").join(met, [F.col(f"all.{k}").eqNullSafe(F.col(f"met.{k}")) for k in keys], "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)
