"""Building blocks over time-ordered messages of all threads at once.

All of them use one order, (ms, id) within thread_id; scans along it are in `segments`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spoken(messages: DataFrame) -> DataFrame:
    """Messages that aren't reactions."""
    return messages.filter(~F.col("is_reaction"))


def substantive(messages: DataFrame) -> DataFrame:
    """Messages that aren't reactions and hold more than spaces; `me` marks the owner's, drafts included."""
    return spoken(messages).filter(F.trim(F.coalesce("body", F.lit(""))) != "").withColumn("me", F.col("direction").isin("outgoing", "draft"))


def runs_of_days(days: DataFrame) -> DataFrame:
    """(thread_id, first, last, length, silence): runs of successive days; silence is the days without any before the run."""
    w = Window.partitionBy("thread_id").orderBy("day")
    marked = days.withColumn("silence", F.col("day") - F.lag("day").over(w) - 1).withColumn("island", F.col("day") - F.row_number().over(w))
    return marked.groupBy("thread_id", "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("length"), F.max("silence").alias("silence")).drop("island")


def top(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c, places)
