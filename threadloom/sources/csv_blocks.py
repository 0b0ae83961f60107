"""CSV files of any size read in blocks, though quoted fields may hold line feeds.

Spark cuts text files at line feeds, wherever its blocks begin. Whether a line begins a record hangs on the quotes before
it, so each block tells how many quotes it has, and how many records would begin in it from either state; these small
figures are summed along the file, and each line then knows its record.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, line): lines as they lie in the files' blocks."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): each record's text, whole, numbered from 0 in its file; blank lines are no records."""
    lines = _lines(spark, path).withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    order = Window.partitionBy("file", "block").orderBy("nth")
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    inner = lines.withColumn("odd", before)
    # Lines that would begin a record if the block begins outside quotes, and if it begins inside.
    blocks = inner.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("turns"), F.count_if(F.col("odd") == 0).alias("outside"), F.count_if(F.col("odd") == 1).alias("inside"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stated = blocks.withColumn("state", F.coalesce(F.sum("turns").over(along), F.lit(0)) % 2)
    began = F.when(F.col("state") == 0, F.col("outside")).otherwise(F.col("inside"))
    carried = stated.withColumn("earlier", F.coalesce(F.sum(began).over(along), F.lit(0))).select("file", "block", "state", "earlier")
    begins = ((F.col("odd") + F.col("state")) % 2 == 0).cast("int")
    placed = inner.join(carried, ["file", "block"]).withColumn("record", F.col("earlier") + F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    whole = placed.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "nth", "line")))["line"].alias("lines"))  # a record's own lines
    text = F.regexp_replace(F.array_join("lines", "\n"), r"\r\z", "")
    return whole.select("file", "record", text.alias("text")).filter(F.trim("text") != "")


def read(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The rows of CSV files with a header line each, all columns as text; names are those of the first file's header.

    Quotes are doubled inside quoted fields. The same rows as Spark's reader with multiLine, which reads a file in one task.
    """
    found = records(spark, path)
    options = {"quote": '"', "escape": '"', "sep": sep}
    head = found.filter("record = 0").orderBy("file").select("text").first()
    if head is None:
        return spark.createDataFrame([], "value string")
    names = [n.strip().lstrip("\ufeff") or f"_c{i}" for i, n in enumerate(next(csv.reader(io.StringIO(head["text"]), delimiter=sep)))]
    schema = ", ".join(f"`_{i}` string" for i in range(len(names)))
    rows = found.filter("record > 0").select(F.from_csv("text", schema, options).alias("r")).select("r.*")
    return rows.toDF(*names)

