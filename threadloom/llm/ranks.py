"""Places of rows in one order of a whole table, found without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import BROADCAST_ROWS, unused, work_table


def placed(rows: DataFrame, group: list[str], order: list[Column], position: str, name: str) -> DataFrame:
    """rows with `position`, their place from 0 within `group` (nulls are a group) by `order`; equal rows keep the order in which they lie.

    Rows are sorted by range and written once. A row's place is its number within its part, plus the rows of its group
    in the parts before: one figure a part and group. `rows` should be a written table, as sorting samples it first. A
    last key of its own for each row lets a range end amid equal rows.
    """
    tie, place = unused(rows, "tie"), unused(rows, "place")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(g) for g in group], *order, F.col(tie)]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    lying = work_table(ranged.drop(tie).withColumn(place, F.monotonically_increasing_id()), name)
    # The number is the part's, shifted, and the row's within it.
    part = F.shiftright(place, 33)
    held = lying.groupBy(*group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = held.select(*[F.col(g).alias(f"_own_{g}") for g in group], "_part", (before - F.col("_first")).alias("_shift"))
    n = shift.limit(BROADCAST_ROWS + 1).count()
    same = part == F.col("_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_own_{g}"))
    found = lying.join(F.broadcast(shift) if n <= BROADCAST_ROWS else shift, same)  # a figure a part and group, counted
    return found.select(*rows.columns, (F.col(place) + F.col("_shift")).alias(position))
