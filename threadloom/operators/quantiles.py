"""Exact percentiles of groups of any size.

A group of common size is handed to Spark's own aggregate, which holds its values. Of a larger one the wanted ranks are
narrowed: a pass counts its values in bins and keeps the bin that holds the rank, until few are left, and only these are
put in order. Passes count in every task first, so a group's size is no one task's load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.segments import FEW_BYTES, input_bytes
from threadloom.sources.work import kept

#: Values of a group that one task may hold.
MOST = 1_000_000
BINS = 1_000
#: Ranks that may be broadcast: two for each percentile of each large group.
RANKS = 200_000


def percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], most: int | None = None) -> DataFrame:
    """(by, a column for each wanted percentile): interpolated as Spark's percentile is; null values don't count, and null groups are groups. Values are finite."""
    limit = MOST if most is None else most
    if most is None and input_bytes(rows) <= FEW_BYTES:
        return rows.groupBy(*by).agg(*[F.percentile(value, p).alias(name) for name, p in wanted.items()])
    own = rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    every = rows.select(*by).distinct()
    sizes = kept(own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).filter(F.col("_n") > limit))
    plain = [F.percentile("_v", p).alias(name) for name, p in wanted.items()]
    if sizes.isEmpty():
        found = own.groupBy(*by).agg(*plain)
        return every.alias("e").join(found.alias("f"), same("e", "f"), "left").select("e.*", *[f"f.{n}" for n in wanted])
    small = own.alias("o").join(_few(sizes).alias("s"), same("o", "s"), "left_anti").groupBy(*by).agg(*plain)
    large = _narrowed(own.alias("o").join(_few(sizes).alias("s"), same("o", "s"), "left_semi"), sizes, by, wanted, limit)
    found = small.unionByName(large)
    return every.alias("e").join(found.alias("f"), same("e", "f"), "left").select("e.*", *[f"f.{n}" for n in wanted])


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(RANKS + 1).count() <= RANKS else df  # counted


def _narrowed(rows: DataFrame, sizes: DataFrame, by: list[str], wanted: dict[str, float], limit: int) -> DataFrame:
    """(by, wanted percentiles) of large groups. A rank is (p, side): the value at or next after p * (n - 1)."""
    at = lambda p: p * (F.col("_n") - 1)
    ranks = [F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), F.least(F.floor(at(p)) + up, F.col("_n") - 1).cast("long").alias("rank"), (at(p) - F.floor(at(p))).alias("part")) for i, p in enumerate(wanted.values()) for up in (0, 1)]
    # Each open rank knows the span of values it lies in, how many values of the group that span holds, and its place among them.
    open_ = kept(sizes.select(*by, F.inline(F.array(*ranks)), F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_n").alias("held")))
    done = None
    while True:
        ready = (F.col("low") == F.col("high")) | (F.col("held") <= limit)
        ended = open_.filter(ready)
        done = ended if done is None else done.unionByName(ended)
        open_ = open_.filter(~ready)
        if open_.isEmpty():
            break
        met = _met(rows, open_, by)
        place = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS))
        # Bins follow the values' order, so a bin's least and largest value span just its own.
        bins = met.groupBy(*by, "q", "up", "rank", "part", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "q", "up").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = bins.withColumn("before", before).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        open_ = kept(hit.select(*by, "q", "up", (F.col("rank") - F.col("before")).alias("rank"), "part", F.col("_a").alias("low"), F.col("_b").alias("high"), F.col("n").alias("held")))
    done = kept(done)
    even = done.filter("low = high").select(*by, "q", "up", "part", F.col("low").alias("value"))
    left = _met(rows, done.filter("low <> high"), by).groupBy(*by, "q", "up", "rank", "part").agg(F.array_sort(F.collect_list("_v")).alias("vs"))  # at most `limit` values each
    values = even.unionByName(left.select(*by, "q", "up", "part", F.get("vs", F.col("rank")).alias("value")))
    side = lambda i, up: F.max(F.when((F.col("q") == i) & (F.col("up") == up), F.col("value")))
    part = lambda i: F.max(F.when(F.col("q") == i, F.col("part")))
    return values.groupBy(*by).agg(*[(side(i, 0) * (1 - part(i)) + side(i, 1) * part(i)).alias(name) for i, name in enumerate(wanted)])


def _met(rows: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """Values of each rank's group that lie in its span."""
    r = _few(ranks).select(*[F.col(c).alias(f"_of_{c}") for c in by], "q", "up", "rank", "part", "low", "high")
    same = (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(r, same).drop(*[f"_of_{c}" for c in by])
