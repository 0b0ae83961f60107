"""Ordered scans that split a thread of any size over tasks.

A thread with very many messages is cut into ranges of time. Windows run within a range; each range gives a small
summary (its last value, its first hit, its count), summaries are scanned along the thread, and what they carry into
each range is added to the range's own windows. Threads of common size are one range and cost nothing more.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.work import kept

#: Messages of a thread that one task may order.
MOST = 1_000_000
#: Bytes of all inputs under which no thread is counted: none can have MOST messages there.
FEW_BYTES = 16_000_000
#: Ranges of hot threads whose summaries may be broadcast (some 100 bytes each).
BROADCAST = 200_000
START = "_start"


class Segmented(NamedTuple):
    """rows with `_start`, the range each lies in (ranges of a thread ascend by it); hot: (thread_id) of the threads with several ranges, None where none has."""

    rows: DataFrame
    hot: DataFrame | None

    def filter(self, condition: Column | str) -> Segmented:
        return Segmented(self.rows.filter(condition), self.hot)

    def with_column(self, name: str, c: Column) -> Segmented:
        return Segmented(self.rows.withColumn(name, c), self.hot)

    def plain(self) -> DataFrame:
        return self.rows.drop(START)


def input_bytes(df: DataFrame) -> int:
    """Bytes that df's sources hold by Spark's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df  # counted


def segmented(messages: DataFrame, most: int | None = None) -> Segmented:
    """messages (thread_id, ms, id) in ranges of at most about `most` rows of one thread; rows of one millisecond stay together.

    Threads with more are cut evenly in time, and again where a part still holds more. Only they are looked at again.
    """
    limit = MOST if most is None else most
    rows = messages.withColumn(START, F.lit(0).cast("long"))
    if most is None and input_bytes(messages) <= FEW_BYTES:
        return Segmented(rows, None)
    hot = None
    while True:
        n = F.count(F.lit(1))
        counted = rows.groupBy("thread_id", START).agg(n.alias("_n"), F.min("ms").alias("_first"), F.max("ms").alias("_last")).filter((F.col("_n") > limit) & (F.col("_last") > F.col("_first")) & F.col("thread_id").isNotNull())
        width = F.greatest(F.lit(1), F.floor((F.col("_last") - F.col("_first")) / F.ceil(F.col("_n") / limit)))
        heavy = kept(counted.select("thread_id", START, "_first", width.alias("_width")))
        if heavy.isEmpty():
            return Segmented(rows, hot)
        hot = heavy.select("thread_id").distinct() if hot is None else hot
        inner = F.col("_first") + F.floor((F.col("ms") - F.col("_first")) / F.col("_width")) * F.col("_width")
        joined = rows.join(_small(heavy), ["thread_id", START], "left")
        rows = joined.withColumn(START, F.coalesce(inner, F.col(START))).select(*rows.columns)


def scan(s: Segmented, lag: dict[str, Column] | None = None, last: dict[str, tuple[Column, Column]] | None = None, coming: dict[str, tuple[Column, Column]] | None = None, total: dict[str, Column] | None = None) -> Segmented:
    """s with columns over each whole thread in the order (ms, id).

    lag: a value of the message before. last: (condition, value), the value of the last message before that meets the
    condition. coming: the same of the next message. total: a running sum up to each message, itself included. Hits
    whose value is null don't count. Rows without thread are a thread, in one range.
    """
    lag, last, coming, total = lag or {}, last or {}, coming or {}, total or {}
    within = Window.partitionBy("thread_id", START)
    up, down = within.orderBy("ms", "id"), within.orderBy(F.desc("ms"), F.desc("id"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    hit = lambda pair: F.when(pair[0], pair[1])
    rows = s.rows.withColumns({
        **({"_head": F.lag(F.lit(True)).over(up).isNull()} if lag and s.hot is not None else {}),
        **{k: F.lag(v).over(up) for k, v in lag.items()},
        **{k: F.last(hit(v), ignorenulls=True).over(past(up)) for k, v in last.items()},
        **{k: F.last(hit(v), ignorenulls=True).over(past(down)) for k, v in coming.items()},
        **{k: F.sum(v).over(up.rowsBetween(Window.unboundedPreceding, 0)) for k, v in total.items()},
    })
    if s.hot is None:
        return Segmented(rows, None)
    at = F.struct("ms", "id")
    found = s.rows.join(_small(s.hot), "thread_id", "left_semi").groupBy("thread_id", START).agg(
        *[F.max_by(v, at).alias(f"_lag_{k}") for k, v in lag.items()],
        *[F.max_by(hit(v), F.when(hit(v).isNotNull(), at)).alias(f"_last_{k}") for k, v in last.items()],
        *[F.min_by(hit(v), F.when(hit(v).isNotNull(), at)).alias(f"_next_{k}") for k, v in coming.items()],
        *[F.sum(v).alias(f"_sum_{k}") for k, v in total.items()],
        F.count(F.lit(1)).alias("_n"),
    )
    # A hot thread has a summary for each of its ranges, and no more.
    ranges = Window.partitionBy("thread_id")
    along, back = ranges.orderBy(START), ranges.orderBy(F.desc(START))
    carried = found.select(
        "thread_id", START,
        *[F.lag(f"_lag_{k}").over(along).alias(f"_lag_{k}") for k in lag],
        *[F.last(f"_last_{k}", ignorenulls=True).over(past(along)).alias(f"_last_{k}") for k in last],
        *[F.last(f"_next_{k}", ignorenulls=True).over(past(back)).alias(f"_next_{k}") for k in coming],
        *[F.sum(f"_sum_{k}").over(past(along)).alias(f"_sum_{k}") for k in total],
    )
    both = rows.join(_small(carried), ["thread_id", START], "left").withColumns({
        **{k: F.when(F.col("_head"), F.col(f"_lag_{k}")).otherwise(F.col(k)) for k in lag},
        **{k: F.coalesce(F.col(k), F.col(f"_last_{k}")) for k in last},
        **{k: F.coalesce(F.col(k), F.col(f"_next_{k}")) for k in coming},
        **{k: F.coalesce(F.col(k) + F.col(f"_sum_{k}"), F.col(k), F.col(f"_sum_{k}")) for k in total},
    })
    return Segmented(both.select(*[c for c in rows.columns if c != "_head"]), s.hot)


def gap_groups(s: Segmented, gap_ms: int, name: str = "grp") -> Segmented:
    """Number groups of messages: one begins (`begins`) where more than gap_ms lie from a message back to the one before."""
    before = scan(s, lag={"_was": F.col("ms")}).with_column("begins", F.coalesce(F.col("ms") - F.col("_was") > gap_ms, F.lit(True)))
    out = scan(before, total={name: F.col("begins").cast("int")})
    return Segmented(out.rows.drop("_was"), out.hot)


def with_turns(s: Segmented) -> Segmented:
    """s with turn: a number for each run of one side's messages (`me` where there is that column, else direction)."""
    side = F.col("me") if "me" in s.rows.columns else F.col("direction")
    changed = scan(s, lag={"_was": side}).with_column("_c", F.coalesce(F.col("_was") != side, F.lit(True)).cast("int"))
    out = scan(changed, total={"turn": F.col("_c")})
    return Segmented(out.rows.drop("_was", "_c"), out.hot)
