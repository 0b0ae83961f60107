"""Scans over threads cut into ranges equal plain windows over whole threads."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import conflict, segments, windows
from threadloom.sources.tables import events_messages, orders_messages


def whole():
    """Windows over a whole thread: its order, up to each row, before it, after it."""
    order = Window.partitionBy("thread_id").orderBy("ms", "id")
    return order, order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)


@pytest.fixture(scope="module")
def rows(spark):
    """A hot thread with ties, others small, one without a name."""
    rng = random.Random(1)
    made = [(rng.choice([1] * 40 + [2, 3, None]), i, rng.randrange(-300, 3000) // rng.choice([1, 50]), rng.random() < 0.5, rng.choice([None, 0, 1, 2, 3])) for i in range(1500)]
    return spark.createDataFrame(made, "thread_id long, id long, ms long, me boolean, tension int").repartition(4).cache()


def same(a, b, columns):
    rows = lambda d: sorted(map(repr, (tuple(r) for r in d.select(*columns).collect())))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("most", [20, 300, 10**6])
def test_scan_equals_windows(rows, most):
    order, upto, past, coming = whole()
    s, hot = segments.segmented(rows, most), F.coalesce(F.col("tension") >= 2, F.lit(False))
    sizes = s.rows.groupBy("thread_id", segments.START).agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("a"), F.max("ms").alias("b")).filter("thread_id is not null")
    assert sizes.filter((F.col("n") > most) & (F.col("a") < F.col("b"))).count() == 0
    got = segments.scan(s, lag={"a": F.col("tension")}, last={"b": (hot, F.col("id"))}, coming={"c": (hot, F.struct("ms", "me"))}, total={"d": F.lit(1), "e": F.col("tension")})
    hit = lambda v, w, f: f(F.when(hot, v), ignorenulls=True).over(w)
    want = rows.withColumns({"a": F.lag("tension").over(order), "b": hit(F.col("id"), past, F.last), "c": hit(F.struct("ms", "me"), coming, F.first), "d": F.row_number().over(order), "e": F.sum("tension").over(upto)})
    same(got.plain(), want, ["thread_id", "id", "a", "b", "c", "d", "e"])
    groups = segments.with_turns(segments.gap_groups(s, 3)).plain()
    begins = F.coalesce(F.col("ms") - F.lag("ms").over(order) > 3, F.lit(True))
    turned = F.coalesce(F.lag("me").over(order) != F.col("me"), F.lit(True))
    want = rows.withColumn("begins", begins).withColumn("t", turned).withColumn("grp", F.sum(F.col("begins").cast("int")).over(upto)).withColumn("turn", F.sum(F.col("t").cast("int")).over(upto))
    same(groups, want, ["thread_id", "id", "begins", "grp", "turn"])
    assert {c for c in groups.columns} == {*rows.columns, "begins", "grp", "turn"}


def test_one_thread_runs_in_many_tasks(spark, rows):
    one = segments.scan(segments.segmented(rows.filter("thread_id = 1"), 100), total={"rn": F.lit(1)}).rows
    tasks = [r["count"] for r in one.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < one.count()


@pytest.mark.parametrize("messages", [events_messages, orders_messages])
def test_operators_over_ranges_equal_those_over_threads(spark, monkeypatch, messages):
    m = messages(spark, "/root/testdata/sf0.001").cache()

    def results():
        marked = conflict.marked_once(m)
        found = conflict.episodes(marked, 5 * 86_400_000, 2)
        return [sorted(map(repr, df.collect())) for df in (found, conflict.reciprocation(marked, conflict.month(), "month"), conflict.turns(m), conflict.coverage(m), windows.tile(m, 6, 200, chunk=7))]

    plain = results()
    monkeypatch.setattr(segments, "MOST", 15)
    monkeypatch.setattr(segments, "FEW_BYTES", -1)
    assert results() == plain


def test_few_rows(spark):
    none = spark.createDataFrame([], "thread_id long, id long, ms long, me boolean")
    assert segments.with_turns(segments.segmented(none, 1)).plain().count() == 0
    ties = spark.createDataFrame([(1, i, 5, True) for i in range(9)], "thread_id long, id long, ms long, me boolean")
    assert sorted(r["n"] for r in segments.scan(segments.segmented(ties, 2), total={"n": F.lit(1)}).rows.collect()) == list(range(1, 10))
