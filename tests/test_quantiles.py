"""Percentiles of large groups equal Spark's own; metrics are made anew only where messages changed."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import metrics, quantiles, segments
from threadloom.sources.tables import events_messages
from threadloom.sources.versions import Store


@pytest.mark.parametrize("most", [5, 100, 10**6])
def test_percentiles_equal_sparks(spark, most):
    rng = random.Random(2)
    made = [(rng.choice(["h"] * 20 + ["a", None, "t"]), rng.choice([None, 1, 2]), rng.choice([None, rng.gauss(0, 10), rng.gauss(1e6, 1), 3.0, 3.0, -7.5])) for _ in range(1500)] + [("t", 9, 5.0)] * 400 + [("e", 9, None)]
    df, wanted = spark.createDataFrame(made, "g string, k int, v double").repartition(4), {"m": 0.5, "p": 0.9, "z": 0.0, "o": 1.0}
    rows = lambda d: sorted(map(repr, (tuple(r) for r in d.select("g", "k", *[F.round(n, 6).alias(n) for n in wanted]).collect())))
    assert rows(quantiles.percentiles(df, ["g", "k"], "v", wanted, most)) == rows(df.groupBy("g", "k").agg(*[F.percentile("v", p).alias(n) for n, p in wanted.items()]))


def test_metrics_of_hot_threads_are_the_same(spark, monkeypatch):
    m = events_messages(spark, "/root/testdata/sf0.001").cache()
    both = lambda: [sorted(map(repr, f(m).collect())) for f in (metrics.summary, metrics.replies_by_side)]
    whole = both()
    monkeypatch.setattr(segments, "MOST", 20)
    monkeypatch.setattr(segments, "FEW_BYTES", -1)
    monkeypatch.setattr(quantiles, "FEW_BYTES", -1)
    monkeypatch.setattr(quantiles, "MOST", 4)
    assert both() == whole


def test_only_changed_threads_are_made_anew(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "thread_id long, id long, body string").repartition(2)
    asked = []

    def make(some):
        asked.append(sorted(r.thread_id for r in some.select("thread_id").distinct().collect()))
        return some.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))

    store, states = metrics.refreshed(Store(spark, "file://" + str(tmp_path)), "m", rows((1, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, None)), make)
    assert {r.thread_id: r.status for r in states.collect()} == {1: "new", 2: "new", 3: "new"}
    store, states = metrics.refreshed(store, "m", rows((1, 2, "b"), (1, 1, "a"), (2, 3, "d"), (4, 5, "e")), make)  # the first in another order
    assert {r.thread_id: r.status for r in states.collect()} == {1: "kept", 2: "changed", 3: "removed", 4: "new"}
    assert asked == [[1, 2, 3], [2, 4]] and store.version == 2
    assert sorted(tuple(r) for r in store.read("m").collect()) == [(1, 2), (2, 1), (4, 1)]
    again, states = metrics.refreshed(store, "m", rows((1, 1, "a"), (1, 2, "b"), (2, 3, "d"), (4, 5, "e")), make)
    assert again.version == 2 and len(asked) == 2 and {r.status for r in states.collect()} == {"kept"}
