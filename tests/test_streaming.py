"""Streams that stop and go on give what a batch gives."""

import shutil

from pyspark.sql import functions as F

from threadloom.operators import conflict
from threadloom.sources.versions import Store
from threadloom.streaming import messages as stream

H, DAY = 3_600_000, 86_400_000
SHAPE = "thread_id long, id long, ms long, direction string, is_reaction boolean, tension double"


def writer(spark, folder):
    def write(name, rows):
        spark.createDataFrame(rows, SHAPE).withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.parquet(str(folder / name))

    return write


def test_episodes_over_restarts_equal_the_batch(spark, tmp_path):
    write, out, check = writer(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    at = lambda t, i, ms, tension=3.0: (t, i, 200 * DAY + ms, "incoming", False, tension)
    parts = [[at(1, i, i * 60_000) for i in range(3)] + [at(2, 50, 0)], [at(1, i, i * 60_000) for i in range(3, 6)] + [at(2, 51, H)], [at(1, 20, 9 * H), at(1, 21, 9 * H + 1)], [at(3, 90, 60 * H, 0.0), at(3, 91, 60 * H, 2.0)], [at(3, 92, 90 * H, 2.0)]]
    for n, rows in enumerate(parts):
        write(f"p{n}", rows)
        source = stream.files(spark, str(tmp_path / "in" / "*"), spark.read.parquet(str(tmp_path / "in" / "p0")).schema)
        stream.drain(stream.episodes(source, 6 * H, 2), out, check)  # stops in the middle of an episode and goes on
    made = spark.read.parquet(out)
    every = spark.read.parquet(str(tmp_path / "in" / "*")).withColumn("body", F.lit("x")).withColumn("warmth", F.lit(0))
    want = conflict.episodes(every, 6 * H, 2).filter(F.col("end_ms") < 200 * DAY + 60 * H)
    same = lambda df: sorted((r.thread_id, r.start_ms, r.end_ms, r.hostile) for r in df.collect())
    assert same(made) == same(want) == [(1, 200 * DAY, 200 * DAY + 5 * 60_000, 6), (1, 200 * DAY + 9 * H, 200 * DAY + 9 * H + 1, 2), (2, 200 * DAY, 200 * DAY + H, 2)]


def test_totals_are_merged_once(spark, tmp_path):
    write, path, check = writer(spark, tmp_path / "in"), "file://" + str(tmp_path / "totals"), tmp_path / "check"
    at = lambda i, ms, side="outgoing": (1, i, 300 * DAY + ms, side, False, 0.0)
    source = lambda: stream.files(spark, str(tmp_path / "in" / "*"), spark.read.parquet(str(tmp_path / "in" / "a")).schema)
    write("a", [at(1, 0), at(2, H, "incoming"), at(3, 3 * DAY)])
    stream.merge_daily(source(), path, str(check))
    shutil.copytree(check, tmp_path / "older")
    write("b", [at(4, 2 * H), at(5, 3 * DAY + 1)])
    stream.merge_daily(source(), path, str(check))
    totals = lambda: sorted(tuple(r) for r in Store(spark, path).read("totals").collect())
    want = [(1, 300, 2, 1), (1, 303, 2, 0)]
    assert totals() == want and [(r.id, r.batch) for r in Store(spark, path).read("late").collect()] == [(4, 1)]
    # Killed after the commit and before the stream's own note of it: the batch comes again and changes nothing.
    stream.merge_daily(source(), path, str(tmp_path / "older"))
    assert totals() == want and Store(spark, path).version == 2
