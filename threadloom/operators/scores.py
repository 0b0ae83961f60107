"""Scores that an external reader gave messages, window by window.

Results have thread_id, window, status (done, refused, error) and messages (array of message_id "m<id>", valence,
warmth, tension). A message may lie in several windows; its score is the mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.clock import Zone, half_up, local_day
from threadloom.operators.ordered import rounded, substantive

RESULTS = "thread_id long, window long, status string, messages array<struct<message_id: string, valence: double, warmth: double, tension: double>>"
#: Share of a thread's messages that must be scored before its scores stand for it.
FLOOR = 0.95


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files, one JSON object each; a file that isn't one has nulls and its text in _corrupt_record."""
    return spark.read.json(path, schema=RESULTS + ", _corrupt_record string", multiLine=True)


def message_scores(results: DataFrame) -> DataFrame:
    """(thread_id, id, valence, warmth, tension): means over all windows; ids that aren't "m" and a number are left out."""
    each = results.filter("status = 'done'").select("thread_id", F.inline("messages"))
    each = each.withColumn("id", F.regexp_extract("message_id", r"^m(\d+)$", 1).try_cast("long")).filter("id is not null")
    return each.groupBy("thread_id", "id").agg(*[F.avg(c).alias(c) for c in ("valence", "warmth", "tension")])


def with_scores(messages: DataFrame, scores: DataFrame) -> DataFrame:
    """messages with their scores; unscored ones have 0 for warmth and tension and null for valence, and scored = false."""
    plain = messages.drop("warmth", "tension", "valence")
    found = plain.join(scores.withColumn("_hit", F.lit(True)), ["thread_id", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return found.select(*plain.columns, "valence", zero("warmth"), zero("tension"), F.coalesce("_hit", F.lit(False)).alias("scored"))


def emotion_daily(messages: DataFrame, scores: DataFrame, zone: Zone = 0) -> DataFrame:
    """Per thread and local day with scored messages: counts and mean scores, overall and by side (0 where a side has none)."""
    mine = F.col("direction").isin("outgoing", "draft")
    rows = messages.select("thread_id", "id", "ms", "direction").join(scores, ["thread_id", "id"]).withColumn("day", local_day(zone))
    means = [rounded(F.avg(c)).alias(c) for c in ("warmth", "tension", "valence")]
    scaled = [rounded(F.avg(c) / 3).alias(f"{c}01") for c in ("warmth", "tension")]
    sides = [a for side, s in (("me", mine), ("them", ~mine)) for a in (F.count_if(s).alias(f"n_{side}"), *[F.coalesce(rounded(F.avg(F.when(s, F.col(c)))), F.lit(0.0)).alias(f"{c}_{side}") for c in ("warmth", "tension", "valence")])]
    return rows.groupBy("thread_id", "day").agg(F.count(F.lit(1)).alias("n"), *means, *scaled, *sides)


def emotion_coverage(messages: DataFrame, results: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(thread_id, eligible, scored, coverage, percent, refused, errored, complete): complete goes by the exact ratio, never by percent."""
    eligible = substantive(messages).groupBy("thread_id").agg(F.count(F.lit(1)).alias("eligible"))
    scored = message_scores(results).groupBy("thread_id").agg(F.count(F.lit(1)).alias("scored"))
    windows = results.groupBy("thread_id").agg(F.count_if(F.col("status") == "refused").alias("refused"), F.count_if(F.col("status") == "error").alias("errored"))
    rows = messages.select("thread_id").distinct().join(eligible, "thread_id", "left").join(scored, "thread_id", "left").join(windows, "thread_id", "left")
    rows = rows.na.fill(0, ["eligible", "scored", "refused", "errored"])
    exact = F.coalesce(F.try_divide("scored", "eligible"), F.lit(0.0))
    return rows.select("thread_id", "eligible", "scored", rounded(exact).alias("coverage"), half_up(exact * 100).cast("int").alias("percent"), "refused", "errored", (exact >= floor).alias("complete"))


def daily_with_emotion(daily: DataFrame, emotion: DataFrame) -> DataFrame:
    """A daily series whose warmth, tension and sentiment (where it has one) are the scored ones on days that have them."""
    scored = {"warmth": "warmth01", "tension": "tension01", "sentiment": "valence"}
    own = emotion.select("thread_id", "day", *[F.col(v).alias(f"_{c}") for c, v in scored.items()])
    joined = daily.join(own, ["thread_id", "day"], "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in scored else F.col(c) for c in daily.columns])


def river_layer(coverage: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(thread_id, layer, state): the model layer where it is wanted and complete, else the lexicon; state says how far a thread is read."""
    wanted = F.lit(True) if wanted is None else wanted
    state = F.when(F.col("scored") == 0, "unread").when(F.col("complete"), "read").otherwise("partial")
    return coverage.select("thread_id", F.when(wanted & F.col("complete"), "model").otherwise("lexicon").alias("layer"), state.alias("state"))
