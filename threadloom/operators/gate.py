"""Which way power leans by era, how far labels can be trusted, and which thresholds fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.clock import DAY_MS, half_up
from threadloom.operators.findings import by_era
from threadloom.operators.ordered import rounded, top
from threadloom.sources.versions import Store

#: Kinds of pattern that count as coercive (fixed values).
COERCIVE = ("threat", "monitoring", "coercive_demand")
THRESHOLD, HALF_LIFE_DAYS = 0.66, 365


def coercive(patterns: str = "patterns") -> tuple[Column, Column]:
    """(me, them): coercive patterns of an array of (kind, side, repair_context); those in a context of repair don't count."""
    count = lambda mine: F.size(F.filter(F.coalesce(F.col(patterns), F.array().cast("array<struct<kind: string, side: string, repair_context: boolean>>")), lambda p: p["kind"].isin(*COERCIVE) & ~F.coalesce(p["repair_context"], F.lit(False)) & ((p["side"] == "me") if mine else (p["side"] != "me"))))
    return count(True), count(False)


def patterns_by_episode(results: DataFrame, episodes: DataFrame) -> DataFrame:
    """(thread_id, start_id, patterns): results (thread_id, member_ids, patterns) with the episode whose first hostile message they hold."""
    each = results.select("thread_id", F.explode("member_ids").alias("start_id"), "patterns")
    return each.join(episodes.select("thread_id", "start_id").distinct(), ["thread_id", "start_id"]).groupBy("thread_id", "start_id").agg(F.max("patterns").alias("patterns"))


def era_totals(episodes: DataFrame, eras: DataFrame, results: DataFrame) -> DataFrame:
    """Per thread and era: episodes, severe messages, episodes begun and coercive patterns by side; eras without episodes have zeros."""
    me, them = coercive()
    placed = by_era(episodes, eras).filter("era is not null").join(patterns_by_episode(results, episodes), ["thread_id", "start_id"], "left").withColumn("c_me", me).withColumn("c_them", them)
    sums = placed.groupBy("thread_id", "era").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("severe_me").alias("severe_me"), F.sum("severe_them").alias("severe_them"), F.count_if("begun_by_me").alias("begun_me"), F.count_if(~F.col("begun_by_me")).alias("begun_them"),
        F.sum("c_me").cast("long").alias("coercive_me"), F.sum("c_them").cast("long").alias("coercive_them"),
    )
    return eras.select("thread_id", "era", "start_ms", "end_ms").join(sums, ["thread_id", "era"], "left").na.fill(0)


def era_gate(totals: DataFrame, threshold: Column | float = THRESHOLD) -> DataFrame:
    """totals with the other side's shares (0.5 without data) and direction: them where all three reach the threshold, me where all are at most one less it."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    share = lambda name: F.coalesce(F.try_divide(name + "_them", F.col(name + "_them") + F.col(name + "_me")), F.lit(0.5))
    names = ("severe", "begun", "coercive")
    rows = totals.withColumns({f"share_{n}": share(n) for n in names})
    shares = [F.col(f"share_{n}") for n in names]
    return rows.withColumn("direction", F.when(F.least(*shares) >= limit, "them").when(F.greatest(*shares) <= 1 - limit, "me"))


def stance(gates: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """(thread_id, direction, confidence): eras that lean, weighed by severe messages halved each half-life before the thread's last era."""
    latest = gates.groupBy("thread_id").agg(F.max("end_ms").alias("latest"))
    weight = (F.col("severe_me") + F.col("severe_them")) * F.pow(F.lit(0.5), (F.col("latest") - F.col("end_ms")) / (DAY_MS * half_life_days))
    sums = gates.join(latest, "thread_id").groupBy("thread_id").agg(*[F.coalesce(F.sum(F.when(F.col("direction") == d, weight)), F.lit(0.0)).alias(d) for d in ("them", "me")])
    both = F.col("them") + F.col("me")
    return sums.select("thread_id", F.when(both > 0, F.when(F.col("them") >= F.col("me"), "them").otherwise("me")).alias("direction"), rounded(F.coalesce(F.try_divide(F.abs(F.col("them") - F.col("me")), both), F.lit(0.0))).alias("confidence"))


def framed(leaning: DataFrame, calibrated: bool, research: bool) -> DataFrame:
    """leaning with frame: a direction is taken as support only where the layer is on and the owner calibrated; else both readings stand."""
    return leaning.withColumn("frame", F.when(F.lit(calibrated and research) & F.col("direction").isNotNull(), "support").otherwise("two_readings"))


def sample_episodes(episodes: DataFrame, n: int = 10) -> DataFrame:
    """Each thread's n episodes of most severe messages; ties by peak, then the earlier."""
    return top(episodes.withColumn("severe", F.col("severe_me") + F.col("severe_them")), ["thread_id"], [F.desc("severe"), F.desc("peak"), F.asc("start_ms"), F.asc("start_id")], n)


def self_report_bias(labels: DataFrame, by: str = "owner", least: int = 8) -> DataFrame:
    """Per owner, from labels (owner, me, tension, hostile, severity; null hostile is skipped): how often the owner agrees with scores of 2 or more, by side.

    leniency is the other side's rate less the owner's; under `least` scored messages on a side the verdict is
    insufficient. bump raises the gate's threshold: by 0.3 of the leniency, 0.12 at most, and by 0.12 where nothing can be said.
    """
    high, me = F.col("tension") >= 2, F.col("me")
    mean = lambda c, side: F.coalesce(F.avg(F.when(high & side, c)), F.lit(0.0))
    hostile = F.col("hostile").cast("int")
    r = labels.filter("hostile is not null").groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(high & me).alias("own_high"), F.count_if(high & ~me).alias("other_high"), mean(hostile, me).alias("own"), mean(hostile, ~me).alias("other"),
        mean(F.col("severity"), me).alias("own_s"), mean(F.col("severity"), ~me).alias("other_s"),
    )
    lean = F.col("other") - F.col("own")
    verdict = F.when(F.least("own_high", "other_high") < least, "insufficient").when(lean > 0.15, "self_lenient").when(lean < -0.15, "self_critical").otherwise("balanced")
    bump = F.when(verdict == "self_lenient", F.least(F.lit(0.12), lean * 0.3)).when(verdict == "insufficient", 0.12).otherwise(0.0)
    return r.select(by, "n", "own_high", "other_high", half_up(F.col("own"), 2).alias("own_rate"), half_up(F.col("other"), 2).alias("other_rate"), half_up(lean, 2).alias("leniency"),
                    half_up(F.col("own_s"), 2).alias("own_severity"), half_up(F.col("other_s"), 2).alias("other_severity"), verdict.alias("verdict"), half_up(bump, 2).alias("bump"))


def derive_thresholds(labels: DataFrame, by: str = "owner") -> DataFrame:
    """(by, hostile, severe): the tension from which labels (by, tension, hostile, severity) are best met by F1; 2 and 3 where labels are too few or say nothing.

    At least 8 labels, 3 hostile ones, and two of the thresholds 1, 2, 3 that split the labels are needed; severe takes
    3 severe labels, and lies above hostile. Ties go to the smaller threshold.
    """
    rows, sharp = labels.filter("hostile is not null"), F.col("severity") >= 3
    at = {t: F.col("tension") >= t for t in (1, 2, 3)}
    f1 = lambda t, real: F.coalesce(F.try_divide(2.0 * F.count_if(at[t] & real), F.count_if(at[t]) + F.count_if(real)), F.lit(0.0))
    n = F.count(F.lit(1))
    r = rows.groupBy(by).agg(
        n.alias("n"), F.count_if("hostile").alias("h"), F.count_if(sharp).alias("s"), sum((F.count_if(at[t]) > 0).cast("int") * (F.count_if(at[t]) < n).cast("int") for t in at).alias("splits"),
        *[f1(t, F.col("hostile")).alias(f"h{t}") for t in at], *[f1(t, sharp).alias(f"s{t}") for t in (2, 3)],
    )
    best = F.greatest("h1", "h2", "h3")
    usable = (F.col("n") >= 8) & (F.col("h") >= 3) & (F.col("splits") >= 2) & (best > 0)
    hostile = F.when(F.col("h1") == best, 1).when(F.col("h2") == best, 2).otherwise(3)
    above = F.least(hostile + 1, F.lit(3))
    severe = F.when(F.col("s") >= 3, F.when(F.col("s2") >= F.col("s3"), 2).otherwise(3)).otherwise(above)
    return r.select(by, F.when(usable, hostile).otherwise(2).alias("hostile"), F.when(usable, F.when(severe <= hostile, above).otherwise(severe)).otherwise(3).alias("severe"))


def owner_gate(totals: DataFrame, owners: DataFrame, bias: DataFrame, base: float = THRESHOLD) -> DataFrame:
    """`era_gate` whose threshold is raised by what the owner's own answers say of their reports: owners are (thread_id, owner), bias `self_report_bias`' rows.

    Threads without an owner, and owners without answers, keep the base.
    """
    bumps = bias.select("owner", F.col("bump").alias("_bump"))
    rows = totals.join(owners.select("thread_id", "owner"), "thread_id", "left").join(bumps, "owner", "left").withColumn("threshold", base + F.coalesce("_bump", F.lit(0.0)))
    return era_gate(rows, F.col("threshold")).drop("_bump")


def disagreements(labels: DataFrame, hostile_from: int = 2) -> DataFrame:
    """Labels that contradict the score at a threshold."""
    return labels.filter(F.col("hostile") != (F.col("tension") >= hostile_from))


def review(marks: DataFrame, messages: DataFrame, scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(owner, thread_id, id, ms, me, tension, hostile, kind): marks of the owner that the scores contradict, and who is harder.

    marks are (owner, thread_id, id, hostile), a null hostile being skipped; messages that no score stands for count as
    0; thresholds are `derive_thresholds`' rows, 2 where an owner has none.
    """
    said = marks.filter("hostile is not null").join(messages.select("thread_id", "id", "ms", F.col("direction").isin("outgoing", "draft").alias("me")), ["thread_id", "id"])
    rows = said.join(scores.select("thread_id", "id", "tension"), ["thread_id", "id"], "left").join(thresholds.select("owner", F.col("hostile").alias("_from")), "owner", "left").withColumn("tension", F.coalesce("tension", F.lit(0.0)))
    hard = F.col("tension") >= F.coalesce("_from", F.lit(2))
    return rows.filter(F.col("hostile") != hard).select("owner", "thread_id", "id", "ms", "me", "tension", "hostile", F.when(hard, "model_harder").otherwise("owner_harder").alias("kind"))


def apply_calibration(store: Store, labels: DataFrame, rubric: int, seed: int | None = None) -> Store:
    """The store with the owners' bias and thresholds (tables bias and calibration) as their labels say, both in one version."""
    thresholds = derive_thresholds(labels).withColumn("rubric", F.lit(rubric)).withColumn("seed", F.lit(seed).cast("long"))
    return store.commit(replace={"bias": self_report_bias(labels), "calibration": thresholds})


def holdout(messages: DataFrame, n: int = 42, seed: int = 0) -> DataFrame:
    """At most n scored messages of each thread, spread evenly over side and tension band, chosen by a seeded hash; `place` interleaves the strata."""
    band = F.least(F.floor("tension"), F.lit(3)).cast("int")
    drawn = top(messages.withColumn("band", band), ["thread_id", "me", "band"], [F.xxhash64("thread_id", "id", F.lit(seed)).asc(), F.asc("id")], n, "nth")
    return top(drawn, ["thread_id"], [F.asc("nth"), F.desc("me"), F.desc("band")], n).drop("nth")
