"""Episodes of hostile messages, and what monthly, quarterly and yearly series say of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.ordered import rounded, substantive
from threadloom.operators.segments import Segmented, gap_groups, scan, segmented, with_turns
from threadloom.sources.tables import HOUR_MS, date_of, day_of
from threadloom.sources.work import kept


def hostile() -> Column:
    return F.col("tension") >= 2


def severe() -> Column:
    return F.col("tension") >= 3


def warm() -> Column:
    return F.col("warmth") >= 2


def marked(messages: DataFrame | Segmented) -> Segmented:
    """Substantive messages with rn (their number in the thread), warm (ms, me of the next warm message) and nxt (ms, tension of the owner's next).

    Episodes and answers both come from this one pass; given to both, written once, it serves them all.
    """
    if isinstance(messages, Segmented):
        return messages
    narrow = substantive(messages).select("thread_id", "id", "ms", "me", "tension", "warmth")
    return scan(segmented(narrow), total={"rn": F.lit(1)}, coming={"warm": (warm(), F.struct("ms", "me")), "nxt": (F.col("me"), F.struct("ms", "tension"))})


def marked_once(messages: DataFrame) -> Segmented:
    """`marked`, written to the shared folder, for queries that read it more than once."""
    found = marked(messages)
    return Segmented(kept(found.rows), found.hot)


def episodes(messages: DataFrame | Segmented, gap_ms: int = 6 * HOUR_MS, least: int = 5, repair_ms: int = 24 * HOUR_MS) -> DataFrame:
    """A row per cluster of at least `least` hostile messages at most gap_ms apart: who began and ended it, peaks, counts by side, and the repair.

    msg_count counts all substantive messages from the first to the last. A repair is the first warm message after the
    last hostile one within repair_ms. messages may be `marked` ones.
    """
    rows = gap_groups(marked(messages).filter(hostile()), gap_ms, "episode").plain()
    me = F.col("me")
    out = rows.groupBy("thread_id", "episode").agg(
        F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.min_by("id", "rn").alias("start_id"), F.count(F.lit(1)).alias("hostile"),
        F.count_if(me).alias("hostile_me"), F.count_if(~me).alias("hostile_them"), F.count_if(severe() & me).alias("severe_me"), F.count_if(severe() & ~me).alias("severe_them"),
        F.max("tension").alias("peak"), F.min_by("me", "rn").alias("begun_by_me"), F.max_by("me", "rn").alias("ended_by_me"),
        (F.max("rn") - F.min("rn") + 1).cast("int").alias("msg_count"), F.max_by("warm", "rn").alias("warm"),
    ).filter(F.col("hostile") >= least)
    repaired = F.coalesce(F.col("warm.ms") - F.col("end_ms") <= repair_ms, F.lit(False))
    return out.withColumn("repaired", repaired).withColumn("repair_ms", F.when(repaired, F.col("warm.ms"))).withColumn("repaired_by_me", F.when(repaired, F.col("warm.me"))).drop("warm", "episode")


def answers(messages: DataFrame | Segmented, within_ms: int = 2 * HOUR_MS) -> DataFrame:
    """Substantive messages with `answer`: the tension of the owner's next message if within within_ms, else null. messages may be `marked` ones."""
    return marked(messages).plain().withColumn("answer", F.when(F.col("nxt.ms") - F.col("ms") <= within_ms, F.col("nxt.tension"))).drop("nxt")


def reciprocation(messages: DataFrame | Segmented, period: Column, name: str, within_ms: int = 2 * HOUR_MS) -> DataFrame:
    """Per thread and period: volumes, hostile, severe and warm counts by side, and how the owner met the other side's hostility."""
    me, theirs = F.col("me"), hostile() & ~F.col("me")
    counts = [F.count_if(c & s).alias(f"{n}_{side}") for n, c in (("n", F.lit(True)), ("hostile", hostile()), ("severe", severe()), ("warm", warm())) for side, s in (("me", me), ("them", ~me))]
    hot = F.coalesce(F.col("answer") >= 2, F.lit(False))
    soft = F.coalesce(F.col("answer") < 2, F.lit(False))
    return answers(messages, within_ms).groupBy("thread_id", period.alias(name)).agg(
        *counts, F.count_if(theirs).alias("asked"), F.count_if(theirs & hot).alias("returned"), F.count_if(theirs & soft).alias("softened"), F.count_if(theirs & F.col("answer").isNull()).alias("withdrew"),
    )


def month() -> Column:
    return F.date_format(date_of(), "yyyy-MM")


def quarter() -> Column:
    return F.concat(F.year(date_of()).cast("string"), F.lit("-Q"), F.quarter(date_of()).cast("string"))


def growth(messages: DataFrame | Segmented, within_ms: int = 2 * HOUR_MS) -> DataFrame:
    """Per thread and quarter with messages: the owner's volume, hostile and severe shares, and rates (of all hostility met) of returning it and of withdrawing."""
    share = lambda a, b: rounded(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    rows = reciprocation(messages, quarter(), "quarter", within_ms)
    return rows.select("thread_id", "quarter", "n_me", "hostile_me", "severe_me", share("hostile_me", "n_me").alias("hostile_share"), share("severe_me", "n_me").alias("severe_share"),
                       "asked", "returned", "softened", "withdrew", share("returned", "asked").alias("returned_rate"), share("withdrew", "asked").alias("withdrew_rate"))


def deluge_days(messages: DataFrame, least: int = 20) -> DataFrame:
    """(thread_id, day, hostile): days on which the other side sent at least `least` hostile messages."""
    return substantive(messages).filter(hostile() & ~F.col("me")).groupBy("thread_id", day_of().alias("day")).agg(F.count(F.lit(1)).alias("hostile")).filter(F.col("hostile") >= least)


FEATURES = ("n_total", "share_them", "hostile_share_me", "hostile_share_them", "returned_rate", "begun_share_them", "repair_hours")


def monthly_series(messages: DataFrame | Segmented, found: DataFrame, within_ms: int = 2 * HOUR_MS) -> DataFrame:
    """Per thread and month with messages: volume, the other side's share, hostile shares, the rate of answered hostility that the owner returned
    (0 without any), the other side's share of episodes begun and the median hours to repair, and each one's z-score in the thread.

    found are the thread's `episodes`, best of the same `marked_once` messages. The last two are carried over months without episodes, from the mean of the known
    months at the start, and are 0 in threads without any.
    """
    answered = F.col("returned") + F.col("softened")
    by = F.date_format(date_of("start_ms"), "yyyy-MM").alias("month")
    known = found.groupBy("thread_id", by).agg(F.avg((~F.col("begun_by_me")).cast("double")).alias("begun"), F.percentile(F.when(F.col("repaired"), (F.col("repair_ms") - F.col("end_ms")) / float(HOUR_MS)), 0.5).alias("repair"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = reciprocation(messages, month(), "month", within_ms).join(known, ["thread_id", "month"], "left").select(
        "thread_id", "month", (F.col("n_me") + F.col("n_them")).alias("n_total"), share("n_them", F.col("n_me") + F.col("n_them")).alias("share_them"), share("hostile_me", "n_me").alias("hostile_share_me"), share("hostile_them", "n_them").alias("hostile_share_them"),
        share("returned", answered).alias("returned_rate"), "begun", "repair",
    )
    seeds = rows.groupBy("thread_id").agg(F.avg("begun").alias("seed_begun"), F.avg("repair").alias("seed_repair"))
    so_far = Window.partitionBy("thread_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col("seed_" + c), F.lit(0.0))
    rows = rows.join(seeds, "thread_id").withColumn("begun_share_them", carried("begun")).withColumn("repair_hours", carried("repair")).drop("begun", "repair", "seed_begun", "seed_repair")
    # One aggregate row per thread rather than windows over unordered frames.
    level = rows.groupBy("thread_id").agg(*[f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("sd", F.stddev_pop))])
    z = lambda c: F.when(F.col(f"sd_{c}") > 1e-12, (F.col(c) - F.col(f"m_{c}")) / F.col(f"sd_{c}")).otherwise(0.0)
    return rows.join(level, "thread_id").select("thread_id", "month", *FEATURES, *[z(c).alias(f"z_{c}") for c in FEATURES])


def best_split(x: np.ndarray, least: int) -> tuple[float, int]:
    """(score, row) of the split of x's rows with the largest mean shift in units of spread within both sides; (0, -1) where x is too short. The earliest of equals."""
    n = len(x)
    cuts = np.arange(least, n - least + 1)
    if not len(cuts):
        return 0.0, -1
    total, square = (np.vstack([np.zeros(x.shape[1]), np.cumsum(v, axis=0)]) for v in (x, x * x))
    left, right = cuts[:, None], (n - cuts)[:, None]
    ml, mr = total[cuts] / left, (total[n] - total[cuts]) / right
    within = square[n] - left * ml**2 - right * mr**2
    scores = (np.abs(ml - mr) / np.maximum(np.sqrt(np.maximum(within, 0) / n), 1e-6)).mean(axis=1)
    at = int(np.argmax(np.round(scores, 9)))
    return float(scores[at]), int(cuts[at])


def split_points(x: np.ndarray, least: int = 4, sigma: float = 0.75, most: int = 6) -> list[int]:
    """Starts of segments of the rows of x: the best split of any segment is made, while its score exceeds sigma."""
    starts = [0]
    while len(starts) < most:
        tried = [(best_split(x[a:b], least), a) for a, b in zip(starts, [*starts[1:], len(x)])]
        (score, at), a = max(tried, key=lambda t: t[0][0])
        if score <= sigma:
            break
        starts = sorted([*starts, a + at])
    return starts


def first_cuts(series: DataFrame, least: int = 4, sigma: float = 0.75) -> DataFrame:
    """(thread_id, first_cut, score): the month with which the best split of each thread's series begins, where its score exceeds sigma."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        score, at = best_split(pdf[[f"z_{c}" for c in FEATURES]].to_numpy(dtype=float), least)
        return pd.DataFrame({"thread_id": pdf["thread_id"].iloc[:1], "first_cut": pdf["month"].iloc[at : at + 1].tolist() or [None], "score": [score]})

    return series.groupBy("thread_id").applyInPandas(cut, "thread_id long, first_cut string, score double").filter(F.col("score") > sigma)


def eras(series: DataFrame, least: int = 4, sigma: float = 0.75, most: int = 6) -> DataFrame:
    """(thread_id, era, first_month, last_month, months, start_ms, end_ms, a mean of each feature): monthly_series' rows cut where the features' level shifts.

    A thread's months are few, so one call sees them whole. end_ms is the last millisecond of the last month.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        starts = split_points(pdf[[f"z_{c}" for c in FEATURES]].to_numpy(dtype=float), least, sigma, most)
        ends = [*starts[1:], len(pdf)]
        month, means = pdf["month"].to_numpy(), [pdf[list(FEATURES)].iloc[a:b].mean() for a, b in zip(starts, ends)]
        out = {"thread_id": pdf["thread_id"].iloc[0], "era": range(len(starts)), "first_month": month[starts], "last_month": month[[e - 1 for e in ends]], "months": [b - a for a, b in zip(starts, ends)]}
        return pd.DataFrame(out | {c: [m[c] for m in means] for c in FEATURES})

    shape = "thread_id long, era int, first_month string, last_month string, months int, " + ", ".join(f"{c} double" for c in FEATURES)
    out = series.groupBy("thread_id").applyInPandas(cut, shape).withColumns({c: rounded(F.col(c)) for c in FEATURES})
    day = lambda c, later: F.unix_date(F.add_months(F.to_date(F.concat(F.col(c), F.lit("-01"))), later)).cast("long") * (24 * HOUR_MS)
    return out.withColumn("start_ms", day("first_month", 0)).withColumn("end_ms", day("last_month", 1) - 1)


def coverage(messages: DataFrame, gap_days: int = 90, serious_days: int = 180, before: int = 15, least: int = 10) -> DataFrame:
    """(thread_id, n, gap_ms, confidence): the longest gap (the first of equals) lowers confidence if `before` messages lie in the gap_days up to it.

    Confidence is 1 under gap_days or with fewer than `least` messages, 0.4 from serious_days, else 0.6.
    """
    day = 24 * HOUR_MS
    rows = scan(segmented(messages.select("thread_id", "id", "ms")), lag={"prev": F.col("ms")}).plain()
    gap = F.col("ms") - F.col("prev")
    worst = rows.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("gap_ms"), F.max_by("prev", F.when(gap.isNotNull(), F.struct(gap, -F.col("prev")))).alias("from"))
    busy = messages.select("thread_id", "ms").join(worst.select("thread_id", "from"), "thread_id").groupBy("thread_id").agg(F.count_if((F.col("ms") <= F.col("from")) & (F.col("ms") > F.col("from") - gap_days * day)).alias("busy"))
    told = (F.col("n") >= least) & (F.col("busy") >= before) & (F.col("gap_ms") >= gap_days * day)
    return worst.join(busy, "thread_id").select("thread_id", "n", "gap_ms", F.when(told, F.when(F.col("gap_ms") >= serious_days * day, 0.4).otherwise(0.6)).otherwise(1.0).alias("confidence"))


def turns(messages: DataFrame) -> DataFrame:
    """(thread_id, turn, direction, messages, start_ms, end_ms): runs of messages of one side."""
    return with_turns(segmented(messages)).rows.groupBy("thread_id", "turn", "direction").agg(F.count(F.lit(1)).alias("messages"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))


def smoothing_half(days: Column) -> Column:
    """Half the width of the rolling mean for a span of so many days: a seventieth of it, 7 to 45 days wide."""
    return F.floor(F.least(F.lit(45.0), F.greatest(F.lit(7.0), days / 70)) / 2 + 0.5).cast("int")


def rolling(series: DataFrame, half: int | None = None) -> DataFrame:
    """(thread_id, day, n, half, smooth): a daily series on all days from first to last, with the centred mean of 2 * half + 1 days, shorter at the ends.

    half follows from each thread's span unless given.
    """
    ends = series.groupBy("thread_id").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.sum("n").alias("total"))
    width = F.lit(half) if half is not None else smoothing_half(F.col("b") - F.col("a") + 1)
    days = ends.select("thread_id", "a", "b", "total", width.alias("half"), F.explode(F.sequence("a", "b")).alias("day"))
    full = days.join(series.select("thread_id", "day", "n"), ["thread_id", "day"], "left").na.fill(0, ["n"])
    # A frame's width can't hang on the row, so sums are differences of running sums, half a width away on both sides.
    full = full.withColumn("upto", F.sum("n").over(Window.partitionBy("thread_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    ahead = full.select("thread_id", (F.col("day") - F.col("half")).alias("day"), F.col("upto").alias("ahead"))
    behind = full.select("thread_id", (F.col("day") + F.col("half") + 1).alias("day"), F.col("upto").alias("behind"))
    both = full.join(ahead, ["thread_id", "day"], "left").join(behind, ["thread_id", "day"], "left")
    count = F.least(F.col("day") + F.col("half"), F.col("b")) - F.greatest(F.col("day") - F.col("half"), F.col("a")) + 1
    smooth = (F.coalesce("ahead", "total") - F.coalesce("behind", F.lit(0))) / count
    return both.select("thread_id", "day", "n", "half", rounded(smooth).alias("smooth"))


def silences(series: DataFrame, half: int | None = None) -> DataFrame:
    """(thread_id, first, last, days): runs of days without messages after and before active ones, of at least max(14, 2 * half) days; half is `rolling`'s."""
    w = Window.partitionBy("thread_id").orderBy("day")
    ends = series.groupBy("thread_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    width = F.lit(half) if half is not None else smoothing_half(F.col("b") - F.col("a") + 1)
    gaps = series.select("thread_id", "day").withColumn("prev", F.lag("day").over(w)).filter(F.col("day") - F.col("prev") > 14)
    runs = gaps.select("thread_id", (F.col("prev") + 1).alias("first"), (F.col("day") - 1).alias("last"), (F.col("day") - F.col("prev") - 1).alias("days"))
    return runs.join(ends.select("thread_id", F.greatest(F.lit(14), 2 * width).alias("least")), "thread_id").filter(F.col("days") >= F.col("least")).drop("least")


def scaled(series: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """series with `scaled`: value over the thread's nearest-rank percentile (rank round((n - 1) * share) of the sorted values), 1 at most.

    A river's thickness is that of `rolling`'s smooth values, all days from first to last.
    """
    w = Window.partitionBy("thread_id").orderBy(value, "day")
    n = F.count(F.lit(1)).over(Window.partitionBy("thread_id"))
    ranked = series.withColumn("_nth", F.row_number().over(w) - 1).withColumn("_n", n)
    level = ranked.filter(F.col("_nth") == F.floor((F.col("_n") - 1) * share + 0.5)).select("thread_id", F.greatest(F.col(value), F.lit(1e-6)).alias("_level"))
    return series.join(level, "thread_id").withColumn("scaled", rounded(F.least(F.lit(1.0), F.col(value) / F.col("_level")))).drop("_level")


def steadiness(series: DataFrame, value: str = "sentiment", least: int = 5, calm: float = 0.18, restless: float = 0.34) -> DataFrame:
    """(thread_id, change, phrase): mean absolute change of a daily value from one day that has it to the next; null under `least` such days."""
    w = Window.partitionBy("thread_id").orderBy("day")
    known = series.filter(F.col(value).isNotNull()).withColumn("d", F.abs(F.col(value) - F.lag(value).over(w)))
    r = series.select("thread_id").distinct().join(known.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("c")), "thread_id", "left")
    change = F.when(F.col("n") >= least, F.col("c"))
    # The phrases.
    return r.select("thread_id", rounded(change).alias("change"), F.when(change < calm, "steady").when(change < restless, "gentle swings").when(change.isNotNull(), "changeable").otherwise("too little to say").alias("phrase"))


def calendar(series: DataFrame) -> DataFrame:
    """(thread_id, day, week, dow, n): every day from the first to the last, in columns of weeks that begin on Sunday."""
    ends = series.groupBy("thread_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    dow = F.pmod(F.col("day") + 4, F.lit(7)).cast("int")
    days = ends.select("thread_id", "a", F.explode(F.sequence("a", "b")).alias("day")).join(series.select("thread_id", "day", "n"), ["thread_id", "day"], "left").na.fill(0, ["n"])
    return days.select("thread_id", "day", F.floor((F.col("day") - F.col("a") + F.pmod(F.col("a") + 4, F.lit(7))) / 7).cast("int").alias("week"), dow.alias("dow"), "n")
