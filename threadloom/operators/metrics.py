"""Counts, series, sessions, replies and streaks of every thread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.clock import Zone, half_up, local_day, local_hour, local_weekday
from threadloom.operators import valence
from threadloom.operators.ordered import rounded, runs_of_days, spoken, substantive, top
from threadloom.operators.quantiles import percentiles
from threadloom.operators.segments import gap_groups, scan, segmented
from threadloom.sources.tables import HOUR_MS, day_of
from threadloom.sources.versions import Store
from threadloom.sources.work import kept

# Words that speak of oneself, of the other, and of both.
I_WORDS = ("i", "i'm", "i've", "i'll", "i'd", "im", "ive", "me", "my", "mine", "myself")
YOU_WORDS = ("you", "you're", "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "u", "ya")
WE_WORDS = ("we", "we're", "we've", "we'll", "we'd", "us", "our", "ours", "ourselves")
#: Changed threads whose ids may be broadcast.
CHANGED = 1_000_000
#: Words of a lexicon that may be broadcast.
LEXICON_ROWS = 500_000


def sent() -> Column:
    return F.col("direction") == "outgoing"


def received() -> Column:
    return F.col("direction") == "incoming"


def reply_latencies(messages: DataFrame) -> DataFrame:
    """(thread_id, direction, minutes): at each change of side among sent and received messages, time since the one before."""
    two = scan(segmented(spoken(messages).filter(sent() | received()).select("thread_id", "id", "ms", "direction")), lag={"was": F.col("direction"), "_then": F.col("ms")}).plain()
    return two.withColumn("minutes", (F.col("ms") - F.col("_then")) / 60_000.0).filter("was <> direction").select("thread_id", "direction", "minutes")


def summary(messages: DataFrame, session_gap_ms: int = HOUR_MS, zone: Zone = 0) -> DataFrame:
    """One row per thread: totals, sides, span, late-night share (before 5 by the zone's clock), sessions and who opens them, median and p90 replies in minutes."""
    rows = gap_groups(segmented(spoken(messages).select("thread_id", "id", "ms", "direction")), session_gap_ms, "session").plain()
    hour = local_hour(zone)
    counts = rows.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(sent()).alias("sent"), F.count_if(received()).alias("received"),
        rounded(F.avg(sent().cast("double"))).alias("sent_share"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
        rounded(F.avg((hour < 5).cast("double"))).alias("late_share"), F.count_if("begins").alias("sessions"),
        F.count_if(F.col("begins") & sent()).alias("opened_by_you"), F.count_if(F.col("begins") & received()).alias("opened_by_them"),
        rounded(F.count(F.lit(1)) / F.count_if("begins")).alias("session_messages"),
    )
    found = percentiles(reply_latencies(messages), ["thread_id", "direction"], "minutes", {"median": 0.5, "p90": 0.9})
    of = lambda side, c: rounded(F.max(F.when(F.col("direction") == side, F.col(c))))
    replies = found.groupBy("thread_id").agg(*[of(side, c).alias(f"{name}_{c}") for side, name in (("outgoing", "you"), ("incoming", "them")) for c in ("median", "p90")])
    return counts.join(replies, "thread_id", "left")


def daily(messages: DataFrame, zone: Zone = 0) -> DataFrame:
    """(thread_id, day, n, sent, received, warmth, tension): a row per thread and day of the zone's clock with messages; day counts from 1970."""
    return spoken(messages).groupBy("thread_id", local_day(zone).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sent()).alias("sent"), F.count_if(received()).alias("received"),
        rounded(F.avg(F.col("warmth") / 3.0)).alias("warmth"), rounded(F.avg(F.col("tension") / 3.0)).alias("tension"),
    )


def heatmap(messages: DataFrame, zone: Zone = 0) -> DataFrame:
    """(thread_id, dow, hour, n) for all 168 cells of every thread by the zone's clock; dow 0 is Sunday."""
    cell = spoken(messages).groupBy("thread_id", local_weekday(zone).alias("dow"), local_hour(zone).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    grid = spoken(messages).select("thread_id").distinct().withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(cell, ["thread_id", "dow", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sentiment(messages: DataFrame, lexicon: DataFrame, zone: Zone = 0, alpha: float = 15.0, context: valence.Context | None = None) -> DataFrame:
    """(thread_id, day, sentiment, warmth, tension, scored, english_share): daily means of scores by a lexicon (word, valence).

    A message's score is its words' valence sum over the root of its square plus alpha, so that it lies within -1 and 1.
    Every eligible message (language en or unknown) with more than white space has one, 0 if it holds no word of the
    lexicon. warmth is the mean of its positive part, tension of its negative part; on days without scored messages both
    are 0 and sentiment is null. With a context words are scored by `valence.scores`. The lexicon is broadcast only if it
    is counted to be small.
    """
    few = lexicon.limit(LEXICON_ROWS + 1).count() <= LEXICON_ROWS
    rows = spoken(messages).select("thread_id", "id", "body", local_day(zone).alias("day"), english().alias("eligible"))
    said = F.col("eligible") & F.coalesce(F.col("body"), F.lit("")).rlike(r"(?U)\S")
    if context is not None:
        keyed = rows.filter(said).select("thread_id", "day", F.struct("thread_id", "id").alias("key"), "body")
        total = valence.scores(keyed, lexicon, context, LEXICON_ROWS).select("key", "score").join(keyed.select("key", "thread_id", "day"), "key")
        return _daily_sentiment(rows, said, total.select("thread_id", "day", F.col("score").alias("c")))
    words = rows.filter(said).select("thread_id", "day", "id", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(r"[a-z][a-z']*"), 0)).alias("word"))
    total = words.join(F.broadcast(lexicon) if few else lexicon, "word").groupBy("thread_id", "day", "id").agg(F.sum("valence").alias("s"))
    score = F.col("s") / F.sqrt(F.col("s") * F.col("s") + alpha)
    return _daily_sentiment(rows, said, total.withColumn("c", score))


def _daily_sentiment(rows: DataFrame, said: Column, scored: DataFrame) -> DataFrame:
    """Daily means of scores c: messages without such a word add nothing to the sums, and count."""
    sums = scored.groupBy("thread_id", "day").agg(F.sum("c").alias("c"), F.sum(F.greatest(F.lit(0.0), "c")).alias("up"), F.sum(F.greatest(F.lit(0.0), -F.col("c"))).alias("down"))
    days = rows.groupBy("thread_id", "day").agg(F.count_if(said).alias("scored"), rounded(F.avg(F.col("eligible").cast("int"))).alias("english_share"))
    mean = lambda c: rounded(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), F.col("scored")))
    both = days.join(sums, ["thread_id", "day"], "left")
    return both.select("thread_id", "day", mean("c").alias("sentiment"), F.coalesce(mean("up"), F.lit(0.0)).alias("warmth"), F.coalesce(mean("down"), F.lit(0.0)).alias("tension"), "scored", "english_share")


def english() -> Column:
    """Whether a message's words may be read as English: its language is that or unknown."""
    return F.coalesce(F.col("lang") == "en", F.lit(True))


def english_gate(messages: DataFrame) -> DataFrame:
    """(thread_id, share, available): word-based readings are offered where over half of a thread's messages are eligible."""
    share = F.avg(english().cast("int"))
    return spoken(messages).groupBy("thread_id").agg(rounded(share).alias("share"), (share > 0.5).alias("available"))


def streaks(messages: DataFrame) -> DataFrame:
    """(thread_id, active_days, longest_streak, longest_silence) over UTC days."""
    islands = runs_of_days(spoken(messages).select("thread_id", day_of().alias("day")).distinct())
    return islands.groupBy("thread_id").agg(F.sum("length").alias("active_days"), F.max("length").alias("longest_streak"), F.coalesce(F.max("silence"), F.lit(0)).alias("longest_silence"))


def wording(messages: DataFrame) -> DataFrame:
    """(thread_id, direction, n, avg_words, question_share, we_ratio): words are runs without white space.

    we_ratio is the share of words of both among those of oneself, the other and both, over messages that are English or
    of unknown language (all of them where there is no lang column); null without any.
    """
    body = F.coalesce("body", F.lit(""))
    trimmed = F.trim(F.regexp_replace(body, r"(?U)\s+", " "))
    eligible = english() if "lang" in messages.columns else F.lit(True)
    tokens = F.when(eligible, F.regexp_extract_all(F.lower(body), F.lit(r"[a-z][a-z']*"), 0)).otherwise(F.array().cast("array<string>"))
    of = lambda *w: F.size(F.filter(tokens, lambda t: t.isin(*w)))
    rows = spoken(messages).select("thread_id", "direction", F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).alias("words"), F.contains(body, F.lit("?")).cast("double").alias("asks"),
                                   of(*WE_WORDS).alias("we"), of(*I_WORDS, *YOU_WORDS).alias("other"))
    total = F.sum("we") + F.sum("other")
    return rows.groupBy("thread_id", "direction").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("words")).alias("avg_words"), rounded(F.avg("asks")).alias("question_share"), rounded(F.when(total > 0, F.sum("we") / total)).alias("we_ratio"))


def top_words(messages: DataFrame, n: int = 30, stop: tuple[str, ...] = ()) -> DataFrame:
    """(thread_id, me, word, n, place): the most frequent words of three letters or more by side; ties go to the first seen."""
    words = substantive(messages).select("thread_id", "me", "ms", "id", F.posexplode(F.regexp_extract_all(F.lower("body"), F.lit("[a-z']{3,}"), 0)).alias("pos", "word"))
    counted = words.filter(~F.col("word").isin(*stop)) if stop else words
    counted = counted.groupBy("thread_id", "me", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ms", "id", "pos")).alias("seen"))
    return top(counted, ["thread_id", "me"], [F.desc("n"), F.asc("seen")], n).drop("seen")


def replies_by_side(messages: DataFrame, most_ms: int = 6 * HOUR_MS, zone: Zone = 0) -> DataFrame:
    """(thread_id, ...): median minutes of replies within most_ms to one place, first and last of each day by the zone's clock, and double texts, by side."""
    narrow = substantive(messages).select("thread_id", "id", "ms", "me").withColumn("day", local_day(zone))
    s = scan(segmented(narrow), lag={"was": F.col("me"), "_then": F.col("ms"), "_day": F.col("day")}, coming={"_next_day": (F.lit(True), F.col("day"))})
    rows = s.plain().withColumn("gap", F.col("ms") - F.col("_then")).withColumn("first", ~F.col("day").eqNullSafe(F.col("_day"))).withColumn("last", ~F.col("day").eqNullSafe(F.col("_next_day")))
    answered = (F.col("was") != F.col("me")) & (F.col("gap") > 0) & (F.col("gap") <= most_ms)
    me = F.col("me")
    double = lambda side: rounded(F.count_if((F.col("was") == F.col("me")) & side) / F.greatest(F.count_if(side), F.lit(1)), 3)
    minutes = lambda side: F.when(answered & side, F.col("gap") / 60_000.0)
    counts = [
        F.count_if(F.col("first") & me).alias("first_me"), F.count_if(F.col("first") & ~me).alias("first_them"), F.count_if(F.col("last") & me).alias("last_me"), F.count_if(F.col("last") & ~me).alias("last_them"),
        double(me).alias("double_me"), double(~me).alias("double_them"),
    ]
    sides = {"median_me": me, "median_them": ~me}
    if s.hot is None:
        out = rows.groupBy("thread_id").agg(*[F.percentile(minutes(side), 0.5).alias(n) for n, side in sides.items()], *counts)
    else:
        # A thread of several ranges may have more replies than one task should hold.
        halves = percentiles(rows.filter(answered).select("thread_id", "me", minutes(F.lit(True)).alias("minutes")), ["thread_id", "me"], "minutes", {"half": 0.5})
        out = rows.groupBy("thread_id").agg(*counts).join(halves.groupBy("thread_id").agg(*[F.max(F.when(side, F.col("half"))).alias(n) for n, side in sides.items()]), "thread_id", "left")
    return out.select("thread_id", *[F.coalesce(half_up(F.col(n), 1), F.lit(0.0)).alias(n) for n in sides], "first_me", "first_them", "last_me", "last_them", "double_me", "double_them")


def fingerprints(messages: DataFrame, by: str = "thread_id") -> DataFrame:
    """(by, print): what each thread's rows are known by, in any order: their number and the sums of two hashes of all columns."""
    columns = sorted(messages.columns)
    sums = [F.sum(F.xxhash64(F.lit(i), *columns).cast("decimal(38,0)")).cast("string") for i in (1, 2)]
    return messages.groupBy(by).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("print"))


def refreshed(store: Store, name: str, messages: DataFrame, make: Callable[[DataFrame], DataFrame], by: str = "thread_id") -> tuple[Store, DataFrame]:
    """(the store with table `name` up to date, (by, status)): rows are made anew only for threads that changed; status is new, changed, kept or removed.

    make gives rows with the column `by` for messages of some threads, each thread by itself. Rows and fingerprints are
    one version. Nothing is written where nothing changed.
    """
    known = store.read(f"{name}_prints")
    now = fingerprints(messages, by)
    old = now.limit(0) if known is None else known
    both = now.select(by, F.col("print").alias("_now")).join(old.select(by, F.col("print").alias("_then")), by, "full")
    status = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "removed").when(F.col("_now") == F.col("_then"), "kept").otherwise("changed")
    states = kept(both.select(by, status.alias("status"), F.col("_now").alias("print")))
    moved = states.filter("status <> 'kept'")
    if moved.isEmpty() and store.read(name) is not None:
        return store, states.select(by, "status")
    due = states.filter("status in ('new', 'changed')").select(by)
    few = due.limit(CHANGED + 1).count() <= CHANGED
    made = make(messages.join(F.broadcast(due) if few else due, by, "left_semi"))
    before = store.read(name)
    rows = made if before is None else before.join(moved.select(by), by, "left_anti").unionByName(made)
    prints = states.filter("print is not null").select(by, "print")
    return store.commit(replace={name: rows, f"{name}_prints": prints}), states.select(by, "status")


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame], anew: bool = False) -> DataFrame:
    """The table at path; it is made and written there first where it isn't yet, or where it is to be made anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if anew or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
