"""Counts of phrases and how episodes end: ledgers, framing, apologies, exits, wearing down.

What counts as a phrase is the caller's: every function takes patterns (Java regular expressions, any case). Messages
need body, tension and warmth; episodes are those of `conflict.episodes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.clock import HOUR_MS
from threadloom.operators.conflict import hostile, quarter, warm
from threadloom.operators.ordered import rounded, substantive, top
from threadloom.operators.ranges import range_join
from threadloom.operators.segments import scan, segmented
from threadloom.sources.tables import date_of


def says(pattern: str) -> Column:
    return F.col("body").rlike("(?i)" + pattern)


def word_pattern(names: list[str]) -> str:
    """A pattern for any of these names as whole words; without names, one that nothing matches."""
    special = set(r"\.^$|?*+()[]{}-")
    escaped = ["".join("\\" + c if c in special else c for c in n) for n in names if n.strip()]
    return rf"(?<![A-Za-z0-9_])(?:{'|'.join(escaped)})(?![A-Za-z0-9_])" if escaped else r"(?!)"


def _sides(condition: Column, name: str) -> list[Column]:
    return [F.count_if(condition & F.col("me")).alias(f"{name}_me"), F.count_if(condition & ~F.col("me")).alias(f"{name}_them")]


def ledger(messages: DataFrame, categories: dict[str, str], preview: int = 200) -> DataFrame:
    """(thread_id, id, ms, me, category, text): messages under the first category whose pattern they hold."""
    kind = F.coalesce(*[F.when(says(p), name) for name, p in categories.items()])
    text = F.trim(F.regexp_replace("body", r"(?U)\s+", " "))
    cut = F.when(F.length(text) > preview, F.concat(F.left(text, F.lit(preview)), F.lit("…"))).otherwise(text)
    return substantive(messages).withColumn("category", kind).filter("category is not null").select("thread_id", "id", "ms", "me", "category", cut.alias("text"))


def ledger_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("thread_id", "category").agg(F.count_if("me").alias("n_me"), F.count_if(~F.col("me")).alias("n_them"))


def receipts(entries: DataFrame, n: int = 4) -> DataFrame:
    """The n latest entries of each thread, category and side."""
    return top(entries, ["thread_id", "category", "me"], [F.desc("ms"), F.desc("id")], n)


def framing(messages: DataFrame, first: str, second: str) -> DataFrame:
    """(thread_id, year, first_me, first_them, second_me, second_them): messages that hold either pattern, by year; a null year is the whole."""
    rows = substantive(messages).withColumn("a", says(first)).withColumn("b", says(second)).filter("a or b").withColumn("year", F.year(date_of()))
    return rows.groupingSets([["thread_id", "year"], ["thread_id"]], "thread_id", "year").agg(*_sides(F.col("a"), "first"), *_sides(F.col("b"), "second"))


def first_repairs(messages: DataFrame, episodes: DataFrame, apology: str, within_ms: int = 24 * HOUR_MS) -> DataFrame:
    """(thread_id, me, them, none): which side's apology comes first in the time after each episode's end (later than its last instant)."""
    said = substantive(messages).filter(says(apology)).select("thread_id", "ms", "id", "me")
    spans = episodes.select("thread_id", "start_ms", (F.col("end_ms") + 1).alias("after"), (F.col("end_ms") + within_ms).alias("until"))
    met = range_join(spans, said, "after", "until", "ms", within_ms, how="left")
    each = met.groupBy("thread_id", "start_ms", "after").agg(F.min_by("me", F.struct("ms", "id")).alias("by_me"))
    return each.groupBy("thread_id").agg(F.count_if("by_me").alias("me"), F.count_if(~F.col("by_me")).alias("them"), F.count_if(F.col("by_me").isNull()).alias("none"))


def met_with_fire(messages: DataFrame, apology: str, within_ms: int = 2 * HOUR_MS) -> DataFrame:
    """(thread_id, total_me, rejected_me, rate_me, total_them, ...): apologies whose first answer by the other side, within within_ms, is hostile."""
    me, value = F.col("me"), F.struct("ms", hostile().alias("hot"))
    rows = scan(segmented(substantive(messages).select("thread_id", "id", "ms", "me", "body", "tension")), coming={"mine": (me, value), "theirs": (~me, value)}).plain().filter(says(apology))
    answer = F.when(me, F.col("theirs")).otherwise(F.col("mine"))
    rows = rows.withColumn("rejected", F.coalesce((answer["ms"] - F.col("ms") <= within_ms) & answer["hot"], F.lit(False)))
    rate = lambda side: rounded(F.coalesce(F.try_divide(F.count_if(F.col("rejected") & side), F.count_if(side)), F.lit(0.0)), 3)
    return rows.groupBy("thread_id").agg(*_sides(F.lit(True), "total"), *_sides(F.col("rejected"), "rejected"), rate(me).alias("rate_me"), rate(~me).alias("rate_them"))


def exits(messages: DataFrame, episodes: DataFrame, block: str, notice: str, apology: str, bucket_ms: int = 24 * HOUR_MS) -> DataFrame:
    """(thread_id, start_ms, exit): how the owner's last message within each episode leaves it; episodes without one are left out.

    In this order: block, notice, softened (warm or an apology), met (hostile), silent.
    """
    mine = substantive(messages).filter("me").select("thread_id", "ms", "id", F.when(says(block), "block").when(says(notice), "notice").when(warm() | says(apology), "softened").when(hostile(), "met").otherwise("silent").alias("exit"))
    spans = episodes.select("thread_id", "start_ms", "end_ms")
    return range_join(spans, mine, "start_ms", "end_ms", "ms", bucket_ms).groupBy("thread_id", "start_ms").agg(F.max_by("exit", F.struct("ms", "id")).alias("exit"))


def by_era(rows: DataFrame, eras: DataFrame, at: str = "start_ms") -> DataFrame:
    """rows with the era (its number) that their moment lies in; null where none does. A thread has few eras, so the join's fan is small."""
    spans = eras.select("thread_id", "era", F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to")).alias("e")
    r = rows.alias("r")
    return r.join(spans, (F.col("r.thread_id") == F.col("e.thread_id")) & (F.col(f"r.{at}") >= F.col("e._from")) & (F.col(f"r.{at}") <= F.col("e._to")), "left").select("r.*", "e.era")


def wearing_down(messages: DataFrame, love: str, playful: str) -> DataFrame:
    """(thread_id, quarter, me, n, words, warm_rate, love_rate, playful_rate): rates to three places."""
    rate = lambda c: rounded(F.avg(c.cast("int")), 3)
    words = F.size(F.regexp_extract_all("body", F.lit(r"(?U)\S+"), 0))
    return substantive(messages).groupBy("thread_id", quarter().alias("quarter"), "me").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(words), 3).alias("words"), rate(warm()).alias("warm_rate"), rate(says(love)).alias("love_rate"), rate(says(playful)).alias("playful_rate")
    )


def near_mentions(messages: DataFrame, episodes: DataFrame, pattern: str, around_ms: int = HOUR_MS, bucket_ms: int = 24 * HOUR_MS) -> DataFrame:
    """episodes with near: whether a message that holds the pattern lies in their span or around_ms beside it."""
    said = substantive(messages).filter(says(pattern)).select("thread_id", F.col("ms").alias("said_ms"))
    spans = episodes.select("thread_id", "start_ms", (F.col("start_ms") - around_ms).alias("_from"), (F.col("end_ms") + around_ms).alias("_to"))
    hit = range_join(spans, said, "_from", "_to", "said_ms", bucket_ms).select("thread_id", "start_ms").distinct().withColumn("near", F.lit(True))
    return episodes.join(hit, ["thread_id", "start_ms"], "left").na.fill(False, ["near"])


def near_by_year(episodes: DataFrame) -> DataFrame:
    """(thread_id, year, episodes, near, near_share, hostile_me, hostile_them, severe): of `near_mentions`, by the year of an episode's start; the last three within near ones."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col("near"), c)), F.lit(0))
    return episodes.groupBy("thread_id", F.year(date_of("start_ms")).alias("year")).agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if("near").alias("near"), rounded(F.avg(F.col("near").cast("int"))).alias("near_share"),
        of(F.col("hostile_me")).alias("hostile_me"), of(F.col("hostile_them")).alias("hostile_them"), of(F.col("severe_me") + F.col("severe_them")).alias("severe"),
    )


def letter_material(series: DataFrame, episodes: DataFrame, entries: DataFrame, most: int = 6) -> DataFrame:
    """(thread_id, sums of a monthly `conflict.reciprocation`, first_rate, last_rate, episodes, receipts): what a summary of a thread rests on.

    The rates of returned hostility are those of the first and the last month that has any; episodes are the ids of the
    `most` with most severe messages, receipts those of the latest `receipts` of a ledger; both in ascending order.
    """
    rate = F.when(F.col("asked") > 0, F.col("returned") / F.col("asked"))
    counts = [c for c in series.columns if c.startswith(("n_", "hostile_", "severe_", "warm_"))]
    when = F.when(F.col("asked") > 0, F.col("month"))
    sums = series.groupBy("thread_id").agg(*[F.sum(c).alias(c) for c in counts], rounded(F.min_by(rate, when)).alias("first_rate"), rounded(F.max_by(rate, when)).alias("last_rate"))
    severe = top(episodes.withColumn("_s", F.col("severe_me") + F.col("severe_them")), ["thread_id"], [F.desc("_s"), F.desc("peak"), F.asc("start_ms"), F.asc("start_id")], most)
    told = severe.groupBy("thread_id").agg(F.array_sort(F.collect_list("start_id")).alias("episodes"))
    kept = receipts(entries).groupBy("thread_id").agg(F.array_sort(F.collect_list("id")).alias("receipts"))
    none = F.array().cast("array<bigint>")
    out = sums.join(told, "thread_id", "left").join(kept, "thread_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("episodes", "receipts")})


def claims_of(readings: DataFrame, evidence: str = "evidence") -> DataFrame:
    """(reading_id, claim, evidence_ids): a row for each entry of the readings' maps from claims to evidence."""
    return readings.select("reading_id", F.explode(evidence).alias("claim", "evidence_ids"))
