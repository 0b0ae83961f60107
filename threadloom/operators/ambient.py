"""What ordinary messages say of every thread: years, hours, words, months. Only substantive messages count; a zone sets the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.clock import Zone, half_up, local_date, local_day, local_hour, local_month, local_weekday
from threadloom.operators.ordered import substantive, top

# Ranges of pictographs, joined by U+200D into families and the like; two regional letters are a flag.
PICTOGRAPH = r"[\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F004}-\x{1F0CF}\x{1F170}-\x{1F1E5}\x{1F200}-\x{1F3FA}\x{1F400}-\x{1FAFF}]"
EMOJI = rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|{PICTOGRAPH}(?:[\x{{1F3FB}}-\x{{1F3FF}}\x{{FE0F}}\x{{20E3}}]|\x{{200D}}{PICTOGRAPH})*"


def _sides(prefix: str = "") -> list:
    return [F.count_if("me").alias(prefix + "me"), F.count_if(~F.col("me")).alias(prefix + "them")]


def volume(messages: DataFrame, zone: Zone = 0) -> DataFrame:
    """(thread_id, year, me, them): a row a year, and one with a null year for the whole."""
    rows = substantive(messages).withColumn("year", F.year(local_date(zone)))
    return rows.groupingSets([["thread_id", "year"], ["thread_id"]], "thread_id", "year").agg(*_sides()).select("thread_id", "year", "me", "them")


def rhythm(messages: DataFrame, zone: Zone = 0) -> DataFrame:
    """(thread_id, kind, slot, me, them): all 24 hours and 7 weekdays (0 is Sunday) of every thread."""
    rows = substantive(messages)
    slots = F.explode(F.array(F.struct(F.lit("hour").alias("kind"), local_hour(zone).alias("slot")), F.struct(F.lit("weekday").alias("kind"), local_weekday(zone).alias("slot"))))
    counts = rows.select("thread_id", "me", slots.alias("s")).groupBy("thread_id", F.col("s.kind").alias("kind"), F.col("s.slot").alias("slot")).agg(*_sides())
    all_slots = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("slot")) for kind, n in (("hour", 24), ("weekday", 7)) for i in range(n)])
    grid = counts.select("thread_id").distinct().select("thread_id", F.inline(all_slots))
    return grid.join(counts, ["thread_id", "kind", "slot"], "left").na.fill(0, ["me", "them"])


def busiest_day(messages: DataFrame, zone: Zone = 0) -> DataFrame:
    """(thread_id, date, n): the day of most substantive messages, the earliest of equals."""
    days = substantive(messages).groupBy("thread_id", local_date(zone).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy("thread_id").agg(F.max_by(F.struct("date", "n"), F.struct("n", -F.unix_date("date"))).alias("b")).select("thread_id", "b.date", "b.n")


def months(messages: DataFrame, zone: Zone = 0, busiest: int = 6) -> DataFrame:
    """(thread_id, month, me, them, place): volume by side; place numbers a thread's busiest months, earlier ones first among equals, and is null for others."""
    rows = substantive(messages).groupBy("thread_id", local_month(zone).alias("month")).agg(*_sides())
    ranked = top(rows.withColumn("n", F.col("me") + F.col("them")), ["thread_id"], [F.desc("n"), F.asc("month")], busiest).select("thread_id", "month", "place")
    return rows.join(ranked, ["thread_id", "month"], "left")


def language(messages: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """(thread_id, me, n, words, questions, one column for each phrase): mean words of three letters, percent of questions, messages that hold a phrase (a pattern, any case)."""
    body = F.col("body")
    words = F.size(F.regexp_extract_all(F.lower(body), F.lit("[a-z']{3,}"), 0))
    found = [F.count_if(body.rlike("(?i)" + p)).alias(name) for name, p in phrases.items()]
    return substantive(messages).groupBy("thread_id", "me").agg(
        F.count(F.lit(1)).alias("n"), half_up(F.avg(words), 1).alias("words"), half_up(F.avg(F.contains(body, F.lit("?")).cast("int")) * 100, 1).alias("questions"), *found
    )


def longest(messages: DataFrame, n: int = 5, preview: int = 120) -> DataFrame:
    """(thread_id, place, id, me, words, preview): the messages of most words; earlier ones win ties."""
    words = F.size(F.regexp_extract_all("body", F.lit(r"(?U)\S+"), 0))
    rows = top(substantive(messages).withColumn("words", words), ["thread_id"], [F.desc("words"), F.asc("ms"), F.asc("id")], n)
    return rows.select("thread_id", "place", "id", "me", "words", F.left(F.trim(F.regexp_replace("body", r"(?U)\s+", " ")), F.lit(preview)).alias("preview"))


def top_emoji(messages: DataFrame, n: int = 20, by: str = "thread_id") -> DataFrame:
    """(by, emoji, n, place): the most frequent emoji sequences; ties go to the smaller text."""
    each = substantive(messages).select(by, F.explode(F.regexp_extract_all("body", F.lit(EMOJI), 0)).alias("emoji"))
    return top(each.groupBy(by, "emoji").agg(F.count(F.lit(1)).alias("n")), [by], [F.desc("n"), F.asc("emoji")], n)


def active_days(messages: DataFrame, zone: Zone = 0) -> DataFrame:
    """(thread_id, day): local days with substantive messages, the input of `ordered.runs_of_days`."""
    return substantive(messages).select("thread_id", local_day(zone).alias("day")).distinct()
