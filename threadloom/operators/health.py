"""Whether a thread's archive is whole: months, gaps, attachments, sources, and how loudly to warn.

Messages have att and smil besides the usual columns: how many attachments each has, and how many of them are layouts
(`attachment_counts`); source_kind and source_file say where a message came from. Reactions never count. Medians of an
even number of values are rounded means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.clock import DAY_MS, Zone, half_up, local_date, local_day
from threadloom.operators.ordered import rounded, spoken


def _mine() -> Column:
    return F.col("direction").isin("outgoing", "draft")


def _median(c: Column | str) -> Column:
    return half_up(F.percentile(c, 0.5)).cast("long")


def attachment_counts(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """messages with att and smil, counted over attachments (message_id, is_smil)."""
    counts = attachments.groupBy(F.col("message_id").alias("id")).agg(F.count(F.lit(1)).alias("att"), F.count_if("is_smil").alias("smil"))
    return messages.join(counts, "id", "left").na.fill(0, ["att", "smil"])


def months(messages: DataFrame, zone: Zone = 0) -> DataFrame:
    """(thread_id, month, total, me, them, with_attachments, active_days, days_in_month, below): every month from the first to the last.

    below marks months with messages, but under 15 % of the thread's median month.
    """
    rows = spoken(messages).groupBy("thread_id", F.trunc(local_date(zone), "month").alias("m")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_mine()).alias("me"), F.count_if(F.col("att") > 0).alias("with_attachments"), F.countDistinct(local_day(zone)).alias("active_days"),
    )
    span = rows.groupBy("thread_id").agg(F.expr("sequence(min(m), max(m), interval 1 month)").alias("ms"), F.greatest(F.lit(1), half_up(_median("total") * 0.15)).alias("floor"))
    full = span.select("thread_id", "floor", F.explode("ms").alias("m")).join(rows, ["thread_id", "m"], "left").na.fill(0, ["total", "me", "with_attachments", "active_days"])
    below = (F.col("total") > 0) & (F.col("total") < F.col("floor"))
    return full.select("thread_id", F.date_format("m", "yyyy-MM").alias("month"), "total", "me", (F.col("total") - F.col("me")).alias("them"), "with_attachments", "active_days", F.day(F.last_day("m")).alias("days_in_month"), below.alias("below"))


def gaps(messages: DataFrame, zone: Zone = 0) -> DataFrame:
    """(thread_id, from_month, to_month, months, last_before_ms, first_after_ms): runs of months without messages."""
    rows = spoken(messages).groupBy("thread_id", F.trunc(local_date(zone), "month").alias("m")).agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    w = Window.partitionBy("thread_id").orderBy("m")
    apart = (F.year("m") - F.year(F.lag("m").over(w))) * 12 + F.month("m") - F.month(F.lag("m").over(w)) - 1
    holes = rows.withColumn("months", apart).withColumn("before", F.lag("m").over(w)).withColumn("last_before_ms", F.lag("last").over(w)).filter("months > 0")
    name = lambda c: F.date_format(c, "yyyy-MM")
    return holes.select("thread_id", name(F.add_months("before", 1)).alias("from_month"), name(F.add_months("m", -1)).alias("to_month"), "months", "last_before_ms", F.col("first").alias("first_after_ms"))


def source_spans(messages: DataFrame) -> DataFrame:
    """(thread_id, kind, first_ms, last_ms, n, files): what each kind of source covers; a missing kind is unknown."""
    return spoken(messages).groupBy("thread_id", F.coalesce("source_kind", F.lit("unknown")).alias("kind")).agg(
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n"), F.countDistinct("source_file").alias("files")
    )


def report(messages: DataFrame, zone: Zone = 0, imported_ms: Column | None = None) -> DataFrame:
    """One row per thread: span, active share, volumes, medians, attachments, suspicions and the caution level with its reasons.

    imported_ms, an aggregate over a thread's messages, is when its files were read, for the suspicion that an archive
    ends long before.
    """
    imported = F.max(F.lit(None).cast("long")) if imported_ms is None else imported_ms
    rows = spoken(messages)
    ends = Window.partitionBy("thread_id")
    rows = rows.withColumn("end", F.max("ms").over(ends))
    day = local_day(zone)
    total = rows.groupBy("thread_id").agg(
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("total"), F.count_if(_mine()).alias("me"), F.countDistinct(day).alias("active_days"),
        F.count_if(F.col("att") > 0).alias("with_attachments"), F.count_if((F.col("att") > 0) & (F.col("att") == F.col("smil"))).alias("layout_only"), F.max(F.when(F.col("att") > 0, F.col("ms"))).alias("last_attachment_ms"),
        F.count_if(F.col("ms") >= F.col("end") - 90 * DAY_MS).alias("tail"), imported.alias("imported"),
    )
    reactions = messages.groupBy("thread_id").agg(F.count_if("is_reaction").alias("reactions"))
    per_day = rows.groupBy("thread_id", day.alias("d")).agg(F.count(F.lit(1)).alias("n")).groupBy("thread_id").agg(_median("n").alias("median_day"))
    by_month = months(messages, zone)
    shape = by_month.groupBy("thread_id").agg(F.count(F.lit(1)).alias("months"), F.count_if("below").alias("thin"), F.count_if(F.col("total") == 0).alias("absent"), _median(F.when(F.col("total") > 0, F.col("total"))).alias("median_month"))
    holes = gaps(messages, zone).groupBy("thread_id").agg(F.max("months").alias("longest_gap"))
    r = total.join(reactions, "thread_id").join(per_day, "thread_id").join(shape, "thread_id").join(holes, "thread_id", "left").na.fill(0, ["longest_gap"])
    r = r.withColumn("them", F.col("total") - F.col("me")).withColumn("days", F.greatest(F.lit(1.0), (F.col("last_ms") - F.col("first_ms")) / DAY_MS))
    suspicions = {
        "attachments_stop": F.coalesce(F.col("last_ms") - F.col("last_attachment_ms") > 120 * DAY_MS, F.lit(False)),
        "collapses": (F.col("days") > 365) & (F.col("tail") < F.col("total") / F.col("days") * 18),
        "ends_early": F.coalesce(F.col("imported") - F.col("last_ms") > 180 * DAY_MS, F.lit(False)),
        "lopsided": (F.col("total") >= 50) & (F.least("me", "them") < F.greatest("me", "them") * 0.1),
    }
    r = r.withColumns(suspicions).withColumn("active_share", rounded(F.col("active_days") / F.greatest(F.lit(1), half_up((F.col("last_ms") - F.col("first_ms")) / DAY_MS) + 1)))
    reasons = F.array_compact(F.array(F.when(F.col("absent") > 0, "absent_months"), F.when(F.col("thin") > 0, "thin_months"), *[F.when(F.col(s), s) for s in suspicions]))
    level = F.when((F.col("longest_gap") >= 3) | F.col("lopsided") | F.col("collapses"), "serious").when(F.size(reasons) > 0, "notable").otherwise("clear")
    return r.select(
        "thread_id", "first_ms", "last_ms", "months", "active_days", "active_share", "total", "me", "them", "reactions", "median_day", "median_month", "thin", "absent", "longest_gap",
        "with_attachments", "layout_only", "last_attachment_ms", *suspicions, level.alias("level"), F.array_join(reasons, ",").alias("reasons"),
    )


def discontinuity(messages: DataFrame, ranges: DataFrame, zone: Zone = 0) -> DataFrame:
    """(thread_id, from_ms, to_ms, gap_months, thin_months): what the span of each range misses; 0 or null ends are open. Ranges that aren't ahead have nulls."""
    ends = spoken(messages).groupBy("thread_id").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    open_ = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(default))
    asked = ranges.join(ends, "thread_id").withColumn("a", open_("from_ms", "first")).withColumn("b", open_("to_ms", "last"))
    name = lambda c: F.date_format(local_date(zone, c), "yyyy-MM")
    shape = months(messages, zone).filter("below or total = 0").select("thread_id", "month", "below")
    joined = asked.withColumn("m1", name("a")).withColumn("m2", name("b")).join(shape, "thread_id", "left")
    inside = (F.col("month") >= F.col("m1")) & (F.col("month") <= F.col("m2")) & (F.col("b") > F.col("a"))
    ahead = F.max(F.col("b") > F.col("a"))
    return joined.groupBy("thread_id", "from_ms", "to_ms").agg(F.when(ahead, F.count_if(inside & ~F.col("below"))).alias("gap_months"), F.when(ahead, F.count_if(inside & F.col("below"))).alias("thin_months"))


def ambiguous_contacts(participants: DataFrame, identifiers: DataFrame, messages: DataFrame) -> DataFrame:
    """(thread_id, contact_id, identifiers, messages): members known by more than one identifier, and how much they sent."""
    known = identifiers.groupBy("contact_id").agg(F.countDistinct("identifier").alias("identifiers")).filter("identifiers > 1")
    sent = messages.groupBy("thread_id", F.col("sender_id").alias("contact_id")).agg(F.count(F.lit(1)).alias("messages"))
    members = participants.select("thread_id", "contact_id").distinct()
    return members.join(known, "contact_id").join(sent, ["thread_id", "contact_id"], "left").na.fill(0, ["messages"]).select("thread_id", "contact_id", "identifiers", "messages")


def collapsed_records(files: DataFrame, messages: DataFrame) -> DataFrame:
    """(collapsed): records that files declare beyond the messages stored, over the whole archive."""
    declared = files.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("d"))
    stored = messages.agg(F.count(F.lit(1)).alias("n"))
    return declared.join(F.broadcast(stored)).select(F.greatest(F.lit(0), F.col("d") - F.col("n")).alias("collapsed"))  # one row each
