"""Phrase search, pages and lists of threads, participant signatures, exports and label sweeps."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.ordered import rounded, substantive, top
from threadloom.operators.ranges import range_join
from threadloom.operators.segments import scan, segmented


def phrase_hits(rows: DataFrame, phrase: str, key: str, text: str) -> DataFrame:
    """(key, length, hits): words of each text, and how often those of phrase follow one another in it (overlaps count)."""
    wanted = [t for t in re.split(r"[^\w]+|_", phrase.lower()) if t]
    if not wanted:
        return rows.select(key, F.lit(0).alias("length"), F.lit(0).alias("hits")).limit(0)
    low = F.lower(F.coalesce(text, F.lit("")))
    # Two blanks after each word, so that a hit's last word may begin the next one. Only texts that hold every word are looked at so closely.
    body = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    held = functools.reduce(Column.__and__, [F.contains(low, F.lit(t)) for t in wanted])
    hits = F.when(held, F.regexp_count(body, F.lit(f" (?={'  '.join(wanted)} )"))).otherwise(0)
    return rows.select(key, F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+")).alias("length"), hits.alias("hits"))


def phrase_search(rows: DataFrame, phrase: str, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, hits, length, score): texts that hold the words of phrase in a row, best BM25 first by score; words are runs of letters and digits, lower-cased.

    One pass over the texts; its two numbers a text are what statistics and hits are taken from.
    """
    measured = phrase_hits(rows, phrase, key, text)
    stats = measured.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), F.count_if(F.col("hits") > 0).alias("with"))
    idf = F.log(1 + (F.col("docs") - F.col("with") + 0.5) / (F.col("with") + 0.5))
    score = idf * F.col("hits") * (k1 + 1) / (F.col("hits") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return measured.filter("hits > 0").join(F.broadcast(stats)).select(key, "hits", "length", rounded(score).alias("score"))  # stats is one row


def best_hits(messages: DataFrame, phrase: str, limit: int = 100, thread_id: int | None = None, words: int = 12) -> DataFrame:
    """(thread_id, id, ms, direction, score, snippet): the `limit` best messages of all threads or one; the snippet is the hit in brackets and words around it.

    Statistics are those of all messages, whichever thread is asked for. Ties go to the smaller id.
    """
    found = phrase_search(messages, phrase, "id", "body")
    inside = messages if thread_id is None else messages.filter(F.col("thread_id") == thread_id)
    best = inside.join(found, "id").orderBy(F.desc("score"), "id").limit(limit)
    wanted = [re.escape(t) for t in re.split(r"[^\w]+|_", phrase.lower()) if t]
    middle = r"[^\p{L}\p{N}]+".join(wanted)
    hit = rf"(?i)(?<![\p{{L}}\p{{N}}])({middle})(?![\p{{L}}\p{{N}}])"
    around = max(0, words - len(wanted)) // 2
    cut = F.regexp_extract("body", rf"((?:\S+\s+){{0,{around}}}\S*?{hit}\S*(?:\s+\S+){{0,{around}}})", 1)
    snippet = F.concat(F.when(F.startswith(F.trim("body"), cut), "").otherwise("…"), F.regexp_replace(cut, hit, r"[$1]"), F.when(F.endswith(F.trim("body"), cut), "").otherwise("…"))
    return best.select("thread_id", "id", "ms", "direction", "score", snippet.alias("snippet"))


def plan_ask(messages: DataFrame, thread_id: int, phrase: str = "", side: str | None = None, from_ms: int | None = None, to_ms: int | None = None,
             least_tension: float | None = None, most_tension: float | None = None, least_warmth: float | None = None, pattern: str | None = None, cap: int = 500, limit: int = 50) -> DataFrame:
    """(id, ms, me, tension, warmth, body, count, label): the first `limit` messages that meet all filters, in order, and how many there are.

    messages have `scored`; a filter on scores leaves unscored messages out. With a phrase the thread's cap + 1 best hits
    are looked at, whose scores are those among all messages; without one the first cap + 1 messages of the range. count
    stops at cap, the label then says so.
    """
    every = substantive(messages)
    rows = every.filter(F.col("thread_id") == thread_id)
    ranged = [c for c, v in ((F.col("ms") >= from_ms, from_ms), (F.col("ms") <= to_ms, to_ms)) if v is not None]
    if phrase.strip():
        found = rows.select("id").join(phrase_search(every, phrase, "id", "body"), "id").orderBy(F.desc("score"), "id").limit(cap + 1)
        rows = rows.join(found.select("id"), "id", "left_semi")
    for c in ranged:
        rows = rows.filter(c)
    if not phrase.strip():
        rows = rows.orderBy("ms", "id").limit(cap + 1)
    tests = [(side, F.col("me") == (side == "me")), (least_tension, F.col("tension") >= F.lit(least_tension)), (most_tension, F.col("tension") <= F.lit(most_tension)), (least_warmth, F.col("warmth") >= F.lit(least_warmth)), (pattern, F.col("body").rlike("(?i)" + (pattern or "")))]
    for value, c in tests:
        if value is not None:
            rows = rows.filter(c)
    if any(v is not None for v in (least_tension, most_tension, least_warmth)):
        rows = rows.filter("scored")
    # At most cap + 1 rows are left, so one window over them all is bounded.
    counted = rows.orderBy("ms", "id").limit(cap + 1).withColumn("n", F.row_number().over(Window.orderBy("ms", "id"))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy()))
    label = F.when(F.col("all") > cap, f"{cap}+").otherwise(F.col("all").cast("string"))
    shown = lambda c: F.when(F.col("scored"), F.col(c)).alias(c)
    return counted.filter(F.col("n") <= min(limit, cap)).select("id", "ms", "me", shown("tension"), shown("warmth"), "body", F.least("all", F.lit(cap)).alias("count"), label.alias("label"))


def signatures(members: DataFrame, thread: str, member: str) -> DataFrame:
    """(thread, members, signature): one signature for equal sets of members, whatever their order."""
    return members.groupBy(thread).agg(F.array_sort(F.collect_set(F.col(member).cast("string"))).alias("m")).select(thread, F.size("m").alias("members"), F.sha2(F.array_join("m", ","), 256).alias("signature"))


def export_digests(messages: DataFrame, piece: int = 10_000) -> DataFrame:
    """(thread_id, piece, lines, digest): SHA-256 of a thread's lines in order, by pieces of so many lines, so that no task holds a whole thread's text."""
    line = F.concat_ws("|", F.col("ms").cast("string"), "direction", F.coalesce("body", F.lit("")))
    numbered = scan(segmented(messages), total={"nth": F.lit(1)}).plain().withColumn("piece", F.floor((F.col("nth") - 1) / piece))
    parts = F.array_sort(F.collect_list(F.struct("ms", "id", line.alias("line"))))
    return numbered.groupBy("thread_id", "piece").agg(F.count(F.lit(1)).alias("lines"), F.sha2(F.array_join(F.transform(parts, lambda p: p["line"]), "\n"), 256).alias("digest"))


def chained_digest(pieces: DataFrame) -> DataFrame:
    """(thread_id, lines, digest): one digest for a thread: SHA-256 of its pieces' digests in order."""
    digests = F.transform(F.array_sort(F.collect_list(F.struct("piece", "digest"))), lambda p: p["digest"])
    return pieces.groupBy("thread_id").agg(F.sum("lines").alias("lines"), F.sha2(F.array_join(digests, ""), 256).alias("digest"))


def page(messages: DataFrame, before_ms: int | None = None, limit: int = 200, after_ms: int | None = None, newest: bool = True) -> DataFrame:
    """`limit` messages of each thread after one moment and before another (both exclusive), the newest or the oldest: a keyset page."""
    kept = messages
    if before_ms is not None:
        kept = kept.filter(F.col("ms") < before_ms)
    if after_ms is not None:
        kept = kept.filter(F.col("ms") > after_ms)
    return top(kept, ["thread_id"], [F.desc("ms"), F.desc("id")] if newest else [F.asc("ms"), F.asc("id")], limit, "n").drop("n")


def message_rows(messages: DataFrame, contacts: DataFrame, attachments: DataFrame) -> DataFrame:
    """messages with sender_name (null where the sender is unknown) and attachments: how many each has, layouts left out.

    messages have sender_id, contacts (contact_id, name), attachments (message_id, is_smil).
    """
    names = contacts.select(F.col("contact_id").alias("sender_id"), F.col("name").alias("sender_name"))
    counts = attachments.filter(~F.col("is_smil")).groupBy(F.col("message_id").alias("id")).agg(F.count(F.lit(1)).alias("attachments"))
    return messages.join(names, "sender_id", "left").join(counts, "id", "left").na.fill(0, ["attachments"])


def around(messages: DataFrame, episodes: DataFrame, slack_ms: int = 1, limit: int = 2000, bucket_ms: int = 86_400_000) -> DataFrame:
    """(thread_id, start_ms, place, id, ms, direction, body): the messages of each episode, slack_ms beyond its ends, the first `limit` of them."""
    spans = episodes.select("thread_id", "start_ms", (F.col("start_ms") - slack_ms).alias("_from"), (F.col("end_ms") + slack_ms).alias("_to"))
    rows = range_join(spans, messages.select("thread_id", "id", "ms", "direction", "body"), "_from", "_to", "ms", bucket_ms)
    return top(rows, ["thread_id", "start_ms"], [F.asc("ms"), F.asc("id")], limit).select("thread_id", "start_ms", "place", "id", "ms", "direction", "body")


def moments(messages: DataFrame) -> DataFrame:
    """(thread_id, first_id, first_ms, biggest_day, biggest_n, total) over all messages but reactions, days in UTC; the earliest of equal days."""
    rows = messages.filter(~F.col("is_reaction"))
    days = rows.groupBy("thread_id", F.floor(F.col("ms") / 86_400_000).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ms", "id")).alias("first"))
    return days.groupBy("thread_id").agg(F.min("first").alias("f"), F.max_by(F.struct("day", "n"), F.struct("n", -F.col("day"))).alias("b"), F.sum("n").alias("total")).select(
        "thread_id", F.col("f.id").alias("first_id"), F.col("f.ms").alias("first_ms"), F.col("b.day").alias("biggest_day"), F.col("b.n").alias("biggest_n"), "total"
    )


def thread_list(messages: DataFrame, participants: DataFrame, contacts: DataFrame) -> DataFrame:
    """(thread_id, names, n, last_ms, grieving): threads with the names of those besides the owner, and whether one of them has died; order by last_ms for a list.

    participants are (thread_id, contact_id), contacts (contact_id, name, is_owner, deceased).
    """
    who = participants.distinct().join(contacts.filter(~F.col("is_owner")), "contact_id")
    names = who.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contact_id", F.coalesce("name", F.lit("Unknown")).alias("name")))), lambda x: x["name"]), ", ").alias("names"), F.max(F.coalesce("deceased", F.lit(False))).alias("grieving"))
    spans = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.max("ms").alias("last_ms"))
    return spans.join(names, "thread_id", "left").select("thread_id", F.coalesce("names", F.lit("Unknown")).alias("names"), "n", "last_ms", F.coalesce("grieving", F.lit(False)).alias("grieving"))


def diagnostics(messages: DataFrame) -> DataFrame:
    """(what, value, n): counts of messages by direction, kind of source and year, and of reactions and empty bodies: one pass."""
    empty = F.when(F.trim(F.coalesce("body", F.lit(""))) == "", "yes").otherwise("no")
    year = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ms") / 86_400_000).cast("int")), "yyyy")
    facts = {"direction": F.col("direction"), "reaction": F.when(F.col("is_reaction"), "yes").otherwise("no"), "empty": empty, "year": year}
    if "source_kind" in messages.columns:
        facts["source"] = F.coalesce("source_kind", F.lit("unknown"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in facts.items()]))
    return messages.select(each.alias("f")).groupBy("f.what", "f.value").agg(F.count(F.lit(1)).alias("n"))


def thresholds(labelled: DataFrame, score: str, label: str, cuts: list[float]) -> DataFrame:
    """(cut, tp, fp, fn, f1) of score >= cut for each cut."""
    rows = labelled.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts])))
    yes, real = F.col(score) >= F.col("cut"), F.col(label) == 1
    counts = rows.groupBy("cut").agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"))
    return counts.withColumn("f1", rounded(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))))


def related_threads(members: DataFrame, thread: str, member: str, owner: str | int | None = None) -> DataFrame:
    """(thread, related): how many other threads share a member with each, the owner left out.

    Pairs of threads are made per member, so the owner, who is in all of them, has to be named; a member of very many
    threads costs the square of their number.
    """
    own = members.select(F.col(thread).alias("a"), F.col(member).alias("m")).distinct()
    own = own if owner is None else own.filter(F.col("m") != owner)
    return own.join(own.select(F.col("a").alias("b"), "m"), "m").filter("a <> b").groupBy(F.col("a").alias(thread)).agg(F.countDistinct("b").alias("related"))
