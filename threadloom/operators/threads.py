"""Who takes part, which thread a message belongs to, and which messages are the same one.

Messages have id, ms, direction and addresses (array of (raw, role)), as the readers of exports give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import normalize as N


def _addressed(messages: DataFrame) -> DataFrame:
    a = messages.withColumn("address", F.explode("addresses"))
    return a.withColumn("raw", F.col("address.raw")).withColumn("role", F.col("address.role")).withColumn("key", N.address_key(F.col("address.raw"))).filter("key is not null")


def contacts(messages: DataFrame) -> DataFrame:
    """(key, kind, first_ms, last_ms, name): a row per address; the name is the latest that a message with no other address gave."""
    named = F.when((F.size("addresses") == 1) & F.col("contact_name").isNotNull() & (F.col("contact_name") != "(Unknown)"), F.struct("ms", "id", "contact_name"))
    return _addressed(messages).groupBy("key").agg(
        F.min(N.address_kind(F.col("raw"))).alias("kind"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.max(named)["contact_name"].alias("name")
    )


def owner_key(messages: DataFrame) -> DataFrame:
    """(key): the owner's address, or no row. The sender of what went out and the only receiver of what came in are evidence; it must agree."""
    a = _addressed(messages)
    sent = a.filter("direction = 'outgoing' and role = 'from'").select("key")
    got = a.filter("direction = 'incoming' and role = 'to'").groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("other")).filter("key = other").select("key")
    return sent.union(got).agg(F.min("key").alias("key"), F.max("key").alias("other")).filter("key = other").select("key")


def participant_key(keys: Column) -> Column:
    """One unambiguous text for a set of address keys."""
    return F.to_json(F.array_sort(F.transform(F.array_distinct(keys), lambda k: F.to_json(F.array(F.lit("member"), k)))))


def assign_threads(messages: DataFrame, owner: DataFrame) -> DataFrame:
    """messages with thread_key and is_group: the set of those besides the owner; a note to oneself is a thread of its own."""
    mine = owner.agg(F.max("key").alias("_owner"))
    keys = F.array_compact(F.transform("addresses", lambda a: N.address_key(a["raw"])))
    others = F.filter(F.col("_keys"), lambda k: ~k.eqNullSafe(F.col("_owner")))
    alone = F.to_json(F.array(F.to_json(F.array(F.lit("self"), F.coalesce("_owner", F.lit(""))))))
    m = messages.withColumn("_keys", keys).join(F.broadcast(mine)).withColumn("_others", others)  # the owner is one row
    m = m.withColumn("thread_key", F.sha2(F.when(F.size("_others") > 0, participant_key(F.col("_others"))).otherwise(alone), 256))
    return m.withColumn("is_group", F.size(F.array_distinct("_others")) > 1).drop("_keys", "_owner", "_others")


def primary_language(rows: DataFrame, by: str, lang: str = "lang") -> DataFrame:
    """(by, lang, n): the most frequent language of each group; ties go to the smaller code."""
    counts = rows.filter(F.col(lang).isNotNull()).groupBy(by, lang).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(lang).alias("lang"))).alias("b"))
    return best.select(by, "b.lang", (-F.col("b.m")).alias("n"))


def dedup_keys(messages: DataFrame, counterpart: str, body: str = "body", native: str | None = None, digest: str | None = None) -> DataFrame:
    """messages with occurrence and dedup_key: two records are one message if their keys are equal, whatever file they came from.

    Records of one counterpart, direction, minute and body are numbered by (time, identity); records with the same
    native id at one instant, or without one at the same instant with the same digest, share a number.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    identity = F.when(text(native) != "", F.concat(F.lit("id:"), text(native))).otherwise(F.concat_ws(":", F.lit("ms"), F.col("ms"), text(digest)))
    group = ["_counterpart", "direction", "_minute", "_body"]
    m = messages.withColumn("_counterpart", text(counterpart)).withColumn("_minute", N.minute_bucket(F.col("ms"))).withColumn("_body", F.sha2(N.canonical_body(F.col(body)), 256)).withColumn("_identity", identity)
    # One pass over the bodies: they are known by their hash, and identities in order by the rank of (ms, identity).
    group = Window.partitionBy(*group).orderBy("ms", "_identity")
    found = m.withColumn("occurrence", (F.dense_rank().over(group) - 1).cast("int"))
    key = F.concat_ws("|", F.to_json(F.array("_counterpart", "direction")), "_minute", "_body", "occurrence")
    return found.withColumn("dedup_key", F.sha2(key, 256)).drop("_counterpart", "_minute", "_body", "_identity")


def new_messages(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """Of arrived messages, for each dedup_key that isn't stored yet the first: the one of the smallest id."""
    nth = F.row_number().over(Window.partitionBy("dedup_key").orderBy(F.col("id").asc_nulls_last()))
    first = arrived.withColumn("_nth", nth).filter("_nth = 1")
    return first.join(stored.select("dedup_key"), "dedup_key", "left_anti").select(*arrived.columns)
