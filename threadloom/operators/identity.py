"""People over several imports: identifiers, owner, senders, merged contacts, and refreshes that keep what the owner wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.threads import _addressed, owner_key, participant_key


def identifier_rows(messages: DataFrame) -> DataFrame:
    """(raw, key, kind, first_ms, last_ms): a row for each spelling of an address."""
    from threadloom.functions.normalize import address_kind

    return _addressed(messages).groupBy("raw").agg(F.min("key").alias("key"), F.min(address_kind(F.col("raw"))).alias("kind"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def owner_by_company(messages: DataFrame) -> DataFrame:
    """(key): the address met with the most others, at least two and more than any other address; no row where there's a tie."""
    keys = _addressed(messages).groupBy("id").agg(F.collect_set("key").alias("keys")).filter(F.size("keys") > 1)
    pairs = keys.select(F.explode("keys").alias("key"), "keys").select("key", F.explode("keys").alias("other")).filter("key <> other")
    degrees = pairs.groupBy("key").agg(F.countDistinct("other").alias("n"))
    # The two largest degrees in one aggregate: a key is the owner only if it alone has the largest.
    best = degrees.agg(F.max(F.struct("n", "key")).alias("b"), F.max("n").alias("n"))
    alone = degrees.join(F.broadcast(best), "n").agg(F.count(F.lit(1)).alias("ties"), F.max("b").alias("b")).filter("ties = 1 and b.n >= 2")  # best is one row
    return alone.select(F.col("b.key").alias("key"))


def find_owner(messages: DataFrame) -> DataFrame:
    """(key): by role where that says one, else by company."""
    told = owner_key(messages)
    return told.unionByName(owner_by_company(messages).join(told.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"), how="inner").select("key"))


def with_senders(messages: DataFrame, owner: DataFrame) -> DataFrame:
    """messages with sender and recipients: the owner sends what goes out, the `from` address (or the only other one) what comes in; recipients are distinct (key, role)."""
    from threadloom.functions.normalize import address_key

    mine = owner.agg(F.max("key").alias("_owner"))
    m = messages.join(F.broadcast(mine)).withColumn("_a", F.filter(F.transform("addresses", lambda a: F.struct(address_key(a["raw"]).alias("key"), a["role"].alias("role"))), lambda a: a["key"].isNotNull()))
    first = F.get(F.filter("_a", lambda a: a["role"] == "from"), F.lit(0))["key"]
    others = F.array_distinct(F.transform(F.filter("_a", lambda a: ~a["key"].eqNullSafe(F.col("_owner"))), lambda a: a["key"]))
    sender = F.when(F.col("direction").isin("outgoing", "draft"), F.coalesce("_owner", first)).otherwise(F.coalesce(first, F.when(F.size(others) == 1, others[0])))
    return m.select(*messages.columns, sender.alias("sender"), F.array_distinct(F.filter("_a", lambda a: a["role"] != "from")).alias("recipients"))


def senders(messages: DataFrame, owner: DataFrame) -> DataFrame:
    """(id, sender, recipients) by `with_senders`."""
    return with_senders(messages, owner).select("id", "sender", "recipients")


def merge_contacts(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """(contact, contact_id): the stored contact each arrived one is, by its identifiers in order; null for new people.

    arrived has contact, nth, raw, e164; stored has contact_id, raw, e164. An identifier's spelling decides first, then
    its number (the smallest contact that has it). Names never decide.
    """
    by_raw = stored.groupBy("raw").agg(F.min("contact_id").alias("_raw_id"))
    by_number = stored.filter("e164 is not null").groupBy("e164").agg(F.min("contact_id").alias("_number_id"))
    hit = F.coalesce("_raw_id", "_number_id")
    rows = arrived.join(by_raw, "raw", "left").join(by_number, "e164", "left")
    return rows.groupBy("contact").agg(F.min_by(hit, F.when(hit.isNotNull(), F.col("nth"))).alias("contact_id"))


def filled_contacts(stored: DataFrame, arrived: DataFrame, merged: DataFrame) -> DataFrame:
    """stored contacts (contact_id, name, e164, is_owner) with what they lacked filled in, and the new ones; there is one owner at most, the stored one first.

    A new contact's id is a hash of the key it arrived under, so that importing it again gives the same id.
    """
    known = arrived.join(merged, "contact")
    fill = known.filter("contact_id is not null").groupBy("contact_id").agg(F.min("name").alias("_name"), F.min("e164").alias("_e164"))
    old = stored.join(fill, "contact_id", "left").select("contact_id", F.coalesce("name", "_name").alias("name"), F.coalesce("e164", "_e164").alias("e164"), "is_owner")
    new = known.filter("contact_id is null").select(F.xxhash64("contact").alias("contact_id"), "name", "e164", "is_owner").dropDuplicates(["contact_id"])
    both = old.withColumn("_old", F.lit(0)).unionByName(new.withColumn("_old", F.lit(1)))
    first = both.filter("is_owner").agg(F.min(F.struct("_old", "contact_id"))["contact_id"].alias("_owner"))
    return both.join(F.broadcast(first)).select("contact_id", "name", "e164", F.col("contact_id").eqNullSafe(F.col("_owner")).alias("is_owner"))  # first is one row


def owner_keys(contacts: DataFrame, identifiers: DataFrame, chosen: int | None = None) -> DataFrame:
    """(key): the keys of one owner: the chosen contact if it's flagged, else the smallest that is."""
    flagged = contacts.filter("is_owner").agg(F.coalesce(F.max(F.when(F.col("contact_id") == F.lit(chosen), F.col("contact_id"))), F.min("contact_id")).alias("contact_id"))
    return identifiers.join(F.broadcast(flagged), "contact_id").select(F.coalesce("e164", "raw").alias("key")).distinct()


def repaired_threads(threads: DataFrame, owner: DataFrame) -> DataFrame:
    """threads (thread_id, keys, signature) with the signature they have without the owner; those whose new one is taken keep the old."""
    mine = owner.agg(F.collect_set("key").alias("_owner"))  # one person's keys
    rest = F.array_except("keys", "_owner")
    t = threads.join(F.broadcast(mine)).withColumn("_new", F.when(F.size(rest) > 0, F.sha2(participant_key(rest), 256)).otherwise(F.col("signature")))
    claims = t.groupBy("_new").agg(F.min("thread_id").alias("_first"))
    held = threads.select(F.col("signature").alias("_new"), F.lit(True).alias("_held"))
    free = F.col("_held").isNull() & (F.col("thread_id") == F.col("_first"))
    out = t.join(claims, "_new").join(held, "_new", "left").withColumn("changed", F.coalesce(free, F.lit(False)))
    return out.select("thread_id", F.when(F.col("changed"), F.col("_new")).otherwise(F.col("signature")).alias("signature"), "changed")


def refresh_episodes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh episodes with the stored narratives, and a status: inserted, updated (its figures changed), kept or removed. The key is (thread_id, start_id)."""
    keys = ["thread_id", "start_id"]
    figures = [c for c in fresh.columns if c not in keys]
    old = stored.select(*keys, F.struct(*figures).alias("_old"), "narrative", F.lit(True).alias("_was"))
    new = fresh.select(*keys, F.struct(*figures).alias("_new"), F.lit(True).alias("_is"))
    both = new.join(old, keys, "full")
    status = F.when(F.col("_was").isNull(), "inserted").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "kept").otherwise("updated")
    return both.withColumn("status", status).select(*keys, F.coalesce("_new", "_old").alias("_f"), "narrative", "status").select(*keys, "_f.*", "narrative", "status")


def refresh_eras(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh eras with the names and summaries that stored ones of the same thread and start had."""
    return fresh.join(stored.select("thread_id", "start_ms", "name", "summary"), ["thread_id", "start_ms"], "left")


def replace_rows(rows: DataFrame, path: str, by: str) -> None:
    """Write rows as Parquet in folders by one column; only the folders that rows touch are replaced."""
    rows.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def unread_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, sha256, size): files (binaryFile rows) whose content no import has read yet; equal ones count once, the first by path."""
    hashed = files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    new = hashed.join(stored.select("sha256").distinct(), "sha256", "left_anti")
    return new.groupBy("sha256").agg(F.min("file").alias("file"), F.min("size").alias("size")).select("file", "sha256", "size")


def import_counts(arrived: DataFrame, stored: DataFrame, by: str = "source_file") -> DataFrame:
    """(by, records, new, known): of messages with dedup_key, how many a file adds. A key that several files bring counts for the first of them."""
    firsts = arrived.groupBy("dedup_key").agg(F.min(by).alias(by)).join(stored.select("dedup_key").distinct(), "dedup_key", "left_anti")
    new = firsts.groupBy(by).agg(F.count(F.lit(1)).alias("new"))
    total = arrived.groupBy(by).agg(F.count(F.lit(1)).alias("records"))
    return total.join(new, by, "left").na.fill(0, ["new"]).withColumn("known", F.col("records") - F.col("new"))


def supported_claims(claims: DataFrame, messages: DataFrame, ids: str = "evidence_ids") -> DataFrame:
    """claims with only the evidence that exists in messages; those left without any are dropped. claims have claim_id."""
    each = claims.select("claim_id", F.posexplode(ids).alias("_pos", "id"))
    real = each.join(messages.select("id").distinct(), "id", "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "id")))["id"].alias("_kept"))
    return claims.join(real, "claim_id").withColumn(ids, F.col("_kept")).drop("_kept")
