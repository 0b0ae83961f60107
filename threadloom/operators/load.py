"""Loading imported records into the stored people, threads and messages, as one commit.

A load finds or makes contacts, names the owner, assigns threads, keeps messages that aren't stored yet, refreshes the
threads' spans and counts, and writes it all as one version of a store. A file that was read before changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import normalize as N
from threadloom.operators import identity, threads
from threadloom.sources.versions import Store
from threadloom.sources.work import kept

STORED = ["dedup_key", "thread_key", "ms", "direction", "sender", "body", "lang", "source_file"]


def _people(store: Store, records: DataFrame, owner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contacts (contact_id, name, e164, is_owner), identifiers (raw, contact_id, e164, kind, first_ms, last_ms)) with those of records."""
    spellings = identity.identifier_rows(records).withColumn("e164", N.e164(F.col("raw")))
    mine = owner.select(F.col("key"), F.lit(True).alias("is_owner"))
    names = threads.contacts(records).select("key", "name").join(mine, "key", "left").na.fill(False, ["is_owner"])
    arrived = kept(spellings.join(names, "key").select(F.col("key").alias("contact"), F.dense_rank().over(_by_spelling()).alias("nth"), "raw", "e164", "name", "is_owner", "kind", "first_ms", "last_ms"))
    none = arrived.limit(0)
    contacts, known = store.read("contacts"), store.read("identifiers")
    contacts = none.select(F.lit(0).cast("long").alias("contact_id"), "name", "e164", "is_owner") if contacts is None else contacts
    known = none.select("raw", F.lit(0).cast("long").alias("contact_id"), "e164", "kind", "first_ms", "last_ms") if known is None else known
    merged = kept(identity.merge_contacts(arrived, known.select("contact_id", "raw", "e164")))
    one = arrived.groupBy("contact").agg(F.min("name").alias("name"), F.min("e164").alias("e164"), F.max("is_owner").alias("is_owner"))
    filled = identity.filled_contacts(contacts, one, merged)
    own = arrived.join(merged, "contact").select("raw", F.coalesce("contact_id", F.xxhash64("contact")).alias("contact_id"), "e164", "kind", "first_ms", "last_ms")
    both = known.unionByName(own).groupBy("raw").agg(F.min_by("contact_id", F.struct("first_ms", "contact_id")).alias("contact_id"), F.min("e164").alias("e164"), F.min("kind").alias("kind"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    return filled, both


def _by_spelling():
    from pyspark.sql import Window

    return Window.partitionBy("key").orderBy("raw")


def thread_rows(messages: DataFrame) -> DataFrame:
    """(thread_key, n, first_ms, last_ms, lang, languages): each thread's span, its primary language and how often each language occurs, most frequent first."""
    counts = messages.groupBy("thread_key", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    known = F.array_sort(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct((-F.col("n")).alias("less"), "lang"))))
    spans = counts.groupBy("thread_key").agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), known.alias("l"))
    told = F.array_join(F.transform("l", lambda x: F.concat(x["lang"], F.lit(":"), -x["less"])), ",")
    return spans.select("thread_key", "n", "first_ms", "last_ms", F.get("l", F.lit(0))["lang"].alias("lang"), told.alias("languages"))


def load(store: Store, records: DataFrame, source: str, sha256: str, native: str | None = "id") -> Store:
    """The store with a file's records loaded: one new version, or the same store where a file of that content was read before.

    records have id, ms, direction, addresses (array of (raw, role)), contact_name, body, and may have lang. Messages
    are known by dedup_key; of equal ones the first by id is kept. A killed load leaves the version before.
    """
    files = store.read("files")
    if files is not None and files.filter(F.col("sha256") == sha256).limit(1).count():
        return store
    rows = kept(records if "lang" in records.columns else records.withColumn("lang", N.language(F.col("body"))))
    owner = kept(threads.owner_key(rows))
    if owner.isEmpty():  # as find_owner, which would look at the company in any case
        owner = kept(identity.owner_by_company(rows))
    contacts, identifiers = _people(store, rows, owner)
    own = rows.filter("id is not null")
    assigned = threads.assign_threads(identity.with_senders(own, owner), owner)
    arrived = threads.dedup_keys(assigned, "thread_key", native=native).withColumn("source_file", F.lit(source)).select(*STORED, "id")
    stored = store.read("messages")
    # What is new is written once, as the store's own rows; counts and threads are taken from there.
    fresh = store.stage("messages", threads.new_messages(arrived, arrived.limit(0) if stored is None else stored).select(*STORED))
    every = store.staged(fresh) if stored is None else stored.unionByName(store.staged(fresh))
    n, new = own.count(), store.staged(fresh).count()
    log = store.spark.createDataFrame([(source, sha256, n, new, n - new)], "source_file string, sha256 string, records long, new long, known long")
    return store.commit(replace={"contacts": contacts, "identifiers": identifiers, "threads": thread_rows(every)}, append={"messages": fresh, "files": log})
