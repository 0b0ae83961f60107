"""One way in for all exports: a file's kind by its content, its rows as records, and what it is known by."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import normalize as N
from threadloom.operators.load import load
from threadloom.sources import exports, phone
from threadloom.sources.versions import Store

#: Bytes of a file's head that its kind is told by.
HEAD = 4096
_ADDRESSES = "array<struct<raw: string, role: string>>"
_CHAT = re.compile("^[\u200e\ufeff]*(?:\\[[^\\]\\n]{6,40}\\] |\\d{1,4}[/.-]\\d{1,2}[/.-]\\d{1,4},? [^\\n]{3,20} - )", re.MULTILINE)


class Refused(ValueError):
    """A file that can't be loaded as it is; the message says why."""


def head(spark: SparkSession, path: str) -> bytes:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(HEAD))
    finally:
        stream.close()


def kind_of(first: bytes) -> str:
    """Which reader a file's first bytes ask for: phone, chat, backup, json, lines or rows; the name has no say."""
    if first.startswith(b"SQLite format 3\0"):
        return "phone"
    if first.startswith(b"PK\x03\x04"):
        return "chat"
    text = first.decode("utf-8", "ignore").lstrip("\ufeff \t\r\n")
    if re.match(r"<\?xml|<smses|<sms\b|<mms\b|<!--", text):
        return "backup"
    if text.startswith("["):
        return "chat" if _CHAT.match(text) else "json"
    if text.startswith("{"):
        line = text.split("\n", 1)[0].rstrip()
        return "lines" if line.endswith("}") else "json"
    if _CHAT.search(text):
        return "chat"
    if "," in text.split("\n", 1)[0] or "\t" in text.split("\n", 1)[0]:
        return "rows"
    raise Refused("no reader knows this content")


def _known(rows: DataFrame, owner: str) -> DataFrame:
    """Records of rows (ms, direction, correspondent, body) whose other side is one person; the owner goes by name."""
    them, me = F.struct(F.col("correspondent").alias("raw"), F.when(F.col("direction") == "outgoing", "to").otherwise("from").alias("role")), F.struct(F.lit(owner).alias("raw"), F.when(F.col("direction") == "outgoing", "from").otherwise("to").alias("role"))
    return rows.select(F.monotonically_increasing_id().alias("id"), "ms", "direction", F.array(them, me).cast(_ADDRESSES).alias("addresses"), F.lit(None).cast("string").alias("contact_name"), "body", N.language(F.col("body")).alias("lang"))


def records(spark: SparkSession, path: str, owner: str | None = None, conversation: str | None = None) -> DataFrame:
    """A file's messages as records: id, ms, direction, addresses, contact_name, body, lang; rows without a time are left out.

    Chats and plain rows need the owner's name; those of several others are refused, as are phone databases of several
    conversations without a choice. A file is one conversation, but for backups.
    """
    first = head(spark, path)
    kind = kind_of(first)
    if kind == "backup":
        rows = exports.backup(spark, path)
        return rows.filter("ms > 0").select(F.monotonically_increasing_id().alias("id"), "ms", "direction", "addresses", "contact_name", "body", "lang")
    if kind == "phone":
        rows = phone.messages(spark, [path], conversation).filter("ms is not null")
        groups = rows.agg(F.max("is_group")).first()[0]
        if groups is None or groups:
            raise Refused("a conversation has to be chosen" if groups is None else "a conversation of several people")
        return _known(rows.withColumn("correspondent", F.col("identifier")), owner or "me")
    if kind == "chat":
        if owner is None:
            raise Refused("whose chat is it: the owner's name is needed")
        rows = exports.chat_messages(exports.chat_text(spark, path, first.startswith(b"PK")), owner)
        if reason := rows.agg(F.max("problem")).first()[0]:
            raise Refused(reason)
        return _known(rows.filter("ms is not null"), owner)
    rows = exports.plain_rows(spark, path, owner, kind)
    good = exports.with_correspondent(rows, fingerprint(spark, path)).filter("problem is null")
    return _known(good, owner or "me")


def fingerprint(spark: SparkSession, path: str) -> str:
    """What a file's content is known by, whatever its size: SHA-256 of its lines' number, lengths and hashes, which are summed in each block."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value")
    sums = lines.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value").cast("long")).alias("size"), *[F.sum(F.xxhash64("value", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(3)])
    return sums.select(F.sha2(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sums.columns]), 256)).first()[0]


def import_file(store: Store, path: str, owner: str | None = None, conversation: str | None = None) -> Store:
    """The store with a file of any kind loaded; the same store where its content was read before, whatever its name."""
    spark, known = store.spark, fingerprint(store.spark, path)
    files = store.read("files")
    if files is not None and files.filter(F.col("sha256") == known).limit(1).count():
        return store
    return load(store, records(spark, path, owner, conversation), path, known, native=None)
