"""Adapters that read the driver's tables as messages.

A message has thread_id, id, ms (epoch milliseconds, UTC), direction (outgoing, incoming, draft, other), is_reaction,
body, tension (0-3) and warmth. Timestamps without zone are taken as UTC whatever the session's zone is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.work import shared_dir

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, floored."""
    return F.expr(f"datediff(to_date({ts}), date'1970-01-01') * 86400000L + hour({ts}) * 3600000L + minute({ts}) * 60000L + cast(floor(extract(second from {ts}) * 1000) as long)")


def day_of(ms: Column | str = "ms") -> Column:
    return F.floor(F.col(ms) / DAY_MS if isinstance(ms, str) else ms / DAY_MS)


def date_of(ms: str = "ms") -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_of(ms).cast("int"))


def events_messages(spark: SparkSession, folder: str) -> DataFrame:
    """A thread for each user of the event stream."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("thread_id"), F.col("event_id").alias("id"), epoch_ms("ts").alias("ms"),
        F.when(kind.isin("click", "purchase"), "outgoing").when(kind == "signup", "draft").otherwise("incoming").alias("direction"),
        ((kind == "error") & (F.col("event_id") % 2 == 0)).alias("is_reaction"),
        F.col("props").alias("body"),
        F.when(F.col("value") >= 100, 3).when(F.col("value") >= 50, 2).when(F.col("value") >= 20, 1).otherwise(0).alias("tension"),
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("warmth"),
    )


def orders_messages(spark: SparkSession, folder: str) -> DataFrame:
    """A thread for each nation's orders; many share a day, so that ties in time are common."""
    rank = F.substring("o_orderpriority", 1, 1)
    return table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("long").alias("thread_id"), F.col("o_orderkey").alias("id"), epoch_ms("o_orderdate").alias("ms"),
        F.when(F.col("o_orderkey") % 2 == 0, "outgoing").otherwise("incoming").alias("direction"),
        (F.col("o_orderkey") % 11 == 0).alias("is_reaction"), F.col("o_orderpriority").alias("body"),
        F.when(rank == "1", 3).when(rank == "2", 2).when(rank == "3", 1).otherwise(0).alias("tension"),
        F.when(F.col("o_totalprice") >= 250_000, 2).otherwise(0).alias("warmth"),
        F.col("o_orderstatus").alias("source_kind"), (F.col("o_custkey") % 5).alias("source_file"), F.when(F.col("o_orderkey") % 3 == 0, "fr").when(F.col("o_orderkey") % 3 == 1, "en").alias("lang"),
    )


def uneven_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The orders' messages with the faults that archives have: months missing or thin, a thin tail, attachments that stop, one side nearly silent, a language for each half of the threads."""
    t, k, ms = F.col("thread_id"), F.col("id"), F.col("ms")
    holes = F.floor(ms / (40 * DAY_MS)) * (t % 4) * (35 * DAY_MS)
    crowded = F.when((t % 8 == 4) & (t > 4) & (k % 30 != 0), ms - ms % (60 * DAY_MS)).otherwise(ms)
    tail = F.when((t % 6 == 2) & (k % 50 == 0), F.lit(900 * DAY_MS)).otherwise(F.lit(0))
    return orders_messages(spark, folder).withColumns({
        "ms": (crowded + holes + tail).cast("long"), "direction": F.when((t % 7 == 3) & (k % 20 != 0), "incoming").otherwise(F.col("direction")), "lang": F.when((t % 2 == 0) & (k % 3 != 0), "fr").otherwise(F.col("lang")),
        "imported_ms": (ms + F.when(t % 3 == 0, F.lit(4000 * DAY_MS)).otherwise(F.lit(0))).cast("long"),
    })


def orders_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Attachments of the orders' messages: line items of small quantity; those of one piece are layouts."""
    return table(spark, folder, "lineitem").filter("l_quantity <= 4").select(F.col("l_orderkey").alias("message_id"), (F.col("l_quantity") == 1).alias("is_smil"))


def events_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of a reader that scored the event stream in windows of 40 messages, of which the first six are read with the window before too: some windows refused, some failed, some ids unreadable."""
    m, w = events_messages(spark, folder), F.floor(F.col("id") / 40)
    score = lambda tension: F.struct(F.concat(F.when(F.col("id") % 97 == 0, "x").otherwise("m"), F.col("id").cast("string")).alias("message_id"), ((F.col("id") % 21 - 10) / 10.0).alias("valence"), F.col("warmth").cast("double").alias("warmth"), tension.cast("double").alias("tension"))
    own = m.select("thread_id", w.alias("window"), score(F.col("tension")).alias("m"))
    again = m.filter("id % 40 < 6 and id >= 40").select("thread_id", (w - 1).alias("window"), score(F.least(F.lit(3), F.col("tension") + 1)).alias("m"))
    status = F.when((F.col("thread_id") + F.col("window")) % 17 == 0, "refused").when((F.col("thread_id") + F.col("window")) % 19 == 0, "error").otherwise("done")
    return own.unionByName(again).groupBy("thread_id", "window").agg(F.collect_list("m").alias("messages")).select("thread_id", "window", status.alias("status"), "messages")


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """A thread for each conversation, a turn a minute."""
    role = F.col("role")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("thread_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") * 60_000).alias("ms"),
        F.when(role == "user", "outgoing").when(role == "assistant", "incoming").otherwise("other").alias("direction"),
        F.lit(False).alias("is_reaction"), F.col("text").alias("body"), F.lit(0).alias("tension"), F.lit(0).alias("warmth"),
    )


#: The same adapters in DuckDB's SQL, as common table expressions.
SQL = {
    "events": """msgs as (select user_id as thread_id, event_id as id, epoch_us(ts) // 1000 as ms,
        case when event_type in ('click', 'purchase') then 'outgoing' when event_type = 'signup' then 'draft' else 'incoming' end as direction,
        event_type = 'error' and event_id % 2 = 0 as is_reaction, props as body,
        case when value >= 100 then 3 when value >= 50 then 2 when value >= 20 then 1 else 0 end as tension,
        cast(json_extract_string(props, '$.k') as int) % 4 as warmth from events)""",
    "orders": """msgs as (select cast(c_nationkey as bigint) as thread_id, o_orderkey as id, epoch_us(o_orderdate) // 1000 as ms,
        case when o_orderkey % 2 = 0 then 'outgoing' else 'incoming' end as direction, o_orderkey % 11 = 0 as is_reaction, o_orderpriority as body,
        case substr(o_orderpriority, 1, 1) when '1' then 3 when '2' then 2 when '3' then 1 else 0 end as tension,
        case when o_totalprice >= 250000 then 2 else 0 end as warmth, o_orderstatus as source_kind, o_custkey % 5 as source_file,
        case o_orderkey % 3 when 0 then 'fr' when 1 then 'en' end as lang
        from orders join customer on o_custkey = c_custkey)""",
    "uneven": """om as (select cast(c_nationkey as bigint) as thread_id, o_orderkey as id, epoch_us(o_orderdate) // 1000 as ms,
        case when o_orderkey % 2 = 0 then 'outgoing' else 'incoming' end as direction, o_orderkey % 11 = 0 as is_reaction, o_orderpriority as body,
        case substr(o_orderpriority, 1, 1) when '1' then 3 when '2' then 2 when '3' then 1 else 0 end as tension,
        case when o_totalprice >= 250000 then 2 else 0 end as warmth, o_orderstatus as source_kind, o_custkey % 5 as source_file,
        case o_orderkey % 3 when 0 then 'fr' when 1 then 'en' end as lang from orders join customer on o_custkey = c_custkey),
        msgs as (select * replace (case when thread_id % 8 = 4 and thread_id > 4 and id % 30 <> 0 then ms - ms % 5184000000 else ms end + (ms // 3456000000) * (thread_id % 4) * 3024000000 + case when thread_id % 6 = 2 and id % 50 = 0 then 77760000000 else 0 end as ms,
        case when thread_id % 7 = 3 and id % 20 <> 0 then 'incoming' else direction end as direction, case when thread_id % 2 = 0 and id % 3 <> 0 then 'fr' else lang end as lang),
        ms + case when thread_id % 3 = 0 then 345600000000 else 0 end as imported_ms from om)""",
    "conversations": """msgs as (select conv_id as thread_id, conv_id * 1000 + turn as id, turn * 60000 as ms,
        case role when 'user' then 'outgoing' when 'assistant' then 'incoming' else 'other' end as direction, false as is_reaction,
        text as body, 0 as tension, 0 as warmth from conversations)""",
}
