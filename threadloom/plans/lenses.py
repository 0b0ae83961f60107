"""Queries of scores, ordinary language, archive health, findings, power and people, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import normalize
from threadloom.operators import ambient, conflict, findings, gate, health, identity, load, metrics, scores, search, threads, valence, windows
from threadloom.operators.ordered import rounded, runs_of_days
from threadloom.plans.registry import DAY, MONTH, ORACLE_SQL, SPOKEN, SUBSTANTIVE, answers_sql, episodes_sql, query
from threadloom.sources import exports
from threadloom.sources.tables import conversation_messages, epoch_ms, events_messages, events_results, orders_attachments, orders_messages, scratch, table, uneven_messages
from threadloom.sources.versions import Store
from threadloom.sources.work import kept

# ---- scores ----

SCORED = """sc as (select thread_id, id, id // 40 as win, (id % 21 - 10) / 10.0 as valence, warmth, tension from msgs
  union all select thread_id, id, id // 40 - 1, (id % 21 - 10) / 10.0, warmth, least(3, tension + 1) from msgs where id % 40 < 6 and id >= 40),
scores as (select thread_id, id, avg(valence) as valence, avg(warmth) as warmth, avg(tension) as tension from sc
  where (thread_id + win) % 17 <> 0 and (thread_id + win) % 19 <> 0 and id % 97 <> 0 group by 1, 2)"""


@query(f"{SCORED} select thread_id, id, round(valence, 6)::double as valence, round(warmth, 6) as warmth, round(tension, 6) as tension from scores", "events")
def message_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = scores.message_scores(events_results(spark, folder))
    return found.select("thread_id", "id", *[rounded(F.col(c)).alias(c) for c in ("valence", "warmth", "tension")])


_SIDE = lambda c, side, name: f"round(coalesce(avg({c}) filter ({side}), 0), 6)::double as {c}_{name}"
_EMOTION = f"""{SCORED}, j as (select s.*, direction in ('outgoing', 'draft') as me, epoch_ms(make_timestamptz(m.ms * 1000) at time zone 'America/New_York') // 86400000 as day from scores s join msgs m using (thread_id, id)),
em as (select thread_id, day, count(*) as n, round(avg(warmth), 6) as warmth, round(avg(tension), 6) as tension, round(avg(valence), 6)::double as valence, round(avg(warmth) / 3, 6) as warmth01, round(avg(tension) / 3, 6) as tension01,
  {', '.join(f"count(*) filter ({s}) as n_{n}, " + ', '.join(_SIDE(c, s, n) for c in ('warmth', 'tension', 'valence')) for n, s in (('me', 'me'), ('them', 'not me')))} from j group by 1, 2)"""


@query(_EMOTION.replace("make_timestamptz(m.ms * 1000)", "(make_timestamp(m.ms * 1000) at time zone 'UTC')") + " select * from em", "events")
def emotion_daily(spark: SparkSession, folder: str) -> DataFrame:
    return scores.emotion_daily(events_messages(spark, folder), scores.message_scores(events_results(spark, folder)), "America/New_York")


_COVERAGE = f"""{SCORED}, {SUBSTANTIVE}, e as (select thread_id, count(*) as eligible from sub group by 1), s as (select thread_id, count(*) as scored from scores group by 1),
w as (select thread_id, count(distinct win) filter ((thread_id + win) % 17 = 0) as refused, count(distinct win) filter ((thread_id + win) % 19 = 0 and (thread_id + win) % 17 <> 0) as errored from sc group by 1),
cv as (select thread_id, coalesce(eligible, 0) as eligible, coalesce(scored, 0) as scored, coalesce(scored / nullif(eligible, 0), 0) as c, coalesce(refused, 0) as refused, coalesce(errored, 0) as errored
  from (select distinct thread_id from msgs) left join e using (thread_id) left join s using (thread_id) left join w using (thread_id))"""


@query(_COVERAGE + " select thread_id, eligible, scored, round(c, 6) as coverage, floor(c * 100 + 0.5)::int as percent, refused, errored, c >= 0.95 as complete from cv", "events")
def emotion_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return scores.emotion_coverage(events_messages(spark, folder), events_results(spark, folder))


@query(_COVERAGE + " select thread_id, case when c >= 0.95 then 'model' else 'lexicon' end as layer, case when scored = 0 then 'unread' when c >= 0.95 then 'read' else 'partial' end as state from cv", "events")
def river_layers(spark: SparkSession, folder: str) -> DataFrame:
    return scores.river_layer(scores.emotion_coverage(events_messages(spark, folder), events_results(spark, folder)))


# ---- local clocks ----

_NY = "epoch_ms((make_timestamp(ms * 1000) at time zone 'UTC') at time zone 'America/New_York')"


@query(f"""{SPOKEN}, l as (select *, {_NY} as lms from spoken)
select thread_id, lms // 86400000 as day, count(*) as n, count(*) filter (direction = 'outgoing') as sent, count(*) filter (direction = 'incoming') as received,
  round(avg(warmth / 3.0), 6) as warmth, round(avg(tension / 3.0), 6) as tension from l group by 1, 2""", "events")
def daily_series_local(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.daily(events_messages(spark, folder), "America/New_York")


@query(f"""{SPOKEN}, l as (select *, {_NY} as lms from spoken),
c as (select thread_id, cast((lms // 86400000 + 4) % 7 as int) as dow, cast(lms % 86400000 // 3600000 as int) as hour, count(*) as n from l group by 1, 2, 3),
g as (select thread_id, cast(d.d as int) as dow, cast(h.h as int) as hour from (select distinct thread_id from spoken), range(7) d(d), range(24) h(h))
select thread_id, dow, hour, coalesce(n, 0) as n from g left join c using (thread_id, dow, hour)""", "events")
def hour_heatmap_local(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.heatmap(events_messages(spark, folder), "America/New_York")


@query(f"{SPOKEN} select thread_id, round(avg(case when lang is null or lang = 'en' then 1.0 else 0 end), 6) as share, avg(case when lang is null or lang = 'en' then 1.0 else 0 end) > 0.5 as available from spoken group by 1", "uneven")
def english_gate(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.english_gate(uneven_messages(spark, folder))


LEXICON = [("urgent", -2.5), ("high", -1.0), ("low", 1.5), ("not", 1.0), ("specified", 0.5)]
#: dy, the daily means: messages in English or of unknown language with a body are scored, 0 where no word is known.
SENTIMENT = f"""{SPOKEN}, lx(word, v) as (values {', '.join(f"('{w}', {v}::double)" for w, v in LEXICON)}),
t as (select *, coalesce(lang = 'en', true) as ok, ms // 86400000 as day from spoken),
w as (select thread_id, day, id, unnest(regexp_extract_all(lower(body), '[a-z][a-z'']*')) as word from t where ok),
k as (select thread_id, day, id, sum(v) as s from w join lx using (word) group by 1, 2, 3),
b as (select t.thread_id, t.day, t.id, s from t left join k on k.thread_id = t.thread_id and k.day = t.day and k.id = t.id where ok and regexp_matches(coalesce(body, ''), '\\S')),
c as (select *, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) as c from b),
m as (select thread_id, day, round(avg(c), 6) as sentiment, round(avg(greatest(0, c)), 6) as warmth, round(avg(greatest(0, -c)), 6) as tension, count(*) as scored from c group by 1, 2),
dy as (select thread_id, day, english_share, sentiment, coalesce(warmth, 0) as warmth, coalesce(tension, 0) as tension, coalesce(scored, 0) as scored
  from (select thread_id, day, round(avg(case when ok then 1.0 else 0 end), 6) as english_share from t group by 1, 2) left join m using (thread_id, day))"""


@query(SENTIMENT + " select * from dy", "orders")
def lexicon_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.sentiment(orders_messages(spark, folder), spark.createDataFrame(LEXICON, "word string, valence double"))


# ---- ordinary language; the clock is five hours behind ----

_AM = f"{SUBSTANTIVE}, am as (select *, ms - 18000000 as lms, date '1970-01-01' + ((ms - 18000000) // 86400000)::int as d from sub)"


@query(_AM + " select thread_id, year(d)::int as year, count(*) filter (me) as me, count(*) filter (not me) as them from am group by grouping sets ((thread_id, year(d)), (thread_id))", "events")
def ambient_volume(spark: SparkSession, folder: str) -> DataFrame:
    return ambient.volume(events_messages(spark, folder), -5)


@query(_AM + """, u as (select thread_id, me, 'hour' as kind, (lms % 86400000 // 3600000)::int as slot from am union all select thread_id, me, 'weekday', dayofweek(d)::int from am),
c as (select thread_id, kind, slot, count(*) filter (me) as me, count(*) filter (not me) as them from u group by 1, 2, 3),
g as (select thread_id, kind, slot::int as slot from (select distinct thread_id from am), (select 'hour' as kind, unnest(range(24)) as slot union all select 'weekday', unnest(range(7))))
select thread_id, kind, slot, coalesce(me, 0) as me, coalesce(them, 0) as them from g left join c using (thread_id, kind, slot)""", "events")
def ambient_rhythm(spark: SparkSession, folder: str) -> DataFrame:
    return ambient.rhythm(events_messages(spark, folder), -5)


@query(_AM + """, c as (select thread_id, d, count(*) as n from am group by 1, 2)
select thread_id, strftime(d, '%Y-%m-%d') as date, n from (select *, row_number() over (partition by thread_id order by n desc, d) as p from c) where p = 1""", "events")
def busiest_days(spark: SparkSession, folder: str) -> DataFrame:
    return ambient.busiest_day(events_messages(spark, folder), -5).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(_AM + """, x as (select distinct thread_id, (lms // 86400000) as day from am), i as (select *, day - lag(day) over w - 1 as silence, day - row_number() over w as island from x window w as (partition by thread_id order by day)),
r as (select thread_id, island, count(*) as length, max(silence) as silence from i group by 1, 2) select thread_id, max(length) as longest_streak, coalesce(max(silence), 0) as longest_silence from r group by 1""", "events")
def ambient_streaks(spark: SparkSession, folder: str) -> DataFrame:
    runs = runs_of_days(ambient.active_days(events_messages(spark, folder), -5))
    return runs.groupBy("thread_id").agg(F.max("length").alias("longest_streak"), F.coalesce(F.max("silence"), F.lit(0)).alias("longest_silence"))


@query(_AM + """, c as (select thread_id, strftime(d, '%Y-%m') as month, count(*) filter (me) as me, count(*) filter (not me) as them from am group by 1, 2),
r as (select *, row_number() over (partition by thread_id order by me + them desc, month) as p from c) select thread_id, month, me, them, case when p <= 6 then p end::int as place from r""", "orders")
def ambient_months(spark: SparkSession, folder: str) -> DataFrame:
    return ambient.months(orders_messages(spark, folder), -5)


@query(SUBSTANTIVE + """ select thread_id, me, count(*) as n, floor(avg(len(regexp_extract_all(lower(body), '[a-z'']{3,}'))) * 10 + 0.5) / 10 as words, floor(avg(case when contains(body, '?') then 100.0 else 0 end) * 10 + 0.5) / 10 as questions,
  count(*) filter (regexp_matches(body, '(?i)\\b(?:the|and)\\b')) as linking, count(*) filter (regexp_matches(body, '(?i)\\bof\\s+(?:the|to|and)\\b')) as of_it from sub group by 1, 2""", "conversations")
def ambient_language(spark: SparkSession, folder: str) -> DataFrame:
    return ambient.language(conversation_messages(spark, folder), {"linking": r"\b(?:the|and)\b", "of_it": r"\bof\s+(?:the|to|and)\b"})


@query(SUBSTANTIVE + """, w as (select *, len(regexp_extract_all(body, '\\S+')) as words from sub), r as (select *, row_number() over (partition by thread_id order by words desc, ms, id) as place from w)
select thread_id, place::int as place, id, me, words::int as words, left(trim(regexp_replace(body, '\\s+', ' ', 'g'), ' '), 120) as preview from r where place <= 5""", "conversations")
def longest_messages(spark: SparkSession, folder: str) -> DataFrame:
    return ambient.longest(conversation_messages(spark, folder))


@query(f"""with e as (select doc_id % 7 as thread_id, unnest(regexp_extract_all(text || ' 😀' || case when doc_id % 3 = 0 then ' 👨‍👩‍👧 🇩🇪🇫🇷 👍🏽' else '' end, '{ambient.EMOJI}')) as emoji from documents where trim(coalesce(text, ''), ' ') <> ''),
c as (select thread_id, emoji, count(*) as n from e group by 1, 2), r as (select *, row_number() over (partition by thread_id order by n desc, emoji) as place from c)
select thread_id, emoji, n, place::int as place from r where place <= 8""")
def top_emoji(spark: SparkSession, folder: str) -> DataFrame:
    more = F.when(F.col("doc_id") % 3 == 0, " 👨‍👩‍👧 🇩🇪🇫🇷 👍🏽").otherwise("")
    rows = table(spark, folder, "documents").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return ambient.top_emoji(rows.select((F.col("doc_id") % 7).alias("thread_id"), F.lit("outgoing").alias("direction"), F.lit(False).alias("is_reaction"), F.concat("text", F.lit(" 😀"), more).alias("body")), 8)


# ---- archive health ----

_HEALTH = f"""{SPOKEN}, att as (select l_orderkey as id, count(*) as att, count(*) filter (l_quantity = 1) as smil from lineitem where l_quantity <= 4 group by 1),
hm as (select s.*, case when s.thread_id % 5 = 1 and imported_ms > 850000000000 then 0 else coalesce(att, 0) end as att, case when s.thread_id % 5 = 1 and imported_ms > 850000000000 then 0 else coalesce(smil, 0) end as smil, direction in ('outgoing', 'draft') as me, date '1970-01-01' + ((ms + 7200000) // 86400000)::int as d from spoken s left join att using (id)),
r as (select thread_id, date_trunc('month', d)::date as m, count(*) as total, count(*) filter (me) as me, count(*) filter (att > 0) as wa, count(distinct d) as active_days, min(ms) as f, max(ms) as l from hm group by 1, 2),
md as (select thread_id, floor(median(total) + 0.5) as median_month, unnest(generate_series(min(m)::timestamp, max(m)::timestamp, interval 1 month))::date as m from r group by 1),
mo as (select thread_id, m, median_month, coalesce(total, 0) as total, coalesce(me, 0) as me, coalesce(wa, 0) as wa, coalesce(active_days, 0) as active_days, coalesce(total, 0) > 0 and total < greatest(1, floor(median_month * 0.15 + 0.5)) as below from md left join r using (thread_id, m))"""


def _health_messages(spark: SparkSession, folder: str) -> DataFrame:
    counted = health.attachment_counts(uneven_messages(spark, folder), orders_attachments(spark, folder))
    lost = (F.col("thread_id") % 5 == 1) & (F.col("imported_ms") > 850_000_000_000)
    return counted.withColumns({c: F.when(lost, 0).otherwise(F.col(c)) for c in ("att", "smil")})


@query(_HEALTH + " select thread_id, strftime(m, '%Y-%m') as month, total, me, total - me as them, wa as with_attachments, active_days, day(last_day(m))::int as days_in_month, below from mo", "uneven")
def archive_months(spark: SparkSession, folder: str) -> DataFrame:
    return health.months(_health_messages(spark, folder), 2)


_SPARSE = f"{SPOKEN}, sp as (select thread_id, ms, date_trunc('month', make_timestamp(ms * 1000))::date as m from spoken)"


@query(_SPARSE + """, r as (select thread_id, m, min(ms) as f, max(ms) as l from sp group by 1, 2), g as (select *, lag(m) over w as pm, lag(l) over w as pl from r window w as (partition by thread_id order by m))
select thread_id, strftime(pm + interval 1 month, '%Y-%m') as from_month, strftime(m - interval 1 month, '%Y-%m') as to_month, (datediff('month', pm, m) - 1)::int as months, pl as last_before_ms, f as first_after_ms from g where datediff('month', pm, m) > 1""", "uneven")
def archive_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return health.gaps(uneven_messages(spark, folder))


@query(f"{SPOKEN} select thread_id, coalesce(source_kind, 'unknown') as kind, min(ms) as first_ms, max(ms) as last_ms, count(*) as n, count(distinct source_file) as files from spoken group by 1, 2", "orders")
def source_spans(spark: SparkSession, folder: str) -> DataFrame:
    return health.source_spans(orders_messages(spark, folder))


@query(_HEALTH + f""", t as (select thread_id, min(ms) as first_ms, max(ms) as last_ms, count(*) as total, count(*) filter (me) as me, count(distinct d) as active_days, count(*) filter (att > 0) as with_attachments,
  count(*) filter (att > 0 and att = smil) as layout_only, max(ms) filter (att > 0) as last_attachment_ms, max(imported_ms) as imported from hm group by 1),
tl as (select hm.thread_id, count(*) as tail from hm join t using (thread_id) where ms >= last_ms - 90 * 86400000::bigint group by 1),
re as (select thread_id, count(*) filter (is_reaction) as reactions from msgs group by 1),
pd as (select thread_id, floor(median(n) + 0.5)::bigint as median_day from (select thread_id, d, count(*) as n from hm group by 1, 2) group by 1),
sh as (select thread_id, count(*) as months, count(*) filter (below) as thin, count(*) filter (total = 0) as absent, max(median_month)::bigint as median_month from mo group by 1),
ga as (select thread_id, max(datediff('month', pm, m) - 1)::int as longest_gap from (select *, lag(m) over (partition by thread_id order by m) as pm from r) group by 1),
z as (select *, total - t.me as them, greatest(1.0, (last_ms - first_ms) / 86400000.0)::double as days from t join tl using (thread_id) join re using (thread_id) join pd using (thread_id) join sh using (thread_id) join ga using (thread_id)),
y as (select *, coalesce(last_ms - last_attachment_ms > 120 * 86400000::bigint, false) as attachments_stop, days > 365 and tail < total / days * 18 as collapses, imported - last_ms > 180 * 86400000::bigint as ends_early,
  total >= 50 and least(me, them) < greatest(me, them) * 0.1 as lopsided from z),
x as (select *, list_filter([case when absent > 0 then 'absent_months' end, case when thin > 0 then 'thin_months' end, case when attachments_stop then 'attachments_stop' end, case when collapses then 'collapses' end,
  case when ends_early then 'ends_early' end, case when lopsided then 'lopsided' end], lambda q: q is not null) as why from y)
select thread_id, first_ms, last_ms, months, active_days, round(active_days / greatest(1, floor((last_ms - first_ms) / 86400000.0 + 0.5) + 1), 6)::double as active_share, total, me, them, reactions, median_day, median_month, thin, absent, coalesce(longest_gap, 0) as longest_gap,
  with_attachments, layout_only, last_attachment_ms, attachments_stop, collapses, ends_early, lopsided,
  case when coalesce(longest_gap, 0) >= 3 or lopsided or collapses then 'serious' when len(why) > 0 then 'notable' else 'clear' end as level, coalesce(array_to_string(why, ','), '') as reasons from x""", "uneven")  # fmt: skip
def archive_report(spark: SparkSession, folder: str) -> DataFrame:
    return health.report(_health_messages(spark, folder), 2, F.max("imported_ms"))


_RANGES = [(0, 0), (820_000_000_000, 850_000_000_000), (850_000_000_000, 820_000_000_000), (860_000_000_000, 0)]


@query(_SPARSE + f""", r as (select thread_id, m, count(*) as total from sp group by 1, 2), e as (select thread_id, min(ms) as f, max(ms) as l, min(m) as fm, max(m) as lm from sp group by 1),
md as (select thread_id, greatest(1, floor(floor(median(total) + 0.5) * 0.15 + 0.5)) as fl from r group by 1),
mo as (select e.thread_id, g.m::date as m, coalesce(total, 0) as total, fl from e join md using (thread_id), lateral (select unnest(generate_series(fm::timestamp, lm::timestamp, interval 1 month)) as m) g left join r on r.thread_id = e.thread_id and r.m = g.m),
q(a, b) as (values {', '.join(map(str, _RANGES))}),
z as (select thread_id, a as from_ms, b as to_ms, coalesce(nullif(a, 0), f) as x, coalesce(nullif(b, 0), l) as y from e, q)
select z.thread_id, from_ms, to_ms, case when y > x then count(*) filter (total = 0 and m >= date_trunc('month', make_timestamp(x * 1000)) and m <= make_timestamp(y * 1000)) end as gap_months,
  case when y > x then count(*) filter (total > 0 and total < fl and m >= date_trunc('month', make_timestamp(x * 1000)) and m <= make_timestamp(y * 1000)) end as thin_months from z join mo using (thread_id) group by z.thread_id, from_ms, to_ms, x, y""", "uneven")  # fmt: skip
def span_discontinuity(spark: SparkSession, folder: str) -> DataFrame:
    m = uneven_messages(spark, folder).withColumn("att", F.lit(0))
    asked = m.select("thread_id").distinct().select("thread_id", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("from_ms"), F.lit(b).cast("long").alias("to_ms")) for a, b in _RANGES])).alias("r")).select("thread_id", "r.*")
    return health.discontinuity(m, asked)


@query("""with k as (select o_custkey as contact_id, count(distinct o_orderpriority) as identifiers from orders group by 1 having count(distinct o_orderpriority) > 1)
select c_nationkey::bigint as thread_id, c_custkey as contact_id, identifiers, (select count(*) from orders o where o.o_custkey = c_custkey) as messages from customer join k on c_custkey = contact_id""")
def ambiguous_contacts(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    members = customers.select(F.col("c_nationkey").cast("long").alias("thread_id"), F.col("c_custkey").alias("contact_id"))
    sent = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("thread_id"), F.col("o_custkey").alias("sender_id"))
    return health.ambiguous_contacts(members, orders.select(F.col("o_custkey").alias("contact_id"), F.col("o_orderpriority").alias("identifier")), sent)


# ---- findings: priorities stand for phrases ----

_EP = f"{SUBSTANTIVE}, {episodes_sql(5 * DAY, 3)}"


def _orders_and_episodes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    messages = orders_messages(spark, folder)
    return messages, conflict.episodes(messages, 5 * DAY, 3)


_CATEGORY = "case when body ilike '%urgent%' then 'pressing' when body ilike '%high%' then 'raised' end"


@query(SUBSTANTIVE + f" select thread_id, id, ms, me, {_CATEGORY} as category, trim(body, ' ') as text from sub where {_CATEGORY} is not null", "orders")
def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return findings.ledger(orders_messages(spark, folder), {"pressing": r"\burgent\b", "raised": r"\bhigh\b"})


@query(SUBSTANTIVE + f""", e as (select *, {_CATEGORY} as category from sub), r as (select *, row_number() over (partition by thread_id, category, me order by ms desc, id desc) as place from e where category is not null)
select thread_id, id, ms, me, category, body as text, place::int as place from r where place <= 4""", "orders")
def receipts(spark: SparkSession, folder: str) -> DataFrame:
    return findings.receipts(findings.ledger(orders_messages(spark, folder), {"pressing": r"\burgent\b", "raised": r"\bhigh\b"}))


@query(SUBSTANTIVE + """ select thread_id, year(make_timestamp(ms * 1000))::int as year, count(*) filter (body ilike '%urgent%' and me) as first_me, count(*) filter (body ilike '%urgent%' and not me) as first_them,
  count(*) filter (body ilike '%low%' and me) as second_me, count(*) filter (body ilike '%low%' and not me) as second_them from sub where body ilike '%urgent%' or body ilike '%low%' group by grouping sets ((thread_id, year(make_timestamp(ms * 1000))), (thread_id))""", "orders")
def framing(spark: SparkSession, folder: str) -> DataFrame:
    return findings.framing(orders_messages(spark, folder), "urgent", "low")


@query(_EP + """, f1 as (select ep.thread_id, start_ms, arg_min(s.me, (s.ms, s.id)) filter (s.id is not null) as by_me from ep left join sub s on s.thread_id = ep.thread_id and s.body ilike '%specified%' and s.ms > end_ms and s.ms <= end_ms + 86400000 group by 1, 2)
select thread_id, count(*) filter (by_me) as me, count(*) filter (not by_me) as them, count(*) filter (by_me is null) as none from f1 group by 1""", "orders")
def first_repairs(spark: SparkSession, folder: str) -> DataFrame:
    return findings.first_repairs(*_orders_and_episodes(spark, folder), "specified")


@query(SUBSTANTIVE + """, n as (select *, last_value(case when me then {'ms': ms, 't': tension} end ignore nulls) over w as mine, last_value(case when not me then {'ms': ms, 't': tension} end ignore nulls) over w as theirs
  from sub window w as (partition by thread_id order by ms desc, id desc rows unbounded preceding exclude current row)),
x as (select thread_id, me, case when me then theirs else mine end as a, ms from n where body ilike '%specified%'), y as (select *, coalesce(a.ms - ms <= 86400000 and a.t >= 2, false) as hot from x)
select thread_id, count(*) filter (me) as total_me, count(*) filter (not me) as total_them, count(*) filter (me and hot) as rejected_me, count(*) filter (not me and hot) as rejected_them,
  round(coalesce(count(*) filter (me and hot) / nullif(count(*) filter (me), 0), 0), 3) as rate_me, round(coalesce(count(*) filter (not me and hot) / nullif(count(*) filter (not me), 0), 0), 3) as rate_them from y group by 1""", "orders")
def met_with_fire(spark: SparkSession, folder: str) -> DataFrame:
    return findings.met_with_fire(orders_messages(spark, folder), "specified", DAY)


_HALVES = "er as (select thread_id, era::int as era, epoch_ms(make_timestamp(1995 + era, 1, 1, 0, 0, 0.0)) as era_start, epoch_ms(make_timestamp(1996 + era, 1, 1, 0, 0, 0.0)) - 1 as era_end from (select distinct thread_id from msgs), range(7) t(era))"


def _year_eras(spark: SparkSession, folder: str) -> DataFrame:
    start = lambda n: F.unix_date(F.make_date(n + F.col("era"), F.lit(1), F.lit(1))).cast("long") * DAY
    threads = orders_messages(spark, folder).select("thread_id").distinct().withColumn("era", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return threads.withColumn("start_ms", start(F.lit(1995))).withColumn("end_ms", start(F.lit(1996)) - 1)


@query(_EP + f""", {_HALVES}, l as (select ep.thread_id, start_ms, arg_max({{'b': s.body, 'w': s.warmth, 't': s.tension}}, (s.ms, s.id)) as m from ep join sub s on s.thread_id = ep.thread_id and s.me and s.ms >= start_ms and s.ms <= end_ms group by 1, 2),
xs as (select thread_id, start_ms, case when m.b ilike '%urgent%' then 'block' when m.b ilike '%low%' then 'notice' when m.w >= 2 or m.b ilike '%specified%' then 'softened' when m.t >= 2 then 'met' else 'silent' end as exit from l)
select xs.thread_id, er.era, exit, count(*) as n from xs left join er on er.thread_id = xs.thread_id and start_ms >= era_start and start_ms <= era_end group by 1, 2, 3""", "orders")
def exit_signature(spark: SparkSession, folder: str) -> DataFrame:
    found = findings.exits(*_orders_and_episodes(spark, folder), "urgent", "low", "specified")
    return findings.by_era(found, _year_eras(spark, folder)).groupBy("thread_id", "era", "exit").agg(F.count(F.lit(1)).alias("n"))


@query(SUBSTANTIVE + """ select thread_id, year(make_timestamp(ms * 1000)) || '-Q' || quarter(make_timestamp(ms * 1000)) as quarter, me, count(*) as n, round(avg(len(regexp_extract_all(body, '\\S+'))), 3) as words, round(avg(case when warmth >= 2 then 1.0 else 0 end), 3) as warm_rate,
  round(avg(case when body ilike '%low%' then 1.0 else 0 end), 3) as love_rate, round(avg(case when body ilike '%medium%' then 1.0 else 0 end), 3) as playful_rate from sub group by 1, 2, 3""", "orders")
def wearing_down(spark: SparkSession, folder: str) -> DataFrame:
    return findings.wearing_down(orders_messages(spark, folder), "low", "medium")


@query(_EP + """, k as (select ep.*, exists (select 1 from sub s where s.thread_id = ep.thread_id and s.body ilike '%not specified%' and s.ms >= start_ms - 3600000 and s.ms <= end_ms + 3600000) as near from ep)
select thread_id, year(make_timestamp(start_ms * 1000))::int as year, count(*) as episodes, count(*) filter (near) as near, round(avg(case when near then 1.0 else 0 end), 6) as near_share,
  coalesce(sum(hostile_me) filter (near), 0)::bigint as hostile_me, coalesce(sum(hostile_them) filter (near), 0)::bigint as hostile_them, coalesce(sum(severe_me + severe_them) filter (near), 0)::bigint as severe from k group by 1, 2""", "orders")
def mentions_near_episodes(spark: SparkSession, folder: str) -> DataFrame:
    messages, found = _orders_and_episodes(spark, folder)
    return findings.near_by_year(findings.near_mentions(messages, found, findings.word_pattern(["not specified"])))


_ARRAYS = ("episodes", "receipts")


@query(_EP + f""", {answers_sql(DAY, MONTH, 'month')}, e as (select *, {_CATEGORY} as category from sub), l as (select *, row_number() over (partition by thread_id, category, me order by ms desc, id desc) as place from e where category is not null),
rx as (select thread_id, string_agg(id, ',' order by id) as receipts from l where place <= 4 group by 1),
q as (select *, row_number() over (partition by thread_id order by severe_me + severe_them desc, peak desc, start_ms, start_id) as place from ep), ex as (select thread_id, string_agg(start_id, ',' order by start_id) as episodes from q where place <= 6 group by 1),
sx as (select thread_id, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('n_me', 'n_them', 'hostile_me', 'hostile_them', 'severe_me', 'severe_them', 'warm_me', 'warm_them'))},
  round(arg_min(returned / asked, month) filter (asked > 0), 6) as first_rate, round(arg_max(returned / asked, month) filter (asked > 0), 6) as last_rate from rc group by 1)
select sx.*, coalesce(episodes, '') as episodes, coalesce(receipts, '') as receipts from sx left join ex using (thread_id) left join rx using (thread_id)""", "orders")
def letter_material(spark: SparkSession, folder: str) -> DataFrame:
    messages, found = _orders_and_episodes(spark, folder)
    entries = findings.ledger(messages, {"pressing": r"\burgent\b", "raised": r"\bhigh\b"})
    made = findings.letter_material(conflict.reciprocation(messages, conflict.month(), "month", DAY), found, entries)
    return made.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in _ARRAYS})


# ---- power ----

_PATTERNS = """pa as (select thread_id, start_id, (case when start_id % 2 = 0 then 1 else 0 end) as c_me, (case when start_id % 3 = 0 then 2 else 0 end) as c_them from ep)"""
_GATE = _EP + f""", {_HALVES}, {_PATTERNS}, gt as (select er.thread_id, er.era, era_start as start_ms, era_end as end_ms, count(ep.start_id) as episodes, coalesce(sum(severe_me), 0)::bigint as severe_me, coalesce(sum(severe_them), 0)::bigint as severe_them,
  count(*) filter (begun_by_me) as begun_me, count(*) filter (not begun_by_me) as begun_them, coalesce(sum(c_me), 0)::bigint as coercive_me, coalesce(sum(c_them), 0)::bigint as coercive_them
  from er left join (ep join pa using (thread_id, start_id)) ep on ep.thread_id = er.thread_id and ep.start_ms >= era_start and ep.start_ms <= era_end group by 1, 2, 3, 4),
gs as (select *, coalesce(severe_them / nullif(severe_them + severe_me, 0), 0.5) as a, coalesce(begun_them / nullif(begun_them + begun_me, 0), 0.5) as b, coalesce(coercive_them / nullif(coercive_them + coercive_me, 0), 0.5) as c from gt),
gg as (select *, case when a >= 0.6 and b >= 0.6 and c >= 0.6 then 'them' when a <= 0.4 and b <= 0.4 and c <= 0.4 then 'me' end as direction from gs)"""


def _gates(spark: SparkSession, folder: str) -> DataFrame:
    _, found = _orders_and_episodes(spark, folder)
    p = lambda kind, side, repair=False: F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), F.lit(repair).alias("repair_context"))
    start = F.col("start_id")
    made = F.concat(F.when(start % 2 == 0, F.array(p("threat", "me"), p("contempt", "me"))).otherwise(F.array(p("threat", "me", True))), F.when(start % 3 == 0, F.array(p("monitoring", "them"), p("coercive_demand", "them"))).otherwise(F.array(p("apology", "them"))))
    results = found.select("thread_id", F.array(start, start + 1).alias("member_ids"), made.alias("patterns"))
    return gate.era_gate(gate.era_totals(found, _year_eras(spark, folder), results), 0.6)


@query(_GATE + " select thread_id, era, start_ms, end_ms, episodes, severe_me, severe_them, begun_me, begun_them, coercive_me, coercive_them, round(a, 6) as share_severe, round(b, 6) as share_begun, round(c, 6) as share_coercive, direction from gg", "orders")
def power_by_era(spark: SparkSession, folder: str) -> DataFrame:
    found = _gates(spark, folder)
    return found.withColumns({c: rounded(F.col(c)) for c in found.columns if c.startswith("share_")})


@query(_GATE + """, w as (select *, (severe_me + severe_them) * pow(0.5, (max(end_ms) over (partition by thread_id) - end_ms) / (365.0 * 86400000)) as w from gg),
s as (select thread_id, coalesce(sum(w) filter (direction = 'them'), 0) as t, coalesce(sum(w) filter (direction = 'me'), 0) as m from w group by 1)
select thread_id, case when t + m > 0 then case when t >= m then 'them' else 'me' end end as direction, round(coalesce(abs(t - m) / nullif(t + m, 0), 0), 6) as confidence, case when t + m > 0 then 'support' else 'two_readings' end as frame from s""", "orders")
def power_stance(spark: SparkSession, folder: str) -> DataFrame:
    return gate.framed(gate.stance(_gates(spark, folder)), True, True)


@query(_EP + ", r as (select thread_id, start_id, row_number() over (partition by thread_id order by severe_me + severe_them desc, peak desc, start_ms, start_id) as place from ep) select thread_id, start_id, place::int as place from r where place <= 3", "orders")
def sample_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return gate.sample_episodes(_orders_and_episodes(spark, folder)[1], 3).select("thread_id", "start_id", "place")


_LABELS = """lb as (select case when doc_id % 8 = 0 then source else lang end as owner, doc_id % 2 = 0 as me, (doc_id % 4)::double as tension, case when doc_id % 9 <> 0 then toxic = 1 or doc_id % 4 = 3 end as hostile, (case when toxic = 1 then 3 else doc_id % 3 end)::int as severity
  from documents join labels using (doc_id) where toxic is not null)"""


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").filter("toxic is not null")
    return both.selectExpr("case when doc_id % 8 = 0 then source else lang end as owner", "doc_id % 2 = 0 as me", "cast(doc_id % 4 as double) as tension", "case when doc_id % 9 <> 0 then toxic = 1 or doc_id % 4 = 3 end as hostile", "cast(case when toxic = 1 then 3 else doc_id % 3 end as int) as severity")


@query(f"""with {_LABELS}, r as (select owner, count(*) as n, count(*) filter (tension >= 2 and me) as own_high, count(*) filter (tension >= 2 and not me) as other_high,
  coalesce(avg(hostile::int) filter (tension >= 2 and me), 0) as o, coalesce(avg(hostile::int) filter (tension >= 2 and not me), 0) as t, coalesce(avg(severity) filter (tension >= 2 and me), 0) as os, coalesce(avg(severity) filter (tension >= 2 and not me), 0) as ts from lb where hostile is not null group by 1),
v as (select *, case when least(own_high, other_high) < 8 then 'insufficient' when t - o > 0.15 then 'self_lenient' when t - o < -0.15 then 'self_critical' else 'balanced' end as verdict from r)
select owner, n, own_high, other_high, floor(o * 100 + 0.5) / 100 as own_rate, floor(t * 100 + 0.5) / 100 as other_rate, floor((t - o) * 100 + 0.5) / 100 as leniency, floor(os * 100 + 0.5) / 100 as own_severity, floor(ts * 100 + 0.5) / 100 as other_severity, verdict,
  floor(case verdict when 'self_lenient' then least(0.12, (t - o) * 0.3) when 'insufficient' then 0.12 else 0 end * 100 + 0.5) / 100 as bump from v""")
def self_report_bias(spark: SparkSession, folder: str) -> DataFrame:
    return gate.self_report_bias(_labels(spark, folder))


@query(f"""with {_LABELS}, s as (select * from lb where hostile is not null), c as (select owner, t, count(*) as n, count(*) filter (hostile) as h, count(*) filter (severity >= 3) as sv, count(*) filter (tension >= t) as p,
  count(*) filter (tension >= t and hostile) as tp, count(*) filter (tension >= t and severity >= 3) as ts from s, (values (1), (2), (3)) k(t) group by 1, 2),
f as (select *, coalesce(2.0 * tp / nullif(p + h, 0), 0) as fh, coalesce(2.0 * ts / nullif(p + sv, 0), 0) as fs from c),
b as (select owner, max(n) as n, max(h) as h, max(sv) as sv, count(*) filter (p > 0 and p < n) as splits, max(fh) as best, arg_max(t, (fh, -t)) as hostile, arg_max(t, (fs, -t)) filter (t > 1) as sharp from f group by 1),
g as (select *, case when sv >= 3 then sharp else least(hostile + 1, 3) end as sev, n >= 8 and h >= 3 and splits >= 2 and best > 0 as ok from b)
select owner, case when ok then hostile else 2 end as hostile, case when ok then case when sev <= hostile then least(hostile + 1, 3) else sev end else 3 end as severe from g""")
def derived_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return gate.derive_thresholds(_labels(spark, folder))


# ---- people ----


@query("""with a as (select o_orderkey as id, 'c' || (o_custkey % 40) as k from orders union select o_orderkey, 'p' || substr(o_orderpriority, 1, 1) from orders union select o_orderkey, 'me' from orders where o_orderkey % 10 <> 0),
p as (select a.k as k, count(distinct b.k) as n from a join a b on a.id = b.id and a.k <> b.k group by 1), m as (select max(n) as n from p)
select k as key from p, m where p.n = m.n and p.n >= 2 and (select count(*) from p p2, m m2 where p2.n = m2.n) = 1""")
def owner_by_company(spark: SparkSession, folder: str) -> DataFrame:
    a = lambda c, role: F.struct(c.alias("raw"), F.lit(role).alias("role"))
    who = [a(F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")), "from"), a(F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)), "to"), a(F.when(F.col("o_orderkey") % 10 != 0, "me"), "to")]
    return identity.owner_by_company(table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("ms"), F.array(*who).alias("addresses")))


@query("""with st as (select c_custkey as contact_id, 'r' || c_custkey as raw, 'e' || (c_custkey % 300) as e164 from customer where c_custkey % 3 = 0),
ar as (select s_suppkey as contact, n, case when n = 1 then 'r' || (s_suppkey * 2) else 'x' || s_suppkey end as raw, case when n = 1 then null else 'e' || (s_suppkey % 400) end as e164 from supplier, (values (1), (2)) t(n)),
h as (select contact, n, coalesce((select min(contact_id) from st where st.raw = ar.raw), (select min(contact_id) from st where st.e164 = ar.e164)) as hit from ar)
select contact, arg_min(hit, n) filter (hit is not null) as contact_id from h group by 1""")
def merged_contacts(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey as contact_id", "concat('r', c_custkey) as raw", "concat('e', c_custkey % 300) as e164")
    arrived = table(spark, folder, "supplier").selectExpr("s_suppkey as contact", "explode(array(1, 2)) as nth").selectExpr("contact", "nth", "if(nth = 1, concat('r', contact * 2), concat('x', contact)) as raw", "if(nth = 1, null, concat('e', contact % 400)) as e164")
    return identity.merge_contacts(arrived, stored)


@query(f"""{SUBSTANTIVE}, {episodes_sql(5 * DAY, 3)}, n as (select thread_id, start_id, hostile, peak, start_ms from ep where start_id % 7 <> 0),
o as (select thread_id, start_id, case when start_id % 5 = 0 then hostile + 1 else hostile end as hostile, peak, start_ms, 'told ' || start_id as narrative from ep where start_id % 3 <> 0)
select coalesce(n.thread_id, o.thread_id) as thread_id, coalesce(n.start_id, o.start_id) as start_id, coalesce(n.hostile, o.hostile) as hostile, coalesce(n.peak, o.peak) as peak, coalesce(n.start_ms, o.start_ms) as start_ms, narrative,
  case when o.start_id is null then 'inserted' when n.start_id is null then 'removed' when n.hostile = o.hostile then 'kept' else 'updated' end as status from n full join o on n.thread_id = o.thread_id and n.start_id = o.start_id""", "orders")
def refreshed_episodes(spark: SparkSession, folder: str) -> DataFrame:
    found = _orders_and_episodes(spark, folder)[1].select("thread_id", "start_id", "hostile", "peak", "start_ms")
    stored = found.filter("start_id % 3 <> 0").withColumn("hostile", F.when(F.col("start_id") % 5 == 0, F.col("hostile") + 1).otherwise(F.col("hostile"))).withColumn("narrative", F.concat(F.lit("told "), F.col("start_id").cast("string")))
    return identity.refresh_episodes(stored, found.filter("start_id % 7 <> 0"))


@query("""with c as (select p_partkey as claim_id, [p_partkey, p_partkey * 4, p_partkey * 8 + 1] as e from part), k as (select claim_id, unnest(e) as id, generate_subscripts(e, 1) as i from c)
select claim_id, string_agg(id, ',' order by i) as evidence from k where id in (select o_orderkey from orders) group by 1""")
def supported_claims(spark: SparkSession, folder: str) -> DataFrame:
    claims = table(spark, folder, "part").select(F.col("p_partkey").alias("claim_id"), F.array(F.col("p_partkey"), F.col("p_partkey") * 4, F.col("p_partkey") * 8 + 1).alias("evidence_ids"))
    kept = identity.supported_claims(claims, table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")))
    return kept.select("claim_id", F.array_join(F.col("evidence_ids").cast("array<string>"), ",").alias("evidence"))


# ---- lists, search and fields ----


@query(f"""{SPOKEN}, d as (select thread_id, ms // 86400000 as day, count(*) as n from spoken group by 1, 2), b as (select thread_id, arg_max(day, (n, -day)) as biggest_day, max(n) as biggest_n from d group by 1)
select thread_id, arg_min(id, (ms, id)) as first_id, min(ms) as first_ms, biggest_day, biggest_n, count(*) as total from spoken join b using (thread_id) group by 1, 4, 5""", "events")
def moments(spark: SparkSession, folder: str) -> DataFrame:
    return search.moments(events_messages(spark, folder))


@query("""n as (select c_nationkey::bigint as thread_id, string_agg(case when c_custkey % 9 = 0 then 'Unknown' else c_name end, ', ' order by c_custkey) as names, bool_or(c_custkey % 50 = 0) as grieving from customer where c_custkey <> 1 group by 1)
select thread_id, coalesce(names, 'Unknown') as names, count(*) as n, max(ms) as last_ms, coalesce(grieving, false) as grieving from msgs left join n using (thread_id) group by 1, 2, 5""", "orders")
def thread_list(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer")
    who = people.select(F.col("c_custkey").alias("contact_id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("name"), (F.col("c_custkey") == 1).alias("is_owner"), (F.col("c_custkey") % 50 == 0).alias("deceased"))
    return search.thread_list(orders_messages(spark, folder), people.select(F.col("c_nationkey").cast("long").alias("thread_id"), F.col("c_custkey").alias("contact_id")), who)


@query("""f as (select unnest([{'w': 'direction', 'v': direction}, {'w': 'reaction', 'v': case when is_reaction then 'yes' else 'no' end}, {'w': 'empty', 'v': case when trim(coalesce(body, ''), ' ') = '' then 'yes' else 'no' end},
  {'w': 'year', 'v': year(make_timestamp(ms * 1000))::varchar}, {'w': 'source', 'v': coalesce(source_kind, 'unknown')}]) as f from msgs) select f.w as what, f.v as value, count(*) as n from f group by 1, 2""", "orders")
def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return search.diagnostics(orders_messages(spark, folder))


@query(_EP + """, r as (select ep.thread_id, start_ms, m.id, m.ms, m.direction, m.body, row_number() over (partition by ep.thread_id, start_ms order by m.ms, m.id) as place from ep join msgs m on m.thread_id = ep.thread_id and m.ms >= start_ms - 1 and m.ms <= end_ms + 1)
select thread_id, start_ms, place::int as place, id, ms, direction, body from r where place <= 20""", "orders")
def episode_drill(spark: SparkSession, folder: str) -> DataFrame:
    messages, found = _orders_and_episodes(spark, folder)
    return search.around(messages, found, limit=20)


@query(SUBSTANTIVE + """, r as (select * from sub where thread_id = 3 and ms >= 800000000000 order by ms, id limit 501), k as (select * from r where tension >= 2 and me), c as (select count(*) as c from k)
select id, ms, me, tension::double as tension, warmth::double as warmth, body, least(c, 500)::bigint as count, case when c > 500 then '500+' else c::varchar end as label from k, c order by ms, id limit 50""", "orders")
def ask_plan(spark: SparkSession, folder: str) -> DataFrame:
    m = orders_messages(spark, folder).withColumns({"scored": F.lit(True), "tension": F.col("tension").cast("double"), "warmth": F.col("warmth").cast("double")})
    return search.plan_ask(m, 3, side="me", from_ms=800_000_000_000, least_tension=2)


@query(SUBSTANTIVE + """, t as (select *, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') as w from sub), m as (select *, len(w) as length, len(list_filter(range(1, len(w)), lambda i: w[i] = 'not' and w[i + 1] = 'specified')) as hits from t),
s as (select count(*) as docs, avg(length) as mean, count(*) filter (hits > 0) as n from m), r as (select m.*, round(ln(1 + (docs - n + 0.5) / (n + 0.5)) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * length / mean)), 6) as score from m, s where hits > 0 and thread_id = 5),
b as (select * from r order by score desc, id limit 41), k as (select * from b where ms >= 800000000000 and warmth >= 2), c as (select count(*) as c from k)
select id, ms, me, tension::double as tension, warmth::double as warmth, body, least(c, 40)::bigint as count, case when c > 40 then '40+' else c::varchar end as label from k, c order by ms, id limit 40""", "orders")
def ask_phrase(spark: SparkSession, folder: str) -> DataFrame:
    m = orders_messages(spark, folder).withColumns({"scored": F.lit(True), "tension": F.col("tension").cast("double"), "warmth": F.col("warmth").cast("double")})
    return search.plan_ask(m, 5, "not specified", from_ms=800_000_000_000, least_warmth=2, cap=40)


_RAW = "case c_custkey % 6 when 0 then '+1 (555) ' || n when 1 then '555' || n when 2 then 'u' || c_custkey || '@x.org' when 3 then (c_custkey % 1000000)::varchar when 4 then 'SHOP' || c_custkey else 'null' end"


@query(f"""with b as (select *, lpad((c_custkey % 10000000)::varchar, 7, '0') as n from customer), r as (select *, {_RAW} as raw, (c_custkey % 7)::varchar as kind, case c_custkey % 4 when 0 then (1700000000 + c_custkey)::varchar when 1 then (1700000000000 + c_custkey)::varchar when 2 then 'soon' else null end as at from b)
select c_custkey as id, case when raw <> 'null' then raw end as raw, case c_custkey % 6 when 0 then 'mobile' when 1 then 'mobile' when 2 then 'email' when 3 then 'shortcode' when 4 then 'alias' else 'alias' end as kind,
  case c_custkey % 6 when 0 then '+1555' || n when 1 then '+1555' || n end as e164, case kind when '1' then 'incoming' when '2' then 'outgoing' when '3' then 'draft' else 'other' end as sms,
  case kind when '1' then 'incoming' when '2' then 'outgoing' when '3' then 'incoming' when '4' then 'outgoing' else case c_custkey % 2 when 0 then 'outgoing' else 'incoming' end end as mms,
  case c_custkey % 5 when 0 then 'from' when 1 then 'to' when 2 then 'cc' when 3 then 'bcc' else 'to' end as role,
  case c_custkey % 4 when 0 then (1700000000 + c_custkey) * 1000 when 1 then 1700000000000 + c_custkey else 0 end as ms,
  case c_custkey % 3 when 0 then 'liked' when 1 then 'laughed' end as reaction from r""")
def normalized_fields(spark: SparkSession, folder: str) -> DataFrame:
    N, k = normalize, F.col("c_custkey")
    n = F.lpad((k % 10_000_000).cast("string"), 7, "0")
    raw = F.when(k % 6 == 0, F.concat(F.lit("+1 (555) "), n)).when(k % 6 == 1, F.concat(F.lit("555"), n)).when(k % 6 == 2, F.concat(F.lit("u"), k, F.lit("@x.org"))).when(k % 6 == 3, (k % 1_000_000).cast("string")).when(k % 6 == 4, F.concat(F.lit("SHOP"), k)).otherwise("null")
    at = F.when(k % 4 == 0, (k + 1_700_000_000).cast("string")).when(k % 4 == 1, (k + 1_700_000_000_000).cast("string")).when(k % 4 == 2, "soon")
    body = F.when(k % 3 == 0, "Liked “so\nit is”").when(k % 3 == 1, 'Laughed at "that"').otherwise("liked “that”")
    role = F.element_at(F.array(*[F.lit(c) for c in ("137", "151", "130", "129", "7")]), (k % 5 + 1).cast("int"))
    kind = (k % 7).cast("string")
    given = N.present(raw)
    return table(spark, folder, "customer").select(
        k.alias("id"), given.alias("raw"), N.address_kind(given).alias("kind"), N.e164(given).alias("e164"), N.sms_direction(N.whole(kind)).alias("sms"), N.mms_direction(N.whole(kind), F.when(k % 2 == 0, 128).otherwise(132)).alias("mms"),
        N.address_role(N.whole(role)).alias("role"), N.sent_ms(at).alias("ms"), N.reaction_kind(body).alias("reaction"),
    )


# ---- imports: tables written as exports and read back ----


@query("""select event_id as id, case event_id % 3 when 0 then epoch_us(ts) // 1000000 * 1000 when 1 then epoch_us(ts) // 1000 end as ms, 'u' || user_id as sender,
  case when event_type in ('click', 'purchase') then 'outgoing' when event_type = 'signup' then 'incoming' when user_id = 7 then 'outgoing' when user_id % 9 <> 0 then 'incoming' end as direction,
  case when event_id % 3 = 2 then case event_id % 2 when 0 then 'no timestamp' else 'unclear timestamp: 1/2/2021' end when event_type not in ('click', 'purchase', 'signup') and user_id % 9 = 0 then 'no direction' end as problem from events""")
def imported_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as CSV with commas, quotes and line feeds in bodies; times in seconds, milliseconds, missing or unclear; directions by word, by the owner u7, or unknown."""
    ms, k = epoch_ms("ts"), F.col("event_id")
    when = F.when(k % 3 == 0, F.floor(ms / 1000).cast("string")).when(k % 3 == 1, ms.cast("string")).when(k % 2 == 1, "1/2/2021")
    said = F.when(F.col("event_type").isin("click", "purchase"), "Sent").when(F.col("event_type") == "signup", "received")
    path = scratch(spark, "rows") + ".csv"
    hidden = said.isNull() & (F.col("user_id") % 9 == 0)
    named = F.when(~hidden, F.concat(F.lit("u"), "user_id"))
    table(spark, folder, "events").select(when.alias("Date"), named.alias("From"), said.alias("Dir"), F.concat(k.cast("string"), F.lit("/u"), "user_id", F.lit(', "so"\n it is')).alias("Text")).write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    found = exports.plain_rows(spark, path, "U7")
    sender = F.coalesce("sender", F.regexp_extract("body", r"/(u\d+), ", 1))
    return found.select(F.regexp_extract("body", r'^(\d+)/u\d+, "so"\n it is$', 1).cast("long").alias("id"), "ms", sender.alias("sender"), "direction", "problem")


@query("""select event_id as id, epoch_us(ts) // 1000000 * 1000 as ms, 'u' || user_id as sender, case when event_type in ('click', 'purchase') then 'outgoing' when user_id = 7 then 'outgoing' else 'incoming' end as direction, props as body from events""")
def imported_json(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON lines under other column names."""
    path = scratch(spark, "lines") + ".jsonl"
    said = F.when(F.col("event_type").isin("click", "purchase"), "OUT")
    table(spark, folder, "events").select(F.floor(epoch_ms("ts") / 1000).alias("sent_at"), F.concat(F.lit("u"), "user_id").alias("author"), said.alias("direction"), F.concat_ws("|", "event_id", "props").alias("content")).write.json(path)
    found = exports.plain_rows(spark, path, "u7")
    return found.select(F.substring_index("body", "|", 1).cast("long").alias("id"), "ms", "sender", "direction", F.expr("substring(body, locate('|', body) + 1)").alias("body"))


@query("""select event_id as id, epoch_us(ts) // 60000000 * 60000 as ms, case when event_id % 11 <> 0 then 'u' || user_id end as sender, case when event_id % 11 <> 0 and event_id % 7 = 0 then '' else event_id || ' it: was' || case event_id % 3 when 0 then chr(10) || '1/2, not a head' else '' end end as body,
  event_id % 11 <> 0 and event_id % 7 = 0 as media, 'dmy' as "order" from events""")
def imported_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Events as exported chats: system lines, media, messages of two lines; Spark's part files are the chats."""
    k, path = F.col("event_id"), scratch(spark, "chat")
    body = F.when((k % 11 != 0) & (k % 7 == 0), "<Media omitted>").otherwise(F.concat(k.cast("string"), F.lit(" it: was"), F.when(k % 3 == 0, "\n1/2, not a head").otherwise("")))
    at = F.timestamp_seconds(F.floor(epoch_ms("ts") / 1000))
    # A media line says nothing of its event: its time holds the seconds, its sender the event.
    sender = F.when(k % 11 != 0, F.concat(F.lit("u"), "user_id", F.when(k % 7 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise(""), F.lit(": "))).otherwise("")
    system = F.when(k % 11 == 0, F.regexp_replace(body, "it: was", "it:was")).otherwise(body)
    table(spark, folder, "events").select(F.concat(F.date_format(at, "dd/MM/yyyy, HH:mm"), F.lit(" - "), sender, system)).write.option("compression", "none").text(path)
    found = exports.chat_text(spark, path)
    key = F.when(F.col("media"), F.substring_index("sender", " ", -1)).otherwise(F.regexp_extract("body", r"^(\d+)", 1)).cast("long")
    return found.select(key.alias("id"), "ms", F.substring_index("sender", " ", 1).alias("sender"), F.regexp_replace("body", "it:was", "it: was").alias("body"), "media", "order")


@query("""select o_orderkey as id, epoch_us(o_orderdate) // 1000 as ms, case o_orderkey % 5 when 0 then 'incoming' when 1 then 'outgoing' when 2 then 'draft' else 'other' end as direction,
  case when o_orderkey % 7 <> 0 then o_orderpriority || ' & <' || o_orderkey || '>' end as body, case o_orderkey % 3 when 0 then true when 1 then false end as is_read, 'c' || o_custkey as address from orders""")
def imported_backup(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as the text messages of XML backups, escaped, and read back."""
    k = F.col("o_orderkey")
    escaped = F.replace(F.replace(F.replace(F.concat_ws("", "o_orderpriority", F.lit(" & <"), k, F.lit(">")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kind, read = (k % 5 + 1).cast("string"), F.when(k % 3 == 0, "1").when(k % 3 == 1, "0").otherwise("null")
    line = F.concat(F.lit('<sms address="c'), F.col("o_custkey"), F.lit('" date="'), epoch_ms("o_orderdate"), F.lit('" type="'), kind, F.lit('" body="'), F.when(k % 7 == 0, "null").otherwise(escaped), F.lit('" read="'), read, F.lit('" contact_name="'), k, F.lit('" />'))
    path = scratch(spark, "backup")
    table(spark, folder, "orders").select(line).write.text(path)
    return exports.sms(spark, path).select(F.col("contact_name").cast("long").alias("id"), "ms", "direction", "body", "is_read", F.col("addresses")[0]["raw"].alias("address"))


@query("""with a as (select o_orderkey % 4000 as dedup_key, o_custkey % 5 as source_file from orders), f as (select dedup_key, min(source_file) as source_file from a where dedup_key not in (select distinct (o_orderkey % 4000) // 7 * 7 from orders) group by 1),
n as (select source_file, count(*) as new from f group by 1), t as (select source_file, count(*) as records from a group by 1)
select source_file, records, coalesce(new, 0) as new, records - coalesce(new, 0) as known from t left join n using (source_file)""")
def import_counts(spark: SparkSession, folder: str) -> DataFrame:
    arrived = table(spark, folder, "orders").select((F.col("o_orderkey") % 4000).alias("dedup_key"), (F.col("o_custkey") % 5).alias("source_file"))
    return identity.import_counts(arrived, arrived.select((F.floor(F.col("dedup_key") / 7) * 7).alias("dedup_key")))


_PEOPLE = """ad as (select o_orderkey as id, epoch_us(o_orderdate) // 1000 as ms, case when o_orderkey % 2 = 0 then 'outgoing' else 'incoming' end as direction, 'c' || o_custkey as raw, case when o_orderkey % 2 = 0 then 'to' else 'from' end as role, c_name as name from orders join customer on o_custkey = c_custkey
  union all select o_orderkey, epoch_us(o_orderdate) // 1000, case when o_orderkey % 2 = 0 then 'outgoing' else 'incoming' end, 'me', case when o_orderkey % 2 = 0 then 'from' else 'to' end, null from orders where o_orderkey % 3 = 0)"""


def _people(spark: SparkSession, folder: str) -> DataFrame:
    out, k = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")
    a = lambda raw, role: F.struct(raw.alias("raw"), role.alias("role"))
    both = F.array_compact(F.array(a(F.concat(F.lit("c"), "o_custkey"), F.when(out, "to").otherwise("from")), F.when(k % 3 == 0, a(F.lit("me"), F.when(out, "from").otherwise("to")))))
    return table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(k.alias("id"), epoch_ms("o_orderdate").alias("ms"), F.when(out, "outgoing").otherwise("incoming").alias("direction"), both.alias("addresses"), F.col("c_name").alias("contact_name"))


@query(f"""with {_PEOPLE}, n as (select id, count(*) as n from ad group by 1)
select raw as key, 'alias' as kind, min(ms) as first_ms, max(ms) as last_ms, case when raw <> 'me' then arg_max(name, (ms, id, name)) filter (n = 1) end as name from ad join n using (id) group by 1""")
def contact_list(spark: SparkSession, folder: str) -> DataFrame:
    return threads.contacts(_people(spark, folder))


@query(f"with {_PEOPLE}, e as (select raw from ad where direction = 'outgoing' and role = 'from' union select raw from ad where direction = 'incoming' and role = 'to') select min(raw) as key from e having count(distinct raw) = 1")
def owner_by_role(spark: SparkSession, folder: str) -> DataFrame:
    return threads.owner_key(_people(spark, folder))


@query(f"""with {_PEOPLE}, k as (select id, raw as c from ad where raw <> 'me')
select sha256('["' || replace('["member","' || c || '"]', '"', '\\"') || '"]') as thread_key, count(*) as n, false as is_group from k group by 1""")
def assigned_threads(spark: SparkSession, folder: str) -> DataFrame:
    people = _people(spark, folder)
    return threads.assign_threads(people, threads.owner_key(people)).groupBy("thread_key").agg(F.count(F.lit(1)).alias("n"), F.max("is_group").alias("is_group"))


def _loaded(spark: SparkSession, folder: str) -> Store:
    """Orders as two imports that share a third of their records; the first comes once more at the end."""
    records = _people(spark, folder).withColumn("body", F.concat(F.lit("order "), "id")).withColumn("lang", F.when(F.col("id") % 3 == 0, "fr").when(F.col("id") % 3 == 1, "en"))
    k = F.regexp_extract(F.col("addresses")[0]["raw"], r"(\d+)", 1).cast("int") % 3
    store, first = Store(spark, scratch(spark, "graph")), records.filter(k != 0)
    for source, rows in (("a", first), ("b", records.filter(k != 1)), ("a", first)):
        store = load.load(store, rows, source, f"sha-{source}")
    return store


@query(f"""with {_PEOPLE}, k as (select ad.id, ms, raw as c, case ad.id % 3 when 0 then 'fr' when 1 then 'en' end as lang from ad where raw <> 'me'),
l as (select c, lang, count(*) as n from k where lang is not null group by 1, 2), g as (select c, string_agg(lang || ':' || n, ',' order by n desc, lang) as languages, arg_min(lang, (-n, lang)) as lang from l group by 1)
select sha256('["' || replace('["member","' || c || '"]', '"', '\\"') || '"]') as thread_key, count(*) as n, min(ms) as first_ms, max(ms) as last_ms, any_value(g.lang) as lang, coalesce(any_value(languages), '') as languages from k left join g using (c) group by c""")
def loaded_threads(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder).read("threads")


@query("""select * from (select 'a' as source_file, count(*) filter (o_custkey % 3 <> 0) as records, count(*) filter (o_custkey % 3 <> 0) as new, 0::bigint as known from orders
  union all select 'b', count(*) filter (o_custkey % 3 <> 1), count(*) filter (o_custkey % 3 = 0), count(*) filter (o_custkey % 3 = 2) from orders)""")
def load_log(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder).read("files").drop("sha256")


@query(f"""with {_PEOPLE}, n as (select id, count(*) as n from ad group by 1), c as (select raw, arg_max(name, (ms, id, name)) filter (n = 1) as name from ad join n using (id) group by 1)
select raw, case when raw <> 'me' then name end as name, raw = 'me' as is_owner from c""")
def loaded_contacts(spark: SparkSession, folder: str) -> DataFrame:
    store = _loaded(spark, folder)
    return store.read("identifiers").join(store.read("contacts"), "contact_id").select("raw", "name", "is_owner")


@query(f"""with {_PEOPLE} select id, max(case when direction = 'outgoing' then 'me' else raw end) filter (direction = 'outgoing' or role = 'from') as sender, coalesce(string_agg(raw || ':' || role, ',' order by raw) filter (role <> 'from'), '') as recipients from ad group by 1""")
def message_senders(spark: SparkSession, folder: str) -> DataFrame:
    people = _people(spark, folder)
    found = identity.senders(people, threads.owner_key(people))
    return found.select("id", "sender", F.array_join(F.transform(F.array_sort("recipients"), lambda r: F.concat_ws(":", r["key"], r["role"])), ",").alias("recipients"))


@query("""select o_orderkey as id, case when c_custkey % 9 <> 0 then c_name end as sender_name, (select count(*) from lineitem where l_orderkey = o_orderkey and l_quantity <= 4 and l_quantity <> 1) as attachments from orders left join customer on o_custkey = c_custkey and c_custkey % 11 <> 0""")
def message_rows(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer").filter("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("contact_id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("name"))
    sent = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sender_id"))
    return search.message_rows(sent, people, orders_attachments(spark, folder)).select("id", "sender_name", "attachments")


@query(f"""{SUBSTANTIVE}, c as (select *, coalesce(lag(me) over w <> me, true) as c, row_number() over w as rn from sub window w as (partition by thread_id order by ms, id)),
t as (select *, sum(c::int) over (partition by thread_id order by rn) as turn, ceil((length(body) + 24) / 4) as cost from c),
u as (select thread_id, turn, count(*) as n, sum(cost) as cost from t group by 1, 2),
v as (select *, sum(n) over w as upto, sum(cost) over w as spent from u window w as (partition by thread_id order by turn)),
e as (select a.thread_id, a.turn, min(b.turn) + 1 as next from v a left join v b on b.thread_id = a.thread_id and b.turn >= a.turn and b.turn < a.turn + 20 and (b.upto - a.upto + a.n >= 20 or b.spent - a.spent + a.cost >= 800) group by 1, 2),
wi as (select thread_id, 1::bigint as turn, 0::bigint as win from e where turn = 1 union all select w.thread_id, x.next, w.win + 1 from wi w join e x on x.thread_id = w.thread_id and x.turn = w.turn join v y on y.thread_id = x.thread_id and y.turn = x.next),
tw as (select t.thread_id, t.id, t.ms, t.rn, t.turn, w.win from t asof join wi w on t.thread_id = w.thread_id and t.turn >= w.turn),
en as (select thread_id, win, max(turn) as last_turn, max(rn) as last_rn from tw group by 1, 2)
select thread_id, win::bigint as "window", id, ms, false as prefix from tw
union all select tw.thread_id, tw.win + 1, tw.id, tw.ms, true from tw join en using (thread_id, win) join en f on f.thread_id = tw.thread_id and f.win = tw.win + 1 where en.last_turn - tw.turn < 3 and en.last_rn - tw.rn < 12""", "events")  # fmt: skip
def reader_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of the event stream for an external reader; SQL finds each window's successor and follows them by recursion."""
    return windows.tile(events_messages(spark, folder), 20, 800)


_TILED = ORACLE_SQL["reader_windows"]
_JOBS = f"""w as ({_TILED}), m as (select w.*, s.me, s.body, '[m' || w.id || '] ' || strftime(make_timestamp(w.ms // 60000 * 60000000), '%Y-%m-%d %H:%M') || case when s.me then ' ME: ' else ' THEM: ' end || trim(regexp_replace(s.body, '\\s*\\n\\s*', ' ', 'g'), ' ') as line
  from w join (select user_id as thread_id, event_id as id, event_type in ('click', 'purchase', 'signup') as me, props as body from events) s using (thread_id, id)),
j as (select thread_id, "window", string_agg(line, chr(10) order by not prefix, ms, id) as transcript, list(id order by not prefix, ms, id) as member_ids, count(*) filter (not prefix) as own, count(*) filter (prefix) as context from m group by 1, 2),
jobs as (select *, sha256(to_json({{'lens': 'tone', 'transcript': transcript}})::varchar) as input_hash from j)"""


def _reader_jobs(spark: SparkSession, folder: str) -> DataFrame:
    messages = events_messages(spark, folder)
    return windows.jobs(messages, windows.tile(messages, 20, 800), "tone")


@query(f"with {_JOBS} select thread_id, \"window\", input_hash, own, context from jobs")
def reader_jobs(spark: SparkSession, folder: str) -> DataFrame:
    context = F.size("prefix_ids").cast("long")
    return _reader_jobs(spark, folder).select("thread_id", "window", "input_hash", (F.size("member_ids") - context).alias("own"), context.alias("context"))


#: Results of a reader: some refused, failed or with another status, some short of a message, with one twice, with one that is foreign, or with a score out of range.
_ANSWERS = "case h % 12 when 0 then 'refused' when 1 then 'failed' when 2 then 'envelope' when 3 then 'missing' when 4 then 'duplicate' when 5 then 'extra' when 6 then 'schema' when 7 then 'unread' end"


def _reader_results(planned: DataFrame) -> DataFrame:
    h = F.conv(F.substring("input_hash", 1, 6), 16, 10).cast("long") % 12
    score = lambda i, bad: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("message_id"), F.lit(0.5).alias("valence"), F.lit(1.0).alias("warmth"), F.when(bad, 7.0).otherwise(2.0).alias("tension"))
    own = F.array_except("member_ids", "prefix_ids")
    ids = F.when(h == 3, F.slice(own, 2, 10_000)).when(h == 4, F.concat(own, F.slice(own, 1, 1))).when(h == 5, F.concat(own, F.array(F.lit(-1).cast("long")))).otherwise(own)
    made = F.transform(F.when(h == 5, F.concat(own, F.array(F.lit(999_999_999).cast("long")))).otherwise(ids), lambda i: score(i, h == 6))
    status = F.when(h == 0, "refused").when(h == 1, "error").when(h == 2, "maybe").otherwise("done")
    return planned.filter(h != 7).select("input_hash", status.alias("status"), made.alias("messages"), F.lit(1).alias("read_at")).dropDuplicates(["input_hash"])


_INTAKE = f"""{_JOBS}, r as (select *, case when why = 'unread' then null when why = 'refused' then 'refused' when why is not null then 'error' else 'done' end as status
  from (select *, {_ANSWERS} as why from (select *, ('0x' || substr(input_hash, 1, 6))::bigint % 12 as h from jobs)))"""


@query(f"with {_INTAKE} select input_hash, any_value(status) as status, any_value(nullif(why, 'unread')) as reason from r where status is not null group by 1")
def reader_intake(spark: SparkSession, folder: str) -> DataFrame:
    planned = kept(_reader_jobs(spark, folder))
    return windows.intake(_reader_results(planned), planned).select("input_hash", "status", "reason")


@query(f"""with {_INTAKE} select thread_id, count(*) filter (status = 'done') as done, count(*) filter (status = 'refused') as refused, count(*) filter (status = 'error') as error, count(*) filter (status is null) as pending,
  ceil(count(*) filter (status is null) / 20)::bigint as drains from r group by 1""")
def reader_status(spark: SparkSession, folder: str) -> DataFrame:
    planned = kept(_reader_jobs(spark, folder))
    return windows.status_counts(windows.intake(_reader_results(planned), planned), planned)


@query(f"with {_INTAKE} select thread_id, \"window\" from r where why = 'unread' or why is not null and why <> 'unread' and h > 2")
def unread_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs that no result stands for, where those that failed a check are read again."""
    planned = kept(_reader_jobs(spark, folder))
    taken = windows.intake(_reader_results(planned), planned).filter("status = 'done' or reason in ('refused', 'failed', 'envelope')")
    return windows.unread_jobs(planned, taken).select("thread_id", "window")


@query(f"""with {_JOBS}, x as (select distinct thread_id, "window" from m where not prefix and ms >= 1705276800000 and ms <= 1705363200000) select thread_id, "window" from x""")
def windows_of_a_day(spark: SparkSession, folder: str) -> DataFrame:
    return windows.windows_in_range(_reader_jobs(spark, folder), events_messages(spark, folder), 1_705_276_800_000, 1_705_363_200_000).select("thread_id", "window")


@query(f"{_EMOTION}, {SPOKEN}, d as (select thread_id, {_NY} // 86400000 as day, count(*) as n, count(*) filter (direction = 'outgoing') as sent, count(*) filter (direction = 'incoming') as received, round(avg(warmth / 3.0), 6) as w, round(avg(tension / 3.0), 6) as t from spoken group by 1, 2) select d.thread_id, d.day, d.n, sent, received, coalesce(em.warmth01, w) as warmth, coalesce(em.tension01, t) as tension, coalesce(em.valence, 0.25)::double + 0.0::double as sentiment from d left join em using (thread_id, day)".replace("make_timestamptz(m.ms * 1000)", "(make_timestamp(m.ms * 1000) at time zone 'UTC')"), "events")
def daily_with_emotion(spark: SparkSession, folder: str) -> DataFrame:
    m = events_messages(spark, folder)
    emotion = scores.emotion_daily(m, scores.message_scores(events_results(spark, folder)), "America/New_York")
    found = scores.daily_with_emotion(metrics.daily(m, "America/New_York").withColumn("sentiment", F.lit(0.25)), emotion)
    return found.withColumn("sentiment", F.col("sentiment") + 0.0)  # no negative zeros


@query(f"{SPOKEN} select distinct thread_id, year(make_timestamp(ms * 1000))::int as era, case when thread_id % 2 = 0 then 'y' || year(make_timestamp(ms * 1000)) end as name from spoken", "orders")
def refreshed_eras(spark: SparkSession, folder: str) -> DataFrame:
    """Eras by year, made anew, with the names that half of the threads had given them."""
    m = orders_messages(spark, folder).filter("not is_reaction")
    fresh = m.select("thread_id", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ms") / DAY).cast("int"))).alias("era")).distinct().withColumn("start_ms", F.unix_date(F.make_date("era", F.lit(1), F.lit(1))).cast("long") * DAY)
    stored = fresh.filter("thread_id % 2 = 0").select("thread_id", "start_ms", F.concat(F.lit("y"), "era").alias("name"), F.lit("told").alias("summary"))
    return identity.refresh_eras(stored, fresh).select("thread_id", "era", "name")


_OWNERS = "case thread_id % 5 when 0 then 'en' when 1 then 'fr' when 2 then 'de' when 3 then 'src1' end"


@query(_GATE + f""", {_LABELS}, bb as (select owner, count(*) filter (tension >= 2 and me) as a, count(*) filter (tension >= 2 and not me) as b, coalesce(avg(hostile::int) filter (tension >= 2 and not me), 0) - coalesce(avg(hostile::int) filter (tension >= 2 and me), 0) as lean from lb where hostile is not null group by 1),
bu as (select owner, floor(case when least(a, b) < 8 then 0.12 when lean > 0.15 then least(0.12, lean * 0.3) else 0 end * 100 + 0.5) / 100 as bump from bb),
ow as (select gs.thread_id, era, a, b, c, 0.5 + coalesce(bump, 0) as threshold from gs left join bu on bu.owner = {_OWNERS})
select thread_id, era, round(threshold, 6)::double as threshold, case when least(a, b, c) >= threshold then 'them' when greatest(a, b, c) <= 1 - threshold then 'me' end as direction from ow""", "orders")
def power_by_owner(spark: SparkSession, folder: str) -> DataFrame:
    totals = _gates(spark, folder).drop("direction", "share_severe", "share_begun", "share_coercive")
    owners = totals.select("thread_id").distinct().withColumn("owner", F.expr(_OWNERS))
    found = gate.owner_gate(totals, owners, gate.self_report_bias(_labels(spark, folder)), 0.5)
    return found.select("thread_id", "era", rounded(F.col("threshold")).alias("threshold"), "direction")


@query(f"""{SCORED}, mk as (select thread_id, id, ms, direction in ('outgoing', 'draft') as me, id % 3 = 0 as hostile from msgs where id % 20 = 0 and id % 60 <> 40),
x as (select mk.*, coalesce(s.tension, 0)::double as tension from mk left join scores s using (thread_id, id))
select thread_id, id, ms, me, round(tension, 6) as tension, hostile, case when tension >= 2 then 'model_harder' else 'owner_harder' end as kind from x where hostile <> (tension >= 2)""", "events")
def calibration_review(spark: SparkSession, folder: str) -> DataFrame:
    m = events_messages(spark, folder)
    marks = m.filter("id % 20 = 0").select(F.lit("me").alias("owner"), "thread_id", "id", F.when(F.col("id") % 60 != 40, F.col("id") % 3 == 0).alias("hostile"))
    none = spark.createDataFrame([], "owner string, hostile int, severe int")
    found = gate.review(marks, m, scores.message_scores(events_results(spark, folder)), none)
    return found.select("thread_id", "id", "ms", "me", rounded(F.col("tension")).alias("tension"), "hostile", "kind")


@query(f"""with {_PEOPLE}, t as (select row_number() over (order by raw) as thread_id, raw from (select distinct raw from ad)), k as (select thread_id, raw, raw = 'me' as mine from t)
select thread_id, case when mine then 'stays' else 'renamed' end as state from k""")
def repaired_threads(spark: SparkSession, folder: str) -> DataFrame:
    """Threads that were made while nobody was known as the owner: the owner goes from their keys, unless nobody else is left."""
    people = _people(spark, folder)
    who = people.select(F.explode("addresses").alias("a")).select(F.col("a.raw").alias("raw")).distinct()
    ranked = who.withColumn("thread_id", F.row_number().over(Window.orderBy("raw")))  # one row a person of the sample tables
    stored = ranked.select("thread_id", F.array_distinct(F.array("raw", F.lit("me"))).alias("keys"), F.concat(F.lit("old-"), "raw").alias("signature"))
    owner = identity.owner_keys(spark.createDataFrame([(1, True)], "contact_id int, is_owner boolean"), spark.createDataFrame([(1, "me", None)], "contact_id int, raw string, e164 string"))
    return identity.repaired_threads(stored, owner).select("thread_id", F.when(F.col("changed"), "renamed").otherwise("stays").alias("state"))


#: Order priorities as sentences with capitals, boosters, negations, contrast and stress.
_SENTENCES = "case id % 6 when 0 then 'VERY ' || lower(body) || '!!' when 1 then 'not so ' || lower(body) when 2 then lower(body) || ' but hardly ' || lower(body) || '??' when 3 then lower(split_part(body, '-', 1)) || ' it is ' || upper(split_part(body, '-', 2)) when 4 then 'never (' || lower(split_part(body, '-', 2)) || ')!!!!!!' else body || '???? ' end"


def _sql_valence() -> str:
    c = valence.Context()
    words = lambda ws: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"
    loud = lambda t: f"({t} = upper({t}) and {t} <> lower({t}))"
    v = f"v + case when mixed and {loud('w[i]')} then sign(v) * 0.733 else 0 end"
    for k, fading in ((1, 1.0), (2, 0.95), (3, 0.9)):
        low = f"lower(w[i - {k}])"
        b = f"(case when i > {k} and {low} in {words(c.stronger)} then 0.293 when i > {k} and {low} in {words(c.weaker)} then -0.293 end)"
        v = f"({v}) + coalesce((sign(v) * {b} + case when mixed and {loud(f'w[i - {k}]')} then sign(v) * 0.733 * sign({b}) else 0 end) * {fading}, 0)"
        v = f"({v}) * case when i > {k} and {low} in {words(c.negations)} then -0.74 else 1 end"
    return v


@query(f"""{SPOKEN}, lx(word, v) as (values {', '.join(f"('{w}', {v}::double)" for w, v in LEXICON)}),
t as (select thread_id, id, ms // 86400000 as day, coalesce(lang = 'en', true) as ok, {_SENTENCES} as body from spoken),
k as (select *, list_filter(list_transform(string_split(trim(regexp_replace(body, '\\s+', ' ', 'g'), ' '), ' '), lambda x: regexp_replace(x, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda x: x <> '') as w from t where ok),
g as (select *, len(list_filter(w, lambda x: x = upper(x) and x <> lower(x))) as loud from k), m as (select *, loud > 0 and loud < len(w) as mixed, coalesce(list_position(list_transform(w, lambda x: lower(x)), 'but'), 0) as but, generate_subscripts(w, 1) as i from g),
x as (select m.*, v from m join lx on lower(w[i]) = word),
y as (select thread_id, day, id, body, sum(({_sql_valence()}) * case when but = 0 or i = but then 1 when i < but then 0.5 else 1.5 end) as s from x group by 1, 2, 3, 4),
z as (select *, length(body) - length(replace(body, '!', '')) as e, length(body) - length(replace(body, '?', '')) as q from y),
c as (select thread_id, day, s + sign(s) * (least(e, 4) * 0.292 + case when q > 3 then 0.96 when q > 1 then q * 0.18 else 0 end) as s from z),
f as (select thread_id, day, s / sqrt(s * s + 15) as c from c),
u as (select thread_id, day, sum(c) as c, sum(greatest(0, c)) as up, sum(greatest(0, -c)) as down from f group by 1, 2), d as (select thread_id, day, count(*) filter (ok) as scored, round(avg(case when ok then 1.0 else 0 end), 6) as english_share from t group by 1, 2)
select thread_id, day, round(coalesce(c, 0) / nullif(scored, 0), 5)::double + 0.0::double as sentiment, round(coalesce(coalesce(up, 0) / nullif(scored, 0), 0), 5)::double as warmth, round(coalesce(coalesce(down, 0) / nullif(scored, 0), 0), 5)::double as tension, scored, english_share from d left join u using (thread_id, day)""", "orders")
def context_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    m = orders_messages(spark, folder).withColumn("body", F.expr(_SENTENCES))
    found = metrics.sentiment(m, spark.createDataFrame(LEXICON, "word string, valence double"), context=valence.Context())
    return found.withColumns({c: F.round(c, 5) + 0.0 for c in ("sentiment", "warmth", "tension")})
