"""The engine's queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import conflict, metrics, phrase_index, search, threads
from threadloom.plans import lenses  # registers its queries
from threadloom.plans.lenses import SENTIMENT
from threadloom.plans.registry import DAY, LOCAL_MS, MONTH, ORACLE_SQL, QUERIES, SPOKEN, SUBSTANTIVE, answers_sql, episodes_sql, query  # noqa: F401
from threadloom.sources.tables import HOUR_MS, conversation_messages, events_messages, orders_messages, scratch, table, uneven_messages
from threadloom.sources.versions import Store


@query(f"""{SPOKEN},
s as (select *, coalesce(ms - lag(ms) over w > 43200000, true) as begins from spoken window w as (partition by thread_id order by ms, id)),
c as (select thread_id, count(*) as total, count(*) filter (direction = 'outgoing') as sent, count(*) filter (direction = 'incoming') as received,
  round(avg(case when direction = 'outgoing' then 1.0 else 0 end), 6) as sent_share, min(ms) as first_ms, max(ms) as last_ms,
  round(avg(case when ms % 86400000 < 18000000 then 1.0 else 0 end), 6) as late_share, count(*) filter (begins) as sessions,
  count(*) filter (begins and direction = 'outgoing') as opened_by_you, count(*) filter (begins and direction = 'incoming') as opened_by_them,
  round(count(*) / count(*) filter (begins), 6) as session_messages from s group by 1),
r as (select *, lag(direction) over w as was, (ms - lag(ms) over w) / 60000.0 as minutes from spoken where direction in ('outgoing', 'incoming') window w as (partition by thread_id order by ms, id)),
q as (select thread_id,
  round(quantile_cont(cast(minutes as double), 0.5) filter (direction = 'outgoing'), 6) as you_median, round(quantile_cont(cast(minutes as double), 0.9) filter (direction = 'outgoing'), 6) as you_p90,
  round(quantile_cont(cast(minutes as double), 0.5) filter (direction = 'incoming'), 6) as them_median, round(quantile_cont(cast(minutes as double), 0.9) filter (direction = 'incoming'), 6) as them_p90
  from r where was <> direction group by 1)
select * from c left join q using (thread_id)""", "events")  # fmt: skip
def thread_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.summary(events_messages(spark, folder), 12 * HOUR_MS)


@query(f"""{SPOKEN}
select thread_id, ms // 86400000 as day, count(*) as n, count(*) filter (direction = 'outgoing') as sent, count(*) filter (direction = 'incoming') as received,
  round(avg(warmth / 3.0), 6) as warmth, round(avg(tension / 3.0), 6) as tension from spoken group by 1, 2""", "events")
def daily_series(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.daily(events_messages(spark, folder))


@query(f"""{SPOKEN},
c as (select thread_id, cast((ms // 86400000 + 4) % 7 as int) as dow, cast(ms % 86400000 // 3600000 as int) as hour, count(*) as n from spoken group by 1, 2, 3),
g as (select thread_id, cast(d.d as int) as dow, cast(h.h as int) as hour from (select distinct thread_id from spoken), range(7) d(d), range(24) h(h))
select thread_id, dow, hour, coalesce(n, 0) as n from g left join c using (thread_id, dow, hour)""", "events")
def hour_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.heatmap(events_messages(spark, folder))


@query(f"""{SPOKEN},
d as (select distinct thread_id, ms // 86400000 as day from spoken),
i as (select *, day - lag(day) over w - 1 as silence, day - row_number() over w as island from d window w as (partition by thread_id order by day)),
r as (select thread_id, island, count(*) as length, max(silence) as silence from i group by 1, 2)
select thread_id, cast(sum(length) as bigint) as active_days, max(length) as longest_streak, coalesce(max(silence), 0) as longest_silence from r group by 1""", "events")
def activity_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.streaks(events_messages(spark, folder))


@query(f"""{SPOKEN},
t as (select thread_id, direction, trim(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g')) as b, regexp_extract_all(lower(coalesce(body, '')), '[a-z][a-z'']*') as w from spoken),
c as (select thread_id, direction, case when b = '' then 0 else len(string_split(b, ' ')) end as words, case when contains(b, '?') then 1.0 else 0 end as asks,
  len(regexp_extract_all(' ' || array_to_string(w, '  ') || ' ', ' (we|we''re|we''ve|we''ll|we''d|us|ours?|ourselves) ')) as we,
  len(regexp_extract_all(' ' || array_to_string(w, '  ') || ' ', ' (i|i''m|i''ve|i''ll|i''d|im|ive|me|my|mine|myself|you|you''re|you''ve|you''ll|you''d|yours?|yourself|yourselves|u|ya) ')) as other from t)
select thread_id, direction, count(*) as n, round(avg(words), 6) as avg_words, round(avg(asks), 6) as question_share,
  round(case when sum(we) + sum(other) > 0 then sum(we) / (sum(we) + sum(other)) end, 6) as we_ratio from c group by 1, 2""", "conversations")
def wording(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.wording(conversation_messages(spark, folder))


@query(f"""{SUBSTANTIVE},
w as (select thread_id, me, ms, id, regexp_extract_all(lower(body), '[a-z'']{{3,}}') as words from sub),
e as (select thread_id, me, ms, id, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
c as (select thread_id, me, word, count(*) as n, min((ms, id, pos)) as seen from e group by 1, 2, 3),
r as (select *, row_number() over (partition by thread_id, me order by n desc, seen) as place from c)
select thread_id, me, word, n, cast(place as int) as place from r where place <= 30""", "conversations")
def top_words(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.top_words(conversation_messages(spark, folder))


@query(f"""{SUBSTANTIVE},
l as (select *, lag(me) over w as was, ms - lag(ms) over w as gap, lag(id) over d is null as first, lead(id) over d is null as last from sub
  window w as (partition by thread_id order by ms, id), d as (partition by thread_id, {LOCAL_MS} // 86400000 order by ms, id)),
a as (select *, coalesce(was <> me and gap > 0 and gap <= 21600000, false) as answered, coalesce(was = me, false) as again from l)
select thread_id, coalesce(floor(quantile_cont(gap / 60000.0::double, 0.5) filter (answered and me) * 10 + 0.5) / 10, 0) as median_me, coalesce(floor(quantile_cont(gap / 60000.0::double, 0.5) filter (answered and not me) * 10 + 0.5) / 10, 0) as median_them,
  count(*) filter (first and me) as first_me, count(*) filter (first and not me) as first_them, count(*) filter (last and me) as last_me, count(*) filter (last and not me) as last_them,
  round(count(*) filter (again and me) / greatest(count(*) filter (me), 1), 3) as double_me, round(count(*) filter (again and not me) / greatest(count(*) filter (not me), 1), 3) as double_them
from a group by 1""", "events")  # fmt: skip
def replies_by_side(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.replies_by_side(events_messages(spark, folder), zone="America/New_York")


_REFRESHED = f"""{SPOKEN}, d as (select thread_id, count(distinct ms // 86400000)::bigint as active_days, count(*) as n from spoken group by 1),
st as (select thread_id, case when thread_id % 7 = 0 then 'new' when thread_id % 4 = 0 then 'changed' else 'kept' end as status from (select distinct thread_id from msgs) union all select 1000001, 'removed')"""


def _refreshed(spark: SparkSession, folder: str) -> tuple[Store, DataFrame]:
    """A table of each thread's days, of an older state of the events first (threads missing, others with fewer messages, one since gone), then of the events."""
    m = events_messages(spark, folder)
    gone = m.limit(1).withColumn("thread_id", F.lit(1_000_001).cast(m.schema["thread_id"].dataType))
    older = m.filter("thread_id % 7 <> 0").filter("thread_id % 4 <> 0 or id % 3 <> 0").unionByName(gone)
    made = lambda rows: metrics.daily(rows).groupBy("thread_id").agg(F.count(F.lit(1)).alias("active_days"), F.sum("n").alias("n"))
    store, _ = metrics.refreshed(Store(spark, scratch(spark, "metrics")), "days", older, made)
    return metrics.refreshed(store, "days", m, made)


@query(_REFRESHED + " select thread_id, active_days, n from d", "events")
def refreshed_days(spark: SparkSession, folder: str) -> DataFrame:
    return _refreshed(spark, folder)[0].read("days")


@query(_REFRESHED + " select thread_id::bigint as thread_id, status from st", "events")
def refreshed_states(spark: SparkSession, folder: str) -> DataFrame:
    return _refreshed(spark, folder)[1].select(F.col("thread_id").cast("long").alias("thread_id"), "status")


@query(f"{SUBSTANTIVE}, {episodes_sql(DAY, 3)} select * from ep", "events")
def episodes(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.episodes(events_messages(spark, folder), DAY, 3)


@query(f"{SUBSTANTIVE}, {episodes_sql(5 * DAY, 3)} select * from ep", "orders")
def episodes_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.episodes(orders_messages(spark, folder), 5 * DAY, 3)


@query(f"{SUBSTANTIVE}, {answers_sql(DAY, MONTH, 'month')} select * from rc", "orders")
def trajectory(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.reciprocation(orders_messages(spark, folder), conflict.month(), "month", DAY)


QUARTER = "year(make_timestamp(ms * 1000)) || '-Q' || quarter(make_timestamp(ms * 1000))"


@query(f"""{SUBSTANTIVE}, {answers_sql(2 * HOUR_MS, QUARTER, 'quarter')}
select thread_id, quarter, n_me, hostile_me, severe_me, round(coalesce(hostile_me / nullif(n_me, 0), 0), 6) as hostile_share, round(coalesce(severe_me / nullif(n_me, 0), 0), 6) as severe_share,
  asked, returned, softened, withdrew, round(coalesce(returned / nullif(asked, 0), 0), 6) as returned_rate, round(coalesce(withdrew / nullif(asked, 0), 0), 6) as withdrew_rate from rc""", "events")
def growth_quarterly(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.growth(events_messages(spark, folder))


@query(f"{SUBSTANTIVE} select thread_id, ms // 86400000 as day, count(*) as hostile from sub where tension >= 2 and not me group by 1, 2 having count(*) >= 2", "events")
def deluge_days(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.deluge_days(events_messages(spark, folder), 2)


_Z = ", ".join(f"case when stddev_pop({c}) over t > 1e-12 then round(({c} - avg({c}) over t) / stddev_pop({c}) over t, 4) else 0 end as z_{c}" for c in conflict.FEATURES)
_MONTHLY = f"""{SUBSTANTIVE}, {episodes_sql(5 * DAY, 3)}, {answers_sql(DAY, MONTH, 'month')},
em as (select thread_id, strftime(make_timestamp(start_ms * 1000), '%Y-%m') as month, avg(case when begun_by_me then 0.0 else 1 end) as begun, median((repair_ms - end_ms) / 3600000.0) as repair from ep group by 1, 2),
k as (select thread_id, month, n_me + n_them as n_total, n_them / (n_me + n_them) as share_them, coalesce(hostile_me / nullif(n_me, 0), 0) as hostile_share_me, coalesce(hostile_them / nullif(n_them, 0), 0) as hostile_share_them,
  coalesce(returned / nullif(returned + softened, 0), 0) as returned_rate, begun, repair from rc left join em using (thread_id, month)),
v as (select * exclude (begun, repair), coalesce(last_value(begun ignore nulls) over o, avg(begun) over t, 0) as begun_share_them, coalesce(last_value(repair ignore nulls) over o, avg(repair) over t, 0) as repair_hours
  from k window t as (partition by thread_id), o as (partition by thread_id order by month rows unbounded preceding))"""


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    messages = conflict.marked_once(orders_messages(spark, folder))
    return conflict.monthly_series(messages, conflict.episodes(messages, 5 * DAY, 3), DAY)


@query(_MONTHLY + f"select thread_id, month, {', '.join(f'round({c}, 5) as {c}' for c in conflict.FEATURES)}, {_Z} from v window t as (partition by thread_id)", "orders")
def monthly_series(spark: SparkSession, folder: str) -> DataFrame:
    series = _monthly(spark, folder)
    return series.select("thread_id", "month", *[F.round(c, 5).alias(c) for c in conflict.FEATURES], *[F.round(f"z_{c}", 4).alias(f"z_{c}") for c in conflict.FEATURES])


#: Every segment's best split from running sums, then the splits made one after another by recursion.
_ERAS = f"""
u as (unpivot (select thread_id, month, n_total::double as n_total, {', '.join(f'{c}::double as {c}' for c in conflict.FEATURES[1:])} from v) on {', '.join(conflict.FEATURES)} into name f value x),
z as (select thread_id, month, f, case when stddev_pop(x) over w > 1e-12 then (x - avg(x) over w) / stddev_pop(x) over w else 0 end as x from u window w as (partition by thread_id, f)),
pr as (select thread_id, f, row_number() over w as i, sum(x) over w as s1, sum(x * x) over w as s2 from z window w as (partition by thread_id, f order by month) union all select distinct thread_id, f, 0, 0.0, 0.0 from z),
ca as (select a.thread_id, a.i as a, b.i as b, c.i as c, avg(abs((c.s1 - a.s1) / (c.i - a.i) - (b.s1 - c.s1) / (b.i - c.i)) / greatest(sqrt(greatest(b.s2 - a.s2 - pow(c.s1 - a.s1, 2) / (c.i - a.i) - pow(b.s1 - c.s1, 2) / (b.i - c.i), 0) / (b.i - a.i)), 1e-6)) as score
  from pr a join pr c on c.thread_id = a.thread_id and c.f = a.f and c.i >= a.i + 4 join pr b on b.thread_id = a.thread_id and b.f = a.f and b.i >= c.i + 4 group by 1, 2, 3, 4),
be as (select thread_id, a, b, arg_max(c, (round(score, 9), -c)) as cut, arg_max(score, (round(score, 9), -c)) as score from ca group by 1, 2, 3),
st as (select thread_id, 1 as k, [0::bigint] as starts, count(*) as n from v group by 1
  union all select q.thread_id, q.k + 1, list_sort(list_append(any_value(q.starts), arg_max(cut, (score, -a)))), q.n from (select *, unnest(range(1, len(starts) + 1)) as j from st where len(starts) < 6) q
  join be on be.thread_id = q.thread_id and be.a = q.starts[j] and be.b = coalesce(q.starts[j + 1], q.n) group by q.thread_id, q.k, q.n having max(score) > 0.75),
fi as (select thread_id, arg_max(starts, k) as starts, any_value(n) as n from st group by 1), sg as (select thread_id, j - 1 as era, starts[j] as a, coalesce(starts[j + 1], n) as b from (select *, unnest(range(1, len(starts) + 1)) as j from fi)),
ro as (select *, row_number() over (partition by thread_id order by month) - 1 as i from v)"""


@query(_MONTHLY + "," + _ERAS + f""" select sg.thread_id, era::int as era, min(month) as first_month, max(month) as last_month, count(*)::int as months, {', '.join(f'round(avg({c}), 6)::double as {c}' for c in conflict.FEATURES)},
  epoch_ms(strptime(min(month) || '-01', '%Y-%m-%d')) as start_ms, epoch_ms(strptime(max(month) || '-01', '%Y-%m-%d') + interval 1 month) - 1 as end_ms from sg join ro on ro.thread_id = sg.thread_id and i >= a and i < b group by 1, 2""", "orders")  # fmt: skip
def eras(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.eras(_monthly(spark, folder))


@query(_MONTHLY + f""",
u as (unpivot (select thread_id, month, n_total::double as n_total, {', '.join(f'{c}::double as {c}' for c in conflict.FEATURES[1:])} from v) on {', '.join(conflict.FEATURES)} into name f value x),
z as (select thread_id, month, f, case when stddev_pop(x) over w > 1e-12 then (x - avg(x) over w) / stddev_pop(x) over w else 0 end as x from u window w as (partition by thread_id, f)),
c as (select *, row_number() over w as i, count(*) over (partition by thread_id, f) as n, avg(x) over (w rows unbounded preceding) as ml, stddev_pop(x) over (w rows unbounded preceding) as sl,
  avg(x) over v as mr, stddev_pop(x) over v as sr from z window w as (partition by thread_id, f order by month), v as (partition by thread_id, f order by month desc rows unbounded preceding exclude current row)),
s as (select thread_id, i, lead_month, avg(abs(ml - mr) / greatest(sqrt((i * sl * sl + (n - i) * sr * sr) / n), 1e-6)) as score from (select *, lead(month) over (partition by thread_id, f order by month) as lead_month from c) where i >= 4 and n - i >= 4 group by 1, 2, 3)
select thread_id, arg_max(lead_month, (round(score, 9), -i)) as first_cut, round(max(score), 4) as score from s group by 1 having max(score) > 0.75""", "orders")  # fmt: skip
def first_era_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The first cut of `eras`, which SQL can find by trying every month: the later ones follow from it within its halves."""
    return conflict.first_cuts(_monthly(spark, folder)).select("thread_id", "first_cut", F.round("score", 4).alias("score"))


@query(f"""{SPOKEN},
g as (select *, ms - lag(ms) over w as gap, lag(ms) over w as prev from msgs window w as (partition by thread_id order by ms, id)),
x as (select thread_id, count(*) as n, max(gap) as gap_ms from g group by 1),
y as (select x.thread_id, x.n, gap_ms, min(prev) as since from x left join g on g.thread_id = x.thread_id and gap = gap_ms group by 1, 2, 3),
c as (select y.*, (select count(*) from msgs m where m.thread_id = y.thread_id and m.ms <= since and m.ms > since - 3 * 86400000) as busy from y)
select thread_id, n, gap_ms, case when n < 10 or busy < 2 or gap_ms < 3 * 86400000 or gap_ms is null then 1.0 when gap_ms < 4 * 86400000 then 0.6 else 0.4 end::double as confidence from c""", "events")
def thread_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.coverage(events_messages(spark, folder), 3, 4, 2)


@query("""
c as (select *, coalesce(lag(direction) over w <> direction, true) as c from msgs window w as (partition by thread_id order by ms, id)),
t as (select *, sum(c::int) over (partition by thread_id order by ms, id) as turn from c)
select thread_id, cast(turn as bigint) as turn, direction, count(*) as messages, min(ms) as start_ms, max(ms) as end_ms from t group by 1, 2, 3""", "conversations")
def speaker_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.turns(conversation_messages(spark, folder))


RIVER = f"""{SPOKEN}, d as (select thread_id, ms // 86400000 as day, count(*) as n from spoken group by 1, 2),
h as (select thread_id, min(day) as a, max(day) as b, floor(least(45.0, greatest(7.0, (max(day) - min(day) + 1) / 70)) / 2 + 0.5)::int as half from d group by 1),
s as (select thread_id, half, unnest(range(a, b + 1)) as day from h),
f as (select thread_id, half, day, coalesce(n, 0) as n from s left join d using (thread_id, day))"""


@query(RIVER + """ select x.thread_id, x.day, x.n, x.half, round(avg(y.n), 6) as smooth from f x join f y on x.thread_id = y.thread_id and y.day >= x.day - x.half and y.day <= x.day + x.half group by 1, 2, 3, 4""", "events")
def river(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.rolling(metrics.daily(events_messages(spark, folder)))


@query(RIVER + """, r as (select *, sum(case when n > 0 then 1 else 0 end) over (partition by thread_id order by day) as grp from f)
select thread_id, min(day) as first, max(day) as last, count(*) as days from r where n = 0 group by thread_id, grp, half having count(*) >= greatest(14, 2 * half)""", "uneven")
def river_silences(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.silences(metrics.daily(uneven_messages(spark, folder)))


@query(RIVER + """, m as (select x.thread_id, x.day, x.n, x.half, round(avg(y.n), 6) as smooth from f x join f y on x.thread_id = y.thread_id and y.day >= x.day - x.half and y.day <= x.day + x.half group by 1, 2, 3, 4),
l as (select thread_id, list_sort(list(smooth)) as v from m group by 1)
select thread_id, day, n, half, smooth, round(least(1.0, smooth / greatest(v[floor((len(v) - 1) * 0.95 + 0.5)::int + 1], 1e-6)), 6)::double as scaled from m join l using (thread_id)""", "events")
def river_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.scaled(conflict.rolling(metrics.daily(events_messages(spark, folder))), "smooth")


@query(SENTIMENT + """, mv as (select *, abs(sentiment - lag(sentiment) over (partition by thread_id order by day)) as c from dy where sentiment is not null),
y as (select d.thread_id, case when count(mv.thread_id) >= 5 then avg(c) end as c from (select distinct thread_id from dy) d left join mv using (thread_id) group by 1)
select thread_id, round(c, 6) as change, case when c < 0.18 then 'steady' when c < 0.34 then 'gentle swings' when c is not null then 'changeable' else 'too little to say' end as phrase from y""", "orders")
def steadiness(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.steadiness(lenses.lexicon_sentiment(spark, folder))


@query(RIVER + """ select thread_id, f.day, ((f.day - (a - (a + 4) % 7)) // 7)::int as week, dayofweek(date '1970-01-01' + f.day::int)::int as dow, n from f join h using (thread_id)""", "events")
def calendar_grid(spark: SparkSession, folder: str) -> DataFrame:
    return conflict.calendar(metrics.daily(events_messages(spark, folder)))


@query("""with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents),
m as (select doc_id, len(w)::int as length, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the'))::int as hits from t),
s as (select count(*) as docs, avg(length) as mean, count(*) filter (hits > 0) as n from m)
select doc_id, hits, length, round(ln(1 + (docs - n + 0.5) / (n + 0.5)) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * length / mean)), 6) as score from m, s where hits > 0""")
def phrase_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.phrase_search(table(spark, folder, "documents"), "of the")


_INDEXED = """with t as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
m as (select doc_id, len(w)::int as length, len(list_filter(range(1, len(w)), lambda i: w[i] = '%s' and w[i + 1] = '%s'))::int as hits from t),
s as (select count(*) as docs, sum(length) / count(*) as mean, count(*) filter (hits > 0) as n from m)
select doc_id, hits, length, round(ln(1 + (docs - n + 0.5) / (n + 0.5)) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * length / mean)), 6) as score from m, s where hits > 0"""


def _indexed(spark: SparkSession, folder: str) -> Store:
    """An index of documents in two loads: a fifth of the texts come wrong first, and again."""
    documents = table(spark, folder, "documents")
    first = documents.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("of the of the "), F.reverse("text"))).otherwise(F.col("text")))
    store = phrase_index.upsert(Store(spark, scratch(spark, "index")), first)
    return phrase_index.upsert(store, documents.filter("doc_id % 5 = 0"))


@query(_INDEXED % ("of", "the"))
def indexed_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_index.phrase_search(_indexed(spark, folder), "Of the")


@query(_INDEXED % ("de", "e"))
def indexed_phrase_without_accents(spark: SparkSession, folder: str) -> DataFrame:
    """The phrase is met with and without accents."""
    return phrase_index.phrase_search(_indexed(spark, folder), "dé Ê")


@query("""with m as (select distinct o_custkey, cast(o_orderpriority as varchar) as p from orders)
select o_custkey, cast(count(*) as int) as members, sha256(string_agg(p, ',' order by p)) as signature from m group by 1""")
def participant_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return search.signatures(table(spark, folder, "orders"), "o_custkey", "o_orderpriority")


@query("""n as (select *, (row_number() over (partition by thread_id order by ms, id) - 1) // 4 as piece from msgs),
p as (select thread_id, piece, count(*) as lines, sha256(string_agg(ms || '|' || direction || '|' || coalesce(body, ''), chr(10) order by ms, id)) as d from n group by 1, 2)
select thread_id, cast(sum(lines) as bigint) as lines, sha256(string_agg(d, '' order by piece)) as digest from p group by 1""", "conversations")
def export_digests(spark: SparkSession, folder: str) -> DataFrame:
    return search.chained_digest(search.export_digests(conversation_messages(spark, folder), 4))


@query("""p as (select *, row_number() over (partition by thread_id order by ms desc, id desc) as n from msgs where ms < 1705276800000) select * exclude (n) from p where n <= 20""", "events")
def message_page(spark: SparkSession, folder: str) -> DataFrame:
    return search.page(events_messages(spark, folder), 1_705_276_800_000, 20)


@query("""with d as (select n_chars, toxic from documents join labels using (doc_id)), r as (select *, unnest([200.0, 500.0, 1000.0, 2000.0]::double[]) as cut from d),
c as (select cut, count(*) filter (n_chars >= cut and toxic = 1) as tp, count(*) filter (n_chars >= cut and toxic <> 1) as fp, count(*) filter (n_chars < cut and toxic = 1) as fn from r group by 1)
select *, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c""")
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return search.thresholds(labelled, "n_chars", "toxic", [200.0, 500.0, 1000.0, 2000.0])


@query("""with m as (select distinct s_nationkey as t, l_partkey as p from lineitem join supplier on l_suppkey = s_suppkey where l_partkey <> 1)
select a.t as s_nationkey, count(distinct b.t) as related from m a join m b on a.p = b.p and a.t <> b.t group by 1""")
def related_threads(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "lineitem").join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return search.related_threads(parts, "s_nationkey", "l_partkey", 1)


@query("""with n as (select source, lang, count(*) as n from documents where lang is not null group by 1, 2)
select source, arg_min(lang, (-n, lang)) as lang, max(n) as n from n group by 1""")
def primary_language(spark: SparkSession, folder: str) -> DataFrame:
    return threads.primary_language(table(spark, folder, "documents"), "source")


@query("""with k as (select doc_id, coalesce(source, '') as c, lang as d, (n_chars * 60 + doc_id % 3) * 1000 as ms, sha256(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\\s+', ' ', 'g'), ' ')) as body from documents),
o as (select *, cast(dense_rank() over (partition by c, d, ms // 60000, body order by ms) - 1 as int) as occurrence from k)
select doc_id, occurrence, sha256(to_json([c, d]) || '|' || (ms // 60000) || '|' || body || '|' || occurrence) as dedup_key from o""")
def dedup_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "documents").select("doc_id", "source", F.col("lang").alias("direction"), ((F.col("n_chars") * 60 + F.col("doc_id") % 3) * 1000).alias("ms"), F.col("text").alias("body"))
    return threads.dedup_keys(messages, "source").select("doc_id", "occurrence", "dedup_key")


@query("""with k as (select doc_id, coalesce(source, '') as c, sha256(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\\s+', ' ', 'g'), ' ')) as body from documents),
o as (select *, cast(row_number() over (partition by c, body order by 'id:' || doc_id) - 1 as int) as occurrence from k)
select doc_id, occurrence, sha256(to_json([c, 'other']) || '|0|' || body || '|' || occurrence) as dedup_key from o""")
def content_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as messages of no time, each with an identity of its own."""
    messages = table(spark, folder, "documents").select("doc_id", "source", F.lit("other").alias("direction"), F.lit(0).cast("long").alias("ms"), F.col("text").alias("body"))
    return threads.dedup_keys(messages, "source", native="doc_id").select("doc_id", "occurrence", "dedup_key")
