"""Where queries register under their names, with the same in DuckDB's SQL, and the SQL that several of them begin with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.sources.tables import HOUR_MS, SQL

DAY = 24 * HOUR_MS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str | None = None):
    """Register a function under its name, with SQL that may build on an adapter's `msgs`."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with recursive {SQL[base]}, {sql}" if base else sql
        return f

    return add


SPOKEN = "spoken as (select * from msgs where not is_reaction)"
SUBSTANTIVE = "sub as (select *, direction in ('outgoing', 'draft') as me from msgs where not is_reaction and trim(coalesce(body, ''), ' ') <> '')"
LOCAL_MS = "epoch_ms((make_timestamp(ms * 1000) at time zone 'UTC') at time zone 'America/New_York')"
MONTH = "strftime(make_timestamp(ms * 1000), '%Y-%m')"


def episodes_sql(gap: int, least: int) -> str:
    """ep, the episodes of sub."""
    return f"""f as (select *, row_number() over w as rn from sub window w as (partition by thread_id order by ms, id)),
nx as (select *, last_value(case when warmth >= 2 then {{'ms': ms, 'me': me}} end ignore nulls) over (partition by thread_id order by rn desc rows unbounded preceding exclude current row) as warm from f),
h as (select *, coalesce(ms - lag(ms) over (partition by thread_id order by rn) > {gap}, true) as begins from nx where tension >= 2),
g as (select *, sum(begins::int) over (partition by thread_id order by rn) as episode from h),
x as (select thread_id, min(ms) as start_ms, max(ms) as end_ms, arg_min(id, rn) as start_id, count(*) as hostile, count(*) filter (me) as hostile_me, count(*) filter (not me) as hostile_them,
  count(*) filter (tension >= 3 and me) as severe_me, count(*) filter (tension >= 3 and not me) as severe_them, max(tension) as peak, arg_min(me, rn) as begun_by_me, arg_max(me, rn) as ended_by_me,
  cast(max(rn) - min(rn) + 1 as int) as msg_count, max_by({{'v': warm}}, rn).v as warm from g group by thread_id, episode having count(*) >= {least}),
ep as (select * exclude (warm), coalesce(warm.ms - end_ms <= 86400000, false) as repaired, case when warm.ms - end_ms <= 86400000 then warm.ms end as repair_ms,
  case when warm.ms - end_ms <= 86400000 then warm.me end as repaired_by_me from x)"""  # fmt: skip


def answers_sql(within: int, period: str, name: str) -> str:
    """rc, counts of sub by thread and period, and how hostility was answered."""
    return f"""n as (select *, last_value(case when me then {{'ms': ms, 't': tension}} end ignore nulls) over (partition by thread_id order by ms desc, id desc rows unbounded preceding exclude current row) as nxt from sub),
a as (select *, case when nxt.ms - ms <= {within} then nxt.t end as answer from n),
rc as (select thread_id, {period} as {name}, count(*) filter (me) as n_me, count(*) filter (not me) as n_them, count(*) filter (me and tension >= 2) as hostile_me, count(*) filter (not me and tension >= 2) as hostile_them,
  count(*) filter (me and tension >= 3) as severe_me, count(*) filter (not me and tension >= 3) as severe_them, count(*) filter (me and warmth >= 2) as warm_me, count(*) filter (not me and warmth >= 2) as warm_them,
  count(*) filter (not me and tension >= 2) as asked, count(*) filter (not me and tension >= 2 and answer >= 2) as returned,
  count(*) filter (not me and tension >= 2 and answer < 2) as softened, count(*) filter (not me and tension >= 2 and answer is null) as withdrew from a group by 1, 2)"""  # fmt: skip
