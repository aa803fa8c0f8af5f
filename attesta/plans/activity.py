"""Queries over the activity log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.operators import sessions
from attesta.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_bounds(table(spark, folder, "activity"))


def p2_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch with its start, end, duration, calls and calls per tool."""
    return sessions.sessionize(table(spark, folder, "activity"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_sessions)}


STRETCHES = r"""
with calls as (
  select distinct on (id) id, coalesce(tool, '') as tool, lower(regexp_replace(session, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) as session,
    epoch_us(at_ts) as e, epoch_us(at_ts) - greatest(coalesce(duration_ms, 0), 0)::bigint * 1000 as s
  from activity where at_ts is not null),
seen as (
  select *, max(e) over (partition by session order by s, id rows between unbounded preceding and 1 preceding) as reach
  from calls where session is not null and session <> ''),
numbered as (
  select *, sum(case when s > reach + 1800000000 then 1 else 0 end) over (partition by session order by s, id rows unbounded preceding) as nth
  from seen)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": STRETCHES + "select session, arg_min(id, (s, id)) as first_id, arg_max(id, (e, id)) as last_id from numbered group by session, nth",
        "p2_sessions": STRETCHES + """,
tools as (select session, nth, string_agg(tool || '=' || n, ',' order by tool || '=' || n) as tools
  from (select session, nth, tool, count(*) as n from numbered group by all) group by all)
select session, arg_min(id, (s, id)) as first_id, arg_max(id, (e, id)) as last_id, make_timestamptz(min(s)) as started_at,
  make_timestamptz(max(e)) as ended_at, max(e) - min(s) as duration_us, count(*) as calls, any_value(tools) as tools
from numbered join tools using (session, nth) group by session, nth""",
    }
