"""Where queries register, with what their SQL statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.tables import answers, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EV_SQL = """ev as (select event_id, user_id, ts, event_type, value, k, k % 2 = 0 as is_correct,
  case k % 3 when 0 then 'sure' when 1 then 'unsure' else 'guess' end as confidence, k // 10 as subject,
  case event_type when 'click' then 'Practice' when 'view' then 'Past papers' when 'purchase' then 'Weekly mock' when 'signup' then 'Daily Dose' else 'Other' end as feature,
  event_type || ':' || strftime(ts, '%Y-%m-%d') as session
  from (select *, try_cast(json_extract_string(props, '$.k') as int) as k from events))"""
MASTERY_SQL = """m as (select user_id, subject, count(*) as n, sum(case when is_correct then case confidence when 'sure' then 1.0::double when 'unsure' then 0.6::double else 0.2::double end else 0.0::double end) / count(*) as mastery
  from ev where ts >= (select max(ts) from ev) - interval 60 days group by 1, 2)"""
FORECAST_SQL = (
    MASTERY_SQL
    + """, w as (select subject, count(*)::double / sum(count(*)) over () as share from ev group by 1),
  f0 as (select user_id, sum(share) as coverage, sum(share * mastery) as s, sum(share * share * mastery * (1 - mastery) / n) as v from m join w using (subject) where n >= 10 group by 1),
  f as (select user_id, round(coverage, 3) as coverage, case when coverage >= 0.3 then round(s / coverage, 3) end as score,
    case when coverage >= 0.3 then round(greatest(0.0, s / coverage - 1.96 * sqrt(v) / coverage), 3) end as low,
    case when coverage >= 0.3 then round(least(1.0, s / coverage + 1.96 * sqrt(v) / coverage), 3) end as high from f0)"""
)


#: SQL of the text that ``files.natural_key`` hashes.
NATURAL_SQL = r"trim(regexp_replace(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x{85}\pZ]+', ' ', 'g'))"


def query(sql: str | None = None):
    """Register a function under its name, with SQL where it has an equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def ev(spark: SparkSession, d: str) -> DataFrame:
    return answers(table(spark, d, "events"))
