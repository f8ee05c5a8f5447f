"""Registry and the SQL text of the panels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearwatch.sources.warehouse import EVENT_MEMBERS, PART_MEMBERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 9) -> DataFrame:
    """Round for comparison with another engine (sums of doubles depend on order)."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _dense_sql(facts: str, measures: str, members: dict, flagged: str, cost: str, etype: str, site: str) -> str:
    rows = ", ".join(f"('{m}', '{f}', '{g}')" for m, (f, g) in members.items())
    return f"""
facts AS ({facts}),
days AS (SELECT d, entity, {measures} FROM facts GROUP BY d, entity),
seen AS (SELECT d, entity, member, max(CASE WHEN {flagged} THEN 1 ELSE 0 END) AS flag, count(*) AS qty,
         max({cost}) AS cost FROM facts GROUP BY d, entity, member),
members(member, family, grade) AS (VALUES {rows}),
panel AS (SELECT days.d, days.entity, {etype} AS etype, {site} AS site, m.member, m.family, m.grade,
  CAST(coalesce(s.flag, 0) AS INTEGER) AS flag, CAST(coalesce(s.qty, 0) AS BIGINT) AS qty,
  coalesce(s.cost, 0.0) AS cost, coalesce(s.cost, 0.0) * coalesce(s.qty, 0) AS amount,
  CASE WHEN s.qty > 0 THEN CASE WHEN s.flag = 1 THEN 'repair' ELSE 'check' END END AS category,
  CAST(CASE WHEN s.qty > 0 THEN 1 ELSE 0 END AS INTEGER) AS observed, m1, m2, m3, m4
  FROM days CROSS JOIN members m
  LEFT JOIN seen s ON s.d = days.d AND s.entity = days.entity AND s.member = m.member)"""


_E_FACTS = "SELECT CAST(ts AS DATE) AS d, user_id AS entity, event_type AS member, value FROM events"
_L_FACTS = """SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey AS entity, p_type AS member, l_quantity,
 l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey"""
_R_FACTS = """SELECT CAST(l_shipdate AS DATE) AS d, CAST(n_regionkey AS BIGINT) AS entity, p_type AS member,
 l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"""
_PART_MEASURES = """round(avg(l_quantity), 6) AS m1, round(avg(l_extendedprice), 6) AS m2,
 round(avg(l_discount), 6) AS m3, round(avg(l_tax), 6) AS m4"""

_DAILY = """,
daily AS (SELECT d, entity, etype, site,
  CAST(sum(flag * CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 2 ELSE 1 END) AS BIGINT) AS points,
  count(*) FILTER (flag = 1 AND grade = 'A') AS "failed_A", count(*) FILTER (flag = 1 AND grade = 'B') AS "failed_B",
  count(*) FILTER (flag = 1 AND grade = 'C') AS "failed_C", CAST(sum(flag) AS BIGINT) AS failed_parts,
  count(*) AS total_parts, sum(CASE WHEN flag = 1 THEN cost ELSE 0 END) AS failed_cost, sum(amount) AS amount,
  max(m1) AS m1, max(m2) AS m2, max(m3) AS m3, max(m4) AS m4
  FROM panel GROUP BY d, entity, etype, site),
fam AS (SELECT d, entity, etype, site, family, count(*) AS total_parts, CAST(sum(flag) AS BIGINT) AS failed_parts,
  count(*) FILTER (flag = 1 AND grade = 'A') AS failed_a_parts, CAST(max(flag) AS INTEGER) AS family_flag,
  CAST(sum(flag) >= 1 AS INTEGER) AS affected,
  CAST(sum(flag) >= 2 OR count(*) FILTER (flag = 1 AND grade = 'A') >= 1 AS INTEGER) AS severe,
  CAST(sum(flag) = count(*) AS INTEGER) AS all_failed, max(m1) AS m1, max(m2) AS m2, max(m3) AS m3, max(m4) AS m4
  FROM panel GROUP BY d, entity, etype, site, family)"""

E_SQL = (
    "WITH"
    + _dense_sql(
        _E_FACTS,
        "CAST(count(*) AS DOUBLE) AS m1, round(avg(value), 6) AS m2, max(value) AS m3, min(value) AS m4",
        EVENT_MEMBERS, "value > 60", "value", "days.entity % 5", "days.entity % 3",
    )
    + _DAILY
)
L_SQL = (
    "WITH"
    + _dense_sql(_L_FACTS, _PART_MEASURES, PART_MEMBERS, "l_returnflag = 'R'", "l_extendedprice", "days.entity % 5", "days.entity % 3")
    + _DAILY
)
R_SQL = (
    "WITH"
    + _dense_sql(_R_FACTS, _PART_MEASURES, PART_MEMBERS, "l_returnflag = 'R'", "l_extendedprice", "days.entity % 2", "CAST(0 AS BIGINT)")
    + _DAILY
)


def severity_sql(score: str, t: int) -> str:
    return (
        f"CASE WHEN {score} = 0 THEN 'normal' WHEN {score} BETWEEN 1 AND 5 THEN 'caution' "
        f"WHEN {score} BETWEEN 6 AND {t - 1} THEN 'risk' ELSE 'high_risk' END"
    )


def code_sql(level: str) -> str:
    return f"CASE {level} WHEN 'normal' THEN 0 WHEN 'caution' THEN 1 WHEN 'risk' THEN 2 ELSE 3 END"


def period_sql(valid: str, test: str, d: str = "d") -> str:
    return f"CASE WHEN {d} < DATE '{valid}' THEN 'train' WHEN {d} < DATE '{test}' THEN 'valid' ELSE 'test' END"
