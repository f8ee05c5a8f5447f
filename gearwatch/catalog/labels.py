"""Labels, splits and the tables that describe them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import E_SQL, L_SQL, R_SQL, period_sql, query, rounded
from gearwatch.catalog.history import _range
from gearwatch.operators import labels as L
from gearwatch.operators import rollups as U
from gearwatch.operators import splits as S
from gearwatch.operators.history import strict_flag_history
from gearwatch.operators.joins import scope_rows
from gearwatch.functions.expressions import SEVERITY_LEVELS, ratio
from gearwatch.sources.warehouse import EVENT_SPLIT, PART_SPLIT, events_panel, region_panel, supplier_panel

EM = "entity, member"


def ahead(by: str, days: int) -> str:
    return _range(1, days).format(by=by)


def binary_sql(flag: str, by: str, days: int) -> str:
    w = ahead(by, days)
    return f"CASE WHEN count({flag}) OVER {w} = {days} THEN CAST(max({flag}) OVER {w} AS INTEGER) END"


@query(
    "label_binary_h",
    R_SQL + f""" SELECT d, entity, member, {binary_sql('flag', EM, 7)} AS target,
 count(flag) OVER {ahead(EM, 7)} = 7 AS future_complete, CAST(d + INTERVAL 7 DAY AS DATE) AS label_end FROM panel""",
)
def label_binary_h(spark, sf):
    p = region_panel(spark, sf).select("d", "entity", "member", "flag")
    return L.future_label(p, ["entity", "member"], "d", "flag", 7, "binary").drop("flag")


@query(
    "label_binary_gaps",
    L_SQL + f""" SELECT d, entity, member, {binary_sql('flag', EM, 2)} AS target,
 count(flag) OVER {ahead(EM, 2)} = 2 AS future_complete, CAST(d + INTERVAL 2 DAY AS DATE) AS label_end FROM panel""",
)
def label_binary_gaps(spark, sf):
    p = supplier_panel(spark, sf).select("d", "entity", "member", "flag")
    return L.future_label(p, ["entity", "member"], "d", "flag", 2, "binary").drop("flag")


@query(
    "label_count_h",
    R_SQL + f""" SELECT d, entity, member, CASE WHEN count(flag) OVER {ahead(EM, 7)} = 7
 THEN CAST(sum(flag) OVER {ahead(EM, 7)} AS INTEGER) END AS target FROM panel""",
)
def label_count_h(spark, sf):
    p = region_panel(spark, sf).select("d", "entity", "member", "flag")
    return L.future_label(p, ["entity", "member"], "d", "flag", 7, "count").select("d", "entity", "member", "target")


@query(
    "label_first_class",
    R_SQL + f""", x AS (SELECT d, entity, member, count(flag) OVER {ahead(EM, 7)} = 7 AS ok,
 date_diff('day', d, min(CASE WHEN flag = 1 THEN d END) OVER {ahead(EM, 7)}) AS wait FROM panel)
 SELECT d, entity, member, CAST(CASE WHEN ok THEN CASE WHEN wait IS NULL THEN 0 WHEN wait = 1 THEN 3 WHEN wait <= 3 THEN 2 ELSE 1 END END AS INTEGER) AS target FROM x""",
)
def label_first_class(spark, sf):
    p = region_panel(spark, sf).select("d", "entity", "member", "flag")
    return L.future_label(p, ["entity", "member"], "d", "flag", 7, "first").select("d", "entity", "member", "target")


@query(
    "label_new_any",
    E_SQL + f""", x AS (SELECT *, CAST(points >= 7 AS INTEGER) AS risk_today FROM daily),
 y AS (SELECT d, entity, risk_today, {binary_sql('risk_today', 'entity', 3)} AS target FROM x)
 SELECT 'any' AS mode, * FROM y UNION ALL SELECT 'new' AS mode, * FROM y WHERE risk_today = 0""",
)
def label_new_any(spark, sf):
    daily = U.entity_daily(events_panel(spark, sf)).select("d", "entity", "points")
    parts = [
        L.entity_forecast_label(daily, ["entity"], "d", "points", 7, 3, mode).select(
            F.lit(mode).alias("mode"), "d", "entity", "risk_today", "target"
        )
        for mode in ("any", "new")
    ]
    return parts[0].unionByName(parts[1])


def rule_sql(kind: str, column: str, limit: int) -> str:
    op = "<" if kind == "start" else ">="
    return (
        "CASE WHEN date_diff('day', lag(d) OVER w, d) = 1 THEN "
        f"CAST(lag({column}) OVER w {op} {limit} AND {column} >= {limit} AS INTEGER) END"
    )


def _rules(rules) -> str:
    return ", ".join(f"{rule_sql(*r)} AS {n}" for n, r in rules.items())


WINDOW = "WINDOW w AS (PARTITION BY entity ORDER BY d)"


@query("label_onset", L_SQL + f" SELECT d, entity, {_rules(L.START_RULES)} FROM daily {WINDOW}")
def label_onset(spark, sf):
    daily = U.entity_daily(supplier_panel(spark, sf)).select("d", "entity", "failed_parts", "points")
    out, names = L.label_family(daily, "START", ["entity"], "d")
    return out.select("d", "entity", *names)


@query("label_consec", L_SQL + f" SELECT d, entity, {_rules(L.CONSEC_RULES)} FROM daily {WINDOW}")
def label_consec(spark, sf):
    daily = U.entity_daily(supplier_panel(spark, sf)).select("d", "entity", "failed_parts", "points")
    out, names = L.label_family(daily, "CONSEC", ["entity"], "d")
    return out.select("d", "entity", *names)


COSTS = (10000, 50000, 100000, 200000, 400000)
_SAME_DAY = [f"CAST(failed_parts >= {n} AS INTEGER) AS failed_parts_ge_{n}" for n in L.COUNT_LIMITS]
_SAME_DAY += [
    'CAST("failed_A" >= 1 AS INTEGER) AS "A_ge_1"', 'CAST("failed_A" >= 2 AS INTEGER) AS "A_ge_2"',
    'CAST("failed_A" >= 1 AND failed_parts >= 2 AS INTEGER) AS "A_ge_1_and_total_ge_2"',
    'CAST("failed_A" >= 2 OR failed_parts >= 4 AS INTEGER) AS "A_ge_2_or_total_ge_4"',
]
_SAME_DAY += [f"CAST(failed_cost >= {n} AS INTEGER) AS failed_cost_ge_{n}" for n in COSTS]


def same_day_labels(daily):
    """All label families side by side."""
    names = []
    out = daily
    for family in ("CO", "A", "COST", "START", "CONSEC"):
        out, more = L.label_family(out, family, ["entity"], "d", COSTS)
        names += more
    return out, names


@query(
    "label_same_day",
    R_SQL + f" SELECT d, entity, {', '.join(_SAME_DAY)}, {_rules(L.START_RULES)}, {_rules(L.CONSEC_RULES)} FROM daily {WINDOW}",
)
def label_same_day(spark, sf):
    out, names = same_day_labels(U.entity_daily(region_panel(spark, sf)))
    return out.select("d", "entity", *names)


_SPLIT = """, dates AS (SELECT list_sort(list(DISTINCT d)) AS ds FROM {t}),
 lim AS (SELECT ds[CAST(floor(len(ds) * 0.70) AS INT)] AS train_end, ds[CAST(floor(len(ds) * 0.70) AS INT) + 1] AS valid_start,
 ds[CAST(floor(len(ds) * 0.85) AS INT)] AS valid_end, ds[CAST(floor(len(ds) * 0.85) AS INT) + 1] AS test_start, ds[len(ds)] AS test_end FROM dates)"""
_SPLIT_NAME = "CASE WHEN d <= train_end THEN 'train' WHEN d <= valid_end THEN 'valid' ELSE 'test' END"
_SPLIT_END = "CASE WHEN d <= train_end THEN train_end WHEN d <= valid_end THEN valid_end ELSE test_end END"


@query(
    "split_dates",
    R_SQL + _SPLIT.format(t="daily") + f""", x AS (SELECT d, {_SPLIT_NAME} AS split FROM daily, lim)
 SELECT split, min(d) AS start, max(d) AS "end", count(*) AS rows, count(DISTINCT d) AS dates FROM x GROUP BY split""",
)
def split_dates(spark, sf):
    daily = U.entity_daily(region_panel(spark, sf)).select("d", "entity")
    return S.split_summary(S.date_share_split(daily, "d"), "d")


def _long_sql() -> str:
    names = [c.split(" AS ")[-1] for c in _SAME_DAY] + list(L.START_RULES) + list(L.CONSEC_RULES)
    return ", ".join(names)


@query(
    "label_rates",
    R_SQL + _SPLIT.format(t="daily") + f""", lab AS (SELECT d, entity, {', '.join(_SAME_DAY)}, {_rules(L.START_RULES)}, {_rules(L.CONSEC_RULES)} FROM daily {WINDOW}),
 long AS (UNPIVOT lab ON {_long_sql()} INTO NAME criterion VALUE y),
 x AS (SELECT criterion, y, {_SPLIT_NAME} AS split FROM long, lim WHERE y IS NOT NULL)
 SELECT criterion, coalesce(split, 'all') AS dataset, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 9) AS rate,
 round(1 - avg(y), 9) AS always_negative_accuracy FROM x GROUP BY GROUPING SETS ((criterion), (criterion, split))""",
)
def label_rates(spark, sf):
    out, names = same_day_labels(U.entity_daily(region_panel(spark, sf)))
    split = S.date_share_split(out, "d")
    return rounded(S.label_rates(L.long_labels(split, ["split"], names)), ["rate", "always_negative_accuracy"])


@query(
    "part_eligibility",
    R_SQL + _SPLIT.format(t="panel") + f""", lab AS (SELECT d, entity, member, flag, {binary_sql('flag', EM, 7)} AS target,
 count(flag) OVER {ahead(EM, 7)} = 7 AS future_complete, CAST(d + INTERVAL 7 DAY AS DATE) AS label_end,
 count(flag) OVER {_range(-30, -1).format(by=EM)} >= 30 AS past_complete FROM panel)
 SELECT d, entity, member, {_SPLIT_NAME} AS split, future_complete AND flag = 0 AS eligible_for_target,
 label_end <= {_SPLIT_END} AS target_within_split,
 CASE WHEN flag <> 0 THEN 'flagged_today' WHEN NOT past_complete THEN 'short_history' WHEN NOT future_complete THEN 'incomplete_future'
 WHEN label_end > {_SPLIT_END} THEN 'crosses_split' ELSE 'used' END AS reason FROM lab, lim""",
)
def part_eligibility(spark, sf):
    return eligible_parts(region_panel(spark, sf)).select(
        "d", "entity", "member", "split", "eligible_for_target", "target_within_split", "reason"
    )


def eligible_parts(panel, days: int = 7, kind: str = "binary"):
    """Part rows with strict history, future label, split and exclusion reason."""
    by = ["entity", "member"]
    p = strict_flag_history(panel, by, "d", "flag", "qty")
    p = L.future_label(p, by, "d", "flag", days, kind)
    return S.forecast_eligibility(S.date_share_split(p, "d"), "flag")


@query("exclusions", f"SELECT split, reason, count(*) AS rows FROM (__PART__) GROUP BY split, reason")
def exclusions(spark, sf):
    return S.exclusion_counts(eligible_parts(region_panel(spark, sf)))


@query(
    "family_profile",
    E_SQL + f""", x AS (SELECT *, unnest(['overall', {period_sql(*EVENT_SPLIT)}]) AS period FROM fam)
 SELECT period, family, count(*) AS row_count, max(total_parts) AS total_parts, CAST(sum(affected) AS BIGINT) AS affected_count,
 CAST(sum(severe) AS BIGINT) AS severe_count, CAST(sum(all_failed) AS BIGINT) AS all_failed_count, round(avg(affected), 9) AS affected_rate,
 round(avg(severe), 9) AS severe_rate, round(avg(all_failed), 9) AS all_failed_rate FROM x GROUP BY period, family""",
)
def family_profile(spark, sf):
    out = U.family_profile(U.family_daily(events_panel(spark, sf)), "d", *EVENT_SPLIT)
    return rounded(out, ["affected_rate", "severe_rate", "all_failed_rate"])


def failure_profile_frame(panel, thresholds, valid_start, test_start):
    """Part rate, issue-day rate and high-risk-day rate per split, scope and threshold."""
    scopes = {"machine_type": "etype", "asset_tag": "entity"}
    daily = U.entity_daily(panel)
    split = S.period_column("d", valid_start, test_start).alias("split")
    days = scope_rows(daily.select("d", "etype", "entity", "points", "total_parts", "failed_parts", split), scopes)
    key = ["split", "scope_kind", "scope_name"]
    grouped = days.groupBy(*key, "points").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_parts").alias("parts"), F.sum("failed_parts").alias("failed")
    )
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_t{t}").alias("asset_high_risk_day_rate")) for t in thresholds])
    out = grouped.groupBy(*key).agg(
        F.sum("parts").alias("part_rows"),
        F.sum("n").alias("asset_days"),
        ratio(F.sum("failed"), F.sum("parts")).alias("part_breakdown_rate"),
        ratio(F.sum(F.when(F.col("points") >= 1, F.col("n")).otherwise(0)), F.sum("n")).alias("asset_issue_day_rate"),
        ratio(F.sum(F.col("points") * F.col("n")), F.sum("n")).alias("mean_points"),
        # Few distinct scores per group: the weighted percentile holds one entry per score.
        F.percentile("points", 0.5, F.col("n")).alias("median_points"),
        *[ratio(F.sum(F.when(F.col("points") >= t, F.col("n")).otherwise(0)), F.sum("n")).alias(f"_t{t}") for t in thresholds],
    )
    return out.select("*", F.inline(cells)).drop(*[f"_t{t}" for t in thresholds])


@query(
    "failure_profile",
    L_SQL + f""", s AS (SELECT {period_sql(*PART_SPLIT)} AS split, points, total_parts, failed_parts,
 unnest([{{'k': 'machine_type', 'v': CAST(etype AS VARCHAR)}}, {{'k': 'asset_tag', 'v': CAST(entity AS VARCHAR)}}]) AS sc FROM daily)
 SELECT split, sc.k AS scope_kind, sc.v AS scope_name, CAST(t AS INTEGER) AS threshold, CAST(sum(total_parts) AS BIGINT) AS part_rows, count(*) AS asset_days,
 round(sum(failed_parts) / sum(total_parts), 9) AS part_breakdown_rate, round(avg(CAST(points >= 1 AS INTEGER)), 9) AS asset_issue_day_rate,
 round(avg(CAST(points >= t AS INTEGER)), 9) AS asset_high_risk_day_rate, round(avg(points), 9) AS mean_points, median(points) AS median_points
 FROM s CROSS JOIN (VALUES (7), (10)) v(t) GROUP BY ALL""",
)
def failure_profile(spark, sf):
    out = failure_profile_frame(supplier_panel(spark, sf), (7, 10), *PART_SPLIT)
    return rounded(out, ["part_breakdown_rate", "asset_issue_day_rate", "asset_high_risk_day_rate", "mean_points"])


@query(
    "class_shares",
    R_SQL + f""", x AS (SELECT {period_sql(*PART_SPLIT)} AS split,
 CASE WHEN points = 0 THEN 'normal' WHEN points <= 5 THEN 'caution' WHEN points <= 12 THEN 'risk' ELSE 'high_risk' END AS s FROM daily)
 SELECT split, class, count(*) FILTER (s = class) AS rows, round(count(*) FILTER (s = class) / count(*), 9) AS share
 FROM x CROSS JOIN (VALUES ('normal'), ('caution'), ('risk'), ('high_risk')) c(class) GROUP BY split, class""",
)
def class_shares(spark, sf):
    daily = U.with_severity(U.entity_daily(region_panel(spark, sf)), 13)
    daily = daily.withColumn("split", S.period_column("d", *PART_SPLIT))
    return rounded(S.class_shares(daily, ["split"], "severity", SEVERITY_LEVELS), ["share"])


@query(
    "purged_split",
    E_SQL + f""", x AS (SELECT d, CAST(d + INTERVAL 3 DAY AS DATE) AS e FROM daily)
 SELECT coalesce(CASE WHEN d >= DATE '{EVENT_SPLIT[1]}' THEN 'test' WHEN d >= DATE '{EVENT_SPLIT[0]}' AND e < DATE '{EVENT_SPLIT[1]}' THEN 'valid'
 WHEN d < DATE '{EVENT_SPLIT[0]}' AND e < DATE '{EVENT_SPLIT[0]}' THEN 'train' END, 'purged') AS split, min(d) AS start, max(d) AS "end",
 count(*) AS rows, count(DISTINCT d) AS dates FROM x GROUP BY 1""",
)
def purged_split(spark, sf):
    daily = U.entity_daily(events_panel(spark, sf)).select("d", F.date_add("d", 3).alias("label_end"))
    split = F.coalesce(S.purged_split("d", "label_end", *EVENT_SPLIT), F.lit("purged"))
    return S.split_summary(daily.withColumn("split", split), "d")


from gearwatch.catalog.base import SQL  # noqa: E402

SQL["exclusions"] = SQL["exclusions"].replace("__PART__", SQL["part_eligibility"])
