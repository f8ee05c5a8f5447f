"""Rollups and history columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import E_SQL, L_SQL, R_SQL, code_sql, query, rounded, severity_sql
from gearwatch.functions import expressions as X
from gearwatch.operators import history as H
from gearwatch.operators import rollups as U
from gearwatch.operators.labels import threshold_labels
from gearwatch.sources.warehouse import PART_MEMBERS, ROWS_PER_TASK, dealt, events_panel, region_panel, shipment_count, supplier_panel

M = ("m1", "m2", "m3", "m4")


@query(
    "panel_rollup",
    E_SQL + """ SELECT d, entity, etype, site, points, "failed_A", "failed_B", "failed_C", failed_parts, total_parts,
 round(failed_cost, 4) AS failed_cost, round(amount, 4) AS amount, m1, m2, m3, m4,
 CAST(points = 4 * "failed_A" + 2 * "failed_B" + "failed_C" AS INTEGER) AS identity_ok FROM daily""",
)
def panel_rollup(spark, sf):
    out = U.entity_daily(events_panel(spark, sf))
    identity = F.col("points") == 4 * F.col("failed_A") + 2 * F.col("failed_B") + F.col("failed_C")
    return rounded(out.withColumn("identity_ok", identity.cast("int")), ["failed_cost", "amount"], 4)


@query(
    "threshold_labels",
    R_SQL + " SELECT d, entity, points, " + ", ".join(
        f"CAST(points >= {t} AS INTEGER) AS severity_{t}" for t in X.SEVERITY_THRESHOLDS) + " FROM daily",
)
def threshold_label_rows(spark, sf):
    daily = U.entity_daily(region_panel(spark, sf))
    return threshold_labels(daily.select("d", "entity", "points"), "points")


@query(
    "severity_bands",
    R_SQL + f""", s AS (SELECT d, entity, points, {severity_sql('points', 12)} AS severity,
 CASE WHEN points <= 0 THEN 'normal' WHEN points <= 5 THEN 'caution' WHEN points <= 11 THEN 'risk' ELSE 'high_risk' END AS observed,
 points * 0.9 AS guess FROM daily)
 SELECT d, entity, points, severity, CAST({code_sql('severity')} AS INTEGER) AS severity_code, observed,
 CASE WHEN guess < 0.5 THEN 'normal' WHEN guess < 5.5 THEN 'caution' WHEN guess < 11.5 THEN 'risk' ELSE 'high_risk' END AS guessed
 FROM s""",
)
def severity_bands(spark, sf):
    daily = U.with_severity(U.entity_daily(region_panel(spark, sf)), 12)
    return daily.select(
        "d", "entity", "points", "severity", "severity_code",
        X.observed_severity("points").alias("observed"),
        X.predicted_severity(F.col("points") * F.lit(0.9)).alias("guessed"),
    )


@query(
    "calendar_feats",
    E_SQL + """ SELECT d, entity, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week,
 round(sin(2 * pi() * month(d) / 12.0), 9) AS month_sin, round(cos(2 * pi() * month(d) / 12.0), 9) AS month_cos FROM daily""",
)
def calendar_feats(spark, sf):
    daily = U.entity_daily(events_panel(spark, sf)).select("d", "entity")
    return rounded(X.add(daily, X.calendar_columns("d")), ["month_sin", "month_cos"])


@query(
    "measure_interactions",
    R_SQL + """ SELECT d, entity, round(m1 - m4, 9) AS temp_gap, round(sqrt(m3 * m3 + m4 * m4), 9) AS vibration_magnitude,
 round(m1 * sqrt(m3 * m3 + m4 * m4), 9) AS temp_vibration_product, m4 * m2 AS temp_load_product FROM daily""",
)
def measure_interactions(spark, sf):
    daily = U.entity_daily(region_panel(spark, sf))
    out = X.add(daily, X.interaction_columns("m1", "m4", "m3", "m4", "m2")).select(
        "d", "entity", "temp_gap", "vibration_magnitude", "temp_vibration_product", "temp_load_product"
    )
    return rounded(out, ["temp_gap", "vibration_magnitude", "temp_vibration_product"])


def _range(lo: int, hi: int) -> str:
    def side(n: int) -> str:
        return f"INTERVAL {abs(n)} DAY {'PRECEDING' if n < 0 else 'FOLLOWING'}" if n else "CURRENT ROW"

    return f"(PARTITION BY {{by}} ORDER BY d RANGE BETWEEN {side(lo)} AND {side(hi)})"


def over(fn: str, x: str, lo: int, hi: int, at_least: int = 1, by: str = "entity") -> str:
    w = _range(lo, hi).format(by=by)
    return f"CASE WHEN count({x}) OVER {w} >= {at_least} THEN {fn}({x}) OVER {w} END"


def lag_sql(x: str, k: int, by: str = "entity") -> str:
    return f"max({x}) OVER {_range(-k, -k).format(by=by)}"


def since_sql(cond: str, by: str = "entity") -> str:
    return (
        f"date_diff('day', max(CASE WHEN {cond} THEN d END) OVER (PARTITION BY {by} ORDER BY d "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d)"
    )


def _measure_sql() -> str:
    cols = []
    for m in M:
        cols += [f"{lag_sql(m, k)} AS {m}_lag{k}" for k in (1, 3, 7)]
        cols.append(f"round({over('avg', m, -6, 0, 3)}, 9) AS {m}_mean7")
        cols.append(f"round({over('stddev_samp', m, -6, 0, 3)}, {6 if m == 'm2' else 9}) AS {m}_std7")
        cols.append(f"round({m} - {lag_sql(m, 1)}, 9) AS {m}_diff1")
    return ", ".join(cols)


@query("hist_sensor_calendar", E_SQL + f" SELECT d, entity, {_measure_sql()} FROM daily")
def hist_sensor_calendar(spark, sf):
    daily = U.entity_daily(events_panel(spark, sf)).select("d", "entity", *M)
    out = H.measure_history(daily, ["entity"], "d", M).drop(*M)
    return rounded(rounded(out, [f"{m}_{s}" for m in M for s in ("mean7", "diff1", "std7") if (m, s) != ("m2", "std7")]), ["m2_std7"], 6)


@query("hist_sensor_calendar_gaps", L_SQL + f" SELECT d, entity, {_measure_sql()} FROM daily")
def hist_sensor_calendar_gaps(spark, sf):
    daily = U.entity_daily(supplier_panel(spark, sf)).select("d", "entity", *M)
    out = H.measure_history(daily, ["entity"], "d", M).drop(*M)
    return rounded(rounded(out, [f"{m}_{s}" for m in M for s in ("mean7", "diff1", "std7") if (m, s) != ("m2", "std7")]), ["m2_std7"], 6)


def _robust_sql() -> str:
    cols = []
    for m in ("m2", "m3"):
        cols += [f"{lag_sql(m, k)} AS {m}_lag{k}" for k in (1, 3, 7)]
        cols += [
            f"round({m} - {lag_sql(m, 1)}, 9) AS {m}_diff1",
            f"round({m} - {lag_sql(m, 7)}, 9) AS {m}_diff7",
            f"round({over('median', m, -3, -1, 2)}, 9) AS {m}_median3",
            f"round({over('median', m, -7, -1, 3)}, 9) AS {m}_median7",
            f"round({over('mad', m, -7, -1, 3)}, 9) AS {m}_mad7",
        ]
        w = _range(-7, -1).format(by="entity")
        cols.append(
            f"round(CASE WHEN count({m}) OVER {w} >= 7 THEN regr_slope({m}, date_diff('day', DATE '2024-01-01', d)) OVER {w} END, 9) AS {m}_slope7"
        )
    return ", ".join(cols)


@query("hist_sensor_robust", E_SQL + f" SELECT d, entity, {_robust_sql()} FROM daily")
def hist_sensor_robust(spark, sf):
    daily = U.entity_daily(events_panel(spark, sf)).select("d", "entity", "m2", "m3")
    out = H.robust_history(daily, ["entity"], "d", ["m2", "m3"]).drop("m2", "m3")
    names = [f"{m}_{s}" for m in ("m2", "m3") for s in ("diff1", "diff7", "median3", "median7", "mad7")]
    return rounded(rounded(out, names), ["m2_slope7", "m3_slope7"])


def _rows_sql() -> str:
    cols = []
    for m in ("m1", "m2"):
        w7 = "(PARTITION BY entity ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
        w30 = "(PARTITION BY entity ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
        mean7 = f"CASE WHEN count({m}) OVER {w7} >= 3 THEN avg({m}) OVER {w7} END"
        std7 = f"CASE WHEN count({m}) OVER {w7} >= 3 THEN stddev_samp({m}) OVER {w7} END"
        mean30 = f"CASE WHEN count({m}) OVER {w30} >= 7 THEN avg({m}) OVER {w30} END"
        cols += [
            f"round({m} - lag({m}) OVER (PARTITION BY entity ORDER BY d), 9) AS {m}_diff1",
            f"round({mean7}, 9) AS {m}_mean7",
            f"round({std7}, 6) AS {m}_std7",
            f"round({m} - {mean7}, 9) AS {m}_vs_mean7",
            f"round(abs({m} - {mean7}) / nullif({std7}, 0), 9) AS {m}_anomaly7",
            f"round({m} - {mean30}, 9) AS {m}_vs_mean30",
        ]
    return ", ".join(cols)


@query("hist_sensor_rows", L_SQL + f" SELECT d, entity, {_rows_sql()} FROM daily")
def hist_sensor_rows(spark, sf):
    daily = U.entity_daily(supplier_panel(spark, sf)).select("d", "entity", "m1", "m2")
    out = H.observed_row_history(daily, ["entity"], "d", ["m1", "m2"]).drop("m1", "m2")
    names = [f"{m}_{s}" for m in ("m1", "m2") for s in ("diff1", "mean7", "vs_mean7", "vs_mean30", "anomaly7")]
    return rounded(rounded(out, names), ["m1_std7", "m2_std7"], 6)


@query(
    "hist_sensor_strict",
    R_SQL + " SELECT d, entity, " + ", ".join(
        f"{lag_sql(m, 1)} AS {m}_lag1, round({over('avg', m, -7, -1, 7)}, 9) AS {m}_mean_prev_7d" for m in M) + " FROM daily",
)
def hist_sensor_strict(spark, sf):
    daily = U.entity_daily(region_panel(spark, sf)).select("d", "entity", *M)
    out = H.strict_measure_history(daily, ["entity"], "d", M).drop(*M)
    return rounded(out, [f"{m}_mean_prev_7d" for m in M])


EM = "entity, member"


@query(
    "hist_flag",
    E_SQL + f""" SELECT d, entity, member, {lag_sql('flag', 1, EM)} AS flag_lag1,
 CAST({over('sum', 'flag', -7, -1, 1, EM)} AS BIGINT) AS flag_count_7d,
 CAST({over('sum', 'flag', -30, -1, 1, EM)} AS BIGINT) AS flag_count_30d,
 CAST({since_sql('flag = 1', EM)} AS INTEGER) AS days_since_last_flag FROM panel""",
)
def hist_flag(spark, sf):
    p = events_panel(spark, sf).select("d", "entity", "member", "flag")
    return H.flag_history(p, ["entity", "member"], "d", "flag").drop("flag")


@query(
    "hist_flag_strict",
    R_SQL + f""" SELECT d, entity, member, CAST({over('sum', 'flag', -7, -1, 7, EM)} AS BIGINT) AS flag_days_prev_7d,
 CAST({over('sum', 'flag', -30, -1, 30, EM)} AS BIGINT) AS flag_days_prev_30d,
 CAST({over('sum', 'qty', -7, -1, 7, EM)} AS BIGINT) AS qty_prev_7d,
 CAST({over('sum', 'qty', -30, -1, 30, EM)} AS BIGINT) AS qty_prev_30d,
 count(flag) OVER {_range(-30, -1).format(by=EM)} >= 30 AS history_30d_complete,
 CAST({since_sql('flag = 1', EM)} AS INTEGER) AS days_since_last_flag,
 {since_sql('flag = 1', EM)} IS NOT NULL AS has_prior_flag FROM panel""",
)
def hist_flag_strict(spark, sf):
    p = region_panel(spark, sf).select("d", "entity", "member", "flag", "qty")
    return H.strict_flag_history(p, ["entity", "member"], "d", "flag", "qty").drop("flag", "qty")


@query(
    "hist_risk",
    E_SQL + f""", x AS (SELECT *, CAST(points >= 7 AS INTEGER) AS risky FROM daily)
 SELECT d, entity, points, {lag_sql('points', 1)} AS points_lag1, round({over('avg', 'points', -7, -1)}, 9) AS points_mean7,
 {over('max', 'points', -7, -1)} AS points_max7, CAST({over('sum', 'risky', -30, -1)} AS BIGINT) AS risk_count_30d,
 CAST({since_sql('risky = 1')} AS INTEGER) AS days_since_last_risk FROM x""",
)
def hist_risk(spark, sf):
    daily = U.entity_daily(events_panel(spark, sf)).select("d", "entity", "points")
    return rounded(H.risk_history(daily, ["entity"], "d", "points", 7), ["points_mean7"])


EF = "entity, family"


@query(
    "hist_family",
    L_SQL + f""" SELECT d, entity, family, {lag_sql('affected', 1, EF)} AS affected_lag1,
 CAST({over('sum', 'affected', -7, -1, 1, EF)} AS BIGINT) AS affected_count_7d,
 CAST({over('sum', 'affected', -30, -1, 1, EF)} AS BIGINT) AS affected_count_30d,
 {lag_sql('severe', 1, EF)} AS severe_lag1, CAST({over('sum', 'severe', -30, -1, 1, EF)} AS BIGINT) AS severe_count_30d,
 CAST({since_sql('affected = 1', EF)} AS INTEGER) AS days_since_last_affected FROM fam""",
)
def hist_family(spark, sf):
    fam = U.family_daily(supplier_panel(spark, sf)).select("d", "entity", "family", "affected", "severe")
    families = len({f for f, _ in PART_MEMBERS.values()})  # rows of a day
    fam = dealt(fam, families * shipment_count(spark, sf), "entity", "family", per_task=4 * ROWS_PER_TASK)
    return H.family_history(fam, ["entity", "family"], "d").drop("affected", "severe")


@query(
    "hist_family_strict",
    R_SQL + f""" SELECT d, entity, family, family_flag, CAST({over('sum', 'family_flag', -7, -1, 7, EF)} AS BIGINT) AS family_flag_days_prev_7d,
 CAST({over('sum', 'family_flag', -30, -1, 30, EF)} AS BIGINT) AS family_flag_days_prev_30d,
 count(family_flag) OVER {_range(-30, -1).format(by=EF)} >= 30 AS history_30d_complete,
 CAST({since_sql('family_flag = 1', EF)} AS INTEGER) AS days_since_last_family_flag,
 {since_sql('family_flag = 1', EF)} IS NOT NULL AS has_prior_family_flag FROM fam""",
)
def hist_family_strict(spark, sf):
    fam = U.family_daily(region_panel(spark, sf)).select("d", "entity", "family", "family_flag")
    return H.strict_flag_history(fam, ["entity", "family"], "d", "family_flag")


@query(
    "previous_row",
    L_SQL + """ SELECT d, entity, lag(m1) OVER w AS m1_prev, round(m1 - lag(m1) OVER w, 9) AS m1_change,
 lag(points) OVER w AS points_prev, points - lag(points) OVER w AS points_change FROM daily
 WINDOW w AS (PARTITION BY entity ORDER BY d)""",
)
def previous_row(spark, sf):
    daily = U.entity_daily(supplier_panel(spark, sf)).select("d", "entity", "m1", "points")
    return rounded(H.previous_row(daily, ["entity"], "d", ["m1", "points"]).drop("m1", "points"), ["m1_change"])


@query(
    "family_rollup",
    E_SQL + """, full_days AS (SELECT d, entity, max(all_failed) AS full_breakdown, CAST(sum(all_failed) AS BIGINT) AS fully_failed_families FROM fam GROUP BY d, entity)
 SELECT f.d, f.entity, f.family, total_parts, failed_parts, failed_a_parts, affected, severe, all_failed, full_breakdown, fully_failed_families
 FROM fam f JOIN full_days USING (d, entity)""",
)
def family_rollup(spark, sf):
    fam = U.family_daily(events_panel(spark, sf))
    full = U.full_family_label(fam)
    return fam.join(full, ["d", "entity"]).select(
        "d", "entity", "family", "total_parts", "failed_parts", "failed_a_parts", "affected", "severe", "all_failed",
        "full_breakdown", "fully_failed_families",
    )


@query(
    "single_failure_days",
    E_SQL + """ SELECT d, entity, etype, count(*) AS total_parts, CAST(sum(flag) AS BIGINT) AS failed_parts,
 CASE sum(flag) WHEN 0 THEN 'clean' WHEN 1 THEN 'isolated' ELSE 'multiple' END AS status,
 CASE WHEN sum(flag) = 1 THEN max(CASE WHEN flag = 1 THEN member END) END AS failed_part,
 CASE WHEN sum(flag) = 1 THEN max(CASE WHEN flag = 1 THEN family END) END AS failed_family FROM panel GROUP BY d, entity, etype""",
)
def single_failure_days(spark, sf):
    out = U.single_failure_daily(events_panel(spark, sf))
    return out.select("d", "entity", "etype", "total_parts", "failed_parts", "status", "failed_part", "failed_family")
