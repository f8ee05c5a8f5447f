"""Robust baselines, z scores, residuals and case-control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import L_SQL, R_SQL, period_sql, query, rounded
from gearwatch.functions import expressions as X
from gearwatch.operators import casecontrol as C
from gearwatch.operators import robust as B
from gearwatch.operators import rollups as U
from gearwatch.operators.history import residual_history
from gearwatch.operators.residuals import operating_residuals
from gearwatch.session import materialize
from gearwatch.sources.warehouse import PART_MEMBERS, PART_SPLIT, region_panel, supplier_panel

M = ("m1", "m2", "m3", "m4")
VALID, TEST = PART_SPLIT

BASE_SQL = L_SQL + f""", clean AS (UNPIVOT (SELECT etype, entity, m1, m2, m3, m4 FROM daily WHERE points = 0 AND d < DATE '{VALID}') ON m1, m2, m3, m4 INTO NAME sensor VALUE v),
 a AS (SELECT etype, entity, sensor, count(*) AS n, median(v) AS med, mad(v) AS mad FROM clean GROUP BY ALL),
 t AS (SELECT etype, sensor, count(*) AS n, median(v) AS med, mad(v) AS mad FROM clean GROUP BY ALL),
 g AS (SELECT sensor, count(*) AS n, median(v) AS med, mad(v) AS mad, stddev_pop(v) AS std FROM clean GROUP BY ALL),
 gs AS (SELECT *, CASE WHEN mad > 1e-12 THEN 'global' WHEN std > 1e-12 THEN 'global_std' ELSE 'constant' END AS scope,
   CASE WHEN mad > 1e-12 THEN 1.4826 * mad WHEN std > 1e-12 THEN std ELSE 1 END AS scale FROM g),
 ts AS (SELECT t.etype, t.sensor, CASE WHEN ok THEN t.n ELSE gs.n END AS n, CASE WHEN ok THEN t.med ELSE gs.med END AS med, CASE WHEN ok THEN t.mad ELSE gs.mad END AS mad,
   CASE WHEN ok THEN 1.4826 * t.mad ELSE gs.scale END AS scale, CASE WHEN ok THEN 'machine_type' ELSE gs.scope END AS scope,
   CASE WHEN ok THEN '' WHEN t.n < {{min}} THEN 'machine_insufficient_rows' ELSE 'machine_mad_zero' END AS reason
   FROM (SELECT *, n >= {{min}} AND mad > 1e-12 AS ok FROM t) t JOIN gs USING (sensor)),
 es AS (SELECT a.etype, a.entity, a.sensor, CASE WHEN ok THEN a.n ELSE ts.n END AS n, CASE WHEN ok THEN a.med ELSE ts.med END AS med, CASE WHEN ok THEN a.mad ELSE ts.mad END AS mad,
   CASE WHEN ok THEN 1.4826 * a.mad ELSE ts.scale END AS scale, CASE WHEN ok THEN 'asset_tag' ELSE ts.scope END AS scope,
   CASE WHEN ok THEN '' WHEN a.n < {{min}} THEN 'asset_insufficient_rows' ELSE 'asset_mad_zero' END AS reason
   FROM (SELECT *, n >= {{min}} AND mad > 1e-12 AS ok FROM a) a JOIN ts USING (etype, sensor)),
 base AS (SELECT NULL AS entity, NULL AS etype, sensor, n, med, mad, scale, scope, CASE scope WHEN 'global' THEN 'machine_baseline_unavailable' WHEN 'global_std' THEN 'global_mad_zero' ELSE 'global_scale_zero' END AS reason FROM gs
   UNION ALL SELECT NULL, etype, sensor, n, med, mad, scale, scope, reason FROM ts UNION ALL SELECT entity, etype, sensor, n, med, mad, scale, scope, reason FROM es)"""

_BASE_OUT = """ SELECT entity, etype, sensor, CAST(n AS BIGINT) AS normal_rows, round(med, 9) AS median, round(mad, 9) AS mad, round(scale, 9) AS scale,
 scope AS selected_scope, reason AS fallback_reason FROM base"""


def clean_train(daily):
    return daily.filter((F.col("points") == 0) & (F.col("d") < F.lit(VALID).cast("date")))


def _days(spark, sf):
    """The suppliers' days with what the queries here read of them, written: fits, scores and comparisons all start from it."""
    days = U.scored_failure_daily(supplier_panel(spark, sf), {m: family for m, (family, _) in PART_MEMBERS.items()})
    return materialize(days.select("d", "entity", "etype", "points", "status", "failed_part", "failed_family", *M))


def _baseline(spark, sf, min_rows):
    daily = _days(spark, sf)
    return daily, B.fit_baseline(clean_train(daily), M, min_rows=min_rows)


@query("robust_baseline", BASE_SQL.replace("{min}", "30") + _BASE_OUT)
def robust_baseline(spark, sf):
    return rounded(_baseline(spark, sf, 30)[1], ["median", "mad", "scale"])


@query("robust_baseline_fallback", BASE_SQL.replace("{min}", "190") + _BASE_OUT)
def robust_baseline_fallback(spark, sf):
    """A row requirement that part of the entities miss, so lower levels are used."""
    return rounded(_baseline(spark, sf, 190)[1], ["median", "mad", "scale"])


_Z = ", ".join(f"(m{i} - max(CASE WHEN sensor = 'm{i}' THEN med END)) / max(CASE WHEN sensor = 'm{i}' THEN scale END) AS z{i}" for i in range(1, 5))
Z_SQL = BASE_SQL.replace("{min}", "30") + """, ent AS (SELECT DISTINCT entity, etype FROM daily),
 lk AS (SELECT ent.entity, s.sensor, coalesce(es.med, ts.med, gs.med) AS med, coalesce(es.scale, ts.scale, gs.scale) AS scale FROM ent CROSS JOIN (SELECT DISTINCT sensor FROM gs) s
   LEFT JOIN es ON es.entity = ent.entity AND es.etype = ent.etype AND es.sensor = s.sensor LEFT JOIN ts ON ts.etype = ent.etype AND ts.sensor = s.sensor JOIN gs ON gs.sensor = s.sensor),
 w AS (SELECT entity, """ + ", ".join(
    f"max(med) FILTER (sensor = 'm{i}') AS med{i}, max(scale) FILTER (sensor = 'm{i}') AS sc{i}" for i in range(1, 5)
) + """ FROM lk GROUP BY entity), z AS (SELECT daily.*, """ + ", ".join(f"(m{i} - med{i}) / sc{i} AS z{i}" for i in range(1, 5)) + " FROM daily JOIN w USING (entity))"


def z_days(spark, sf):
    daily, table = _baseline(spark, sf, 30)
    return B.robust_z(daily, table, M)


ZCOLS = [f"{m}_robust_z" for m in M]


@query(
    "robust_z",
    Z_SQL + """ SELECT d, entity, """ + ", ".join(f"round(z{i}, 9) AS m{i}_robust_z" for i in range(1, 5)) + """,
 round(greatest(abs(z1), abs(z2), abs(z3), abs(z4)), 9) AS max_abs_z, round((abs(z1) + abs(z2) + abs(z3) + abs(z4)) / 4, 9) AS mean_abs_z,
 CAST(abs(z1) >= 2 AS INTEGER) + CAST(abs(z2) >= 2 AS INTEGER) + CAST(abs(z3) >= 2 AS INTEGER) + CAST(abs(z4) >= 2 AS INTEGER) AS count_abs_z_ge_2,
 CAST(abs(z1) >= 3 AS INTEGER) + CAST(abs(z2) >= 3 AS INTEGER) + CAST(abs(z3) >= 3 AS INTEGER) + CAST(abs(z4) >= 3 AS INTEGER) AS count_abs_z_ge_3,
 CAST(abs(z1) >= 2 AND abs(z2) >= 2 AS INTEGER) AS temp_vibration_joint FROM z""",
)
def robust_z(spark, sf):
    out = X.add(z_days(spark, sf), X.abs_z_summary(ZCOLS, [ZCOLS[0]], [ZCOLS[1]]))
    names = [*ZCOLS, "max_abs_z", "mean_abs_z"]
    return rounded(out.select("d", "entity", *names, "count_abs_z_ge_2", "count_abs_z_ge_3", "temp_vibration_joint"), names)


@query(
    "normal_bounds",
    BASE_SQL.replace("{min}", "30") + """ SELECT entity, sensor, round(med, 9) AS median, round(scale, 9) AS scale, round(med - 3 * scale, 9) AS lower, round(med + 3 * scale, 9) AS upper FROM es""",
)
def normal_bounds(spark, sf):
    return rounded(B.normal_bounds(_baseline(spark, sf, 30)[1]), ["median", "scale", "lower", "upper"])


@query(
    "out_of_range_days",
    BASE_SQL.replace("{min}", "30") + f""", long AS (UNPIVOT (SELECT entity, m1, m2, m3, m4 FROM daily WHERE d >= DATE '{TEST}') ON m1, m2, m3, m4 INTO NAME sensor VALUE v)
 SELECT long.entity, sensor, count(*) AS days, count(*) FILTER (v < med - 3 * scale OR v > med + 3 * scale) AS out_days FROM long JOIN es USING (entity, sensor) GROUP BY long.entity, sensor""",
)
def out_of_range_days(spark, sf):
    daily, table = _baseline(spark, sf, 30)
    return B.out_of_range_days(daily.filter(F.col("d") >= F.lit(TEST).cast("date")), B.normal_bounds(table), M)


CASE_SQL = Z_SQL + f""", sd AS (SELECT d, entity, CASE sum(flag) WHEN 0 THEN 'clean' ELSE 'isolated' END AS status, max(CASE WHEN flag = 1 THEN member END) AS part,
   max(CASE WHEN flag = 1 THEN family END) AS family FROM panel GROUP BY d, entity HAVING sum(flag) <= 1),
 per AS (SELECT sd.*, unnest(['overall', {period_sql(VALID, TEST, 'sd.d')}]) AS period, abs(z1) AS m1, abs(z2) AS m2, abs(z3) AS m3, abs(z4) AS m4 FROM sd JOIN z ON z.d = sd.d AND z.entity = sd.entity),
 long AS (UNPIVOT (SELECT period, entity, status, part, family, m1, m2, m3, m4 FROM per) ON m1, m2, m3, m4 INTO NAME sensor VALUE az),
 cl AS (SELECT period, entity, sensor, count(*) AS n, median(az) AS med, avg(CAST(az >= 2 AS INTEGER)) AS r2, avg(CAST(az >= 3 AS INTEGER)) AS r3 FROM long WHERE status = 'clean' GROUP BY ALL),
 ca AS (SELECT period, part, family, entity, sensor, count(*) AS n, median(az) AS med, avg(CAST(az >= 2 AS INTEGER)) AS r2, avg(CAST(az >= 3 AS INTEGER)) AS r3 FROM long WHERE status = 'isolated' GROUP BY ALL),
 u AS (SELECT period, entity, sensor, az, sum(clean) OVER w AS upto, clean, sum(clean) OVER (PARTITION BY period, entity, sensor) AS tot
   FROM (SELECT period, entity, sensor, az, count(*) FILTER (status = 'clean') AS clean FROM long GROUP BY ALL) WINDOW w AS (PARTITION BY period, entity, sensor ORDER BY az)),
 dl AS (SELECT l.period, l.part, l.entity, l.sensor, sum((upto - clean) - (tot - upto)) / (count(*) * max(tot)) AS delta FROM long l JOIN u USING (period, entity, sensor, az) WHERE l.status = 'isolated' GROUP BY ALL)"""


def case_days(spark, sf):
    days = z_days(spark, sf).dropna(subset=["d", "entity"]).select("d", "entity", "status", "failed_part", "failed_family", *ZCOLS)
    return C.with_periods(days, "d", VALID, TEST)


def effects(spark, sf):
    return C.entity_effects(case_days(spark, sf), dict(zip(M, ZCOLS)))


RATES = ["clean_anomaly_rate", "isolated_anomaly_rate", "median_abs_z_clean", "median_abs_z_isolated", "cliffs_delta", "anomaly_rate_diff_pp"]


_CASE_OUT = """ SELECT ca.period, ca.part AS failed_part, ca.family AS failed_family, ca.sensor, CAST(t AS DOUBLE) AS z_threshold, count(*) AS case_assets,
 CAST(sum(cl.n) AS BIGINT) AS clean_rows, CAST(sum(ca.n) AS BIGINT) AS isolated_rows, round(avg(CASE t WHEN 2 THEN cl.r2 ELSE cl.r3 END), 9) AS clean_anomaly_rate,
 round(avg(CASE t WHEN 2 THEN ca.r2 ELSE ca.r3 END), 9) AS isolated_anomaly_rate, round(avg(cl.med), 9) AS median_abs_z_clean, round(avg(ca.med), 9) AS median_abs_z_isolated,
 round(avg(delta), 9) AS cliffs_delta, round((avg(CASE t WHEN 2 THEN ca.r2 ELSE ca.r3 END) - avg(CASE t WHEN 2 THEN cl.r2 ELSE cl.r3 END)) * 100, 9) AS anomaly_rate_diff_pp
 FROM ca JOIN cl USING (period, entity, sensor) JOIN dl ON dl.period = ca.period AND dl.part = ca.part AND dl.entity = ca.entity AND dl.sensor = ca.sensor
 CROSS JOIN (VALUES (2), (3)) v(t) GROUP BY ca.period, ca.part, ca.family, ca.sensor, t"""


@query("case_control", CASE_SQL + _CASE_OUT)
def case_control(spark, sf):
    return rounded(rounded(C.summarize(effects(spark, sf)), RATES), ["anomaly_rate_diff_pp"])


@query(
    "case_control_direction",
    CASE_SQL + f""", s AS ({_CASE_OUT}), k AS (SELECT failed_part, sensor, z_threshold, count(*) AS n, count(DISTINCT sign(anomaly_rate_diff_pp)) FILTER (anomaly_rate_diff_pp <> 0) AS signs
   FROM s WHERE period <> 'overall' GROUP BY ALL)
 SELECT period, failed_part, sensor, z_threshold, anomaly_rate_diff_pp, CASE WHEN n < 2 THEN 'too_few_periods' WHEN signs <= 1 THEN 'consistent' ELSE 'mixed' END AS direction_status
 FROM s JOIN k USING (failed_part, sensor, z_threshold)""",
)
def case_control_direction(spark, sf):
    out = C.direction(C.summarize(effects(spark, sf)))
    return rounded(out.select("period", "failed_part", "sensor", "z_threshold", "anomaly_rate_diff_pp", "direction_status"), ["anomaly_rate_diff_pp"])


@query("case_control_bootstrap")
def case_control_bootstrap(spark, sf):
    """Random resamples: no SQL twin; its properties are tested on small frames."""
    e = effects(spark, sf)
    return C.direction(C.with_status(C.summarize(e), C.bootstrap(e, samples=1000)))


@query(
    "part_profile",
    L_SQL + f""", sd AS (SELECT d, entity, CASE sum(flag) WHEN 0 THEN 'clean' WHEN 1 THEN 'isolated' ELSE 'multiple' END AS status, max(CASE WHEN flag = 1 THEN member END) AS part FROM panel GROUP BY d, entity),
 per AS (SELECT *, unnest(['overall', {period_sql(VALID, TEST)}]) AS period FROM sd)
 SELECT p.period, m.member AS part, CAST(count(*) FILTER (status = 'isolated' AND p.part = m.member) AS BIGINT) AS isolated_rows,
 count(DISTINCT CASE WHEN status = 'isolated' AND p.part = m.member THEN entity END) AS case_assets,
 max(CASE WHEN status = 'isolated' AND p.part = m.member THEN m.family END) AS family,
 count(*) FILTER (status = 'clean') AS all_clean_rows, count(*) FILTER (status = 'multiple') AS multiple_rows_excluded FROM per p CROSS JOIN members m GROUP BY p.period, m.member""",
)
def part_profile(spark, sf):
    days = C.with_periods(U.single_failure_daily(supplier_panel(spark, sf)), "d", VALID, TEST)
    return C.part_profile(days, list(PART_MEMBERS))


def residual_sql(base: str, measures, operating: str, min_rows: int) -> str:
    """CTE ``res``: daily rows with <m>_expected, <m>_residual and <m>_residual_robust_z for one operating measure."""
    out = base + f""", c AS (SELECT * FROM daily WHERE points = 0 AND d < DATE '{VALID}')"""
    for m in measures:
        out += f""",
 own_{m} AS (SELECT entity, etype, count(*) AS n, regr_slope({m}, {operating}) AS b, regr_intercept({m}, {operating}) AS a, avg({m}) AS my, avg({operating}) AS mx,
   covar_pop({m}, {operating}) * count(*) AS sxy, var_pop({operating}) * count(*) AS sxx FROM c GROUP BY entity, etype),
 pool_{m} AS (SELECT sum(sxy) / sum(sxx) AS b FROM own_{m}),
 ty_{m} AS (SELECT etype, avg({m}) - max(b) * avg({operating}) AS a FROM c, pool_{m} GROUP BY etype),
 al_{m} AS (SELECT avg({m}) - max(b) * avg({operating}) AS a FROM c, pool_{m}),
 e_{m} AS (SELECT daily.d, daily.entity, daily.etype, daily.{m} AS v, own.n >= {min_rows} AS is_own, points = 0 AND d < DATE '{VALID}' AS fit,
   coalesce(own.my - p.b * own.mx, ty.a, al.a) + p.b * {operating} AS shared, CASE WHEN own.n >= {min_rows} THEN own.a + own.b * {operating} ELSE coalesce(own.my - p.b * own.mx, ty.a, al.a) + p.b * {operating} END AS expected
   FROM daily LEFT JOIN own_{m} own ON own.entity = daily.entity AND own.etype = daily.etype LEFT JOIN ty_{m} ty ON ty.etype = daily.etype, pool_{m} p, al_{m} al),
 sc_{m} AS (SELECT entity, median(v - expected) AS med, mad(v - expected) AS mad, stddev_pop(v - expected) AS std FROM e_{m} WHERE fit AND is_own GROUP BY entity),
 sa_{m} AS (SELECT median(v - shared) AS med, mad(v - shared) AS mad, stddev_pop(v - shared) AS std FROM e_{m} WHERE fit),
 r_{m} AS (SELECT e.d, e.entity, expected AS {m}_expected, v - expected AS {m}_residual, (v - expected - coalesce(s.med, g.med))
   / CASE WHEN s.entity IS NOT NULL THEN CASE WHEN s.mad > 1e-12 THEN 1.4826 * s.mad ELSE s.std END ELSE CASE WHEN g.mad > 1e-12 THEN 1.4826 * g.mad ELSE g.std END END AS {m}_residual_robust_z
   FROM e_{m} e LEFT JOIN sc_{m} s ON s.entity = e.entity, sa_{m} g)"""
    joins = " ".join(f"JOIN r_{m} ON r_{m}.d = daily.d AND r_{m}.entity = daily.entity" for m in measures)
    names = ", ".join(f"round({m}_{x}, 6) AS {m}_{x}" for m in measures for x in ("expected", "residual", "residual_robust_z"))
    return out + f""",
 res AS (SELECT daily.d, daily.entity, {names} FROM daily {joins})"""


RESIDUAL_ROWS = 190  # own fits for a part of the entities, shared slopes for the others
RESIDUAL_COLUMNS = [f"{m}_{x}" for m in ("m1", "m2") for x in ("expected", "residual", "residual_robust_z")]


def residual_rows(daily, also=()):
    train = (F.col("points") == 0) & (F.col("d") < F.lit(VALID).cast("date"))
    out, artifacts = operating_residuals(daily, ["m1", "m2"], ["m3"], train, min_rows=RESIDUAL_ROWS, calendar=())
    return rounded(out.select("d", "entity", *also, *RESIDUAL_COLUMNS), RESIDUAL_COLUMNS, 6), artifacts


RES_SQL = residual_sql(L_SQL, ("m1", "m2"), "m3", RESIDUAL_ROWS)


@query("operating_residuals", RES_SQL + " SELECT * FROM res")
def operating_residual_rows(spark, sf):
    """Expected values, residuals and their z: own fits, or shared slopes with a level of its own per entity."""
    return residual_rows(_days(spark, sf))[0]


@query("residual_scopes", RES_SQL + " SELECT 'm1' AS sensor, count(*) AS entities, count(*) FILTER (n >= 190) AS own_fits FROM own_m1 UNION ALL SELECT 'm2', count(*), count(*) FILTER (n >= 190) FROM own_m2")
def residual_scopes(spark, sf):
    """How many entities have a fit of their own."""
    daily = _days(spark, sf)
    clean = clean_train(daily)
    artifacts = residual_rows(daily)[1]
    own = artifacts.filter("selected_scope = 'asset_tag'").groupBy("sensor").agg(F.count(F.lit(1)).alias("own_fits"))
    return own.withColumn("entities", clean.agg(F.countDistinct("entity")).scalar()).select("sensor", "entities", "own_fits")


def _residual_history_sql() -> str:
    from gearwatch.catalog.history import _range, lag_sql, over

    cols = []
    for x in ("m1_residual", "m1_residual_robust_z"):
        w = _range(-7, -1).format(by="entity")
        cols += [f"{lag_sql(x, k)} AS {x}_lag{k}" for k in (1, 3, 7)]
        cols += [f"round({over('median', x, -7, -1, 3)}, 9) AS {x}_median7", f"round({over('mad', x, -7, -1, 3)}, 9) AS {x}_mad7"]
        cols.append(f"round(CASE WHEN count({x}) OVER {w} >= 7 THEN regr_slope({x}, date_diff('day', DATE '2024-01-01', d)) OVER {w} END, 6) AS {x}_slope7")
    return ", ".join(cols)


@query("residual_history", RES_SQL + f" SELECT d, entity, m1_residual, m1_residual_robust_z, {_residual_history_sql()} FROM res")
def residual_history_rows(spark, sf):
    """History of residuals: lags, median, deviation and slope of the past week."""
    names = ["m1_residual", "m1_residual_robust_z"]
    out = residual_history(residual_rows(_days(spark, sf))[0].select("d", "entity", *names), ["entity"], "d", names)
    return rounded(rounded(out, [f"{c}_{x}" for c in names for x in ("median7", "mad7")]), [f"{c}_slope7" for c in names], 6)


_RES_CASE = CASE_SQL.removeprefix(Z_SQL).replace(", abs(z3) AS m3, abs(z4) AS m4", "").replace("m1, m2, m3, m4", "m1, m2")


@query(
    "case_control_residual",
    RES_SQL + ", z AS (SELECT d, entity, m1_residual_robust_z AS z1, m2_residual_robust_z AS z2 FROM res)" + _RES_CASE + f""", s AS ({_CASE_OUT}),
 k AS (SELECT failed_part, sensor, z_threshold, count(*) AS n, count(DISTINCT sign(anomaly_rate_diff_pp)) FILTER (anomaly_rate_diff_pp <> 0) AS signs FROM s WHERE period <> 'overall' GROUP BY ALL)
 SELECT s.*, CASE WHEN n < 2 THEN 'too_few_periods' WHEN signs <= 1 THEN 'consistent' ELSE 'mixed' END AS direction_status FROM s JOIN k USING (failed_part, sensor, z_threshold)""",
)
def case_control_residual(spark, sf):
    """The same comparison on operating-condition residuals."""
    z = residual_rows(_days(spark, sf), ["status", "failed_part", "failed_family"])[0].dropna(subset=["d", "entity"])
    days = C.with_periods(z, "d", VALID, TEST)
    out = C.direction(C.summarize(C.entity_effects(days, {m: f"{m}_residual_robust_z" for m in ("m1", "m2")})))
    return rounded(out, [*RATES[:5], "anomaly_rate_diff_pp"])
