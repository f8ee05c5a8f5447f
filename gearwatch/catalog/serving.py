"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import E_SQL, L_SQL, R_SQL, code_sql, query, rounded, severity_sql
from gearwatch.functions import expressions as X
from gearwatch.operators import joins as J
from gearwatch.operators import ranking as K
from gearwatch.operators import rollups as U
from gearwatch.operators import serving as S
from gearwatch.operators.quality import entity_catalog
from gearwatch.sources.warehouse import events_panel, region_panel, supplier_panel
from gearwatch.streaming import alerts as A

SEV7, SEV12 = severity_sql("points", 7), severity_sql("points", 12)
E_DAY = E_SQL + f", sd AS (SELECT *, {SEV7} AS severity FROM daily)"
R_DAY = R_SQL + f", sd AS (SELECT *, {SEV12} AS severity FROM daily)"
START, END = "2024-01-16", "2024-01-28"


def e_daily(spark, sf):
    return U.with_severity(U.entity_daily(events_panel(spark, sf)), 7)


def r_daily(spark, sf):
    return U.with_severity(U.entity_daily(region_panel(spark, sf)), 12)


@query(
    "kpis_period",
    E_DAY + f""", l AS (SELECT max(d) AS ld FROM sd WHERE d BETWEEN DATE '{START}' AND DATE '{END}'),
 f AS (SELECT *, d BETWEEN DATE '{START}' AND DATE '{END}' AS inp, severity = 'high_risk' AS hi, d = ld AS atl,
   d < DATE '{START}' AND d >= DATE '{START}' - CAST(date_diff('day', DATE '{START}', ld) + 1 AS INTEGER) AS prev FROM sd, l)
 SELECT count(DISTINCT entity) AS observed_machines, count(*) FILTER (inp AND points > 0) AS failure_machine_days, count(*) FILTER (inp AND hi) AS high_risk_days,
 round(100 * (count(*) FILTER (inp AND hi) / count(*) FILTER (inp)), 9) AS high_risk_rate_pct, round(100 * (count(*) FILTER (prev AND hi) / count(*) FILTER (prev)), 9) AS prev_high_risk_rate_pct,
 count(*) FILTER (atl AND hi) AS latest_high_risk_machines, round(100 * (count(*) FILTER (atl AND hi) / count(DISTINCT entity)), 9) AS failure_rate_pct,
 round(avg(m1) FILTER (atl), 9) AS avg_power, max(m2) FILTER (atl) AS max_heat, round(sum(amount) FILTER (inp), 4) AS parts_issue_value FROM f""",
)
def kpis_period(spark, sf):
    out = S.period_kpis(e_daily(spark, sf), None, START, END)
    return rounded(rounded(out, ["high_risk_rate_pct", "prev_high_risk_rate_pct", "failure_rate_pct", "avg_power"]), ["parts_issue_value"], 4)


@query(
    "organisation_kpis",
    E_DAY + """, l AS (SELECT max(d) AS ld FROM sd) SELECT count(*) FILTER (points > 0) AS failure_machine_days,
 round(100 * (count(*) FILTER (d = ld AND severity = 'high_risk') / count(DISTINCT entity)), 9) AS failure_rate_pct, round(sum(amount), 4) AS parts_issue_value,
 round(avg(m1) FILTER (d = ld), 9) AS avg_power FROM sd, l""",
)
def organisation_kpis(spark, sf):
    out = S.organisation_kpis(S.period_kpis(e_daily(spark, sf)))
    return rounded(rounded(out, ["failure_rate_pct", "avg_power"]), ["parts_issue_value"], 4)


@query(
    "trend_daily",
    E_DAY + """ SELECT d, count(*) FILTER (points > 0) AS failure_days,
 round(100 * (count(*) FILTER (severity = 'high_risk') / (SELECT count(DISTINCT entity) FROM sd)), 9) AS high_risk_pct FROM sd GROUP BY d""",
)
def trend_daily(spark, sf):
    return rounded(S.failure_trend(e_daily(spark, sf)), ["high_risk_pct"])


@query(
    "rate_change",
    E_DAY + """, t AS (SELECT d, 100 * (count(*) FILTER (severity = 'high_risk') / count(*)) AS p FROM sd GROUP BY d)
 SELECT a.d, round(round(a.p, 1) - round(b.p, 1), 1) AS change FROM t a JOIN t b ON b.d = a.d - INTERVAL 1 DAY""",
)
def rate_change(spark, sf):
    high = (F.col("severity") == "high_risk").cast("double")
    t = e_daily(spark, sf).groupBy("d").agg((F.avg(high) * 100).alias("p"))
    before = t.select(F.date_add("d", 1).alias("d"), F.col("p").alias("q"))
    return t.join(before, "d").select("d", X.rate_change("p", "q").alias("change"))


@query(
    "heatmap_bucket",
    L_SQL + """, c AS (SELECT entity, strftime(date_trunc('month', d), '%Y-%m') AS period, sum(failed_parts) AS n FROM daily GROUP BY ALL)
 SELECT e.entity, p.period, CAST(coalesce(n, 0) AS BIGINT) AS failed_part_count FROM (SELECT DISTINCT entity FROM c) e CROSS JOIN (SELECT DISTINCT period FROM c) p
 LEFT JOIN c ON c.entity = e.entity AND c.period = p.period""",
)
def heatmap_bucket(spark, sf):
    return S.failure_heatmap(U.entity_daily(supplier_panel(spark, sf)), "month")


@query(
    "heatmap_week",
    E_SQL + """, c AS (SELECT entity, strftime(date_trunc('week', d), '%Y-%m-%d') AS period, sum(failed_parts) AS n FROM daily GROUP BY ALL)
 SELECT e.entity, p.period, CAST(coalesce(n, 0) AS BIGINT) AS failed_part_count FROM (SELECT DISTINCT entity FROM c) e CROSS JOIN (SELECT DISTINCT period FROM c) p
 LEFT JOIN c ON c.entity = e.entity AND c.period = p.period""",
)
def heatmap_week(spark, sf):
    return S.failure_heatmap(U.entity_daily(events_panel(spark, sf)), "week")


@query(
    "period_coverage",
    R_SQL + """ SELECT strftime(date_trunc('month', d), '%Y-%m') AS period, count(DISTINCT d) AS observed_days,
 CAST(date_diff('day', date_trunc('month', d), date_trunc('month', d) + INTERVAL 1 MONTH) AS INTEGER) AS calendar_days FROM daily GROUP BY date_trunc('month', d)""",
)
def period_coverage(spark, sf):
    return S.period_coverage(U.entity_daily(region_panel(spark, sf)), "month")


_PRIO = """, l AS (SELECT max(d) AS ld FROM sd), pr AS (SELECT entity, min(etype) AS etype, min(site) AS site, coalesce(max(points) FILTER (d = ld), 0) AS points,
   coalesce(bool_or(severity = 'high_risk') FILTER (d = ld), false) AS threshold_exceeded, max(d) FILTER (points > 0) AS last_failure_date,
   count(*) FILTER (severity = 'high_risk' AND d >= ld - 29) AS high_risk_days_30d, coalesce(arg_max(failed_parts, d) FILTER (points > 0), 0) AS failed_part_count
   FROM sd, l GROUP BY entity), ranked AS (SELECT *, row_number() OVER (ORDER BY points DESC, entity) AS rank FROM pr)"""


@query("priority_table", E_DAY + _PRIO + " SELECT * FROM ranked")
def priority_table(spark, sf):
    return S.priority_table(e_daily(spark, sf), sort_by="high_risk_days_30d")


@query(
    "share_of_max",
    E_DAY + _PRIO + " SELECT entity, rank, round(high_risk_days_30d / max(high_risk_days_30d) OVER (), 9) AS share FROM ranked",
)
def share_of_max(spark, sf):
    return rounded(S.share_of_max(S.priority_table(e_daily(spark, sf)), "high_risk_days_30d").select("entity", "rank", "share"), ["share"])


@query(
    "onset_window",
    E_DAY + """, i AS (SELECT *, row_number() OVER w AS i, severity = 'high_risk' AND NOT coalesce(lag(severity = 'high_risk') OVER w, false) AS st FROM sd WINDOW w AS (PARTITION BY entity ORDER BY d)),
 s AS (SELECT entity, max(i) AS li FROM i WHERE st GROUP BY entity)
 SELECT i.entity, d, CAST(i - li AS INTEGER) AS relative_day, m2 FROM i JOIN s ON s.entity = i.entity WHERE i - li BETWEEN -7 AND 0""",
)
def onset_window(spark, sf):
    return S.onset_windows(e_daily(spark, sf), "m2")


@query(
    "islands",
    E_DAY + """, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) - row_number() OVER (PARTITION BY entity, points > 0 ORDER BY d) AS g FROM sd)
 SELECT entity, min(d) AS run_start, max(d) AS run_end, count(*) AS rows FROM i WHERE points > 0 GROUP BY entity, g""",
)
def islands(spark, sf):
    return S.true_runs(e_daily(spark, sf), F.col("points") > 0)


@query(
    "sparkline",
    R_DAY + """, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS r, max(d) OVER () AS ld FROM sd)
 SELECT entity, max(severity) FILTER (d = ld) AS grade, max(points) FILTER (d = ld) AS risk_score, string_agg(CAST(points AS VARCHAR), ',' ORDER BY d) AS sparkline FROM r WHERE r <= 30 GROUP BY entity""",
)
def sparkline(spark, sf):
    out = S.machine_status(r_daily(spark, sf))
    return out.withColumn("sparkline", F.array_join(F.transform("sparkline", lambda x: x.cast("string")), ","))


@query("mean_by_entity", R_SQL + " SELECT entity, round(avg(m2), 6) AS mean FROM daily GROUP BY entity")
def mean_by_entity(spark, sf):
    return rounded(S.mean_by_entity(U.entity_daily(region_panel(spark, sf)), "m2"), ["mean"], 6)


@query(
    "entity_details",
    E_DAY + f""", l AS (SELECT max(d) AS ld FROM sd) SELECT entity, max(etype) AS etype, max(site) AS site, max(severity) FILTER (d = ld) AS current_grade, max(points) FILTER (d = ld) AS risk_score,
 max(d) FILTER (points > 0) AS last_failure_date, count(*) FILTER (points > 0 AND d BETWEEN DATE '{START}' AND DATE '{END}') AS failure_days_count,
 round(avg(m1) FILTER (d BETWEEN DATE '{START}' AND DATE '{END}'), 9) AS avg_power FROM sd, l GROUP BY entity""",
)
def entity_details(spark, sf):
    return rounded(S.entity_details(e_daily(spark, sf), START, END), ["avg_power"])


@query(
    "entity_series",
    E_DAY + f" SELECT entity, d, m1, m2, points > 0 AS is_failure_day, severity = 'high_risk' AS is_high_risk_day FROM sd WHERE d BETWEEN DATE '{START}' AND DATE '{END}'",
)
def entity_series(spark, sf):
    return S.entity_series(S.scoped(e_daily(spark, sf), None, START, END), ["m1", "m2"])


@query(
    "last_days",
    R_SQL + " SELECT d, entity, points FROM daily WHERE d >= (SELECT max(d) FROM daily) - 29",
)
def last_days(spark, sf):
    return S.last_days(U.entity_daily(region_panel(spark, sf)).select("d", "entity", "points"), 30)


@query(
    "peer_compare",
    R_SQL + """, p AS (SELECT etype, min(entity) AS lo, max(entity) AS hi FROM daily GROUP BY etype HAVING count(DISTINCT entity) = 2),
 m AS (SELECT lo AS entity, hi AS peer FROM p UNION ALL SELECT hi, lo FROM p)
 SELECT a.entity, m.peer, a.d, a.m2 AS value, b.m2 AS peer_value FROM daily a JOIN m ON m.entity = a.entity LEFT JOIN daily b ON b.entity = m.peer AND b.d = a.d""",
)
def peer_compare(spark, sf):
    return J.peer_series(U.entity_daily(region_panel(spark, sf)), "entity", "etype", "d", "m2")


@query(
    "parts_top10",
    L_SQL + """, t AS (SELECT entity, member, round(sum(amount), 4) AS total FROM panel GROUP BY ALL HAVING sum(amount) > 0)
 SELECT entity, member, total FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY total DESC, member) AS r FROM t) WHERE r <= 3""",
)
def parts_top10(spark, sf):
    return rounded(S.part_totals(supplier_panel(spark, sf), 3), ["total"], 4)


def _page_sql(source: str, cols: str, order: str, page: int, size: int) -> str:
    return f" SELECT {cols}, r - 1 AS position FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM {source}) WHERE r > {page * size} AND r <= {(page + 1) * size}"


@query("table_page", E_SQL + _page_sql("panel", "d, entity, member, category, amount, m2", "amount DESC, d, entity, member", 25, 16))
def table_page(spark, sf):
    rows = events_panel(spark, sf).select("d", "entity", "member", "category", "amount", "m2")
    return K.page(rows, "amount", True, 25, 16, ["d", "entity", "member"])[0]


@query(
    "table_page_severity",
    E_DAY + f", c AS (SELECT d, entity, severity, CAST({code_sql('severity')} AS INTEGER) AS severity_code FROM sd)"
    + _page_sql("c", "d, entity, severity, severity_code", "severity_code, d, entity", 3, 16),
)
def table_page_severity(spark, sf):
    rows = e_daily(spark, sf).select("d", "entity", "severity", "severity_code")
    return K.page(rows, "severity_code", False, 3, 16, ["d", "entity"])[0]


@query(
    "table_last_page",
    E_SQL + """, r AS (SELECT d, entity, member, category, row_number() OVER (ORDER BY category NULLS LAST, d, entity, member) - 1 AS position, count(*) OVER () AS n FROM panel)
 SELECT d, entity, member, category, position FROM r WHERE position >= CAST(floor((n - 1) / 16) AS BIGINT) * 16""",
)
def table_last_page(spark, sf):
    """A page number past the end is clamped; NULL categories come last."""
    rows = events_panel(spark, sf).select("d", "entity", "member", "category")
    return K.page(rows, "category", False, 10**9, 16, ["d", "entity", "member"])[0]


@query(
    "display_rows",
    E_SQL + """ SELECT strftime(d, '%Y-%m-%d') AS d, CAST(entity AS VARCHAR) AS entity, member, format('{:,}', qty) AS qty, coalesce(category, 'no work') AS category FROM panel""",
)
def display_rows(spark, sf):
    p = events_panel(spark, sf)
    return p.select(
        X.display("d", "date").alias("d"), X.display("entity", "text").alias("entity"), X.display("member", "text").alias("member"),
        X.display("qty", "int_comma").alias("qty"), X.display("category", "category").alias("category"),
    )


@query(
    "fleet_overview",
    E_SQL + """, x AS (SELECT entity, d, sum(flag) AS flags, max(m1) AS power FROM panel GROUP BY ALL), l AS (SELECT max(d) AS ld FROM x)
 SELECT entity, CAST(coalesce(max(flags) FILTER (d = ld), 0) AS BIGINT) AS latest_flags, count(*) FILTER (flags > 0) AS fault_days, round(avg(power), 9) AS mean_power FROM x, l GROUP BY entity""",
)
def fleet_overview(spark, sf):
    return rounded(S.fleet_overview(events_panel(spark, sf)), ["mean_power"])


@query(
    "part_status",
    E_SQL + """ SELECT entity, member, arg_max(flag, d) AS last_flag, count(*) FILTER (flag = 1) AS flag_days, CAST(sum(qty) AS BIGINT) AS qty, round(sum(amount), 4) AS amount,
 count(*) FILTER (qty > 0) AS issue_days, max(d) FILTER (qty > 0) AS last_issue FROM panel GROUP BY entity, member""",
)
def part_status(spark, sf):
    return rounded(S.part_status(events_panel(spark, sf)), ["amount"], 4)


@query("issue_events", E_SQL + " SELECT d, entity, member, qty, amount FROM panel WHERE qty > 0 ORDER BY d DESC, entity, member LIMIT 50")
def issue_events(spark, sf):
    return S.issue_events(events_panel(spark, sf), 50)


@query(
    "latest_context",
    L_SQL + """, r AS (SELECT entity, d, m2 AS value, avg(m2) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving,
   row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS r FROM daily), h AS (SELECT * FROM r WHERE r = 1),
 s AS (SELECT r.entity, median(r.value) AS median, 100 * avg(CAST(r.value <= h.value AS INTEGER)) AS percentile FROM r JOIN h ON h.entity = r.entity WHERE r.r BETWEEN 2 AND 91 GROUP BY r.entity)
 SELECT h.entity, d, value, round(moving, 6) AS moving, round(median, 6) AS median, round(percentile, 9) AS percentile, round(value - median, 6) AS delta FROM h LEFT JOIN s ON s.entity = h.entity""",
)
def latest_context(spark, sf):
    out = S.latest_context(U.entity_daily(supplier_panel(spark, sf)), "m2", 90)
    return rounded(rounded(out, ["percentile"]), ["moving", "median", "delta"], 6)


@query(
    "histogram",
    R_SQL + """, s AS (SELECT least(24, greatest(5, CAST(floor(count(m3) / 4) AS INTEGER))) AS bins, min(m3) AS lo, max(m3) AS hi FROM daily),
 b AS (SELECT least(CAST(floor((m3 - lo) / ((hi - lo) / bins)) AS INTEGER), bins - 1) AS bin, count(*) AS n FROM daily, s GROUP BY 1)
 SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS rows FROM range(24) g(i) LEFT JOIN b ON b.bin = i WHERE i < (SELECT bins FROM s)""",
)
def histogram(spark, sf):
    return S.histogram(U.entity_daily(region_panel(spark, sf)), "m3")


@query(
    "facets",
    E_SQL + """, c AS (SELECT entity, min(etype) AS etype, min(site) AS site FROM panel GROUP BY entity)
 SELECT DISTINCT 'site' AS facet, CAST(site AS VARCHAR) AS option FROM c WHERE etype = 2 UNION ALL SELECT DISTINCT 'etype', CAST(etype AS VARCHAR) FROM c WHERE site = 1
 UNION ALL SELECT DISTINCT 'entity', CAST(entity AS VARCHAR) FROM c WHERE site = 1 AND etype = 2""",
)
def facets(spark, sf):
    return S.facet_options(entity_catalog(events_panel(spark, sf)), {"site": 1, "etype": 2, "entity": None})


@query(
    "flags_on_dates",
    L_SQL + """, t AS (SELECT DISTINCT d FROM daily), f AS (SELECT d, CAST(sum(flag) AS BIGINT) AS flags FROM panel WHERE grade = 'A' AND flag = 1 GROUP BY d)
 SELECT t.d, coalesce(flags, 0) AS flags FROM t LEFT JOIN f ON f.d = t.d""",
)
def flags_on_dates(spark, sf):
    p = supplier_panel(spark, sf)
    flags = p.filter("grade = 'A' AND flag = 1").groupBy("d").agg(F.sum("flag").alias("flags"))
    return S.flags_on_dates(flags, p.select("d").distinct())


@query(
    "cyclic_neighbours",
    L_SQL + """, e AS (SELECT DISTINCT entity FROM panel) SELECT entity, coalesce(lag(entity) OVER (ORDER BY entity), (SELECT max(entity) FROM e)) AS previous,
 coalesce(lead(entity) OVER (ORDER BY entity), (SELECT min(entity) FROM e)) AS next FROM e""",
)
def cyclic_neighbours(spark, sf):
    return K.with_neighbours(supplier_panel(spark, sf), "entity")


@query(
    "alerts_latest",
    E_DAY + """, l AS (SELECT * FROM sd WHERE d = (SELECT max(d) FROM sd))
 SELECT d, entity, 'any_failure' AS rule, points FROM l WHERE points >= 1 UNION ALL SELECT d, entity, 'high_risk', points FROM l WHERE points >= 7""",
)
def alerts_latest(spark, sf):
    return A.alerts_of(A.latest_rows(e_daily(spark, sf)), {"any_failure": 1, "high_risk": 7})


@query(
    "alerts_new_only",
    E_DAY + """, l AS (SELECT * FROM sd WHERE d >= (SELECT max(d) FROM sd) - 1), a AS (SELECT d, entity, 'any_failure' AS rule, points FROM l WHERE points >= 1 UNION ALL SELECT d, entity, 'high_risk', points FROM l WHERE points >= 7)
 SELECT * FROM a WHERE d = (SELECT max(d) FROM sd)""",
)
def alerts_new_only(spark, sf):
    """The day before is stored already; only the rest is inserted."""
    rules = {"any_failure": 1, "high_risk": 7}
    both = A.alerts_of(S.last_days(e_daily(spark, sf), 2), rules)
    stored = both.filter(F.col("d") < both.agg(F.max("d")).scalar())
    return J.only_new(both, stored, ["d", "entity", "rule"])


@query(
    "failed_parts_latest",
    E_SQL + " SELECT d, entity, member FROM panel WHERE flag = 1 AND d = (SELECT max(d) FROM panel)",
)
def failed_parts_latest(spark, sf):
    return A.latest_rows(events_panel(spark, sf)).filter("flag = 1").select("d", "entity", "member")


@query(
    "alert_summary",
    E_DAY + """, a AS (SELECT d, entity, 'any_failure' AS rule FROM sd WHERE points >= 1 UNION ALL SELECT d, entity, 'high_risk' FROM sd WHERE points >= 7)
 SELECT rule, CASE rule WHEN 'any_failure' THEN 'any failure' ELSE 'high risk' END AS label, count(*) AS alerts, count(DISTINCT entity) AS entities, max(d) AS latest FROM a GROUP BY rule""",
)
def alert_summary(spark, sf):
    rows = A.alerts_of(e_daily(spark, sf), {"any_failure": 1, "high_risk": 7})
    return A.alert_summary(rows, {"any_failure": "any failure", "high_risk": "high risk"})


_REVIEWED = """, a AS (SELECT d, entity, 'any_failure' AS rule, points FROM sd WHERE points >= 1 UNION ALL SELECT d, entity, 'high_risk', points FROM sd WHERE points >= 7),
 v AS (SELECT d, entity, rule, CASE WHEN points % 2 = k % 2 THEN 'reviewed' ELSE 'unreviewed' END AS status, CAST(d AS TIMESTAMP) + INTERVAL (((entity * 7 + k * 5) % 11)) HOUR AS t_at FROM a, range(3) r(k) WHERE entity % 3 <> 0),
 w AS (SELECT d, entity, rule, status, t_at FROM (SELECT *, row_number() OVER (PARTITION BY d, entity, rule ORDER BY t_at DESC, CASE status WHEN 'reviewed' THEN 0 ELSE 1 END) AS r FROM v) WHERE r = 1)"""


def _reviewed(spark, sf):
    alerts = A.alerts_of(e_daily(spark, sf), {"any_failure": 1, "high_risk": 7})
    events = alerts.filter("entity % 3 <> 0").withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    reviews = events.select(
        "d", "entity", "rule", F.when(F.col("points") % 2 == F.col("k") % 2, "reviewed").otherwise("unreviewed").alias("status"),
        F.expr("CAST(d AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST((entity * 7 + k * 5) % 11 AS INT))").alias("at"),
    )
    return A.with_reviews(alerts, reviews)


@query(
    "alert_reviews",
    E_DAY + _REVIEWED + """ SELECT d, entity, rule, points, coalesce(status, 'unreviewed') AS status, strftime(t_at, '%Y-%m-%d %H:%M:%S') AS reviewed_at FROM a LEFT JOIN w USING (d, entity, rule)""",
)
def alert_reviews(spark, sf):
    """Alerts with the state of their latest review by event time."""
    return _reviewed(spark, sf).withColumn("reviewed_at", F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "alert_review_summary",
    E_DAY + _REVIEWED + """ SELECT rule, CASE rule WHEN 'any_failure' THEN 'any failure' ELSE 'high risk' END AS label, count(*) AS alerts, count(DISTINCT entity) AS entities, max(d) AS latest,
 count(*) FILTER (coalesce(status, 'unreviewed') = 'unreviewed') AS unreviewed, count(*) FILTER (status = 'reviewed') AS reviewed FROM a LEFT JOIN w USING (d, entity, rule) GROUP BY rule""",
)
def alert_review_summary(spark, sf):
    return A.review_summary(_reviewed(spark, sf), {"any_failure": "any failure", "high_risk": "high risk"})
