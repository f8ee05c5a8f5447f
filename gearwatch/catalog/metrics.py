"""Evaluation, threshold and selection queries over a scored forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import E_SQL, R_SQL, period_sql, query, rounded, severity_sql
from gearwatch.catalog.history import over
from gearwatch.catalog.labels import binary_sql
from gearwatch.functions import expressions as X
from gearwatch.operators import baselines, metrics, ranking, rollups, selection, splits, thresholds
from gearwatch.operators.joins import compare_columns, scope_rows
from gearwatch.operators.labels import future_label
from gearwatch.operators.history import Past, add_history
from gearwatch.plans.risk import evaluate_forecast, forecast_frame, scored_forecast
from gearwatch.sources.warehouse import EVENT_SPLIT, PART_SPLIT, events_panel, region_panel

V, T = EVENT_SPLIT

SCORED_SQL = E_SQL + f""", risky AS (SELECT *, CAST(points >= 7 AS INTEGER) AS risk_today FROM daily),
 lab AS (SELECT *, {binary_sql('risk_today', 'entity', 3)} AS target, {over('avg', 'points', -7, -1)} AS points_mean7,
   CAST(d + INTERVAL 3 DAY AS DATE) AS label_end FROM risky),
 sp AS (SELECT *, CASE WHEN d >= DATE '{T}' THEN 'test' WHEN d >= DATE '{V}' AND label_end < DATE '{T}' THEN 'valid'
   WHEN d < DATE '{V}' AND label_end < DATE '{V}' THEN 'train' END AS split FROM lab),
 known AS (SELECT * FROM sp WHERE target IS NOT NULL AND split IS NOT NULL),
 rates AS (SELECT entity, avg(target) AS rate FROM known WHERE split = 'train' GROUP BY entity),
 scored AS (SELECT d, known.entity, etype, split, target AS y,
   coalesce(rate, (SELECT avg(target) FROM known WHERE split = 'train')) AS rate,
   round(coalesce(rate, (SELECT avg(target) FROM known WHERE split = 'train')) * 0.7 + coalesce(points_mean7, 0.0) / 10.0 * 0.3, 6) AS score
   FROM known LEFT JOIN rates ON rates.entity = known.entity)"""


def curve_sql(source: str, by: str) -> str:
    """score table of a (by, score, y) source as CTE ``st``."""
    return f""", st AS (SELECT {by}, score, n, pos, CAST(sum(n) OVER w AS BIGINT) AS alerts, CAST(sum(pos) OVER w AS BIGINT) AS tp,
   CAST(sum(n) OVER (PARTITION BY {by}) AS BIGINT) AS tot, CAST(sum(pos) OVER (PARTITION BY {by}) AS BIGINT) AS ptot
   FROM (SELECT {by}, score, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM {source} GROUP BY {by}, score)
   WINDOW w AS (PARTITION BY {by} ORDER BY score DESC))"""


CURVE = SCORED_SQL + curve_sql("scored", "split")

QUALITY_SQL = """, q AS (SELECT split, max(tot) AS rows, max(ptot) AS positives, CAST(max(ptot) AS DOUBLE) AS p, max(tot) - max(ptot) AS neg,
   sum(pos * (tp / alerts)) AS ap, sum((n - pos) * (tp - pos / 2)) AS auc,
   sum(pos * (tp / alerts + CASE WHEN alerts > n THEN (tp - pos) / (alerts - n) ELSE 1.0 END) / 2) AS pr FROM st GROUP BY split)
 SELECT split, rows, positives, round(p / rows, 9) AS positive_rate, CASE WHEN p > 0 AND neg > 0 THEN round(ap / p, 9) END AS average_precision,
 CASE WHEN p > 0 AND neg > 0 THEN round(auc / (p * neg), 9) END AS roc_auc, CASE WHEN p > 0 AND neg > 0 THEN round(pr / p, 9) END AS pr_auc_trapezoid,
 CASE WHEN p > 0 AND neg > 0 THEN round(ap / p / (p / rows), 9) END AS ap_lift FROM q"""
RANKED = ["positive_rate", "average_precision", "roc_auc", "pr_auc_trapezoid", "ap_lift"]


def scored(spark, sf):
    return scored_forecast(events_panel(spark, sf), 7, 3, V, T)


@query("risk_forecast_quality", CURVE + QUALITY_SQL)
def risk_forecast_quality(spark, sf):
    return rounded(evaluate_forecast(events_panel(spark, sf), 7, 3, V, T), RANKED)


@query(
    "group_rate_baseline",
    SCORED_SQL + """ SELECT d, entity, split, y, round(rate, 9) AS rate, score FROM scored""",
)
def group_rate_baseline(spark, sf):
    return rounded(scored(spark, sf).select("d", "entity", "split", "y", "rate", "score"), ["rate"])


@query(
    "group_rate_table",
    SCORED_SQL + """ SELECT entity, count(*) AS rows, round(avg(y), 9) AS rate FROM scored WHERE split = 'train' GROUP BY entity
 UNION ALL SELECT NULL, count(*), round(avg(y), 9) FROM scored WHERE split = 'train'""",
)
def group_rate_table(spark, sf):
    train = scored(spark, sf).filter("split = 'train'")
    table = baselines.group_rate_table(train, ["entity"], "y")
    prior = train.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("y").cast("double")).alias("rate"))
    return rounded(table.unionByName(prior, allowMissingColumns=True), ["rate"])


@query("avg_precision", "SELECT split, average_precision FROM (" + CURVE + QUALITY_SQL + ")")
def avg_precision(spark, sf):
    return rounded(metrics.ranking_quality(scored(spark, sf), ["split"]).select("split", "average_precision"), ["average_precision"])


@query("roc_auc", "SELECT split, roc_auc FROM (" + CURVE + QUALITY_SQL + ")")
def roc_auc(spark, sf):
    return rounded(metrics.ranking_quality(scored(spark, sf), ["split"]).select("split", "roc_auc"), ["roc_auc"])


_CURVE_POINTS = """, pts AS (SELECT split, tot, row_number() OVER (PARTITION BY split ORDER BY score) - 1 AS position, count(*) OVER (PARTITION BY split) + 1 AS points,
   score AS cutoff, tp / alerts AS precision, tp / ptot AS recall FROM st),
 curve AS (SELECT split, position, points, cutoff, precision, recall FROM pts
   UNION ALL SELECT split, max(position) + 1, max(points), NULL, 1.0, 0.0 FROM pts GROUP BY split)"""


@query(
    "pr_auc_trap",
    CURVE + _CURVE_POINTS + """ SELECT split, points, position, cutoff, round(precision, 9) AS precision, round(recall, 9) AS recall FROM curve""",
)
def pr_auc_trap(spark, sf):
    return rounded(metrics.pr_curve(scored(spark, sf), ["split"]), ["precision", "recall"])


@query(
    "pr_curve_thinned",
    CURVE + _CURVE_POINTS + """, kept AS (SELECT DISTINCT split, CAST(floor(j * ((points - 1) / (least(points, 60) - 1))) AS BIGINT) AS position
   FROM (SELECT split, max(points) AS points FROM curve GROUP BY split), range(60) r(j) WHERE j < least(points, 60))
 SELECT split, points, position, cutoff, round(precision, 9) AS precision, round(recall, 9) AS recall FROM curve JOIN kept USING (split, position)""",
)
def pr_curve_thinned(spark, sf):
    return rounded(metrics.pr_curve(scored(spark, sf), ["split"], max_points=60), ["precision", "recall"])


@query("brier", SCORED_SQL + " SELECT split, round(avg((score - y) * (score - y)), 9) AS brier FROM scored GROUP BY split")
def brier(spark, sf):
    return rounded(metrics.brier(scored(spark, sf), ["split"]), ["brier"])


def confusion_sql(source: str, by: str, cut: str) -> str:
    return f""" SELECT {by}, count(*) FILTER (score >= {cut} AND y = 1) AS tp, count(*) FILTER (score >= {cut} AND y = 0) AS fp,
 count(*) FILTER (score < {cut} AND y = 1) AS fn, count(*) FILTER (score < {cut} AND y = 0) AS tn, count(*) AS rows,
 count(*) FILTER (y = 1) AS positives FROM {source} GROUP BY {by}"""


RATES_SQL = """ SELECT *, round((tp + tn) / rows, 9) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1,
 round((tp + fp) / rows, 9) AS alert_rate, round((fp + tn) / rows, 9) AS always_negative_accuracy FROM c"""
RATES = ["accuracy", "precision", "recall", "f1", "alert_rate", "always_negative_accuracy"]


@query("confusion_at_cutoff", SCORED_SQL + f", c AS ({confusion_sql('scored', 'split', '0.3')})" + RATES_SQL)
def confusion_at_cutoff(spark, sf):
    return rounded(metrics.at_cutoff(scored(spark, sf), ["split"], 0.3), RATES)


@query(
    "slice_metrics",
    SCORED_SQL + """, sc AS (SELECT *, unnest([{'k': 'overall', 'v': 'all'}, {'k': 'machine_type', 'v': CAST(etype AS VARCHAR)},
   {'k': 'asset_tag', 'v': CAST(entity AS VARCHAR)}]) AS s FROM scored WHERE split = 'test'),
 z AS (SELECT s.k AS scope_kind, s.v AS scope_name, y, score FROM sc)""" + f", c AS ({confusion_sql('z', 'scope_kind, scope_name', '0.3')})" + RATES_SQL,
)
def slice_metrics(spark, sf):
    test = scored(spark, sf).filter("split = 'test'")
    rows = scope_rows(test, {"overall": None, "machine_type": "etype", "asset_tag": "entity"})
    return rounded(metrics.at_cutoff(rows, ["scope_kind", "scope_name"], 0.3), RATES)


@query(
    "undefined_notes",
    SCORED_SQL + f""", c AS ({confusion_sql('scored', 'split, entity', '0.3')})
 SELECT split, entity, concat_ws('; ', CASE WHEN tp + fp = 0 THEN 'no predicted positives: precision undefined' END,
 CASE WHEN positives = 0 THEN 'no actual positives: recall undefined' END, CASE WHEN positives = rows THEN 'no actual negatives: pr_auc undefined' END,
 CASE WHEN positives = 0 OR positives = rows THEN 'single class: pr_auc undefined' END) AS notes FROM c""",
)
def undefined_notes(spark, sf):
    c = metrics.at_cutoff(scored(spark, sf), ["split", "entity"], 0.3)
    return c.select("split", "entity", X.undefined_notes("rows", "positives", F.col("tp") + F.col("fp")).alias("notes"))


@query(
    "top_share",
    CURVE + """, k AS (SELECT *, greatest(1, CAST(ceil(tot * 0.1) AS BIGINT)) AS k FROM st)
 SELECT split, k, round((tp - pos + (k - alerts + n) * (pos / n)) / k, 9) AS precision FROM k WHERE alerts - n < k AND k <= alerts""",
)
def top_share(spark, sf):
    return rounded(metrics.top_share(scored(spark, sf), ["split"], 0.10), ["precision"])


@query(
    "rank_at_pct",
    SCORED_SQL + """, r AS (SELECT split, y, row_number() OVER (PARTITION BY split ORDER BY score DESC, d, entity) AS rk, count(*) OVER (PARTITION BY split) AS n,
   sum(y) OVER (PARTITION BY split) AS p FROM scored),
 g AS (SELECT split, percent, greatest(1, CAST(ceil(max(n) * percent / 100) AS BIGINT)) AS k, max(n) AS n, max(p) AS p,
   CAST(sum(CASE WHEN rk <= greatest(1, ceil(n * percent / 100)) THEN y ELSE 0 END) AS DOUBLE) AS hits
   FROM r CROSS JOIN (VALUES (5), (10), (20)) v(percent) GROUP BY split, percent)
 SELECT split, percent, k, round(hits / k, 9) AS precision, round(hits / p, 9) AS recall, round(hits / k / (p / n), 9) AS lift FROM g""",
)
def rank_at_pct(spark, sf):
    return rounded(metrics.rank_at_percent(scored(spark, sf), ["split"], ["d", "entity"]), ["precision", "recall", "lift"])


_CAND = """, cand AS (SELECT split, least(greatest(score, 0), 1) AS cutoff, alerts, n, tp, tot, ptot, tp / alerts AS precision, tp / ptot AS recall, 2 * tp / (alerts + ptot) AS f1 FROM st)"""


def _policy(name: str, where: str, order: str) -> str:
    return f"""SELECT s.split, '{name}' AS policy, b.cutoff, CASE WHEN b.cutoff IS NULL THEN 'unavailable' ELSE 'ok' END AS status
 FROM (SELECT DISTINCT split FROM st) s LEFT JOIN (SELECT split, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {order}) AS r
 FROM cand WHERE {where}) WHERE r = 1) b ON b.split = s.split"""


_TOP = """alerts - n < greatest(1, ceil(tot * 0.1)) AND greatest(1, ceil(tot * 0.1)) <= alerts"""


@query(
    "best_f1_threshold",
    CURVE + _CAND + " " + " UNION ALL ".join([
        _policy("f1", "true", "f1 DESC, cutoff DESC"),
        _policy("min_precision_30", "precision >= 0.3", "recall DESC, cutoff DESC"),
        _policy("min_precision_99", "precision >= 0.99", "recall DESC, cutoff DESC"),
        _policy("top_10pct", _TOP, "cutoff DESC"),
    ]),
)
def best_f1_threshold(spark, sf):
    return thresholds.choose_cutoffs(scored(spark, sf), ["split"], (0.3, 0.99), (0.1,))


@query(
    "family_thresholds",
    CURVE + _CAND + " " + " UNION ALL ".join([
        _policy("f1", "true", "f1 DESC, cutoff DESC"),
        _policy("min_precision_70", "precision >= 0.7", "recall DESC, cutoff DESC"),
        _policy("min_precision_80", "precision >= 0.8", "recall DESC, cutoff DESC"),
        _policy("top_10pct", _TOP, "cutoff DESC"),
    ]),
)
def family_thresholds(spark, sf):
    return thresholds.family_cutoffs(scored(spark, sf), ["split"])


def grid_sql(source: str, by: str, points: int, step: str) -> str:
    return f"""g AS (SELECT {by}, cutoff, coalesce(2 * count(*) FILTER (score >= cutoff AND y = 1)
   / nullif(count(*) FILTER (score >= cutoff) + count(*) FILTER (y = 1), 0), 0) AS f1
   FROM {source} CROSS JOIN (SELECT round(0.05::DOUBLE + {step}::DOUBLE * i, 10) AS cutoff FROM range({points}) r(i)) GROUP BY {by}, cutoff),
 best AS (SELECT {by}, cutoff, f1 FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY f1 DESC, round(abs(cutoff - 0.5), 6), cutoff) AS r FROM g) WHERE r = 1)"""


@query("cutoff_grid", SCORED_SQL + ", " + grid_sql("scored", "split", 91, "0.01") + " SELECT split, cutoff, round(f1, 9) AS f1 FROM best")
def cutoff_grid(spark, sf):
    return rounded(thresholds.grid_cutoff(scored(spark, sf), ["split"]), ["f1"])


@query("cutoff_grid_19", SCORED_SQL + ", " + grid_sql("scored", "split", 19, "0.05") + " SELECT split, cutoff, round(f1, 9) AS f1 FROM best")
def cutoff_grid_19(spark, sf):
    return rounded(thresholds.grid_cutoff(scored(spark, sf), ["split"], 0.05, 0.05, 19), ["f1"])


@query(
    "type_cutoffs",
    SCORED_SQL + ", va AS (SELECT * FROM scored WHERE split = 'valid'), " + grid_sql("va", "etype", 91, "0.01")
    + """, tp AS (SELECT etype, y, score, cutoff FROM scored JOIN best USING (etype) WHERE split = 'test'),
 c AS (SELECT etype, count(*) FILTER (score >= cutoff AND y = 1) AS tp, count(*) FILTER (score >= cutoff AND y = 0) AS fp,
   count(*) FILTER (score < cutoff AND y = 1) AS fn, count(*) FILTER (score < cutoff AND y = 0) AS tn, count(*) AS rows, count(*) FILTER (y = 1) AS positives FROM tp GROUP BY etype)
 SELECT c.*, round((tp + tn) / rows, 9) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1,
 round((tp + fp) / rows, 9) AS alert_rate, round((fp + tn) / rows, 9) AS always_negative_accuracy,
 cutoff, CASE WHEN positives = 0 THEN 'no positives' WHEN positives = rows THEN 'no negatives' ELSE 'ok' END AS status FROM c JOIN best USING (etype)""",
)
def type_cutoffs(spark, sf):
    rows = scored(spark, sf)
    cuts = thresholds.grid_cutoff(rows.filter("split = 'valid'"), ["etype"]).select("etype", "cutoff")
    applied = thresholds.apply_cutoffs(rows.filter("split = 'test'"), cuts, ["etype"])
    out = rounded(metrics.confusion(applied, ["etype"]), RATES).join(cuts, "etype")
    status = F.when(F.col("positives") == 0, "no positives").when(F.col("positives") == F.col("rows"), "no negatives")
    return out.withColumn("status", status.otherwise("ok"))


# --- regression and classes: predict a day's score from the entity's recent mean ---

REG_SQL = R_SQL + f""", h AS (SELECT d, entity, points, {over('avg', 'points', -7, -1, 7)} AS guess, {period_sql(*PART_SPLIT)} AS split FROM daily),
 reg AS (SELECT d, entity, split, CAST(points AS DOUBLE) AS actual, round(guess, 6) AS predicted,
   CASE WHEN points <= 0 THEN 'normal' WHEN points <= 5 THEN 'caution' WHEN points <= 11 THEN 'risk' ELSE 'high_risk' END AS actual_level,
   CASE WHEN guess < 0.5 THEN 'normal' WHEN guess < 5.5 THEN 'caution' WHEN guess < 11.5 THEN 'risk' ELSE 'high_risk' END AS predicted_level
   FROM h WHERE guess IS NOT NULL)"""


def regression_rows(spark, sf):
    daily = rollups.entity_daily(region_panel(spark, sf)).select("d", "entity", "points")
    past = add_history(daily, ["entity"], "d", [Past("guess", "points", "mean", -7, -1, 7)])
    rows = past.filter(F.col("guess").isNotNull()).select(
        "d", "entity", splits.period_column("d", *PART_SPLIT).alias("split"),
        F.col("points").cast("double").alias("actual"), F.round("guess", 6).alias("predicted"), "guess",
    )
    return metrics.with_score_levels(rows, "actual", "guess").drop("guess")


@query(
    "regression_metrics",
    REG_SQL + """ SELECT split, count(*) AS rows, round(avg(abs(actual - predicted)), 9) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 9) AS rmse,
 round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)), 9) AS r2 FROM reg GROUP BY split""",
)
def regression_metrics(spark, sf):
    return rounded(metrics.regression_errors(regression_rows(spark, sf), ["split"], "actual", "predicted", True), ["mae", "rmse", "r2"])


@query(
    "spearman",
    REG_SQL + """, k AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY actual) + (count(*) OVER (PARTITION BY split, actual) - 1) / 2.0 AS rx,
   rank() OVER (PARTITION BY split ORDER BY predicted) + (count(*) OVER (PARTITION BY split, predicted) - 1) / 2.0 AS ry FROM reg)
 SELECT split, count(*) AS rows, round(corr(rx, ry), 9) AS spearman FROM k GROUP BY split""",
)
def spearman(spark, sf):
    return rounded(metrics.spearman(regression_rows(spark, sf), ["split"], "actual", "predicted"), ["spearman"])


_PER_CLASS = """, levels(class_order, class) AS (VALUES (0, 'normal'), (1, 'caution'), (2, 'risk'), (3, 'high_risk')),
 pc AS (SELECT split, CAST(class_order AS INTEGER) AS class_order, class, count(*) FILTER (actual_level = class AND predicted_level = class) AS tp,
   count(*) FILTER (actual_level <> class AND predicted_level = class) AS fp, count(*) FILTER (actual_level = class AND predicted_level <> class) AS fn
   FROM reg CROSS JOIN levels GROUP BY split, class_order, class),
 pr AS (SELECT split, class_order, class, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
   CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, tp + fn AS support FROM pc)"""


@query("per_class", REG_SQL + _PER_CLASS + " SELECT split, class_order, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM pr")
def per_class(spark, sf):
    return rounded(metrics.per_class(regression_rows(spark, sf), ["split"], "actual_level", "predicted_level"), ["precision", "recall", "f1"])


@query(
    "class_confusion",
    REG_SQL + """, l(c) AS (VALUES ('normal'), ('caution'), ('risk'), ('high_risk'))
 SELECT split, a.c AS actual, p.c AS predicted, count(*) FILTER (actual_level = a.c AND predicted_level = p.c) AS rows FROM reg CROSS JOIN l a CROSS JOIN l p GROUP BY ALL""",
)
def class_confusion(spark, sf):
    return metrics.class_confusion(regression_rows(spark, sf), ["split"], "actual_level", "predicted_level")


_CELL = "count(*) FILTER (actual_level = '{a}' AND predicted_level = '{p}')"
_JSON = "'[' || " + " || ',' || ".join(
    "'[' || " + " || ',' || ".join(_CELL.format(a=a, p=p) for p in X.SEVERITY_LEVELS) + " || ']'" for a in X.SEVERITY_LEVELS
) + " || ']'"


@query(
    "multiclass",
    REG_SQL + _PER_CLASS + f""", acc AS (SELECT split, round(avg(CAST(actual_level = predicted_level AS INTEGER)), 9) AS accuracy, {_JSON} AS confusion_matrix_json FROM reg GROUP BY split)
 SELECT split, accuracy, confusion_matrix_json, CAST(sum(support) AS BIGINT) AS rows, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall,
 round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
 round(max(CASE WHEN class = 'high_risk' THEN precision END), 9) AS top_precision, round(max(CASE WHEN class = 'high_risk' THEN recall END), 9) AS top_recall,
 round(max(CASE WHEN class = 'high_risk' THEN f1 END), 9) AS top_f1 FROM pr JOIN acc USING (split) GROUP BY split, accuracy, confusion_matrix_json""",
)
def multiclass(spark, sf):
    out = metrics.multiclass_summary(regression_rows(spark, sf), ["split"], "actual_level", "predicted_level")
    return rounded(out, ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "top_precision", "top_recall", "top_f1"])


# --- multi-label: families of an entity-day scored by their own history ---

FAM_SQL = E_SQL + f""", fh AS (SELECT d, entity, family, affected AS y, {over('avg', 'affected', -7, -1, 1, 'entity, family')} AS past, {period_sql(V, T)} AS split FROM fam),
 ml AS (SELECT d, entity, family, split, y, round(past, 6) AS score, CAST(past >= 0.8 AS INTEGER) AS predicted FROM fh WHERE past IS NOT NULL)"""


def family_scores(spark, sf, min_days: int = 1):
    fam = rollups.family_daily(events_panel(spark, sf)).select("d", "entity", "family", "affected")
    past = add_history(fam, ["entity", "family"], "d", [Past("past", "affected", "mean", -7, -1, min_days)])
    return past.filter(F.col("past").isNotNull()).select(
        "d", "entity", "family", splits.period_column("d", V, T).alias("split"), F.col("affected").alias("y"),
        F.round("past", 6).alias("score"), (F.col("past") >= 0.8).cast("int").alias("predicted"),
    )


@query(
    "multilabel",
    FAM_SQL + curve_sql("ml", "split, family") + """, ap AS (SELECT split, family, sum(pos * (tp / alerts)) / max(ptot) AS ap FROM st GROUP BY split, family),
 c AS (SELECT split, family, count(*) FILTER (predicted = 1 AND y = 1) AS tp, count(*) FILTER (predicted = 1 AND y = 0) AS fp,
   count(*) FILTER (predicted = 0 AND y = 1) AS fn, count(*) FILTER (predicted = 0 AND y = 0) AS tn FROM ml GROUP BY split, family),
 m AS (SELECT split, count(*) AS evaluated, avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) AS mp, avg(tp / (tp + fn)) AS mr,
   avg(2 * tp / (2 * tp + fp + fn)) AS mf, avg(ap) AS map, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM c JOIN ap USING (split, family) GROUP BY split),
 s2 AS (SELECT split, score, n, pos, sum(n) OVER w AS alerts, sum(pos) OVER w AS tp FROM (SELECT split, score, count(*) AS n, sum(y) AS pos FROM ml GROUP BY split, score)
   WINDOW w AS (PARTITION BY split ORDER BY score DESC)),
 mi AS (SELECT split, sum(pos * (tp / alerts)) / sum(pos) AS ap FROM s2 GROUP BY split),
 ex AS (SELECT split, avg(ok) AS exact FROM (SELECT split, d, entity, min(CAST(y = predicted AS INTEGER)) AS ok FROM ml GROUP BY ALL) GROUP BY split)
 SELECT split, evaluated, '' AS excluded, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1, round(map, 9) AS macro_average_precision,
 round(tp / (tp + fp), 9) AS micro_precision, round(tp / (tp + fn), 9) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 9) AS micro_f1,
 round(mi.ap, 9) AS micro_average_precision, round((fp + fn) / (tp + fp + fn + tn), 9) AS hamming_loss, round(exact, 9) AS exact_match
 FROM m JOIN mi USING (split) JOIN ex USING (split)""",
)
def multilabel(spark, sf):
    out = metrics.multilabel(family_scores(spark, sf), ["split"], ["d", "entity"], "family", ["X", "Y"])
    return rounded(out, [c for c in out.columns if c not in ("split", "evaluated", "excluded")])


@query(
    "daily_topk",
    SCORED_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS rk FROM scored)
 SELECT d, count(*) AS candidates, CAST(sum(y) AS BIGINT) AS positives, count(*) FILTER (rk <= 10) AS inspected, CAST(sum(y) FILTER (rk <= 10) AS BIGINT) AS hits,
 round(sum(y) FILTER (rk <= 10) / count(*) FILTER (rk <= 10), 9) AS precision_at_k, round(sum(y) FILTER (rk <= 10) / nullif(sum(y), 0), 9) AS recall_at_k,
 round(count(*) FILTER (rk <= 10) * sum(y) / count(*), 9) AS random_expected_hits, round(sum(y) / count(*), 9) AS random_expected_precision FROM r GROUP BY d""",
)
def daily_topk(spark, sf):
    out = ranking.daily_top_k(scored(spark, sf), "d", ["entity"], 10)
    return rounded(out, ["precision_at_k", "recall_at_k", "random_expected_hits", "random_expected_precision"])


# --- variants A (rate), B (recent score), C (blend) ---

ABC_SQL = SCORED_SQL + """, abc AS (SELECT d, entity, split, y, 'A' AS experiment, round(rate, 6) AS score FROM scored
   UNION ALL SELECT d, entity, split, y, 'B', round(score - rate * 0.7, 6) FROM scored UNION ALL SELECT d, entity, split, y, 'C', score FROM scored),
 r AS (SELECT *, row_number() OVER (PARTITION BY experiment, d ORDER BY score DESC, entity) AS rk FROM abc),
 day AS (SELECT experiment, d, sum(y) FILTER (rk <= 10) / count(*) FILTER (rk <= 10) AS p FROM r GROUP BY experiment, d)"""


def variants(spark, sf):
    rows = scored(spark, sf)
    cells = F.array(
        F.struct(F.lit("A").alias("experiment"), F.round("rate", 6).alias("score")),
        F.struct(F.lit("B").alias("experiment"), F.round(F.col("score") - F.col("rate") * F.lit(0.7), 6).alias("score")),
        F.struct(F.lit("C").alias("experiment"), F.col("score")),
    )
    return rows.select("d", "entity", "etype", "split", "y", F.inline(cells))


@query(
    "abc_delta",
    ABC_SQL + """ SELECT d, round(max(p) FILTER (experiment = 'A'), 9) AS "A", round(max(p) FILTER (experiment = 'B'), 9) AS "B",
 round(max(p) FILTER (experiment = 'C'), 9) AS "C", round(max(p) FILTER (experiment = 'C') - max(p) FILTER (experiment = 'A'), 9) AS "C_minus_A" FROM day GROUP BY d""",
)
def abc_delta(spark, sf):
    daily = ranking.daily_top_k(variants(spark, sf), "d", ["entity"], 10, by=["experiment"])
    return rounded(selection.variant_delta(daily, ["d"], "experiment", "precision_at_k"), ["A", "B", "C", "C_minus_A"])


@query(
    "abc_counts",
    ABC_SQL + """, dl AS (SELECT d, max(p) FILTER (experiment = 'C') - max(p) FILTER (experiment = 'A') AS x FROM day GROUP BY d)
 SELECT count(*) FILTER (x > 0) AS better, count(*) FILTER (x = 0) AS tied, count(*) FILTER (x < 0) AS worse, count(x) AS evaluated FROM dl""",
)
def abc_counts(spark, sf):
    daily = ranking.daily_top_k(variants(spark, sf), "d", ["entity"], 10, by=["experiment"])
    return selection.delta_counts(selection.variant_delta(daily, ["d"], "experiment", "precision_at_k"), "C_minus_A")


@query(
    "monthly_ranking",
    ABC_SQL + """, m AS (SELECT *, strftime(d, '%Y-%m') AS month FROM r), q AS (SELECT experiment, month, d, count(*) AS candidates, sum(y) AS positives,
   count(*) FILTER (rk <= 10) AS inspected, sum(y) FILTER (rk <= 10) AS hits FROM m GROUP BY ALL)
 SELECT experiment, month, count(*) AS days, CAST(sum(inspected) AS BIGINT) AS inspections, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits) / sum(inspected), 9) AS precision_at_k,
 round(avg(hits / inspected), 9) AS mean_daily_precision, round(avg(hits), 9) AS mean_hits_per_day, round(sum(inspected * positives / candidates) / sum(inspected), 9) AS random_expected_precision
 FROM q GROUP BY experiment, month""",
)
def monthly_ranking(spark, sf):
    daily = ranking.daily_top_k(variants(spark, sf), "d", ["entity"], 10, by=["experiment"])
    monthly = daily.withColumn("month", F.date_format("d", "yyyy-MM"))
    out = ranking.top_k_summary(monthly, ["experiment", "month"])
    return rounded(out, ["precision_at_k", "mean_daily_precision", "mean_hits_per_day", "random_expected_precision"])


@query(
    "model_comparison_rows",
    ABC_SQL + curve_sql("abc", "experiment, split") + """, q AS (SELECT experiment, split, sum(pos * (tp / alerts)) / max(ptot) AS ap FROM st GROUP BY ALL),
 f AS (SELECT experiment, split, 2 * count(*) FILTER (score >= 0.3 AND y = 1) / (count(*) FILTER (score >= 0.3) + count(*) FILTER (y = 1)) AS f1 FROM abc GROUP BY ALL)
 , near AS (SELECT q.*, f1, max(ap) OVER (PARTITION BY split) AS best FROM q JOIN f USING (experiment, split))
 SELECT split, experiment AS model, round(ap, 9) AS average_precision, round(f1, 9) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY f1 DESC, experiment) AS r
   FROM near WHERE ap >= best - 0.01 - 1e-12) WHERE r = 1""",
)
def model_comparison_rows(spark, sf):
    rows = variants(spark, sf).withColumnRenamed("experiment", "model")
    quality = metrics.ranking_quality(rows, ["split", "model"]).select("split", "model", "average_precision")
    rates = metrics.at_cutoff(rows, ["split", "model"], 0.3).select("split", "model", "f1", "recall", "precision")
    best = selection.select_by_ap(quality.join(rates, ["split", "model"]), ["split"], "model", ["A", "B", "C"])
    return rounded(best.select("split", "model", "average_precision", "f1"), ["average_precision", "f1"])


@query(
    "class_model_selection",
    REG_SQL + _PER_CLASS + """, s AS (SELECT split, avg(f1) AS macro_f1, max(CASE WHEN class = 'high_risk' THEN recall END) AS tr, max(CASE WHEN class = 'high_risk' THEN precision END) AS tpn FROM pr GROUP BY split)
 SELECT split, round(macro_f1, 9) AS macro_f1, round(tr, 9) AS top_recall, round(tpn, 9) AS top_precision FROM (SELECT *, row_number() OVER (ORDER BY tr DESC, tpn DESC, macro_f1 DESC, split) AS r FROM s WHERE macro_f1 >= (SELECT max(macro_f1) FROM s) - 0.05 - 1e-12) WHERE r = 1""",
)
def class_model_selection(spark, sf):
    """Candidates here are the periods: pick the one a tolerance rule prefers."""
    table = metrics.multiclass_summary(regression_rows(spark, sf), ["split"], "actual_level", "predicted_level").withColumn("all", F.lit(1))
    best = selection.select_by_macro_f1(table, ["all"], "split", ["test", "train", "valid"], 0.05)
    return rounded(best.select("split", "macro_f1", "top_recall", "top_precision"), ["macro_f1", "top_recall", "top_precision"])


@query(
    "metric_ab_join",
    ABC_SQL + curve_sql("abc", "experiment, split") + """, q AS (SELECT experiment, split, sum(pos * (tp / alerts)) / max(ptot) AS ap FROM st GROUP BY ALL)
 SELECT split, round(max(ap) FILTER (experiment = 'A'), 9) AS "average_precision_A", round(max(ap) FILTER (experiment = 'C'), 9) AS "average_precision_C",
 round(max(ap) FILTER (experiment = 'C') - max(ap) FILTER (experiment = 'A'), 9) AS average_precision_delta FROM q GROUP BY split""",
)
def metric_ab_join(spark, sf):
    quality = metrics.ranking_quality(variants(spark, sf), ["split", "experiment"])
    out = compare_columns(quality, ["split"], "experiment", ("A", "C"), ["average_precision"])
    return rounded(out, ["average_precision_A", "average_precision_C", "average_precision_delta"])


@query(
    "operational_verdict",
    SCORED_SQL + curve_sql("scored", "split, etype") + f""", q AS (SELECT split, etype, CASE WHEN max(ptot) > 0 AND max(ptot) < max(tot) THEN sum(pos * (tp / alerts)) / max(ptot) / (max(ptot) / max(tot)) END AS lift FROM st GROUP BY ALL),
 c AS ({confusion_sql('scored', 'split, etype', '0.3')}), v AS (SELECT split, etype, lift, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM q JOIN c USING (split, etype))
 SELECT split, etype, round(lift, 9) AS lift, CASE WHEN lift < 1.2 THEN 'unusable' WHEN p >= 0.8 AND r >= 0.8 THEN 'operational_review' WHEN p >= 0.5 THEN 'inspection_aid' ELSE 'exploratory' END AS verdict FROM v""",
)
def operational_verdict(spark, sf):
    rows = scored(spark, sf)
    key = ["split", "etype"]
    q = metrics.ranking_quality(rows, key).select(*key, F.col("ap_lift").alias("lift"))
    c = metrics.at_cutoff(rows, key, 0.3).select(*key, "precision", "recall")
    out = q.join(c, key).select(*key, "lift", X.operational_verdict("lift", "precision", "recall").alias("verdict"))
    return rounded(out, ["lift"])


@query(
    "sequence_gate",
    FAM_SQL + """, a AS (SELECT family, avg(y) AS r FROM ml WHERE split = 'train' GROUP BY family),
 fs AS (SELECT d, entity, family, split, y, 'A' AS fset, round(r, 6) AS score FROM ml JOIN a USING (family) UNION ALL SELECT d, entity, family, split, y, 'B', score FROM ml
   UNION ALL SELECT d, entity, family, split, y, 'C', round(0.5 * score + 0.5 * r, 6) FROM ml JOIN a USING (family))""" + curve_sql("fs", "split, family, fset") + """,
 q AS (SELECT split, family, fset, sum(pos * (tp / alerts)) / max(ptot) AS ap FROM st GROUP BY ALL),
 m AS (SELECT avg(ap) FILTER (split = 'valid' AND fset = 'A') AS va, avg(ap) FILTER (split = 'valid' AND fset = 'B') AS vb, avg(ap) FILTER (split = 'valid' AND fset = 'C') AS vc,
   avg(ap) FILTER (split = 'test' AND fset = 'A') AS ta, avg(ap) FILTER (split = 'test' AND fset = 'B') AS tb, avg(ap) FILTER (split = 'test' AND fset = 'C') AS tc FROM q),
 w AS (SELECT count(*) FILTER (b > a) AS wb, count(*) FILTER (c > a) AS wc FROM (SELECT family, max(ap) FILTER (fset = 'A') AS a, max(ap) FILTER (fset = 'B') AS b, max(ap) FILTER (fset = 'C') AS c FROM q WHERE split = 'valid' GROUP BY family)),
 z AS (SELECT CASE WHEN vc > vb THEN 'C' ELSE 'B' END AS chosen, CASE WHEN vc > vb THEN vc ELSE vb END - va AS vd, CASE WHEN vc > vb THEN tc ELSE tb END - ta AS td, CASE WHEN vc > vb THEN wc ELSE wb END AS wins FROM m, w),
 gn AS (SELECT family, fset, greatest(max(ap) FILTER (split = 'valid') - 0.5, -1) AS gain FROM q GROUP BY ALL),
 im AS (SELECT max(gain) FILTER (fset = 'B') AS ib, max(gain) FILTER (fset = 'C') AS ic FROM (SELECT fset, family, greatest(gain, 0) AS gain FROM gn)),
 y AS (SELECT z.*, CASE WHEN chosen = 'C' THEN ic ELSE ib END AS ti FROM z, im),
 x AS (SELECT *, concat_ws('; ', CASE WHEN vd < 0.02 - 1e-12 THEN 'validation gain below 0.02' END, CASE WHEN wins < 5 THEN 'too few families improved' END, CASE WHEN td < -1e-12 THEN 'worse on test' END,
   CASE WHEN ti <= 0 THEN 'history features carry no importance' END) AS reasons FROM y)
 SELECT chosen, round(vd, 9) AS valid_delta, round(td, 9) AS test_delta, wins AS improved_families, round(ti, 9) AS temporal_importance, reasons, reasons = '' AS eligible FROM x""",
)
def sequence_gate(spark, sf):
    rows = family_scores(spark, sf)
    static = baselines.group_rate_table(rows.filter("split = 'train'"), ["family"], "y").select("family", "rate")
    cells = F.array(
        F.struct(F.lit("A").alias("feature_set"), F.round("rate", 6).alias("score")),
        F.struct(F.lit("B").alias("feature_set"), F.col("score")),
        F.struct(F.lit("C").alias("feature_set"), F.round(F.lit(0.5) * F.col("score") + F.lit(0.5) * F.col("rate"), 6).alias("score")),
    )
    sets = rows.join(static, "family").select("family", "split", "y", F.inline(cells))
    quality = metrics.ranking_quality(sets, ["family", "feature_set", "split"]).withColumn("target", F.lit("affected"))
    # What the history column adds to a set's AP over a coin's, on validation; the static rate is no history feature.
    gains = quality.filter("split = 'valid'").select("family", "feature_set", F.explode(F.array(
        F.struct(F.lit("past").alias("feature"), (F.col("average_precision") - 0.5).alias("importance")), F.struct(F.lit("rate").alias("feature"), F.lit(1.0).alias("importance"))
    )).alias("x")).select("family", "feature_set", "x.*")
    importance = selection.positive_importance(gains, ["past"], ["family", "feature_set"])
    return rounded(selection.sequence_gate(quality.join(importance, ["family", "feature_set"])), ["valid_delta", "test_delta", "temporal_importance"])
