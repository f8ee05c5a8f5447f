"""Learning tasks and forecasts. Fits have no SQL twin; the naive forecasts and the task frames do."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import E_SQL, R_SQL, period_sql, query, rounded
from gearwatch.catalog.history import lag_sql
from gearwatch.catalog.labels import ahead, binary_sql
from gearwatch.functions.expressions import SEVERITY_LEVELS
from gearwatch.operators import history, metrics, rollups, splits, thresholds
from gearwatch.operators.joins import scope_rows
from gearwatch.plans import forecast as P
from gearwatch.plans import learning as L
from gearwatch.plans import tasks as K
from gearwatch.sources.warehouse import EVENT_SPLIT, PART_SPLIT, events_panel, region_panel


# Forests over all parts stop at this depth: grown out to 30 levels one fit took over four minutes on eight cores.
PART_TREES = {"maxDepth": 10}


def _region_daily(spark, sf):
    daily = rollups.entity_daily(region_panel(spark, sf)).select("d", "entity", "m2")
    return daily.withColumn("split", splits.period_column("d", *PART_SPLIT))


@query(
    "naive_backtest",
    R_SQL + f""", h AS (SELECT d, entity, {period_sql(*PART_SPLIT)} AS split, m2 AS actual, lag(m2) OVER w AS previous_day, lag(m2, 7) OVER w AS previous_week,
   row_number() OVER w - 1 AS n FROM daily WINDOW w AS (PARTITION BY entity ORDER BY d)),
 k AS (SELECT *, row_number() OVER w AS i, lead(d) OVER w IS NULL AS fin FROM h WHERE split <> 'train' AND n >= 60 WINDOW w AS (PARTITION BY entity, split ORDER BY d)),
 c AS (SELECT * FROM k WHERE (i - 1) % 7 = 0 OR fin),
 e AS (SELECT unnest([CAST(entity AS VARCHAR), 'ALL']) AS entity, split, model, CASE model WHEN 'previous_day' THEN previous_day ELSE previous_week END - actual AS e
   FROM c CROSS JOIN (VALUES ('previous_day'), ('previous_week')) m(model))
 SELECT entity, split, model, count(*) AS rows, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM e GROUP BY ALL""",
)
def naive_backtest(spark, sf):
    held = P.origins(_region_daily(spark, sf), "m2").filter("split <> 'train' AND train_rows >= 60").drop("_sums", "_x")
    points = P.checkpoint_days(held, ["entity", "split"], "d", 7)
    return rounded(P.backtest_metrics(points, ["previous_day", "previous_week"]), ["mae", "rmse"], 6)


@query("seasonal_backtest")
def seasonal_backtest(spark, sf):
    points = P.backtest(_region_daily(spark, sf), "m2", 7)
    return P.backtest_metrics(points, ["seasonal", "previous_day", "previous_week"])


@query("next_day_forecast")
def next_day_forecast(spark, sf):
    return P.next_day(_region_daily(spark, sf), "m2")


@query(
    "task_part_within_7d",
    R_SQL + """, e AS (__ELIG__), f AS (SELECT d, entity, member, """ + binary_sql("flag", "entity, member", 7) + """ AS target FROM panel)
 SELECT e.split, count(*) AS rows, CAST(sum(target) AS BIGINT) AS positives FROM e JOIN f ON f.d = e.d AND f.entity = e.entity AND f.member = e.member WHERE reason = 'used' GROUP BY e.split""",
)
def task_part_within_7d(spark, sf):
    task = K.part_experiment(region_panel(spark, sf), "within_7d")
    return task.frame.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").alias("positives"))


@query("learn_asset_current")
def learn_asset_current(spark, sf):
    """Same-day entity risk: constant, plain and balanced logistic regression, forest, boosted trees."""
    task = L.written(K.asset_task(region_panel(spark, sf), "current", 12, *PART_SPLIT))
    models = {"prior": ("prior", False), "lr": ("lr", False), "lr_balanced": ("lr", True), "rf": ("rf", False), "gbt": ("gbt", False)}
    return L.comparison(task, models, ["d", "entity", "etype", "split"], list(models))


@query("learn_asset_forecast")
def learn_asset_forecast(spark, sf):
    task = L.written(K.asset_task(events_panel(spark, sf), "forecast", 7, *EVENT_SPLIT, days=3, mode="any"))
    return L.comparison(task, {"prior": ("prior", False), "lr": ("lr", False)}, ["d", "entity", "split"], ["prior", "lr"])


@query("learn_part_within_7d")
def learn_part_within_7d(spark, sf):
    """Part forecast scored overall, per type and per entity."""
    task = L.written(K.part_experiment(region_panel(spark, sf), "within_7d"))
    scored = L.suite_predictions(task, {"prior": ("prior", False), "lr": ("lr", False), "rf": ("rf", False, PART_TREES)}, ["d", "entity", "etype", "member", "split"], ("test",))
    scopes = scope_rows(scored, {"overall": None, "machine_type": "etype", "asset_tag": "entity"})
    return metrics.ranking_quality(scopes, ["model", "scope_kind", "scope_name"])


@query("learn_part_current")
def learn_part_current(spark, sf):
    task = L.written(K.part_current(events_panel(spark, sf), *EVENT_SPLIT))
    return L.comparison(task, {"prior": ("prior", False), "gbt": ("gbt", False)}, ["d", "entity", "member", "split"], ["prior", "gbt"])


@query("learn_count_7d")
def learn_count_7d(spark, sf):
    task = L.written(K.part_experiment(region_panel(spark, sf), "count_7d"))
    rows = task.part("train").count()
    out = None
    for name in ("ridge", "rf"):
        scored = L.predict(L.fit_if_rows(task, L.regressor(name, rows, **(PART_TREES if name == "rf" else {}))), task.part("test"), task, ["entity"]).withColumn("model", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return metrics.regression_errors(out, ["model"], "y", "score", True)


@query("learn_first_day_class")
def learn_first_day_class(spark, sf):
    task = L.written(K.part_experiment(region_panel(spark, sf), "first_day_class"))
    model = L.fit_if_rows(task, L.classifier("lr", task.part("train").count(), True), weighted=True)
    out = L.ordered_probabilities(model, task.part("test"), task, ["entity"], ("0", "1", "2", "3"))
    return metrics.multiclass_summary(out.withColumn("actual", F.col("y").cast("string")).withColumn("k", F.lit("test")), ["k"], "actual", "predicted_level", ("0", "1", "2", "3"), "3")


@query("learn_severity")
def learn_severity(spark, sf):
    """Four ordered levels by forest and the score by ridge, judged on the same levels."""
    panel = region_panel(spark, sf)
    task = L.written(K.asset_task(panel, "severity", 12, *PART_SPLIT))
    model = L.fit(task, L.classifier("rf", 0))
    levels = F.array(*[F.lit(c) for c in SEVERITY_LEVELS])
    direct = L.ordered_probabilities(model, task.part("test"), task, ["entity"]).select(
        F.lit("forest").alias("model"), F.get(levels, F.col("y")).alias("actual_level"), "predicted_level"
    )
    score = L.written(K.asset_task(panel, "score", 12, *PART_SPLIT))
    ridge = L.predict(L.fit(score, L.regressor("ridge", score.part("train").count())), score.part("test"), score, ["entity"])
    by_score = metrics.with_score_levels(ridge, "y", "score").select(F.lit("ridge").alias("model"), "actual_level", "predicted_level")
    return metrics.multiclass_summary(direct.unionByName(by_score), ["model"], "actual_level", "predicted_level")


@query("learn_families")
def learn_families(spark, sf):
    """Family models on the history features, judged as one multi-label task."""
    task = L.written(K.family_task(events_panel(spark, sf), "affected", "B", *EVENT_SPLIT))
    scored = L.suite_predictions(task, {"lr": ("lr", False)}, ["d", "entity", "family", "split"])
    cuts = thresholds.family_cutoffs(scored.filter("split = 'valid'"), ["family"])
    test = thresholds.apply_cutoffs(scored.filter("split = 'test'"), cuts, ["family"])
    return metrics.multilabel(test, ["policy"], ["d", "entity"], "family", ["X", "Y"])


@query("learn_label_criteria")
def learn_label_criteria(spark, sf):
    """Measures alone against measures with history for one label criterion."""
    panel = region_panel(spark, sf)
    out = None
    for name, expanded in (("measures", False), ("expanded", True)):
        task = L.written(K.label_task(panel, "CO", "failed_parts_ge_3", expanded))
        scored = L.suite_predictions(task, {name: ("lr", True)}, ["d", "entity", "split"])
        out = scored if out is None else out.unionByName(scored)
    return L.suite_metrics(out)


@query("learn_full_breakdown")
def learn_full_breakdown(spark, sf):
    task = L.written(K.full_breakdown_task(region_panel(spark, sf)))
    scored = L.suite_predictions(task, {"lr": ("lr", False), "lr_balanced": ("lr", True)}, ["d", "entity", "etype", "split"], ("test",))
    scopes = scope_rows(scored, {"overall": None, "machine_type": "etype", "asset_tag": "entity"})
    return metrics.at_cutoff(scopes, ["model", "scope_kind", "scope_name"], 0.5)


@query("learn_importance")
def learn_importance(spark, sf):
    """Loss of average precision when a feature is shuffled."""
    task = L.written(K.asset_task(events_panel(spark, sf), "forecast", 7, *EVENT_SPLIT, days=3, mode="any"))
    model = L.fit(task, L.classifier("lr", task.part("train").count()))
    return L.permutation_importance(model, task, "valid", ["d", "entity"], task.numeric, 3)


@query("learn_latest_scores")
def learn_latest_scores(spark, sf):
    """Latest-day scores of a fitted linear model."""
    task = L.written(K.asset_task(events_panel(spark, sf), "current", 7, *EVENT_SPLIT))
    model = L.fit(task, L.classifier("lr", task.part("train").count()))
    latest = task.frame.filter(F.col("d") == task.frame.agg(F.max("d")).scalar())
    return L.predict(model, latest, task, ["d", "entity"])


PREPARED = tuple(x for m in ("m1", "m2", "m3", "m4") for x in (m, f"{m}_lag1", f"{m}_lag7"))


def _prepared_sql() -> str:
    columns = ", ".join(f"CAST({m if x == m else lag_sql(m, int(x[-1]))} AS DOUBLE) AS {x}" for m in ("m1", "m2", "m3", "m4") for x in (m, f"{m}_lag1", f"{m}_lag7"))
    cells = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM t" for c in PREPARED)
    return E_SQL + f""", t AS (SELECT * FROM (SELECT d, entity, etype, {period_sql(*EVENT_SPLIT)} AS split, {columns} FROM daily) WHERE split = 'train'), c AS ({cells}),
 md AS (SELECT col, coalesce(median(v), 0) AS fill FROM c GROUP BY col),
 s AS (SELECT c.col, any_value(fill) AS fill, avg(coalesce(v, fill)) AS mean, stddev_samp(coalesce(v, fill)) AS sd, avg(CAST(v IS NULL AS INTEGER)) AS gone, stddev_samp(CAST(v IS NULL AS INTEGER)) AS gone_sd FROM c JOIN md USING (col) GROUP BY c.col)
 SELECT col AS "column", CAST(fill AS DOUBLE) AS fill, round(mean, 6) AS mean, round(sd, 6) AS deviation, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS INTEGER) AS place FROM s
 UNION ALL SELECT col || '__missing', NULL, round(gone, 6), round(gone_sd, 6), NULL, NULL FROM s
 UNION ALL SELECT 'etype', NULL, NULL, NULL, level, CAST(row_number() OVER (ORDER BY level) - 1 AS INTEGER) FROM (SELECT DISTINCT CAST(etype AS VARCHAR) AS level FROM t)"""


@query("fitted_preprocessing", _prepared_sql())
def fitted_preprocessing(spark, sf):
    """Exact medians, means, deviations and categories that a pipeline learnt from the training rows."""
    daily = rollups.entity_daily(events_panel(spark, sf))
    rows = history.add_history(daily, ["entity"], "d", [history.lag(m, k) for m in ("m1", "m2", "m3", "m4") for k in (1, 7)])
    rows = rows.withColumns({"split": splits.period_column("d", *EVENT_SPLIT), "risk": (F.col("points") >= 7).cast("int")})
    task = L.written(L.Task(rows, PREPARED, "risk", ("etype",)))
    model = L.fit(task, L.classifier("lr", task.part("train").count(), maxIter=1))
    return rounded(L.preprocessing_table(model, task), ["mean", "deviation"], 6)


from gearwatch.catalog.base import SQL  # noqa: E402

SQL["task_part_within_7d"] = SQL["task_part_within_7d"].replace(
    "__ELIG__", "SELECT d, entity, member, split, reason FROM (" + SQL["part_eligibility"] + ")"
)
