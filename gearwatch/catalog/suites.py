"""Feature sets and experiment suites. With models that SQL can express, whole suites are compared; fitted ones are not."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.anomaly import Z_SQL, M
from gearwatch.catalog.base import E_SQL, R_SQL, period_sql, query, rounded
from gearwatch.catalog.history import lag_sql, over, _range
from gearwatch.catalog.labels import _SAME_DAY, _SPLIT, _SPLIT_END, _SPLIT_NAME, WINDOW, _rules, ahead, binary_sql, same_day_labels
from gearwatch.catalog.metrics import curve_sql
from gearwatch.functions.expressions import calendar_columns
from gearwatch.operators import metrics, rollups, screens, splits
from gearwatch.operators.joins import scope_rows
from gearwatch.operators.labels import CONSEC_RULES, START_RULES
from gearwatch.plans import features as FS
from gearwatch.plans import learning as L
from gearwatch.plans import suites as S
from gearwatch.plans import tasks as K
from gearwatch.sources.warehouse import EVENT_SPLIT, PART_SPLIT, events_panel, region_panel, supplier_panel

V, T = EVENT_SPLIT


# --- feature sets


def _past_sql(m: str) -> list[str]:
    w = _range(-7, -1).format(by="entity")
    return [
        *[f"{lag_sql(m, k)} AS {m}_lag{k}" for k in (1, 3, 7)],
        f"{m} - {lag_sql(m, 1)} AS {m}_diff1", f"{m} - {lag_sql(m, 7)} AS {m}_diff7",
        f"{over('median', m, -3, -1, 2)} AS {m}_median3", f"{over('median', m, -7, -1, 3)} AS {m}_median7", f"{over('mad', m, -7, -1, 3)} AS {m}_mad7",
        f"CASE WHEN count({m}) OVER {w} >= 7 THEN regr_slope({m}, date_diff('day', DATE '2024-01-01', d)) OVER {w} END AS {m}_slope7",
    ]


_CALENDAR = ("isodow(d) - 1 AS day_of_week", "sin(2 * pi() * month(d) / 12.0) AS month_sin", "cos(2 * pi() * month(d) / 12.0) AS month_cos")
_MAGS = [f"abs(z{i})" for i in range(1, 5)]
_SUMMARY = (
    f"greatest({', '.join(_MAGS)}) AS max_abs_z", f"({' + '.join(_MAGS)}) / 4 AS mean_abs_z",
    " + ".join(f"CAST({m} >= 2 AS INTEGER)" for m in _MAGS) + " AS count_abs_z_ge_2", " + ".join(f"CAST({m} >= 3 AS INTEGER)" for m in _MAGS) + " AS count_abs_z_ge_3",
    "CAST(abs(z1) >= 2 AND abs(z2) >= 2 AS INTEGER) AS temp_vibration_joint",
)
_BLOCK_SQL = {
    "base": [*[f"{m} AS {m}" for m in M], *_CALENDAR],
    "robust_z": [f"z{i} AS m{i}_robust_z" for i in range(1, 5)],
    "history": [c for m in M for c in _past_sql(m)],
    "anomaly_summary": list(_SUMMARY),
}


def _sets_sql() -> str:
    name = lambda c: c.rsplit(" AS ", 1)[1]
    inner = ", ".join(f"({c.rsplit(' AS ', 1)[0]}) AS f_{name(c)}" for cols in _BLOCK_SQL.values() for c in cols)
    parts = []
    for s, blocks in FS.ASSET_SETS.items():
        for place, c in enumerate(c for b in blocks for c in _BLOCK_SQL[b]):
            parts.append(f"SELECT '{s}' AS feature_set, {place} AS place, '{name(c)}' AS \"column\", count(f_{name(c)}) AS known, round(avg(CAST(f_{name(c)} AS DOUBLE)), 6) AS mean FROM x")
    return Z_SQL + f", x AS (SELECT {inner} FROM z) " + " UNION ALL ".join(parts)


@query("asset_feature_sets", _sets_sql())
def asset_feature_sets(spark, sf):
    """Columns of the four nested sets in order, with the number of known values and the mean of each."""
    sets = FS.asset_features(supplier_panel(spark, sf), *PART_SPLIT)
    names = sorted({c for s in sets.columns.values() for c in s})
    # A row becomes one short row per dozen columns, not one per column.
    dozens = [names[i : i + 12] for i in range(0, len(names), 12)]
    blank = F.lit(None).cast("double")
    packed = [F.struct(F.lit(k).alias("_k"), *[(F.col(own[j]).cast("double") if j < len(own) else blank).alias(f"_v{j}") for j in range(12)]) for k, own in enumerate(dozens)]
    figures = sets.frame.select(F.inline(F.array(*packed))).groupBy("_k").agg(*[F.struct(F.count(f"_v{j}").alias("known"), F.avg(f"_v{j}").alias("mean")).alias(f"_f{j}") for j in range(12)])
    titles = F.array(*[F.array(*[F.lit(own[j] if j < len(own) else None) for j in range(12)]) for own in dozens])
    cells = F.array(*[F.struct(titles[F.col("_k")][j].alias("column"), F.col(f"_f{j}.known").alias("known"), F.col(f"_f{j}.mean").alias("mean")) for j in range(12)])
    seen = figures.select(F.inline(cells)).filter(F.col("column").isNotNull())
    return rounded(sets.listing().select("feature_set", "place", "column").join(seen, "column"), ["mean"], 6)


# --- plans


def _family_rows(spark, sf):
    rows = rollups.family_daily(events_panel(spark, sf)).withColumns(calendar_columns("d"))
    return rows.withColumn("split", splits.period_column("d", V, T))


FAMILY_SCOPES = {"family": "family", "site": "site"}
FAMILY_TARGETS = ("affected", "severe", "family_flag", "all_failed")

_PLAN_ROWS = E_SQL + f""", fr AS (SELECT *, {period_sql(V, T)} AS split FROM fam)"""


def plan_sql(rows: str, targets, scopes: dict[str, str | None], least: int, reuse: bool = True) -> str:
    """CTE ``plan`` from a table ``rows`` with a split column."""
    cells = " UNION ALL ".join(
        f"SELECT '{t}' AS target, {i} AS i, '{k}' AS scope_kind, {'CAST(' + c + ' AS VARCHAR)' if c else chr(39) + 'all' + chr(39)} AS scope_name, split, CAST({t} AS INTEGER) AS y, "
        + ", ".join(f"CAST({u} AS INTEGER) AS y{j}" for j, u in enumerate(targets)) + f" FROM {rows}"
        for i, t in enumerate(targets) for k, c in scopes.items()
    )
    counts = ", ".join(f"count(y) FILTER (split = '{p}') AS {p}_rows, count(*) FILTER (split = '{p}' AND y = 1) AS {p}_positives, count(DISTINCT CASE WHEN split = '{p}' THEN y END) AS {p}_classes" for p in S.PARTS)
    issues = []
    for p in S.PARTS:
        issue = f"CASE WHEN {p}_rows = 0 THEN 'empty {p} split'"
        if not least or p != "test":
            issue += f" WHEN {p}_classes < 2 THEN 'single {p} class'"
        if least and p != "test":
            issue += f" WHEN {p}_positives < {least} THEN '{p} positives ' || {p}_positives || ' below {least}'"
        issues.append(issue + " END")
    same = "CASE " + " ".join(f"WHEN i > {j} AND same{j} THEN '{t}'" for j, t in enumerate(targets)) + " END" if reuse else "CAST(NULL AS VARCHAR)"
    return f""", pc AS ({cells}),
 pa AS (SELECT target, i, scope_kind, scope_name, {counts}, {', '.join(f'bool_and(y IS NOT DISTINCT FROM y{j}) AS same{j}' for j in range(len(targets)))} FROM pc WHERE scope_name IS NOT NULL GROUP BY ALL HAVING count(y) > 0),
 pb AS (SELECT *, concat_ws('; ', {', '.join(issues)}) AS skip, {same} AS first FROM pa),
 plan AS (SELECT target, scope_kind, scope_name, CASE WHEN skip <> '' THEN 'skipped' WHEN first IS NOT NULL THEN 'identical_target' ELSE 'ok' END AS status,
   CASE WHEN skip <> '' THEN skip WHEN first IS NOT NULL THEN 'same labels as ' || first ELSE '' END AS reason, CASE WHEN skip = '' THEN first END AS same_as,
   {', '.join(f'{p}_rows, {p}_positives' for p in S.PARTS)} FROM pb)"""


@query("family_plan", _PLAN_ROWS + plan_sql("fr", FAMILY_TARGETS, FAMILY_SCOPES, S.MIN_POSITIVES) + " SELECT * FROM plan")
def family_plan(spark, sf):
    """Which family targets are fitted, which repeat another one's labels and which have too few positives."""
    return S.plan(_family_rows(spark, sf), FAMILY_TARGETS, ["d", "entity", "family"], FAMILY_SCOPES, S.MIN_POSITIVES)


def _risk_rows(spark, sf, *thresholds):
    daily = rollups.entity_daily(events_panel(spark, sf)).withColumns(calendar_columns("d"))
    return daily.withColumns({"split": splits.period_column("d", V, T), **{f"risk_{t}": (F.col("points") >= t).cast("int") for t in thresholds}})


_RISK_ROWS = E_SQL + f""", rr AS (SELECT *, isodow(d) - 1 AS day_of_week, CAST(points >= 7 AS INTEGER) AS risk_7, CAST(points >= 8 AS INTEGER) AS risk_8, {period_sql(V, T)} AS split FROM daily)"""
RISKS = ("risk_7", "risk_8")


@query("risk_plan", _RISK_ROWS + plan_sql("rr", RISKS, S.SCOPES, 0) + " SELECT * FROM plan")
def risk_plan(spark, sf):
    """Scopes of two risk levels: all, every type and every asset, with the reasons of those that are skipped."""
    return S.plan(_risk_rows(spark, sf, 7, 8), RISKS, ["d", "entity"])


# --- whole suites


def suite_sql(rows: str, targets, scopes, ids: str, rates: dict[str, str], least: int) -> str:
    """CTEs ``pred`` (scored valid and test rows), ``cuts``, ``mrows`` (metric rows) and ``best`` for a plan."""
    cells = " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{k}' AS scope_kind, {'CAST(' + c + ' AS VARCHAR)' if c else chr(39) + 'all' + chr(39)} AS scope_name, split, CAST({t} AS INTEGER) AS y, {ids}, entity AS k_entity, day_of_week AS k_dow FROM {rows}"
        for t in targets for k, c in scopes.items()
    )
    by = "target, scope_kind, scope_name"
    key = by + ", model"
    scored = [f"SELECT {by}, 'prior' AS model, split, {ids}, k_entity, y, round(whole, 6) AS score FROM sr JOIN sw USING ({by}) WHERE split <> 'train'"]
    for name, column in rates.items():
        scored.append(
            f"SELECT {by}, '{name}' AS model, split, {ids}, k_entity, y, round(coalesce(rate, whole), 6) AS score FROM sr JOIN sw USING ({by}) "
            f"LEFT JOIN (SELECT {by}, {column}, avg(y) AS rate FROM sr WHERE split = 'train' GROUP BY {by}, {column}) g USING ({by}, {column}) WHERE split <> 'train'"
        )
    policy = lambda name, where, order: (
        f"SELECT k.*, '{name}' AS policy, b.cutoff, CASE WHEN b.cutoff IS NULL THEN 'unavailable' ELSE 'ok' END AS cut_status FROM (SELECT DISTINCT {key} FROM st) k LEFT JOIN "
        f"(SELECT * FROM (SELECT {key}, cutoff, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM cand WHERE {where}) WHERE r = 1) b USING ({key})"
    )
    top = "alerts - n < greatest(1, ceil(tot * 0.1)) AND greatest(1, ceil(tot * 0.1)) <= alerts"
    full = curve_sql("pv", key).replace(", st AS", "st AS", 1)
    both = curve_sql("pred", key + ", split").replace(", st AS", "sq AS", 1)
    order = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(rates))
    return f""", sa AS ({cells}), sr AS (SELECT sa.* FROM sa JOIN plan USING ({by}) WHERE status = 'ok' AND y IS NOT NULL),
 sw AS (SELECT {by}, avg(y) AS whole FROM sr WHERE split = 'train' GROUP BY {by}),
 pred AS ({' UNION ALL '.join(scored)}), pv AS (SELECT * FROM pred WHERE split = 'valid'), {full},
 cand AS (SELECT {key}, least(greatest(score, 0), 1) AS cutoff, alerts, n, tot, ptot, tp / alerts AS precision, CASE WHEN ptot = 0 THEN 0 ELSE tp / ptot END AS recall, 2 * tp / (alerts + ptot) AS f1 FROM st),
 cuts AS ({policy('f1', 'true', 'f1 DESC, cutoff DESC')} UNION ALL {policy('min_precision_30', 'precision >= 0.3', 'recall DESC, cutoff DESC')} UNION ALL {policy('top_10pct', top, 'cutoff DESC')}),
 ap AS (SELECT pred.*, policy, cutoff, cut_status, CASE WHEN cutoff IS NOT NULL THEN CAST(score >= cutoff AS INTEGER) END AS predicted FROM pred JOIN cuts USING ({key})),
 cf AS (SELECT {key}, split, policy, any_value(cutoff) AS cutoff, any_value(cut_status) AS cut_status, count(*) FILTER (predicted = 1 AND y = 1) AS tp, count(*) FILTER (predicted = 1 AND y = 0) AS fp,
   count(*) FILTER (predicted = 0 AND y = 1) AS fn, count(*) FILTER (predicted = 0 AND y = 0) AS tn FROM ap GROUP BY {key}, split, policy),
 {both},
 ql AS (SELECT {key}, split, CASE WHEN max(ptot) > 0 AND max(ptot) < max(tot) THEN sum(pos * (tp / alerts)) / max(ptot) END AS average_precision,
   CASE WHEN max(ptot) > 0 AND max(ptot) < max(tot) THEN sum((n - pos) * (tp - pos / 2)) / (CAST(max(ptot) AS DOUBLE) * (max(tot) - max(ptot))) END AS roc_auc FROM sq GROUP BY {key}, split),
 fr1 AS (SELECT {key}, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
   CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision FROM cf WHERE split = 'valid' AND policy = 'f1'),
 near AS (SELECT ql.*, fr1.f1, fr1.recall, fr1.precision, max(average_precision) OVER (PARTITION BY {by}) AS top FROM ql JOIN fr1 USING ({key}) WHERE split = 'valid' AND model <> 'prior' AND average_precision IS NOT NULL),
 win AS (SELECT {key} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY f1 DESC, recall DESC, precision DESC, CASE model {order} END) AS r FROM near WHERE average_precision >= top - 1e-12) WHERE r = 1),
 done AS (SELECT {key}, split, CASE WHEN win.target IS NOT NULL THEN true ELSE false END AS selected_model, cut_status AS status, '' AS reason, policy, cutoff,
   tp, fp, fn, tn, average_precision, roc_auc FROM cf JOIN ql USING ({key}, split) LEFT JOIN win USING ({key})),
 twice AS (SELECT plan.target, d.scope_kind, d.scope_name, model, split, selected_model, 'identical_target' AS status, plan.reason, policy, cutoff, tp, fp, fn, tn, average_precision, roc_auc
   FROM done d JOIN plan ON plan.same_as = d.target AND plan.scope_kind = d.scope_kind AND plan.scope_name = d.scope_name AND plan.status = 'identical_target'),
 skipped AS (SELECT {by}, 'none' AS model, 'test' AS split, false AS selected_model, status, reason, NULL AS policy, NULL AS cutoff, NULL AS tp, NULL AS fp, NULL AS fn, NULL AS tn, NULL AS average_precision, NULL AS roc_auc
   FROM plan WHERE status = 'skipped'),
 mrows AS (SELECT m.*, {', '.join(f'{p}_rows, {p}_positives / nullif({p}_rows, 0) AS {p}_positive_rate' for p in S.PARTS)} FROM (SELECT {key}, split, selected_model, status, reason, policy, cutoff, tp, fp, fn, tn, average_precision, roc_auc FROM done
   UNION ALL SELECT target, scope_kind, scope_name, model, split, selected_model, status, reason, policy, cutoff, tp, fp, fn, tn, average_precision, roc_auc FROM twice UNION ALL SELECT * FROM skipped) m JOIN plan USING ({by})),
 best AS (SELECT ap.* FROM ap JOIN win USING ({key}) WHERE split = 'test')"""


SUITE_COLUMNS = [
    "target", "scope_kind", "scope_name", "model", "split", "selected_model", "status", "reason", "policy", "cutoff", *[f"{p}_rows" for p in S.PARTS],
    *[f"{p}_positive_rate" for p in S.PARTS], "accuracy", "precision", "recall", "f1", "average_precision", "roc_auc", "tp", "fp", "fn", "tn",
]
_SUITE_OUT = f""" SELECT target, scope_kind, scope_name, model, split, selected_model, status, reason, policy, CAST(cutoff AS DOUBLE) AS cutoff, {', '.join(f'{p}_rows, round({p}_positive_rate, 9) AS {p}_positive_rate' for p in S.PARTS)},
 round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy, round(CASE WHEN tp + fp + fn + tn > 0 THEN CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END END, 9) AS precision,
 round(CASE WHEN tp + fp + fn + tn > 0 THEN CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END END, 9) AS recall,
 round(CASE WHEN tp + fp + fn + tn > 0 THEN CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END END, 9) AS f1,
 round(average_precision, 9) AS average_precision, round(roc_auc, 9) AS roc_auc, tp, fp, fn, tn FROM mrows"""
_SUITE_ROUND = [*[f"{p}_positive_rate" for p in S.PARTS], "accuracy", "precision", "recall", "f1", "average_precision", "roc_auc"]

RATE_MODELS = {"prior": S.Model("prior"), "rate_entity": S.Model("rate", keys=("entity",)), "rate_weekday": S.Model("rate", keys=("day_of_week",))}
_RATES = {"rate_entity": "k_entity", "rate_weekday": "k_dow"}


def family_suite_of(spark, sf) -> S.Results:
    suite = S.Suite({}, (), RATE_MODELS, ("d", "entity", "family"), ("day_of_week",), FAMILY_SCOPES, S.MIN_POSITIVES)
    return S.run(_family_rows(spark, sf), FAMILY_TARGETS, suite)


_FAMILY_SUITE = (
    E_SQL + f""", fr AS (SELECT *, isodow(d) - 1 AS day_of_week, {period_sql(V, T)} AS split FROM fam)""" + plan_sql("fr", FAMILY_TARGETS, FAMILY_SCOPES, S.MIN_POSITIVES)
    + suite_sql("fr", FAMILY_TARGETS, FAMILY_SCOPES, "d, entity, family", _RATES, S.MIN_POSITIVES)
)


@query("family_suite", _FAMILY_SUITE + _SUITE_OUT)
def family_suite(spark, sf):
    """Family targets by family and site: models by validation AP, cutoffs by policy, reused and skipped targets."""
    return rounded(family_suite_of(spark, sf).metrics.select(*SUITE_COLUMNS), _SUITE_ROUND)


def risk_suite_of(spark, sf) -> S.Results:
    suite = S.Suite({}, (), RATE_MODELS, ("d", "entity"), ("day_of_week",))
    return S.run(_risk_rows(spark, sf, 7, 8), RISKS, suite)


_RISK_SUITE = _RISK_ROWS + plan_sql("rr", RISKS, S.SCOPES, 0) + suite_sql("rr", RISKS, S.SCOPES, "d, entity", _RATES, 0)


@query("risk_suite", _RISK_SUITE + _SUITE_OUT)
def risk_suite(spark, sf):
    """Two risk levels over all scopes: overall, every type, every asset."""
    return rounded(risk_suite_of(spark, sf).metrics.select(*SUITE_COLUMNS), _SUITE_ROUND)


@query(
    "suite_predictions",
    _RISK_SUITE + " SELECT target, scope_kind, scope_name, model, policy, CAST(cutoff AS DOUBLE) AS cutoff, d, entity, y, score, predicted FROM best",
)
def suite_predictions(spark, sf):
    """Test predictions of the selected model of each scope at each policy's cutoff."""
    found = risk_suite_of(spark, sf).predictions
    return found.select("target", "scope_kind", "scope_name", "model", "policy", "cutoff", "d", "entity", "y", "score", "predicted")


_TYPE_SCOPES = {"overall": None, "machine_type": "etype"}
_ONE = (
    _RISK_ROWS.replace("FROM daily)", "FROM daily WHERE etype <> 4 OR points < 7 OR d < DATE '" + T + "')")
    + plan_sql("rr", ("risk_7",), _TYPE_SCOPES, 0) + suite_sql("rr", ("risk_7",), _TYPE_SCOPES, "d, entity", {"rate_entity": "k_entity"}, 0)
)


def _type_predictions(spark, sf):
    """Test scores of the entity rates of every type and of all; one type's test part has a single class, so it has no model of its own."""
    rows = _risk_rows(spark, sf, 7).filter((F.col("etype") != 4) | (F.col("points") < 7) | (F.col("d") < F.lit(T).cast("date")))
    suite = S.Suite({}, (), {"rate_entity": S.Model("rate", keys=("entity",))}, ("d", "entity"), ("day_of_week",), _TYPE_SCOPES)
    planned = S.plan(rows, ["risk_7"], ["d", "entity"], _TYPE_SCOPES)
    return S.fit_all(rows, planned, suite)[0].filter("split = 'test' AND model = 'rate_entity'")


_PREFERRED = """, tp_ AS (SELECT * FROM pred WHERE split = 'test' AND model = 'rate_entity'),
 w_ AS (SELECT entity, min(CASE scope_kind WHEN 'machine_type' THEN 1 ELSE 2 END) AS pr FROM tp_ GROUP BY entity),
 pf AS (SELECT tp_.* FROM tp_ JOIN w_ USING (entity) WHERE CASE scope_kind WHEN 'machine_type' THEN 1 ELSE 2 END = pr)"""


@query(
    "asset_reaggregation",
    _ONE + _PREFERRED + curve_sql("pf", "entity, scope_kind, scope_name").replace(", st AS", ", s3 AS", 1) + """,
 q3 AS (SELECT entity, scope_kind, scope_name, max(tot) AS rows, max(ptot) AS positives, sum(pos * (tp / alerts)) AS ap FROM s3 GROUP BY ALL),
 c3 AS (SELECT entity, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn FROM pf GROUP BY entity)
 SELECT entity, scope_kind AS source_kind, scope_name AS source_name, rows, positives, CASE WHEN positives > 0 AND positives < rows THEN round(ap / positives, 9) END AS average_precision, tp, fp, fn, tn FROM q3 JOIN c3 USING (entity)""",
)
def asset_reaggregation(spark, sf):
    """Metrics by asset from its type's model, or the overall one where its type has none, with where they come from."""
    out = S.asset_reaggregation(_type_predictions(spark, sf))
    return rounded(out.select("entity", "source_kind", "source_name", "rows", "positives", "average_precision", "tp", "fp", "fn", "tn"), ["average_precision"])


@query(
    "merged_predictions",
    _ONE + _PREFERRED + """ SELECT d, entity, y, score, scope_kind AS source_kind, scope_name AS source_name FROM (SELECT *, row_number() OVER (PARTITION BY d, entity ORDER BY CASE scope_kind WHEN 'machine_type' THEN 1 ELSE 2 END) AS r FROM tp_) WHERE r = 1""",
)
def merged_predictions(spark, sf):
    """One prediction per row: of the row's type where its model exists, else of the overall model."""
    return S.type_and_overall(_type_predictions(spark, sf), ["d", "entity"]).select("d", "entity", "y", "score", "source_kind", "source_name")


@query(
    "type_reference",
    _ONE + """, te AS (SELECT p.*, daily.etype FROM (SELECT * FROM pred WHERE model = 'rate_entity') p JOIN daily ON daily.d = p.d AND daily.entity = p.entity WHERE split = 'test')"""
    + curve_sql("te", "scope_kind, etype").replace(", st AS", ", s4 AS", 1)
    + """, q4 AS (SELECT scope_kind, etype, max(tot) AS rows, max(ptot) AS positives, CASE WHEN max(ptot) > 0 AND max(ptot) < max(tot) THEN sum(pos * (tp / alerts)) / max(ptot) END AS ap FROM s4 GROUP BY ALL)
 SELECT etype, max(rows) FILTER (scope_kind = 'overall') AS test_rows, max(positives) FILTER (scope_kind = 'overall') AS test_positives, round(max(positives / rows) FILTER (scope_kind = 'overall'), 9) AS positive_rate,
 round(max(ap) FILTER (scope_kind = 'machine_type'), 9) AS ap_by_type, round(max(ap) FILTER (scope_kind = 'overall'), 9) AS ap_overall FROM q4 GROUP BY etype""",
)
def type_reference(spark, sf):
    """Per type: AP of the type's own model against the overall model on the same rows."""
    return rounded(S.type_against_overall(_type_predictions(spark, sf)), ["positive_rate", "ap_by_type", "ap_overall"])


# --- all same-day label criteria, and the frames of the future experiments


def _label_frame(spark, sf):
    out, names = same_day_labels(rollups.entity_daily(region_panel(spark, sf)))
    return splits.date_share_split(out, "d").withColumns(calendar_columns("d")), names



def label_sql(names) -> str:
    return (
        R_SQL + _SPLIT.format(t="daily") + f""", sd AS (SELECT daily.*, {', '.join(_SAME_DAY)}, {_rules(START_RULES)}, {_rules(CONSEC_RULES)} FROM daily {WINDOW}),
 lr AS (SELECT *, isodow(d) - 1 AS day_of_week, {_SPLIT_NAME} AS split FROM sd, lim)""" + plan_sql("lr", names, _TYPE_SCOPES, 0)
    )


ALL_LABELS = [c.rsplit(" AS ", 1)[1].strip('"') for c in _SAME_DAY] + [*START_RULES, *CONSEC_RULES]


@query("label_plan", label_sql(ALL_LABELS) + " SELECT * FROM plan")
def label_plan(spark, sf):
    """All same-day label criteria by type: which can be fitted, which repeat another one, which lack a class."""
    frame, names = _label_frame(spark, sf)
    return S.plan(frame, ALL_LABELS, ["d", "entity"], _TYPE_SCOPES)


@query("label_suite", label_sql(ALL_LABELS) + suite_sql("lr", ALL_LABELS, _TYPE_SCOPES, "d, entity", _RATES, 0) + _SUITE_OUT)
def label_suite(spark, sf):
    """Every label criterion by type: models by validation AP and cutoffs by policy."""
    frame, _ = _label_frame(spark, sf)
    suite = S.Suite({}, (), RATE_MODELS, ("d", "entity"), ("day_of_week",), _TYPE_SCOPES)
    return rounded(S.run(frame, ALL_LABELS, suite).metrics.select(*SUITE_COLUMNS), _SUITE_ROUND)


def _future_sql() -> str:
    parts = []
    for name, (days, kind, on_family) in K.EXPERIMENTS.items():
        source, by, flag = ("fam", "entity, family", "family_flag") if on_family else ("panel", "entity, member", "flag")
        ahead_ = ahead(by, days)
        target = {
            "binary": binary_sql(flag, by, days),
            "count": f"CASE WHEN count({flag}) OVER {ahead_} = {days} THEN CAST(sum({flag}) OVER {ahead_} AS INTEGER) END",
            "first": f"CASE WHEN count({flag}) OVER {ahead_} = {days} THEN coalesce(date_diff('day', d, min(CASE WHEN {flag} = 1 THEN d END) OVER {ahead_}), 0) END",
        }[kind]
        value = "CASE WHEN target = 0 THEN 0 WHEN target = 1 THEN 3 WHEN target <= 3 THEN 2 ELSE 1 END" if kind == "first" else "target"
        parts.append(
            f"SELECT '{name}' AS experiment, split, count(*) AS rows, CAST(sum({value}) AS BIGINT) AS target_sum, count(DISTINCT entity) AS entities, min(d) AS first_day, max(d) AS last_day FROM ("
            f"SELECT d, entity, {target} AS target, {flag} AS f, count({flag}) OVER {ahead_} = {days} AS fc, CAST(d + INTERVAL {days} DAY AS DATE) AS le, count({flag}) OVER {_range(-30, -1).format(by=by)} >= 30 AS pc, "
            f"{_SPLIT_NAME} AS split, {_SPLIT_END} AS se FROM {source}, lim) WHERE f = 0 AND pc AND fc AND le <= se GROUP BY split"
        )
    return R_SQL + _SPLIT.format(t="panel") + " " + " UNION ALL ".join(parts)


@query("future_frames", _future_sql())
def future_frames(spark, sf):
    """Rows, targets and dates of the prepared frames of all six future experiments."""
    panel = S.materialize(region_panel(spark, sf))
    out = None
    for name in K.EXPERIMENTS:
        task = K.part_experiment(panel, name)
        one = task.frame.groupBy("split").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("target").cast("bigint").alias("target_sum"), F.countDistinct("entity").alias("entities"), F.min("d").alias("first_day"), F.max("d").alias("last_day")
        ).withColumn("experiment", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# --- fitted suites (no SQL)

_SMALL_TREES = {"maxDepth": 10}


@query("learn_suite")
def learn_suite(spark, sf):
    """Current risk over all types: every model, selection by validation AP, cutoffs by policy, skipped scopes."""
    sets = FS.asset_features(region_panel(spark, sf), *PART_SPLIT)
    frame = sets.frame.withColumn("risk_12", (F.col("points") >= 12).cast("int"))
    models = {"prior": S.Model("prior"), "lr": S.Model("lr", True), "rf": S.Model("rf", options=_SMALL_TREES), "gbt": S.Model("gbt", options={"maxIter": 20})}
    suite = S.Suite({"C": sets.columns["C"]}, ("etype",), models, ("d", "entity"), (), _TYPE_SCOPES)
    return S.run(frame, ["risk_12"], suite).metrics


@query("learn_suite_importance")
def learn_suite_importance(spark, sf):
    """Permutation importance of the selected model of each scope."""
    sets = FS.asset_features(region_panel(spark, sf), *PART_SPLIT, requested=["A"])
    frame = S.materialize(sets.frame.withColumn("risk_12", (F.col("points") >= 12).cast("int")))
    suite = S.Suite(sets.columns, ("etype",), {"lr": S.Model("lr", True)}, ("d", "entity"), (), _TYPE_SCOPES)
    planned = S.materialize(S.plan(frame, ["risk_12"], ["d", "entity"], _TYPE_SCOPES))
    _, fitted = S.fit_all(frame, planned, suite)
    rows = [(*k, True) for k in fitted]
    chosen = spark.createDataFrame(rows, "target string, scope_kind string, scope_name string, feature_set string, model string, selected_feature_set boolean")
    return S.importance_table(fitted, chosen, planned, suite)


@query("learn_family_suite")
def learn_family_suite(spark, sf):
    """Both family targets and one that repeats a target, nested sets A to C, by family; at least ten positives."""
    sets = FS.family_features(events_panel(spark, sf), V, T, ["m1"], ["m2", "m3"], min_rows=5)
    models = {"prior": S.Model("prior"), "lr": S.Model("lr", True, turned=True)}
    suite = S.Suite(sets.columns, ("etype",), models, ("d", "entity", "family"), (), {"family": "family"}, S.MIN_POSITIVES)
    return S.run(sets.frame, ("affected", "severe", "family_flag"), suite, (0.7, 0.8), tolerance=0.01).metrics


@query("learn_type_reference")
def learn_type_reference(spark, sf):
    """Forests of every type against the forest of all."""
    sets = FS.asset_features(region_panel(spark, sf), *PART_SPLIT, requested=["C"])
    frame = sets.frame.withColumn("risk_12", (F.col("points") >= 12).cast("int"))
    suite = S.Suite(sets.columns, ("site",), {"rf": S.Model("rf", options=_SMALL_TREES)}, ("d", "entity"), (), _TYPE_SCOPES)
    planned = S.materialize(S.plan(frame, ["risk_12"], ["d", "entity"], _TYPE_SCOPES))
    return S.type_against_overall(S.fit_all(S.materialize(frame), planned, suite)[0].filter("split = 'test'"))


# --- screens and reports from stored tables


_FAMILY_BEST = _FAMILY_SUITE + """, fb AS (SELECT * FROM best WHERE target = 'affected' AND policy = 'f1' AND scope_kind = 'family')"""


def _best_asset_sql() -> str:
    return "(SELECT min(entity) FROM (SELECT entity FROM fb GROUP BY entity HAVING count(DISTINCT scope_name) = 2))"


def _asset(predictions) -> int:
    """The first asset with rows of every family."""
    rows = predictions.filter("target = 'affected' AND policy = 'f1' AND scope_kind = 'family'")
    return rows.groupBy("entity").agg(F.countDistinct("scope_name").alias("n")).filter("n = 2").agg(F.min("entity")).first()[0]


@query(
    "family_screen",
    _FAMILY_BEST + f""", fa AS (SELECT * FROM fb WHERE entity = {_best_asset_sql()})""" + curve_sql("fa", "scope_name, model").replace(", st AS", ", s5 AS", 1) + """,
 q5 AS (SELECT scope_name, model, CASE WHEN max(ptot) > 0 AND max(ptot) < max(tot) THEN sum(pos * (tp / alerts)) / max(ptot) END AS ap FROM s5 GROUP BY ALL),
 c5 AS (SELECT scope_name, model, any_value(cutoff) AS cutoff, count(*) AS rows, count(*) FILTER (y = 1) AS support, count(*) FILTER (score >= cutoff AND y = 1) AS tp, count(*) FILTER (score >= cutoff AND y = 0) AS fp,
   count(*) FILTER (score < cutoff AND y = 1) AS fn, count(*) FILTER (score < cutoff AND y = 0) AS tn FROM fa GROUP BY ALL)
 SELECT scope_name AS family, model, CAST(cutoff AS DOUBLE) AS cutoff, rows, support, tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1, round(ap, 9) AS average_precision FROM c5 JOIN q5 USING (scope_name, model)""",
)
def family_screen(spark, sf):
    """One asset's families with the figures of their models at the stored cutoffs."""
    best = family_suite_of(spark, sf).predictions
    out = screens.family_rows(best, _asset(best), ["X", "Y"])
    return rounded(out.select("family", "model", "cutoff", "rows", "support", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "average_precision"), ["precision", "recall", "f1", "average_precision"])


@query(
    "family_detail",
    _FAMILY_BEST + f""", fa AS (SELECT * FROM fb WHERE scope_name = 'X' AND entity = {_best_asset_sql()})""" + curve_sql("fa", "scope_name").replace(", st AS", ", s5 AS", 1) + """,
 p5 AS (SELECT row_number() OVER (ORDER BY score) - 1 AS position, count(*) OVER () + 1 AS points, score, tp / alerts AS precision, CASE WHEN ptot = 0 THEN 0 ELSE tp / ptot END AS recall FROM s5),
 k5 AS (SELECT * FROM p5 UNION ALL SELECT max(position) + 1, max(points), NULL, 1.0, 0.0 FROM p5),
 c5 AS (SELECT any_value(cutoff) AS cutoff, count(*) FILTER (score >= cutoff AND y = 1) AS tp, count(*) FILTER (score >= cutoff AND y = 0) AS fp, count(*) FILTER (score < cutoff AND y = 1) AS fn, count(*) FILTER (score < cutoff AND y = 0) AS tn FROM fa)
 SELECT 'X' AS family, points, position, CAST(score AS DOUBLE) AS score, round(precision, 9) AS precision, round(recall, 9) AS recall, tn, fp, fn, tp, CAST(cutoff AS DOUBLE) AS cutoff FROM k5, c5""",
)
def family_detail(spark, sf):
    """PR curve of one asset and family with the confusion at the stored cutoff."""
    best = family_suite_of(spark, sf).predictions
    return rounded(screens.family_detail(best, _asset(best), "X"), ["precision", "recall"])


_CROSS = [c for c in screens.COMPARISON_COLUMNS if c not in ("experiment", "feature_set")]


@query(
    "experiment_table",
    "SELECT * FROM (" + _RISK_SUITE + f" SELECT 'risk' AS experiment, {', '.join(_CROSS)} FROM ({_SUITE_OUT}) WHERE selected_model AND split = 'test') UNION ALL SELECT * FROM ("
    + _FAMILY_SUITE + f" SELECT 'family' AS experiment, {', '.join(_CROSS)} FROM ({_SUITE_OUT}) WHERE selected_model AND split = 'test')",
)
def experiment_table(spark, sf):
    """Test rows of the selected models of two experiments under each other."""
    out = screens.cross_table({"risk": risk_suite_of(spark, sf).metrics, "family": family_suite_of(spark, sf).metrics})
    return rounded(out.select("experiment", *_CROSS), [c for c in _SUITE_ROUND if c in _CROSS])


@query(
    "model_rows",
    _RISK_SUITE + f""" SELECT model, CASE model WHEN 'prior' THEN 1 WHEN 'rate_entity' THEN 2 ELSE 3 END AS place, selected_model AS focus, cutoff, precision, recall, f1, average_precision
 FROM ({_SUITE_OUT}) WHERE target = 'risk_7' AND scope_kind = 'overall' AND policy = 'f1' AND split = 'test'""",
)
def model_rows(spark, sf):
    """All models of one task in order, the selected one marked."""
    out = screens.model_rows(risk_suite_of(spark, sf).metrics, "risk_7", "overall", "all", list(RATE_MODELS))
    return rounded(out.select("model", F.col("place").cast("int").alias("place"), "focus", "cutoff", "precision", "recall", "f1", "average_precision"), ["precision", "recall", "f1", "average_precision"])


@query("learn_label_suite")
def learn_label_suite(spark, sf):
    """Every label criterion: measures alone against measures with history, each plain and balanced, and the constant."""
    panel = S.materialize(region_panel(spark, sf))
    base = K.label_task(panel, "CO", "failed_parts_ge_3").frame
    labels, _ = same_day_labels(rollups.entity_daily(panel))
    frame = base.drop(*[c for c in ALL_LABELS if c in base.columns]).join(labels.select("d", "entity", *ALL_LABELS), ["d", "entity"])
    measures = ("m1", "m2", "m3", "m4")
    more = [f"{m}_{x}" for m in measures for x in ("diff1", "mean7", "std7", "vs_mean7", "anomaly7", "vs_mean30")]
    models = {"prior": S.Model("prior"), "lr": S.Model("lr", options={"maxIter": 100}), "lr_balanced": S.Model("lr", True, {"maxIter": 100})}
    suite = S.Suite({"measures": measures, "expanded": (*measures, *more)}, ("etype", "site"), models, ("d", "entity"), (), {"overall": None})
    return S.run(frame, ALL_LABELS, suite).metrics


@query("learn_future_suite")
def learn_future_suite(spark, sf):
    """The binary future experiments of parts and families over all rows and by type: constant, rates of the unit, logistic regression."""
    panel = S.materialize(region_panel(spark, sf))
    out = None
    for name, (_, kind, on_family) in K.EXPERIMENTS.items():
        if kind != "binary":
            continue
        task = K.part_experiment(panel, name)
        unit = "family" if on_family else "member"
        models = {"prior": S.Model("prior"), "rate_unit": S.Model("rate", keys=("entity", unit)), "lr": S.Model("lr", options={"maxIter": 100})}
        suite = S.Suite({"A": task.numeric}, task.categorical, models, ("d", "entity", unit), (), _TYPE_SCOPES)
        one = S.run(task.frame, ["target"], suite).metrics.withColumn("target", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("learn_count_scopes")
def learn_count_scopes(spark, sf):
    """Failure days of the next week by a constant, ridge and boosted trees; errors over all rows, by type and by asset."""
    task = L.written(K.part_experiment(region_panel(spark, sf), "count_7d"))
    rows, test, keep = task.part("train").count(), task.part("test"), ["entity", "etype"]
    mean = task.part("train").agg(F.avg(F.col("target").cast("double"))).scalar()
    out = test.select(*keep, F.col("target").alias("y"), mean.alias("score")).filter(F.lit(rows > 0)).withColumn("model", F.lit("mean"))
    for name, options in (("ridge", {}), ("gbt", {"maxIter": 20})):
        scored = L.predict(L.fit_if_rows(task, L.regressor(name, rows, **options)), test, task, keep).withColumn("model", F.lit(name))
        out = out.unionByName(scored)
    return metrics.regression_errors(scope_rows(out, S.SCOPES), ["model", "scope_kind", "scope_name"], "y", "score", True)


@query("learn_class_scopes")
def learn_class_scopes(spark, sf):
    """Class of the first failure day: figures over all rows, by type and by asset."""
    task = L.written(K.part_experiment(region_panel(spark, sf), "first_day_class"))
    model = L.fit_if_rows(task, L.classifier("lr", task.part("train").count(), True, maxIter=100), weighted=True)
    classes = ("0", "1", "2", "3")
    out = L.ordered_probabilities(model, task.part("test"), task, ["entity", "etype"], classes).withColumn("actual", F.col("y").cast("string"))
    return metrics.multiclass_summary(scope_rows(out, S.SCOPES), ["scope_kind", "scope_name"], "actual", "predicted_level", classes, "3")
