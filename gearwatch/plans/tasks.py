"""Ready-made learning tasks on a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearwatch.functions.expressions import calendar_columns
from gearwatch.operators import history, labels, rollups, splits
from gearwatch.operators.joins import checked_join
from gearwatch.panel import PANEL, PanelSpec
from gearwatch.plans.learning import Task

# The six part-future experiments as (days ahead, label kind, on families).
EXPERIMENTS = {
    "next_day": (1, "binary", False),
    "within_3d": (3, "binary", False),
    "within_7d": (7, "binary", False),
    "count_7d": (7, "count", False),
    "first_day_class": (7, "first", False),
    "family_within_3d": (3, "binary", True),
}


def part_experiment(panel: DataFrame, name: str, spec: PanelSpec = PANEL) -> Task:
    """One of the six future experiments: strict history, label on the full series, exclusions, split."""
    days, kind, on_family = EXPERIMENTS[name]
    s = spec
    if on_family:
        rows, unit, flag = rollups.family_daily(panel, s), s.family, "family_flag"
    else:
        rows, unit, flag = panel, s.member, s.flag
    by = [s.entity, unit]
    past = history.strict_flag_history(rows, by, s.date, flag)
    past = labels.future_label(past, by, s.date, flag, days, kind)
    frame = splits.forecast_eligibility(splits.date_share_split(past, s.date), flag).filter("eligible_for_model")
    frame = frame.withColumns(calendar_columns(s.date))
    numeric = [*s.measures, f"{flag}_days_prev_7d", f"{flag}_days_prev_30d", f"days_since_last_{flag}", "day_of_week", "month_sin", "month_cos"]
    return Task(frame, tuple(numeric), "target", (s.etype, unit), meta={"days": days, "kind": kind, "name": name})


def part_current(panel: DataFrame, valid_start: str, test_start: str, spec: PanelSpec = PANEL) -> Task:
    """Same-day part flag from measures and their history.

    Measure windows run once per entity-day and are joined onto the parts.
    """
    s = spec
    day = panel.groupBy(*s.entity_day).agg(*[F.max(m).alias(m) for m in s.measures])
    hist = history.measure_history(day, [s.entity], s.date, s.measures).drop(*s.measures)
    rows = history.flag_history(panel, [s.entity, s.member], s.date, s.flag)
    rows = rows.join(hist, s.entity_day, "left").withColumns(calendar_columns(s.date))
    rows = rows.withColumn("split", splits.period_column(s.date, valid_start, test_start))
    extra = [f"{m}_{x}" for m in s.measures for x in ("lag1", "mean7", "std7", "diff1")]
    numeric = (*s.measures, *extra, f"{s.flag}_lag1", f"{s.flag}_count_7d", f"{s.flag}_count_30d", f"days_since_last_{s.flag}", "day_of_week", "month_sin", "month_cos")
    return Task(rows, numeric, s.flag, (s.etype, s.family, s.grade))


def asset_task(
    panel: DataFrame, kind: str, threshold: int, valid_start: str, test_start: str, days: int = 7, mode: str = "new", spec: PanelSpec = PANEL
) -> Task:
    """Entity-day task: ``current`` risk, ``score``, ``severity`` level code or ``forecast`` of risk."""
    s = spec
    daily = rollups.with_severity(rollups.entity_daily(panel, s), threshold)
    rows = history.measure_history(daily, [s.entity], s.date, s.measures)
    rows = history.risk_history(rows, [s.entity], s.date, "points", threshold).withColumns(calendar_columns(s.date))
    extra = [f"{m}_{x}" for m in s.measures for x in ("lag1", "mean7", "std7", "diff1")]
    numeric = (*s.measures, *extra, "points_lag1", "points_mean7", "points_max7", "risk_count_30d", "days_since_last_risk", "day_of_week", "month_sin", "month_cos")
    if kind == "forecast":
        rows = labels.entity_forecast_label(rows, [s.entity], s.date, "points", threshold, days, mode)
        rows = rows.withColumn("split", splits.purged_split(s.date, "label_end", valid_start, test_start))
        return Task(rows.filter(F.col("target").isNotNull() & F.col("split").isNotNull()), numeric, "target", (s.etype,))
    rows = rows.withColumn("split", splits.period_column(s.date, valid_start, test_start))
    if kind == "current":
        return Task(rows.withColumn("target", (F.col("points") >= threshold).cast("int")), numeric, "target", (s.etype,))
    if kind == "score":
        return Task(rows, numeric, "points", (s.etype,))
    if kind == "severity":
        return Task(rows, numeric, "severity_code", (s.etype,))
    raise ValueError(f"unknown task: {kind}")


def label_task(panel: DataFrame, family: str, label: str, expanded: bool = True, spec: PanelSpec = PANEL, cost_limits=labels.COST_LIMITS) -> Task:
    """Same-day label criterion from row-window features (or the measures alone)."""
    s = spec
    daily = history.observed_row_history(rollups.entity_daily(panel, s), [s.entity], s.date, s.measures)
    rows, names = labels.label_family(daily, family, [s.entity], s.date, cost_limits)
    if label not in names:
        raise ValueError(f"{label} is not one of {names}")
    rows = splits.date_share_split(rows.filter(F.col(label).isNotNull()), s.date).withColumn("y_label", F.col(label))
    more = [f"{m}_{x}" for m in s.measures for x in ("diff1", "mean7", "std7", "vs_mean7", "anomaly7", "vs_mean30")]
    return Task(rows, (*s.measures, *(more if expanded else ())), "y_label", (s.etype, s.site))


def family_task(panel: DataFrame, target: str, feature_set: str, valid_start: str, test_start: str, spec: PanelSpec = PANEL) -> Task:
    """Family label with nested feature sets: A static, B with history, C with robust measure history."""
    if target not in ("affected", "severe"):
        raise ValueError("target must be affected or severe")
    s = spec
    rows = rollups.family_daily(panel, s).withColumns(calendar_columns(s.date))
    numeric = [*s.measures, "day_of_week", "month_sin", "month_cos"]
    if feature_set in ("B", "C"):
        rows = history.family_history(rows, [s.entity, s.family], s.date)
        numeric += ["affected_lag1", "affected_count_7d", "affected_count_30d", "days_since_last_affected"]
    if feature_set == "C":
        day = rows.groupBy(*s.entity_day).agg(*[F.max(m).alias(m) for m in s.measures])
        robust = history.robust_history(day, [s.entity], s.date, s.measures).drop(*s.measures)
        rows = rows.join(robust, s.entity_day, "left")
        numeric += [f"{m}_{x}" for m in s.measures for x in ("lag1", "median7", "mad7", "slope7")]
    rows = rows.withColumn("split", splits.period_column(s.date, valid_start, test_start)).withColumn("y_label", F.col(target))
    return Task(rows, tuple(numeric), "y_label", (s.etype, s.family))


def full_breakdown_task(panel: DataFrame, spec: PanelSpec = PANEL) -> Task:
    """Does any family fail completely today?"""
    s = spec
    daily = history.observed_row_history(rollups.entity_daily(panel, s), [s.entity], s.date, s.measures)
    label = rollups.full_family_label(rollups.family_daily(panel, s), s)
    rows = splits.date_share_split(checked_join(daily, label, s.entity_day, "left", "one_to_one"), s.date)
    more = [f"{m}_{x}" for m in s.measures for x in ("diff1", "mean7", "std7", "vs_mean7", "anomaly7", "vs_mean30")]
    return Task(rows, (*s.measures, *more), "full_breakdown", (s.etype, s.site))
