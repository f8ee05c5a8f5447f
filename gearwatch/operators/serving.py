"""Dashboard queries on the entity-day table: filters, KPIs, trends, heatmaps, details."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearwatch.functions.expressions import day_number, ratio
from gearwatch.operators.joins import zero_filled_grid
from gearwatch.operators.ordered import row_numbers
from gearwatch.panel import PANEL, PanelSpec
from gearwatch.session import materialize


def _when(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def scoped(df: DataFrame, entities: Sequence | None = None, start: str | None = None, end: str | None = None, spec: PanelSpec = PANEL) -> DataFrame:
    """Entity list and inclusive dates; None leaves that side open. Filters reach the scan."""
    out = df
    if entities is not None:
        out = out.filter(F.col(spec.entity).isin(list(entities)))
    if start is not None:
        out = out.filter(F.col(spec.date) >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col(spec.date) <= F.lit(end).cast("date"))
    return out


def matching_entities(catalog: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Entities of the catalog that meet every given attribute."""
    out = catalog
    for column, value in filters.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def last_days(df: DataFrame, days: int, date: str = "d") -> DataFrame:
    """Rows of the last ``days`` days, the latest day counted."""
    return df.filter(F.col(date) >= F.date_sub(df.agg(F.max(date)).scalar(), days - 1))


def facet_options(catalog: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Choices left for each attribute under the other filters."""
    out = None
    for facet in filters:
        others = {k: v for k, v in filters.items() if k != facet}
        part = matching_entities(catalog, others).select(
            F.lit(facet).alias("facet"), F.col(facet).cast("string").alias("option")
        ).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def period_kpis(
    daily: DataFrame, entities: Sequence | None = None, start: str | None = None, end: str | None = None,
    power: str = "m1", heat: str = "m2", spec: PanelSpec = PANEL,
) -> DataFrame:
    """The ten KPI values of a period in one row.

    One pass finds the latest day, a second one fills all conditional aggregates.
    """
    s = spec
    rows = scoped(daily, entities, spec=s)
    in_period = F.lit(True)
    if start is not None:
        in_period = in_period & (F.col(s.date) >= F.lit(start).cast("date"))
    if end is not None:
        in_period = in_period & (F.col(s.date) <= F.lit(end).cast("date"))
    latest = rows.agg(F.coalesce(F.max(F.when(in_period, F.col(s.date))), F.max(s.date))).scalar()
    high = F.col("severity") == "high_risk"
    at_end = F.col(s.date) == F.col("_latest")
    if start is None:
        before = F.lit(False)
    else:
        first = F.lit(start).cast("date")
        span = F.datediff("_latest", first)
        before = (F.col(s.date) >= F.date_sub(first, span + 1)) & (F.col(s.date) < first)
    out = rows.withColumn("_latest", latest).agg(
        F.countDistinct(s.entity).alias("observed_machines"),
        _when(in_period & (F.col("points") > 0)).alias("failure_machine_days"),
        _when(in_period & high).alias("high_risk_days"),
        _when(in_period).alias("_days"),
        _when(before & high).alias("_ph"),
        _when(before).alias("_pd"),
        _when(at_end & high).alias("latest_high_risk_machines"),
        F.avg(F.when(at_end, F.col(power))).alias("avg_power"),
        F.max(F.when(at_end, F.col(heat))).alias("max_heat"),
        F.sum(F.when(in_period, F.col("amount")).otherwise(0.0)).alias("parts_issue_value"),
    )
    return out.select(
        "observed_machines", "failure_machine_days", "high_risk_days",
        (ratio("high_risk_days", "_days", 0.0) * 100).alias("high_risk_rate_pct"),
        (ratio("_ph", "_pd") * 100).alias("prev_high_risk_rate_pct"),
        "latest_high_risk_machines",
        (ratio("latest_high_risk_machines", "observed_machines", 0.0) * 100).alias("failure_rate_pct"),
        "avg_power", "max_heat", "parts_issue_value",
    )


def organisation_kpis(kpis: DataFrame) -> DataFrame:
    return kpis.select("failure_machine_days", "failure_rate_pct", "parts_issue_value", "avg_power")


def failure_trend(daily: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Failing machines and high-risk share per day; the share divides by all machines."""
    machines = daily.agg(F.countDistinct(spec.entity)).scalar()
    out = daily.groupBy(spec.date).agg(
        _when(F.col("points") > 0).alias("failure_days"), _when(F.col("severity") == "high_risk").alias("_h")
    )
    return out.withColumn("_n", machines).select(spec.date, "failure_days", (ratio("_h", "_n", 0.0) * 100).alias("high_risk_pct"))


def priority_table(daily: DataFrame, spec: PanelSpec = PANEL, sort_by: str | None = None, descending: bool = True) -> DataFrame:
    """Inspection order: latest score first, then entity; ``rank`` keeps that order under any sort.

    Entities not seen on the latest day score 0.
    """
    s = spec
    latest = daily.agg(F.max(s.date)).scalar()
    at_end = F.col(s.date) == F.col("_latest")
    high = F.col("severity") == "high_risk"
    failed = F.col("points") > 0
    rows = daily.withColumn("_latest", latest).groupBy(s.entity).agg(
        F.min(s.etype).alias(s.etype),
        F.min(s.site).alias(s.site),
        F.coalesce(F.max(F.when(at_end, F.col("points"))), F.lit(0)).alias("points"),
        F.coalesce(F.max(F.when(at_end, high)), F.lit(False)).alias("threshold_exceeded"),
        F.max(F.when(failed, F.col(s.date))).alias("last_failure_date"),
        _when(high & (F.col(s.date) >= F.date_sub("_latest", 29))).alias("high_risk_days_30d"),
        F.coalesce(F.max_by("failed_parts", F.when(failed, F.col(s.date))), F.lit(0)).alias("failed_part_count"),
    )
    ranked = row_numbers(rows, [], [("points", False), (s.entity, True)]).drop("rank_of")
    if sort_by is None:
        return ranked.orderBy("rank")
    c = F.col(sort_by)
    return ranked.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "rank")


def machine_status(daily: DataFrame, last: int = 30, spec: PanelSpec = PANEL) -> DataFrame:
    """Latest level and score of each entity with its last scores as an array (at most ``last``)."""
    s = spec
    w = Window.partitionBy(s.entity).orderBy(F.col(s.date).desc())
    recent = daily.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    latest = daily.agg(F.max(s.date)).scalar()
    points = F.array_sort(F.collect_list(F.struct(s.date, "points")))
    return recent.withColumn("_latest", latest).groupBy(s.entity).agg(
        F.max(F.when(F.col(s.date) == F.col("_latest"), F.col("severity"))).alias("grade"),
        F.max(F.when(F.col(s.date) == F.col("_latest"), F.col("points"))).alias("risk_score"),
        F.transform(points, lambda x: x["points"]).alias("sparkline"),
    )


def mean_by_entity(daily: DataFrame, measure: str, spec: PanelSpec = PANEL) -> DataFrame:
    return daily.groupBy(spec.entity).agg(F.avg(measure).alias("mean")).orderBy(F.col("mean").desc(), spec.entity)


# Heatmap units and label formats.
UNITS = {"day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def bucket_label(date: str, unit: str) -> Column:
    return F.date_format(F.date_trunc(unit, F.col(date)), UNITS[unit])


def failure_heatmap(daily: DataFrame, unit: str = "month", spec: PanelSpec = PANEL) -> DataFrame:
    """Failed part-days per entity and bucket on the full grid."""
    rows = daily.select(spec.entity, bucket_label(spec.date, unit).alias("period"), "failed_parts")
    # The counts hold every entity and every bucket, so rows, columns and cells come from one table that is written once.
    counts = materialize(rows.groupBy(spec.entity, "period").agg(F.sum("failed_parts").alias("failed_part_count")))
    return zero_filled_grid(counts, counts, spec.entity, counts, "period", "failed_part_count")


def period_coverage(daily: DataFrame, unit: str = "month", spec: PanelSpec = PANEL) -> DataFrame:
    """Observed days and calendar days of each bucket."""
    first = F.to_date(F.date_trunc(unit, F.col(spec.date)))
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "year": "interval 1 year"}[unit]
    return daily.groupBy(bucket_label(spec.date, unit).alias("period"), first.alias("_first")).agg(
        F.countDistinct(spec.date).alias("observed_days")
    ).select("period", "observed_days", F.datediff(F.to_date(F.col("_first") + F.expr(step)), "_first").alias("calendar_days"))


def entity_details(daily: DataFrame, start: str | None = None, end: str | None = None, power: str = "m1", spec: PanelSpec = PANEL) -> DataFrame:
    """Detail strip of every entity: snapshot of the latest day, figures of the period."""
    s = spec
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(s.date) >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col(s.date) <= F.lit(end).cast("date"))
    at_end = F.col(s.date) == F.col("_latest")
    return daily.withColumn("_latest", daily.agg(F.max(s.date)).scalar()).groupBy(s.entity).agg(
        F.max(s.etype).alias(s.etype),
        F.max(s.site).alias(s.site),
        F.max(F.when(at_end, F.col("severity"))).alias("current_grade"),
        F.max(F.when(at_end, F.col("points"))).alias("risk_score"),
        F.max(F.when(F.col("points") > 0, F.col(s.date))).alias("last_failure_date"),
        _when(inside & (F.col("points") > 0)).alias("failure_days_count"),
        F.avg(F.when(inside, F.col(power))).alias("avg_power"),
    )


def entity_series(daily: DataFrame, measures: Sequence[str], spec: PanelSpec = PANEL) -> DataFrame:
    """Measures per day with failure and high-risk flags."""
    return daily.select(
        spec.entity, spec.date, *measures, (F.col("points") > 0).alias("is_failure_day"),
        (F.col("severity") == "high_risk").alias("is_high_risk_day"),
    )


def part_totals(panel: DataFrame, top: int = 10, spec: PanelSpec = PANEL) -> DataFrame:
    """Highest positive issue values per entity; the limit is applied per task first."""
    s = spec
    totals = panel.groupBy(s.entity, s.member).agg(F.sum(s.amount).alias("total")).filter(F.col("total") > 0)
    w = Window.partitionBy(s.entity).orderBy(F.col("total").desc(), s.member)
    return totals.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def onset_windows(daily: DataFrame, value: str, before: int = 7, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows from ``before`` observations ahead of each entity's last high-risk start up to it."""
    s = spec
    w = Window.partitionBy(s.entity).orderBy(day_number(s.date))
    high = F.col("severity") == "high_risk"
    rows = daily.withColumns({"_i": F.row_number().over(w), "_start": high & ~F.coalesce(F.lag(high).over(w), F.lit(False))})
    last = F.max(F.when(F.col("_start"), F.col("_i"))).over(Window.partitionBy(s.entity))
    rows = rows.withColumn("relative_day", F.col("_i") - last)
    return rows.filter(F.col("relative_day").between(-before, 0)).select(s.entity, s.date, "relative_day", value)


def true_runs(daily: DataFrame, condition: Column, spec: PanelSpec = PANEL) -> DataFrame:
    """Runs of consecutive rows that meet the condition."""
    s = spec
    w = Window.partitionBy(s.entity).orderBy(day_number(s.date))
    marked = daily.withColumns({"_hit": condition, "_i": F.row_number().over(w)})
    inner = Window.partitionBy(s.entity, "_hit").orderBy(day_number(s.date))
    runs = marked.withColumn("_run", F.col("_i") - F.row_number().over(inner)).filter("_hit")
    return runs.groupBy(s.entity, "_run").agg(
        F.min(s.date).alias("run_start"), F.max(s.date).alias("run_end"), F.count(F.lit(1)).alias("rows")
    ).drop("_run")


def fleet_overview(panel: DataFrame, power: str = "m1", spec: PanelSpec = PANEL) -> DataFrame:
    """Fault days, flags of the last day and mean power per entity."""
    s = spec
    days = panel.groupBy(s.entity, s.date).agg(F.sum(s.flag).alias("flags"), F.max(power).alias("power"))
    latest = panel.agg(F.max(s.date)).scalar()
    return days.withColumn("_latest", latest).groupBy(s.entity).agg(
        F.coalesce(F.max(F.when(F.col(s.date) == F.col("_latest"), F.col("flags"))), F.lit(0)).alias("latest_flags"),
        _when(F.col("flags") > 0).alias("fault_days"),
        F.avg("power").alias("mean_power"),
    ).orderBy(F.col("latest_flags").desc(), F.col("fault_days").desc(), s.entity)


def part_status(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Per entity and part: last flag, flag days, quantity, cost, issue days."""
    s = spec
    return panel.groupBy(s.entity, s.member).agg(
        F.max_by(s.flag, s.date).alias("last_flag"),
        _when(F.col(s.flag) == 1).alias("flag_days"),
        F.sum(s.qty).alias("qty"),
        F.sum(s.amount).alias("amount"),
        _when(F.col(s.qty) > 0).alias("issue_days"),
        F.max(F.when(F.col(s.qty) > 0, F.col(s.date))).alias("last_issue"),
    )


def issue_events(panel: DataFrame, n: int, spec: PanelSpec = PANEL) -> DataFrame:
    """Newest issues first."""
    s = spec
    return panel.filter(F.col(s.qty) > 0).select(s.date, s.entity, s.member, s.qty, s.amount).orderBy(
        F.col(s.date).desc(), s.entity, s.member
    ).limit(n)


def latest_context(daily: DataFrame, measure: str, last: int | None = None, spec: PanelSpec = PANEL) -> DataFrame:
    """Latest value of each entity against its earlier rows: moving mean, median, gap, share at or below."""
    s = spec
    w = Window.partitionBy(s.entity).orderBy(day_number(s.date))
    newest = Window.partitionBy(s.entity).orderBy(day_number(s.date).desc())
    rows = daily.select(s.entity, s.date, F.col(measure).alias("value")).withColumns(
        {"moving": F.avg("value").over(w.rowsBetween(-6, 0)), "_r": F.row_number().over(newest)}
    )
    head = rows.filter("_r = 1").select(s.entity, s.date, "value", "moving")
    prior = rows.filter("_r > 1") if last is None else rows.filter(F.col("_r").between(2, last + 1))
    # At most the calendar's days per entity.
    stats = prior.select(s.entity, F.col("value").alias("v")).join(head.select(s.entity, "value"), s.entity).groupBy(s.entity).agg(
        F.percentile("v", 0.5).alias("median"), (F.avg((F.col("v") <= F.col("value")).cast("double")) * 100).alias("percentile")
    )
    return head.join(stats, s.entity, "left").withColumn("delta", F.col("value") - F.col("median"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Equal-width bins, min(24, max(5, n / 4)) of them, empty ones included."""
    stats = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.struct("*")).scalar()
    rows = df.filter(F.col(value).isNotNull()).select(value).withColumn("_s", stats)
    bins = F.least(F.lit(24), F.greatest(F.lit(5), F.floor(F.col("_s.n") / 4))).cast("int")
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_s.lo"), width)), F.lit(0)), bins - 1).cast("int")
    counts = rows.select(at.alias("bin"), bins.alias("bins")).groupBy("bin", "bins").agg(F.count(F.lit(1)).alias("rows"))
    # At most 24 cells from here on.
    packed = counts.groupBy("bins").agg(F.map_from_entries(F.collect_list(F.struct("bin", "rows"))).alias("m"))
    return packed.select("m", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")).select(
        "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("rows")
    )


def share_of_max(df: DataFrame, value: str) -> DataFrame:
    top = df.agg(F.max(value)).scalar()
    return df.withColumn("_top", top).withColumn("share", ratio(value, "_top")).drop("_top")


def flags_on_dates(flags: DataFrame, dates: DataFrame, date: str = "d") -> DataFrame:
    """Daily flag counts on the dates of a trend, missing days as zero."""
    return dates.select(date).join(flags, date, "left").withColumn("flags", F.coalesce("flags", F.lit(0)))


def default_entity(priority: DataFrame, chosen=None, entity: str = "entity"):
    """The filtered entity, else the first of the priority table."""
    return chosen if chosen is not None else priority.filter("rank = 1").select(entity).first()[0]
