"""Entity-day and family-day rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearwatch.functions.expressions import GRADE_WEIGHTS, grade_weight, severity_code, severity_level
from gearwatch.panel import PANEL, PanelSpec


def entity_daily(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """One row per entity-day: weighted score, graded counts, failed cost and measures.

    Measures depend on (entity, day) only, checked by ``quality.dependency_breaks``;
    ``max`` therefore equals any representative and is deterministic.
    """
    s = spec
    failed = F.col(s.flag) == 1
    by_grade = [
        F.count(F.when(failed & (F.upper(F.trim(s.grade)) == g), F.lit(1))).alias(f"failed_{g}") for g in GRADE_WEIGHTS
    ]
    extra = [F.sum(F.when(failed, F.col(s.cost)).otherwise(0.0)).alias("failed_cost")] if s.cost in panel.columns else []
    if s.amount in panel.columns:
        extra.append(F.sum(s.amount).alias("amount"))
    return panel.groupBy(s.date, s.entity, s.etype, s.site).agg(
        F.sum(F.col(s.flag) * grade_weight(s.grade)).cast("bigint").alias("points"),
        *by_grade,
        F.sum(F.col(s.flag)).cast("bigint").alias("failed_parts"),
        F.count(F.lit(1)).alias("total_parts"),
        *extra,
        *[F.max(m).alias(m) for m in s.measures],
    )


def with_severity(daily: DataFrame, threshold: int = 12, score: str = "points") -> DataFrame:
    return daily.withColumn("severity", severity_level(score, threshold)).withColumn(
        "severity_code", severity_code("severity")
    )


def family_daily(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """One row per entity, day and family with affected / severe / all_failed."""
    s = spec
    failed = F.col(s.flag) == 1
    cost = [F.sum(s.cost).alias("cost")] if s.cost in panel.columns else []
    out = panel.groupBy(s.date, s.entity, s.etype, s.site, s.family).agg(
        F.count(F.lit(1)).alias("total_parts"),
        F.sum(F.col(s.flag)).cast("bigint").alias("failed_parts"),
        F.count(F.when(failed & (F.col(s.grade) == "A"), F.lit(1))).alias("failed_a_parts"),
        F.max(s.flag).alias("family_flag"),
        *cost,
        *[F.max(m).alias(m) for m in s.measures],
    )
    return out.withColumns(
        {
            "affected": (F.col("failed_parts") >= 1).cast("int"),
            "severe": ((F.col("failed_parts") >= 2) | (F.col("failed_a_parts") >= 1)).cast("int"),
            "all_failed": (F.col("failed_parts") == F.col("total_parts")).cast("int"),
        }
    )


def full_family_label(families: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Entity-day label: does any family have all its parts failed, and how many do."""
    return families.groupBy(spec.date, spec.entity).agg(
        F.max("all_failed").alias("full_breakdown"),
        F.sum(F.col("all_failed")).cast("bigint").alias("fully_failed_families"),
    )


def single_failure_daily(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """clean / isolated / multiple per entity-day and, if isolated, which part failed."""
    s = spec
    failed = F.col(s.flag) == 1
    return _with_status(panel.groupBy(s.date, s.entity, s.etype).agg(
        F.count(F.lit(1)).alias("total_parts"),
        F.sum(F.col(s.flag)).cast("bigint").alias("failed_parts"),
        F.max(F.when(failed, F.struct(F.col(s.member).alias("part"), F.col(s.family).alias("family")))).alias("_hit"),
        *[F.max(m).alias(m) for m in s.measures],
    ))


def scored_failure_daily(panel: DataFrame, members: Mapping[str, str], spec: PanelSpec = PANEL) -> DataFrame:
    """Points, measures and ``single_failure_daily``'s status of each entity-day from one pass over the panel.

    ``members`` maps every member to its family; with their numbers in place of their names the days are aggregated without a sort.
    """
    s = spec
    number = F.array_position(F.array(*[F.lit(m) for m in members]), F.col(s.member))
    out = panel.groupBy(s.date, s.entity, s.etype, s.site).agg(
        F.sum(F.col(s.flag) * grade_weight(s.grade)).cast("bigint").alias("points"),
        F.sum(F.col(s.flag)).cast("bigint").alias("failed_parts"),
        F.max(F.when(F.col(s.flag) == 1, number)).alias("_number"),
        *[F.max(m).alias(m) for m in s.measures],
    )
    at = (F.col("_number") - 1).cast("int")
    part, family = F.get(F.array(*[F.lit(m) for m in members]), at), F.get(F.array(*[F.lit(f) for f in members.values()]), at)
    return _with_status(out.withColumn("_hit", F.struct(part.alias("part"), family.alias("family"))).drop("_number"))


def _with_status(out: DataFrame) -> DataFrame:
    one = F.col("failed_parts") == 1
    return out.withColumns(
        {
            "status": F.when(F.col("failed_parts") == 0, "clean").when(one, "isolated").otherwise("multiple"),
            "failed_part": F.when(one, F.col("_hit.part")),
            "failed_family": F.when(one, F.col("_hit.family")),
        }
    ).drop("_hit")


def family_profile(
    families: DataFrame, date: str, valid_start: str, test_start: str, targets: Sequence[str] = ("affected", "severe", "all_failed")
) -> DataFrame:
    """Count and rate of each family label, overall and per period."""
    from gearwatch.operators.splits import period_column

    periods = families.withColumn(
        "period", F.explode(F.array(F.lit("overall"), period_column(date, valid_start, test_start)))
    )
    out = periods.groupBy("period", "family").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max("total_parts").alias("total_parts"),
        *[F.sum(F.col(t)).cast("bigint").alias(f"{t}_count") for t in targets],
    )
    return out.withColumns({f"{t}_rate": F.try_divide(F.col(f"{t}_count").cast("double"), F.col("row_count")) for t in targets})
