"""Flagship: from the raw panel to a scored and evaluated risk forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearwatch.operators import baselines, history, labels, metrics, quality, rollups, splits
from gearwatch.panel import PANEL, PanelSpec
from gearwatch.session import materialize


def forecast_frame(
    panel: DataFrame, threshold: int, days: int, valid_start: str, test_start: str, mode: str = "any", spec: PanelSpec = PANEL
) -> DataFrame:
    """Entity-day rollup, past score columns, future label and purged split."""
    daily = rollups.entity_daily(panel, spec)
    past = history.risk_history(daily, [spec.entity], spec.date, "points", threshold)
    labelled = labels.entity_forecast_label(past, [spec.entity], spec.date, "points", threshold, days, mode)
    return labelled.withColumn("split", splits.purged_split(spec.date, "label_end", valid_start, test_start))


def scored_forecast(
    panel: DataFrame, threshold: int, days: int, valid_start: str, test_start: str, spec: PanelSpec = PANEL
) -> DataFrame:
    """Known labels with the entity's training rate, blended with its recent mean score."""
    frame = forecast_frame(panel, threshold, days, valid_start, test_start, "any", spec)
    # The training rates and the rows come from one written table.
    rows = materialize(frame.filter(F.col("target").isNotNull() & F.col("split").isNotNull()))
    rated = baselines.fit_and_score(rows, [spec.entity], "target", out="rate")
    recent = F.coalesce(F.col("points_mean7"), F.lit(0.0)) / F.lit(10.0)
    return rated.select(
        spec.date, spec.entity, spec.etype, "split", F.col("target").alias("y"), "rate",
        F.round(F.col("rate") * F.lit(0.7) + recent * F.lit(0.3), 6).alias("score"),
    )


def evaluate_forecast(
    panel: DataFrame, threshold: int, days: int, valid_start: str, test_start: str, spec: PanelSpec = PANEL
) -> DataFrame:
    """Check the panel, score it and report ranking quality per split."""
    panel = materialize(panel)  # checked in several passes, then rolled up
    quality.require_sound(panel, spec)
    scored = scored_forecast(panel, threshold, days, valid_start, test_start, spec)
    return metrics.ranking_quality(scored, ["split"])
