"""Time splits and the tables that describe them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearwatch.functions.expressions import first_reason, ratio

SPLITS = ("train", "valid", "test")


def period_column(date: str, valid_start: str, test_start: str) -> Column:
    """train / valid / test by fixed dates, nothing purged."""
    if valid_start >= test_start:
        raise ValueError("valid_start must come before test_start")
    d = F.col(date)
    return (
        F.when(d < F.lit(valid_start).cast("date"), "train")
        .when(d < F.lit(test_start).cast("date"), "valid")
        .when(d.isNotNull(), "test")
    )


def purged_split(date: str, label_end: str, valid_start: str, test_start: str) -> Column:
    """Fixed-date split; a training or validation label may not reach into the next part.

    Rows that do (or whose label end is unknown) get NULL.
    """
    if valid_start >= test_start:
        raise ValueError("valid_start must come before test_start")
    d, e = F.col(date), F.col(label_end)
    valid, test = F.lit(valid_start).cast("date"), F.lit(test_start).cast("date")
    return (
        F.when(d >= test, "test")
        .when((d >= valid) & (e < test), "valid")
        .when((d < valid) & (e < valid), "train")
    )


def date_bounds(df: DataFrame, date: str, first: float = 0.70, second: float = 0.85) -> DataFrame:
    """One row with the limits of a split by distinct dates.

    The aggregate holds each date once, so its size is the length of the calendar.
    """
    dates = df.agg(F.array_sort(F.collect_set(date)).alias("ds"))
    n = F.size("ds")
    at = [F.floor(n * F.lit(first)).cast("int"), F.floor(n * F.lit(second)).cast("int")]
    return dates.select(
        F.get("ds", at[0] - 1).alias("train_end"),
        F.get("ds", at[0]).alias("valid_start"),
        F.get("ds", at[1] - 1).alias("valid_end"),
        F.get("ds", at[1]).alias("test_start"),
        F.get("ds", n - 1).alias("test_end"),
    )


def date_share_split(df: DataFrame, date: str, first: float = 0.70, second: float = 0.85) -> DataFrame:
    """Add ``split`` and ``split_end`` by the share of distinct dates (limits as a scalar subquery)."""
    bounds = date_bounds(df.select(date), date, first, second).select(F.struct("*")).scalar()
    out = df.withColumn("_b", bounds)
    d = F.col(date)
    split = F.when(d <= F.col("_b.train_end"), "train").when(d <= F.col("_b.valid_end"), "valid").otherwise("test")
    end = (
        F.when(d <= F.col("_b.train_end"), F.col("_b.train_end"))
        .when(d <= F.col("_b.valid_end"), F.col("_b.valid_end"))
        .otherwise(F.col("_b.test_end"))
    )
    return out.withColumns({"split": split, "split_end": end}).drop("_b")


def forecast_eligibility(df: DataFrame, flag: str, label_end: str = "label_end") -> DataFrame:
    """Exclusive reason why a row is (not) used, by precedence, and the flags behind it."""
    within = F.col(label_end) <= F.col("split_end")
    reason = first_reason(
        [
            (F.col(flag) != 0, "flagged_today"),
            (~F.col("history_30d_complete"), "short_history"),
            (~F.col("future_complete"), "incomplete_future"),
            (~within, "crosses_split"),
        ],
        "used",
    )
    return df.withColumns(
        {
            "eligible_for_target": F.col("future_complete") & (F.col(flag) == 0),
            "target_within_split": within,
            "reason": reason,
        }
    ).withColumn("eligible_for_model", F.col("reason") == "used")


def split_summary(df: DataFrame, date: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(
        F.min(date).alias("start"),
        F.max(date).alias("end"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(date).alias("dates"),
    )


def split_overlap(df: DataFrame, date: str, split: str = "split") -> DataFrame:
    """Pairs of splits whose date ranges touch; empty when the split is sound."""
    ends = df.groupBy(split).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    order = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col(split))
    ends = ends.withColumn("o", order)
    later = ends.select(F.col(split).alias("next_split"), F.col("lo").alias("next_lo"), F.col("o").alias("next_o"))
    return ends.join(later, F.col("next_o") == F.col("o") + 1).filter(F.col("hi") >= F.col("next_lo")).select(
        split, "hi", "next_split", "next_lo"
    )


def label_rates(long: DataFrame, label: str = "y", criterion: str = "criterion", split: str = "split") -> DataFrame:
    """Rows, positives and rate per criterion, overall and by split, in one pass."""
    sets = long.groupingSets([[F.col(criterion)], [F.col(criterion), F.col(split)]], F.col(criterion), F.col(split))
    out = sets.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label).cast("bigint")).alias("positives"),
    )
    rate = ratio("positives", "rows")
    return out.select(
        F.col(criterion),
        F.coalesce(F.col(split), F.lit("all")).alias("dataset"),
        "rows",
        "positives",
        rate.alias("rate"),
        (1.0 - rate).alias("always_negative_accuracy"),
    )


def exclusion_counts(df: DataFrame, split: str = "split", reason: str = "reason") -> DataFrame:
    return df.groupBy(split, reason).agg(F.count(F.lit(1)).alias("rows"))


def class_shares(df: DataFrame, by: Sequence[str], label: str, classes: Sequence) -> DataFrame:
    """Count and share of every class per group, absent classes as zero."""
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(F.col(label) == c, F.lit(1))).alias(f"_c{i}") for i, c in enumerate(classes)],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_c{i}").alias("rows")) for i, c in enumerate(classes)])
    return counts.select(*by, "total", F.inline(cells)).select(*by, "class", "rows", ratio("rows", "total").alias("share"))
