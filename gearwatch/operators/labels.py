"""Same-day and future labels. Unknown futures are NULL, never 0."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearwatch.functions.expressions import SEVERITY_THRESHOLDS, day_number


def threshold_labels(df: DataFrame, score: str, thresholds: Sequence[int] = SEVERITY_THRESHOLDS) -> DataFrame:
    return df.withColumns({f"severity_{t}": (F.col(score) >= t).cast("int") for t in thresholds})


def future_label(
    df: DataFrame, by: Sequence[str], date: str, flag: str | Column, days: int, kind: str, out: str = "target"
) -> DataFrame:
    """Label of the next ``days`` calendar days, all of which must be observed.

    ``binary``: any flag; ``count``: number of flags; ``first``: 3 for a first
    flag tomorrow, 2 on day 2-3, 1 from day 4 on, 0 for none. Also adds
    ``label_end`` (last day the label looks at) and ``future_complete``.
    """
    f = F.col(flag) if isinstance(flag, str) else flag
    ahead = Window.partitionBy(*by).orderBy(day_number(date)).rangeBetween(1, days)
    complete = F.count(f).over(ahead) == days
    if kind == "binary":
        value = F.max(f).over(ahead).cast("int")
    elif kind == "count":
        value = F.sum(f).over(ahead).cast("int")
    elif kind == "first":
        wait = F.min(F.when(f == 1, day_number(date))).over(ahead) - day_number(date)
        value = F.when(wait == 1, 3).when(wait <= 3, 2).when(wait.isNotNull(), 1).otherwise(0)
    else:
        raise ValueError(f"unknown label kind: {kind}")
    return df.withColumns(
        {
            out: F.when(complete, value),
            "future_complete": complete,
            "label_end": F.date_add(date, days),
        }
    )


def entity_forecast_label(
    df: DataFrame, by: Sequence[str], date: str, score: str, threshold: int, days: int, mode: str
) -> DataFrame:
    """Risk within ``days``; mode ``new`` keeps only rows that are not at risk today.

    The label is built on the full series first and the rows are dropped after.
    """
    if mode not in ("new", "any"):
        raise ValueError("mode must be new or any")
    risky = (F.col(score) >= threshold).cast("int")
    out = future_label(df.withColumn("risk_today", risky), by, date, "risk_today", days, "binary")
    return out.filter(F.col("risk_today") == 0) if mode == "new" else out


def yesterday_rules(
    df: DataFrame, by: Sequence[str], date: str, rules: Mapping[str, tuple[str, str, float]]
) -> DataFrame:
    """Labels over yesterday and today; NULL unless yesterday was observed.

    A rule is (kind, column, limit): ``start`` for below the limit yesterday and
    at or above today, ``stay`` for at or above on both days.
    """
    w = Window.partitionBy(*by).orderBy(day_number(date))
    consecutive = (day_number(date) - F.lag(day_number(date)).over(w)) == 1
    out = {}
    for name, (kind, column, limit) in rules.items():
        before = F.lag(column).over(w)
        today = F.col(column) >= limit
        hit = (before < limit) & today if kind == "start" else (before >= limit) & today
        out[name] = F.when(consecutive, hit.cast("int"))
    return df.withColumns(out)


# The label families and their limits.
COUNT_LIMITS = (3, 4, 5, 6, 7)
COST_LIMITS = (1000, 2500, 5000, 10000, 20000)
START_RULES = {
    "start_parts_ge_3": ("start", "failed_parts", 3),
    "start_severity_ge_10": ("start", "points", 10),
}
CONSEC_RULES = {
    "consec_parts_ge_1": ("stay", "failed_parts", 1),
    "consec_parts_ge_2": ("stay", "failed_parts", 2),
}


def label_family(
    df: DataFrame, family: str, by: Sequence[str], date: str, cost_limits: Sequence[float] = COST_LIMITS
) -> tuple[DataFrame, list[str]]:
    """One of the five same-day label families on an entity-day frame."""
    parts, a = F.col("failed_parts"), F.col("failed_A")
    if family == "CO":
        rules = {f"failed_parts_ge_{n}": parts >= n for n in COUNT_LIMITS}
    elif family == "A":
        rules = {
            "A_ge_1": a >= 1,
            "A_ge_2": a >= 2,
            "A_ge_1_and_total_ge_2": (a >= 1) & (parts >= 2),
            "A_ge_2_or_total_ge_4": (a >= 2) | (parts >= 4),
        }
    elif family == "COST":
        rules = {f"failed_cost_ge_{int(n)}": F.col("failed_cost") >= n for n in cost_limits}
    elif family in ("START", "CONSEC"):
        days = START_RULES if family == "START" else CONSEC_RULES
        return yesterday_rules(df, by, date, days), list(days)
    else:
        raise ValueError(f"unknown label family: {family}")
    return df.withColumns({n: c.cast("int") for n, c in rules.items()}), list(rules)


def long_labels(df: DataFrame, keep: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per (row, criterion), unknown labels left out."""
    return df.unpivot(list(keep), list(labels), "criterion", "y").filter(F.col("y").isNotNull())
