"""Leak-free history columns on the calendar (RANGE) or on observed rows (ROWS).

Every column of one call shares one partition and one order, so Spark plans a
single exchange and a single sort. The key (entity or entity-member, day) is
unique after the rollup: a window group never holds more rows than the calendar
has days, however hot the entity was in the raw data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearwatch.functions.expressions import day_number


@dataclass(frozen=True)
class Past:
    """One history column: statistic of ``src`` over offsets ``lo..hi`` (negative is past)."""

    out: str
    src: str
    stat: str
    lo: int
    hi: int
    at_least: int = 1


def lag(src: str, k: int, out: str | None = None) -> Past:
    return Past(out or f"{src}_lag{k}", src, "max", -k, -k)


def median_of_sorted(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    low = F.element_at(sorted_values, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(sorted_values, F.floor((n + 2) / 2).cast("int"))
    return (low + high) / 2


def _deviation_of(sorted_values: Column) -> Column:
    middle = median_of_sorted(sorted_values)
    return median_of_sorted(F.sort_array(F.transform(sorted_values, lambda v: F.abs(v - middle))))


def add_history(
    df: DataFrame, by: Sequence[str], date: str, columns: Sequence[Past], calendar: bool = True
) -> DataFrame:
    """Append the columns. ``calendar`` picks day offsets (RANGE) or row offsets (ROWS).

    Medians and deviations of one source and frame read one sorted list of its values.
    """
    ordered = Window.partitionBy(*by).orderBy(day_number(date))
    windowed: dict[str, Column] = {}
    derived: dict[str, Column] = {}
    helpers: dict[str, None] = {}
    for c in columns:
        frame = ordered.rangeBetween(c.lo, c.hi) if calendar else ordered.rowsBetween(c.lo, c.hi)
        x = F.col(c.src).cast("double") if c.stat in ("mean", "std", "slope") else F.col(c.src)
        enough = F.count(c.src).over(frame) >= c.at_least
        if c.stat == "mean":
            value = F.avg(x).over(frame)
        elif c.stat == "sum":
            value = F.sum(x).over(frame)
        elif c.stat == "max":
            value = F.max(x).over(frame)
        elif c.stat == "std":
            value = F.stddev_samp(x).over(frame)
        elif c.stat == "slope":
            value = F.regr_slope(x, day_number(date).cast("double")).over(frame)
        elif c.stat == "complete":
            windowed[c.out] = enough
            continue
        elif c.stat in ("median", "mad"):
            seen = f"_seen_{c.src}_{-c.lo}_{-c.hi}"
            windowed[seen] = F.sort_array(F.collect_list(x.cast("double")).over(frame))
            helpers[seen] = None
            found = median_of_sorted(F.col(seen)) if c.stat == "median" else _deviation_of(F.col(seen))
            derived[c.out] = F.when(F.size(seen) >= max(1, c.at_least), found)
            continue
        else:
            raise ValueError(f"unknown statistic: {c.stat}")
        windowed[c.out] = F.when(enough, value) if c.at_least > 1 else value
    out = df.withColumns(windowed)
    if derived:
        out = out.withColumns(derived).drop(*helpers)
    return out


def days_since(df: DataFrame, by: Sequence[str], date: str, condition: Column, out: str, has: str | None = None) -> DataFrame:
    """Days since the last earlier row that met the condition, NULL when none did."""
    before = Window.partitionBy(*by).orderBy(day_number(date)).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(condition, day_number(date)), ignorenulls=True).over(before)
    columns = {out: day_number(date) - last}
    if has:
        columns[has] = last.isNotNull()
    return df.withColumns(columns)


def measure_history(df: DataFrame, by: Sequence[str], date: str, measures: Sequence[str]) -> DataFrame:
    """Lags 1/3/7, mean and spread of the week up to today, change since yesterday."""
    columns: list[Past] = []
    for m in measures:
        columns += [lag(m, k) for k in (1, 3, 7)]
        columns += [Past(f"{m}_mean7", m, "mean", -6, 0, 3), Past(f"{m}_std7", m, "std", -6, 0, 3)]
    out = add_history(df, by, date, columns)
    return out.withColumns({f"{m}_diff1": F.col(m) - F.col(f"{m}_lag1") for m in measures})


def robust_history(df: DataFrame, by: Sequence[str], date: str, measures: Sequence[str]) -> DataFrame:
    """Lags, changes, past medians, median absolute deviation and full-week slope."""
    columns: list[Past] = []
    for m in measures:
        columns += [lag(m, k) for k in (1, 3, 7)]
        columns += [
            Past(f"{m}_median3", m, "median", -3, -1, 2),
            Past(f"{m}_median7", m, "median", -7, -1, 3),
            Past(f"{m}_mad7", m, "mad", -7, -1, 3),
            Past(f"{m}_slope7", m, "slope", -7, -1, 7),
        ]
    out = add_history(df, by, date, columns)
    changes = {}
    for m in measures:
        changes[f"{m}_diff1"] = F.col(m) - F.col(f"{m}_lag1")
        changes[f"{m}_diff7"] = F.col(m) - F.col(f"{m}_lag7")
    return out.withColumns(changes)


def residual_history(df: DataFrame, by: Sequence[str], date: str, columns: Sequence[str]) -> DataFrame:
    """History of residual columns: lags, median, deviation and slope of the past week."""
    wanted: list[Past] = []
    for m in columns:
        wanted += [lag(m, k) for k in (1, 3, 7)]
        wanted += [
            Past(f"{m}_median7", m, "median", -7, -1, 3),
            Past(f"{m}_mad7", m, "mad", -7, -1, 3),
            Past(f"{m}_slope7", m, "slope", -7, -1, 7),
        ]
    return add_history(df, by, date, wanted)


def observed_row_history(df: DataFrame, by: Sequence[str], date: str, measures: Sequence[str]) -> DataFrame:
    """The same idea over the previous observations instead of calendar days."""
    columns: list[Past] = []
    for m in measures:
        columns += [
            Past(f"{m}_prev", m, "max", -1, -1),
            Past(f"{m}_mean7", m, "mean", -7, -1, 3),
            Past(f"{m}_std7", m, "std", -7, -1, 3),
            Past(f"_{m}_mean30", m, "mean", -30, -1, 7),
        ]
    out = add_history(df, by, date, columns, calendar=False)
    extra = {}
    for m in measures:
        gap = F.col(m) - F.col(f"{m}_mean7")
        extra[f"{m}_diff1"] = F.col(m) - F.col(f"{m}_prev")
        extra[f"{m}_vs_mean7"] = gap
        extra[f"{m}_anomaly7"] = F.try_divide(F.abs(gap), F.col(f"{m}_std7"))
        extra[f"{m}_vs_mean30"] = F.col(m) - F.col(f"_{m}_mean30")
    return out.withColumns(extra).drop(*[f"{m}_prev" for m in measures], *[f"_{m}_mean30" for m in measures])


def strict_measure_history(df: DataFrame, by: Sequence[str], date: str, measures: Sequence[str]) -> DataFrame:
    """Yesterday's value and the mean of a past week without gaps."""
    columns: list[Past] = []
    for m in measures:
        columns += [lag(m, 1), Past(f"{m}_mean_prev_7d", m, "mean", -7, -1, 7)]
    return add_history(df, by, date, columns)


def flag_history(df: DataFrame, by: Sequence[str], date: str, flag: str) -> DataFrame:
    """Yesterday's flag, flags of the past 7 and 30 days and days since the last one."""
    out = add_history(
        df, by, date,
        [
            lag(flag, 1),
            Past(f"{flag}_count_7d", flag, "sum", -7, -1),
            Past(f"{flag}_count_30d", flag, "sum", -30, -1),
        ],
    )
    return days_since(out, by, date, F.col(flag) == 1, f"days_since_last_{flag}")


def strict_flag_history(df: DataFrame, by: Sequence[str], date: str, flag: str, quantity: str | None = None) -> DataFrame:
    """Flag days (and quantity) over complete past windows of 7 and 30 days."""
    columns = [Past(f"{flag}_days_prev_{n}d", flag, "sum", -n, -1, n) for n in (7, 30)]
    if quantity:
        columns += [Past(f"{quantity}_prev_{n}d", quantity, "sum", -n, -1, n) for n in (7, 30)]
    columns.append(Past("history_30d_complete", flag, "complete", -30, -1, 30))
    out = add_history(df, by, date, columns)
    return days_since(out, by, date, F.col(flag) == 1, f"days_since_last_{flag}", f"has_prior_{flag}")


def risk_history(df: DataFrame, by: Sequence[str], date: str, score: str, threshold: int) -> DataFrame:
    """History of the entity score and of its days at or above the threshold."""
    risky = (F.col(score) >= threshold).cast("int")
    out = add_history(
        df.withColumn("_risky", risky), by, date,
        [
            lag(score, 1),
            Past(f"{score}_mean7", score, "mean", -7, -1),
            Past(f"{score}_max7", score, "max", -7, -1),
            Past("risk_count_30d", "_risky", "sum", -30, -1),
        ],
    )
    return days_since(out, by, date, F.col("_risky") == 1, "days_since_last_risk").drop("_risky")


def family_history(df: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """History of a family's affected and severe days."""
    out = add_history(
        df, by, date,
        [
            lag("affected", 1),
            Past("affected_count_7d", "affected", "sum", -7, -1),
            Past("affected_count_30d", "affected", "sum", -30, -1),
            lag("severe", 1),
            Past("severe_count_30d", "severe", "sum", -30, -1),
        ],
    )
    return days_since(out, by, date, F.col("affected") == 1, "days_since_last_affected")


def previous_row(df: DataFrame, by: Sequence[str], date: str, columns: Sequence[str]) -> DataFrame:
    """Value and change against the previous observed row."""
    w = Window.partitionBy(*by).orderBy(day_number(date))
    out = {}
    for c in columns:
        out[f"{c}_prev"] = F.lag(c).over(w)
        out[f"{c}_change"] = F.col(c) - F.lag(c).over(w)
    return df.withColumns(out)
