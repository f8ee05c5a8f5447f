"""Rolling-origin backtest of a daily measure and the next-day forecast.

The model is a least-squares fit on a yearly and a weekly cycle. Its inputs are
sums of products per entity and day, accumulated over time with a window, so
every origin's fit comes from running sums of the history before it: no refit
reads the history again, and history is never copied per origin.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearwatch.functions.expressions import day_number


def _waves(n: Column) -> list[Column]:
    year, week = n * F.lit(2 * pi / 365.25), n * F.lit(2 * pi / 7)
    return [F.lit(1.0), n / F.lit(3650.0), F.sin(year), F.cos(year), F.sin(year * 2), F.cos(year * 2), F.sin(week), F.cos(week), F.sin(week * 2), F.cos(week * 2)]


WIDTH = 10


def _solver():
    @F.pandas_udf(T.DoubleType())
    def solve(products: pd.Series, point: pd.Series) -> pd.Series:
        """Prediction at a point from packed sums [x'x | x'y]; a small ridge keeps short histories stable."""
        out = []
        for packed, x in zip(products, point):
            if packed is None:
                out.append(None)
                continue
            m = np.asarray(packed, dtype=float).reshape(WIDTH, WIDTH + 1)
            beta = np.linalg.lstsq(m[:, :-1] + 1e-6 * np.eye(WIDTH), m[:, -1], rcond=None)[0]
            out.append(float(np.dot(beta, np.asarray(x, dtype=float))))
        return pd.Series(out, dtype=float)

    return solve


def checkpoint_days(df: DataFrame, by: Sequence[str], date: str, stride: int) -> DataFrame:
    """Every stride-th row of each group and its last one (groups are calendars, bounded by their days)."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    w = Window.partitionBy(*by).orderBy(day_number(date))
    i = F.row_number().over(w)
    last = F.lead(date).over(w).isNull()
    return df.withColumn("_keep", ((i - 1) % stride == 0) | last).filter("_keep").drop("_keep")


def origins(daily: DataFrame, value: str, entity: str = "entity", date: str = "d") -> DataFrame:
    """Each day with what was known before it: previous value, value 7 rows before, history size, fit."""
    w = Window.partitionBy(entity).orderBy(day_number(date))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = _waves(day_number(date).cast("double"))
    y = F.col(value).cast("double")
    cells = [F.sum(a * b).over(before) for a in x for b in [*x, y]]
    return daily.select(entity, date, F.col(value).alias("actual"), *[c for c in ("split",) if c in daily.columns],
        F.count(value).over(before).alias("train_rows"),
        F.max(date).over(before).alias("origin"),
        F.lag(value, 1).over(w).alias("previous_day"),
        F.lag(value, 7).over(w).alias("previous_week"),
        F.array(*cells).alias("_sums"),
        F.array(*x).alias("_x"),
    )


def backtest(daily: DataFrame, value: str, stride: int = 7, min_rows: int = 60, entity: str = "entity", date: str = "d", parts: Sequence[str] = ("valid", "test")) -> DataFrame:
    """Checkpoints of the held-out parts with the model and both naive forecasts."""
    held = origins(daily, value, entity, date).filter(F.col("split").isin(*parts) & (F.col("train_rows") >= min_rows))
    points = checkpoint_days(held, [entity, "split"], date, stride)
    return points.withColumn("seasonal", _solver()("_sums", "_x")).drop("_sums", "_x")


def backtest_metrics(points: DataFrame, models: Sequence[str], entity: str = "entity") -> DataFrame:
    """MAE and RMSE per entity and pooled (``ALL``), one pass."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) - F.col("actual")).alias("e")) for m in models])
    long = points.select(F.col(entity).cast("string").alias(entity), "split", F.inline(cells))
    both = long.select(F.explode(F.array(entity, F.lit("ALL"))).alias(entity), "split", "model", "e")
    return both.groupBy(entity, "split", "model").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")
    )


def next_day(daily: DataFrame, value: str, entity: str = "entity", date: str = "d") -> DataFrame:
    """Forecast of the day after each entity's last one from all its history."""
    x = _waves(day_number(date).cast("double"))
    y = F.col(value).cast("double")
    sums = F.array(*[F.sum(a * b) for a in x for b in [*x, y]])
    g = daily.groupBy(entity).agg(F.max(date).alias("trained_through"), F.count(value).alias("train_rows"), sums.alias("_sums"))
    g = g.withColumn(date, F.date_add("trained_through", 1))
    return g.select(entity, date, "trained_through", "train_rows", _solver()("_sums", F.array(*_waves(day_number(date).cast("double")))).alias("forecast"))
