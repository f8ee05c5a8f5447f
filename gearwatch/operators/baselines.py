"""Constant and group-rate baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearwatch.operators.joins import lookup


def constant_rate(train: DataFrame, target: str) -> Column:
    """Mean label of the training rows, as a scalar subquery."""
    return train.agg(F.avg(F.col(target).cast("double"))).scalar()


def group_rate_table(train: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    return train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(target).cast("double")).alias("rate")
    )


def score_group_rate(table: DataFrame, rows: DataFrame, keys: Sequence[str], fallback: float | Column, out: str = "score") -> DataFrame:
    return lookup(rows, table.withColumnRenamed("rate", out), keys, out, fallback)


def fit_and_score(df: DataFrame, keys: Sequence[str], target: str, split: str = "split", out: str = "score") -> DataFrame:
    """Group rates learnt on the train rows and applied to all rows, unseen keys get the train mean."""
    train = df.filter(F.col(split) == "train")
    return score_group_rate(group_rate_table(train, keys, target), df, keys, constant_rate(train, target), out)
