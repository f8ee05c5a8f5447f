"""Tables of metric and prediction rows as screens and reports show them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearwatch.operators import metrics

# Columns of a comparison and the order of its rows.
COMPARISON_COLUMNS = (
    "experiment", "target", "scope_kind", "scope_name", "feature_set", "model", "status", "policy", "cutoff", "train_rows", "valid_rows", "test_rows",
    "test_positive_rate", "accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "tn", "fp", "fn", "tp",
)
COMPARISON_ORDER = ("experiment", "target", "scope_kind", "scope_name", "feature_set", "policy")


def cross_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Test rows of the selected models of several experiments under each other, in pinned columns and a fixed order of rows.

    ``place`` numbers the rows from 1. A column that an experiment does not have is NULL.
    """
    out = None
    for name, table in tables.items():
        missing = sorted({"selected_model", "split", "model"} - set(table.columns))
        if missing:
            raise ValueError(f"{name} lacks the columns {missing}")
        own = table.filter(F.coalesce(F.col("selected_model").cast("boolean"), F.lit(False)) & (F.col("split") == "test")).withColumn("experiment", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no experiment given")
    columns = [F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in COMPARISON_COLUMNS]
    return out.select(*columns).orderBy(*[F.col(c).asc_nulls_first() for c in COMPARISON_ORDER])


def model_rows(table: DataFrame, target: str, scope_kind: str, scope_name: str, order: Sequence[str], policy: str = "f1", split: str = "test") -> DataFrame:
    """One task's rows of all models, baselines first, in the given order; ``focus`` marks the selected one. An error if there are none."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    rows = table.filter(
        (F.col("target") == target) & (F.col("scope_kind") == scope_kind) & (F.col("scope_name") == scope_name) & (F.col("policy") == policy) & (F.col("split") == split)
    ).withColumn("place", place).filter("place > 0")
    if rows.isEmpty():
        raise ValueError(f"no results of {target} for {scope_kind} {scope_name}")
    return rows.withColumn("focus", F.coalesce(F.col("selected_model"), F.lit(False))).orderBy("place")


def focus_model(table: DataFrame, **task) -> str:
    """Name of the model whose figures a screen shows."""
    hit = model_rows(table, **task).filter("focus").select("model").take(1)
    if not hit:
        raise ValueError("no model is selected")
    return hit[0]["model"]


def _of_asset(predictions: DataFrame, asset, target: str, policy: str, entity: str) -> DataFrame:
    rows = predictions.filter((F.col(entity) == asset) & (F.col("target") == target) & (F.col("policy") == policy) & (F.col("split") == "test"))
    if rows.isEmpty():
        raise ValueError(f"unknown asset: {asset}")
    return rows


def family_rows(predictions: DataFrame, asset, families: Sequence[str], target: str = "affected", policy: str = "f1", entity: str = "entity") -> DataFrame:
    """One asset's families, best AP first: model, support and figures at the stored cutoff of each family's model.

    Every family must come out once.
    """
    key = ["scope_name", "model", "cutoff"]
    rows = _of_asset(predictions, asset, target, policy, entity).filter(F.col("scope_kind") == "family")
    figures = metrics.at_cutoff(rows, key, "cutoff").drop("always_negative_accuracy", "alert_rate")
    out = figures.join(metrics.ranking_quality(rows, key).select(*key, "average_precision", "roc_auc"), key).withColumnsRenamed({"scope_name": "family", "positives": "support"})
    found = sorted(r["family"] for r in out.select("family").collect())  # a name per family
    if found != sorted(families):
        raise ValueError(f"families of {asset}: {found} instead of {sorted(families)}")
    return out.orderBy(F.col("average_precision").desc_nulls_last(), "family")


def family_detail(predictions: DataFrame, asset, family: str, target: str = "affected", policy: str = "f1", entity: str = "entity") -> DataFrame:
    """PR curve of one asset and family, every point with the confusion at the stored cutoff."""
    rows = _of_asset(predictions, asset, target, policy, entity).filter((F.col("scope_kind") == "family") & (F.col("scope_name") == family))
    cutoffs = [r["cutoff"] for r in rows.select("cutoff").distinct().take(2)]
    if len(cutoffs) != 1:
        raise ValueError(f"{asset}, {family}: {len(cutoffs)} stored cutoffs instead of one")
    curve = metrics.pr_curve(rows, ["scope_name"]).withColumnRenamed("cutoff", "score")
    at = metrics.at_cutoff(rows, ["scope_name"], "cutoff").select("scope_name", "tn", "fp", "fn", "tp", F.lit(cutoffs[0]).cast("double").alias("cutoff"))
    return curve.join(at, "scope_name").withColumnRenamed("scope_name", "family")
