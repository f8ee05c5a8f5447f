"""Choosing a cutoff from validation scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearwatch.functions.expressions import ratio
from gearwatch.operators.metrics import score_table


def candidate_cutoffs(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y", weight: str | None = None) -> DataFrame:
    """Every distinct score as a cutoff with its precision, recall and F1.

    A cutoff of 0.5 between two scores alerts the same rows as the next score
    above, which wins the tie, so the distinct scores are all that is needed.
    """
    t = score_table(df, by, score, label, weight)
    return t.select(
        *by,
        F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)).alias("cutoff"),
        "alerts",
        "tp",
        "n",
        "tot",
        "ptot",
        ratio("tp", "alerts", 0.0).alias("precision"),
        ratio("tp", "ptot", 0.0).alias("recall"),
        ratio(2 * F.col("tp"), F.col("alerts") + F.col("ptot"), 0.0).alias("f1"),
    )


def choose_cutoffs(
    df: DataFrame,
    by: Sequence[str],
    min_precisions: Sequence[float] = (0.3,),
    top_fractions: Sequence[float] = (0.1,),
    score: str = "score",
    label: str = "y",
    weight: str | None = None,
) -> DataFrame:
    """One row per policy: best F1, most recall at a minimum precision, top fraction.

    Ties go to the highest cutoff. A single-class group gets 0.5 for F1 and the
    top fraction and ``unavailable`` for a minimum precision.
    """
    c = candidate_cutoffs(df, by, score, label, weight)
    cut = F.col("cutoff")
    aggs = [
        F.max(F.struct("f1", "cutoff")).getField("cutoff").alias("_f1"),
        F.max("tot").alias("_n"),
        F.max("ptot").alias("_p"),
    ]
    for i, p in enumerate(min_precisions):
        aggs.append(
            F.max(F.when(F.col("precision") >= p, F.struct("recall", "cutoff"))).getField("cutoff").alias(f"_mp{i}")
        )
    for i, f in enumerate(top_fractions):
        k = F.greatest(F.lit(1), F.ceil(F.col("tot").cast("double") * f))
        aggs.append(F.max(F.when((F.col("alerts") - F.col("n") < k) & (k <= F.col("alerts")), cut)).alias(f"_tf{i}"))
    g = c.groupBy(*by).agg(*aggs)
    both = (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))

    def cell(policy: str, value, single) -> F.Column:
        v = F.when(both, value).otherwise(single)
        return F.struct(
            F.lit(policy).alias("policy"),
            v.cast("double").alias("cutoff"),
            F.when(v.isNull(), "unavailable").otherwise("ok").alias("status"),
        )

    cells = [cell("f1", F.col("_f1"), F.lit(0.5))]
    cells += [
        cell(f"min_precision_{round(p * 100)}", F.col(f"_mp{i}"), F.lit(None)) for i, p in enumerate(min_precisions)
    ]
    cells += [cell(f"top_{round(f * 100)}pct", F.col(f"_tf{i}"), F.lit(0.5)) for i, f in enumerate(top_fractions)]
    return g.select(*by, F.inline(F.array(*cells)))


def family_cutoffs(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """The four policies of the family models."""
    return choose_cutoffs(df, by, (0.70, 0.80), (0.10,), score, label)


def grid_cutoff(
    df: DataFrame, by: Sequence[str], start: float = 0.05, step: float = 0.01, points: int = 91, score: str = "score", label: str = "y"
) -> DataFrame:
    """Best F1 on a fixed grid; ties go to the cutoff nearest 0.5, then the lowest.

    Rows fall into the grid cells first, so the grid is joined to cell counts and
    never to rows: one aggregate of at most ``points`` cells per group, then a
    suffix sum over the cells.
    """
    cuts = [round(start + step * i, 10) for i in range(points)]
    below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(score)))
    cells = df.groupBy(*by, below.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    packed = cells.groupBy(*by).agg(
        F.collect_list(F.struct("cell", "n", "pos")).alias("cells"), F.sum("pos").alias("P")
    )
    grid = F.array(
        *[F.struct(F.lit(i + 1).alias("cell"), F.lit(float(c)).alias("cutoff")) for i, c in enumerate(cuts)]
    )
    zero = F.lit(0).cast("bigint")
    rows = packed.select(*by, "cells", "P", F.explode(grid).alias("g")).select(
        *by,
        F.col("g.cutoff").alias("cutoff"),
        "P",
        F.aggregate(F.filter("cells", lambda c: c["cell"] >= F.col("g.cell")), zero, lambda a, c: a + c["n"]).alias("alerts"),
        F.aggregate(F.filter("cells", lambda c: c["cell"] >= F.col("g.cell")), zero, lambda a, c: a + c["pos"]).alias("tp"),
    )
    scored = rows.withColumn("f1", ratio(2 * F.col("tp"), F.col("alerts") + F.col("P"), 0.0))
    best = F.max(F.struct("f1", (-F.round(F.abs(F.col("cutoff") - 0.5), 6)).alias("near"), (-F.col("cutoff")).alias("low")))
    return scored.groupBy(*by).agg(best.alias("b")).select(
        *by, (-F.col("b.low")).alias("cutoff"), F.col("b.f1").alias("f1")
    )


def apply_cutoffs(rows: DataFrame, cutoffs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scored rows once per policy with the 0/1 (or NULL) prediction of that policy."""
    if by:
        joined = rows.join(cutoffs, list(by), "left")
    else:  # a few rows, one per policy: carried as one array, not joined on a constant
        table = cutoffs.agg(F.collect_list(F.struct(*cutoffs.columns))).scalar()
        joined = rows.withColumn("_cut", F.explode_outer(table)).select(*rows.columns, *[F.col("_cut").getField(c).alias(c) for c in cutoffs.columns])
    return joined.withColumn("predicted", F.when(F.col("cutoff").isNotNull(), (F.col("score") >= F.col("cutoff")).cast("int")))
