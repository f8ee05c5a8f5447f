"""Evaluation metrics as relational jobs: one row per group of scored rows.

All ranking metrics start from ``score_table``: rows are grouped by score first
(hot scores and tied rows collapse map-side), then running totals are taken by
ranges of the score, so a group of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearwatch.functions.expressions import SEVERITY_LEVELS, observed_severity, predicted_severity, ratio
from gearwatch.operators.ordered import row_numbers, running_totals, value_counts


def _d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def score_counts(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """Rows of each score and label in ``weight``: what ranking figures and confusions need, without the rows themselves."""
    return df.groupBy(*by, score, label).agg(F.count(F.lit(1)).alias("weight"))


def score_table(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y", weight: str | None = None) -> DataFrame:
    """Distinct scores, highest first: n, pos, alerts and tp at that cutoff, totals tot and ptot. ``weight``: rows that a row stands for."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    if weight is None:
        counts = value_counts(known, by, score, {"pos": F.col(label).cast("bigint")})
    else:
        counts = known.groupBy(*by, score).agg(F.sum(weight).alias("n"), F.sum(F.col(label).cast("bigint") * F.col(weight)).alias("pos"))
    run = running_totals(counts, by, [(score, False)], {"n": "n", "pos": "pos"})
    return run.select(
        *by,
        score,
        "n",
        "pos",
        (F.col("n_before") + F.col("n")).alias("alerts"),
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        F.col("n_total").alias("tot"),
        F.col("pos_total").alias("ptot"),
    )


def ranking_quality(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y", weight: str | None = None) -> DataFrame:
    """Average precision, ROC-AUC, trapezoid PR-AUC and AP lift per group.

    NULL for a group with a single class.
    """
    t = score_table(df, by, score, label, weight)
    pos, tp, alerts, n = _d("pos"), _d("tp"), _d("alerts"), _d("n")
    before = alerts - n
    p_before = F.when(before > 0, F.try_divide(tp - pos, before)).otherwise(F.lit(1.0))
    out = t.groupBy(*by).agg(
        F.max("tot").alias("rows"),
        F.max("ptot").alias("positives"),
        F.sum(pos * F.try_divide(tp, alerts)).alias("_ap"),
        F.sum((n - pos) * (tp - pos / 2)).alias("_auc"),
        F.sum(pos * (F.try_divide(tp, alerts) + p_before) / 2).alias("_pr"),
    )
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    p, q = _d("positives"), _d(F.col("rows") - F.col("positives"))
    rate = ratio("positives", "rows")
    return out.select(
        *by,
        "rows",
        "positives",
        rate.alias("positive_rate"),
        F.when(both, F.try_divide(F.col("_ap"), p)).alias("average_precision"),
        F.when(both, F.try_divide(F.col("_auc"), p * q)).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("_pr"), p)).alias("pr_auc_trapezoid"),
        F.when(both, F.try_divide(F.try_divide(F.col("_ap"), p), rate)).alias("ap_lift"),
    )


def pr_curve(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y", max_points: int | None = None) -> DataFrame:
    """Precision and recall at every cutoff, position 0 being the lowest cutoff.

    The closing point (recall 0, precision 1) has no cutoff. ``max_points``
    thins the curve evenly, always keeping both ends.
    """
    t = score_table(df, by, score, label).withColumn("_one", F.lit(1))
    run = running_totals(t, by, [(score, True)], {"i": "_one"})
    last = F.col("i_before") == F.col("i_total") - 1
    here = F.struct(
        F.col("i_before").alias("position"),
        F.col(score).alias("cutoff"),
        F.try_divide(_d("tp"), _d("alerts")).alias("precision"),
        ratio("tp", "ptot", 0.0).alias("recall"),
    )
    end = F.struct(
        F.col("i_total").alias("position"),
        F.lit(None).cast("double").alias("cutoff"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    points = run.select(
        *by, (F.col("i_total") + 1).alias("points"), F.inline(F.when(last, F.array(here, end)).otherwise(F.array(here)))
    )
    if max_points is None:
        return points
    return thin_points(points, max_points)


def thin_points(points: DataFrame, max_points: int) -> DataFrame:
    """Keep the positions that an even grid of ``max_points`` from first to last hits."""
    keep = F.least(F.col("points"), F.lit(max_points)).cast("bigint")
    step = F.try_divide(_d(F.col("points") - 1), _d(keep - 1))
    # Position p is hit if floor(j * step) = p for some grid index j.
    j = F.ceil(F.try_divide(_d("position"), step))
    hit = (F.floor(_d(j) * step) == F.col("position")) & (j < keep)
    on_end = F.col("position") == F.col("points") - 1
    return points.filter((F.col("points") <= max_points) | on_end | F.coalesce(hit, F.lit(True)))


def brier(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(_d(score) - _d(label), 2)).alias("brier"))


def confusion(df: DataFrame, by: Sequence[str], predicted: str = "predicted", label: str = "y", weight: str | None = None) -> DataFrame:
    """tp / fp / fn / tn of a 0/1 prediction and the rates made from them; NULL predictions give NULL rates.

    ``weight``: rows that a row stands for.
    """
    hit, y = F.col(predicted) == 1, F.col(label) == 1
    known = F.col(predicted).isNotNull()

    def tally(c: Column, name: str) -> Column:
        found = F.count(F.when(c, F.lit(1))) if weight is None else F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0))
        return found.alias(name)

    out = df.groupBy(*by).agg(
        tally(hit & y, "tp"), tally(hit & ~y, "fp"), tally(known & ~hit & y, "fn"), tally(known & ~hit & ~y, "tn"),
        tally(F.lit(True), "rows"), tally(known, "_known"), tally(y, "positives"),
    )
    return rates_from_counts(out).drop("_known")


def rates_from_counts(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, alert rate from tp / fp / fn / tn columns."""
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    total = tp + fp + fn + tn
    some = total > 0
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, total),
            "precision": F.when(some, ratio(tp, tp + fp, 0.0)),
            "recall": F.when(some, ratio(tp, tp + fn, 0.0)),
            "f1": F.when(some, ratio(2 * tp, 2 * tp + fp + fn, 0.0)),
            "alert_rate": ratio(tp + fp, total),
            "always_negative_accuracy": ratio(fp + tn, total),
        }
    )


def at_cutoff(df: DataFrame, by: Sequence[str], cutoff: float | str, score: str = "score", label: str = "y") -> DataFrame:
    """Confusion of stored scores at any cutoff (a number or a column; NULL means no policy)."""
    cut = F.col(cutoff) if isinstance(cutoff, str) else F.lit(float(cutoff))
    return confusion(
        df.withColumn("predicted", F.when(cut.isNotNull(), (F.col(score) >= cut).cast("int"))), by, "predicted", label
    )


def top_share(df: DataFrame, by: Sequence[str], share: float, score: str = "score", label: str = "y") -> DataFrame:
    """Precision of the top share of scores; a tied block at the edge counts by its expectation."""
    t = score_table(df, by, score, label)
    k = F.greatest(F.lit(1), F.ceil(_d("tot") * share))
    start = F.col("alerts") - F.col("n")
    edge = (start < k) & (k <= F.col("alerts"))
    hits = _d(F.col("tp") - F.col("pos")) + _d(k - start) * F.try_divide(_d("pos"), _d("n"))
    return t.filter(edge).select(*by, k.alias("k"), F.try_divide(hits, _d(k)).alias("precision"))


def rank_at_percent(
    df: DataFrame, by: Sequence[str], ids: Sequence[str], percents: Sequence[int] = (5, 10, 20), score: str = "score", label: str = "y"
) -> DataFrame:
    """Precision, recall and lift among the first p percent; ties fall in id order."""
    rows = df.select(*by, score, label, *[i for i in ids if i not in by])
    ranked = row_numbers(rows, by, [(score, False), *[(i, True) for i in ids if i not in by]])
    aggs = [F.max("rank_of").alias("rows"), F.sum(_d(label)).alias("_p")]
    for p in percents:
        k = F.greatest(F.lit(1), F.ceil(_d("rank_of") * p / 100))
        aggs += [F.sum(F.when(F.col("rank") <= k, _d(label)).otherwise(0.0)).alias(f"_h{p}"), F.max(k).alias(f"_k{p}")]
    g = ranked.groupBy(*by).agg(*aggs)
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("percent"), F.col(f"_k{p}").alias("k"), F.col(f"_h{p}").alias("hits")) for p in percents
        ]
    )
    long = g.select(*by, "rows", "_p", F.inline(cells))
    precision = ratio("hits", "k")
    return long.select(
        *by,
        "percent",
        "k",
        precision.alias("precision"),
        ratio("hits", "_p", 0.0).alias("recall"),
        F.try_divide(precision, ratio("_p", "rows")).alias("lift"),
    )


def class_confusion(df: DataFrame, by: Sequence[str], actual: str, predicted: str, classes: Sequence = SEVERITY_LEVELS) -> DataFrame:
    """Long confusion table over a fixed class order, absent cells zero."""
    cells = []
    aggs = []
    for i, a in enumerate(classes):
        for j, p in enumerate(classes):
            aggs.append(F.count(F.when((F.col(actual) == a) & (F.col(predicted) == p), F.lit(1))).alias(f"_{i}_{j}"))
            cells.append(F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_{i}_{j}").alias("rows")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def per_class(df: DataFrame, by: Sequence[str], actual: str, predicted: str, classes: Sequence = SEVERITY_LEVELS) -> DataFrame:
    """Precision, recall, F1 and support of every class in one pass."""
    aggs, cells = [], []
    for i, c in enumerate(classes):
        a, p = F.col(actual) == c, F.col(predicted) == c
        for name, cond in (("tp", a & p), ("fp", ~a & p), ("fn", a & ~p)):
            aggs.append(F.count(F.when(cond, F.lit(1))).alias(f"_{name}{i}"))
        tp, fp, fn = (F.col(f"_{x}{i}") for x in ("tp", "fp", "fn"))
        cells.append(
            F.struct(
                F.lit(i).alias("class_order"),
                F.lit(c).alias("class"),
                ratio(tp, tp + fp, 0.0).alias("precision"),
                ratio(tp, tp + fn, 0.0).alias("recall"),
                ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
                (tp + fn).alias("support"),
            )
        )
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def multiclass_summary(df: DataFrame, by: Sequence[str], actual: str, predicted: str, classes: Sequence = SEVERITY_LEVELS, top: str = "high_risk") -> DataFrame:
    """Accuracy, macro and weighted averages, top class as a binary task and the matrix as JSON."""
    each = per_class(df, by, actual, predicted, classes)
    averages = each.groupBy(*by).agg(
        F.sum("support").alias("rows"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), _d(F.sum("support"))).alias("weighted_f1"),
        F.max(F.when(F.col("class") == top, F.col("precision"))).alias("top_precision"),
        F.max(F.when(F.col("class") == top, F.col("recall"))).alias("top_recall"),
        F.max(F.when(F.col("class") == top, F.col("f1"))).alias("top_f1"),
    )
    matrix = confusion_json(df, by, actual, predicted, classes)
    return averages.join(matrix, list(by)) if by else averages.withColumn("_k", F.lit(1)).join(
        matrix.withColumn("_k", F.lit(1)), "_k"
    ).drop("_k")


def confusion_json(df: DataFrame, by: Sequence[str], actual: str, predicted: str, classes: Sequence = SEVERITY_LEVELS) -> DataFrame:
    """Accuracy and the class matrix as JSON text."""
    matrix = F.array(
        *[
            F.array(*[F.count(F.when((F.col(actual) == a) & (F.col(predicted) == p), F.lit(1))) for p in classes])
            for a in classes
        ]
    )
    right = F.avg((F.col(actual) == F.col(predicted)).cast("double"))
    return df.groupBy(*by).agg(right.alias("accuracy"), F.to_json(matrix).alias("confusion_matrix_json"))


def regression_errors(df: DataFrame, by: Sequence[str], actual: str, predicted: str, clip: bool = False) -> DataFrame:
    """MAE, RMSE and R2 in one pass (sum of squares around the mean from moments)."""
    p = F.greatest(_d(predicted), F.lit(0.0)) if clip else _d(predicted)
    e = _d(actual) - p
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(_d(actual)) * F.count(F.lit(1))).alias("_sst"),
    )
    return out.withColumn("r2", F.when(F.col("rows") >= 2, 1.0 - F.try_divide(F.col("_sse"), F.col("_sst")))).drop("_sse", "_sst")


def with_score_levels(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Observed and predicted severity of a regression, predictions clipped at 0."""
    return df.withColumns({"actual_level": observed_severity(actual), "predicted_level": predicted_severity(predicted)})


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; NULL for a constant side."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("w"))

    def ranks(c: str, name: str) -> DataFrame:
        counts = pairs.groupBy(*by, c).agg(F.sum("w").alias("n"))
        run = running_totals(counts, by, [(c, True)], {"n": "n"})
        return run.select(*by, c, (_d("n_before") + (_d("n") + 1) / 2).alias(name))

    both = pairs.join(ranks(x, "rx"), [*by, x]).join(ranks(y, "ry"), [*by, y])
    w, rx, ry = _d("w"), F.col("rx"), F.col("ry")
    g = both.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"),
        F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"), F.sum(w * rx * ry).alias("sxy"),
    )
    n = F.col("n")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    return g.select(
        *by, n.cast("bigint").alias("rows"), F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))).alias("spearman")
    )


def multilabel(
    df: DataFrame, by: Sequence[str], unit: Sequence[str], label_name: str, labels: Sequence[str],
    actual: str = "y", predicted: str = "predicted", score: str = "score",
) -> DataFrame:
    """Macro and micro precision / recall / F1 / AP, hamming loss, exact match.

    Long input: one row per unit and label. Labels with one class are left out
    of every figure and named in ``excluded``.
    """
    seen = df.filter(F.col(predicted).isNotNull())
    usable = (
        seen.groupBy(*by, label_name)
        .agg(F.min(actual).alias("_lo"), F.max(actual).alias("_hi"))
        .filter(F.col("_lo") < F.col("_hi"))
        .select(*by, label_name)
    )
    kept = seen.join(usable, [*by, label_name], "left_semi")
    rates = confusion(kept, [*by, label_name], predicted, actual)
    aps = ranking_quality(kept.withColumnRenamed(actual, "_y"), [*by, label_name], score, "_y").select(
        *by, label_name, "average_precision"
    )
    macro = rates.join(aps, [*by, label_name]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.array_sort(F.collect_list(label_name)).alias("_names"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.avg("average_precision").alias("macro_average_precision"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
    )
    micro = rates_from_counts(macro)
    micro_ap = ranking_quality(kept.withColumnRenamed(actual, "_y"), by, score, "_y").select(
        *by, F.col("average_precision").alias("micro_average_precision")
    )
    exact = (
        kept.groupBy(*by, *unit)
        .agg(F.min((F.col(actual) == F.col(predicted)).cast("int")).alias("all_right"))
        .groupBy(*by)
        .agg(F.avg(_d("all_right")).alias("exact_match"))
    )
    names = F.array(*[F.lit(x) for x in labels])
    return (
        micro.join(micro_ap, list(by))
        .join(exact, list(by))
        .select(
            *by,
            "evaluated",
            F.array_join(F.array_except(names, F.col("_names")), ";").alias("excluded"),
            "macro_precision",
            "macro_recall",
            "macro_f1",
            "macro_average_precision",
            F.col("precision").alias("micro_precision"),
            F.col("recall").alias("micro_recall"),
            F.col("f1").alias("micro_f1"),
            "micro_average_precision",
            (1.0 - F.col("accuracy")).alias("hamming_loss"),
            "exact_match",
        )
    )
