import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gearwatch.operators import baselines, metrics, ranking, selection, thresholds
from gearwatch.operators.joins import checked_join


def scores(seeds=12, rows=60):
    parts = []
    for seed in range(seeds):
        rng = np.random.default_rng(seed)
        y = (rng.random(rows) < 0.3).astype(int)
        y[:2] = [0, 1]
        s = np.round(rng.random(rows) * (0.5 + 0.5 * y), 1 + seed % 2)
        parts.append(pd.DataFrame({"grp": seed, "id": np.arange(rows), "y": y, "score": s}))
    return pd.concat(parts)


def brute(part):
    y, s = part.y.to_numpy(), part.score.to_numpy()
    ap, last = 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        hit = s >= cut
        recall = y[hit].sum() / y.sum()
        ap += (recall - last) * y[hit].mean()
        last = recall
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    k = max(1, math.ceil(len(s) * 0.1))
    kth = np.sort(s)[::-1][k - 1]
    above = s > kth
    top = (y[above].sum() + (k - above.sum()) * y[s == kth].mean()) / k
    f1 = {c: 2 * y[s >= c].sum() / ((s >= c).sum() + y.sum()) for c in set(s)}
    best = max(c for c in f1 if f1[c] == max(f1.values()))
    return ap, auc, top, best


def test_ranking_metrics_equal_brute_force(spark):
    pdf = scores()
    df = spark.createDataFrame(pdf)
    quality = metrics.ranking_quality(df, ["grp"]).toPandas().set_index("grp")
    top = metrics.top_share(df, ["grp"], 0.1).toPandas().set_index("grp")
    cut = thresholds.choose_cutoffs(df, ["grp"]).filter("policy = 'f1'").toPandas().set_index("grp")
    for k, part in pdf.groupby("grp"):
        ap, auc, share, best = brute(part)
        assert quality.loc[k, "average_precision"] == pytest.approx(ap)
        assert quality.loc[k, "roc_auc"] == pytest.approx(auc)
        assert top.loc[k, "precision"] == pytest.approx(share)
        assert cut.loc[k, "cutoff"] == pytest.approx(best)


def test_single_class_has_no_ranking_quality_and_default_cutoffs(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.9)], "y int, score double").withColumn("k", F.lit(1))
    row = metrics.ranking_quality(df, ["k"]).first()
    assert row.average_precision is None and row.roc_auc is None
    cuts = {r.policy: (r.cutoff, r.status) for r in thresholds.choose_cutoffs(df, ["k"]).collect()}
    assert cuts == {"f1": (0.5, "ok"), "min_precision_30": (None, "unavailable"), "top_10pct": (0.5, "ok")}


def test_pr_curve_thinning_matches_an_even_grid(spark):
    pdf = scores(1, 400).assign(score=lambda d: d.id / 400)
    full = metrics.pr_curve(spark.createDataFrame(pdf), ["grp"]).toPandas()
    thin = metrics.pr_curve(spark.createDataFrame(pdf), ["grp"], max_points=37).toPandas()
    want = set(np.unique(np.linspace(0, len(full) - 1, 37).astype(int)))
    assert set(thin.position) == want


def test_spearman_with_ties_and_constant(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": 0, "x": rng.integers(0, 6, 80).astype(float), "y": rng.integers(0, 9, 80).astype(float)})
    flat = pd.DataFrame({"k": 1, "x": [1.0, 1.0, 1.0], "y": [1.0, 2.0, 3.0]})
    out = {r.k: r.spearman for r in metrics.spearman(spark.createDataFrame(pd.concat([pdf, flat])), ["k"], "x", "y").collect()}
    want = np.corrcoef(pdf.x.rank(), pdf.y.rank())[0, 1]
    assert out[0] == pytest.approx(want) and out[1] is None


def test_grid_cutoff_prefers_nearest_half(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.2)], "y int, score double").withColumn("k", F.lit(1))
    row = thresholds.grid_cutoff(df, ["k"]).first()
    assert (row.cutoff, row.f1) == (0.5, 1.0)


def test_group_rates_and_fallback(spark):
    rows = [("A", "train", 1), ("A", "train", 0), ("B", "train", 0), ("A", "test", 1), ("B", "test", 0), ("C", "test", 1)]
    df = spark.createDataFrame(rows, "asset string, split string, y int")
    out = baselines.fit_and_score(df, ["asset"], "y").filter("split = 'test'").toPandas().set_index("asset").score
    assert out["A"] == 0.5 and out["B"] == 0.0 and out["C"] == pytest.approx(1 / 3)


def test_daily_top_k_breaks_ties_by_id(spark):
    rows = [("2024-01-01", "A", 1, 0.5), ("2024-01-01", "B", 0, 0.5), ("2024-01-01", "C", 1, 0.1), ("2024-01-02", "A", 1, 0.3)]
    df = spark.createDataFrame(rows, "d string, asset string, y int, score double")
    out = ranking.daily_top_k(df, "d", ["asset"], 2).orderBy("d").collect()
    assert [(r.inspected, r.hits, r.positives) for r in out] == [(2, 1, 2), (1, 1, 1)]
    assert out[0].recall_at_k == 0.5 and out[0].random_expected_hits == pytest.approx(4 / 3)


def test_multilabel_leaves_out_single_class_labels(spark):
    rows = [(1, "x", 1, 1, 0.9), (2, "x", 0, 1, 0.8), (1, "y", 0, 0, 0.1), (2, "y", 0, 0, 0.2)]
    df = spark.createDataFrame(rows, "u int, f string, y int, predicted int, score double").withColumn("k", F.lit(1))
    row = metrics.multilabel(df, ["k"], ["u"], "f", ["x", "y"]).first()
    assert (row.evaluated, row.excluded, row.hamming_loss, row.exact_match) == (1, "y", 0.5, 0.5)
    assert row.macro_average_precision == 1.0 and row.macro_precision == 0.5


def test_selection_within_tolerance(spark):
    df = spark.createDataFrame(
        [("a", 0.50, 0.2, 0.5, 0.5), ("b", 0.495, 0.4, 0.1, 0.1), ("c", 0.3, 0.9, 0.9, 0.9)],
        "model string, average_precision double, f1 double, recall double, precision double",
    ).withColumn("k", F.lit(1))
    assert selection.select_by_ap(df, ["k"], "model", ["a", "b", "c"]).first().model == "b"
    with pytest.raises(ValueError):
        selection.select_by_ap(df, ["k"], "model", ["a"], -1)


def test_checked_join_rejects_duplicate_keys(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    right = spark.createDataFrame([(1, 2)], "k int, v int")
    assert checked_join(left, right, ["k"]).count() == 2
    with pytest.raises(ValueError):
        checked_join(left, right, ["k"], cardinality="one_to_one")
