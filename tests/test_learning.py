import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from gearwatch.operators.quality import PanelError
from gearwatch.plans import forecast
from gearwatch.plans import learning as L


@pytest.fixture(scope="module")
def task(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "noise": rng.normal(size=n), "c": rng.choice(["u", "v"], n)})
    pdf["y"] = (x + rng.normal(scale=0.5, size=n) > 0.7).astype(int)
    pdf["split"] = np.where(pdf.id < 250, "train", np.where(pdf.id < 325, "valid", "test"))
    pdf.loc[pdf.id % 17 == 0, "noise"] = None
    df = spark.createDataFrame(pdf)
    return L.written(L.Task(df.replace(float("nan"), None), ("x", "noise"), "y", ("c",)))


def test_model_beats_the_constant_and_is_selected(spark, task):
    table = L.comparison(task, {"prior": ("prior", False), "lr": ("lr", True)}, ["id", "split"], ["prior", "lr"]).toPandas()
    test = table[(table.split == "test") & (table.policy == "f1")].set_index("model")
    assert test.loc["lr", "average_precision"] > test.loc["prior", "average_precision"]
    assert test.loc["prior", "roc_auc"] == 0.5 and test.loc["lr", "selected_model"]


def test_importance_and_reload(spark, task, tmp_path):
    model = L.fit(task, L.classifier("lr", task.part("train").count()))
    drops = L.permutation_importance(model, task, "valid", ["id"], ["x", "noise"], 2).toPandas().set_index("feature").importance
    assert drops["x"] > 0.1 > abs(drops["noise"])
    L.save_and_verify(model, str(tmp_path / "m"), L.ready(task.part("test"), task), ["id"])
    names = L.column_names(model, task.part("train"), task)
    assert names[:4] == ["x", "noise", "x__missing", "noise__missing"] and names[4:] == ["c=u", "c=v"]
    table = L.coefficients(model, names).toPandas().set_index("feature").coefficient
    assert table["x"] > abs(table["noise"])
    with pytest.raises(ValueError):
        L.coefficients(model, ["x", "noise"])


def test_estimators_take_the_fixed_values_or_options():
    assert L.classifier("rf", 1).getNumTrees() == 100 and L.classifier("rf", 1, numTrees=3).getNumTrees() == 3
    assert L.classifier("gbt", 1).getMaxIter() == 100 and L.classifier("lr", 10).getMaxIter() == 1000
    assert not L.classifier("lr", 10).getStandardization() and L.regressor("rf", 1).getMaxDepth() == 30


def test_leaks_are_refused(spark, task):
    with pytest.raises(PanelError):
        L.Task(task.frame, ("x", "y"), "y")
    with pytest.raises(PanelError):
        L.Task(task.frame, ("x", "absent"), "y")


def test_an_experiment_is_validated_and_tested_once(spark, task, tmp_path):
    sets = {"A": ("x",), "C": ("x", "noise")}
    folder = str(tmp_path / "run")
    with pytest.raises(ValueError, match="validated"):
        L.test_once(task, sets, ["id"], folder)
    scores = L.validate_once(task, sets, ["id"], folder, 5)
    assert {r.experiment for r in scores.select("experiment").distinct().collect()} == {"A", "C"}
    assert scores.count() == 2 * task.part("valid").count()
    with pytest.raises(ValueError, match="already"):
        L.validate_once(task, sets, ["id"], folder, 5)
    with pytest.raises(ValueError, match="k was 5"):
        L.test_once(task, sets, ["id"], folder, 6)
    with pytest.raises(ValueError, match="feature lists"):
        L.test_once(task, {"A": ("x",), "C": ("noise", "x")}, ["id"], folder)
    changed = L.replace(task, frame=task.frame.withColumn("x", F.when(F.col("id") == 1, F.col("x") + 1).otherwise(F.col("x"))))
    with pytest.raises(ValueError, match="data changed"):
        L.test_once(changed, sets, ["id"], folder)
    first = L.test_once(task, sets, ["id"], folder, 5)
    assert first.count() == 2 * task.part("test").count()
    with pytest.raises(ValueError, match="tested already"):
        L.test_once(task, sets, ["id"], folder, 5)
    with pytest.raises(ValueError, match="at least 1"):
        L.validate_once(task, sets, ["id"], str(tmp_path / "other"), 0)


def test_a_changed_model_is_refused(spark, task, tmp_path):
    folder = str(tmp_path / "run")
    L.validate_once(task, {"A": ("x",)}, ["id"], folder, 1)
    L.fit(task, L.classifier("lr", 1)).write().overwrite().save(f"{folder}/models/A")
    with pytest.raises(ValueError, match="model changed"):
        L.test_once(task, {"A": ("x",)}, ["id"], folder)


def test_medians_are_exact(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.normal(size=2001), "b": rng.integers(0, 3, 2001).astype(float), "c": np.nan, "e": rng.normal(size=2001)})
    pdf.loc[::3, "a"] = np.nan
    got = L.exact_medians(spark.createDataFrame(pdf).repartition(7), ["a", "b", "c", "e"])
    assert got == {"a": pdf.a.median(), "b": pdf.b.median(), "c": 0.0, "e": pdf.e.median()}
    assert L.exact_medians(spark.createDataFrame(pdf), []) == {}


def test_backtest_uses_only_the_past(spark):
    days = pd.date_range("2020-01-01", periods=120)
    pdf = pd.DataFrame({"d": days.date, "entity": "a", "v": 10 + np.sin(np.arange(120) * 2 * np.pi / 7)})
    pdf["split"] = np.where(np.arange(120) < 100, "train", "test")
    points = forecast.backtest(spark.createDataFrame(pdf), "v", 5).toPandas().sort_values("d")
    assert len(points) == 5 and (points.origin < points.d).all()
    m = forecast.backtest_metrics(spark.createDataFrame(points), ["seasonal", "previous_day", "previous_week"]).toPandas()
    mae = m[m.entity == "ALL"].set_index("model").mae
    assert mae["previous_week"] < 1e-9 < mae["previous_day"] and mae["seasonal"] < 0.05


def test_without_training_rows_nothing_is_scored(spark, task):
    """Ended in an error of the scaler when no row was left to fit."""
    bare = L.written(L.Task(task.frame.filter("split <> 'train'"), task.numeric, "y", task.categorical))
    assert L.suite_predictions(bare, {"prior": ("prior", False), "lr": ("lr", True), "rf": ("rf", False)}, ["id", "split"]).count() == 0
    ridge = L.predict(L.fit_if_rows(bare, L.regressor("ridge", 0)), bare.part("test"), bare, ["id"])
    assert ridge.count() == 0 and ridge.columns == ["id", "y", "score"]
    classes = L.ordered_probabilities(L.fit_if_rows(bare, L.classifier("lr", 0), True), bare.part("test"), bare, ["id"], ("0", "1"))
    assert classes.count() == 0 and classes.columns == ["id", "y", "p_0", "p_1", "predicted_level"]


def test_a_single_training_class_is_enough(spark, task):
    one = L.written(L.Task(task.frame.filter("split <> 'train' OR (id < 5 AND y = 0)"), task.numeric, "y", task.categorical))
    scored = L.suite_predictions(one, {"lr": ("lr", True), "rf": ("rf", False)}, ["id", "split"])
    assert scored.filter("score IS NULL").count() == 0 and scored.count() == 2 * 150


def test_medians_do_not_shuffle_the_training_rows(spark, monkeypatch):
    """Every value of every column was counted, shuffled and ranged."""
    from gearwatch.operators import ordered as O

    df = spark.range(5000).select((F.xxhash64("id") / 1e18).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id") / 7).alias("b"), F.lit(float("nan")).alias("c"))
    pdf, seen, totals = df.toPandas(), [], O.running_totals
    monkeypatch.setattr(O, "running_totals", lambda d, *a, **k: (seen.append(d.count()), totals(d, *a, **k))[1])
    got = L.exact_medians(df, ["a", "b", "c"])
    assert got == {"a": pytest.approx(pdf.a.median()), "b": pytest.approx(pdf.b.median()), "c": 0.0} and seen[0] < 100


def test_a_turned_fit_has_the_same_optimum_in_fewer_passes(spark):
    rng = np.random.default_rng(5)
    n = 600
    x = np.cumsum(rng.normal(size=n)) / 5
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "before": np.roll(x, 1), "near": x + rng.normal(scale=0.01, size=n), "same": 3.0, "c": rng.choice(["u", "v"], n)})
    pdf["change"] = pdf.x - pdf.before
    pdf["y"] = (x + rng.normal(size=n) > x.mean()).astype(int)
    pdf["split"] = np.where(pdf.id < 450, "train", "valid")
    df = spark.createDataFrame(pdf).withColumn("before", F.when(F.col("id") % 9 > 0, F.col("before")))
    task = L.written(L.Task(df, ("x", "before", "near", "same", "change"), "y", ("c",)))
    plain = L.fit(task, L.classifier("lr", 450, True, tol=1e-13, maxIter=5000), True)
    turned = L.fit(task, L.classifier("lr", 450, True, tol=1e-13, maxIter=5000), True, turned=True)
    assert turned.stages[-1].numFeatures < plain.stages[-1].numFeatures  # axes without variance
    names = L.column_names(plain, task.part("train"), task)
    assert L.column_names(turned, task.part("train"), task) == names
    a, b = (L.coefficients(m, names).toPandas().set_index("feature").coefficient for m in (plain, turned))
    assert b.to_numpy() == pytest.approx(a.to_numpy(), abs=1e-3)
    a, b = (L.predict(m, task.part("valid"), task, ["id"]).toPandas().sort_values("id").score.to_numpy() for m in (plain, turned))
    assert b == pytest.approx(a, abs=1e-4)
    # with the usual tolerance the turned fit is no worse and takes fewer passes
    plain, turned = (L.fit(task, L.classifier("lr", 450, True), True, turned=t).stages[-1].summary for t in (False, True))
    assert turned.totalIterations < plain.totalIterations
    assert turned.objectiveHistory[-1] <= plain.objectiveHistory[-1] + 1e-6


def test_suite_metrics_repeat_scores_not_rows_per_policy(spark, monkeypatch):
    rows = [("m", s, i % 2 if i % 7 else 1 - i % 2, (i % 4) / 4) for s in ("valid", "test") for i in range(80)]
    found = []
    apply = L.thresholds.apply_cutoffs
    monkeypatch.setattr(L.thresholds, "apply_cutoffs", lambda df, *a: found.append(df.count()) or apply(df, *a))
    table = L.suite_metrics(spark.createDataFrame(rows, "model string, split string, y int, score double")).toPandas()
    assert found[0] <= 2 * 4 * 2
    for r in table.itertuples():
        own = [(y, s >= r.cutoff) for _, split, y, s in rows if split == r.split]
        if r.cutoff == r.cutoff:
            assert (r.tp, r.fp, r.fn, r.tn) == tuple(sum(1 for y, p in own if (p, y) == c) for c in ((True, 1), (True, 0), (False, 1), (False, 0)))
        assert (r.rows, r.positives) == (80, sum(y for y, _ in own))
    assert len(table) == 6
