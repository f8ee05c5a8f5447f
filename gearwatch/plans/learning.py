"""Spark ML pipelines, experiment suites and what is read from them.

Fits run on Spark; every metric of a suite is computed in one grouped pass over
the long prediction table, never per model on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, PCAModel, SQLTransformer, StandardScaler, StandardScalerModel, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gearwatch.functions.expressions import SEVERITY_LEVELS, ratio
from gearwatch.operators import metrics, selection, thresholds
from gearwatch.operators.ordered import quantiles_of_rows, row_numbers
from gearwatch.operators.quality import check_features, fingerprint, require_columns
from gearwatch.session import materialize
from gearwatch.sources.writers import read_manifest, write_manifest

SEED = 42


@dataclass(frozen=True)
class Task:
    """A prepared frame with its features and target; nothing is run by making one."""

    frame: DataFrame
    numeric: tuple[str, ...]
    target: str
    categorical: tuple[str, ...] = ()
    split: str = "split"
    meta: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_features([*self.numeric, *self.categorical], self.target)
        require_columns(self.frame, [*self.numeric, *self.categorical, self.target, self.split])

    def part(self, name: str) -> DataFrame:
        return self.frame.filter(F.col(self.split) == name)


def written(task: Task) -> Task:
    """The task on a written copy of its frame: a fit passes over it many times."""
    if task.meta.get("written"):
        return task
    return replace(task, frame=materialize(task.frame), meta={**task.meta, "written": True})


def balanced_weight(train: DataFrame, target: str) -> Column:
    """n / (classes x class rows) as a CASE over a scalar map of class counts (one entry per class)."""
    counts = train.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.col(target).cast("string"), "n")))).scalar()
    total = train.agg(F.count(F.lit(1))).scalar()
    size = F.element_at(table, F.col(target).cast("string"))
    return ratio(total, F.size(table) * size)


def exact_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median of the known values of each column, all columns together; 0 for a column without any.

    ``train`` is read three times and should be written; its values are counted by bins and only those next to a median are ordered.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    known = train.select(F.inline(cells)).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    found = {r["column"]: r["median"] for r in quantiles_of_rows(known, ["column"], "value", {"median": 0.5}).collect()}  # a row per column
    return {c: float(found.get(c, 0.0)) for c in columns}


def fills_of(task: Task) -> dict[str, float]:
    """Medians of the task's training rows; ``meta`` may bring them along where several tasks share their rows."""
    known = task.meta.get("medians")
    return known if known is not None else exact_medians(task.part("train"), task.numeric)


def preprocessing(task: Task) -> list:
    """Median fill with missing indicators, scaling, one-hot of known categories; fitted on train only."""
    stages, inputs = [], []
    filled = [f"{c}__fill" for c in task.numeric]
    if task.numeric:
        medians = fills_of(task)
        fills = ", ".join(f"coalesce(nanvl(`{c}`, NULL), CAST('{medians[c]!r}' AS DOUBLE)) AS `{f}`" for c, f in zip(task.numeric, filled))
        stages.append(SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"))
        stages.append(VectorAssembler(inputCols=[*filled, *[f"{c}__missing" for c in task.numeric]], outputCol="numeric__vec"))
        stages.append(StandardScaler(inputCol="numeric__vec", outputCol="numeric__scaled", withMean=True, withStd=True))
        inputs.append("numeric__scaled")
    for c in task.categorical:
        stages.append(StringIndexer(inputCol=f"{c}__text", outputCol=f"{c}__idx", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__hot", dropLast=True))
        inputs.append(f"{c}__hot")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def ready(df: DataFrame, task: Task) -> DataFrame:
    """Numeric columns as doubles, their missing indicators and text categories (NULL is a category)."""
    cols: dict[str, Column] = {}
    for c in task.numeric:
        cols[c] = F.col(c).cast("double")
        cols[f"{c}__missing"] = F.col(c).isNull().cast("double")
    for c in task.categorical:
        cols[f"{c}__text"] = F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return df.withColumns({**cols, "label": F.col(task.target).cast("double")})


# Work of the estimators unless a caller sets it otherwise.
LR_ITERATIONS, TREES, TREE_DEPTH, BOOSTING_ROUNDS, BOOSTING_DEPTH, LEARNING_RATE = 1000, 100, 30, 100, 5, 0.1


def classifier(name: str, rows: int, weighted: bool = False, **options):
    """``lr``: L2 strength 1/(C n) with C = 1 on the columns as they are; ``rf`` and ``gbt``: tree ensembles.

    ``options`` go to the estimator and override the fixed values.
    """
    weight = {"weightCol": "weight"} if weighted else {}
    if name == "lr":
        return LogisticRegression(**{"regParam": 1.0 / max(rows, 1), "elasticNetParam": 0.0, "maxIter": LR_ITERATIONS, "standardization": False, **weight, **options})
    if name == "rf":
        return RandomForestClassifier(**{"numTrees": TREES, "maxDepth": TREE_DEPTH, "seed": SEED, **weight, **options})
    if name == "gbt":
        return GBTClassifier(**{"maxIter": BOOSTING_ROUNDS, "maxDepth": BOOSTING_DEPTH, "stepSize": LEARNING_RATE, "seed": SEED, **weight, **options})
    raise ValueError(f"unknown classifier: {name}")


def regressor(name: str, rows: int, **options):
    if name == "ridge":
        return LinearRegression(**{"regParam": 1.0 / max(rows, 1), "elasticNetParam": 0.0, "standardization": False, **options})
    if name == "rf":
        return RandomForestRegressor(**{"numTrees": TREES, "maxDepth": TREE_DEPTH, "seed": SEED, **options})
    if name == "gbt":
        return GBTRegressor(**{"maxIter": BOOSTING_ROUNDS, "maxDepth": BOOSTING_DEPTH, "stepSize": LEARNING_RATE, "seed": SEED, **options})
    raise ValueError(f"unknown regressor: {name}")


FLAT = 1e-12  # share of the variance below which an axis holds rounding only


def _fit_turned(stages: list, estimator, train: DataFrame) -> PipelineModel:
    """The estimator on the principal axes of the features, for models with an L2 penalty on columns as they are.

    A turn keeps the penalty, so the optimum is that of the features themselves; the estimator scales its columns while it
    iterates, and columns that do not move together need far fewer passes. Axes without variance have no part in the optimum.
    """
    before = Pipeline(stages=stages).fit(train)
    rows = before.transform(train)
    axes = PCA(k=rows.select("features").first()[0].size, inputCol="features", outputCol="features__turned").fit(rows)
    vary = [i for i, share in enumerate(axes.explainedVariance.toArray()) if share > FLAT] or [0]
    cut = VectorSlicer(inputCol="features__turned", outputCol="features__axes", indices=vary)
    model = estimator.setFeaturesCol("features__axes").fit(cut.transform(axes.transform(rows)))
    return PipelineModel([*before.stages, axes, cut, model])


def fit(task: Task, estimator, weighted: bool = False, by_class: bool = False, turned: bool = False) -> PipelineModel:
    """The fitted pipeline; ``turned`` fits a linear model on principal axes, with the same optimum in fewer passes."""
    task = written(task)
    train = ready(task.part("train"), task)
    if weighted:
        train = train.withColumn("weight", balanced_weight(task.part("train"), task.target))
    if turned:
        return _fit_turned(preprocessing(task), estimator, train)
    if by_class:
        estimator = OneVsRest(classifier=estimator)
    return Pipeline(stages=[*preprocessing(task), estimator]).fit(train)


def fit_if_rows(task: Task, estimator, weighted: bool = False) -> PipelineModel | None:
    """``fit``, or None where the training part has no row: there is nothing to learn from and so no model."""
    task = written(task)
    return None if task.part("train").isEmpty() else fit(task, estimator, weighted)


def predict(model: PipelineModel | None, df: DataFrame, task: Task, keep: Sequence[str]) -> DataFrame:
    """Score (probability of 1, or the regression value) next to the kept columns; no row without a model."""
    if model is None:
        return df.filter(F.lit(False)).select(*keep, F.col(task.target).alias("y"), F.lit(None).cast("double").alias("score"))
    out = model.transform(ready(df, task))
    # A tree that saw no row of class 1 has a probability for class 0 only.
    score = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)) if "probability" in out.columns else F.col("prediction")
    return out.select(*keep, F.col(task.target).alias("y"), score.alias("score"))


def ordered_probabilities(model: PipelineModel | None, df: DataFrame, task: Task, keep: Sequence[str], classes: Sequence = SEVERITY_LEVELS) -> DataFrame:
    """Probability of every class in a fixed order; classes absent from training get 0. No row without a model."""
    if model is None:
        none = [F.lit(None).cast("double").alias(f"p_{c}") for c in classes]
        return df.filter(F.lit(False)).select(*keep, F.col(task.target).alias("y"), *none, F.lit(None).cast("string").alias("predicted_level"))
    out = model.transform(ready(df, task))
    p = vector_to_array("probability")
    cells = [
        F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias(f"p_{c}") for i, c in enumerate(classes)
    ]
    level = F.array(*[F.lit(str(c)) for c in classes])
    return out.select(*keep, F.col(task.target).alias("y"), *cells, F.get(level, F.col("prediction").cast("int")).alias("predicted_level"))


def suite_predictions(task: Task, models: Mapping[str, tuple], keep: Sequence[str], parts: Sequence[str] = ("valid", "test")) -> DataFrame:
    """Fit every model on train and stack the predictions of the other parts with a model column.

    A model maps to (classifier, balanced) or (classifier, balanced, options); ``prior`` is the constant training rate.
    Without training rows no model scores anything.
    """
    task = written(task)
    rows = task.part("train").count()
    held = task.frame.filter(F.col(task.split).isin(*parts))
    out = None
    for name, (kind, weighted, *options) in models.items():
        if not rows:
            scored = predict(None, held, task, keep)
        elif kind == "prior":
            rate = task.part("train").agg(F.avg(F.col(task.target).cast("double"))).scalar()
            scored = held.select(*keep, F.col(task.target).alias("y"), rate.alias("score"))
        else:
            scored = predict(fit(task, classifier(kind, rows, weighted, **dict(*options)), weighted), held, task, keep)
        scored = scored.withColumn("model", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return materialize(out)


def suite_metrics(predictions: DataFrame, split: str = "split", min_precision: float = 0.3) -> DataFrame:
    """Cutoffs chosen on validation per policy, applied to both parts, ranking quality alongside; all from the rows counted by score."""
    counts = materialize(metrics.score_counts(predictions, ["model", split]))
    cuts = materialize(
        thresholds.choose_cutoffs(counts.filter(F.col(split) == "valid"), ["model"], (min_precision,), (0.1,), weight="weight")
    )
    applied = thresholds.apply_cutoffs(counts, cuts, ["model"])
    key = ["model", split, "policy"]
    rates = metrics.confusion(applied, key, weight="weight")
    quality = metrics.ranking_quality(counts, ["model", split], weight="weight").drop("rows", "positives")
    return rates.join(cuts, ["model", "policy"]).join(quality, ["model", split])


def comparison(task: Task, models: Mapping[str, tuple[str, bool]], keep: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Metric rows of all models, the one with the best validation AP flagged as selected."""
    predictions = suite_predictions(task, models, keep)
    table = materialize(suite_metrics(predictions, task.split))
    valid = table.filter((F.col(task.split) == "valid") & (F.col("policy") == "f1") & (F.col("model") != "prior"))
    best = selection.best_row(
        valid.withColumn("_k", F.lit(1)), ["_k"],
        [F.col("average_precision").desc_nulls_last(), F.array_position(F.array(*[F.lit(o) for o in order]), F.col("model"))],
    )
    chosen = best.select(F.max("model")).scalar()
    return table.withColumn("_c", chosen).withColumn("selected_model", F.col("model") == F.col("_c")).drop("_c")


def column_names(model: PipelineModel, df: DataFrame, task: Task) -> list[str]:
    """Name of every model column, from the attributes of the feature vector."""
    attrs = model.transform(ready(df, task).limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    named = {a["idx"]: a.get("name", f"column_{a['idx']}") for kind in attrs.values() for a in kind}
    scaled = [*task.numeric, *[f"{c}__missing" for c in task.numeric]]  # the scaler keeps the order but not the names
    tidy = lambda i, name: scaled[i] if i < len(scaled) and name.startswith("numeric__scaled") else name.replace("__hot_", "=")
    return [tidy(i, named[i]) for i in sorted(named)]


def coefficients(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Coefficient table of a linear model (one row per model column; see ``column_names``)."""
    values = model.stages[-1].coefficients.toArray()
    for axes, cut in zip(model.stages, model.stages[1:]):
        if isinstance(axes, PCAModel):  # turned back
            values = axes.pc.toArray()[:, cut.getIndices()] @ values
    return _by_column("coefficient", values, names)


def importances(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Importance table of a tree model."""
    return _by_column("importance", model.stages[-1].featureImportances.toArray(), names)


def _by_column(value: str, values, names: Sequence[str]) -> DataFrame:
    if len(names) != len(values):
        raise ValueError(f"{len(names)} names for {len(values)} model columns")
    return SparkSession.getActiveSession().createDataFrame([(n, float(v)) for n, v in zip(names, values)], f"feature string, {value} double")


def permutation_importance(model: PipelineModel, task: Task, part: str, ids: Sequence[str], features: Sequence[str], repeats: int = 3) -> DataFrame:
    """Drop in average precision when a feature is shuffled among the rows.

    The shuffle pairs two random orders of the rows by position (running counts
    by ranges), so no task ever sees the whole column.
    """
    rows = materialize(ready(task.part(part), task))
    keyed = rows.withColumn("_key", F.xxhash64(*ids))
    pieces = []
    for r in range(repeats):
        a = row_numbers(keyed.select(*ids, "_key"), [], [("_key", True), *[(i, True) for i in ids]], "_pos")
        b = row_numbers(
            keyed.select(*[F.col(i).alias(f"_o_{i}") for i in ids], F.xxhash64("_key", F.lit(SEED + r)).alias("_mix"), *[F.col(f).alias(f"_s_{f}") for f in features],
                         *[F.col(f"{f}__missing").alias(f"_m_{f}") for f in features]),
            [], [("_mix", True), *[(f"_o_{i}", True) for i in ids]], "_pos",
        )
        pieces.append(a.select(*ids, "_pos").join(b.drop("_pos_of", "_mix", *[f"_o_{i}" for i in ids]), "_pos").drop("_pos").withColumn("_r", F.lit(r)))
    mixed = pieces[0]
    for p in pieces[1:]:
        mixed = mixed.unionByName(p)
    both = materialize(rows.join(mixed, list(ids)))
    stacked = [rows.withColumns({"feature": F.lit("none"), "_r": F.lit(0)})]
    for f in features:
        swapped = both.withColumns({f: F.col(f"_s_{f}"), f"{f}__missing": F.col(f"_m_{f}")})
        stacked.append(swapped.select(*rows.columns, F.lit(f).alias("feature"), "_r"))
    long = stacked[0]
    for s in stacked[1:]:
        long = long.unionByName(s)
    scored = model.transform(long).select(
        "feature", "_r", F.col(task.target).alias("y"), F.round(vector_to_array("probability")[1], 12).alias("score")
    )
    ap = materialize(metrics.ranking_quality(scored, ["feature", "_r"]).select("feature", "_r", "average_precision"))
    base = ap.filter("feature = 'none'").select(F.max("average_precision")).scalar()
    drops = ap.filter("feature <> 'none'").withColumn("_b", base).withColumn("drop", F.col("_b") - F.col("average_precision"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"), F.coalesce(F.stddev_pop("drop"), F.lit(0.0)).alias("importance_std"))


def preprocessing_table(model: PipelineModel, task: Task) -> DataFrame:
    """What the preprocessing learnt: per numeric column (and missing indicator) fill, mean and deviation; per category its levels."""
    medians = fills_of(task)
    rows, names = [], [*task.numeric, *[f"{c}__missing" for c in task.numeric]]
    for stage in model.stages:
        if isinstance(stage, StandardScalerModel):
            rows += [(n, medians.get(n), float(m), float(s), None, None) for n, m, s in zip(names, stage.mean.toArray(), stage.std.toArray())]
        elif isinstance(stage, StringIndexerModel):
            column = stage.getInputCol().removesuffix("__text")
            rows += [(column, None, None, None, level, i) for i, level in enumerate(stage.labels)]
    return SparkSession.getActiveSession().createDataFrame(rows, "column string, fill double, mean double, deviation double, level string, place int")


def save_and_verify(model: PipelineModel, path: str, sample: DataFrame, ids: Sequence[str]) -> PipelineModel:
    """Save, reload and compare the predictions of both models row by row; ``ids`` identify a row of ``sample``."""
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    left = model.transform(sample).select(*ids, F.col("prediction").alias("_a"))
    right = again.transform(sample).select(*ids, F.col("prediction").alias("_b"))
    apart = left.join(right, list(ids), "full").filter(~F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= 1e-9, F.lit(False)))
    if not apart.isEmpty():
        raise ValueError("the reloaded model predicts differently")
    return again


# --- experiments that are validated, frozen and tested once


def _settings(task: Task, feature_sets: Mapping[str, Sequence[str]], k: int) -> dict:
    return {"features": {n: list(c) for n, c in feature_sets.items()}, "categorical": list(task.categorical), "target": task.target, "k": k}


def _fingerprint(frame: DataFrame) -> dict:
    """Rows and an order-free fingerprint of a prepared frame, as text."""
    return {k: str(v) for k, v in fingerprint(frame).first().asDict().items()}


def validate_once(task: Task, feature_sets: Mapping[str, Sequence[str]], ids: Sequence[str], folder: str, k: int) -> DataFrame:
    """Fit each feature set on train, write the models and a manifest, and return the validation scores.

    The manifest holds k, the feature lists and a fingerprint of the frame; it is written before anything is scored.
    A folder is used once. Nothing of the test part is read but its rows' fingerprint.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = task.frame.sparkSession
    if _written(spark, f"{folder}/manifest"):
        raise ValueError(f"{folder} holds an experiment already")
    task = written(task)
    if task.part("train").select(task.target).distinct().count() != 2:
        raise ValueError("the train part needs both classes")
    write_manifest(spark, f"{folder}/manifest", {**_settings(task, feature_sets, k), "data": _fingerprint(task.frame)})
    rows = task.part("train").count()
    out = None
    for name, columns in feature_sets.items():
        own = replace(task, numeric=tuple(columns))
        model = fit(own, classifier("lr", rows))
        path = f"{folder}/models/{name}"
        model = save_and_verify(model, path, ready(own.part("valid"), own), ids)
        scored = predict(model, own.part("valid"), own, ids).withColumn("experiment", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    write_manifest(spark, f"{folder}/model_prints", {n: _model_print(spark, f"{folder}/models/{n}") for n in feature_sets})
    out.write.parquet(f"{folder}/validation")
    return spark.read.parquet(f"{folder}/validation")


def _model_print(spark: SparkSession, path: str) -> str:
    """An order-free fingerprint of a stored model's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    row = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("content"))).first()
    return f"{row[0]}:{row[1]}"


def test_once(task: Task, feature_sets: Mapping[str, Sequence[str]], ids: Sequence[str], folder: str, k: int | None = None) -> DataFrame:
    """Score the test part with the stored models, once, and only if data, k and feature lists are those of validation."""
    spark = task.frame.sparkSession
    if not _written(spark, f"{folder}/validation"):
        raise ValueError("nothing has been validated here")
    if _written(spark, f"{folder}/test"):
        raise ValueError("this experiment has been tested already")
    manifest = read_manifest(spark, f"{folder}/manifest")
    if k is not None and k != manifest["k"]:
        raise ValueError(f"k was {manifest['k']} in validation")
    if _settings(task, feature_sets, manifest["k"]) != {n: manifest[n] for n in ("features", "categorical", "target", "k")}:
        raise ValueError("feature lists or target changed since validation")
    task = written(task)
    if _fingerprint(task.frame) != manifest["data"]:
        raise ValueError("the data changed since validation")
    if {n: _model_print(spark, f"{folder}/models/{n}") for n in feature_sets} != read_manifest(spark, f"{folder}/model_prints"):
        raise ValueError("a stored model changed since validation")
    out = None
    for name, columns in feature_sets.items():
        own = replace(task, numeric=tuple(columns))
        model = PipelineModel.load(f"{folder}/models/{name}")
        scored = predict(model, own.part("test"), own, ids).withColumn("experiment", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    out.write.parquet(f"{folder}/test")
    return spark.read.parquet(f"{folder}/test")


test_once.__test__ = False  # not a test of pytest's


def _written(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path) if path.endswith("manifest") else spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False
    return True
