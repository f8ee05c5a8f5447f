"""Experiment suites: targets x scopes x feature sets x models, judged from stored predictions.

A suite runs in four steps. A plan comes from one grouped pass over the frame: rows and positives of every
scope and part, the targets that repeat another one, and from these a status and reason per scope before
anything is fitted. Fits of the runnable cells run side by side from a bounded pool of driver threads, each in
a scheduler pool of its own, over one written frame. Their predictions are written, and
every metric of the suite then comes from grouped passes over that one table, whatever the number of fits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearwatch.functions.expressions import ratio
from gearwatch.operators import baselines, metrics, selection, thresholds
from gearwatch.operators.joins import scope_rows
from gearwatch.plans import learning as L
from gearwatch.session import checkpoint_dir, materialize

PARTS = ("train", "valid", "test")
SCOPES = {"overall": None, "machine_type": "etype", "asset_tag": "entity"}
# Candidates in the order in which ties are settled, and the fewest positives of a family model.
BASELINE, CANDIDATES, MIN_POSITIVES = "prior", ("lr", "rf", "gbt"), 10
MOST_FITS = 2000  # of one suite; each is a Spark ML job started by the driver
POOL = 4  # fits at a time

RANKS = tuple(f"{m}_at_{p}pct" for p in (5, 10, 20) for m in ("precision", "recall", "lift"))
METRIC_COLUMNS = (
    "target", "scope_kind", "scope_name", "feature_set", "model", "selected_model", "selected_feature_set", "split", "status", "reason",
    "policy", "cutoff", *[f"{p}_rows" for p in PARTS], *[f"{p}_positive_rate" for p in PARTS],
    "accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "tn", "fp", "fn", "tp", *RANKS,
)
PREDICTION_COLUMNS = ("target", "scope_kind", "scope_name", "feature_set", "model", "split", "policy", "cutoff", "y", "score", "predicted")
IMPORTANCE_COLUMNS = ("target", "scope_kind", "scope_name", "feature_set", "model", "feature", "importance", "importance_std")
CELL = ["target", "scope_kind", "scope_name"]


# --- scopes and plan


def chosen_scopes(scope: str = "all", machine_type: str | None = None, asset_tag: str | None = None, scopes: Mapping[str, str | None] = SCOPES) -> dict[str, str | None]:
    """The kinds of scope to run: one of them or ``all``; with a single asset its type is no scope."""
    if scope not in ("all", *scopes):
        raise ValueError(f"scope must be all or one of {sorted(scopes)}")
    return {k: c for k, c in scopes.items() if scope in ("all", k) and not (k == "machine_type" and asset_tag is not None)}


def filtered(frame: DataFrame, machine_type: str | None = None, asset_tag: str | None = None, scopes: Mapping[str, str | None] = SCOPES) -> DataFrame:
    """Rows of one type or asset; an error if there are none."""
    out = frame
    for kind, value in (("machine_type", machine_type), ("asset_tag", asset_tag)):
        if value is not None:
            out = out.filter(F.col(scopes[kind]).cast("string") == str(value))
    if (machine_type is not None or asset_tag is not None) and out.isEmpty():
        raise ValueError("no rows of the asked machine_type or asset_tag")
    return out


def scope_counts(frame: DataFrame, targets: Sequence[str], scopes: Mapping[str, str | None] = SCOPES, split: str = "split") -> DataFrame:
    """target, scope, and rows, positives and classes of each part; rows without a label do not count.

    Rows are counted by the scopes' columns first, so they are not repeated per scope.
    """
    columns = [c for c in scopes.values() if c is not None]
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("_y")) for t in targets])
    fine = frame.select(*columns, F.col(split).alias("_split"), F.inline(cells)).filter(F.col("_y").isNotNull()).groupBy(*columns, "_split", "target", "_y").agg(F.count(F.lit(1)).alias("_n"))
    at = lambda p: F.col("_split") == p
    aggs = []
    for p in PARTS:
        aggs += [
            F.coalesce(F.sum(F.when(at(p), F.col("_n"))), F.lit(0)).alias(f"{p}_rows"),
            F.coalesce(F.sum(F.when(at(p) & (F.col("_y") == 1), F.col("_n"))), F.lit(0)).alias(f"{p}_positives"),
            F.countDistinct(F.when(at(p), F.col("_y"))).alias(f"{p}_classes"),
        ]
    return scope_rows(fine, scopes).filter(F.col("scope_name").isNotNull()).groupBy(*CELL).agg(*aggs)


def skip_reason(min_positives: int = 0) -> Column:
    """Why a cell of ``scope_counts`` cannot be fitted; empty if it can.

    Without ``min_positives`` every part needs both classes; with it train and valid need both and that many
    positives, and the test part a row.
    """
    found = []
    for p in PARTS:
        empty, single = F.col(f"{p}_rows") == 0, F.col(f"{p}_classes") < 2
        issue = F.when(empty, F.lit(f"empty {p} split"))
        if not min_positives or p != "test":
            issue = issue.when(single, F.lit(f"single {p} class"))
        if min_positives and p != "test":
            issue = issue.when(F.col(f"{p}_positives") < min_positives, F.concat(F.lit(f"{p} positives "), F.col(f"{p}_positives"), F.lit(f" below {min_positives}")))
        found.append(issue)
    return F.array_join(F.array_compact(F.array(*found)), "; ")


def identical_targets(frame: DataFrame, targets: Sequence[str], ids: Sequence[str], scopes: Mapping[str, str | None]) -> DataFrame:
    """target, scope, ``same_as``: the first other target (in the given order) with the same label in every row of the scope.

    All targets are fingerprinted in one aggregate that does not depend on the order of rows; pairs of equal fingerprints
    are confirmed by comparing the labels themselves, and only those pairs are looked at again.
    """
    columns = [c for c in scopes.values() if c is not None]
    mark = lambda t: F.xxhash64(*ids, F.coalesce(F.col(t).cast("int"), F.lit(-1)))
    prints = F.array(*[F.struct(F.lit(i).alias("_i"), mark(t).alias("_h")) for i, t in enumerate(targets)])
    fine = frame.select(*columns, F.inline(prints)).groupBy(*columns, "_i").agg(
        F.bit_xor("_h").alias("_x"), F.sum(F.col("_h") % F.lit(1_000_000_007)).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    whole = scope_rows(fine, scopes).groupBy("scope_kind", "scope_name", "_i").agg(F.bit_xor("_x").alias("_x"), F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    # one row per scope and target
    pairs = whole.groupBy("scope_kind", "scope_name", "_x", "_s", "_n").agg(F.array_sort(F.collect_set("_i")).alias("_all")).filter(F.size("_all") > 1)
    first = F.col("_all")[0]
    likely = {(r["a"], r["b"]) for r in pairs.select(first.alias("a"), F.explode(F.slice("_all", 2, len(targets))).alias("b")).distinct().collect()}
    if not likely:
        return frame.sparkSession.createDataFrame([], "target string, scope_kind string, scope_name string, same_as string")
    tests = F.array(
        *[
            F.struct(F.lit(targets[b]).alias("target"), F.lit(targets[a]).alias("same_as"), (~F.col(targets[a]).eqNullSafe(F.col(targets[b]))).cast("int").alias("_apart"))
            for a, b in sorted(likely)
        ]
    )
    exact = frame.select(*columns, F.inline(tests)).groupBy(*columns, "target", "same_as").agg(F.max("_apart").alias("_apart"))
    agreed = scope_rows(exact, scopes).groupBy(*CELL, "same_as").agg(F.max("_apart").alias("_apart")).filter("_apart = 0")
    number = F.array_position(F.array(*[F.lit(t) for t in targets]), F.col("same_as"))
    return agreed.groupBy(*CELL).agg(F.min_by("same_as", number).alias("same_as"))


def plan(
    frame: DataFrame, targets: Sequence[str], ids: Sequence[str], scopes: Mapping[str, str | None] = SCOPES, min_positives: int = 0, reuse: bool = True, split: str = "split"
) -> DataFrame:
    """A row per target and scope: status (``ok``, ``skipped``, ``identical_target``), reason, same_as, counts of the parts.

    A target that repeats a skipped one is skipped as well.
    """
    counts = scope_counts(frame, targets, scopes, split).withColumn("reason", skip_reason(min_positives))
    if reuse and len(targets) > 1:
        counts = counts.join(identical_targets(frame, targets, ids, scopes), CELL, "left")
    else:
        counts = counts.withColumn("same_as", F.lit(None).cast("string"))
    skipped = F.col("reason") != ""
    status = F.when(skipped, "skipped").when(F.col("same_as").isNotNull(), "identical_target").otherwise("ok")
    reason = F.when(skipped, F.col("reason")).when(F.col("same_as").isNotNull(), F.concat(F.lit("same labels as "), F.col("same_as"))).otherwise("")
    return counts.select(*CELL, status.alias("status"), reason.alias("reason"), F.when(~skipped, F.col("same_as")).alias("same_as"), *[f"{p}_{x}" for p in PARTS for x in ("rows", "positives")])


# --- fits


@dataclass(frozen=True)
class Model:
    """``kind``: lr, rf, gbt, ``prior`` (train rate of the scope) or ``rate`` (train rate by ``keys`` in the scope).

    ``turned``: lr is fitted on the principal axes of its features.
    """

    kind: str
    weighted: bool = False
    options: Mapping[str, object] | None = None
    keys: tuple[str, ...] = ()
    turned: bool = False

    @property
    def grouped(self) -> bool:
        return self.kind in ("prior", "rate")


def in_pools(spark, jobs: Sequence[Callable[[], object]], pool: int = POOL) -> list:
    """Run jobs side by side, each thread in its own scheduler pool; the first error is raised when all have ended."""

    def run(number: int, job: Callable[[], object]) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"suite-{number % pool}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(pool) as threads:
        waiting = [threads.submit(inheritable_thread_target(spark)(partial(run, i, job))) for i, job in enumerate(jobs)]
        return [w.result() for w in waiting]


def _rate_scores(frame: DataFrame, cells: DataFrame, target: str, name: str, keys: Sequence[str], scopes: Mapping[str, str | None], split: str, keep: Sequence[str]) -> DataFrame:
    """Train rates of all runnable scopes in one grouped pass; a key unseen in training gets its scope's rate."""
    where = ["scope_kind", "scope_name"]
    rows = scope_rows(frame.filter(F.col(target).isNotNull()), scopes).join(cells.filter(F.col("target") == target).select(*where), where)
    train = rows.filter(F.col(split) == "train")
    held = rows.filter(F.col(split) != "train")
    y = F.col(target).cast("double")
    whole = train.groupBy(*where).agg(F.avg(y).alias("_whole"))
    scored = held.join(whole, where)
    if keys:
        table = baselines.group_rate_table(train, [*where, *keys], target).withColumnRenamed("rate", "_own").drop("rows")
        scored = scored.join(table, [*where, *keys], "left").withColumn("_score", F.coalesce("_own", "_whole"))
    else:
        scored = scored.withColumn("_score", F.col("_whole"))
    return scored.select(
        F.lit(target).alias("target"), *where, F.lit("none").alias("feature_set"), F.lit(name).alias("model"), F.col(split).alias("split"), *keep,
        F.col(target).cast("int").alias("y"), F.round("_score", 6).alias("score"),
    )


@dataclass(frozen=True)
class Suite:
    """What is tried: numeric columns by feature set, categories, models by name, and what names a row."""

    feature_sets: Mapping[str, Sequence[str]]
    categorical: Sequence[str]
    models: Mapping[str, Model]
    ids: Sequence[str]
    keep: Sequence[str] = ()
    scopes: Mapping[str, str | None] = None
    min_positives: int = 0
    reuse: bool = True
    split: str = "split"

    @property
    def kinds(self) -> Mapping[str, str | None]:
        return self.scopes or SCOPES

    @property
    def kept(self) -> list[str]:
        """Columns that name a row or a scope, each once."""
        return list(dict.fromkeys([*self.ids, *[c for c in self.kinds.values() if c], *self.keep]))


def fit_all(frame: DataFrame, planned: DataFrame, suite: Suite) -> tuple[DataFrame, dict[tuple, object]]:
    """Predictions of every runnable cell on valid and test rows; and the fitted models by (target, scope, feature set, model)."""
    spark = frame.sparkSession
    cells = planned.filter("status = 'ok'").select(*CELL)
    table = [tuple(r) for r in cells.limit(MOST_FITS + 1).collect()]
    trained = {n: m for n, m in suite.models.items() if not m.grouped}
    if len(table) * len(trained) * len(suite.feature_sets) > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} fits; narrow the scopes")
    fitted: dict[tuple, object] = {}
    parts = []
    train = frame.filter(F.col(suite.split) == "train")
    sizes, labelled = {}, {}
    if trained:  # a row per scope; suites without fits may have a scope per asset, and theirs stay where they are
        sizes = {(r["scope_kind"], r["scope_name"]): r["n"] for r in scope_rows(train, suite.kinds).groupBy("scope_kind", "scope_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        labelled = {tuple(r)[:3]: r["train_rows"] for r in planned.filter("status = 'ok'").select(*CELL, "train_rows").collect()}

    def scope_train(kind: str, scope: str) -> DataFrame:
        column = suite.kinds[kind]
        return train if column is None else train.filter(F.col(column).cast("string") == scope)

    # Targets that label every training row of a scope share its medians.
    shared = sorted({(k, s, f) for t, k, s in table for f in suite.feature_sets if labelled[t, k, s] == sizes[k, s]}) if trained else []
    found = in_pools(spark, [lambda k=k, s=s, f=f: L.exact_medians(scope_train(k, s), list(suite.feature_sets[f])) for k, s, f in shared])
    medians = dict(zip(shared, found))
    targets = [r[0] for r in cells.select("target").distinct().collect()]  # of all cells, not of those listed above
    for name, model in suite.models.items():
        if model.grouped:
            parts += [_rate_scores(frame, cells, t, name, model.keys, suite.kinds, suite.split, suite.kept) for t in targets]

    def job(target: str, kind: str, scope: str, fset: str, name: str, model: Model) -> DataFrame:
        column = suite.kinds[kind]
        own = frame.filter(F.col(target).isNotNull())
        own = own if column is None else own.filter(F.col(column).cast("string") == scope)
        numeric = tuple(suite.feature_sets[fset])
        task = L.Task(own.withColumn("_target", F.col(target).cast("int")), numeric, "_target", tuple(suite.categorical), suite.split, {"written": True, "medians": medians.get((kind, scope, fset)) if labelled[target, kind, scope] == sizes[kind, scope] else None})
        rows = task.part("train").count()
        made = L.fit(task, L.classifier(model.kind, rows, model.weighted, **(model.options or {})), model.weighted, turned=model.turned)
        fitted[target, kind, scope, fset, name] = (made, task)
        held = own.filter(F.col(suite.split) != "train").withColumn("_target", F.col(target).cast("int"))
        scored = L.predict(made, held, replace(task, frame=held), [suite.split, *suite.kept])
        marks = {"target": target, "scope_kind": kind, "scope_name": scope, "feature_set": fset, "model": name}
        return materialize(scored.select(*[F.lit(v).alias(k) for k, v in marks.items()], F.col(suite.split).alias("split"), *suite.kept, F.col("y").cast("int").alias("y"), "score"))

    jobs = [partial(job, t, k, s, f, n, m) for t, k, s in table for f in suite.feature_sets for n, m in trained.items()]
    parts += in_pools(spark, jobs)
    if not parts:
        kept = [f for f in frame.select(*suite.kept).schema.fields]
        ddl = ", ".join(["target string, scope_kind string, scope_name string, feature_set string, model string, split string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "y int, score double"])
        return spark.createDataFrame([], ddl), fitted
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out), fitted


def with_reused(table: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows of a target's table again for each target that repeats its labels."""
    again = planned.filter("status = 'identical_target'").select(F.col("target").alias("_new"), "scope_kind", "scope_name", F.col("same_as").alias("target"))
    copies = table.join(again, CELL).withColumn("target", F.col("_new")).select(*table.columns)
    return table.unionByName(copies)


# --- tables


def select_models(quality: DataFrame, candidates: Sequence[str], feature_sets: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """target, scope, feature_set, model, selected_feature_set: the best candidate of each feature set by validation AP, and the best set.

    Ties (and, with a tolerance, what comes within it) go to F1, recall and precision, then to the declared order.
    """
    valid = quality.filter((F.col("split") == "valid") & F.col("model").isin(list(candidates)))
    best = selection.select_by_ap(valid, [*CELL, "feature_set"], "model", list(candidates), tolerance)
    sets = selection.select_by_ap(best, CELL, "feature_set", list(feature_sets), tolerance).select(*CELL, F.col("feature_set").alias("_best"))
    return best.join(sets, CELL).select(*CELL, "feature_set", "model", (F.col("feature_set") == F.col("_best")).alias("selected_feature_set"))


def tables(
    predictions: DataFrame, planned: DataFrame, suite: Suite, min_precisions: Sequence[float] = (0.3,), top_fractions: Sequence[float] = (0.1,), tolerance: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Metric rows (also of skipped cells) and the selected models' test predictions, in their pinned columns.

    Cutoffs are chosen on the validation part and applied to both parts; all groups in one pass each. Cutoffs, confusions
    and ranking figures come from the rows counted by score, and only the selected models' rows are repeated per policy.
    """
    key = [*CELL, "feature_set", "model"]
    counts = materialize(metrics.score_counts(predictions, [*key, "split"]))
    cuts = materialize(thresholds.choose_cutoffs(counts.filter("split = 'valid'"), key, min_precisions, top_fractions, weight="weight").withColumnRenamed("status", "_cut_status"))
    rates = metrics.confusion(thresholds.apply_cutoffs(counts, cuts, key), [*key, "split", "policy"], weight="weight")
    top = metrics.rank_at_percent(predictions, [*key, "split"], list(suite.ids))
    ranks = top.groupBy(*key, "split").agg(
        *[F.max(F.when(F.col("percent") == p, F.col(m))).alias(f"{m}_at_{p}pct") for p in (5, 10, 20) for m in ("precision", "recall", "lift")]
    )
    ranking = materialize(metrics.ranking_quality(counts, [*key, "split"], weight="weight").select(*key, "split", "average_precision", "roc_auc"))
    f1 = rates.filter("policy = 'f1'").select(*key, "split", "f1", "recall", "precision")
    candidates = [n for n, m in suite.models.items() if n != BASELINE]
    sets = [*suite.feature_sets, "none"]
    chosen = materialize(select_models(ranking.join(f1, [*key, "split"]), candidates, sets, tolerance))
    parts = planned.drop("status", "reason", "same_as")
    picked = chosen.withColumn("selected_model", F.lit(True))
    rows = (
        rates.drop("rows", "positives").join(cuts, [*key, "policy"]).join(ranking, [*key, "split"]).join(ranks, [*key, "split"])
        .join(parts, CELL).join(picked, key, "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("selected_model", "selected_feature_set")})
        .withColumns({"status": F.col("_cut_status"), "reason": F.lit("")})
    )
    reused = planned.filter("status = 'identical_target'").select(*CELL, F.col("reason").alias("_why"))
    done = with_reused(rows, planned).join(reused, CELL, "left").withColumns(
        {"status": F.when(F.col("_why").isNotNull(), "identical_target").otherwise(F.col("status")), "reason": F.coalesce("_why", "reason")}
    )
    none = planned.filter("status = 'skipped'").withColumns(
        {"feature_set": F.lit("none"), "model": F.lit("none"), "selected_model": F.lit(False), "selected_feature_set": F.lit(False), "split": F.lit("test")}
    )
    both = done.unionByName(none, allowMissingColumns=True)
    both = both.withColumns({f"{p}_positive_rate": ratio(f"{p}_positives", f"{p}_rows") for p in PARTS})
    tested = predictions.filter("split = 'test'").join(chosen.filter("selected_feature_set").drop("selected_feature_set"), key, "left_semi")
    best = thresholds.apply_cutoffs(tested, cuts, key)
    return both.select(*METRIC_COLUMNS), with_reused(best, planned).select(*suite.kept, *PREDICTION_COLUMNS)


def importance_table(fitted: Mapping[tuple, object], chosen: DataFrame, planned: DataFrame, suite: Suite, repeats: int = 3) -> DataFrame:
    """Loss of average precision on the validation part when a feature is shuffled, for the selected model of each scope."""
    spark = planned.sparkSession
    best = [tuple(r) for r in chosen.filter("selected_feature_set").select(*CELL, "feature_set", "model").collect()]

    def job(k: tuple) -> DataFrame:
        model, task = fitted[k]
        found = L.permutation_importance(model, task, "valid", list(suite.ids), list(task.numeric), repeats)
        marks = dict(zip((*CELL, "feature_set", "model"), k))
        return materialize(found.select(*[F.lit(v).alias(c) for c, v in marks.items()], "feature", "importance", "importance_std"))

    parts = in_pools(spark, [partial(job, k) for k in best if k in fitted])
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} {'double' if c.startswith('importance') else 'string'}" for c in IMPORTANCE_COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_reused(out, planned).select(*IMPORTANCE_COLUMNS)


@dataclass(frozen=True)
class Results:
    plan: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    fitted: Mapping[tuple, object]


def run(frame: DataFrame, targets: Sequence[str], suite: Suite, min_precisions: Sequence[float] = (0.3,), top_fractions: Sequence[float] = (0.1,), tolerance: float = 0.0) -> Results:
    """Plan, fits, metric and prediction tables of a suite."""
    frame = materialize(frame)
    planned = materialize(plan(frame, targets, suite.ids, suite.kinds, suite.min_positives, suite.reuse, suite.split))
    predictions, fitted = fit_all(frame, planned, suite)
    table, best = tables(predictions, planned, suite, min_precisions, top_fractions, tolerance)
    return Results(planned, materialize(table), materialize(best), fitted)


def save(results: Results, folder: str | None = None) -> str:
    """Write plan, metrics and predictions below a folder (of the shared one by default); its path."""
    folder = folder or f"{checkpoint_dir(results.plan.sparkSession)}/suites/{uuid.uuid4().hex}"
    for name in ("plan", "metrics", "predictions"):
        getattr(results, name).write.parquet(f"{folder}/{name}")
    return folder


# --- several scopes' predictions of one row


def type_and_overall(predictions: DataFrame, ids: Sequence[str], kinds: Sequence[str] = ("machine_type", "overall")) -> DataFrame:
    """One prediction per row: of the most specific scope that has one for it, named in ``source_kind`` and ``source_name``."""
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("scope_kind"))
    rows = predictions.withColumn("_p", order).filter("_p > 0")
    held = [c for c in rows.columns if c not in (*ids, "_p")]
    best = rows.groupBy(*ids).agg(F.min_by(F.struct(*held), F.col("_p")).alias("x")).select(*ids, "x.*")
    return best.withColumnsRenamed({"scope_kind": "source_kind", "scope_name": "source_name"})


def asset_reaggregation(predictions: DataFrame, entity: str = "entity", cutoff: float = 0.5) -> DataFrame:
    """Metrics of every asset from stored predictions of its type's model, or of the overall one if its type has none."""
    best = selection.preferred_scope(predictions, [entity])
    key = [entity, F.col("scope_kind").alias("source_kind"), F.col("scope_name").alias("source_name")]
    rows = best.select(*key, "y", "score")
    by = [entity, "source_kind", "source_name"]
    return metrics.ranking_quality(rows, by).join(metrics.at_cutoff(rows, by, cutoff).drop("rows", "positives"), by)


def type_against_overall(predictions: DataFrame, etype: str = "etype") -> DataFrame:
    """Per type: rows, positives, and AP of the type's own model and of the overall model on the same rows."""
    rows = predictions.filter((F.col("scope_kind") == "overall") | (F.col("scope_kind") == "machine_type"))
    quality = metrics.ranking_quality(rows, ["scope_kind", etype])
    of = lambda kind, c: F.max(F.when(F.col("scope_kind") == kind, F.col(c)))
    return quality.groupBy(etype).agg(
        of("overall", "rows").alias("test_rows"), of("overall", "positives").alias("test_positives"), of("overall", "positive_rate").alias("positive_rate"),
        of("machine_type", "average_precision").alias("ap_by_type"), of("overall", "average_precision").alias("ap_overall"),
    )
