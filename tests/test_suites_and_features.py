"""Plans, fits and tables of suites; feature sets; screens; bootstrap blocks; absorbed levels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gearwatch.operators import casecontrol as C
from gearwatch.operators import quality as Q
from gearwatch.operators import screens
from gearwatch.operators.residuals import operating_residuals
from gearwatch.plans import features as FS
from gearwatch.plans import suites as S


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"d": np.arange(n), "entity": rng.integers(0, 6, n), "x": rng.normal(size=n)})
    pdf["etype"] = pdf.entity % 3
    pdf["split"] = np.select([pdf.d < n * 0.6, pdf.d < n * 0.8], ["train", "valid"], "test")
    pdf["y"] = (pdf.x + rng.normal(size=n) * 0.7 > 0.4).astype(int)
    pdf["same"], pdf["never"] = pdf.y, 0
    pdf["nearly"] = pdf.y.where(pdf.d != 5, 1 - pdf.y)
    pdf.loc[(pdf.etype == 2) & (pdf.split == "valid"), ["y", "same", "nearly"]] = 0
    return pdf


TYPES = {"overall": None, "machine_type": "etype"}


def test_plan_names_skipped_and_repeated_cells(spark):
    frame = spark.createDataFrame(rows()).repartition(5)
    got = {(r.target, r.scope_name): r for r in S.plan(frame, ("y", "same", "nearly", "never"), ["d", "entity"], TYPES).collect()}
    assert len(got) == 16
    assert got["y", "all"].status == "ok" and got["same", "all"].same_as == "y" and got["same", "all"].status == "identical_target"
    assert got["nearly", "all"].status == "ok" and got["never", "all"].reason == "single train class; single valid class; single test class"
    assert got["y", "2"].status == "skipped" and got["y", "2"].reason == "single valid class" and got["same", "2"].status == "skipped"
    strict = {(r.target, r.scope_name): r for r in S.plan(frame, ("y",), ["d"], TYPES, min_positives=1000).collect()}
    assert "train positives" in strict["y", "all"].reason and "below 1000" in strict["y", "all"].reason
    none = S.plan(frame.filter("split <> 'valid'"), ("y",), ["d"], {"overall": None}).first()
    assert none.status == "skipped" and none.reason == "empty valid split"


def test_equal_fingerprints_are_compared_exactly(spark, monkeypatch):
    frame = spark.createDataFrame(rows())
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # every label looks alike
    found = {(r.target, r.same_as) for r in S.identical_targets(frame, ("y", "same", "nearly", "never"), ["d"], {"overall": None}).collect()}
    assert found == {("same", "y")}


def test_scopes_and_filters(spark):
    frame = spark.createDataFrame(rows())
    assert list(S.chosen_scopes()) == ["overall", "machine_type", "asset_tag"] and list(S.chosen_scopes("machine_type")) == ["machine_type"]
    assert list(S.chosen_scopes(asset_tag="3")) == ["overall", "asset_tag"]
    assert S.filtered(frame, machine_type="1").select("etype").distinct().collect()[0][0] == 1
    with pytest.raises(ValueError):
        S.filtered(frame, asset_tag="absent")
    with pytest.raises(ValueError):
        S.chosen_scopes("site")


def test_fits_run_side_by_side_and_errors_come_out(spark):
    frames = S.in_pools(spark, [lambda k=k: spark.range(k) for k in (1, 2, 3)], 2)
    assert [f.count() for f in frames] == [1, 2, 3]

    def fail():
        raise RuntimeError("a fit failed")

    with pytest.raises(RuntimeError, match="a fit failed"):
        S.in_pools(spark, [fail, lambda: spark.range(1)])


def average_precision(y, score):
    order = np.argsort(-score, kind="stable")
    y, score = y[order], score[order]
    last = np.append(np.flatnonzero(np.diff(score)), len(score) - 1)
    tp, n = np.cumsum(y)[last], last + 1
    return float(np.sum(np.diff(np.append(0, tp)) * tp / n) / y.sum())


def test_fitted_suite_metrics_follow_from_stored_predictions(spark, tmp_path):
    frame = spark.createDataFrame(rows(600, 4))
    models = {"prior": S.Model("prior"), "lr": S.Model("lr"), "rf": S.Model("rf", options={"numTrees": 10, "maxDepth": 4})}
    suite = S.Suite({"A": ("x",)}, ("entity",), models, ("d", "entity"), (), TYPES)
    out = S.run(frame, ("y", "same", "never"), suite)
    table, best = out.metrics.toPandas(), out.predictions.toPandas()
    assert list(table.columns) == list(S.METRIC_COLUMNS) and list(best.columns)[-len(S.PREDICTION_COLUMNS):] == list(S.PREDICTION_COLUMNS)
    assert set(out.fitted) == {("y", k, s, "A", m) for k, s in (("overall", "all"), ("machine_type", "0"), ("machine_type", "1")) for m in ("lr", "rf")}
    skipped = table[table.status == "skipped"]
    assert set(zip(skipped.target, skipped.scope_name)) == {("never", s) for s in ("all", "0", "1", "2")} | {("y", "2"), ("same", "2")}
    for (target, kind, scope, model, policy), g in best.groupby(["target", "scope_kind", "scope_name", "model", "policy"]):
        row = table[(table.target == target) & (table.scope_kind == kind) & (table.scope_name == scope) & (table.model == model) & (table.policy == policy) & (table.split == "test")]
        assert len(row) == 1 and row.selected_model.item()
        hit = g.score >= g.cutoff
        assert (row.tp.item(), row.fp.item()) == ((hit & (g.y == 1)).sum(), (hit & (g.y == 0)).sum())
        assert row.average_precision.item() == pytest.approx(average_precision(g.y.to_numpy(), g.score.to_numpy()))
        assert row.test_rows.item() == len(g)
    y, same = (table[(table.target == t) & (table.status != "skipped")].drop(columns=["target", "status", "reason"]) for t in ("y", "same"))
    order = ["scope_kind", "scope_name", "model", "split", "policy"]
    pd.testing.assert_frame_equal(y.sort_values(order).reset_index(drop=True), same.sort_values(order).reset_index(drop=True))
    assert set(table[table.target == "same"].status) == {"identical_target", "skipped"}
    folder = S.save(out, str(tmp_path / "suite"))
    assert spark.read.parquet(f"{folder}/metrics").count() == len(table)
    cross = screens.cross_table({"one": out.metrics}).toPandas()
    assert list(cross.columns) == list(screens.COMPARISON_COLUMNS) and len(cross) == ((table.split == "test") & table.selected_model).sum()
    task = {"target": "y", "scope_kind": "overall", "scope_name": "all", "order": ["prior", "lr", "rf"]}
    assert [r.model for r in screens.model_rows(out.metrics, **task).collect()] == ["prior", "lr", "rf"] and screens.focus_model(out.metrics, **task) in ("lr", "rf")
    with pytest.raises(ValueError):
        screens.model_rows(out.metrics, "y", "overall", "absent", ["lr"])


def test_too_many_fits_are_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_FITS", 2)
    frame = spark.createDataFrame(rows())
    suite = S.Suite({"A": ("x",)}, (), {"lr": S.Model("lr")}, ("d",), (), TYPES)
    with pytest.raises(ValueError, match="fits"):
        S.fit_all(frame, S.plan(frame, ("y",), ["d"], TYPES), suite)


def test_one_prediction_per_row_from_the_most_specific_scope(spark):
    p = spark.createDataFrame([("overall", "all", 1, 0.1), ("machine_type", "a", 1, 0.2), ("overall", "all", 2, 0.3)], "scope_kind string, scope_name string, id int, score double")
    got = {r.id: (r.score, r.source_kind, r.source_name) for r in S.type_and_overall(p, ["id"]).collect()}
    assert got == {1: (0.2, "machine_type", "a"), 2: (0.3, "overall", "all")}


# --- feature sets


def test_resolver_builds_what_is_asked_for_once(spark):
    built = []

    def block(name, needs=(), absent=""):
        return FS.Block((f"{name}_1",), lambda df: built.append(name) or df.withColumn(f"{name}_1", F.lit(1)), needs, lambda: absent)

    blocks = {"a": block("a"), "b": block("b", ("a",)), "c": block("c", ("b",), "no rows"), "d": block("d", ("c",))}
    sets = {"A": ("a",), "B": ("a", "b"), "C": ("c",), "D": ("b", "d")}
    out = FS.resolve(spark.range(1), blocks, sets)
    assert built == ["a", "b"] and out.columns == {"A": ("a_1",), "B": ("a_1", "b_1")}
    assert out.unavailable == {"C": "no rows", "D": "c: no rows"}
    assert {(r.feature_set, r.status, r.reason) for r in out.listing().collect() if r.column is None} == {("C", "unavailable", "no rows"), ("D", "unavailable", "c: no rows")}
    built.clear()
    assert FS.resolve(spark.range(1), blocks, sets, ["A"]).columns == {"A": ("a_1",)} and built == ["a"]
    for bad, kind in ((["Z"], "unknown"), ([], "no feature set")):
        with pytest.raises(ValueError, match=kind):
            FS.resolve(spark.range(1), blocks, sets, bad)
    with pytest.raises(ValueError, match="target"):
        FS.resolve(spark.range(1), blocks, sets, ["A"], forbidden=("a_1",))
    with pytest.raises(ValueError, match="rest on each other"):
        FS.resolve(spark.range(1), {"a": block("a", ("b",)), "b": block("b", ("a",))}, {"A": ("a",)})


def test_sets_without_a_normal_period_are_unavailable(spark):
    from gearwatch.sources.warehouse import EVENT_SPLIT, events_panel

    panel = events_panel(spark, "/root/testdata/sf0.001")
    sets = FS.asset_features(panel, *EVENT_SPLIT, min_rows=10**6)
    assert set(sets.columns) == {"A", "C"} and set(sets.unavailable) == {"B", "D"} and "of 1000000 rows" in sets.unavailable["B"] and sets.unavailable["D"] == sets.unavailable["B"]
    full = FS.asset_features(panel, *EVENT_SPLIT, min_rows=2)
    a, b, c, d = (set(full.columns[s]) for s in "ABCD")
    assert a < b < d and a < c < d and b | c < d
    family = FS.family_features(panel, *EVENT_SPLIT, ["m1"], ["m2", "m3"], min_rows=3)
    a, b, c = (set(family.columns[s]) for s in "ABC")
    assert a < b < c and not c & set(FS.FAMILY_TARGETS) and set(family.columns["C"]) <= set(family.frame.columns)


# --- residuals, bootstrap, lists


def test_entities_with_few_rows_keep_their_level_out_of_the_residual(spark):
    rng = np.random.default_rng(2)
    big = pd.DataFrame({"entity": np.repeat(["a", "b"], 60), "etype": "t"})
    small = pd.DataFrame({"entity": ["c"] * 4, "etype": "t"})
    pdf = pd.concat([big, small, pd.DataFrame({"entity": ["n"] * 2, "etype": "t"}), pd.DataFrame({"entity": ["u"] * 2, "etype": "v"})], ignore_index=True)
    pdf["d"] = pd.to_datetime("2024-01-01").date()
    pdf["load"] = rng.normal(size=len(pdf))
    pdf["heat"] = 2 * pdf.load + pdf.entity.map({"a": 0.0, "b": 10.0, "c": 100.0, "n": 5.0, "u": 5.0})
    pdf["clean"] = ~pdf.entity.isin(["n", "u"])
    out, artifacts = operating_residuals(spark.createDataFrame(pdf), ["heat"], ["load"], F.col("clean"), min_rows=30, calendar=())
    got = out.toPandas()
    assert got[got.entity.isin(["a", "b", "c"])].heat_residual.abs().max() < 1e-9
    mean_level = (60 * 0 + 60 * 10 + 4 * 100) / 124
    assert np.allclose(got[got.entity.isin(["n", "u"])].heat_residual, 5 - mean_level)
    assert set(artifacts.filter("selected_scope = 'asset_tag'").toPandas().entity) == {"a", "b"}


def test_bootstrap_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"period": "overall", "failed_part": "p", "sensor": "s", "z_threshold": 2.0, "entity": np.arange(n), "isolated_rows": 20, "clean_rows": 200})
    pdf["isolated_hits"], pdf["clean_hits"] = rng.binomial(20, 0.3, n), rng.binomial(200, 0.1, n)
    effects = spark.createDataFrame(pdf)
    whole = C.bootstrap(effects, samples=400).first()
    monkeypatch.setattr(C, "BLOCK", 32)
    cut = C.bootstrap(effects.repartition(9), samples=400).first()
    rates = pdf.isolated_hits / 20 - pdf.clean_hits / 200
    # Two stages: an entity's days, then entities. An entity that is picked twice brings the same resampled days, so theirs count twice.
    p, q = pdf.isolated_hits / 20, pdf.clean_hits / 200
    within = (p * (1 - p) / 20 + q * (1 - q) / 200).mean()
    spread = np.sqrt((rates.var(ddof=0) + 2 * within) / n) * 100
    for got in (whole, cut):
        assert got.ci_low_pp == pytest.approx(100 * rates.mean() - 1.96 * spread, abs=0.5 * spread)
        assert got.ci_high_pp == pytest.approx(100 * rates.mean() + 1.96 * spread, abs=0.5 * spread)


def test_bootstrap_makes_no_row_per_draw(spark):
    pdf = pd.DataFrame({"period": "overall", "failed_part": "p", "sensor": "s", "z_threshold": 2.0, "entity": ["a", "b"], "isolated_rows": 5, "clean_rows": 9, "isolated_hits": 2, "clean_hits": 1})
    plan = C.bootstrap(spark.createDataFrame(pdf), samples=50)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("FlatMapGroupsInArrow") == 2


def test_daily_lists(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "x"), (3, None)], "d int, v string")
    got = {tuple(r) for r in Q.daily_listed_values(df, "v", ["a", "b"], ["d"]).collect()}
    assert got == {(2, "b", "missing"), (2, "x", "extra"), (3, "a", "missing"), (3, "b", "missing")}


def test_tables_repeat_counted_scores_per_policy_not_rows(spark, monkeypatch):
    seen, apply = [], S.thresholds.apply_cutoffs
    monkeypatch.setattr(S.thresholds, "apply_cutoffs", lambda r, *a: (seen.append(r.count()), apply(r, *a))[1])
    suite = S.Suite({}, (), {"prior": S.Model("prior"), "rate": S.Model("rate", keys=("entity",))}, ("d", "entity"), (), {"overall": None})
    out = S.run(spark.createDataFrame(rows()), ["y"], suite)
    assert seen[0] <= 28 and seen[1] == 80  # of 320 scored rows: 6 rates and one constant, two labels, two parts; the best model's test rows
    for r in out.metrics.filter("policy = 'f1' AND split = 'test'").collect():
        assert r.tp + r.fp + r.fn + r.tn == 80
    best = out.predictions.filter("policy = 'f1'").toPandas()
    hit = out.metrics.filter("selected_model AND policy = 'f1' AND split = 'test'").first()
    assert hit.tp == int(((best.score >= best.cutoff) & (best.y == 1)).sum()) and hit.fp == int(((best.score >= best.cutoff) & (best.y == 0)).sum())


def test_targets_beyond_the_listed_cells_are_scored(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_FITS", 0)  # bounds fits, not the rates of scopes
    suite = S.Suite({}, (), {"rate": S.Model("rate", keys=("entity",))}, ("d", "entity"), (), {"overall": None})
    frame = spark.createDataFrame(rows())
    planned = S.plan(frame, ("y", "nearly"), ["d", "entity"], {"overall": None})
    assert {r[0] for r in S.fit_all(frame, planned, suite)[0].select("target").distinct().collect()} == {"y", "nearly"}


def test_asset_feature_sets_do_not_repeat_rows_per_column(spark, tmp_path, monkeypatch):
    from gearwatch.catalog import suites as Q

    names = [f"c{i}" for i in range(30)]
    frame = spark.createDataFrame([(float(k), None if k % 2 else float(-k)) * 15 for k in range(4)], ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(Q, "supplier_panel", lambda *_: None)
    monkeypatch.setattr(Q.FS, "asset_features", lambda *_: FS.FeatureSets(frame, {"A": tuple(names)}, {}))
    got = Q.asset_feature_sets(spark, "")
    assert {(r["column"], r.known, r["mean"]) for r in got.collect()} == {(n, 2 if i % 2 else 4, -1.0 if i % 2 else 1.5) for i, n in enumerate(names)}
    assert "Sort" not in got._jdf.queryExecution().optimizedPlan().toString()
    inline = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_v11" in x]
    assert inline  # twelve columns to a row
