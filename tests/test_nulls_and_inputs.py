"""NULL groups, files with another header, and the gate on unselected models."""

import pytest

from gearwatch.operators import metrics, ordered, ranking, robust, selection, thresholds
from gearwatch.operators.quality import PanelError
from gearwatch.sources import readers
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_ranking_quality_keeps_the_null_group(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), (None, 1, 0.2), (None, 0, 0.8)], "g string, y int, score double")
    got = {r["g"]: r["roc_auc"] for r in metrics.ranking_quality(rows, ["g"]).collect()}
    assert got == {"a": 1.0, None: 0.0}


@pytest.mark.parametrize("ranges", [1, 64, 500])
def test_running_totals_do_not_depend_on_ranges(spark, ranges):
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") * 7 % 600).alias("v"))
    got = sorted(tuple(r) for r in ordered.running_totals(rows, ["g"], [("v", True)], {"n": "v"}, ranges).select("v", "n_before", "n_total").collect())
    want, groups = [], {}
    for i in range(600):
        groups.setdefault(i % 3, []).append(i * 7 % 600)
    for g in groups.values():
        before = 0
        for v in sorted(g):
            want.append((v, before, sum(g)))
            before += v
    assert got == sorted(want)


def test_daily_top_k_of_a_null_day_and_a_large_k(spark, monkeypatch):
    rows = spark.createDataFrame([(d, i, 1.0 - i / 10, int(i < 2)) for d in ("x", None) for i in range(6)], "d string, id int, score double, y int")
    small = sorted(map(str, ranking.daily_top_k(rows, "d", ["id"], 3).collect()))
    assert len(small) == 2
    monkeypatch.setattr(ranking, "WINDOW_LIMIT", 1)
    assert sorted(map(str, ranking.daily_top_k(rows, "d", ["id"], 3).collect())) == small


def test_robust_baseline_of_a_null_type(spark):
    rows = spark.createDataFrame([("e", None, float(i)) for i in range(40)] + [("f", "t", float(i)) for i in range(40)], "entity string, etype string, m double")
    got = robust.fit_baseline(rows, ["m"]).filter("entity = 'e'").collect()
    assert [(r["etype"], r["selected_scope"], r["median"]) for r in got] == [(None, "asset_tag", 19.5)]


def test_cutoffs_without_groups(spark):
    rows = spark.createDataFrame([(0.2,), (0.7,)], "score double")
    cuts = spark.createDataFrame([("f1", 0.5), ("none", None)], "policy string, cutoff double")
    got = sorted((r["score"], r["policy"], r["predicted"]) for r in thresholds.apply_cutoffs(rows, cuts, []).collect())
    assert got == [(0.2, "f1", 0), (0.2, "none", None), (0.7, "f1", 1), (0.7, "none", None)]


def _csv(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path)


SMALL = T.StructType([T.StructField("d", T.DateType()), T.StructField("tag", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("flag", T.IntegerType())])


def _read(spark, path):
    from gearwatch.panel import EQUIPMENT
    from dataclasses import replace

    return readers.read_panel_csv(spark, path, replace(EQUIPMENT, flag="flag"), SMALL)


def test_flags_must_be_whole_numbers(spark, tmp_path):
    assert _read(spark, _csv(tmp_path, "a.csv", "d,tag,kind,flag\n2024-01-01,a,k,1.0\n")).collect()[0]["flag"] == 1
    with pytest.raises(PanelError):
        _read(spark, _csv(tmp_path, "a.csv", "d,tag,kind,flag\n2024-01-01,a,k,0.9\n"))


def test_files_with_exchanged_columns_are_refused(spark, tmp_path):
    _csv(tmp_path, "a.csv", "d,tag,kind,flag\n2024-01-01,a,k,1\n")
    path = _csv(tmp_path, "b.csv", "d,kind,tag,flag\n2024-01-01,k,a,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        _read(spark, path).collect()


def test_gate_judges_selected_models_only(spark):
    rows = []
    for f in range(6):
        for split in ("valid", "test"):
            rows += [(f"f{f}", "affected", s, split, ap, 1.0, "overall", "f1", chosen, "ok") for s, ap, chosen in (("A", 0.5, True), ("B", 0.3, True), ("B", 0.9, False))]
    schema = "family string, target string, feature_set string, split string, average_precision double, temporal_importance double, scope_kind string, threshold_policy string, selected_model boolean, status string"
    got = selection.sequence_gate(spark.createDataFrame(rows, schema)).first()
    assert not got["eligible"] and got["test_delta"] == pytest.approx(-0.2)
