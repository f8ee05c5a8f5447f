from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gearwatch.functions.expressions import observed_severity, predicted_severity, severity_level
from gearwatch.operators import history, labels, quality, rollups, splits
from gearwatch.operators.robust import fit_baseline, robust_z

DAY = date(2024, 1, 1)


def series(spark, values, missing=(), entity="a"):
    rows = [(DAY + timedelta(days=i), entity, int(v), float(i)) for i, v in enumerate(values) if i not in missing]
    return spark.createDataFrame(rows, "d date, entity string, flag int, x double")


def panel(spark, grades="AAA", days=1):
    rows = [
        (DAY + timedelta(days=i), "m", "t", "p", f"part{j}", "fam", g, 1, 1.0, 2.0, 3.0, 4.0)
        for i in range(days) for j, g in enumerate(grades)
    ]
    return spark.createDataFrame(
        rows, "d date, entity string, etype string, site string, member string, family string, grade string, flag int, m1 double, m2 double, m3 double, m4 double"
    )


def test_score_boundary_and_severity(spark):
    daily = rollups.with_severity(rollups.entity_daily(panel(spark)), 12).first()
    assert (daily.points, daily.severity, daily.severity_code) == (12, "high_risk", 3)
    levels = spark.createDataFrame([(0.0,), (5.0,), (5.5,), (11.0,), (12.0,)], "s double").select(
        severity_level("s", 12).alias("a"), observed_severity("s").alias("b"), predicted_severity("s").alias("c")
    ).collect()
    assert [r.a for r in levels] == ["normal", "caution", "high_risk", "risk", "high_risk"]
    assert [r.b for r in levels] == ["normal", "caution", "risk", "risk", "high_risk"]
    assert [r.c for r in levels] == ["normal", "caution", "risk", "risk", "high_risk"]
    with pytest.raises(ValueError):
        severity_level("s", 6)


def test_lag_is_the_previous_calendar_day(spark):
    out = history.flag_history(series(spark, [0, 1, 0, 0, 1, 0], missing={2}), ["entity"], "d", "flag").orderBy("d").collect()
    by_day = {r.d.day - 1: r for r in out}
    assert by_day[3].flag_lag1 is None and by_day[1].flag_lag1 == 0
    assert by_day[5].days_since_last_flag == 1 and by_day[3].days_since_last_flag == 2
    assert by_day[5].flag_count_7d == 2


def test_changing_the_future_leaves_the_past_alone(spark):
    values = [0, 1, 0, 0, 1, 0, 0, 1, 0, 0]
    a = series(spark, values)
    b = a.withColumns({"x": F.when(F.col("d") > DAY + timedelta(days=6), F.col("x") * 100).otherwise(F.col("x"))})
    frames = []
    for df in (a, b):
        h = history.robust_history(df, ["entity"], "d", ["x"])
        h = history.measure_history(h, ["entity"], "d", ["x"]).drop("x")
        frames.append(h.filter(F.col("d") <= DAY + timedelta(days=6)).orderBy("d").toPandas())
    pd.testing.assert_frame_equal(*frames)
    assert frames[0].x_slope7.notna().sum() == 0
    assert frames[0].x_mad7.iloc[5] == 1.0


def test_future_label_is_null_when_a_day_is_missing(spark):
    df = series(spark, [0, 0, 1, 0, 0, 0, 1, 0, 0], missing={5})
    out = labels.future_label(df, ["entity"], "d", "flag", 2, "binary").orderBy("d").toPandas().set_index("d").target
    got = [None if pd.isna(v) else int(v) for v in out]
    assert got == [1, 1, 0, None, None, 0, None, None]
    first = labels.future_label(series(spark, [0, 0, 0, 0, 1, 0, 0, 0, 0]), ["entity"], "d", "flag", 4, "first").orderBy("d").toPandas().target
    assert [int(v) for v in first.dropna()] == [1, 2, 2, 3, 0]


def test_start_label_needs_yesterday(spark):
    rows = [(DAY, "a", 1), (DAY + timedelta(days=1), "a", 3), (DAY + timedelta(days=3), "a", 5)]
    df = spark.createDataFrame(rows, "d date, entity string, failed_parts int").withColumn("points", F.col("failed_parts") * 2)
    out, names = labels.label_family(df, "START", ["entity"], "d")
    assert [r[names[0]] for r in out.orderBy("d").collect()] == [None, 1, None]


def test_splits(spark):
    df = series(spark, [0] * 20)
    sizes = {r.split: r.rows for r in splits.split_summary(splits.date_share_split(df, "d"), "d").collect()}
    assert sizes == {"train": 14, "valid": 3, "test": 3}
    purged = df.withColumn("end", F.date_add("d", 3)).withColumn("split", splits.purged_split("d", "end", "2024-01-10", "2024-01-15"))
    got = {r.split: r["count"] for r in purged.groupBy("split").count().collect()}
    assert got == {"train": 6, "valid": 2, "test": 6, None: 6}
    assert splits.split_overlap(purged.filter("split is not null"), "d").isEmpty()


def test_bad_panels_are_rejected(spark):
    good = panel(spark, "ABC", 2)
    assert quality.require_sound(good) is good
    with pytest.raises(quality.PanelError, match="m2"):
        quality.require_sound(good.withColumn("m2", F.when(F.col("member") == "part1", 9.0).otherwise(F.col("m2"))))
    with pytest.raises(quality.PanelError, match="m3"):
        quality.require_sound(good.withColumn("m3", F.when(F.col("member") != "part1", F.col("m3"))))
    with pytest.raises(quality.PanelError, match="duplicate"):
        quality.require_sound(good.union(good.limit(1)))
    with pytest.raises(quality.PanelError, match="bad_flags"):
        quality.require_sound(good.withColumn("flag", F.lit(2)))
    with pytest.raises(quality.PanelError, match="grade"):
        quality.require_sound(good.drop("grade"))
    with pytest.raises(quality.PanelError):
        quality.check_features(["m1", "wo_type"], "y")
    with pytest.raises(quality.PanelError):
        quality.check_features(["m1", "y"], "y")


def test_family_and_single_failure(spark):
    p = panel(spark, "BCC", 2).withColumn("flag", F.when((F.col("member") == "part1") | (F.dayofmonth("d") == 2), 1).otherwise(0))
    fam = {r.d.day: r for r in rollups.family_daily(p).collect()}
    assert (fam[1].affected, fam[1].severe, fam[1].all_failed) == (1, 0, 0)
    assert (fam[2].affected, fam[2].severe, fam[2].all_failed) == (1, 1, 1)
    days = {r.d.day: r for r in rollups.single_failure_daily(p).collect()}
    assert (days[1].status, days[1].failed_part) == ("isolated", "part1")
    assert (days[2].status, days[2].failed_part) == ("multiple", None)


def test_robust_baseline_levels_and_unseen_entity(spark):
    rows = [("t", "a", float(v), 5.0) for v in (1, 2, 3, 4, 10)] + [("t", "b", 7.0, 5.0)]
    clean = spark.createDataFrame(rows, "etype string, entity string, m1 double, m2 double")
    table = fit_baseline(clean, ["m1", "m2"], min_rows=3)
    got = {(r.etype, r.entity, r.sensor): r for r in table.collect()}
    assert (got["t", "a", "m1"].median, got["t", "a", "m1"].mad, got["t", "a", "m1"].selected_scope) == (3.0, 1.0, "asset_tag")
    assert (got["t", "b", "m1"].selected_scope, got["t", "b", "m1"].fallback_reason) == ("machine_type", "asset_insufficient_rows")
    assert (got[None, None, "m2"].selected_scope, got[None, None, "m2"].scale) == ("constant", 1.0)
    probe = spark.createDataFrame([("t", "zz", 3.5, 9.0), ("q", "zz", None, 9.0)], "etype string, entity string, m1 double, m2 double")
    z = {r.etype: r for r in robust_z(probe, table, ["m1", "m2"]).collect()}
    assert z["t"].m1_robust_z == pytest.approx((3.5 - 3.5) / (1.4826 * 2.0)) and z["t"].m2_robust_z == 0.0
    assert z["q"].m1_robust_z is None and z["q"].m2_robust_z == 0.0


def test_scored_failure_days_equal_both_rollups(spark):
    import datetime

    from gearwatch.operators import rollups

    rows = [(datetime.date(2024, 1, 1 + d), e, e, 0, m, f, g, int((d * 7 + e * 3 + len(m)) % (2 + d) == 0), 1.0 * d, 2.0, None, 4.0)
            for d in range(6) for e in (1, 2) for m, f, g in (("p", "F1", "A"), ("qq", "F2", "B"), ("rrr", "F2", "C"))]
    p = spark.createDataFrame(rows, "d date, entity int, etype int, site int, member string, family string, grade string, flag int, m1 double, m2 double, m3 double, m4 double")
    got = rollups.scored_failure_daily(p, {"p": "F1", "qq": "F2", "rrr": "F2"})
    single = rollups.single_failure_daily(p)
    names = ["d", "entity", "etype", "failed_parts", "status", "failed_part", "failed_family", "m1", "m3"]
    key = lambda r: (r.d, r.entity)
    assert sorted(got.select(*names).collect(), key=key) == sorted(single.select(*names).collect(), key=key)
    assert {r.status for r in single.collect()} >= {"clean", "isolated"}
    assert "SortAggregate" not in got._jdf.queryExecution().toString()


def test_family_history_is_dealt_into_parts_that_follow_the_shipments(spark, tmp_path, monkeypatch):
    import datetime

    from gearwatch.catalog import history as Q
    from gearwatch.sources import warehouse

    first = datetime.date(2000, 1, 1)
    lines = [(k % 3, k % 4 if k % 50 else None, 1.0, 2.0, 0.0, 0.0, "R" if k % 5 == 0 else "N", first + datetime.timedelta(k // 4) if k % 40 else None) for k in range(400)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "ECONOMY"), (1, "LARGE"), (2, "SMALL")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want = sorted(Q.hist_family(spark, str(tmp_path)).collect(), key=str)
    monkeypatch.setattr(warehouse, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 10)
    out = Q.hist_family(spark, str(tmp_path))
    numbers = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [d#" in numbers and ", 20" in numbers and ", 30" in numbers  # 400 shipments, 1,200 families
    assert sorted(out.collect(), key=str) == want and len(want) == 3 * len({(x[1], x[7]) for x in lines})
