import datetime as dt

import pytest
from pyspark.sql import functions as F

from gearwatch.operators.quality import PanelError, fingerprint
from gearwatch.panel import EQUIPMENT, equipment_schema
from gearwatch.sources import readers, writers
from gearwatch.streaming import alerts as A


def equipment(spark, rows=3):
    data = [
        (dt.date(2024, 1, 1 + i), "M1", "pump", "P1", f"part{i}", "belt", "Bearing", "A", "pc", 2.0, 3.0, 6.0, *[float(x) for x in range(8)], i % 2, None)
        for i in range(rows)
    ]
    return spark.createDataFrame(data, equipment_schema())


def test_csv_round_trip_and_bad_values(spark, tmp_path):
    df = equipment(spark)
    path = str(tmp_path / "panel")
    writers.write_table(writers.bom_header(df), path, writers.bom_header(df).columns, "csv")
    back = readers.read_panel_csv(spark, path)
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
    bad = str(tmp_path / "bad")
    df.withColumn("breakdown_flag", F.lit("x")).write.option("header", True).csv(bad)
    with pytest.raises(PanelError, match="breakdown_flag"):
        readers.read_panel_csv(spark, bad)
    short = str(tmp_path / "short")
    df.drop("shaft_rpm").write.option("header", True).csv(short)
    with pytest.raises(PanelError, match="shaft_rpm"):
        readers.read_panel_csv(spark, short)


def test_parquet_scan_reads_only_named_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    equipment(spark).write.parquet(path)
    plan = readers.read_panel_parquet(spark, path, columns=["asset_tag", "load_pct"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<asset_tag:string,load_pct:double>" in plan


def test_sources_that_exist_are_stacked(spark, tmp_path):
    one = str(tmp_path / "one")
    equipment(spark).write.parquet(one)
    out = readers.read_existing(spark, [one, str(tmp_path / "none")])
    assert out.count() == 3 and out.filter(F.col("metrics_path").contains("one")).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.read_existing(spark, [str(tmp_path / "none")])


def test_replace_export_manifest_fingerprint(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_table(equipment(spark, 2), path)
    writers.replace_table(equipment(spark, 3), path)
    assert writers.current_table(spark, path).count() == 3
    assert fingerprint(writers.current_table(spark, path)).first() == fingerprint(equipment(spark, 3).repartition(2)).first()
    kinds = {"transaction_date": "date", "wo_type": "category", "criticality": "label", "load_pct": "float1"}
    row = writers.export_frame(equipment(spark, 1), kinds, {"A": "vital"}).first()
    assert tuple(row) == ("2024-01-01", "no work", "vital", 5.0)
    assert writers.stamped(equipment(spark, 1), {"site": "P1"}).first().scope_site == "P1"
    writers.write_manifest(spark, str(tmp_path / "m"), {"k": 10})
    assert readers is not None and writers.read_manifest(spark, str(tmp_path / "m")) == {"k": 10}


def test_batch_insert_is_idempotent(spark, tmp_path):
    daily = spark.createDataFrame([(dt.date(2024, 1, 2), "a", 13), (dt.date(2024, 1, 2), "b", 1), (dt.date(2024, 1, 1), "c", 5)], "d date, entity string, points int")
    alerts = A.alerts_of(A.latest_rows(daily))
    path = str(tmp_path / "alerts")
    assert A.store_new(alerts, path, A.KEY) == (3, 3)
    assert A.store_new(alerts, path, A.KEY) == (3, 0)
    assert spark.read.parquet(path).count() == 3


def test_stream_raises_each_alert_once(spark, tmp_path):
    schema = "ts timestamp, d date, entity string, member string, grade string, flag int"
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def drop(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        A.start_alert_stream(A.stream_scores(stream, "ts"), out, mark, {"any_failure": 1, "high_risk": 8}).awaitTermination(120)
        return {(r.entity, r.rule) for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    t = dt.datetime(2024, 1, 1, 6)
    drop([(t, t.date(), "a", "p1", "A", 1), (t, t.date(), "a", "p1", "A", 1), (t, t.date(), "b", "p1", "C", 0)])
    assert run() == ({("a", "any_failure")}, 1)
    assert run() == ({("a", "any_failure")}, 1)
    drop([(t, t.date(), "a", "p2", "A", 1), (t, t.date(), "a", "p1", "A", 1)])
    assert run() == ({("a", "any_failure"), ("a", "high_risk")}, 2)


def test_a_writer_that_stops_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        writers.current_table(spark, path)
    first = writers.replace_table(equipment(spark, 2), path)
    old = writers.current_table(spark, path)

    def stop(*_args, **_options):
        raise RuntimeError("stopped between the steps")

    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", stop)  # the new version is written, the pointer is not
    frame = None
    with pytest.raises(RuntimeError):
        frame = old.union(old)
        writers.replace_table(frame, path)
    monkeypatch.undo()
    assert frame is not None and real is not None
    assert writers.current_table(spark, path).count() == 2 and len(list((tmp_path / "t" / "versions").iterdir())) == 2
    second = writers.replace_table(equipment(spark, 3), path)
    third = writers.replace_table(equipment(spark, 1), path)
    assert writers.current_table(spark, path).count() == 1 and len({first, second, third}) == 3
    assert writers.forget_versions(spark, path, 2) == [first] and writers.forget_versions(spark, path, 2) == []
    assert writers.current_table(spark, path).count() == 1


def alerts_of_day(spark, day, entities, points=1):
    return spark.createDataFrame([(dt.date(2024, 1, day), e, "any_failure", points) for e in entities], "d date, entity string, rule string, points int")


def test_alert_store_reads_only_the_days_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "alerts")
    assert A.store_new(alerts_of_day(spark, 1, "ab"), path, A.KEY) == (2, 2)
    assert A.store_new(alerts_of_day(spark, 2, "a"), path, A.KEY) == (1, 1)
    assert A.store_new(alerts_of_day(spark, 1, "abc").union(alerts_of_day(spark, 1, "c", 9)), path, A.KEY) == (3, 1)
    rows = {(r.d.day, r.entity): r.points for r in spark.read.parquet(path).collect()}
    assert rows == {(1, "a"): 1, (1, "b"): 1, (2, "a"): 1, (1, "c"): 9}
    plan = A.stored_on(spark, path, alerts_of_day(spark, 1, "a").schema, "d", [dt.date(2024, 1, 2)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan and "PushedFilters: []" in plan
    assert A.store_new(alerts_of_day(spark, 3, ""), path, A.KEY) == (0, 0)


def test_latest_review_counts_however_late_it_arrives(spark, tmp_path):
    path, alerts = str(tmp_path / "reviews"), alerts_of_day(spark, 1, "abc")
    schema = "d date, entity string, rule string, status string, at timestamp"
    day, at = dt.date(2024, 1, 1), lambda h: dt.datetime(2024, 1, 2, h)
    A.store_reviews(spark.createDataFrame([(day, "a", "any_failure", "unreviewed", at(9)), (day, "b", "any_failure", "reviewed", at(9))], schema), path)
    A.store_reviews(spark.createDataFrame([(day, "a", "any_failure", "reviewed", at(8)), (day, "b", "any_failure", "unreviewed", at(9))], schema), path)  # late, and a tie
    A.store_reviews(spark.createDataFrame([(day, "a", "any_failure", "reviewed", at(8))], schema), path)  # again
    state = {r.entity: r.status for r in A.with_reviews(alerts, spark.read.schema(schema).parquet(path)).collect()}
    assert state == {"a": "unreviewed", "b": "reviewed", "c": "unreviewed"}
    summary = A.review_summary(A.with_reviews(alerts, spark.read.schema(schema).parquet(path)), {"any_failure": "any failure"}).first()
    assert (summary.label, summary.alerts, summary.unreviewed, summary.reviewed) == ("any failure", 3, 2, 1)
    with pytest.raises(ValueError):
        A.store_reviews(spark.createDataFrame([(day, "a", "any_failure", "odd", at(8))], schema), path)
