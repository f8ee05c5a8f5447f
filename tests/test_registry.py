import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SAMPLE = ("panel_rollup", "hist_flag", "label_first_class", "risk_forecast_quality", "kpis_period", "quality_summary", "table_page", "alerts_latest")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    out = check.compare(entry.queries()[name](spark, SF), check.connect(SF), entry.oracle_sql()[name])
    assert out.startswith("ok") and "TYPES" not in out, out


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_scan_is_pruned(spark):
    plan = entry.queries()["hist_flag"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "event_id" not in plan
