"""What is written and read back, and small row helpers, each next to its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gearwatch.catalog.base import E_SQL, query
from gearwatch.catalog.metrics import SCORED_SQL, scored
from gearwatch.functions import expressions as X
from gearwatch.operators import joins, ranking, rollups
from gearwatch.session import checkpoint_dir
from gearwatch.sources import writers
from gearwatch.sources.warehouse import events_panel, table


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/stored/{uuid.uuid4().hex}"


def _daily(spark, sf):
    return rollups.entity_daily(events_panel(spark, sf)).select("d", "entity", "points", "failed_parts", "m2")


_DAY = "SELECT d, entity, points, failed_parts, m2 FROM daily"


@query("replaced_table", E_SQL + f" {_DAY} WHERE points > 0")
def replaced_table(spark, sf):
    """A table that was replaced: readers get the newest version."""
    path, daily = _folder(spark), _daily(spark, sf)
    writers.replace_table(daily, path)
    writers.replace_table(daily.filter("points > 0"), path)
    return writers.current_table(spark, path)


@query("partitioned_table", E_SQL + f" SELECT entity, points, failed_parts, m2, d FROM ({_DAY}) WHERE d >= DATE '2024-01-25'")
def partitioned_table(spark, sf):
    """A table with a folder per day, read back for a stretch of days."""
    path = _folder(spark)
    writers.write_table(_daily(spark, sf).repartition("d"), path, ["entity", "points", "failed_parts", "m2", "d"], partition_by=["d"])
    return spark.read.parquet(path).filter(F.col("d") >= F.lit("2024-01-25").cast("date"))


@query("csv_table", E_SQL + f" SELECT entity, points, d, category FROM (SELECT DISTINCT entity, d, category FROM panel) JOIN daily USING (d, entity)")
def csv_table(spark, sf):
    """Pinned columns written as CSV with a header and read back with a schema; a NULL stays one."""
    path = _folder(spark)
    kinds = events_panel(spark, sf).select("entity", "d", "category").distinct()
    rows = kinds.join(_daily(spark, sf), ["d", "entity"])
    writers.write_table(rows, path, ["entity", "points", "d", "category"], "csv")
    return spark.read.schema("entity long, points long, d date, category string").option("header", True).csv(path)


@query(
    "stored_predictions",
    SCORED_SQL + " SELECT s.d, s.entity, s.y, s.score, daily.points FROM scored s JOIN daily USING (d, entity) WHERE split = 'test'",
)
def stored_predictions(spark, sf):
    """Predictions that were stored, joined back to their rows: every row must find one."""
    path = _folder(spark)
    scored(spark, sf).filter("split = 'test'").select("d", "entity", "y", "score").write.parquet(path)
    stored = spark.read.parquet(path)
    return joins.matched_or_fail(stored, _daily(spark, sf).select("d", "entity", "points"), ["d", "entity"])


@query("scope_stamps", E_SQL + f" SELECT *, 'all' AS scope_machine_type, CAST(NULL AS VARCHAR) AS scope_asset_tag FROM ({_DAY}) WHERE points >= 7")
def scope_stamps(spark, sf):
    """Exported rows carry the filter they were exported under."""
    return writers.stamped(_daily(spark, sf).filter("points >= 7"), {"machine_type": "all", "asset_tag": None}).withColumn("scope_asset_tag", F.col("scope_asset_tag").cast("string"))


_TEXT = "CASE user_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M') WHEN 1 THEN 'no date' WHEN 2 THEN strftime(ts, '%Y-13-%d') ELSE strftime(ts, '%Y-%m-%d') END"


@query("tolerant_dates", f"SELECT event_id, TRY_CAST(substr({_TEXT}, 1, 10) AS DATE) AS d FROM events")
def tolerant_dates(spark, sf):
    """Texts that begin with a date, and texts that do not."""
    events = table(spark, sf, "events")
    kind, shown = F.col("user_id") % 4, lambda f: F.date_format("ts", f)
    text = F.when(kind == 0, shown("yyyy-MM-dd'T'HH:mm")).when(kind == 1, "no date").when(kind == 2, shown("yyyy-'13'-dd")).otherwise(shown("yyyy-MM-dd"))
    return events.select("event_id", X.tolerant_date(text).alias("d"))


@query(
    "feature_groups",
    """SELECT p_type AS feature, CASE WHEN p_type LIKE 'ECON%' OR p_type LIKE 'STAN%' THEN 'health' WHEN p_type LIKE 'PRO%' THEN 'operating' ELSE 'other' END AS kind, count(*) AS parts FROM part GROUP BY ALL""",
)
def feature_groups(spark, sf):
    """Names by prefix: health, operating or other."""
    kind = X.feature_group("p_type", ["ECON", "STAN"], ["PRO"])
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("feature"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("parts"))


@query(
    "nullable_predictions",
    SCORED_SQL + " SELECT d, entity, split, score, CASE split WHEN 'valid' THEN NULL WHEN 'test' THEN CAST(score >= 0.4 AS INTEGER) ELSE CAST(score >= 0.3 AS INTEGER) END AS predicted FROM scored",
)
def nullable_predictions(spark, sf):
    """0/1 at a cutoff of each part; no prediction where a policy offers no cutoff."""
    cut = F.when(F.col("split") == "test", F.lit(0.4)).when(F.col("split") == "train", F.lit(0.3))
    return scored(spark, sf).select("d", "entity", "split", "score", X.nullable_prediction("score", cut).alias("predicted"))


@query(
    "listed_entities",
    E_SQL + f" {_DAY} WHERE entity IN (SELECT entity FROM daily GROUP BY entity HAVING max(points) >= 7) AND entity NOT IN (SELECT entity FROM daily WHERE d = (SELECT min(d) FROM daily))",
)
def listed_entities(spark, sf):
    """Rows of listed entities that are not on a second list: a semi-join and an anti-join."""
    daily = _daily(spark, sf)
    listed = daily.groupBy("entity").agg(F.max("points").alias("m")).filter("m >= 7")
    first = daily.filter(F.col("d") == daily.agg(F.min("d")).scalar())
    return joins.only_new(joins.only_listed(daily, listed, ["entity"]), first.select("entity").distinct(), ["entity"])


@query(
    "sorted_descending",
    E_SQL + """ SELECT r, d, entity, member, category FROM (SELECT *, row_number() OVER (ORDER BY category DESC NULLS LAST, d, entity, member) AS r FROM panel) WHERE r <= 40""",
)
def sorted_descending(spark, sf):
    """The first rows of a descending sort, NULLs last, ties by key."""
    top = ranking.top_n(events_panel(spark, sf).select("d", "entity", "member", "category"), [F.col("category").desc_nulls_last(), F.col("d"), F.col("entity"), F.col("member")], 40)
    again = ranking.sorted_rows(top, "category", True, ["d", "entity", "member"]).collect()  # forty rows
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(again)], "r long, d date, entity long, member string, category string")
