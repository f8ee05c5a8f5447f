"""Idempotent alerts: batch scan of the latest day and the same rules on a stream.

The unique key (date, entity, rule) makes reruns harmless. Late data is not
defined by the domain; one day of watermark is the choice made here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gearwatch.functions.expressions import grade_weight
from gearwatch.operators.joins import only_new
from gearwatch.panel import PANEL, PanelSpec
from gearwatch.session import materialize

# Alert rules and their lowest score.
RULES = {"any_failure": 1, "high_risk": 12}
KEY = ["d", "entity", "rule"]


def latest_rows(df: DataFrame, date: str = "d") -> DataFrame:
    return df.filter(F.col(date) == df.agg(F.max(date)).scalar())


def alerts_of(daily: DataFrame, rules: Mapping[str, float] = RULES, spec: PanelSpec = PANEL) -> DataFrame:
    """One row per entity-day and rule that fires."""
    hits = F.array_compact(F.array(*[F.when(F.col("points") >= t, F.lit(name)) for name, t in rules.items()]))
    return daily.select(spec.date, spec.entity, F.explode(hits).alias("rule"), "points")


def _dates(rows: DataFrame, date: str) -> list:
    """The days of a batch: as many as it covers."""
    return [r[0] for r in rows.select(date).distinct().collect()]


def stored_on(spark: SparkSession, path: str, schema: StructType, date: str, days: list) -> DataFrame:
    """Rows of a store on the given days; only those days' folders are read. Empty if there is no store yet."""
    try:
        return spark.read.schema(schema).parquet(path).filter(F.col(date).isin(days))
    except Exception as error:  # the store does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def store_new(rows: DataFrame, path: str, key: list[str], date: str = "d") -> tuple[int, int]:
    """Insert-if-absent into a store with a folder per day; returns (observed, created).

    Of rows of one key the largest, column by column in order, counts as a whole. Only the folders of the batch's days
    are compared, so a batch costs its own days however long the store has been kept.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c not in key]
    unique = rows.select(*key).distinct() if not others else rows.groupBy(*key).agg(F.max(F.struct(*others)).alias("_x")).select(*key, "_x.*")
    unique = materialize(unique.select(*rows.columns))
    fresh = materialize(only_new(unique, stored_on(spark, path, rows.schema, date, _dates(unique, date)), key))
    seen = unique.count(), fresh.count()
    if seen[1]:
        fresh.repartition(date).write.mode("append").partitionBy(date).parquet(path)
    return seen


# Review states of an alert; without a review it is the first.
REVIEW_STATES = ("unreviewed", "reviewed")


def store_reviews(reviews: DataFrame, path: str) -> int:
    """Append review events (d, entity, rule, status, at); the same event may come again."""
    bad = reviews.filter(~F.col("status").isin(*REVIEW_STATES) | F.col("status").isNull() | F.col("at").isNull())
    if not bad.isEmpty():
        raise ValueError(f"a review needs a time and one of {REVIEW_STATES}")
    events = materialize(reviews.select(*KEY, "status", "at").distinct())
    events.repartition("d").write.mode("append").partitionBy("d").parquet(path)
    return events.count()


def with_reviews(alerts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Alerts with the status of their latest review by event time (of one time the later state), however late it arrived."""
    order = F.array_position(F.array(*[F.lit(s) for s in REVIEW_STATES]), F.col("status"))
    last = reviews.groupBy(*KEY).agg(F.max(F.struct(F.col("at"), order.alias("_o"), F.col("status"))).alias("_x")).select(*KEY, F.col("_x.status").alias("status"), F.col("_x.at").alias("reviewed_at"))
    return alerts.join(last, KEY, "left").withColumn("status", F.coalesce("status", F.lit(REVIEW_STATES[0])))


def review_summary(alerts: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Alerts per rule with the rule's label and how many are in each review state."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("rule")), F.col("rule"))
    return alerts.groupBy("rule").agg(
        F.first(label).alias("label"), F.count(F.lit(1)).alias("alerts"), F.countDistinct("entity").alias("entities"), F.max("d").alias("latest"),
        *[F.count(F.when(F.col("status") == s, F.lit(1))).alias(s) for s in REVIEW_STATES],
    )


def alert_summary(alerts: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Alerts per rule with the rule's label."""
    label = F.col("rule")
    for name, text in labels.items():
        label = F.when(F.col("rule") == name, F.lit(text)).otherwise(label)
    return alerts.groupBy("rule").agg(
        F.first(label).alias("label"), F.count(F.lit(1)).alias("alerts"), F.countDistinct("entity").alias("entities"), F.max("d").alias("latest")
    )


def stream_scores(panel: DataFrame, time: str, watermark: str = "1 day", spec: PanelSpec = PANEL) -> DataFrame:
    """Score per entity and day of a panel stream. A part resent within the watermark counts once."""
    s = spec
    rows = panel.withWatermark(time, watermark).dropDuplicatesWithinWatermark([s.date, s.entity, s.member])
    return (
        rows.groupBy(F.window(time, "1 day").alias("w"), s.entity)
        .agg(F.sum(F.col(s.flag) * grade_weight(s.grade)).alias("points"))
        .select(F.to_date("w.start").alias(s.date), s.entity, "points")
    )


def start_alert_stream(
    scores: DataFrame, path: str, checkpoint: str, rules: Mapping[str, float] = RULES, available_now: bool = True
) -> StreamingQuery:
    """Append new alerts of each micro-batch; a replayed batch inserts nothing twice.

    The file source's checkpoint remembers what was read, so unchanged input is not processed again.
    """

    def sink(batch: DataFrame, _: int) -> None:
        store_new(alerts_of(batch, rules), path, KEY)

    writer = scores.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
