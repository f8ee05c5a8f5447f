"""Panels derived from the warehouse tables (events, lineitem).

Each adapter makes one pass over its fact table: a single grouped aggregate
per (date, entity) carries the flags of all members as conditional aggregates,
with map-side combine where a day holds many facts, so a hot entity shrinks to
its days before the shuffle. The members are a short fixed list and are laid out afterwards with
``inline``; no join is needed to make the panel dense.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Members of each panel and their family and grade.
EVENT_MEMBERS = {
    "click": ("Y", "C"),
    "error": ("X", "A"),
    "purchase": ("Y", "B"),
    "signup": ("X", "C"),
    "view": ("Y", "C"),
}
PART_MEMBERS = {
    "ECONOMY": ("F1", "A"),
    "LARGE": ("F2", "B"),
    "MEDIUM": ("F2", "B"),
    "PROMO": ("F3", "A"),
    "SMALL": ("F3", "C"),
    "STANDARD": ("F1", "C"),
}
EVENT_SPLIT = ("2024-01-19", "2024-01-25")
PART_SPLIT = ("2000-01-01", "2001-01-01")
PANEL_COLUMNS = (
    "d", "entity", "etype", "site", "member", "family", "grade", "flag", "qty",
    "cost", "amount", "category", "observed", "m1", "m2", "m3", "m4",
)


# Rows of one task where a panel has nearly as many days as facts: its aggregates then need the same memory at any size.
ROWS_PER_TASK, LEAST_TASKS = 150_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str, per_task: int | None = None) -> DataFrame:
    """The rows by their keys in as many parts as keep a part near ``per_task`` of about ``rows`` rows."""
    return df.repartition(max(LEAST_TASKS, -(-rows // (per_task or ROWS_PER_TASK))), *keys)


def _dense(
    facts: DataFrame,
    members: Mapping[str, tuple[str, str]],
    flagged: Column,
    cost: Column,
    measures: Sequence[Column],
    etype: Column,
    site: Column,
) -> DataFrame:
    per_member = []
    for m in members:
        hit = F.col("member") == m
        per_member += [
            F.max(F.when(hit, flagged.cast("int"))).alias(f"flag_{m}"),
            F.count(F.when(hit, F.lit(1))).alias(f"qty_{m}"),
            F.max(F.when(hit, cost)).alias(f"cost_{m}"),
        ]
    days = facts.groupBy("d", "entity").agg(
        *[c.alias(f"m{i}") for i, c in enumerate(measures, 1)], *per_member
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("member"),
                F.lit(family).alias("family"),
                F.lit(grade).alias("grade"),
                F.coalesce(F.col(f"flag_{m}"), F.lit(0)).alias("flag"),
                F.col(f"qty_{m}").alias("qty"),
                F.coalesce(F.col(f"cost_{m}"), F.lit(0.0)).alias("cost"),
            )
            for m, (family, grade) in members.items()
        ]
    )
    long = days.select("d", "entity", "m1", "m2", "m3", "m4", F.inline(rows))
    return long.select(
        "d", "entity", etype.alias("etype"), site.alias("site"), "member", "family", "grade", "flag", "qty",
        "cost",
        (F.col("cost") * F.col("qty")).alias("amount"),
        F.when(F.col("qty") > 0, F.when(F.col("flag") == 1, "repair").otherwise("check")).alias("category"),
        (F.col("qty") > 0).cast("int").alias("observed"),
        "m1", "m2", "m3", "m4",
    )


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel E: user x event type x day."""
    facts = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("d"), F.col("user_id").alias("entity"), F.col("event_type").alias("member"), "value"
    )
    value = F.col("value")
    return _dense(
        facts, EVENT_MEMBERS, value > 60, value,
        [F.count("*").cast("double"), F.round(F.avg(value), 6), F.max(value), F.min(value)],
        F.col("entity") % 5, F.col("entity") % 3,
    )


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        F.to_date("l_shipdate").alias("d"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("member"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def shipment_count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the fact table, from the footers of its files."""
    return table(spark, sf_dir, "lineitem").count()


def _shipment_panel(facts: DataFrame, etype: Column, site: Column) -> DataFrame:
    return _dense(
        facts, PART_MEMBERS, F.col("l_returnflag") == "R", F.col("l_extendedprice"),
        [F.round(F.avg(c), 6) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        etype, site,
    )


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel L: supplier x part type x ship day (many calendar gaps).

    A supplier's day has about one shipment, so combining before the shuffle saves nothing; shipments are dealt instead.
    """
    facts = dealt(_shipments(spark, sf_dir).withColumn("entity", F.col("l_suppkey")), shipment_count(spark, sf_dir), "d", "entity")
    return _shipment_panel(facts, F.col("entity") % 5, F.col("entity") % 3)


def region_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel R: region x part type x ship day (nearly no gaps)."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("entity"))
    homes = (
        table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "entity")
    )
    facts = _shipments(spark, sf_dir).join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
    return _shipment_panel(facts, F.col("entity") % 2, F.lit(0).cast("bigint"))
