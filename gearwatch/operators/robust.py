"""Robust normal baselines (median, MAD, fallback levels) and robust z scores.

One entity's values are gathered in arrays, bounded by the days of the calendar.
Medians of a type and of the whole fleet count those values by bins and order
only the bins that hold a wanted rank, so no sort sees every clean row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearwatch.operators.history import median_of_sorted
from gearwatch.operators.joins import fallback_lookup
from gearwatch.operators.ordered import quantiles_of_rows
from gearwatch.session import materialize

# Consistency factor of the MAD, smallest usable scale, rows a level needs.
MAD_SCALE, EPSILON, MIN_ROWS, OUTLIER_Z = 1.4826, 1e-12, 30, 3.0


def long_measures(df: DataFrame, keep: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per (row, measure)."""
    return df.unpivot(list(keep), list(measures), "sensor", "value").filter(F.col("value").isNotNull())


def robust_stats(rows: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """rows, median, mad and population std of few groups of any size; the rows (known values) are read several times and should be written."""
    by = list(by)
    mid = materialize(quantiles_of_rows(rows, by, value, {"median": 0.5}).withColumnRenamed("n", "normal_rows"))
    gap = F.col(value) - F.col("median")
    around = rows.join(mid, by).withColumn("_dev", F.abs(gap))
    spread = quantiles_of_rows(around.select(*by, "_dev"), by, "_dev", {"mad": 0.5}).drop("n")
    # Moments around the median: a constant group gives exactly 0.
    n = F.count(F.lit(1))
    mean_gap = F.try_divide(F.sum(gap), n)
    moments = around.groupBy(*by).agg(
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(gap * gap), n) - mean_gap * mean_gap)).alias("std")
    )
    return materialize(mid.join(spread, by).join(moments, by))


def entity_values(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per entity and measure its known values in order and their population std. One entity's days bound the array."""
    lists = [
        F.struct(F.lit(m).alias("sensor"), F.sort_array(F.collect_list(F.col(m).cast("double"))).alias("values"), F.stddev_pop(F.col(m).cast("double")).alias("std"))
        for m in measures
    ]
    packed = df.groupBy(*by).agg(F.array(*lists).alias("_lists"))
    return materialize(packed.select(*by, F.inline("_lists")).filter(F.size("values") > 0))


def bounded_stats(packed: DataFrame, by: Sequence[str]) -> DataFrame:
    """normal_rows, median, mad and std of the groups of ``entity_values``."""
    mid = packed.select(*by, F.size("values").cast("bigint").alias("normal_rows"), median_of_sorted(F.col("values")).alias("median"), "std", "values")
    spread = F.sort_array(F.transform("values", lambda v: F.abs(v - F.col("median"))))
    return materialize(mid.withColumn("_devs", spread).select(*by, "normal_rows", "median", median_of_sorted(F.col("_devs")).alias("mad"), "std"))


def _text_key(column: str) -> Column:
    """A key in text with a mark in front, so that NULL is a key of its own ("-") and joins like the others."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def _from_key(key: Column, kind: str) -> Column:
    return F.when(key.startswith("="), F.substring(key, 2, 1 << 30)).cast(kind)


def fit_baseline(
    clean: DataFrame, measures: Sequence[str], entity: str = "entity", etype: str = "etype",
    min_rows: int = MIN_ROWS, epsilon: float = EPSILON,
) -> DataFrame:
    """Baseline per entity, per type (entity NULL) and over all (both NULL), with the chosen level and why.

    ``clean``: training rows without failures.
    """
    if min_rows < 1:
        raise ValueError("min_rows must be at least 1")
    keyed = clean.select(_text_key(etype).alias("tkey"), _text_key(entity).alias("ekey"), *measures)
    packed = entity_values(keyed, ["tkey", "ekey"], measures)
    levels = F.array(
        F.struct(F.lit("machine_type").alias("level"), F.col("tkey")),
        F.struct(F.lit("global").alias("level"), F.lit("").alias("tkey")),
    )
    values = packed.select("tkey", "sensor", F.explode("values").alias("value"))
    stats = robust_stats(values.select("sensor", "value", F.inline(levels)), ["level", "tkey", "sensor"])
    entities = bounded_stats(packed, ["tkey", "ekey", "sensor"])

    def level(name: str, prefix: str, keys: Sequence[str]) -> DataFrame:
        packed = F.struct("normal_rows", "median", "mad", "std").alias(prefix)
        source = entities if name == "asset_tag" else stats.filter(F.col("level") == name)
        return source.select(*keys, "sensor", packed)

    types = {entity: clean.schema[entity].dataType.simpleString(), etype: clean.schema[etype].dataType.simpleString()}
    whole = level("global", "g", [])
    g = F.col("g")
    g_scope = (
        F.when(g["mad"] > epsilon, "global").when(g["std"] > epsilon, "global_std").otherwise("constant")
    )
    g_reason = (
        F.when(g["mad"] > epsilon, "machine_baseline_unavailable")
        .when(g["std"] > epsilon, "global_mad_zero")
        .otherwise("global_scale_zero")
    )

    def usable(s: Column) -> Column:
        return (s["normal_rows"] >= min_rows) & (s["mad"] > epsilon)

    def reason(s: Column, name: str) -> Column:
        return F.when(s["normal_rows"] < min_rows, f"{name}_insufficient_rows").otherwise(f"{name}_mad_zero")

    def row(frame: DataFrame, stat: Column, scope: Column, why: Column, e: Column, t: Column) -> DataFrame:
        scale = (
            F.when(scope == "constant", F.lit(1.0))
            .when(scope == "global_std", stat["std"])
            .otherwise(stat["mad"] * MAD_SCALE)
        )
        return frame.select(
            _from_key(e, types[entity]).alias(entity), _from_key(t, types[etype]).alias(etype), "sensor",
            stat["normal_rows"].alias("normal_rows"), stat["median"].alias("median"), stat["mad"].alias("mad"),
            scale.alias("scale"), scope.alias("selected_scope"), why.alias("fallback_reason"),
        )

    none = F.lit(None).cast("string")
    by_type = level("machine_type", "t", ["tkey"]).join(whole, "sensor")
    t = F.col("t")
    t_stat, t_scope = F.when(usable(t), t).otherwise(g), F.when(usable(t), "machine_type").otherwise(g_scope)
    by_entity = level("asset_tag", "a", ["tkey", "ekey"]).join(by_type, ["tkey", "sensor"])
    a = F.col("a")
    a_stat = F.when(usable(a), a).otherwise(t_stat)
    a_scope = F.when(usable(a), "asset_tag").otherwise(t_scope)
    return materialize(
        row(whole, g, g_scope, g_reason, none, none)
        .unionByName(row(by_type, t_stat, t_scope, F.when(usable(t), "").otherwise(reason(t, "machine")), none, F.col("tkey")))
        .unionByName(
            row(by_entity, a_stat, a_scope, F.when(usable(a), "").otherwise(reason(a, "asset")), F.col("ekey"), F.col("tkey"))
        )
    )


def _wide(table: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    cell = F.struct("median", "scale", "selected_scope")
    return table.groupBy(*keys).agg(*[F.max(F.when(F.col("sensor") == m, cell)).alias(f"_base_{m}") for m in measures])


def robust_z(
    df: DataFrame, table: DataFrame, measures: Sequence[str], entity: str = "entity", etype: str = "etype", suffix: str = "_robust_z"
) -> DataFrame:
    """Add ``<measure>_robust_z`` from the most specific baseline of the row; constants give 0, NULL stays NULL."""
    names = [f"_base_{m}" for m in measures]
    levels = [
        (_wide(table.filter(F.col(entity).isNotNull()), [etype, entity], measures), [etype, entity]),
        (_wide(table.filter(F.col(entity).isNull() & F.col(etype).isNotNull()), [etype], measures), [etype]),
        (_wide(table.filter(F.col(etype).isNull()), [], measures), []),
    ]
    out = fallback_lookup(df, levels, names)
    z = {}
    for m in measures:
        base = F.col(f"_base_{m}")
        scaled = F.try_divide(F.col(m) - base["median"], base["scale"])
        z[f"{m}{suffix}"] = F.when(F.col(m).isNotNull(), F.when(base["selected_scope"] == "constant", F.lit(0.0)).otherwise(scaled))
    return out.withColumns(z).drop(*names)


def normal_bounds(table: DataFrame, entity: str = "entity", width: float = OUTLIER_Z) -> DataFrame:
    """Normal range of every entity and measure: median -/+ width x scale."""
    half = F.col("scale") * width
    return table.filter(F.col(entity).isNotNull()).select(
        entity, "sensor", "median", "scale", (F.col("median") - half).alias("lower"), (F.col("median") + half).alias("upper")
    )


def out_of_range_days(df: DataFrame, bounds: DataFrame, measures: Sequence[str], entity: str = "entity") -> DataFrame:
    """Days outside the normal range per entity and measure."""
    days = long_measures(df, [entity], measures).join(bounds, [entity, "sensor"])
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return days.groupBy(entity, "sensor").agg(F.count(F.lit(1)).alias("days"), F.count(F.when(out, F.lit(1))).alias("out_days"))


def with_scale(stats: DataFrame, by: Sequence[str], epsilon: float = EPSILON) -> DataFrame:
    """Median and scale per group of residuals: MAD, else std, else constant 1."""
    return stats.select(
        *by, "normal_rows",
        F.col("median").alias("residual_median"), F.col("mad").alias("residual_mad"), F.col("std").alias("residual_std"),
        F.when(F.col("mad") > epsilon, F.col("mad") * MAD_SCALE).when(F.col("std") > epsilon, F.col("std")).otherwise(1.0).alias("residual_scale"),
        F.when(F.col("mad") > epsilon, "mad").when(F.col("std") > epsilon, "std").otherwise("constant").alias("scale_method"),
    )


def residual_scales(residuals: DataFrame, by: Sequence[str], value: str = "residual", epsilon: float = EPSILON) -> DataFrame:
    """``with_scale`` of few groups of any size; the residuals are read several times and should be written."""
    return with_scale(robust_stats(residuals.filter(F.col(value).isNotNull()).select(*by, value), by, value), by, epsilon)


def entity_residual_scales(df: DataFrame, by: Sequence[str], measures: Mapping[str, Column], epsilon: float = EPSILON) -> DataFrame:
    """``with_scale`` of every entity and measure; NULL residuals do not count."""
    packed = entity_values(df.select(*by, *[c.alias(m) for m, c in measures.items()]), by, list(measures))
    return with_scale(bounded_stats(packed, [*by, "sensor"]), [*by, "sensor"], epsilon)
