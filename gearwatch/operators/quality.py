"""Validation and data-quality reports. Every check is an aggregate; none collects rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearwatch.functions.expressions import GRADE_WEIGHTS, day_number, ratio
from gearwatch.operators.joins import duplicate_keys
from gearwatch.panel import PANEL, PanelSpec


class PanelError(ValueError):
    """The panel breaks its contract."""


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise PanelError(f"missing columns: {missing}")
    return df


# Columns known only after the event, and what marks a label or a score.
AFTER_EVENT = ("wo_type", "qty_issued", "issue_value_inr", "category", "qty", "amount")
AFTER_EVENT_PREFIXES = ("target", "severity", "failed_", "label_")


def check_features(features: Sequence[str], target: str, more: Sequence[str] = ()) -> list[str]:
    """Refuse feature lists that leak: labels, post-event columns, duplicates."""
    names = list(features)
    bad = {n for n in names if n == target or n in AFTER_EVENT or n in more or n.startswith(AFTER_EVENT_PREFIXES)}
    if bad:
        raise PanelError(f"features known only after the event: {sorted(bad)}")
    if len(set(names)) != len(names):
        raise PanelError("duplicate features")
    return names


def value_problems(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Counts of broken values in one pass (NULL keys, flags, grades, non-finite or negative numbers)."""
    s = spec

    def n(c: Column) -> Column:
        return F.count(F.when(c, F.lit(1)))

    checks: dict[str, Column] = {
        "null_keys": n(F.col(s.date).isNull() | F.col(s.entity).isNull() | F.col(s.member).isNull()),
        "bad_flags": n(F.col(s.flag).isNull() | ~F.col(s.flag).isin(0, 1)),
        "bad_grades": n(F.col(s.grade).isNull() | ~F.upper(F.trim(s.grade)).isin(*GRADE_WEIGHTS)),
    }
    infinite = F.lit(False)
    for m in s.measures:
        infinite = infinite | F.coalesce(F.isnan(m) | (F.abs(m) == float("inf")), F.lit(False))
    checks["non_finite"] = n(infinite)
    if s.cost in df.columns:
        checks["negative_cost"] = n(F.col(s.cost) < 0)
    if s.qty in df.columns:
        checks["negative_qty"] = n(F.col(s.qty) < 0)
    if {s.cost, s.qty, s.amount} <= set(df.columns):
        checks["identity_breaks"] = n(~close(F.col(s.cost) * F.col(s.qty), F.col(s.amount)))
    return df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in checks.items()])


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def dependency_breaks(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key-dependent column: groups that hold more than one value (NULL counts as a value).

    min <> max needs no set per group, so a hot group costs two values.
    """
    per = []
    for c in columns:
        mixed = (F.min(c) != F.max(c)) | (F.count(F.when(F.col(c).isNull(), F.lit(1))).between(F.lit(1), F.count(F.lit(1)) - 1))
        per.append(F.coalesce(mixed, F.lit(False)).alias(c))
    groups = df.groupBy(*keys).agg(*per)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mixed")) for c in columns])
    return (
        groups.select(F.inline(cells))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("mixed"), F.lit(1))).alias("broken_groups"))
    )


def require_sound(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Raise if the panel breaks its contract; two jobs, each returning one small row."""
    require_columns(df, spec.required)
    counts = value_problems(df, spec).first().asDict()
    bad = {k: v for k, v in counts.items() if k != "rows" and v}
    if bad:
        raise PanelError(f"broken values: {bad}")
    columns = [spec.etype, spec.site, *spec.measures]
    mixed = [
        F.coalesce(
            (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))), F.lit(False)
        ).alias(c)
        for c in columns
    ]
    days = df.groupBy(*spec.entity_day).agg(
        (F.count(F.lit(1)) > F.countDistinct(spec.member)).alias("_dup"), *mixed
    )
    hits = days.agg(*[F.max(c).alias(c) for c in ["_dup", *columns]]).first().asDict()
    if hits["_dup"]:
        raise PanelError(f"duplicate rows on {spec.key}")
    odd = [c for c in columns if hits[c]]
    if odd:
        raise PanelError(f"columns that differ within an entity-day: {odd}")
    return df


def member_signatures(df: DataFrame, spec: PanelSpec = PANEL, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct member sets per entity over its days; more than one means the make-up changed.

    A day's set is folded into an order-free fingerprint, so no set is collected.
    """
    columns = columns or [spec.member, spec.family, spec.grade]
    h = F.xxhash64(*columns)
    days = df.groupBy(spec.entity, spec.date).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum((h % F.lit(1_000_003)).cast("bigint")).alias("s")
    )
    return days.groupBy(spec.entity).agg(
        F.countDistinct("n", "x", "s").alias("signatures"), F.min("n").alias("min_members"), F.max("n").alias("max_members")
    )


def listed_values(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Values missing from and extra to a fixed list (the distinct values are few by contract)."""
    want = F.array(*[F.lit(x) for x in expected])
    have = F.array_sort(F.collect_set(column))
    return df.agg(have.alias("have")).select(
        F.array_join(F.array_sort(F.array_except(want, "have")), ";").alias("missing"),
        F.array_join(F.array_except("have", want), ";").alias("extra"),
        F.size(F.array_intersect("have", want)).alias("matched"),
    )


def daily_listed_values(df: DataFrame, column: str, expected: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per group (a day, say): values of a fixed list that are missing, and values beyond it, one row each.

    Both sides of the comparison are distinct (group, value) pairs, met by anti-joins; no group's values are gathered.
    """
    seen = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("string").alias("value")).distinct()
    want = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in expected])).alias("value"))
    missing = want.join(seen, [*keys, "value"], "left_anti").withColumn("problem", F.lit("missing"))
    extra = seen.filter(~F.col("value").isin(list(expected))).withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def incomplete_days(df: DataFrame, keys: Sequence[str], column: str, expected: int) -> DataFrame:
    """Groups whose number of distinct values is not the expected one."""
    return df.groupBy(*keys).agg(F.countDistinct(column).alias("found")).filter(F.col("found") != expected)


def family_completeness(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Per entity: family-days with a missing part, days with a missing family, parts in two families."""
    s = spec
    catalog = df.select(s.entity, s.family, s.member).distinct()
    expected = catalog.groupBy(s.entity, s.family).agg(F.count(F.lit(1)).alias("want"))
    families = expected.groupBy(s.entity).agg(F.count(F.lit(1)).alias("want_families"))
    split_parts = (
        catalog.groupBy(s.entity, s.member).agg(F.count(F.lit(1)).alias("k")).groupBy(s.entity)
        .agg(F.count(F.when(F.col("k") > 1, F.lit(1))).alias("parts_in_two_families"))
    )
    seen = df.groupBy(s.entity, s.family, s.date).agg(F.countDistinct(s.member).alias("found"))
    days = (
        seen.join(expected, [s.entity, s.family])
        .groupBy(s.entity, s.date)
        .agg(F.count(F.lit(1)).alias("families"), F.count(F.when(F.col("found") < F.col("want"), F.lit(1))).alias("short"))
    )
    out = days.join(families, s.entity).groupBy(s.entity).agg(
        F.sum("short").alias("short_family_days"),
        F.count(F.when(F.col("families") < F.col("want_families"), F.lit(1))).alias("days_missing_family"),
    )
    return out.join(split_parts, s.entity)


def calendar_audit(df: DataFrame, keys: Sequence[str], date: str, arrival: str | None = None) -> DataFrame:
    """Missing calendar days over all groups, number of groups and, given an arrival
    order column, rows that arrived with an earlier date than the row before."""
    days = df.select(*keys, date).distinct()
    groups = days.groupBy(*keys).agg(
        (day_number(F.max(date)) - day_number(F.min(date)) + 1 - F.count(F.lit(1))).alias("gap")
    )
    out = groups.agg(F.sum(F.col("gap").cast("bigint")).alias("missing_days"), F.count(F.lit(1)).alias("groups"))
    if arrival is None:
        return out
    return out.withColumn("reverse_rows", reverse_rows(df, keys, date, arrival).select("reverse_rows").scalar())


def reverse_rows(df: DataFrame, keys: Sequence[str], date: str, arrival: str) -> DataFrame:
    """Rows dated before the row that arrived just before them in their group.

    The rows are cut into ranges of the order, so a group of any size is spread out; a row meets its predecessor
    inside the range, and the first row of a range the last one of the range before, from a table of a row per range and group.
    """
    from gearwatch.operators.ordered import ranged_rows

    known = df.select(*keys, date, arrival).dropna(subset=list(keys))
    inside = Window.partitionBy(*keys, "_range").orderBy(arrival)
    back = F.col(date) < F.lag(date).over(inside)
    cells = ranged_rows(known, keys, [(arrival, True)]).withColumn("_back", back).groupBy(*keys, "_range").agg(
        F.count(F.when(F.col("_back"), F.lit(1))).alias("_inside"), F.min_by(date, arrival).alias("_first"), F.max_by(date, arrival).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_range")
    edges = cells.withColumn("_edge", F.col("_first") < F.lag("_last").over(across))
    return edges.agg(F.coalesce(F.sum(F.col("_inside") + F.when(F.col("_edge"), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("reverse_rows"))


def quality_summary(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Duplicates, blank categories, period, group sizes and groups with equal measures: one row."""
    s = spec
    rows = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col(s.category).isNull(), F.lit(1))).alias("blank_category"),
        F.min(s.date).alias("period_start"),
        F.max(s.date).alias("period_end"),
    )
    extra = F.sum(F.col("rows") - 1).cast("bigint")
    keys = duplicate_keys(df, s.key).agg(F.coalesce(extra, F.lit(0)).alias("key_duplicates"))
    full = duplicate_keys(df, df.columns).agg(F.coalesce(extra, F.lit(0)).alias("full_duplicates"))
    equal = F.lit(True)
    for m in s.measures:
        equal = equal & F.coalesce((F.min(m) == F.max(m)) & (F.count(m) == F.count(F.lit(1))), F.count(m) == 0)
    groups = (
        df.groupBy(s.date, s.etype, s.entity)
        .agg(F.count(F.lit(1)).alias("n"), equal.alias("equal"))
        .agg(
            F.count(F.lit(1)).alias("group_count"),
            F.min_by("n", F.struct(s.date, s.etype, s.entity)).alias("rows_per_group"),
            F.count(F.when(F.col("equal"), F.lit(1))).alias("identical_measure_groups"),
        )
    )
    out = rows
    for part in (keys, full, groups):
        out = out.withColumn("_p", part.select(F.struct("*")).scalar()).select("*", "_p.*").drop("_p")
    return out.withColumns(
        {
            "blank_category_pct": F.round(ratio("blank_category", "rows") * 100, 2),
            "period_days": day_number("period_end") - day_number("period_start") + 1,
        }
    )


def data_dictionary(df: DataFrame, units: Mapping[str, str] | None = None, no_null_share: Sequence[str] = ("category", "wo_type")) -> DataFrame:
    """Type, unit and NULL share of every column in one pass."""
    units = units or {}
    aggs, cells = [F.count(F.lit(1)).alias("_n")], []
    for i, (name, dtype) in enumerate(df.dtypes):
        aggs.append(F.count(F.when(F.col(name).isNull(), F.lit(1))).alias(f"_{i}"))
        share = F.lit(None).cast("double") if name in no_null_share else F.round(ratio(f"_{i}", "_n") * 100, 2)
        cells.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(dtype).alias("type"),
                F.lit(units.get(name, "")).alias("unit"), share.alias("missing_pct"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def preparation_report(df: DataFrame, spec: PanelSpec = PANEL, split: str = "split", target: str = "target") -> DataFrame:
    """Rows, eligible rows and positive rate per split, and entity-days whose flags are mixed."""
    eligible = F.col("eligible_for_model")
    out = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(eligible, F.lit(1))).alias("eligible_rows"),
        F.avg(F.when(eligible, F.col(target).cast("double"))).alias("positive_rate"),
    )
    days = df.groupBy(split, *spec.entity_day).agg((F.min(spec.flag) < F.max(spec.flag)).alias("mixed"))
    mixed = days.groupBy(split).agg(F.count(F.when(F.col("mixed"), F.lit(1))).alias("mixed_flag_days"))
    return out.join(mixed, split)


def threshold_monotonicity(rates: DataFrame, threshold: str, rate: str) -> DataFrame:
    """How often the rate rises with the threshold (must be 0). The table has one row per threshold."""

    w = Window.partitionBy(F.lit(0)).orderBy(threshold)
    rises = rates.withColumn("_rise", F.col(rate) > F.lag(rate).over(w))
    return rises.agg(F.count(F.when(F.col("_rise"), F.lit(1))).alias("rises"), F.count(F.lit(1)).alias("thresholds"))


def source_info(df: DataFrame, date: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.min(date).alias("start_date"), F.max(date).alias("reference_date")
    ).withColumn("col_count", F.lit(len(df.columns)))


def entity_catalog(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    return df.groupBy(spec.entity).agg(F.min(spec.etype).alias(spec.etype), F.min(spec.site).alias(spec.site))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: same rows, same numbers, whatever the layout."""
    h = F.xxhash64(*df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum((h % F.lit(1_000_000_007)).cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )
