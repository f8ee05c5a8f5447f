"""Joins with a stated cardinality and lookups with fallback levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CARDINALITIES = ("one_to_one", "many_to_one", "one_to_many")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (pre-aggregated before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "many_to_one"
) -> DataFrame:
    """Join after asserting the side(s) that must be unique. The check is one grouped job per side."""
    if cardinality not in CARDINALITIES:
        raise ValueError(f"cardinality must be one of {CARDINALITIES}")
    sides = []
    if cardinality in ("one_to_one", "many_to_one"):
        sides.append(("right", right))
    if cardinality in ("one_to_one", "one_to_many"):
        sides.append(("left", left))
    for name, side in sides:
        if not duplicate_keys(side, on).isEmpty():
            raise ValueError(f"{name} side is not unique on {list(on)} ({cardinality})")
    return left.join(right, list(on), how)


def lookup(left: DataFrame, table: DataFrame, on: Sequence[str], value: str, fallback: float | Column) -> DataFrame:
    """Left lookup with a fill for keys the table does not know. AQE broadcasts the table if it is small."""
    fill = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return left.join(table.select(*on, value), list(on), "left").withColumn(value, F.coalesce(F.col(value), fill))


def fallback_lookup(
    left: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str]]], columns: Sequence[str]
) -> DataFrame:
    """Take the columns from the first level that has the row's key.

    ``levels`` are (table, keys) from the most specific to the least; a level
    with no keys is a one-row table read as a scalar subquery.
    """
    out = left
    hits = []
    for i, (table, keys) in enumerate(levels):
        packed = F.struct(*columns)
        name = f"_level{i}"
        if keys:
            out = out.join(table.select(*keys, packed.alias(name)), list(keys), "left")
        else:
            out = out.withColumn(name, table.select(packed).scalar())
        hits.append(F.col(name))
    out = out.withColumn("_hit", F.coalesce(*hits))
    return out.withColumns({c: F.col(f"_hit.{c}") for c in columns}).drop("_hit", *[f"_level{i}" for i in range(len(levels))])


def only_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(listed, list(on), "left_semi")


def only_new(df: DataFrame, stored: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet: insert-if-absent."""
    return df.join(stored.select(*on), list(on), "left_anti")


def matched_or_fail(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of stored rows that must match completely."""
    missing = left.join(right, list(on), "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"stored rows are missing for some keys of {list(on)}")
    return checked_join(left, right, on, "left", "many_to_one")


def compare_columns(
    df: DataFrame, keys: Sequence[str], variant: str, names: tuple[str, str], values: Sequence[str]
) -> DataFrame:
    """Two variants side by side with their difference (second minus first)."""
    a, b = names
    wide = df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(variant) == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in (a, b)]
    )
    return wide.withColumns({f"{v}_delta": F.col(f"{v}_{b}") - F.col(f"{v}_{a}") for v in values})


def zero_filled_grid(
    counts: DataFrame, rows: DataFrame, row_key: str, periods: DataFrame, period: str, value: str
) -> DataFrame:
    """Every row key with every period, absent cells as zero.

    The calendar (bounded by its length) travels as one array in a scalar
    subquery and is exploded next to each row key, so no cross join is planned.
    """
    calendar = periods.agg(F.array_sort(F.collect_set(period))).scalar()
    grid = rows.select(row_key).distinct().withColumn("_all", calendar).select(row_key, F.explode("_all").alias(period))
    return grid.join(counts, [row_key, period], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def peer_series(daily: DataFrame, entity: str, etype: str, date: str, value: str) -> DataFrame:
    """Every entity next to its only peer of the same type, day by day.

    Types with any other number of members raise in ``peer_of``; here they
    are left out by the count.
    """
    peers = peer_map(daily, entity, etype)
    own = daily.select(entity, date, F.col(value).alias("value")).join(peers, entity)
    other = daily.select(F.col(entity).alias("peer"), date, F.col(value).alias("peer_value"))
    return own.join(other, ["peer", date], "left")


def peer_map(daily: DataFrame, entity: str, etype: str) -> DataFrame:
    """entity -> peer for types with exactly two entities."""
    pairs = daily.groupBy(etype).agg(
        F.min(entity).alias("_lo"), F.max(entity).alias("_hi"), F.countDistinct(entity).alias("_n")
    ).filter(F.col("_n") == 2)
    both = F.array(
        F.struct(F.col("_lo").alias(entity), F.col("_hi").alias("peer")),
        F.struct(F.col("_hi").alias(entity), F.col("_lo").alias("peer")),
    )
    return pairs.select(F.inline(both))


def peer_of(daily: DataFrame, entity: str, etype: str, which) -> object:
    """The single peer of one entity, or an error."""
    hit = peer_map(daily, entity, etype).filter(F.col(entity) == which).select("peer").take(1)
    if not hit:
        raise ValueError(f"{which} does not have exactly one peer")
    return hit[0]["peer"]


def scope_rows(df: DataFrame, scopes: Mapping[str, str | None]) -> DataFrame:
    """Repeat each row once per scope: ('overall', 'all') and one per scope column."""
    cells = [
        F.struct(F.lit(kind).alias("scope_kind"), (F.lit("all") if c is None else F.col(c).cast("string")).alias("scope_name"))
        for kind, c in scopes.items()
    ]
    return df.select("*", F.inline(F.array(*cells)))
