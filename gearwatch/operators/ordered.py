"""Order statistics without a single-task sort.

A running total or a rank over a whole table normally needs one window with no
partition key, that is one task. Here the rows are first cut into ranges of the
order key by Spark's range partitioning, whose cost for a row does not grow with
the number of ranges. Each (group, range) cell is scanned by its own task, and
the cells' totals, a table of at most groups + ranges rows, supply the offsets.
The limits only steer balance: any limits give the same result. The input and its
ranges are written to the shared checkpoint folder. The key is the (group, order key)
tuple, so one hot group is spread over many ranges and many small groups share one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearwatch.session import materialize

# As large as one task sorts with ease.
ROWS_PER_RANGE = 1_000_000
LEAST_RANGES, MOST_RANGES = 16, 4096
BINS = 1024  # per group, of ``quantiles_of_rows``

Key = tuple[str, bool]  # column name, ascending


def range_count(rows: int) -> int:
    """Ranges that keep a range near ``ROWS_PER_RANGE`` rows; results do not depend on it."""
    return min(MOST_RANGES, max(LEAST_RANGES, -(-rows // ROWS_PER_RANGE)))


def with_range(df: DataFrame, keys: Sequence[Key], ranges: int, name: str = "_range") -> DataFrame:
    """Add the number of the key range a row falls in (ranges follow the key order); the rows are dealt by range and written.

    Limits come from a sample, so another run could set them elsewhere; the written numbers hold for all who read them.
    """
    order = [F.col(f"`{k}`").asc() if ascending else F.col(f"`{k}`").desc() for k, ascending in keys]
    return materialize(df.repartitionByRange(ranges, *order).withColumn(name, F.spark_partition_id()))


def ranged_rows(df: DataFrame, by: Sequence[str], order: Sequence[Key], ranges: int | None = None) -> DataFrame:
    """The rows with the range of their (group, order key) in ``_range``."""
    # Counted, sampled and dealt: written once instead of computed three times.
    # The group enters the key as a hash: any order of groups will do, and equal hashes only share a range.
    source = materialize(df.withColumn("_group", F.xxhash64(*by) if by else F.lit(0).cast("bigint")))
    return with_range(source, [("_group", True), *order], ranges or range_count(source.count())).drop("_group")


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Key], values: Mapping[str, str | Column], ranges: int | None = None
) -> DataFrame:
    """Add ``<name>_before`` (sum of earlier rows of the group) and ``<name>_total``.

    The order key must be unique within a group.
    """
    by = list(by)
    cols = {n: (F.col(v) if isinstance(v, str) else v) for n, v in values.items()}
    ranged = ranged_rows(df, by, order, ranges)
    cells = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_cell_{n}") for n, c in cols.items()])
    across = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = cells.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_cell_{n}").over(across), F.lit(0)).alias(f"_off_{n}") for n in cols],
        *[F.sum(f"_cell_{n}").over(whole).alias(f"{n}_total") for n in cols],
    )
    inside = (
        Window.partitionBy(*by, "_range")
        .orderBy(*[F.col(k).asc() if asc else F.col(k).desc() for k, asc in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in cols.items()})
    # A group whose key is NULL is a group like any other.
    here, there = local.alias("_l"), offsets.alias("_o")
    same = F.col("_l._range") == F.col("_o._range")
    for name in by:
        same = same & F.col(f"_l.`{name}`").eqNullSafe(F.col(f"_o.`{name}`"))
    joined = here.join(there, same)
    return joined.select(
        *[F.col(f"_l.`{c}`") for c in df.columns],
        *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(f"{n}_before") for n in cols],
        *[f"{n}_total" for n in cols],
    )


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[Key], name: str = "rank") -> DataFrame:
    """1-based position within the group; the order key must be unique and non-null."""
    out = running_totals(df.withColumn("_one", F.lit(1)), by, order, {"_row": "_one"})
    return out.select(*df.columns, (F.col("_row_before") + 1).alias(name), F.col("_row_total").alias(f"{name}_of"))


def value_counts(df: DataFrame, by: Sequence[str], value: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct values with their row count (and extra sums): hot values become one row."""
    sums = [F.sum(c).alias(n) for n, c in (extra or {}).items()]
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *sums)


def quantiles(df: DataFrame, by: Sequence[str], value: str, q: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, any group size. NULL values are ignored."""
    return quantiles_of_counts(value_counts(df.filter(F.col(value).isNotNull()), by, value), by, value, q)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], value: str, q: Mapping[str, float]) -> DataFrame:
    """The same from (group, value, n) rows with unique values."""
    run = running_totals(counts.select(*by, value, "n"), by, [(value, True)], {"n": "n"})
    return _interpolated(run, by, value, q)


def quantiles_of_rows(rows: DataFrame, by: Sequence[str], value: str, q: Mapping[str, float], bins: int = BINS) -> DataFrame:
    """Exact interpolated quantiles of few groups with many rows; values are known numbers and may repeat.

    The rows are neither sorted nor shuffled: each group's span is cut into equal bins, the bins are counted, and only the
    rows of a bin that holds a wanted rank are ordered. Where all rows share a bin, all are ordered, as in ``quantiles``.
    ``rows`` is read three times and should be written.
    """
    by = list(by)
    v = F.col(value).cast("double")

    def matched(table: DataFrame, also: Sequence[str] = ()) -> tuple[DataFrame, Column]:
        """The table with its keys renamed, and the join condition; a group whose key is NULL is a group like any other."""
        same = F.lit(True)
        for name in [*by, *also]:
            same = same & F.col(f"`{name}`").eqNullSafe(F.col(f"`_k_{name}`"))
        return table.withColumnsRenamed({name: f"_k_{name}" for name in [*by, *also]}), same

    span, same = matched(materialize(rows.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))))
    width = F.col("_hi") - F.col("_lo")
    number = F.when((width > 0) & (width < 1e300), F.floor((v - F.col("_lo")) * F.lit(float(bins)) / width)).otherwise(F.lit(0).cast("bigint"))
    binned = rows.join(span, same).withColumn("_bin", number).select(*by, "_bin", value)
    cells = materialize(binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_size")))
    across = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_size").over(across.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumns({"_before": before, "_total": F.sum("_size").over(across)})
    wanted = F.lit(False)
    for level in q.values():
        at = F.lit(float(level)) * (F.col("_total") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_size")))
    hit, same = matched(materialize(placed.filter(wanted).drop("_size")), ["_bin"])
    few = binned.join(hit, same).groupBy(*by, "_bin", value).agg(F.count(F.lit(1)).alias("n"), F.max("_before").alias("_before"), F.max("_total").alias("_total"))
    run = running_totals(few, [*by, "_bin"], [(value, True)], {"n": "n"})
    run = run.withColumns({"n_before": F.col("n_before") + F.col("_before"), "n_total": F.col("_total")})
    return _interpolated(run, by, value, q)


def _interpolated(run: DataFrame, by: Sequence[str], value: str, q: Mapping[str, float]) -> DataFrame:
    """Quantiles per group from rows that hold at least the wanted ranks."""
    aggs = []
    for name, level in q.items():
        at = F.lit(float(level)) * (F.col("n_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        through = F.col("n_before") + F.col("n")
        v_low = F.max(F.when((F.col("n_before") <= low) & (low < through), F.col(value)))
        v_high = F.max(F.when((F.col("n_before") <= high) & (high < through), F.col(value)))
        part = F.max(at - low)
        aggs.append((v_low + (v_high - v_low) * part).alias(name))
    return run.groupBy(*by).agg(F.max("n_total").alias("n"), *aggs)
