"""Top-k, priority ranking and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearwatch.functions.expressions import ratio
from gearwatch.operators.ordered import range_count, row_numbers, with_range
from gearwatch.session import materialize


# Fixed value: default of spark.sql.optimizer.windowGroupLimitThreshold.
WINDOW_LIMIT = 1000


def daily_top_k(df: DataFrame, date: str, ids: Sequence[str], k: int, score: str = "score", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Per day: candidates, hits among the k highest scores (ties in id order) and what chance gives.

    Up to ``WINDOW_LIMIT``, ``row_number <= k`` is a per-group limit Spark also applies before
    the shuffle, so a day's rows never meet in one task; a larger k is ranked by ranges.
    Totals are a plain aggregate.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    day = [*by, date]
    if k <= WINDOW_LIMIT:
        w = Window.partitionBy(*day).orderBy(F.col(score).desc(), *[F.col(i).asc() for i in ids])
        ranked = df.withColumn("_r", F.row_number().over(w))
    else:
        ranked = row_numbers(df, day, [(score, False), *[(i, True) for i in ids]], "_r")
    chosen = (
        ranked.filter(F.col("_r") <= k)
        .groupBy(*day)
        .agg(F.count(F.lit(1)).alias("inspected"), F.sum(F.col(label).cast("bigint")).alias("hits"))
    )
    totals = df.groupBy(*day).agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    picked = chosen.select(*[F.col(c).alias(f"_{c}") for c in day], "inspected", "hits")
    same = F.lit(True)
    for c in day:
        same = same & totals[c].eqNullSafe(picked[f"_{c}"])
    out = totals.join(picked, same).drop(*[f"_{c}" for c in day])
    return out.withColumns(
        {
            "precision_at_k": ratio("hits", "inspected"),
            "recall_at_k": ratio("hits", "positives"),
            "random_expected_hits": ratio(F.col("inspected") * F.col("positives"), "candidates"),
            "random_expected_precision": ratio("positives", "candidates"),
        }
    )


def top_k_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pooled and mean daily precision of the daily top-k table."""
    return daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("inspected").alias("inspections"),
        F.sum("hits").alias("hits"),
        ratio(F.sum("hits"), F.sum("inspected")).alias("precision_at_k"),
        F.avg("precision_at_k").alias("mean_daily_precision"),
        F.avg(F.col("hits").cast("double")).alias("mean_hits_per_day"),
        F.try_divide(F.sum("random_expected_hits"), F.sum("inspected").cast("double")).alias("random_expected_precision"),
    )


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Report of n rows: each task keeps its best n, only those are merged."""
    return df.orderBy(*order).limit(n)


def sorted_rows(df: DataFrame, column: str, descending: bool, ties: Sequence[str]) -> DataFrame:
    """Sort with NULLs last in both directions."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)


def recent(df: DataFrame, date: str, ties: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(F.col(date).desc(), *ties).limit(n)


def page(df: DataFrame, sort: str | None, descending: bool, number: int, size: int, key: Sequence[str]) -> tuple[DataFrame, dict]:
    """One page of a stable sort, the number clamped to the pages there are.

    The sort and key columns alone are written once with the range of the order that each row falls in. The page lies
    in the few ranges that its positions reach, and only these are sorted, so a page deep inside a large table costs no
    more than the first. The page's keys, at most ``size``, then fetch its rows by a filter that reaches the scan.
    """
    spark = df.sparkSession
    size = max(size, 1)
    narrow = materialize(df.select(*dict.fromkeys([*([sort] if sort else []), *key])))
    total = narrow.count()
    pages = max(-(-total // size), 1)
    number = min(max(number, 0), pages - 1)
    ordered, order = _ordered(narrow, sort, descending, key)
    ranged = with_range(ordered, order, range_count(total))
    cells = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # a number per range
    first, last, before, wanted = number * size, (number + 1) * size, 0, []
    for cell, n in cells:
        if before < last and before + n > first:
            wanted.append((cell, before))
        before += n
    offset = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for cell in wanted for x in cell]), F.col("_range").cast("bigint")) if wanted else F.lit(0).cast("bigint")
    inside = Window.partitionBy("_range").orderBy(*[F.col(k).asc() if up else F.col(k).desc() for k, up in order])
    placed = ranged.filter(F.col("_range").isin([cell for cell, _ in wanted])).withColumn("position", offset + F.row_number().over(inside) - 1)
    hits = placed.filter((F.col("position") >= first) & (F.col("position") < last)).select(*key, "position").collect()
    schema = placed.select(*key, "position").schema
    rows = df
    for k in key:
        rows = rows.filter(F.col(k).isin(list({h[k] for h in hits})))
    rows = rows.join(F.broadcast(spark.createDataFrame(hits, schema)), list(key))
    return rows, {"total_rows": total, "page_count": pages, "page": number}


def _ordered(df: DataFrame, sort: str | None, descending: bool, key: Sequence[str]) -> tuple[DataFrame, list]:
    """The frame with what it takes to sort it without NULLs, and the order: NULLs of the sort column come last."""
    order = [(k, True) for k in key]
    if sort and sort not in key:
        dtype = dict(df.dtypes)[sort]
        fill = F.lit("") if dtype == "string" else F.lit(0).cast(dtype)
        out = df.withColumns({"_null": F.col(sort).isNull().cast("int"), "_sort": F.coalesce(F.col(sort), fill)})
        return out, [("_null", True), ("_sort", not descending), *order]
    if sort:
        order = [(sort, not descending), *[(k, True) for k in key if k != sort]]
    return df, order


def positions(df: DataFrame, sort: str | None, descending: bool, key: Sequence[str]) -> DataFrame:
    """0-based position of every row in the (sort, key) order, NULLs last."""
    out, order = _ordered(df, sort, descending, key)
    ranked = row_numbers(out, [], order, "_pos")
    return ranked.withColumn("position", F.col("_pos") - 1).drop("_pos", "_pos_of", "_null", "_sort")


def with_neighbours(df: DataFrame, key: str) -> DataFrame:
    """Previous and next key in cyclic order, by position so nothing is sorted in one task."""
    ranked = row_numbers(df.select(key).distinct(), [], [(key, True)], "i")
    before = ranked.select(F.col(key).alias("previous"), F.col("i").alias("_i"))
    after = ranked.select(F.col(key).alias("next"), F.col("i").alias("_j"))
    n = F.col("i_of")
    ranked = ranked.withColumns(
        {
            "_i": F.when(F.col("i") == 1, n).otherwise(F.col("i") - 1),
            "_j": F.when(F.col("i") == n, F.lit(1)).otherwise(F.col("i") + 1),
        }
    )
    return ranked.join(before, "_i").join(after, "_j").select(key, "previous", "next")
