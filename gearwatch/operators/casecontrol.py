"""Isolated-failure days against clean days of the same entity.

Values are placed in order: no case is ever paired with a control.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearwatch.functions.expressions import candidate_status, ratio
from gearwatch.operators.splits import period_column
from gearwatch.session import materialize

# Fixed values: |z| limits and the number of resamples.
Z_LIMITS, RESAMPLES = (2.0, 3.0), 1000


def with_periods(df: DataFrame, date: str, valid_start: str, test_start: str) -> DataFrame:
    """Each row once in its period and once in ``overall``."""
    return df.withColumn("period", F.explode(F.array(F.lit("overall"), period_column(date, valid_start, test_start))))


CHUNK = 100_000  # rows placed together, about; an entity is never cut


def _whole_entities(batches: Iterator[pa.RecordBatch], entity: str) -> Iterator[pa.Table]:
    """Tables of about ``CHUNK`` rows that hold whole entities, from batches in the order of entities."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.column(entity)
        apart = pc.not_equal(names.slice(1), names.slice(0, rows - 1)).to_numpy()
        ends = np.flatnonzero(apart)
        if len(ends):
            yield table.slice(0, ends[-1] + 1)
            held = table.slice(ends[-1] + 1).to_batches()
            rows = sum(b.num_rows for b in held)
        else:
            held = table.to_batches()
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbered(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """A number for every run of rows with the same known values."""
    new = np.zeros(table.num_rows, dtype=bool)
    for name in names:
        column = table.column(name)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
    return np.cumsum(new)


def _medians(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Medians of runs of sorted values."""
    return (values[starts + (sizes - 1) // 2] + values[starts + sizes // 2]) / 2


def _cells(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, starts and sizes of the runs of an ordered array."""
    found, starts = np.unique(number, return_index=True)
    return found, starts, np.diff(np.append(starts, len(number)))


def _placed(by: Sequence[str], entity: str, measures: Sequence[str], limits: Sequence[float], columns: Sequence[str]):
    """Rows of ``entity_effects`` of the entities of a table: every value takes its place among the clean ones of its group."""

    def effects(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = _numbered(table, [entity, *by])
        clean = pc.equal(table.column("status"), "clean").to_numpy().astype(np.int64)
        kinds = pa.table({c: table.column(c) for c in ("failed_part", "failed_family")})
        codes = [c.combine_chunks().dictionary_encode(null_encoding="encode") for c in kinds.columns]
        families = max(1, len(codes[1].dictionary))
        kind = codes[0].indices.to_numpy().astype(np.int64) * families + codes[1].indices.to_numpy()
        kinds_of = max(1, len(codes[0].dictionary)) * families
        for m in measures:
            column = table.column(m)
            known = np.flatnonzero(column.is_valid().to_numpy())
            if not len(known):
                continue
            values = column.fill_null(0.0).to_numpy()[known]
            order = np.lexsort((values, group[known]))  # NaN comes last, as it is the greatest value
            at, v = known[order], values[order]
            g, c = group[at], clean[at]
            _, starts, sizes = _cells(g)
            upto = np.cumsum(c)
            first = np.repeat(starts, sizes)
            upto -= (upto - c)[first]
            total = np.repeat(upto[starts + sizes - 1], sizes)
            apart = np.append(True, (g[1:] != g[:-1]) | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))))
            tie = np.flatnonzero(apart)
            last = np.append(tie[1:], len(v)) - 1
            below, through = (np.repeat(x, last - tie + 1) for x in ((upto - c)[tie], upto[last]))
            lead = below - (total - through)
            hits = [((v >= t) | np.isnan(v)).astype(np.int64) for t in limits]

            one = np.flatnonzero(c == 0)
            one = one[total[one] > 0]
            if not len(one):
                continue
            one = one[np.argsort(g[one] * kinds_of + kind[at[one]], kind="stable")]
            found, cell_starts, cell_sizes = _cells(g[one] * kinds_of + kind[at[one]])
            some = np.flatnonzero(c)
            clean_groups, clean_starts, clean_sizes = _cells(g[some])
            mine = np.searchsorted(clean_groups, found // kinds_of)
            rows, clean_rows = cell_sizes, clean_sizes[mine]
            names = table.take(pa.array(at[one[cell_starts]])).select([*by, "failed_part", "failed_family", entity])
            made = {n: names.column(n) for n in names.column_names} | {
                "sensor": pa.array([m] * len(found)),
                "isolated_rows": rows,
                "clean_rows": clean_rows,
                "median_isolated": _medians(v[one], cell_starts, cell_sizes),
                "median_clean": _medians(v[some], clean_starts, clean_sizes)[mine],
                "delta": np.add.reduceat(lead[one], cell_starts) / (rows * clean_rows),
            }
            for t, hit in zip(limits, hits):
                counts = {"z_threshold": np.full(len(found), float(t)), "isolated_hits": np.add.reduceat(hit[one], cell_starts), "clean_hits": np.add.reduceat(hit[some], clean_starts)[mine]}
                yield from pa.table(made | counts).select(columns).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_entities(batches, entity):
            yield from effects(table)

    return run


def entity_effects(
    days: DataFrame, z: dict[str, str], limits: Sequence[float] = Z_LIMITS, by: Sequence[str] = ("period",), entity: str = "entity"
) -> DataFrame:
    """Per part, measure and entity: anomaly rates, medians and Cliff's delta.

    ``days`` has status / failed_part / failed_family and the z columns; only
    entities with both clean and isolated days count. Rows are dealt out and ordered by entity, and a task places the
    values of some entities at a time, each entity's at most the calendar for every group of ``by``.
    """
    by = list(by)
    isolated = F.col("status") == "isolated"
    named = F.lit(True)
    for c in [*by, entity]:
        named = named & F.col(c).isNotNull()
    flat = days.filter(F.col("status").isin("clean", "isolated") & named).select(
        *by, entity, "status", *[F.when(isolated, F.col(c)).alias(c) for c in ("failed_part", "failed_family")],
        *[F.abs(F.col(c)).cast("double").alias(m) for m, c in z.items()],
    )
    keys = {f.name: f for f in flat.schema.fields}
    out = T.StructType(
        [keys[c] for c in [*by, "failed_part", "failed_family"]] + [T.StructField("sensor", T.StringType()), keys[entity]]
        + [T.StructField(c, T.LongType()) for c in ("isolated_rows", "clean_rows")]
        + [T.StructField(c, T.DoubleType()) for c in ("median_isolated", "median_clean", "delta", "z_threshold")]
        + [T.StructField(c, T.LongType()) for c in ("isolated_hits", "clean_hits")]
    )
    ordered = flat.repartition(entity).sortWithinPartitions(entity, *by)
    return materialize(ordered.mapInArrow(_placed(by, entity, list(z), limits, out.names), out))


def summarize(effects: DataFrame, by: Sequence[str] = ("period",)) -> DataFrame:
    """Equal-weight mean over entities."""
    key = [*by, "failed_part", "failed_family", "sensor", "z_threshold"]
    clean, isolated = ratio("clean_hits", "clean_rows"), ratio("isolated_hits", "isolated_rows")
    out = effects.groupBy(*key).agg(
        F.count(F.lit(1)).alias("case_assets"),
        F.sum("clean_rows").alias("clean_rows"),
        F.sum("isolated_rows").alias("isolated_rows"),
        F.avg(clean).alias("clean_anomaly_rate"),
        F.avg(isolated).alias("isolated_anomaly_rate"),
        F.avg("median_clean").alias("median_abs_z_clean"),
        F.avg("median_isolated").alias("median_abs_z_isolated"),
        F.avg("delta").alias("cliffs_delta"),
    )
    return out.withColumn("anomaly_rate_diff_pp", (F.col("isolated_anomaly_rate") - F.col("clean_anomaly_rate")) * 100)


BLOCK = 1024  # entities redrawn together, about


def _named(values: Sequence) -> int:
    return zlib.crc32("|".join(str(v) for v in values).encode())


def _hits(rng: np.random.Generator, rows: np.ndarray, hits: np.ndarray, samples: int) -> np.ndarray:
    """Hit rates of each entity's resampled days (entities x redraws): a resampled 0/1 vector is a binomial count.

    Entities with the same counts look their draws up in one distribution function; where no day or every day is a hit,
    each resample has the same rate.
    """
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, rows.max() + 1)))])  # of factorials
    out = np.repeat((hits / rows)[:, None], samples, axis=1)
    pairs, place = np.unique(np.stack([rows, hits]), axis=1, return_inverse=True)
    order = np.argsort(place.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(place.ravel(), minlength=pairs.shape[1]))
    for (n, k), start, end in zip(pairs.T.tolist(), [0, *ends[:-1]], ends):
        if 0 < k < n:
            chances = np.exp(logs[n] - logs[: n + 1] - logs[n::-1] + np.arange(n + 1) * np.log(k / n) + np.arange(n, -1, -1) * np.log1p(-k / n))
            upto = np.cumsum(chances)
            out[order[start:end]] = np.searchsorted(upto / upto[-1], rng.random((end - start, samples)), side="right") / n
    return out


def _shares(key: Sequence[str], samples: int, seed: int):
    """How many of a redraw's picks fall on each block of a group, for all blocks at once."""

    def run(group, table):
        table = table.sort_by("block")
        sizes, named = table.column("size").to_numpy(), _named([v.as_py() for v in group])
        picks = np.random.default_rng([seed, named]).multinomial(sizes.sum(), sizes / sizes.sum(), samples).T.astype(np.int32)
        lists = pa.ListArray.from_arrays(np.arange(0, picks.size + 1, samples, dtype=np.int32), picks.ravel())
        return table.select([*key, "block"]).append_column("shares", lists)

    return run


def _block_means(key: Sequence[str], samples: int, seed: int):
    """Per block of a group's entities, the summed rate differences of each redraw, as one array."""

    def run(group, table, dealt):
        table = table.sort_by([(c, "ascending") for c in ("_entity", "isolated_rows", "isolated_hits", "clean_rows", "clean_hits")])
        n1, k1, n2, k2 = (table.column(c).to_numpy().astype(np.int64) for c in ("isolated_rows", "isolated_hits", "clean_rows", "clean_hits"))
        shares = dealt.column("shares")[0].values.to_numpy()
        *values, block = (v.as_py() for v in group)
        rng = np.random.default_rng([seed, _named(values), 1 + block])
        diff = _hits(rng, n1, k1, samples) - _hits(rng, n2, k2, samples)
        # Each pick takes any entity of the block alike; picks of one redraw stand together.
        picked = np.repeat(np.arange(samples), shares) + rng.integers(0, len(n1), shares.sum()) * samples
        times = np.bincount(picked, minlength=diff.size).reshape(diff.shape)  # entities x redraws
        sums = np.einsum("es,es->s", times, diff)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in key}, "size": [len(n1)], "block": [block], "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    return run


def bootstrap(effects: DataFrame, samples: int = RESAMPLES, seed: int = 42, by: Sequence[str] = ("period",), entity: str = "entity") -> DataFrame:
    """Two-stage interval of the rate difference: days within an entity, then entities.

    Seeds come from the row's own key, so the result does not depend on the partitioning. A group's entities are dealt
    into blocks by hash; how many picks of each redraw fall on a block is drawn once a group, and a block makes all
    redraws at once as a matrix and yields one array of sums, so no row is made per redraw, and a group of any size is
    worked on by many tasks. ``effects`` is read three times and should be written.
    """
    key = [*by, "failed_part", "sensor", "z_threshold"]
    narrow = effects.select(*key, F.col(entity).cast("string").alias("_entity"), "isolated_rows", "isolated_hits", "clean_rows", "clean_hits")
    # A group whose key is NULL is a group like any other. A row per group, written so that it is known to be small.
    whole = materialize(narrow.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks")))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    parts = narrow.join(whole, same).withColumn("block", F.pmod(F.xxhash64("_entity"), F.col("_blocks"))).drop("_blocks", *whole.columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*key).schema.fields)
    sizes = parts.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("size"))
    shares = sizes.groupBy(*key).applyInArrow(_shares(key, samples, seed), f"{kinds}, block long, shares array<int>")
    blocks = parts.groupBy(*key, "block").cogroup(shares.groupBy(*key, "block")).applyInArrow(_block_means(key, samples, seed), f"{kinds}, size long, block long, sums array<double>")

    def interval(group, table):
        # An array per block: a few numbers for every thousand entities.
        sums = np.array(table.sort_by("block").column("sums").to_pylist()).sum(axis=0)
        pp = sums / sum(table.column("size").to_pylist()) * 100
        low, high = np.percentile(pp, [2.5, 97.5])
        return pa.table({**{k: table.column(k).slice(0, 1) for k in key}, "ci_low_pp": [float(low)], "ci_high_pp": [float(high)]})

    return blocks.groupBy(*key).applyInArrow(interval, f"{kinds}, ci_low_pp double, ci_high_pp double")


def with_status(summary: DataFrame, intervals: DataFrame, by: Sequence[str] = ("period",)) -> DataFrame:
    key = [*by, "failed_part", "sensor", "z_threshold"]
    out = summary.join(intervals, key, "left")
    return out.withColumn("candidate_status", candidate_status("isolated_rows", "anomaly_rate_diff_pp", "ci_low_pp"))


def direction(results: DataFrame, periods: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """Does the difference keep its sign over the periods? A mixed sign overrides the status."""
    key = ["failed_part", "sensor", "z_threshold"]
    seen = F.col("period").isin(*periods) & (F.col("isolated_rows") > 0) & F.col("anomaly_rate_diff_pp").isNotNull()
    sign = F.signum("anomaly_rate_diff_pp")
    per = results.groupBy(*key).agg(
        F.count(F.when(seen, F.lit(1))).alias("_n"),
        F.max(F.when(seen & (sign != 0), sign)).alias("_hi"),
        F.min(F.when(seen & (sign != 0), sign)).alias("_lo"),
    )
    status = F.when(F.col("_n") < 2, "too_few_periods").when(F.coalesce(F.col("_hi") == F.col("_lo"), F.lit(True)), "consistent").otherwise("mixed")
    out = results.join(per.select(*key, status.alias("direction_status")), key)
    if "candidate_status" not in results.columns:
        return out
    mixed = (F.col("direction_status") == "mixed") & (F.col("candidate_status") != "small_sample")
    return out.withColumn("candidate_status", F.when(mixed, "mixed").otherwise(F.col("candidate_status")))


def part_profile(days: DataFrame, parts: Sequence[str], entity: str = "entity") -> DataFrame:
    """Isolated days and entities per period and part, with the clean and multiple days around them."""
    isolated = F.col("status") == "isolated"
    per_period = days.groupBy("period").agg(
        F.count(F.when(F.col("status") == "clean", F.lit(1))).alias("all_clean_rows"),
        F.count(F.when(F.col("status") == "multiple", F.lit(1))).alias("multiple_rows_excluded"),
    )
    per_part = (
        days.filter(isolated)
        .groupBy("period", F.col("failed_part").alias("part"))
        .agg(F.count(F.lit(1)).alias("isolated_rows"), F.countDistinct(entity).alias("case_assets"), F.max("failed_family").alias("family"))
    )
    grid = per_period.withColumn("part", F.explode(F.array(*[F.lit(p) for p in parts])))
    out = grid.join(per_part, ["period", "part"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("isolated_rows", "case_assets")})
