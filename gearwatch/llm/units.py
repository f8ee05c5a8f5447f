"""Units: runs of documents in id order, and hash lists dealt from units to buckets.

A unit holds about ``unit_bytes`` of text and is worked on by one task as numpy
arrays. Units are numbered in id order, so the order of units is the order of
documents. What units must learn of each other goes through buckets: a unit
sends each bucket the distinct hashes of its range as one binary value, so a hash
that fills a unit is sent once, and no row is made per hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = 256  # id quantiles taken; between two of them units are cut evenly
LEAST_UNITS = 48
LEAST_BUCKETS = 64


@dataclass(frozen=True)
class Layout:
    """Number of units and text bytes of a table."""

    units: int
    text_bytes: int

    def buckets(self, bytes_per_text_byte: float, bucket_bytes: int = 16 << 20) -> int:
        """How many buckets keep a bucket near ``bucket_bytes``."""
        return max(LEAST_BUCKETS, -(-int(self.text_bytes * bytes_per_text_byte) // bucket_bytes))


def with_units(df: DataFrame, unit_bytes: int) -> tuple[DataFrame, Layout]:
    """Put the column ``unit`` before the columns ``id``, ``text``, ... of packed documents.

    Reads the ids and text sizes once; the driver gets a sum and a fixed number of
    quantiles. A null id belongs to the last unit.
    """
    seen = df.agg(
        F.sum(F.octet_length("text")).alias("bytes"),
        F.percentile_approx("id", [k / QUANTILES for k in range(QUANTILES + 1)], 10 * QUANTILES).alias("at"),
    ).first()
    total, at = seen["bytes"] or 0, sorted(set(seen["at"] or ()))
    wanted = max(LEAST_UNITS, -(-total // unit_bytes))
    step = max(1, QUANTILES // wanted)
    at = at[::step]
    each = -(-wanted // max(1, len(at)))
    limits = F.array(*[F.lit(x).cast("long") for x in at]) if at else F.array().cast("array<bigint>")
    passed = F.size(F.filter(limits, lambda x: x <= F.col("id")))
    if each > 1:
        low, high = F.element_at(limits, F.greatest(passed, F.lit(1))), F.element_at(limits, F.least(passed + 1, F.lit(len(at))))
        share = (F.col("id") - low).cast("double") / F.greatest(high - low, F.lit(1))
        inside = F.least(F.greatest(F.floor(share * each), F.lit(0)), F.lit(each - 1))
    else:
        inside = F.lit(0)
    last = (len(at) + 1) * each
    unit = F.coalesce(F.when(F.col("id").isNotNull(), passed * each + inside), F.lit(last)).cast("long")
    return df.select(unit.alias("unit"), *df.columns), Layout(last + 1, total)


def bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted distinct hashes; buckets + 1 places."""
    limit = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, limit), [len(hashes)]])


def dealt(unit: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """Rows (bucket, unit, hashes) for sorted distinct hashes; empty buckets get none."""
    at = bounds(hashes, buckets)
    full = np.flatnonzero(np.diff(at))
    return pa.table(
        {
            "bucket": pa.array(full, pa.int64()),
            "unit": pa.array(np.full(len(full), unit), pa.int64()),
            "hashes": pa.array([hashes[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()),
        }
    )


DEALT = "bucket long, unit long, hashes binary"


def met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of one bucket's rows: order by (hash, unit), "as the one before" in that order, sizes by unit, units."""
    table = table.sort_by("unit")
    lists = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    hashes = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[order[1:]] == hashes[order[:-1]]
    return order, again, np.array([len(x) for x in lists]), table.column("unit").to_pylist()


def pieces(values: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Cut values, which follow each other by unit."""
    return iter(np.split(values, np.cumsum(sizes)[:-1]))
