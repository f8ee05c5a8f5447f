"""Vector bin packing of documents into shards, balanced in bytes, tokens and rows at once.

Documents of equal text are a group and stay together, unless the group is larger than
``LARGEST`` of a shard. Groups are gathered by hash into about ``parcels`` parcels a shard; a group above
the mean parcel is a parcel of its own, and one above the limit is cut by a hash of the ids into as many
parcels as it holds limits, so a group of any size spreads out. Parcels, largest first, go where
the dot product of their vector with the shards' residual capacity is highest, among the shards
that have room for them if any has; then parcels are swapped until the shards' bytes are even.
The number of parcels depends on shards and ``parcels`` only, so their vectors fit any
driver; documents never go there. ``law`` is "bytes": the shards' sizes come out near equal.

Slots number the rows of a shard without gaps: parcel by parcel, by id inside a parcel.

A null text has no bytes and no tokens, and the CRC of no bytes, 0. Null ids come last in
their parcel; repeated rows are rows like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gearwatch.llm.words import Words, slices
from gearwatch.session import materialize

SHARDS = 40
PARCELS = 256  # of each shard
ROW_BYTES = 16
LARGEST = 0.25  # of a mean shard: a group of equal texts above it is cut


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes and ``ROW_BYTES``), crc, key of the text and tokens of each row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text, F.octet_length(text)).alias("key"),
        text.alias("text"),
    )

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = pa.array(Words(part.column("text")).count, pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], tokens], [*part.schema.names[:-1], "tokens"])

    return narrow.mapInArrow(run, "id long, size long, crc long, key long, tokens long")


def place(demand: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each parcel; ``demand`` has a row (bytes, tokens, rows) per parcel."""
    capacity = np.maximum(demand.sum(axis=0) / shards, 1e-9)
    need = demand / capacity
    residual = np.ones((shards, demand.shape[1]))
    out = np.zeros(len(demand), dtype=np.int64)
    for i in np.argsort(-need.max(axis=1, initial=0), kind="stable"):
        worth = residual @ need[i]
        room = (residual >= need[i] - 1e-12).all(axis=1)
        if room.any():
            worth = np.where(room, worth, -np.inf)
        out[i] = int(np.argmax(worth))
        residual[out[i]] -= need[i]
    return out


def evened(demand: np.ndarray, shard: np.ndarray, shards: int, within: float = 0.002) -> np.ndarray:
    """Swap a parcel of the largest shard for a smaller one (or none) of the smallest, while that brings their bytes together.

    Ends when all are ``within`` that share of the mean, no swap helps, or after as many swaps as there are parcels.
    """
    size, out = demand[:, 0], shard.copy()
    total = np.bincount(out, size, minlength=shards)
    for _ in range(len(size)):
        high, low = int(total.argmax()), int(total.argmin())
        gap = total[high] - total[low]
        if gap <= within * total.mean():
            break
        give, take = np.flatnonzero(out == high), np.append(np.flatnonzero(out == low), -1)
        less = np.where(take < 0, 0.0, size[take])
        order = np.argsort(less, kind="stable")
        at = np.clip(np.searchsorted(less[order], size[give] - gap / 2), 0, len(order) - 1)
        near = np.stack([order[at], order[np.maximum(at - 1, 0)]])  # partners that move about half of the gap
        moved = size[give] - less[near]
        best = np.unravel_index(np.abs(moved - gap / 2).argmin(), moved.shape)
        change = moved[best]
        if not 0 < change < gap:
            break
        a, b = give[best[1]], take[near[best]]
        out[a] = low
        if b >= 0:
            out[b] = high
        total[high] -= change
        total[low] += change
    return out


def pack(docs: DataFrame, shards: int = SHARDS, parcels: int = PARCELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), tokens."""
    spark = docs.sparkSession
    rows = materialize(measured(docs, id_col, text_col))
    n_parcels = shards * parcels
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = max(1, total // n_parcels)
    # At most n_parcels groups can be larger than the mean parcel.
    large = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > mean) & (F.col("n") > 1))
    limit = max(1, int(LARGEST * total / shards))
    large = large.select("key", F.least(F.ceil(F.col("bytes") / limit), F.col("n")).cast("long").alias("cuts"))
    cut = F.pmod(F.xxhash64("id", F.lit(7)), F.col("cuts"))
    own = -1 - F.pmod(F.xxhash64("key", cut), F.lit(1 << 62))
    parcel = F.when(F.col("cuts").isNotNull(), own).otherwise(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(n_parcels)))
    dealt = rows.join(F.broadcast(large), "key", "left").withColumn("parcel", parcel).drop("cuts")
    vectors = dealt.groupBy("parcel").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    table = vectors.toPandas().sort_values("parcel", ignore_index=True)  # a row per parcel
    demand = table[["bytes", "tokens", "rows"]].to_numpy(dtype=float)
    table["shard"] = evened(demand, place(demand, shards), shards)
    table["start"] = table.groupby("shard")["rows"].cumsum() - table["rows"]
    fields = ["parcel", "shard", "start"]
    placed = spark.createDataFrame(table[fields].astype("int64"), StructType([StructField(f, LongType()) for f in fields]))
    inside = Window.partitionBy("parcel").orderBy(F.col("id").asc_nulls_last(), "key")
    numbered = dealt.withColumn("place", F.row_number().over(inside) - 1).join(placed, "parcel")
    return numbered.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
