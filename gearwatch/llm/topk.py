"""Exact top-k search by inner product over tiles.

Vectors become integers, floor(scale * x). Queries are packed into blocks and all
vectors into shards, each a matrix. Every block meets every shard once, over a merge join on the shard: a block
is repeated for every shard, which the planner's sizes do not know, so it must not choose to broadcast either side.
A tile is one matrix product, of which each query keeps its best k, and the short
lists are merged level by level in a tree, so no task sees more than ``FAN`` lists of
a query. Work is queries x vectors; a task holds one tile.

Products are exact: in double precision while every sum stays below 2^53, else in
unlimited integers; a score beyond 64 bits is held at the nearest 64-bit integer, and a
scaled component beyond the largest double at that.

Vectors that are null, or hold a null or a non-finite component, take no part, nor do
rows without an id. Vectors of different length are not compared. A vector is no
candidate for a query of its own id. Equal scores go to the smaller id; candidates of
one id take a rank each, and query rows of one id are one query, answered from the
scores of all its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, SHARD = 512, 4096  # rows in a block of queries and in a shard, about
FAN = 16  # lists merged at once
SCALE = 256
_EXACT = float(1 << 53)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _packed(rows: DataFrame, part: str, scale: int) -> DataFrame:
    """One row per part and vector length: ids and the matrix of the vectors."""

    def run(key, table):
        ids = table.column("id").to_numpy()
        with np.errstate(over="ignore"):
            values = np.floor(scale * table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        values = np.clip(values, -np.finfo(float).max, np.finfo(float).max)
        return pa.table(
            {
                part: pa.array([key[0].as_py()], pa.int64()),
                "size": pa.array([key[1].as_py()], pa.int32()),
                f"{part}_ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                f"{part}_values": pa.array([values.astype(np.float64).tobytes()], pa.binary()),
            }
        )

    return rows.groupBy(part, "size").applyInArrow(run, f"{part} long, size int, {part}_ids binary, {part}_values binary")


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows as 64-bit integers, exactly."""
    with np.errstate(over="ignore"):
        most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if most < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    exact = whole(q) @ whole(c).T
    return np.vectorize(lambda x: min(max(x, _LOW), _HIGH), otypes=[np.int64])(exact)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one row: highest score, then smallest id."""
    if len(score) > k:
        limit = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= limit)
    else:
        at = np.arange(len(score))
    # order by score descending (~ turns the order around without overflow), then id
    return at[np.lexsort((ids[at], ~score[at]))[:k]]


def _tiles(k: int):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]  # one tile at a time in memory
                q_ids, c_ids = (np.frombuffer(row[x], np.int64) for x in ("block_ids", "shard_ids"))
                q = np.frombuffer(row["block_values"]).reshape(len(q_ids), row["size"])
                c = np.frombuffer(row["shard_values"]).reshape(len(c_ids), row["size"])
                out: list[tuple[int, int, int]] = []
                for low in range(0, len(c_ids), SHARD):  # a shard may have come out larger than meant
                    ids = c_ids[low : low + SHARD]
                    scores = _products(q, c[low : low + SHARD])
                    for i, own in enumerate(q_ids.tolist()):
                        other = ids != own
                        score, name = scores[i][other], ids[other]
                        best = _best(score, name, k)
                        out += [(own, int(n), int(s)) for n, s in zip(name[best], score[best])]
                shard = [row["shard"]] * len(out)
                columns = [pa.array(x, pa.int64()) for x in (*(zip(*out) if out else ((), (), ())), shard)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "part"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other vectors of each vector whose id is divisible by ``every``."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).withColumn("size", F.size("v"))
    queries = rows.where(F.col("id") % every == 0)
    counts = rows.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asked")).first()
    n_shards, n_blocks = max(1, -(-counts["all"] // SHARD)), max(1, -(-counts["asked"] // BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")
    shards = _packed(rows.withColumn("shard", dealt(n_shards)), "shard", scale)
    blocks = _packed(queries.withColumn("block", dealt(n_blocks)), "block", scale)
    tiles = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))).hint("merge").join(shards, ["shard", "size"])
    tiles = tiles.select("size", "block_ids", "block_values", "shard", "shard_ids", "shard_values")
    lists = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score long, part long")
    parts = n_shards
    while True:  # ascending by ~score is descending by score
        merged = lists.groupBy("query_id", F.floor(F.col("part") / FAN).alias("part")).agg(
            F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("down"), "vec_id"))), 1, k).alias("best")
        )
        parts = -(-parts // FAN)
        if parts == 1:
            break
        lists = merged.select("query_id", "part", F.inline("best")).select("query_id", "vec_id", F.bitwise_not("down").alias("score"), "part")
    ranked = merged.select("query_id", F.posexplode("best").alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.bitwise_not("hit.down").alias("score"))
