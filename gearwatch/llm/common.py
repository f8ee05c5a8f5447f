"""Reading, packing and slicing shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearwatch.llm.words import slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text`` and ``rest``, a struct of all other columns, so no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"),
    )


def unpacked(df: DataFrame, like: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The columns of ``like`` in their order from packed rows; ``columns`` replaces some of them."""
    values = {id_col: F.col("id"), text_col: F.col("text"), **columns}
    return df.select(*[values.get(c, F.col("rest").getField(c)).alias(c) for c in like.columns])


def sliced(column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for mapInArrow, applied to slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield fn(part)

    return run


def give_back() -> None:
    """Return freed memory to the machine; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None):
    """``run`` for mapInArrow; when a task ends, ``forget`` is called and freed memory returned."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return tidied
