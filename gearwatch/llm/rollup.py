"""Token counts kept up to date by signed changes.

A change inserts a document's count, deletes it, or revises it (new count, or another
source, language or tokenizer version). Each change becomes signed amounts: plus what is
new, minus what was. A batch of changes is summed by source, language and tokenizer
version and written as one small table; totals are the sum over committed batches, so
a change costs its own size and not that of the corpus.

Commits are idempotent. A batch is written to a folder of its own attempt and becomes
visible by one row in the list of commits. A batch that is committed already is not
committed again; if two attempts run at once, all readers use the same one (the least
attempt name). An attempt that was broken off has no row and does not count.

Keys may be null and form groups of their own. A null count is 0. ``compact`` folds all
commits into one; batches keep their names, so they stay committed.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gearwatch.llm import bpe
from gearwatch.llm.common import tidy
from gearwatch.llm.words import slices
from gearwatch.session import materialize

KEYS = ("source", "lang", "tokenizer")
AMOUNTS = ("docs", "tokens")
_COMMITS = "batch string, attempt string, part string"
_DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


def change(op: str, new: dict[str, Column] | None = None, old: dict[str, Column] | None = None) -> list[Column]:
    """Columns of a change: ``op``, and structs ``new`` and ``old`` of source, lang, tokenizer and tokens."""
    kinds = {**{k: "string" for k in KEYS}, "tokens": "long"}
    side = lambda x: F.struct(*[x[k].cast(t).alias(k) for k, t in kinds.items()]) if x else F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,tokens:bigint>")
    return [F.lit(op).alias("op"), side(new).alias("new"), side(old).alias("old")]


def signed(changes: DataFrame) -> DataFrame:
    """Totals of the signed amounts of (op, new, old); groups that come to nothing stay, with zeros."""
    part = lambda name, sign: F.struct(*[F.col(f"{name}.{k}").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("docs"), (F.coalesce(F.col(f"{name}.tokens"), F.lit(0)) * sign).alias("tokens"))
    plus, minus = part("new", 1), part("old", -1)
    parts = F.when(F.col("op") == "insert", F.array(plus)).when(F.col("op") == "delete", F.array(minus)).when(F.col("op") == "revise", F.array(plus, minus))
    rows = changes.select(F.explode(parts).alias("x")).select("x.*")
    return rows.groupBy(*KEYS).agg(*[F.sum(a).cast("long").alias(a) for a in AMOUNTS])


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        # Both tables begin with an empty file, so that there is always something to read.
        path = f"{self.folder}/{name}"
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def commits(self) -> DataFrame:
        """(batch, attempt, part): the attempt of each batch that counts, and the folder with its amounts."""
        all_ = self._table("commits", _COMMITS)
        return all_.groupBy("batch").agg(F.min_by(F.struct("attempt", "part"), F.col("attempt")).alias("x")).select("batch", "x.*")

    def committed(self, batch: str) -> bool:
        return not self.commits().where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if it had been committed before."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        part = f"{self.folder}/amounts/{attempt}"
        signed(changes).repartition(1).write.parquet(part)  # a row per key
        self._publish([(batch, attempt, part)])
        return True

    def _publish(self, rows: list[tuple[str, str, str]]) -> None:
        self.spark.createDataFrame(rows, _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        # A path per commit since the last compaction: a list for the driver, not data.
        parts = sorted({r["part"] for r in self.commits().select("part").distinct().collect() if r["part"]})
        rows = self.spark.read.schema(_DELTAS).parquet(*parts) if parts else self.spark.createDataFrame([], _DELTAS)
        return rows.groupBy(*KEYS).agg(*[F.sum(a).cast("long").alias(a) for a in AMOUNTS])

    def compact(self) -> None:
        """Write the totals as one table that stands for all batches committed so far."""
        attempt = f"-{uuid.uuid4().hex}"  # sorts before all attempts of single batches
        part = f"{self.folder}/amounts/{attempt}"
        batches = [r["batch"] for r in self.commits().select("batch").collect()]
        self.totals().repartition(1).write.parquet(part)
        self._publish([(b, attempt, part) for b in batches])


def measured(docs: DataFrame, tokenizers: dict[str, object], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, a hash of the text, and the text's tokens by each of the (broadcast) tokenizers; written.

    A null text has no tokens; its hash is null.
    """
    text = F.col(f"`{text_col}`").cast("string")
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.md5(text).alias("text_key"),
        text.alias("text"),
    )

    def run(batches):
        counts = bpe.Counts([t.value for t in tokenizers.values()])
        for batch in batches:
            for part in slices(batch, "text"):
                own = [pa.array(x, pa.int64()) for x in counts.count_all(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own], [*part.schema.names[:-1], *[f"tokens_{k}" for k in range(len(own))]])

    schema = StructType([*narrow.schema.fields[:-1], *[StructField(f"tokens_{k}", LongType()) for k in range(len(tokenizers))]])
    return materialize(narrow.mapInArrow(tidy(run), schema))


def copies(rows: DataFrame) -> DataFrame:
    """Add ``copy``: whether a row of an equal text (null texts are equal) has a smaller id, a null id counting as the largest.

    Texts that occur once, most of them, are not joined; a text that fills a third of the rows is one row of the small side.
    Of rows that agree in text and id, all are kept or all are copies.
    """
    first = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("text_key").alias("_key"), "first")
    met = rows.join(first, F.col("text_key").eqNullSafe(F.col("_key")), "left")
    return met.withColumn("copy", F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first"))).drop("_key", "first")
