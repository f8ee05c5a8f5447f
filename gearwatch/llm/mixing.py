"""Mixing sources to target weights by a low-discrepancy schedule.

Sources are taken in code point order, the null source last, with weights that repeat
(1, 2, 3 by default), and share the words of all documents by weight. A source's target
stops at ``most_repeats`` times its own size; what is left over goes to the others by weight.

Schedule. Slot i has the golden-ratio point frac(i phi); cumulated target shares map the
point to a source, so any stretch of the schedule holds the sources in proportion. Slots
are ranked within their source. A source's documents, shuffled by a hash of their id, form
a line of words that repeats; its blocks are equal runs of ``block`` words of that line, the
last one shorter so that the target is met to the word. Slot and block meet on (source,
rank), and only what meets is taken. A stretch of points is not exact: where it holds too few slots of a
source, the schedule closes with the missing ones, and slots beyond a source's last block are left out.

No window spans a source: ranks and places within a source are sums over small cells
plus offsets by cell, so one source may hold any share of the rows. Only tables with a
row per source or a row per (source, cell) are ordered as a whole.

A null text has no words. Rows of one id are told apart by a hash of their text, equal
rows by nothing: they share one line, each with its own words. A document without words
is never taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gearwatch.llm.common import tidy
from gearwatch.llm.words import Words, slices
from gearwatch.session import materialize

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK = 1024  # words of a block
CELL_ROWS = 2000  # documents of a cell, about
CELL_SLOTS = 1 << 14
PHI = 0.6180339887498949
SPAN = 1 << 20
PHI_SPAN = 0.607787409740351  # frac(SPAN * phi), see golden_point


def shuffled(id_col: str, text_col: str):
    """Place of an id in the shuffled order of its source; documents without an id are placed by their text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("t"), F.md5(text))))


def tie(text_col: str):
    return F.crc32(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def word_counts(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(Words(part.column("text")).count, pa.int64())], [*part.schema.names[:-1], "size"])


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, order and size (words) of each document; ``order`` shuffles a source."""
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        shuffled(id_col, text_col).alias("order"),
        tie(text_col).alias("tie"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    return narrow.mapInArrow(word_counts, "id long, source string, order string, tie long, size long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Add ``number``, ``weight``, ``target`` and ``words`` (the target as a whole number) to (source, source_size).

    Sources by ascending size over weight reach their limit first; with the ones before
    it at their limits, a source is at its own limit if its share of the rest is no less.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.withColumn("number", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    )
    limit = F.col("source_size") * most_repeats
    ordered = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(upto), F.lit(0))) / F.sum("weight").over(after)
    filled = numbered.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= limit)
    # The first source that is not full sets the level of all that follow it.
    open_level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything.orderBy(F.col("source_size") / F.col("weight"), "number"))
    target = F.when(F.col("full"), limit.cast("double")).otherwise(open_level * F.col("weight"))
    return filled.withColumn("target", target).select(
        "source", "number", "source_size", "weight", "target", F.least(F.round("target").cast("long"), limit.cast("long")).alias("words")
    )


def golden_point(i):
    """frac(i phi), with the product split so that it stays exact to about 1e-9 for any i below 2^44."""
    high, low = F.floor(i / SPAN), i % SPAN
    return F.pmod(high * F.lit(PHI_SPAN) + low * F.lit(PHI), F.lit(1.0))


def _ranked(df: DataFrame, by: str, cell: str, order: list, amount: str, before: str) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over earlier rows of the same ``by``; cells follow each other."""
    cells = df.groupBy(by, cell).agg(F.sum(amount).alias("_sum"))
    across = Window.partitionBy(by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(by, cell, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(by, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return local.join(offsets, [by, cell]).withColumn(before, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside", cell)


def schedule(spark, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots (slot, number, rank) of the sources in ``goals`` (number, words): one for each block of each source."""
    blocks = goals.where("words > 0").select("number", "words", F.ceil(F.col("words") / block).alias("blocks"))
    seen = blocks.agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")).first()
    n_sources, n_points = seen["n"], -(-(seen["words"] or 0) // block) + 2 * seen["n"]
    cells = 4 * max(1, n_sources)
    until = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.sum("words").over(until) / F.lit(float(seen["words"] or 1))
    share = blocks.select("number", "blocks", high.alias("high"))
    share = share.select("number", "blocks", F.lag("high", 1, 0.0).over(Window.orderBy("number")).alias("low"), "high")
    reach = F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))
    share = share.withColumn("cell", F.explode(reach))
    points = spark.range(n_points).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") * cells))
    mapped = points.join(share, "cell").where("point >= low AND point < high").select("slot", "number", F.lit(1).alias("one"), F.floor(F.col("slot") / CELL_SLOTS).alias("stretch"))
    ranked = _ranked(mapped, "number", "stretch", ["slot"], "one", "rank").select("slot", "number", "rank")
    # What the points leave open is a few slots a source.
    found = mapped.groupBy("number").agg(F.count(F.lit(1)).alias("found"))
    missing = blocks.join(found, "number", "left").withColumn("found", F.coalesce("found", F.lit(0))).where("found < blocks")
    missing = missing.select("number", F.explode(F.sequence(F.col("found"), F.col("blocks") - 1)).alias("rank"))
    closing = missing.select((F.lit(n_points) + F.row_number().over(Window.orderBy("number", "rank")) - 1).alias("slot"), "number", "rank")
    return ranked.join(blocks.select("number", "blocks"), "number").where("rank < blocks").select("slot", "number", "rank").union(closing)


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The documents with size, source_size and target, and the mix itself.

    The mix has a row per run of words: ``slot`` of the schedule, ``rank``
    of the block in its source, ``turn`` of the line, ``start`` of the document on it, id, order, tie and source of the document, ``begin`` and ``length`` of the run in words.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs, **columns))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = materialize(targets(sums.select("source", "source_size"), weights, most_repeats))
    seen = rows.agg(F.count(F.lit(1)).alias("docs")).first()
    n_cells = max(1, seen["docs"] // CELL_ROWS)
    placed = rows.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Cells are ranges of the shuffled order, so the order of cells is that of the rows.
    cell = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.lit(n_cells) / F.lit(1 << 32))
    line = _ranked(placed.withColumn("cell", cell), "number", "cell", ["order", "id", "tie"], "size", "start")
    # The line repeats; the runs of a document that lie before the source's last word are cut into blocks.
    again = F.when((F.col("size") > 0) & (F.col("words") > 0), F.sequence(F.lit(0), F.ceil(F.col("words") / F.greatest("source_size", F.lit(1))).cast("int") - 1))
    turns = line.withColumn("turn", F.explode(again)).withColumn("low", F.col("start") + F.col("turn") * F.col("source_size"))
    turns = turns.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("words"))).where("low < high")
    cut = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    begin, end = F.greatest("low", F.col("rank") * block), F.least("high", (F.col("rank") + 1) * block)
    runs = cut.select("number", "rank", "turn", "start", "id", "order", "tie", "source", (begin - F.col("low")).alias("begin"), (end - begin).alias("length"))
    slots = schedule(spark, goals.select("number", "words"), block)
    mixed = runs.join(slots, ["number", "rank"]).select("slot", "rank", "turn", "start", "id", "order", "tie", "source", "begin", "length")
    return placed.drop("number", "weight", "words"), mixed


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix, repeats counted) and first_slot (null if none)."""
    placed, mixed = mix(docs, **options)
    sums = mixed.groupBy(F.col("id").alias("_id"), F.col("order").alias("_o"), F.col("tie").alias("_t"), F.col("source").alias("_s")).agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"))
    # Equal rows share what was taken of them: each is on the line by itself, so the sum divides among them.
    same = Window.partitionBy("id", "order", "tie", "source")
    counted = placed.withColumn("_n", F.count(F.lit(1)).over(same)).withColumn("_k", F.row_number().over(same.orderBy("size")))
    key = F.col("id").eqNullSafe(F.col("_id")) & (F.col("order") == F.col("_o")) & (F.col("tie") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s"))
    part = F.floor((F.col("taken") + F.col("_n") - F.col("_k")) / F.col("_n"))
    return counted.join(sums, key, "left").select(
        F.col("id").cast(LongType()).alias("doc_id"), "size", "source_size", "target", F.coalesce(part, F.lit(0)).cast("long").alias("taken"), F.col("first_slot").cast("long").alias("first_slot")
    )


def first_words(batches):
    """The texts whole, or their first ``take`` words joined by a space where they have more."""
    for batch in batches:
        for part in slices(batch, "text"):
            text, take = part.column("text"), part.column("take").to_numpy()
            words = Words(text)
            out = text.to_pylist()
            for i in np.flatnonzero(words.count > take):
                low = words.first[i]
                spans = zip(words.start[low : low + take[i]].tolist(), words.end[low : low + take[i]].tolist())
                out[i] = b" ".join(words.data[a:b].tobytes() for a, b in spans).decode()
            columns = [pa.array(out, text.type) if name == "text" else part.column(name) for name in part.schema.names if name != "take"]
            yield pa.RecordBatch.from_arrays(columns, [n for n in part.schema.names if n != "take"])


def mixed_texts(rows: DataFrame, runs: DataFrame, source_col: str = "source") -> DataFrame:
    """Packed documents (id, text, rest) as the mix takes them: one row per document and turn.

    Where a source's target ends inside a text, that row has the first words only. The rows of each file
    follow the schedule.
    """
    same = Window.partitionBy("order", "tie", "source")
    turns = runs.groupBy("order", "tie", "source", "start", "turn").agg(F.sum("length").alias("take"), F.min("slot").alias("slot"))
    turns = turns.withColumn("copy", F.dense_rank().over(same.orderBy("start"))).drop("start", "turn")
    turns = turns.select(*[F.col(c).alias(f"_{c}") for c in turns.columns])
    source = F.col("rest").getField(source_col).cast("string")
    keyed = rows.select("id", "text", "rest", shuffled("id", "text").alias("order"), tie("text").alias("tie"), source.alias("source"))
    keyed = keyed.withColumn("copy", F.row_number().over(same.orderBy("id")))
    # no null in a key that texts are joined by: a null source has a name that no other has
    named = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))
    met = keyed.join(turns, (F.col("order") == F.col("_order")) & (F.col("tie") == F.col("_tie")) & (named("source") == named("_source")) & (F.col("copy") == F.col("_copy")))
    met = met.select("id", "text", "rest", F.col("_take").alias("take"), F.col("_slot").alias("slot")).sortWithinPartitions("slot").drop("slot")
    return met.mapInArrow(tidy(first_words), met.select("id", "text", "rest").schema)
