"""Quality selection by importance resampling.

Words and pairs of words are hashed to a fixed number of buckets. Two generative models,
one of target texts and one of all texts, give each bucket a probability; a document's
weight is the mean log ratio of its features times ``strength``. Documents are drawn
without replacement in proportion to their weights: each weight gets Gumbel noise from a
hash of the id, and the highest ``share`` of all documents is selected.

Target texts are at most ``most_targets`` good labelled documents, lowest hashes first; their
ids are broadcast. The model of all texts counts every document. Both models have a fixed size.
The selection's limit is found by narrowing a range of keys, not by sorting the table.

A null or empty text has no features and weight 0. A null id gets the noise of the word
null; rows of one id get the same noise. Of equal keys the smaller ids are selected, and
rows of equal key and id are selected together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearwatch.llm.words import Words, mix, slices
from gearwatch.session import materialize

BUCKETS = 1 << 14
MOST_TARGETS = 20_000
SHARE = 0.9
STRENGTH = 20.0
NARROW = 50_000  # rows among which the limit is found by a sort


def _features(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, and the buckets of single words and of pairs (the last word of a text has no pair: -1)."""
    words = Words(texts)
    one = words.hashes(lower=True)
    two = words.windows(one, 2)
    last = words.position + 2 > np.repeat(words.count, words.count)
    bucket = lambda h: (mix(h) % np.uint64(BUCKETS)).astype(np.int64)
    pair = bucket(two)
    pair[last] = -1
    return words, bucket(one), pair


def _counts(batches):
    """Bucket counts of all texts and of target texts, one row per bucket and task."""
    total, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            words, one, two = _features(part.column("text"))
            good = np.repeat(np.array(part.column("good").to_pylist(), dtype=bool), words.count)
            for place in (one, two):
                used = place >= 0
                total += np.bincount(place[used], minlength=BUCKETS)
                target += np.bincount(place[used & good], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total), pa.array(target)], ["bucket", "total", "target"])


def log_ratios(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log probability ratio of each bucket, with one count added to each; ``targets`` has the ids (target), bounded in number."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    flagged = source.join(F.broadcast(targets), F.col("id") == F.col("target"), "left").select("text", F.col("target").isNotNull().alias("good"))
    rows = flagged.mapInArrow(_counts, "bucket long, total long, target long").groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("target").alias("target"))
    total, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in rows.collect():  # one row per bucket
        total[r["bucket"]] += r["total"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(total / total.sum())


def weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and log_ratio (mean over the features) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(np.append(ratios, 0.0))  # -1 finds the 0 at the end

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, one, two = _features(part.column("text"))
                total = np.concatenate([[0.0], np.cumsum(shared.value[one] + shared.value[two])])
                n = np.maximum(2 * words.count - 1, 1)
                score = (total[words.first[1:]] - total[words.first[:-1]]) / n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(words.count > 0, score, 0.0))], ["id", "log_ratio"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, "id long, log_ratio double")


def gumbel(ident, seed: int):
    """Standard Gumbel noise from a hash of the id."""
    u = (F.pmod(F.xxhash64(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def limit_of_top(rows: DataFrame, k: int) -> tuple[float, int | None]:
    """Key and id of the k-th row by descending key, then ascending id, nulls last (k from 1 to the number of rows)."""
    while True:
        n = rows.count()
        if n <= NARROW:
            last = rows.orderBy(F.desc("key"), F.col("id").asc_nulls_last()).limit(k).orderBy(F.asc("key"), F.col("id").desc_nulls_first()).first()
            return last["key"], last["id"]
        share = 1 - k / n
        low, high = rows.agg(F.percentile_approx("key", [max(0.0, share - 0.01), min(1.0, share + 0.01)], 10_000).alias("q")).first()["q"]
        above = rows.where(F.col("key") > high).count()
        inside = rows.where((F.col("key") >= low) & (F.col("key") <= high))
        size = inside.count()
        if not above < k <= above + size or size == n:  # one key holds nearly all rows: the ids decide
            last = rows.orderBy(F.desc("key"), F.col("id").asc_nulls_last()).offset(k - 1).first()
            return last["key"], last["id"]
        rows, k = inside, k - above


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, strength: float = STRENGTH, most_targets: int = MOST_TARGETS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, log_ratio, key and selected (true for the highest ``share`` of keys)."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("target")).distinct()
    targets = good.orderBy(F.xxhash64("target"), "target").limit(most_targets)
    ratios = log_ratios(docs, targets, id_col, text_col)
    keyed = weights(docs, ratios, id_col, text_col).withColumn("key", F.col("log_ratio") * strength + gumbel(F.col("id"), seed))
    keyed = materialize(keyed)
    k = round(share * keyed.count())
    if k == 0:
        selected = F.lit(False)
    else:
        key, ident = limit_of_top(keyed.select("key", "id"), k)
        tie = F.lit(True) if ident is None else F.coalesce(F.col("id") <= ident, F.lit(False))
        selected = (F.col("key") > key) | ((F.col("key") == key) & tie)
    return keyed.select(F.col("id").alias("doc_id"), "log_ratio", "key", selected.alias("selected"))
