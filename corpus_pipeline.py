"""From raw documents to tokens: five stages, each one operator of ``gearwatch.llm``.

``run`` writes the result of each stage as Parquet to the shared folder and reads
it again as the documents of the next stage. All stages but the last return the
columns of the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearwatch.llm import bpe, jaccard, language, mixing, substrings
from gearwatch.llm.common import packed, unpacked
from gearwatch.session import checkpoint_dir

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
LEAST_LANGUAGE_SCORE = 0.4


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: texts without a language, or with no language that prevails, go."""
    found = language.identify(docs, language.train(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: of each group of linked documents the one of smallest id stays.

    Of repeated rows of that id one stays; documents without an id take no part and stay.
    """
    groups = jaccard.near_duplicates(docs)
    stays = groups.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = packed(docs)
    kept = rows.join(stays, "id", "left_semi")
    first = kept.groupBy("id").agg(F.min_by(F.struct("text", "rest"), F.coalesce("text", F.lit(""))).alias("x")).select("id", "x.*")
    return unpacked(first.union(rows.where("id IS NULL")), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated passages go; a text that has any is left with its other words, joined by a space.

    A document whose words all go stays with an empty text.
    """
    out = substrings.remove_repeats(packed(docs), keep_unchanged=True)
    columns = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs, **columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mix: a row for each time that a document is taken; where a source's target ends inside a text, its first words."""
    cut = mixing.mixed_texts(packed(docs), mixing.mix(docs)[1])
    columns = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unpacked(cut, docs, **columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: adds the token ids, their number, and whether they decode to the text."""
    tokenizer = bpe.load(spark, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return bpe.encode(docs, tokenizer, checked=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identified),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

ORACLE_SQL = None  # language identification is a trained model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
