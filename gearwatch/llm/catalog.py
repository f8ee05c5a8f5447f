"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearwatch.llm import align, bpe, ctph, jaccard, language, licenses, mixing, packing, resample, rollup, substrings, topk, whitening
from gearwatch.llm.common import table
from gearwatch.session import checkpoint_dir, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RANK_FILE, FIRST_RANK_FILE = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"
BYTE_LEVEL_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op3_token_count_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's amounts and its group's totals after three batches.

    The batches: all documents by the first tokenizer; all revised to the second one (delivered twice, counted once);
    documents whose text an earlier document has deleted. Per document: doc_id, source, lang, its tokens by
    either tokenizer, whether it was deleted, what it adds to its group in the end, and its group's
    documents and tokens by either tokenizer.
    """
    files = {"byte-bpe-50k": FIRST_RANK_FILE, "byte-bpe-multi-50k": RANK_FILE}
    versions = {name: bpe.load(spark, public_tokenizers.path(file), public_tokenizers.PATTERN, counting=True) for name, file in files.items()}
    rows = materialize(rollup.copies(rollup.measured(table(spark, sf_dir, "documents"), versions)))
    store = rollup.Rollup(spark, f"{checkpoint_dir(spark)}/rollup/{uuid.uuid4().hex}")
    key = {k: F.col(k) for k in ("source", "lang")}
    first, second = [{**key, "tokenizer": F.lit(name), "tokens": F.col(f"tokens_{k}")} for k, name in enumerate(versions)]
    store.commit("load", rows.select(*rollup.change("insert", new=first)))
    revised = rows.select(*rollup.change("revise", new=second, old=first))
    store.commit("revise", revised)
    store.commit("revise", revised)
    store.commit("delete", rows.where("copy").select(*rollup.change("delete", old=second)))
    totals = store.totals().groupBy(F.col("source").alias("_source"), F.col("lang").alias("_lang")).agg(
        *[F.sum(F.when(F.col("tokenizer") == name, F.col(a))).alias(f"group_{a}_{k}") for k, name in enumerate(versions) for a in rollup.AMOUNTS]
    )
    # a row per source and language
    met = rows.join(totals, F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")))
    amount = F.when(F.col("copy"), F.lit(0)).otherwise(F.col("tokens_1")).cast("long")
    return met.select(
        "doc_id", "source", "lang", "tokens_0", "tokens_1", F.col("copy").alias("deleted"), amount.alias("amount"),
        *[f"group_{a}_{k}" for k in range(len(versions)) for a in rollup.AMOUNTS],
    )


@query
def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edited_and_next(table(spark, sf_dir, "documents"))


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


SQL["op5_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS o,
    CAST(len(regexp_extract_all(text, '[^ 	-
]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS number FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM n),
l AS (SELECT (SELECT level FROM f WHERE level * weight < 3 * source_size ORDER BY source_size / weight, number LIMIT 1) AS level),
t AS (SELECT source, source_size, CASE WHEN f.level * weight >= 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE l.level * weight END AS target FROM f, l),
w AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS words, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id) - size AS BIGINT) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
    + greatest(0, least(start + size, words % source_size) - start) END AS BIGINT) AS taken FROM w),
b AS (SELECT source, number, words, (words + 1023) // 1024 AS blocks, CAST(sum(words) OVER (ORDER BY number) AS DOUBLE) / CAST(sum(words) OVER () AS DOUBLE) AS high
    FROM (SELECT t.source, number, CAST(round(target) AS BIGINT) AS words FROM t JOIN n ON t.source IS NOT DISTINCT FROM n.source) WHERE words > 0),
c AS (SELECT *, lag(high, 1, 0.0) OVER (ORDER BY number) AS low FROM b),
e AS (SELECT i AS slot, x - floor(x) AS point FROM (SELECT i, floor(i / 1048576) * CAST(0.607787409740351 AS DOUBLE) + (i % 1048576) * CAST(0.6180339887498949 AS DOUBLE) AS x
    FROM (SELECT unnest(range(CAST((SELECT (sum(words) + 1023) // 1024 + 2 * count(*) FROM b) AS BIGINT))) AS i))),
g AS (SELECT slot, number, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank FROM e JOIN c ON point >= low AND point < high),
h AS (SELECT c.number, unnest(range(CAST(coalesce(f.found, 0) AS BIGINT), CAST(c.blocks AS BIGINT))) AS rank FROM c LEFT JOIN (SELECT number, count(*) AS found FROM g GROUP BY number) f USING (number)),
z AS (SELECT slot, number, rank FROM g UNION ALL SELECT (SELECT count(*) FROM e) + row_number() OVER (ORDER BY number, rank) - 1, number, rank FROM h)
SELECT doc_id, size, source_size, target, taken, CAST(z.slot AS BIGINT) AS first_slot
FROM k LEFT JOIN c ON k.source IS NOT DISTINCT FROM c.source LEFT JOIN z ON taken > 0 AND z.number = c.number AND z.rank = k.start // 1024
"""


@query
def op6_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(table(spark, sf_dir, "documents"))


@query
def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


SQL["op9_exact_top_k"] = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.load(spark, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer)


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


SQL["op12_license_scan"] = licenses.oracle()


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = align.load(spark, public_tokenizers.path(BYTE_LEVEL_FILE), public_tokenizers.path(PIECE_FILE))
    return align.digests(table(spark, sf_dir, "documents"), tokenizers)
