"""Tokenizer, fingerprints, language id, mix, packing, rollups, resampling and search."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from gearwatch.llm import bpe, catalog, ctph, language, mixing, packing, resample, rollup, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType())]
    + [StructField(n, StringType()) for n in ("id", "size", "row", "unit", "rank", "key")]
)
ODD = ["", None, " ", "a", "a", "É ß  \n\n x", "x" * 5000, "🎉🎉 don't 12345", "one two " * 3000, "\x1c\x85 \t"]


def frame(spark, rows):
    """(doc_id, text, lang, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], DOCS).repartition(3)


def odd_rows():
    return [(k, t, "en", None if k % 3 else "s") for k, t in enumerate(ODD)] + [(None, "null id", None, None), (3, "a", "en", None)]


# --- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path(catalog.RANK_FILE))
    return bpe.Tokenizer(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(encoding):
    own, other = encoding
    rnd = random.Random(3)
    kinds = [lambda: chr(rnd.randrange(32, 127)), lambda: chr(rnd.randrange(160, 0x2FFF)), lambda: chr(rnd.randrange(0x1F300, 0x1F6FF)), lambda: rnd.choice(" \n\t\r\x85  ")]
    texts = ["".join(rnd.choice(kinds)() for _ in range(rnd.randrange(60))) for _ in range(1500)] + ["ab" * 20_000, " " * 500, "\n \n  x"] + [t or "" for t in ODD]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text), text[:80]
        assert own.decode(ids) == text.encode()


def test_perfect_hash_is_minimal(encoding):
    own, _ = encoding
    assert sorted(own.hash.slot(t) for t in own.ranks) == list(range(len(own.ranks)))


def test_bpe_query(spark, encoding):
    _, other = encoding
    tokenizer = bpe.load(spark, public_tokenizers.path(catalog.RANK_FILE), public_tokenizers.PATTERN)

    def want(rows):
        out = []
        for i, t in rows:
            ids = other.encode_ordinary(t or "")
            out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        return sorted(out, key=str)

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted((tuple(r) for r in catalog.op10_byte_level_bpe(spark, SF).collect()), key=str) == want([tuple(r) for r in docs.collect()])
    odd = odd_rows()
    assert sorted((tuple(r) for r in bpe.round_trip_digests(frame(spark, odd), tokenizer).collect()), key=str) == want([r[:2] for r in odd])
    back = bpe.decode(bpe.encode(frame(spark, odd), tokenizer), tokenizer).select("text", "decoded").collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert bpe.round_trip_digests(frame(spark, []), tokenizer).count() == 0


# --- fingerprints


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_edit_similarity():
    rnd = random.Random(4)
    pairs = [("".join(rnd.choice("abcd") for _ in range(rnd.randrange(65))), "".join(rnd.choice("abcd") for _ in range(rnd.randrange(65)))) for _ in range(300)]
    got = ctph._edit_similarity([a for a, _ in pairs], [b for _, b in pairs])
    want = [1 - levenshtein(a, b) / max(len(a), len(b), 1) for a, b in pairs]
    assert np.allclose(got, want)


def test_fingerprints_depend_on_the_text_alone():
    texts = [t or "" for t in ODD] * 2
    one_by_one = [ctph.fingerprints(pa.array([t]))[0] for t in texts]
    assert ctph.fingerprints(pa.array(texts)) == one_by_one
    assert all(len(x.split(":")[1]) <= ctph.LENGTH for x in one_by_one)


def brute_edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        f, fe, fn = ctph.fingerprints(pa.array([t, e, n], pa.string()))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, fe, *ctph.likeness([f, f], [fe, fn]).tolist()))
    return sorted(out, key=str)


def test_fingerprint_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.op4_document_fingerprints(spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_edited(rows)
    assert sum(r["near_edited"] for r in got) / len(got) > 5 * sum(r["near_next"] for r in got) / len(got)
    odd = odd_rows()
    assert sorted((tuple(r) for r in ctph.edited_and_next(frame(spark, odd)).collect()), key=str) == brute_edited([r[:2] for r in odd])
    assert ctph.edited_and_next(frame(spark, [])).count() == 0
    assert sorted((tuple(r) for r in ctph.edited_and_next(frame(spark, odd[:1])).collect()), key=str) == brute_edited([odd[0][:2]])


# --- language identification


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(0)
    score, step = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3))
    length = np.array([5, 3, 1])
    post, expected = language.forward_backward(score, step, length, steps=True)
    total = np.zeros((3, 3))
    for c, n in enumerate(length):
        weight = {y: math.exp(sum(score[c, t, y[t]] for t in range(n)) + sum(step[y[t], y[t + 1]] for t in range(n - 1))) for y in itertools.product(range(3), repeat=int(n))}
        z = sum(weight.values())
        for t in range(n):
            assert np.allclose(post[c, t], [sum(w for y, w in weight.items() if y[t] == k) / z for k in range(3)])
        for y, w in weight.items():
            for t in range(n - 1):
                total[y[t], y[t + 1]] += w / z
    assert np.allclose(expected, total)


def test_language_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = catalog.op2_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in unseen) >= 0.97 * len(unseen)


def test_words_of_mixed_text_and_odd_rows(spark):
    words = {"en": ["the", "and", "thing", "there", "which"], "de": ["der", "und", "ding", "nicht", "auch"]}
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(80)), lang, None) for i in range(40) for lang in [rnd.choice(["en", "de"])]]
    docs = frame(spark, rows)
    model = language.train(docs)
    features = language.Features(pa.array(["the and thing there which the and " + "der und ding nicht auch der und"]))
    best = language.word_posteriors(model, features).argmax(axis=1)
    assert [model.languages[b] for b in best] == ["en"] * 7 + ["de"] * 7
    assert all(model.step[i, i] > model.step[i, 1 - i] for i in range(2))
    odd = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame(spark, odd_rows()), model).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[9] == ("und", 0.0) and odd[3][0] in ("en", "de")
    assert language.train(frame(spark, [])) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


# --- mix


def brute_mix(rows):
    sized = [(i, s, len(WORD.findall(t or "")), hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()) for i, t, _, s in rows]
    names = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, x, n, _ in sized if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(size.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 3 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in full}
        rest -= sum(3 * size[s] for s in full)
        free -= full
    return size, target


@pytest.mark.parametrize("block", [7, 1024])
def test_mix_meets_its_targets(spark, block):
    rnd = random.Random(block)
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(0, 90))), "en", rnd.choice(["a", "b", "é", None, "hot", "hot", "hot", "tiny"] if i else ["tiny"])) for i in range(300)]
    rows = [r for r in rows if r[3] != "tiny" or r[0] < 9]
    size, target = brute_mix(rows)
    got = mixing.taken(frame(spark, rows), block=block).collect()
    source = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
    for s in size:
        assert abs(sum(r["taken"] for r in got if source[r["doc_id"]] == s) - target[s]) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.taken(frame(spark, rows[::-1]), block=block).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mix_spreads_sources_over_the_schedule(spark):
    rows = [(i, "w " * 50, "en", "abc"[i % 3]) for i in range(600)]
    _, runs = mixing.mix(frame(spark, rows), block=50)
    slots = runs.where("slot IS NOT NULL").select("slot", "source").distinct().orderBy("slot").collect()
    for low in range(0, 500, 60):
        part = [r["source"] for r in slots[low : low + 60]]
        assert abs(part.count("a") - 10) <= 4 and abs(part.count("c") - 30) <= 4
    assert runs.where("slot IS NULL").count() <= 6


def test_mix_of_odd_rows(spark):
    got = mixing.taken(frame(spark, odd_rows())).collect()
    size, target = brute_mix(odd_rows())
    assert len(got) == len(odd_rows()) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum(target.values())) <= 2
    assert mixing.taken(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.taken(frame(spark, [(1, None, None, None)])).collect()] == [0]


# --- packing


def test_packing_balances_and_numbers(spark):
    got = catalog.op6_shard_packing(spark, "/root/testdata/sf0.01").toPandas()
    text = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    assert len(got) == len(text)
    both = got.merge(text, on="doc_id")
    assert (both["size"] == both["text"].map(lambda t: len(t.encode()) + 16)).all() and (both["text_crc32"] == both["text"].map(lambda t: zlib.crc32(t.encode()))).all()
    for column in ("size", "tokens"):
        sums = got.groupby("shard")[column].sum()
        assert len(sums) == 40 and sums.max() < 1.12 * sums.min()
    assert got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert got["grown_shard"].isna().all() and set(got["law"]) == {"bytes"}


def test_packing_keeps_groups_and_splits_a_hot_one(spark):
    rows = [(i, "hot text " * 20, "en", None) for i in range(400)] + [(1000 + i, f"own text {i % 300} " * 9, "en", None) for i in range(600)]
    got = packing.pack(frame(spark, rows), shards=5, parcels=16).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() < 1.1 * sums.min()
    own = got[got["doc_id"] >= 1000].assign(t=lambda d: (d["doc_id"] - 1000) % 300)
    assert (own.groupby("t")["shard"].nunique() == 1).all()
    assert packing.pack(frame(spark, [])).count() == 0
    odd = packing.pack(frame(spark, odd_rows()), shards=3).toPandas()
    assert len(odd) == len(odd_rows()) and odd.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert odd.loc[odd["doc_id"] == 1, ["size", "text_crc32"]].values.tolist() == [[16, 0]]


# --- rollups


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    store = rollup.Rollup(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    schema = "source string, lang string, tokenizer string, tokens long"
    rows = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", None), (None, "de", "v1", 7), ("hot", None, "v1", 1)], schema)
    key = {c: F.col(c) for c in ("source", "lang", "tokenizer", "tokens")}
    assert store.commit("one", rows.select(*rollup.change("insert", new=key)))
    assert not store.commit("one", rows.select(*rollup.change("insert", new=key)))
    newer = {**key, "tokenizer": F.lit("v2"), "tokens": F.col("tokens") + 1}
    assert store.commit("two", rows.where("source = 'a'").select(*rollup.change("revise", new=newer, old=key)))
    assert store.commit("three", rows.where("source IS NULL").select(*rollup.change("delete", old=key)))
    want = {("a", "en", "v1", 0, 0), ("a", "en", "v2", 2, 6), (None, "de", "v1", 0, 0), ("hot", None, "v1", 1, 1)}
    assert {tuple(r) for r in store.totals().collect()} == want
    # A second attempt at a batch that ran at the same time is not counted, nor is one that was broken off.
    rollup.signed(rows.select(*rollup.change("insert", new=key))).write.parquet(f"{store.folder}/amounts/zz")
    assert {tuple(r) for r in store.totals().collect()} == want
    store._publish([("one", "zz", f"{store.folder}/amounts/zz")])
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert {tuple(r) for r in store.totals().collect()} == want
    assert not store.commit("two", rows.select(*rollup.change("insert", new=key))) and store.commit("four", rows.where("false").select(*rollup.change("insert", new=key)))
    assert {tuple(r) for r in store.totals().collect()} == want


# --- resampling


def test_resampling_prefers_good_text_and_draws_exactly(spark, monkeypatch):
    monkeypatch.setattr(resample, "NARROW", 20)
    rows = catalog.op8_importance_resampling(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == docs and sum(r["selected"] for r in rows) == round(resample.SHARE * docs)
    limit = min(r["key"] for r in rows if r["selected"])
    assert all(r["key"] <= limit for r in rows if not r["selected"])
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = ([r["log_ratio"] for r in rows if quality.get(r["doc_id"]) == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_resampling_weights_equal_brute_force(spark):
    rows = [(i, t, "en", None) for i, t in enumerate(["a b a", "b c", "a a a b", "", None, "C c c"])]
    labels = spark.createDataFrame([(0, 1), (2, 1), (1, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in resample.resample(frame(spark, rows), labels, share=0.5).collect()}

    def bucket(texts):
        out = np.ones(resample.BUCKETS)
        for t in texts:
            _, one, two = resample._features(pa.array([t]))
            for b in [*one, *two[two >= 0]]:
                out[b] += 1
        return np.log(out / out.sum())

    ratio = bucket(["a b a", "a a a b"]) - bucket([r[1] for r in rows])
    for i, t, _, _ in rows:
        _, one, two = resample._features(pa.array([t]))
        seen = [*ratio[one], *ratio[two[two >= 0]]]
        assert got[i]["log_ratio"] == pytest.approx(np.mean(seen) if seen else 0.0)
    assert sum(r["selected"] for r in got.values()) == 3
    assert resample.resample(frame(spark, []), labels).count() == 0
    assert len(resample.resample(frame(spark, odd_rows()), labels.where("false")).collect()) == len(odd_rows())
    assert sum(r["selected"] for r in resample.resample(frame(spark, [(5, "same", None, None)] * 9), labels, share=0.34).collect()) == 9


# --- search


def brute_top(rows, k=5, every=50):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in usable if i % every == 0}:  # rows of one id are one query
        own = [v for j, v in usable if j == i]
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for v in own for j, w in usable if j != i and len(w) == len(v))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_search_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in catalog.op9_exact_top_k(spark, SF).collect()) == brute_top(rows)


def test_search_of_ties_tiles_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 5)
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "FAN", 2)
    rnd = random.Random(6)
    rows = [(i * 5, [rnd.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(3)]) for i in range(80)]
    rows += [(50, [1.0, 1.0, 1.0]), (1, None), (2, [None, 1.0, 1.0]), (3, [float("nan")] * 3), (4, [float("inf"), 0.0, 0.0]), (None, [1.0] * 3), (100, [1.0]), (101, [2.0]), (150, []), (7, [1e30, 0.0, 0.0])]
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("size", IntegerType()), StructField("shard", StringType())])
    make = lambda rs: spark.createDataFrame([(i, v, 1, "x") for i, v in rs], schema)
    got = sorted(tuple(r) for r in topk.top_k(make(rows)).collect())
    assert got == brute_top(rows)
    assert topk.top_k(make([])).count() == 0 and topk.top_k(make([(50, [1.0])])).count() == 0
