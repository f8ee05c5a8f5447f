"""Texts made to defeat hashes, repeated rows over sources, schedules, whole groups, token totals, many languages, huge numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gearwatch.llm import bpe, catalog, chunks, jaccard, language, mixing, packing, rollup, substrings, topk
from gearwatch.llm.common import packed

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(size):
    bits = [0]
    while len(bits) < size:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [64, 1024, 1 << 19])
def test_words_that_defeat_polynomials_stay_apart(spark, size):
    one, two = thue_morse(size)
    fill = " ".join(f"w{i}" for i in range(40))
    rows = [(1, one), (2, two), (3, f"{one} b c d e"), (4, f"{two} b c d e"), (5, f"{one} {fill}"), (6, f"{two} x {fill}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [1, 2, 3, 4]
    window = " ".join([one] + [f"v{i}" for i in range(19)])
    other = " ".join([two] + [f"v{i}" for i in range(19)])
    docs = spark.createDataFrame([(1, window), (2, other), (3, window)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.removal_digests(docs).collect()} == {1: 0, 2: 0, 3: 20}


def test_windows_of_two_words_in_any_order_stay_apart():
    import pyarrow as pa

    from gearwatch.llm.words import Words

    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("ab") for _ in range(2000)), " ".join(thue_morse(2048)[0]), " ".join(thue_morse(2048)[1]), "", "a b a"]
    words = Words(pa.array(texts))
    for width in (1, 2, 5, 8, 13, 20, 1024):
        seen = {}
        lists = [t.split() for t in texts]
        windows = [tuple(x[i : i + width]) for x in lists for i in range(len(x))]
        for key, h in zip(windows, words.windows(words.hashes(), width).tolist()):
            assert seen.setdefault(key, h) == h
        assert len(set(seen.values())) == len(seen)


# --- mix


def test_mix_stage_keeps_rows_of_one_id_in_two_sources(spark):
    words = " ".join(f"t{i}" for i in range(8))
    rows = [(1, words, "a"), (1, words, "b"), (2, "x y z", None), (2, "x y z", None), (None, "n o", "a"), (None, "p", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, mixed = mixing.mix(docs, block=2)
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += r["length"]
    out = mixing.mixed_texts(packed(docs), mixing.mix(docs, block=2)[1]).select("id", "text", F.col("rest.source").alias("source")).collect()
    got = Counter()
    for r in out:
        got[r["source"]] += len(WORD.findall(r["text"]))
    assert got == taken and set(got) == {"a", "b", None}
    want = {r["source"]: r["target"] for r in mixing.mix(docs, block=2)[0].collect()}
    assert all(abs(got[s] - want[s]) <= 1 for s in want)


def test_mix_takes_what_the_schedule_asks_for(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.taken(docs).collect()}
    assert any(t for t, _ in whole.values()) and all((s is None) == (t == 0) for t, s in whole.values())
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: real(*a).where("false"))
    assert all((r["taken"], r["first_slot"]) == (0, None) for r in mixing.taken(docs).collect())
    monkeypatch.setattr(mixing, "schedule", lambda *a: real(*a).where("rank % 2 = 0"))
    half = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    assert 0 < sum(half.values()) < sum(t for t, _ in whole.values())


def test_schedule_has_one_slot_for_each_block(spark):
    goals = spark.createDataFrame([(0, 10_000), (1, 1), (2, 0), (3, 777)], "number long, words long")
    slots = mixing.schedule(spark, goals, 64).collect()
    by = defaultdict(list)
    for r in slots:
        by[r["number"]].append((r["slot"], r["rank"]))
    assert {n: len(x) for n, x in by.items()} == {0: 157, 1: 1, 3: 13}
    for x in by.values():
        assert [rank for _, rank in sorted(x)] == list(range(len(x)))
    assert len({r["slot"] for r in slots}) == len(slots)


# --- packing


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_registered_packing_keeps_groups_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = catalog.op6_shard_packing(spark, sf).join(docs.select("doc_id", "text"), "doc_id").collect()
    shards, bytes_, total = defaultdict(set), Counter(), Counter()
    for r in rows:
        shards[r["text"]].add(r["shard"])
        bytes_[r["text"]] += r["size"]
        total[r["shard"]] += r["size"]
    limit = packing.LARGEST * sum(total.values()) / 40
    assert all(len(s) == 1 for t, s in shards.items() if bytes_[t] <= limit)
    if sf.endswith("0.01"):
        assert len(total) == 40 and max(total.values()) < 1.03 * sum(total.values()) / 40


def test_placing_follows_the_dot_product():
    rng = np.random.default_rng(2)
    demand = rng.integers(1, 100, (200, 3)).astype(float)
    got = packing.place(demand, 7)
    capacity = demand.sum(axis=0) / 7
    need, residual = demand / capacity, np.ones((7, 3))
    for i in sorted(range(200), key=lambda i: (-need[i].max(), i)):
        fits = [s for s in range(7) if (residual[s] >= need[i] - 1e-12).all()] or list(range(7))
        best = max(fits, key=lambda s: (sum(residual[s] * need[i]), -s))
        assert got[i] == best
        residual[best] -= need[i]


def test_evening_swaps_keep_every_parcel():
    rng = np.random.default_rng(4)
    demand = rng.integers(1, 1000, (300, 3)).astype(float)
    before = packing.place(demand, 9)
    after = packing.evened(demand, before, 9)
    spread = lambda x: np.ptp(np.bincount(x, demand[:, 0], minlength=9))
    assert len(after) == 300 and set(after) <= set(range(9)) and spread(after) <= spread(before) and spread(after) < 0.01 * demand[:, 0].sum() / 9
    assert packing.evened(demand[:0], before[:0], 9).size == 0


# --- token totals


def brute_totals(rows):
    """By document: tokens of both versions, deleted, amount; and totals by source and language."""
    coder = []
    for name in (catalog.FIRST_RANK_FILE, catalog.RANK_FILE):
        ranks = bpe.read_ranks(public_tokenizers.path(name))
        coder.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    first = {}
    for k, text, _, _ in rows:
        if k is not None:
            first[text] = min(first.get(text, k), k)
    times = Counter(r[1] for r in rows)
    out, totals = [], defaultdict(lambda: [0, 0])
    for k, text, lang, source in rows:
        n = [len(c.encode_ordinary(text or "")) for c in coder]
        gone = times[text] > 1 and text in first and k != first[text]
        out.append((k, source, lang, *n, gone, 0 if gone else n[1]))
        total = totals[source, lang]
        if not gone:
            total[0] += 1
            total[1] += n[1]
    return Counter((*r, 0, 0, *totals[r[1], r[2]]) for r in out)


@pytest.mark.parametrize("kind", ["table", "odd", "none"])
def test_token_rollup_equals_a_plain_count(spark, tmp_path, kind):
    if kind == "table":
        folder = SF
    else:
        folder = str(tmp_path)
        rows = [] if kind == "none" else [(5, None, "en", "s"), (3, None, "en", "s"), (4, None, "de", None), (None, None, None, None), (7, "a b", "en", "s"), (None, "a b", "en", "s"), (7, "a b", "en", "s"), (None, "lone", "x", "y"), (8, "", "en", "s"), (9, "word " * 50_000, "en", "s")]
        spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lang string, source string, copy string, tokens_0 long").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source")
    got = Counter(tuple(r) for r in catalog.op3_token_count_rollup(spark, folder).collect())
    assert got == brute_totals([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("limit", [0, 20_000, 1 << 30])
def test_counts_equal_the_library_and_leave_the_heap_to_long_words(monkeypatch, limit):
    """Words met for the first time are merged side by side, for all vocabularies at once; what is remembered stays bounded."""
    monkeypatch.setattr(chunks, "MEMO_BYTES", limit)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aab eé's\n\t 12漢🙂.,▁\x00\x1c\x85\u180e\u200b\u3000") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += [" ".join("".join(rnd.choices("etaoinshrd", k=9)) for _ in range(300)) for _ in range(3)]
    texts += [None, "", " ", "  ", " a  b ", "a" * 300, "ab" * 3000, "don't", "<|endoftext|> x"]
    ranks = [bpe.read_ranks(public_tokenizers.path(name)) for name in (catalog.FIRST_RANK_FILE, catalog.RANK_FILE, catalog.RANK_FILE)]
    patterns = [public_tokenizers.PATTERN, public_tokenizers.PATTERN, r"\S+ ?|\s+"]
    heap, merge = [], bpe.Tokenizer.merge
    monkeypatch.setattr(bpe.Tokenizer, "merge", lambda self, piece: heap.append(len(piece)) or merge(self, piece))
    counts = bpe.Counts([bpe.Tokenizer(r, p, counting=True) for r, p in zip(ranks, patterns)])
    library = [tiktoken.Encoding("own", pat_str=p, mergeable_ranks=r, special_tokens={}) for r, p in zip(ranks, patterns)]
    for low in range(0, len(texts), 50):
        part = texts[low : low + 50]
        found = counts.count_all(part)
        assert [x.tolist() for x in found] == [[len(c.encode_ordinary(t or "")) for t in part] for c in library]
        if not limit:
            assert all(known.bytes <= 300 * sum(len(t or "") + 1 for t in part) for known, _ in counts.known.values())
    assert min(heap) > bpe.BLOCK_LONGEST


def test_counts_of_a_vocabulary_whose_parts_have_no_rank():
    ranks = {bytes((b,)): b for b in range(256)} | {b"ab": 300, b"abc": 300}
    own = bpe.Tokenizer(ranks, public_tokenizers.PATTERN, counting=True)
    assert own.pairs is None and [x.tolist() for x in bpe.Counts([own]).count_all(["abcabc", "ab", None])] == [[len(own.merge(b"abcabc")), 1, 0]]


@pytest.mark.parametrize("text", ["a", " a", "a b", " a  b ", "a\n b", "x▁ y", "x ▁y z", "a \x1c b", "\n", " "])
def test_chunks_joined_are_the_text(text):
    assert " ".join(chunks.cut(text)) == text and all(chunks.cut(text))


# --- languages, tokens, search


def test_seventy_languages(spark):
    rows = [(i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in "qwertz" * 4), f"l{k:02d}") for k in range(70) for i in range(k * 6, k * 6 + 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) == 70
    got = language.identify(docs, model).select("row.lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.9 * len(got)


def test_training_texts_are_bounded_in_bytes(spark):
    rows = [(i, "lang " * 1000 if i % 2 else "wort " * 1000, "a" if i % 2 else "b") for i in range(40)] + [(99, "x" * 50_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = language.fit
    try:
        language.fit = lambda texts, labels: seen.append((texts, labels)) or real(texts, labels)  # in this process only
        model = language.train(docs, fit_bytes=12_000)
    finally:
        language.fit = real
    assert model.languages == ["a", "b", "c"]


def test_another_pattern_is_matched_whole():
    ranks = bpe.read_ranks(public_tokenizers.path(catalog.RANK_FILE))
    pattern = r"\S+ ?|\s+"
    own, other = bpe.Tokenizer(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("hello wide world", " a  b ", "x"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_encoding_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "a b", "old", 5, "c")], "doc_id long, text string, token_ids string, n_tokens long, c0 string")
    out = pipeline.encoded(spark, docs, SF)
    assert out.columns == ["doc_id", "text", "c0", "token_ids", "n_tokens", "round_trip"]
    row = out.first()
    assert row["c0"] == "c" and row["round_trip"] and row["n_tokens"] == len(row["token_ids"]) // 4


def test_memory_of_the_memo_is_bounded():
    memo = bpe.Memo(str.encode, 100_000)
    for i in range(5000):
        assert memo[f"k{i}"] == f"k{i}".encode()
    assert len(memo) + len(memo.old) < 600 and memo["x" * 10_000] and "x" * 10_000 not in memo
    memo.forget()
    assert not memo and not memo.old


def test_search_with_components_beyond_what_scales(spark):
    rows = [(0, [1e308, 1.0]), (1, [1e308, 0.0]), (2, [-1e308, 2.0]), (50, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    best = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    assert best[0, 1] == (1, (1 << 63) - 1) and best[0, 3] == (2, -(1 << 63)) and best[50, 1] == (2, 256 * 512)


def test_copies_of_null_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "k"), (None, "k"), (4, "j")], "doc_id long, text_key string")
    assert {(r["doc_id"], r["text_key"]): r["copy"] for r in rollup.copies(rows).collect()} == {(1, None): False, (2, None): True, (3, "k"): False, (None, "k"): True, (4, "j"): False}
    assert rollup.copies(rows.where(F.lit(False))).count() == 0


def test_top_k_broadcasts_no_repeated_blocks(spark):
    rows = [(i, [float((7 * i + j) % 11) for j in range(4)]) for i in range(200)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10)
    assert len(found.collect()) == 100  # the plan below is the one that ran
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
