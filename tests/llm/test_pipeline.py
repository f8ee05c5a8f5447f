"""The corpus pipeline, stage by stage, against brute force."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from gearwatch.llm import bpe, language
from gearwatch.session import materialize
from test_pairs_and_passages import WORD, brute_components
from test_texts_and_numbers import brute_mix, frame, odd_rows

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def removed(rows, width=20):
    """Texts after removal, by id; a text that loses nothing is unchanged."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        out[i] = " ".join(w for w, g in zip(words, gone) if not g) if any(gone) else text
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF)))
    return docs


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    assert all(d.columns == COLUMNS for d in stages[:-1])
    assert stages[-1].columns == [*COLUMNS, "token_ids", "n_tokens", "round_trip"]


def test_language_stage_drops_only_texts_without_a_language(spark, stages):
    found = {r["row"]["doc_id"]: r for r in language.identify(stages[0], language.train(stages[0])).collect()}
    want = {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= pipeline.LEAST_LANGUAGE_SCORE}
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert kept == want and len(kept) >= 0.97 * len(found)


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert {r["doc_id"]: r["text"] for r in stages[2].collect()} == {i: t for i, t in rows if i in {c for _, _, c in brute_components(rows)}}


def test_passages_are_removed(stages):
    want = removed([(r["doc_id"], r["text"]) for r in stages[2].collect()])
    got = stages[3].collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_mix_and_tokens(stages):
    before = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in stages[3].collect()]
    size, target = brute_mix(before)
    texts = {r[0]: r[1] for r in before}
    took = dict.fromkeys(size, 0)
    for r in stages[4].collect():
        words, own = WORD.findall(r["text"]), WORD.findall(texts[r["doc_id"]])
        assert r["text"] == texts[r["doc_id"]] or words == own[: len(words)]
        took[r["source"]] += len(words)
    assert all(abs(took[s] - target[s]) <= 1 for s in size)
    ranks = bpe.read_ranks(public_tokenizers.path(pipeline.RANK_FILE))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = stages[5].collect()
    assert len(last) == stages[4].count()
    for r in last:
        assert r["round_trip"] and np.frombuffer(r["token_ids"], "<u4").tolist() == other.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["token_ids"]) // 4


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_take_odd_and_empty_tables(spark, rows):
    docs = frame(spark, odd_rows() if rows == "odd" else [])
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = materialize(stage(spark, docs, SF))
        assert out.columns[: len(docs.columns)] == docs.columns
        assert rows == "odd" or out.count() == 0
        if k not in (0, 4):
            assert out.count() <= 3 * docs.count()


def test_null_texts_stay_where_nothing_is_decided_on_them(spark):
    docs = frame(spark, [(1, None, "en", "s"), (2, None, "en", "s"), (3, "a b", "en", "s"), (3, "a b", "en", "s"), (None, "a b", "en", None)])
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in pipeline.one_of_each_group(spark, docs, SF).collect())
    assert [k[:2] for k in kept] == [(False, 1), (False, 2), (False, 3), (True, 0)]
    assert {r["text"] for r in pipeline.without_repeats(spark, docs, SF).collect()} == {None, "a b"}
