"""Whitening, licence scan and cross-tokenizer alignment next to brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter

import check
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from gearwatch.llm import align, catalog, chunks, licenses, whitening

SF = "/root/testdata/sf0.001"
CLASHING = ("id", "text_", "words", "matches", "unit", "pairs", "label", "n")
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *[StructField(c, StringType()) for c in CLASHING]])


def documents(spark, rows):
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], DOCS).repartition(3)


# --- whitening


def vectors(spark, rows):
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("id", StringType()), StructField("v", StringType())])
    return spark.createDataFrame([(k, v, "x", "y") for k, v in rows], schema).repartition(5)


def brute_whitening(rows):
    good = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in good])
    n = len(x)
    y = x - x.sum(axis=0) / n
    values, directions = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:8]
    sums = [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return [k for k, _ in good], n, deviation, y @ directions[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_eigenvectors(spark):
    rnd = random.Random(1)
    rows = [(k, [rnd.gauss(0, 0.1 + 0.05 * i) for i in range(12)]) for k in range(400)]
    rows += [(None, rows[0][1]), (7, rows[3][1]), (900, None), (901, [None] * 12), (902, [math.nan] * 12), (903, [math.inf] * 12), (904, [1.0, 2.0])]
    ids, n, deviation, w, explained = brute_whitening(rows[:-1])
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    assert Counter(r["vec_id"] for r in got) == Counter(i for i in ids for _ in range(8))
    assert max(r["identity_error"] for r in got) < 1e-10
    by = {(r["deviation"], r["component"]): r for r in got}
    sign = {}
    for d, row in zip(deviation, w):
        for c in range(8):
            r = by[d, c + 1]
            s = sign.setdefault(c, math.copysign(1, r["whitened"]) * math.copysign(1, row[c]))
            assert math.isclose(r["whitened"], s * row[c], rel_tol=1e-8, abs_tol=1e-10)
            assert math.isclose(r["explained"], explained[c], rel_tol=1e-10)


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, n, deviation, w, _ = brute_whitening(rows)
    got = {(r["vec_id"], r["component"]): r for r in catalog.QUERIES["op11_embedding_whitening"](spark, SF).collect()}
    assert len(got) == 8 * n
    for c in range(8):
        own = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(own - w[:, c]).max(), np.abs(own + w[:, c]).max()) < 1e-8
    assert [got[i, 1]["deviation"] for i in ids] == deviation


@pytest.mark.parametrize("rows,components", [([], 0), ([(1, [0.5, 0.25])], 0), ([(1, [0.5]), (2, [0.5])], 0), ([(1, [])], 0), ([(1, [0.0, 1.0]), (2, [1.0, 0.0])], 1), ([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], 1)])
def test_whitening_of_odd_tables(spark, rows, components):
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["component"] for r in got} == set(range(1, components + 1))
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_deviation_beyond_64_bits_is_null():
    x = np.array([[10**9], [0]])
    assert whitening.deviations(x, 2, [10**9]) == [10**18, 10**18]
    x = np.array([[4 * 10**9], [0], [2 * 10**9]])
    assert whitening.deviations(x, 3, [6 * 10**9]) == [None, None, 0]


@pytest.mark.parametrize("kind", ["even", "graded", "short", "equal", "close", "doubled", "one"])
def test_directions_solve_the_eigenvalue_problem(kind):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(60, 30)))[0]
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    a = {
        "even": rng.normal(size=(200, 40)),
        "graded": rng.normal(size=(200, 40)) * np.logspace(0, -8, 40),
        "short": rng.normal(size=(10, 30)),
        "equal": q,
        "close": q @ np.diag(1 + 1e-9 * np.arange(30)) @ turn,
        "doubled": np.hstack([rng.normal(size=(90, 6))] * 2),
        "one": np.outer(rng.normal(size=20), np.ones(4)),
    }[kind]
    squares, v = whitening.right_directions(whitening._triangle(a), 8)
    m = v.shape[1]
    assert np.abs(v.T @ v - np.eye(m)).max() < 1e-12
    assert np.abs(a.T @ (a @ v) - v * squares[:m]).max() < 1e-13 * squares[0]
    true = np.linalg.svd(a)[1] ** 2
    assert np.allclose(squares[: len(true)][true > 1e-16 * true[0]], true[true > 1e-16 * true[0]], rtol=1e-8)


# --- licences


ODD = ["", None, " ", "CC BY", "cc-by cc.by CC\x00BY ccby", "All Rights\nReserved." * 30, "É general public license ſ ſcc by", "ccé by cc by4", "x " * 30_000 + "all rights reserved",
       "Licensed under CC BY-NC 4.0. gnu general public license, version 3", "mit license", "the MIT License is released", "Kcc by", "0cc by"]


def brute_places(text):
    lower = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, t.label) for t in licenses.BASE for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def licence_rows(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    return [*enumerate([*ODD, *texts]), (None, "cc by"), (3, "CC BY")]


def test_base_phrases_equal_a_plain_search(spark):
    rows = licence_rows(spark)
    got = licenses.scan(documents(spark, rows)).collect()
    key = lambda r: (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
    assert Counter(map(key, got)) == Counter((k, *brute_places(t)) for k, t in rows)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_scan_equals_its_sql_on_odd_texts(spark, tmp_path):
    documents(spark, licence_rows(spark)).select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    out = check.compare(licenses.scan(spark.read.parquet(str(tmp_path / "d"))).drop("matches"), con, licenses.oracle())
    assert out.startswith("ok") and "TYPES" not in out, out


def test_method_labels(spark):
    texts = {"Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "GNU Lesser General Public License": "gpl,lgpl", "use it under the mit license": "mit", "the license of mit": "", "apache license": ""}
    rows = list(enumerate(texts)) + [(100 + k, "some license of the general public by us under the terms") for k in range(20)]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert [got[k]["labels"] for k in range(len(texts))] == list(texts.values())
    assert got[0]["score"] == 1.0 and got[3]["score"] < 1.0 and got[0]["matches"][0]["start"] == 0


def test_licence_scan_is_free_of_python_and_of_text_shuffles(spark):
    plan = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert licenses.scan(documents(spark, [])).count() == 0


# --- alignment


@pytest.fixture(scope="module")
def tokenizers(spark):
    return align.load(spark, public_tokenizers.path(catalog.BYTE_LEVEL_FILE), public_tokenizers.path(catalog.PIECE_FILE))


def brute_groups(text, a, b):
    """Groups and overlapping pairs, token by token."""
    if not text:
        return None, []
    ids = [side.encode([text])[0] for side in (a, b)]
    spans = []
    for side, own in zip((a, b), ids):
        at, out = 0, []
        for k in own:
            out.append((at, at + len(side.token[k])))
            at = out[-1][1]
        spans.append(out)
        if b"".join(side.token[k] for k in own) != (" " + text).encode():
            return None, []
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, low = [], 0
    for high in common:
        inside = lambda k: ",".join(str(i) for i, (s, e) in zip(ids[k], spans[k]) if low <= s and e <= high)  # noqa: B023, E731
        groups.append(f"{inside(0)}|{inside(1)}")
        low = high
    links = [(i, j) for i, (s, e) in zip(ids[0], spans[0]) for j, (x, y) in zip(ids[1], spans[1]) if s < y and x < e]
    return (ids, groups), links


TEXTS = ["", None, " ", "  a  b", "hello world", "<|endoftext|> <s> <unk> ▁ a▁b", "naïve façade ﬁ 🎉🎉", "x" * 300, "\n\t\r", "日本語 テキスト", "the cat sat on the mat " * 20, "a\x00b", "don't 12345", "hello world"]


def test_alignment_equals_brute_force(spark, tokenizers):
    a, b = tokenizers.sides
    words = [r["text"][:400] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect() if r["text"]]
    rows = [*enumerate([*TEXTS, *words]), (None, "null id"), (3, "  a  b")]
    found = [(k, *brute_groups(t, a, b)) for k, t in rows]
    counts = Counter(link for _, _, links in found for link in links)
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)

    def expected(k, x, links):
        ids, groups = x if x else (([], []), [])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        best = sum(counts[link] == most[link[1]] for link in links)
        return k, len(ids[0]), len(ids[1]), len(groups), len(links), best, sum(counts[link] for link in links), digest

    frame = documents(spark, rows)
    assert Counter(map(tuple, align.digests(frame, tokenizers).collect())) == Counter(expected(*x) for x in found)
    assert {(r["a_id"], r["b_id"]): r["links"] for r in align.pair_counts(frame, tokenizers).collect()} == dict(counts)
    assert Counter(map(tuple, align.aligned_groups(frame, tokenizers).collect())) == Counter((k, ";".join(x[1]) if x else "") for k, x, _ in found)
    assert align.digests(documents(spark, []), tokenizers).count() == 0


def test_units_of_any_size_give_the_same_digests(spark, tokenizers, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(tuple, align.digests(docs, tokenizers).collect()))
    assert len(whole) == docs.count()
    units = align._units(align._narrow(docs.repartition(7), "doc_id", "text"), tokenizers)
    assert units.count() == 7
    assert sorted(map(tuple, align.digests(docs.repartition(7), tokenizers).collect())) == whole


@pytest.mark.parametrize("seed", range(5))
def test_galloping_equals_binary_search(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    long = np.unique(rng.integers(0, 20 * n, 3 * n))
    short = np.unique(np.append(rng.choice(long, n // 2), [*rng.integers(0, long[-1], n // 2), long[-1]]))
    assert (align.gallop(short, long) == np.searchsorted(long, short)).all()


def test_aligned_texts_cover_all_bytes(spark, tokenizers):
    a, b = tokenizers.sides
    found = align.align(["hello there world", "x"], a, b)
    assert (found.n_links == found.count[0] + found.count[1] - found.n_groups).all()


@pytest.fixture(scope="module")
def sides():
    with open(public_tokenizers.path(catalog.BYTE_LEVEL_FILE), encoding="utf-8") as a, open(public_tokenizers.path(catalog.PIECE_FILE), "rb") as b:
        return align._sides(a.read(), b.read())


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_tokens_of_chunks_are_those_of_whole_texts(sides, monkeypatch, limit):
    monkeypatch.setattr(chunks, "MEMO_BYTES", limit)
    rnd = random.Random(5)
    alphabets = ["aab eé's\n\t 12漢🙂.,▁\x00\x1c\x85\u180e\u200b\u3000", "ab  \n\t ", "ab ▁", "a b1,.é \r\x0b\x0c"]
    texts = [*TEXTS, *["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for letters in alphabets for _ in range(300)]]
    assert all(side.cuts for side in sides)
    whole = [align.Side(side.encode, side.token) for side in sides]
    known, plain = align.Known(*sides), align.Known(*whole)
    for low in range(0, len(texts), 100):
        part = texts[low : low + 100]
        for own, other in zip(known.tokens(part), plain.tokens(part)):
            assert all(np.array_equal(x, y) for x, y in zip(own, other))
    for text in TEXTS:
        (ids, _), want = plain.tokens([text]), brute_groups(text, *sides)[0]
        assert [x.tolist() for x in ids] == (want[0] if want else [[], []])


def test_words_met_before_are_not_encoded_again(sides):
    given = []
    seen = [align.Side(lambda texts, side=side: given.extend(texts) or side.encode(texts), side.token, side.cuts) for side in sides]
    known = align.Known(*seen)
    for _ in range(3):
        align.align(["the cat sat on the mat " * 50 + "again"] * 4, *seen, known)
    assert sum(len(t.split()) for t in given) == 2 * 6
