"""Similarity join, substring dedup and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gearwatch.llm import catalog, jaccard, substrings
from gearwatch.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("node", StringType()), StructField("unit", StringType())])
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def near_copies(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    for _ in range(14):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 4, 5, 6, 8, 9, 12, 20, 45, 120, 300]))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.randrange(1, 14)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                at = rnd.randrange(len(own))
                own[at : at + rnd.randrange(2)] = [rnd.choice(vocabulary)]
            rows.append((n, rnd.choice([" ", "\n", " \t"]).join(own).upper() if rnd.random() < 0.2 else " ".join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_join_of_a_hot_group_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_HERE", 4)
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(150):  # a chain of near copies, far ones not alike
        own = list(base)
        own[(i * 7) % 60] = f"x{i % 40}"
        own[(i * 11) % 60] = f"y{i % 9}"
        rows.append((i, " ".join(own)))
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 60)))) for i in range(120)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_join_of_odd_rows(spark):
    long_text = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (4, "a b c d e f"), (9, "A B C D E F"), (9, "A B C D E F"), (5, "a"), (6, "A"), (7, long_text), (8, long_text + " end"), (-3, "a b c d e f")]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert [(k[1], c) for k, _, c in got if not k[0]] == [(-3, -3), (1, 1), (2, 2), (3, 3), (4, -3), (5, 5), (6, 5), (7, 7), (8, 7), (9, -3), (9, -3)]
    assert [c for k, _, c in got if k[0]] == [None]
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_sketch_distance_is_a_lower_bound():
    rnd = np.random.default_rng(1)
    import pyarrow as pa

    for _ in range(40):
        pool = [f"t{i}" for i in range(60)]
        texts = [" ".join(rnd.choice(pool, size=rnd.integers(5, 200))) for _ in range(2)]
        sets = jaccard.Sets(pa.array(texts))
        a, b = (set(sets.of(i).tolist()) for i in range(2))
        assert jaccard.distance_at_least(*sets.narrow_sketches()) <= len(a ^ b)


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {k: v for k, v in got.items()} == {k: v for k, v in parent.items() if (k, k) not in links or k in got}


def brute_removal(rows, width=20):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] is None, rows[k][1] or ""))
    seen, out = set(), []
    for k in order:
        words = WORD.findall(rows[k][1] or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((rows[k][0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rnd = random.Random(seed)
    vocabulary = [f"é{i}" for i in range(8 if seed else 300)]
    shared = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(18, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randrange(0, 6)):
            words += rnd.choice(shared) if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 40))]
        if rnd.random() < 0.1:
            words += ["same"] * rnd.randrange(1, 200)
        rows.append((i * 3 % 120 + 1000 * (i % 2), rnd.choice([" ", "\n", "  "]).join(words)))
    return rows + rows[:5] + [(None, rows[3][1]), (None, "x " * 30), (5, None), (6, ""), (7, " \t")]


@pytest.mark.parametrize("seed", range(2))
def test_removal_equals_brute_force(spark, seed):
    rows = passages(seed)
    got = substrings.removal_digests(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(rows)


def test_removal_over_an_empty_table_and_one_long_text(spark):
    assert substrings.removal_digests(frame(spark, [])).count() == 0
    rows = [(1, " ".join(f"w{i % 5000}" for i in range(40_000)))]
    assert [tuple(r) for r in substrings.removal_digests(frame(spark, rows)).collect()] == brute_removal(rows)


def test_registered_queries_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in catalog.op1_ngram_jaccard_join(spark, SF).collect())
    assert got == brute_components(rows)
    assert sorted((tuple(r) for r in catalog.op7_substring_dedup(spark, SF).collect()), key=str) == brute_removal(rows)
