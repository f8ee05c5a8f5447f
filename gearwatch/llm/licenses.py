"""Licence scan with a positional index of rare words, in DataFrame functions only.

Templates are short licence texts, each with a key phrase that must stand in full. Document
frequencies of all template words are counted over the corpus; a word's weight is its
inverse document frequency in whole bits, so it is exact. The index holds, for each template, the
(up to) ``RARE`` words of its key phrase of highest weight, with their positions.

A file looks up its words in the index. Each hit proposes a start of the template, its
position less the posting's; the starts that all postings of the template propose stay (an
intersection by relative position). There the whole key phrase is verified, word by word, and the
match scores the weighted share of the template's words found at their places. A key
phrase contains its own rarest words, so the index loses no place of it.

A label holds where a match scores ``LEAST_SCORE`` or more. Base phrases are templates that
consist of their key phrase: every place counts, with score 1.

Each document is worked on in its row: nothing is shuffled but the document frequencies, at most one
row per template word and task. The driver gets one number per template word. Null and empty
texts have no words; null ids and repeated rows are rows like any other; an empty table
gives an empty result; other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between two words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 2
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Template:
    """``text`` in lower-case words; ``key`` is a run of them."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


# The phrases and labels that every scan reports.
BASE = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
)

TEMPLATES = (
    *BASE,
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
)

_POSTING = StructType([StructField("word", StringType()), StructField("place", IntegerType())])
_TEMPLATE = StructType(
    [
        StructField("label", StringType()),
        StructField("base", BooleanType()),
        StructField("words", ArrayType(StringType())),
        StructField("weights", ArrayType(LongType())),
        StructField("total", LongType()),
        StructField("key_at", IntegerType()),
        StructField("key_size", IntegerType()),
        StructField("first", _POSTING),
        StructField("others", ArrayType(_POSTING)),
    ]
)


def words_of(text: Column) -> Column:
    """All words of a text, A-Z in lower case (split is several times as fast as extracting each match)."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the vocabulary."""
    asked = F.array(*[F.lit(w) for w in vocabulary])
    held = F.array_intersect(words_of(F.col(f"`{text_col}`")), asked)
    rows = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in rows}  # the empty word counts the documents
    return found.pop("", 0), found


def weight(documents: int, holding: int) -> int:
    """Inverse document frequency in whole bits, at least 1."""
    return ((documents + 1) // (holding + 1)).bit_length()


def index(templates: tuple[Template, ...], documents: int, holding: dict[str, int], rare: int = RARE) -> list[dict]:
    """Templates with weights and the postings of their rarest key words (ties: by word, then position)."""
    out = []
    for t in templates:
        weights = [weight(documents, holding.get(w, 0)) for w in t.words]
        size = len(t.key.split())
        key = range(t.key_at, t.key_at + size)
        postings, seen = [], set()
        for i in sorted(key, key=lambda i: (-weights[i], t.words[i], i)):
            if t.words[i] not in seen and len(postings) < rare:
                seen.add(t.words[i])
                postings.append({"word": t.words[i], "place": i})
        out.append(
            {"label": t.label, "base": t.base, "words": t.words, "weights": weights, "total": sum(weights)}
            | {"key_at": t.key_at, "key_size": size, "first": postings[0], "others": postings[1:]}
        )
    return out


def _constant(value, kind) -> Column:
    """A constant of any type, folded into the plan."""
    if isinstance(kind, StructType):
        return F.struct(*[_constant(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return F.array(*[_constant(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def matches(words: Column, entries: list[dict]) -> Column:
    """(label, base, start, score) of each place of a template whose key phrase is verified."""
    looked_up = sorted({p["word"] for e in entries for p in (e["first"], *e["others"])})
    # (word, place) of the file's words that are in the index
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(looked_up), F.struct(w.alias("word"), i.alias("place")))), lambda h: h.isNotNull())
    starts = lambda own, posting: F.transform(F.filter(own, lambda h: h["word"] == posting["word"]), lambda h: h["place"] - posting["place"])

    def of_template(own: Column, t: Column) -> Column:
        shared = F.aggregate(t["others"], starts(own, t["first"]), lambda found, posting: F.array_intersect(found, starts(own, posting)))
        key = F.sequence(t["key_at"], t["key_at"] + t["key_size"] - 1)
        verified = F.filter(shared, lambda s: F.forall(key, lambda k: F.coalesce(F.get(words, s + k) == F.get(t["words"], k), F.lit(False))))

        def match(s: Column) -> Column:
            at_place = F.transform(t["words"], lambda w, k: F.when(F.get(words, s + k) == w, F.get(t["weights"], k)).otherwise(F.lit(0).cast("long")))
            score = F.aggregate(at_place, F.lit(0).cast("long"), lambda x, y: x + y) / t["total"]
            return F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), score.alias("score"))

        return F.transform(verified, match)

    table = _constant(entries, ArrayType(_TEMPLATE))
    # most files have no word of the index
    one_or_none = F.filter(F.array(hits), lambda own: F.size(own) > 0)
    return F.flatten(F.flatten(F.transform(one_or_none, lambda own: F.transform(table, lambda t: of_template(own, t)))))


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE, rare: int = RARE
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches."""
    vocabulary = sorted({w for t in templates for w in t.words})
    documents, holding = document_frequencies(docs, vocabulary, text_col)
    entries = index(templates, documents, holding, rare)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    found = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), matches(F.col("words"), entries).alias("m"))
    kept = found.select("doc_id", "n_words", F.filter("m", lambda m: m["score"] >= least_score).alias("matches"))
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    start = F.transform(base, lambda m: m["start"].cast("long"))
    return kept.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
        "matches",
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, least_score: float = LEAST_SCORE) -> str:
    """The scan's columns (without ``matches``) in SQL that tries every start of every template, without an index."""
    rows = [(n, t.label, t.base, k, w, t.key_at <= k < t.key_at + len(t.key.split())) for n, t in enumerate(templates) for k, w in enumerate(t.words)]
    values = ",\n".join(f"({n}, '{label}', {str(base).lower()}, {k}, '{w}', {str(key).lower()})" for n, label, base, k, w, key in rows)
    return rf"""
WITH t(n, label, base, k, word, key) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{BETWEEN[1:]}') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d),
v AS (SELECT * FROM w WHERE word IN (SELECT word FROM t)),
f AS (SELECT word, count(DISTINCT r) AS holding FROM v GROUP BY word),
g AS (SELECT t.*, CAST(length(bin(((SELECT count(*) FROM d) + 1) // (coalesce(f.holding, 0) + 1))) AS BIGINT) AS weight FROM t LEFT JOIN f USING (word)),
total AS (SELECT n, label, base, sum(weight) AS total, count(*) FILTER (key) AS keys FROM g GROUP BY n, label, base),
s AS (SELECT r, n, i - k AS start, sum(weight) AS got, count(*) FILTER (key) AS keys FROM v JOIN g USING (word) GROUP BY r, n, i - k),
m AS (SELECT r, label, base, start, CAST(got AS DOUBLE) / CAST(total AS DOUBLE) AS score FROM s JOIN total USING (n)
    WHERE s.keys = total.keys AND CAST(got AS DOUBLE) / CAST(total AS DOUBLE) >= {least_score})
SELECT d.doc_id, any_value(CAST(len(words) AS BIGINT)) AS n_words, count(*) FILTER (base) AS n_base,
  CAST(min(start) FILTER (base) AS BIGINT) AS first_word, CAST(max(start) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0) AS score
FROM d LEFT JOIN m USING (r) GROUP BY r, d.doc_id
"""
