"""Context-triggered piecewise hashing: fingerprints of texts that stay alike under edits.

A hash of the last seven bytes rolls over the UTF-8 text. A chunk ends where its low
e bits are all ones, so cuts depend on nearby bytes only and an edit changes the
chunks it touches. Each chunk gives one character of a signature. e is the largest
number for which a text has 32 cuts or more (0 for short texts), so signatures of
all lengths of text have about the same length; the last of 64 characters covers
the rest of the text. A fingerprint is "e:signature at e:signature at e + 1".
Two fingerprints are compared by the edit distance of signatures of one e, that is,
when their e differ by 1 at most.

Each document is also edited: the last third of its code points gives way to the
first code points of the next document by descending id (``edited_and_next``).
Documents lie in units in id order; what lies across a unit's edge is joined
afterwards, two texts a unit.

A null text counts as empty; empty texts have the fingerprint "0::" and are alike.
Rows of one id are ordered by descending text; null ids come last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gearwatch.llm import units
from gearwatch.llm.common import packed
from gearwatch.llm.words import _BYTE, mix, powers, slices, utf8
from gearwatch.session import materialize

ROLL = 7  # bytes of the rolling hash
LENGTH = 64  # characters of a signature at most
LEVELS = 48
UNIT_BYTES = 8 << 20
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTER = np.frombuffer(ALPHABET, np.uint8)


class _Cut:
    """Rolling hash levels and running chunk sums of some texts."""

    def __init__(self, texts: pa.Array):
        data, self.at = utf8(texts)
        self.size = np.diff(self.at)
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        power, self.inverse = powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])
        begin = np.maximum(np.arange(len(data)) - (ROLL - 1), self.at[:-1][self.text])
        rolled = mix((self.sums[1:] - self.sums[begin]) * self.inverse[begin])
        self.level = np.minimum(np.bitwise_count(rolled ^ (rolled + np.uint64(1))) - 1, LEVELS - 1).astype(np.int64)

    def exponents(self) -> np.ndarray:
        n = len(self.size)
        count = np.bincount(self.text * LEVELS + self.level, minlength=n * LEVELS).reshape(n, LEVELS)
        cuts = np.cumsum(count[:, ::-1], axis=1)[:, ::-1]  # at each level or above
        enough = cuts >= LENGTH // 2
        return np.where(enough.any(axis=1), LEVELS - 1 - np.argmax(enough[:, ::-1], axis=1), 0)

    def signatures(self, exponent: np.ndarray) -> list[str]:
        n = len(self.size)
        cut = np.flatnonzero(self.level >= exponent[self.text])
        owner = self.text[cut]
        first = np.searchsorted(owner, np.arange(n))
        keep = np.arange(len(cut)) - first[owner] < LENGTH - 1
        end, owner = cut[keep] + 1, owner[keep]
        n_cuts = np.bincount(owner, minlength=n)
        reached = self.at[:-1].copy()
        has = n_cuts > 0
        reached[has] = end[np.cumsum(n_cuts)[has] - 1]
        rest = np.flatnonzero(reached < self.at[1:])  # the text goes on behind the last cut
        end = np.concatenate([end, self.at[1:][rest]])
        owner = np.concatenate([owner, rest])
        order = np.argsort(owner, kind="stable")
        end, owner = end[order], owner[order]
        begin = np.empty_like(end)
        begin[1:] = end[:-1]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = owner[1:] != owner[:-1]
        begin[new] = self.at[:-1][owner[new]]
        chunk = mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))
        letters = _LETTER[(chunk & np.uint64(63)).astype(np.int64)].tobytes().decode()
        stop = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        return [letters[a:b] for a, b in zip([0, *stop[:-1]], stop)]


def fingerprints(texts: pa.Array) -> list[str]:
    """The fingerprint of each text."""
    out: list[str] = []
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        cut = _Cut(part.column(0))
        e = cut.exponents()
        out += [f"{x}:{a}:{b}" for x, a, b in zip(e.tolist(), cut.signatures(e), cut.signatures(e + 1))]
    return out


def _edit_similarity(left: list[str], right: list[str]) -> np.ndarray:
    """1 - edit distance / longer length, for many pairs of short strings at once."""
    n = len(left)
    if not n:
        return np.zeros(0)
    size = lambda xs: np.array([len(x) for x in xs])
    grid = lambda xs: np.frombuffer(b"".join(x.encode().ljust(LENGTH, b"\0") for x in xs), np.uint8).reshape(n, LENGTH)
    a, b, la, lb = grid(left), grid(right), size(left), size(right)
    column = np.arange(LENGTH + 1, dtype=np.int16)
    row = np.tile(column, (n, 1))
    at = np.arange(n)
    distance = np.where(la == 0, lb, 0)
    for i in range(1, int(la.max(initial=0)) + 1):
        here = np.empty_like(row)
        here[:, 0] = i
        here[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i - 1 : i]))
        row = np.minimum.accumulate(here - column, axis=1) + column
        ended = la == i
        distance[ended] = row[at[ended], lb[ended]]
    return 1 - distance / np.maximum(np.maximum(la, lb), 1)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Of each pair of fingerprints, 0 to 1: 1 if equal, 0 at block sizes that cannot be compared."""
    out = np.zeros(len(left))
    sides: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        (ex, x0, x1), (ey, y0, y1) = x.split(":"), y.split(":")
        step = int(ex) - int(ey)
        if step == 0:
            sides += [(i, x0, y0), (i, x1, y1)]
        elif step == 1:
            sides.append((i, x0, y1))
        elif step == -1:
            sides.append((i, x1, y0))
    for k in range(0, len(sides), 2048):
        part = sides[k : k + 2048]
        np.maximum.at(out, [s[0] for s in part], _edit_similarity([s[1] for s in part], [s[2] for s in part]))
    return out


def fingerprint_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row, without any shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)), pa.string())], ["doc_id", "fingerprint"])

    return packed(docs, id_col, text_col).select("id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_PARTS = "role int, unit long, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split(" ")[0] for x in _PARTS.split(", ")]


def _rows(role, unit, ids, texts, chars, sha, own, other, near_edited, near_next) -> pa.Table:
    n = len(ids)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    values = [[role] * n, [unit] * n, ids, texts, chars, sha, own, other, near_edited, near_next]
    return pa.table([pa.array(v if v is not None else [None] * n, k) for v, k in zip(values, kinds)], names=_NAMES)


def _digests(texts: list[str], following: list[str], own: list[str], next_own: list[str]):
    changed = [edited(t, f) for t, f in zip(texts, following)]
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    other = fingerprints(pa.array(changed, pa.large_string()))
    return [len(t) for t in texts], sha, own, other, likeness(own, other), likeness(own, next_own)


def _unit(key, table):
    """Role 0: finished rows. Role 1: the first row of the unit. Role 2: the last one, whose next is elsewhere."""
    unit = key[0].as_py()
    table = table.sort_by([("id", "descending"), ("text", "descending")])
    ids, texts = table.column("id").to_pylist(), [t or "" for t in table.column("text").to_pylist()]
    own = fingerprints(pa.array(texts, pa.large_string()))
    done = _rows(0, unit, ids[:-1], None, *_digests(texts[:-1], texts[1:], own[:-1], own[1:]))
    head = _rows(1, unit, ids[:1], texts[:1], None, None, own[:1], None, None, None)
    tail = _rows(2, unit, ids[-1:], texts[-1:], None, None, own[-1:], None, None, None)
    return pa.concat_tables([done, head, tail])


def _edge(batches):
    """Finish the rows whose next document is the head of another unit."""
    for batch in batches:
        ids, texts, own, next_texts, next_own = (c.to_pylist() for c in batch.columns)
        out = _rows(0, 0, ids, None, *_digests(texts, next_texts, own, next_own)).select(_NAMES[2:3] + _NAMES[4:])
        yield from out.to_batches()


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    placed, _ = units.with_units(packed(docs, id_col, text_col).select("id", "text"), unit_bytes)
    # Null ids come last, so their unit counts as the lowest.
    placed = placed.withColumn("unit", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.col("unit")))
    parts = materialize(placed.groupBy("unit").applyInArrow(_unit, _PARTS))
    heads = parts.where("role = 1").select("unit", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_own"))
    # One row per unit, without texts; the lowest unit is followed by the highest.
    order = Window.orderBy(F.desc("unit"))
    follows = heads.select("unit").select("unit", F.lead("unit").over(order).alias("after"), F.first("unit").over(order).alias("top"))
    follows = follows.select("unit", F.coalesce("after", "top").alias("after"))
    tails = parts.where("role = 2").select("unit", "doc_id", "text", "fingerprint").join(follows, "unit")
    met = tails.join(heads.withColumnRenamed("unit", "after"), "after").select("doc_id", "text", "fingerprint", "next_text", "next_own")
    names = ", ".join(x for x in _PARTS.split(", ") if x.split(" ")[0] not in ("role", "unit", "text"))
    finished = parts.where("role = 0").select(*[n for n in _NAMES if n not in ("role", "unit", "text")])
    return finished.union(met.mapInArrow(_edge, names))
