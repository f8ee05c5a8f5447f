"""Removal of repeated passages with difference-cover anchors.

A window is ``width`` consecutive words of one document. A word is removed if a
window over it has the same words as a window that starts earlier (in a document
of smaller id, or sooner in the same document); windows are judged on the input.

Anchors. Positions modulo 13 that fall on {0, 1, 3, 9} are cover positions: for
any two positions some shift below 13 brings both onto the cover. So two equal
windows share an equal run of ``width`` - 12 words that begins on a cover
position in both, and only the runs at 4 of 13 positions are hashed and
exchanged. Windows with no repeated anchor cannot repeat; the others are extended
to the full width and their hashes exchanged to find which begins first.

Documents lie in units in id order (``units``); units exchange sorted lists of
distinct hashes, so a passage that fills a third of the corpus is one entry per
unit. The texts are shuffled once, by unit. Hashes have 64 bits.

Null texts have no words. Rows of one id are ordered by text, and of equal rows
all but one count as later. Null ids come after all others. All other columns
are kept in ``rest``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gearwatch.llm import units
from gearwatch.llm.common import packed
from gearwatch.llm.words import Words, slices

PERIOD, COVER = 13, (0, 1, 3, 9)
WIDTH = 20
UNIT_BYTES = 8 << 20


class _Unit:
    """Hashes of the words of a unit's documents, in document order."""

    def __init__(self, table: pa.Table, width: int):
        self.table = table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.width = width
        self.parts: list[Words] = []
        anchors, windows, place, left = [], [], [], []
        for batch in self.table.to_batches():
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                own = words.hashes()
                anchors.append(words.windows(own, width - PERIOD + 1))
                windows.append(words.windows(own, width))
                place.append(words.position)
                left.append(np.repeat(words.count, words.count) - place[-1])
                self.parts.append(words)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.anchor, self.window = join(anchors, np.uint64), join(windows, np.uint64)
        place, left = join(place, np.int64), join(left, np.int64)
        self.whole = left >= width  # a window begins here
        on_cover = np.zeros(PERIOD, dtype=bool)
        on_cover[list(COVER)] = True
        self.anchored = on_cover[place % PERIOD] & (left > width - PERIOD) & (place + left >= width)

    def repeated_windows(self, again: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Windows with a repeated anchor; ``again`` by distinct anchor, ``which`` the distinct one of each."""
        flag = np.zeros(len(self.anchor) + PERIOD, dtype=np.int32)
        flag[np.flatnonzero(self.anchored)] = again[which]
        total = np.concatenate([[0], np.cumsum(flag)])
        begin = np.arange(len(self.anchor))
        return self.whole & (total[begin + PERIOD] > total[begin])


def _anchors(width: int, buckets: int):
    def run(key, table):
        unit = _Unit(table, width)
        return units.dealt(key[0].as_py(), np.unique(unit.anchor[unit.anchored]), buckets)

    return run


def _shared(key, table):
    """Which hashes of each unit other units have too, as bits in the order they came."""
    order, again, sizes, names = units.met(table)
    again[:-1] |= again[1:]
    shared = np.zeros(len(again), dtype=bool)
    shared[order] = again
    bits = [np.packbits(x).tobytes() for x in units.pieces(shared, sizes)]
    return pa.table({"unit": pa.array(names, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(names), pa.int64()), "bits": pa.array(bits, pa.binary())})


def _candidates(width: int, buckets: int):
    def run(key, docs, verdicts):
        unit = _Unit(docs, width)
        hashes, which, count = np.unique(unit.anchor[unit.anchored], return_inverse=True, return_counts=True)
        again = count > 1
        at = units.bounds(hashes, buckets)
        for bucket, bits in zip(verdicts.column("bucket").to_pylist(), verdicts.column("bits").to_pylist()):
            size = at[bucket + 1] - at[bucket]
            again[at[bucket] : at[bucket + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)
        return units.dealt(key[0].as_py(), np.unique(unit.window[unit.repeated_windows(again, which)]), buckets)

    return run


def _later(key, table):
    """The hashes of each unit that an earlier unit has."""
    order, again, sizes, names = units.met(table)
    later = np.zeros(len(again), dtype=bool)
    later[order] = again
    lists = [np.frombuffer(x, dtype=np.uint64) for x in table.sort_by("unit").column("hashes").to_pylist()]
    kept = [(n, h[x].tobytes()) for n, h, x in zip(names, lists, units.pieces(later, sizes)) if x.any()]
    return pa.table({"unit": pa.array([n for n, _ in kept], pa.int64()), "hashes": pa.array([h for _, h in kept], pa.binary())})


def _kept_bytes(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each text joined by one space: bytes, and n + 1 offsets of the texts."""
    start, end = words.start[keep], words.end[keep]
    size = end - start + 1  # with a space after the word
    text = np.repeat(np.arange(words.n_texts), words.count)[keep]
    n_kept = np.bincount(text, minlength=words.n_texts)
    to = np.cumsum(size) - size  # where each word goes, each with its space
    out = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    take = np.arange(len(out)) - np.repeat(to - start, size)
    is_space = np.zeros(len(out), dtype=bool)
    is_space[to + size - 1] = True
    out[~is_space] = words.data[take[~is_space]]
    last = np.cumsum(n_kept)[n_kept > 0] - 1  # the last kept word of a text has no space after it
    drop = np.zeros(len(out), dtype=bool)
    drop[(to + size - 1)[last]] = True
    length = np.bincount(text, size, minlength=words.n_texts).astype(np.int64) - (n_kept > 0)
    return out[~drop], np.concatenate([[0], np.cumsum(length)])


def _removal(width: int, digest: bool, keep_unchanged: bool):
    def run(key, docs, verdicts):
        unit = _Unit(docs, width)
        begin = np.flatnonzero(unit.whole)
        windows = unit.window[begin]
        order = np.argsort(windows, kind="stable")
        later = np.zeros(len(windows), dtype=bool)
        later[order[1:]] = windows[order[1:]] == windows[order[:-1]]
        lists = [np.frombuffer(x, dtype=np.uint64) for x in verdicts.column("hashes").to_pylist()]
        if lists:
            later |= np.isin(windows, np.concatenate(lists))
        change = np.zeros(len(unit.whole) + 1, dtype=np.int64)
        change[begin[later]] = 1
        np.add.at(change, begin[later] + width, -1)
        removed = np.cumsum(change)[:-1] > 0
        n_words, n_removed, kept, done = [], [], [], 0
        for words in unit.parts:
            own = removed[done : done + len(words.start)]
            done += len(words.start)
            n_words.append(words.count)
            n_removed.append(np.diff(np.concatenate([[0], np.cumsum(own)])[words.first]))
            data, at = _kept_bytes(words, ~own)
            if digest:
                view = memoryview(np.ascontiguousarray(data))
                kept.append(pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string()))
            else:
                kept.append(pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string()))
        join = lambda xs: pa.array(np.concatenate(xs) if xs else [], pa.int64())
        out = {name: unit.table.column(name) for name in unit.table.column_names if name not in ("unit", "text")}
        out |= {"n_words": join(n_words), "n_removed": join(n_removed), "kept": pa.chunked_array(kept, pa.string())}
        if keep_unchanged and not digest:
            out["kept"] = pc.if_else(pc.equal(out["n_removed"], 0), unit.table.column("text").cast(pa.string()), out["kept"])
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, unit_bytes: int = UNIT_BYTES, digest: bool = False, keep_unchanged: bool = False) -> DataFrame:
    """For packed documents (``id``, ``text`` and perhaps ``rest``): id, rest, n_words, n_removed, kept.

    ``kept`` is the remaining words joined by one space, or with ``digest`` its SHA-256.
    With ``keep_unchanged`` a text that loses no word stays as it is.
    """
    if width < PERIOD:
        raise ValueError(f"width must be at least {PERIOD}")
    placed, layout = units.with_units(docs, unit_bytes)
    # Anchors: 4 of 13 words, 8 bytes each; words have 6 bytes or so.
    buckets = layout.buckets(0.4)
    by_unit = placed.groupBy("unit")
    sent = by_unit.applyInArrow(_anchors(width, buckets), units.DEALT)
    shared = sent.groupBy("bucket").applyInArrow(_shared, "unit long, bucket long, bits binary")
    full = by_unit.cogroup(shared.groupBy("unit")).applyInArrow(_candidates(width, buckets), units.DEALT)
    later = full.groupBy("bucket").applyInArrow(_later, "unit long, hashes binary")
    made = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    schema = StructType([f for f in docs.schema.fields if f.name != "text"] + made)
    return by_unit.cogroup(later.groupBy("unit")).applyInArrow(_removal(width, digest, keep_unchanged), schema)


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    narrow = packed(docs, id_col, text_col).select("id", "text")
    out = remove_repeats(narrow, width, digest=True)
    return out.selectExpr("id AS doc_id", "n_words", "n_removed", "kept AS kept_sha256")
