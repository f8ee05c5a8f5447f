"""Alignment of two tokenizers' tokens on the bytes of each text.

Both tokenizers cut the same bytes, so a token is the range between two byte ends. The
shorter list of ends is looked up in the longer one by galloping: from the place of the
end before, exponential steps and then a binary search, for many runs of ends at once.
Ends that both lists hold cut the tokens into groups; the ranks of a token's two ends in
the other list differ by the tokens that it overlaps, its links.

Where neither tokenizer can join across a space before a character that is no white space,
which their definitions tell, a chunk between such spaces is encoded when a task first meets
it; its tokens are taken from there when it is met again.

How often the ids of a link are linked in the whole corpus takes three steps. Each unit (a
few million bytes of text, read by one task) is encoded once and written as one row: its
distinct id pairs with counts, and for each document which of them it holds, how often.
Units send their pairs to buckets by a hash of the pair, one binary value per unit and
bucket, so a pair that fills the corpus is one entry per unit; a bucket adds them up and
answers each unit. Highest counts by id are one number per entry of a vocabulary. Texts are
not shuffled, and no row is made per link.

A text that is null or empty, or whose tokens' bytes are not a space and the text (a
tokenizer that normalises, an unknown token), has no tokens: zeros, and no groups. Repeated
rows and null ids are rows like any other; other columns take no part.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearwatch.llm.chunks import Chunks, can_be_joined, cut
from gearwatch.llm.common import tidy
from gearwatch.llm.words import mix, slices
from gearwatch.session import materialize

SLICE_BYTES = 1 << 20  # of text encoded at once; one longer text is a slice of its own
UNIT_BYTES = 8 << 20  # of text in a unit, about
BUCKET_BYTES = 8 << 20  # of pairs and counts in a bucket, about
LEAST_BUCKETS = 64
JOINED = 64  # chunks that are encoded as one text
LANE = 64  # ends that one lane of the galloping search looks up, one after another
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_UNITS = "unit long, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, pairs binary, counts binary, held array<bigint>, places binary, times binary, entries long"


# --- vocabularies


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte, as letter -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    token: list[bytes]
    cuts: bool = False  # whether a text's tokens are those of its chunks
    size: np.ndarray = field(init=False)

    def __post_init__(self):
        self.size = np.array([len(t) for t in self.token], dtype=np.int64)
        self._letters, self._start = np.frombuffer(b"".join(self.token), dtype=np.uint8), np.cumsum(self.size) - self.size

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens one after another."""
        size = self.size[ids]
        to = np.cumsum(size) - size
        return self._letters[np.arange(int(size.sum())) + np.repeat(self._start[ids] - to, size)]


def byte_level_side(definition: str) -> Side:
    """The tokenizer of a byte-level vocabulary in JSON; texts get a space in front."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    letters = _byte_letters()
    token = [b""] * tokenizer.get_vocab_size()
    for entry, k in tokenizer.get_vocab().items():
        token[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return Side(lambda texts: [e.ids for e in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)], token, _byte_level_cuts(json.loads(definition)))


def _byte_level_cuts(definition: dict) -> bool:
    """Whether texts are split by the usual pattern and only by it: a space before a character that is no white space begins a part."""
    splits, model = definition.get("pre_tokenizer") or {}, definition["model"]
    return (
        (splits.get("type"), splits.get("use_regex", True), splits.get("add_prefix_space", True)) == ("ByteLevel", True, False)
        and not any(definition.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        and all(t["special"] for t in definition.get("added_tokens") or ())
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    )


def _piece_cuts(model: bytes) -> bool:
    """Whether texts are merged as they are, and no piece has the mark of a space after another character."""
    try:
        from sentencepiece.sentencepiece_model_pb2 import ModelProto, TrainerSpec
    except ImportError:  # without protobuf the definition cannot be read
        return False
    read = ModelProto.FromString(model)
    trained, normal = read.trainer_spec, read.normalizer_spec
    return (
        trained.model_type == TrainerSpec.BPE
        and not (trained.treat_whitespace_as_suffix or trained.pretokenization_delimiter)
        and normal.name == "identity"
        and not (normal.precompiled_charsmap or normal.normalization_rule_tsv or normal.remove_extra_whitespaces)
        and normal.add_dummy_prefix
        and normal.escape_whitespaces
        and not any("▁" in p.piece.lstrip("▁") for p in read.pieces)
    )


def piece_side(model: bytes) -> Side:
    """The tokenizer of a piece model, which itself puts a space in front."""
    import sentencepiece

    tokenizer = sentencepiece.SentencePieceProcessor(model_proto=model)

    def bytes_of(k: int) -> bytes:
        if tokenizer.is_byte(k):
            return bytes([int(tokenizer.id_to_piece(k)[3:5], 16)])
        if tokenizer.is_control(k) or tokenizer.is_unknown(k):
            return b""
        return tokenizer.id_to_piece(k).replace("▁", " ").encode()

    return Side(lambda texts: tokenizer.encode(texts, num_threads=1), [bytes_of(k) for k in range(tokenizer.get_piece_size())], _piece_cuts(model))


@lru_cache(maxsize=2)
def _sides(definition: str, model: bytes) -> tuple[Side, Side]:
    return byte_level_side(definition), piece_side(model)


@dataclass(frozen=True)
class Tokenizers:
    """Both vocabularies' files, broadcast; a Python worker builds the tokenizers once."""

    files: object
    n_a: int
    n_b: int

    @property
    def sides(self) -> tuple[Side, Side]:
        return _sides(*self.files.value)


def load(spark: SparkSession, byte_level_path: str, piece_path: str) -> Tokenizers:
    """Read by the driver; the size of the broadcast is that of the two files."""
    with open(byte_level_path, encoding="utf-8") as a, open(piece_path, "rb") as b:
        definition, model = a.read(), b.read()
    json.loads(definition)
    a, b = _sides(definition, model)
    return Tokenizers(spark.sparkContext.broadcast((definition, model)), len(a.token), len(b.token))


# --- alignment


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` the number of ``long`` below it; both ascend strictly and end alike.

    Runs of ``LANE`` values are lanes. A lane's first value is found by binary search;
    from there each value starts where the one before it ended: steps of 1, 2, 4, ...
    until one reaches the value, then a binary search inside the last step.
    """
    heads = np.arange(0, len(short), LANE)
    below = np.empty(len(short), dtype=np.int64)
    at = np.searchsorted(long, short[heads])
    last = len(long) - 1
    for j in range(min(LANE, len(short))):
        heads = heads[heads + j < len(short)]
        x, low = short[heads + j], at[: len(heads)].copy()
        high, step = low.copy(), 1
        left = np.flatnonzero(long[high] < x)
        while len(left):
            low[left] = high[left] + 1
            high[left] = np.minimum(high[left] + step, last)
            step *= 2
            left = left[long[high[left]] < x[left]]
        left = np.flatnonzero(low < high)
        while len(left):
            middle = (low[left] + high[left]) // 2
            less = long[middle] < x[left]
            low[left] = np.where(less, middle + 1, low[left])
            high[left] = np.where(less, high[left], middle)
            left = left[low[left] < high[left]]
        below[heads + j] = at = low
    return below


@dataclass
class Aligned:
    """Alignment of a slice's texts; tokens of all texts in one row after another."""

    ids: tuple[np.ndarray, np.ndarray]
    count: tuple[np.ndarray, np.ndarray]  # tokens of each text
    group: tuple[np.ndarray, np.ndarray]  # number of each token's group in the slice
    links: tuple[np.ndarray, np.ndarray]  # places of the linked tokens
    n_groups: np.ndarray  # of each text
    n_links: np.ndarray

    def link_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_links)), self.n_links)


def _ids(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=sum(map(len, lists)))


class Known:
    """Both tokenizers' ids of the chunks that a task has met."""

    def __init__(self, a: Side, b: Side):
        self.sides, self.chunks = (a, b), Chunks()
        self.empty()

    def empty(self) -> None:
        self.chunks.empty()
        self.ids = [np.zeros(0, dtype=np.int32)] * 2
        self.first = [np.zeros(1, dtype=np.int64)] * 2  # place of each chunk's first id, and the end
        self.spelled = np.zeros(0, dtype=bool)  # whether both lists are a space and the chunk

    def tokens(self, texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers, all texts in one row, and their numbers by text."""
        if self.chunks.full:
            self.empty()
        cuts, keys, through = all(side.cuts for side in self.sides), [], [0]
        for text in texts:
            if text:
                keys += cut(text) if cuts else (text,)
            through.append(len(keys))
        fresh = self.chunks.add(keys, can_be_joined if cuts else None)
        self._learn(fresh, sum(map(can_be_joined, fresh)) if cuts else 0)
        number, through = self.chunks.numbers(keys), np.array(through)
        odd = np.concatenate([[0], np.cumsum(~self.spelled[number])])[through]
        if odd[-1]:  # some text is spelled otherwise: it has no tokens
            held = np.where(np.diff(odd) > 0, 0, np.diff(through))
            number = number[np.repeat(np.diff(odd) == 0, np.diff(through))]
            through = np.concatenate([[0], np.cumsum(held)])
        ids, count = [], []
        for own, first in zip(self.ids, self.first):
            begin, size = first[number], first[number + 1] - first[number]
            to = np.concatenate([[0], np.cumsum(size)])
            ids.append(own[np.arange(to[-1]) + np.repeat(begin - to[:-1], size)].astype(np.int64))
            count.append(np.diff(to[through]))
        return tuple(ids), tuple(count)

    def _learn(self, fresh: list[str], joined: int) -> None:
        """Encode new chunks; the first ``joined`` ones many at a time, as the text that they are together."""
        if not fresh:
            return
        texts = [" ".join(fresh[k : min(k + JOINED, joined)]) for k in range(0, joined, JOINED)] + fresh[joined:]
        whole = [(" " + c).encode() for c in fresh]
        given, good = np.frombuffer(b"".join(whole), dtype=np.uint8), np.ones(len(fresh), dtype=bool)
        chunk_ends = np.cumsum(np.fromiter(map(len, whole), dtype=np.int64, count=len(whole)))
        for k, side in enumerate(self.sides):
            ids = _ids(side.encode(texts))
            size = side.size[ids]
            if (size > 0).all() and np.array_equal(side.spelled(ids), given):
                ends = np.searchsorted(np.cumsum(size), chunk_ends, "right")
            else:  # some chunk is spelled otherwise: find which
                lists = side.encode(fresh)
                ids, ends = _ids(lists), np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
                for i, (own, chunk) in enumerate(zip(lists, whole)):
                    spelled = [side.token[x] for x in own]
                    good[i] &= b"".join(spelled) == chunk and all(spelled)
            self.first[k] = np.concatenate([self.first[k], self.first[k][-1] + ends])
            self.ids[k] = np.concatenate([self.ids[k], ids.astype(np.int32)])
            self.chunks.bytes += 4 * len(ids)
        self.spelled = np.concatenate([self.spelled, good])


def align(texts: list[str | None], a: Side, b: Side, known: Known | None = None) -> Aligned:
    """Align all texts of a slice at once: their bytes follow each other, and each text's end is a common end."""
    ids, count = (known or Known(a, b)).tokens(texts)
    ends = tuple(np.cumsum(side.size[x]) for side, x in zip((a, b), ids))
    s, t = (0, 1) if len(ids[0]) <= len(ids[1]) else (1, 0)  # the shorter and the longer list
    below = gallop(ends[s], ends[t]) if len(ids[s]) else np.zeros(0, dtype=np.int64)
    common = ends[t][below] == ends[s]
    low = np.concatenate([[0], (below + common)[:-1]]).astype(np.int64)[: len(below)]
    width = below - low + 1  # tokens of the other side that each token overlaps
    first = np.cumsum(width) - width
    links: list[np.ndarray] = [None, None]
    links[s] = np.repeat(np.arange(len(width)), width)
    links[t] = np.arange(int(width.sum())) - np.repeat(first - low, width)
    group: list[np.ndarray] = [None, None]
    group[s] = np.cumsum(common) - common
    is_end = np.zeros(len(ids[t]), dtype=np.int64)
    is_end[below[common]] = 1
    group[t] = np.cumsum(is_end) - is_end
    through = np.concatenate([[0], np.cumsum(count[s])])
    summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[through])
    return Aligned(ids, count, tuple(group), tuple(links), summed(common), summed(width))


@lru_cache(maxsize=4)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to size - 1, one row each with room for a separator, and their number."""
    digits = np.array([str(k).encode() for k in range(size)], dtype=f"S{len(str(size)) + 1}")
    return digits.view(np.uint8).reshape(size, -1), np.char.str_len(digits)


def group_texts(found: Aligned, a: Side, b: Side) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each text: ids by group, A before B."""
    a_group, b_group = found.group
    n = int(found.n_groups.sum())
    a_count, b_count = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    a_before, b_before = np.cumsum(a_count) - a_count, np.cumsum(b_count)
    place = (np.arange(len(a_group)) + (b_before - b_count)[a_group], np.arange(len(b_group)) + (a_before + a_count)[b_group])
    total = len(a_group) + len(b_group)
    width = max(_decimals(len(side.token))[0].shape[1] for side in (a, b))
    rows, size = np.zeros((total, width), dtype=np.uint8), np.zeros(total, dtype=np.int64)
    for side, ids, group, at, mark in ((a, found.ids[0], a_group, place[0], "|"), (b, found.ids[1], b_group, place[1], ";")):
        digits, own = _decimals(len(side.token))
        rows[at, : digits.shape[1]] = digits[ids]
        size[at] = own[ids] + 1
        last = np.ones(len(group), dtype=bool)
        last[:-1] = group[1:] != group[:-1]
        rows[at, own[ids]] = np.where(last, ord(mark), ord(","))
    flat = rows[np.arange(width) < size[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(found.count[0] + found.count[1])])]
    return [flat[i : max(i, j - 1)] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def aligned_groups(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, groups: every text's groups of token ids as ``a1,a2|b1;a3|b2,b3``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers.sides
        known = Known(a, b)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = group_texts(align(part.column(1).to_pylist(), a, b, known), a, b)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.decode() for x in texts], pa.string())], ["doc_id", "groups"])

    return _narrow(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, groups string")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


# --- counts of linked ids


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


class _Unit:
    """What the slices of a unit have come to so far; ``pairs`` are B id x size of A's vocabulary + A id."""

    def __init__(self):
        self.bytes, self.columns = 0, {k: [] for k in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "held")}
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, part: pa.RecordBatch, a: Side, b: Side, known: Known | None = None) -> None:
        texts = part.column(1).to_pylist()
        found = align(texts, a, b, known)
        pair = found.ids[1][found.links[1]] * len(a.token) + found.ids[0][found.links[0]]
        text = found.link_text()
        order = np.lexsort((pair, text))
        pair, text = pair[order], text[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        self.pairs.append(pair[at])
        self.times.append(np.diff(np.append(at, len(pair))))
        self.bytes += part.column(1).nbytes
        held = np.bincount(text[at], minlength=len(texts))
        digests = [hashlib.sha256(x).hexdigest() if x else "" for x in group_texts(found, a, b)]
        for name, values in zip(self.columns, (part.column(0).to_pylist(), *[x.tolist() for x in (*found.count, found.n_groups, found.n_links)], digests, held.tolist())):
            self.columns[name] += values

    def row(self, unit: int) -> pa.RecordBatch:
        pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
        distinct, place = np.unique(pairs, return_inverse=True)
        counts = np.bincount(place, weights=times, minlength=len(distinct)).astype(np.int64)  # below 2^53: a unit's links
        blobs = {"pairs": distinct, "counts": counts, "places": place.astype(np.uint32), "times": times.astype(np.uint32)}
        values = {"unit": unit, **self.columns, **{k: _pack(x) for k, x in blobs.items()}, "entries": len(distinct)}
        order = ["unit", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "counts", "held", "places", "times", "entries"]
        kinds = {"unit": pa.int64(), "entries": pa.int64(), "digests": pa.list_(pa.string()), **{k: pa.binary() for k in blobs}}
        return pa.RecordBatch.from_arrays([pa.array([values[k]], kinds.get(k, pa.list_(pa.int64()))) for k in order], order)


def _units(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """One row per unit; written, as the numbers of units hold for one run of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers.sides
        known = Known(a, b)
        number, unit = TaskContext.get().partitionId() << 32, _Unit()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                unit.add(part, a, b, known)
                if unit.bytes >= UNIT_BYTES:
                    yield unit.row(number)
                    number, unit = number + 1, _Unit()
        if unit.pairs:
            yield unit.row(number)

    return materialize(docs.mapInArrow(tidy(run), _UNITS))


def _dealt(units: DataFrame, buckets: int) -> DataFrame:
    """(bucket, unit, pairs, counts): each unit's pairs by bucket; empty buckets get no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, counts = _unpack(row["pairs"], np.int64), _unpack(row["counts"], np.int64)
                bucket = _bucket(pairs, buckets)
                order = np.argsort(bucket, kind="stable")
                at = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(at))
                part = lambda x: pa.array([x[order[at[k] : at[k + 1]]].tobytes() for k in full], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([row["unit"]] * len(full), pa.int64()), part(pairs), part(counts)], ["bucket", "unit", "pairs", "counts"]
                )

    return units.select("unit", "pairs", "counts").mapInArrow(run, "bucket long, unit long, pairs binary, counts binary")


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(pairs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _answered(dealt: DataFrame, n_a: int) -> DataFrame:
    """For each row of a bucket its pairs' counts in the corpus; in rows without a unit, highest counts by B id."""

    def run(key, table):
        lists = [np.frombuffer(x, np.int64) for x in table.column("pairs").to_pylist()]
        pairs = np.concatenate(lists)
        distinct, place = np.unique(pairs, return_inverse=True)
        counts = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(counts, place, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64))
        own = np.split(counts[place], np.cumsum([len(x) for x in lists])[:-1])
        ids, start = np.unique(distinct // n_a, return_index=True)  # pairs ascend by B id
        highest = np.maximum.reduceat(counts, start)
        n = table.num_rows
        return pa.table(
            {
                "unit": pa.array([*table.column("unit").to_pylist(), None], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * (n + 1), pa.int64()),
                "counts": pa.array([*[x.tobytes() for x in own], highest.tobytes()], pa.binary()),
                "ids": pa.array([*[None] * n, ids.tobytes()], pa.binary()),
            }
        )

    return materialize(dealt.groupBy("bucket").applyInArrow(run, "unit long, bucket long, counts binary, ids binary"))


def _highest(answered: DataFrame, n_b: int) -> np.ndarray:
    """The highest count of each B id; the driver gets one number per entry of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], np.int64)) for c in ("ids", "counts")], ["id", "most"])

    parts = answered.where("unit IS NULL").select("ids", "counts").mapInArrow(run, "id long, most long")
    out = np.zeros(n_b, dtype=np.int64)
    for row in parts.groupBy("id").agg(F.max("most").alias("most")).collect():
        out[row["id"]] = row["most"]
    return out


def digests(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text."""
    units = _units(_narrow(docs, id_col, text_col), tokenizers)
    entries = units.agg(F.sum("entries")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-entries * 16 // BUCKET_BYTES))
    answered = _answered(_dealt(units, buckets), tokenizers.n_a)
    highest = docs.sparkSession.sparkContext.broadcast(_highest(answered, tokenizers.n_b))
    n_a = tokenizers.n_a

    def run(key, left, right):
        out = []
        answers = {x["bucket"]: np.frombuffer(x["counts"], np.int64) for x in right.to_pylist()}
        for row in left.to_pylist():
            pairs = _unpack(row["pairs"], np.int64)
            counts = np.zeros(len(pairs), dtype=np.int64)
            if len(pairs):
                order = np.argsort(_bucket(pairs, buckets), kind="stable")
                counts[order] = np.concatenate([answers[k] for k in sorted(answers)])
            best = counts == highest.value[pairs // n_a]
            place, times = _unpack(row["places"], np.uint32), _unpack(row["times"], np.uint32).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(np.array(row["held"], dtype=np.int64))])
            by_text = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[at]), pa.int64())
            long = lambda c: pa.array(row[c], pa.int64())
            columns = [*[long(c) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")], by_text(best[place] * times), by_text(counts[place] * times)]
            out.append(pa.Table.from_arrays([*columns, pa.array(row["digests"], pa.string())], [c.split()[0] for c in DIGESTS.split(", ")]))
        return pa.concat_tables(out)

    return units.groupBy("unit").cogroup(answered.where("unit IS NOT NULL").select("unit", "bucket", "counts").groupBy("unit")).applyInArrow(run, DIGESTS)


def pair_counts(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, links: how often two ids are linked in all documents."""
    n_a = tokenizers.n_a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, counts = _unpack(row["pairs"], np.int64), _unpack(row["counts"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs % n_a), pa.array(pairs // n_a), pa.array(counts)], ["a_id", "b_id", "links"])

    units = _units(_narrow(docs, id_col, text_col), tokenizers)
    rows = units.select("pairs", "counts").mapInArrow(run, "a_id long, b_id long, links long")
    return rows.groupBy("a_id", "b_id").agg(F.sum("links").alias("links"))
