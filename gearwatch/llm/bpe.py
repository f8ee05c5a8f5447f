"""Byte-level BPE encoding and decoding by a given rank file.

A text is cut into pre-tokens by the vocabulary's pattern and each is encoded by
itself, in two tiers: a minimal perfect hash over the vocabulary resolves
pre-tokens that are one token; all others are merged bytewise, lowest rank first,
with a heap over a doubly linked list of the parts, so a pre-token of n bytes
takes n log n steps. Where only the number of tokens is asked for (``Counts``), the
pre-tokens that a slice of texts brings for the first time are merged side by side as
numpy arrays, one merge of each a round, by the same rule. Results are those of the tiktoken library without special
tokens. Rows are encoded where they are read: nothing is shuffled. The vocabulary
(its size is that of the rank file) is read by the driver and broadcast.

Null texts encode as empty texts; all other rows, repeated ones too, yield one row each.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from gearwatch.llm.chunks import Chunks, cut
from gearwatch.llm.common import tidy
from gearwatch.llm.words import mix, slices

CHUNK_MEMO_BYTES, PIECE_MEMO_BYTES = 96 << 20, 64 << 20  # of strings and results that a task remembers, about; only saves repeated work
_MEMO_ENTRY = 200  # bytes of an entry besides its string and result
_MEMO_LONGEST = 256  # characters of a string that is remembered
KEYS_PER_BUCKET = 4
BLOCK_BYTES = 1 << 16  # of pre-tokens merged side by side
BLOCK_LONGEST = 256  # bytes of a pre-token that is merged beside others; longer ones by the heap
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_IDS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: each of the n keys has its own slot of n.

    Keys fall into buckets; a bucket's displacement, searched from large buckets to
    small ones, moves all its keys to free slots.
    """

    def __init__(self, keys: list[bytes]):
        self.size = max(1, len(keys))
        self.n_buckets = max(1, -(-len(keys) // KEYS_PER_BUCKET))
        hashed = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashed)) != len(keys):
            raise ValueError("two vocabulary entries share a 64-bit hash")
        bucket = (hashed % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        self.shift = np.zeros(self.n_buckets, dtype=np.uint64)
        taken = np.zeros(self.size, dtype=bool)
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            own = hashed[order[bounds[b] : bounds[b + 1]]]
            if not len(own):
                break
            tries = np.arange(256, dtype=np.uint64)
            while True:
                at = self._slot(own[None, :], tries[:, None])
                free = ~taken[at].any(axis=1)
                for k in np.flatnonzero(free):
                    if len(np.unique(at[k])) == len(own):
                        taken[at[k]] = True
                        self.shift[b] = tries[k]
                        break
                else:
                    tries = tries + np.uint64(256)
                    continue
                break
        self.shifts = self.shift.tolist()

    def _slot(self, hashed, shift):
        return (mix(hashed + shift * np.uint64(_STEP)) % np.uint64(self.size)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        """The only slot where the key can be."""
        hashed = xxhash.xxh3_64_intdigest(key)
        x = (hashed + self.shifts[hashed % self.n_buckets] * _STEP) & _MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
        return (x ^ x >> 31) % self.size


class Memo(dict):
    """Remembered results of a function of a string; the lesser used half goes when ``limit`` bytes are reached."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.old, self.bytes = fn, limit, {}, 0

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= _MEMO_LONGEST:
            self.bytes += _MEMO_ENTRY + len(key) + len(value)
            if self.bytes > self.limit // 2:
                self.old = dict(self)
                self.forget_young()
            self[key] = value
        return value

    def forget_young(self) -> None:
        self.clear()
        self.bytes = 0

    def forget(self) -> None:
        self.old = {}
        self.forget_young()


class Tokenizer:
    """Encodes and decodes by ranks and a pattern; safe to broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, counting: bool = False):
        self.pattern = pattern
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.token_at: list[bytes] = [b""] * self.hash.size
        self.rank_at = [0] * self.hash.size  # packed as an id
        for token, rank in ranks.items():
            slot = self.hash.slot(token)
            self.token_at[slot], self.rank_at[slot] = token, _IDS[1](rank)
        self.none = max(ranks.values(), default=0) + 1  # no token's rank
        self.byte_pairs = [ranks.get(bytes((a, b)), self.none) for a in range(256) for b in range(256)]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pairs = self._pairs() if counting else None
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.odd_space = regex.compile(r" (?:\s|\Z)").search
        self.pieces = Memo(self.piece_ids, PIECE_MEMO_BYTES)
        self.chunks = Memo(lambda chunk: self.chunk_ids(" " + chunk), CHUNK_MEMO_BYTES)
        # Only of the pattern given with the vocabularies is it known that it can be cut at spaces.
        self.cuts = self.pattern == public_tokenizers.PATTERN

    def forget(self) -> None:
        """Drop what was remembered of earlier texts."""
        self.pieces.forget()
        self.chunks.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "odd_space", "pieces", "chunks", "cuts")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token by merging its bytes, lowest rank and then leftmost first."""
        rank, n = self.ranks.get, len(piece)
        none = self.none
        first = self.byte_pairs
        pair = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of a part with the next one
        pair.append(none)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n - 1))  # begin of the part to the left
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(pair) if r != none]
        heapify(heap)
        while heap:
            item = heappop(heap)
            i = item & mask
            if pair[i] != item >> bits:
                continue  # one of its parts has been merged since
            j = end[i]
            k = end[i] = end[j]
            pair[j] = none
            if k < n:
                before[k] = i
                r = pair[i] = rank(piece[i : end[k]], none)
                if r != none:
                    heappush(heap, r << bits | i)
            else:
                pair[i] = none
            p = before[i]
            if p >= 0:
                r = pair[p] = rank(piece[p:k], none)
                if r != none:
                    heappush(heap, r << bits | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ranks of the bytes; pairs of ranks (left * none + right, ascending) that are a token together, and its rank.

        None where parts cannot be told by their ranks: two tokens share one, or a byte has none.
        """
        ranks = self.ranks
        if len(self.bytes_of) < len(ranks) or any(bytes((b,)) not in ranks for b in range(256)):
            return None
        rank, key, made = ranks.get, [], []
        for token, whole in ranks.items():
            for k in range(1, len(token)):
                left, right = rank(token[:k]), rank(token[k:])
                if left is not None and right is not None:
                    key.append(left * self.none + right)
                    made.append(whole)
        key, made = np.array(key, dtype=np.int64), np.array(made, dtype=np.int64)
        order = np.argsort(key)
        # An entry beyond all pairs, so that every search ends at one.
        return np.array([ranks[bytes((b,))] for b in range(256)], dtype=np.int64), np.append(key[order], self.none**2), np.append(made[order], self.none)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of parts joined with their right neighbours; ``none`` where that is no token."""
        _, keys, made = self.pairs
        key = left * self.none + right
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, made[at], self.none)

    def _block_sizes(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens that ``merge`` finds in each: a round joins the lowest, leftmost pair of every pre-token."""
        out = size = np.array([len(p) for p in pieces], dtype=np.int64)
        part = self.pairs[0][np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = np.full(len(part), self.none, dtype=np.int64)  # of a part with the next one
        rank[:-1] = self._joined(part[:-1], part[1:])
        rank[np.cumsum(size) - 1] = self.none
        piece = np.arange(len(pieces))
        while True:
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            merging = least >> 32 != self.none
            out[piece] = size
            if not merging.any():
                return out
            at, offset = (least & 0xFFFFFFFF)[merging], ((least & 0xFFFFFFFF) - first)[merging]
            part[at] = least[merging] >> 32
            stays = np.repeat(merging, size)
            stays[at + 1] = False
            part, rank, size, piece = part[stays], rank[stays], size[merging] - 1, piece[merging]
            at = np.cumsum(size) - size + offset
            rank[at] = self.none
            inner = at[offset + 1 < size]
            rank[inner] = self._joined(part[inner], part[inner + 1])
            inner = at[offset > 0]
            rank[inner - 1] = self._joined(part[inner - 1], part[inner])

    def sizes(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each of some pre-tokens; those that are a token are not merged."""
        out = np.array([len(p) > 0 for p in pieces], dtype=np.int64)
        ranks = self.ranks
        rest = [k for k, p in enumerate(pieces) if p and p not in ranks]
        if self.pairs is None:
            out[rest] = [len(self.merge(pieces[k])) for k in rest]
            return out
        rest.sort(key=lambda k: len(pieces[k]))  # pre-tokens of about one length take about as many rounds
        while rest:
            longest = len(pieces[rest[-1]])
            if longest > BLOCK_LONGEST:
                alone = rest.pop()
                out[alone] = len(self.merge(pieces[alone]))
                continue
            block = rest[-max(1, BLOCK_BYTES // longest) :]
            del rest[-len(block) :]
            out[block] = self._block_sizes([pieces[k] for k in block])
        return out

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one pre-token: a whole token by the perfect hash, else by merging."""
        key = piece.encode()
        slot = self.hash.slot(key)
        if self.token_at[slot] == key:
            return self.rank_at[slot]
        ids = self.merge(key)
        return _IDS[len(ids)](*ids) if len(ids) < len(_IDS) else np.array(ids, dtype="<u4").tobytes()

    def chunk_ids(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(chunk)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        By the pattern of the vocabularies a space before a character that is no white space
        always begins a pre-token, so a text can be cut there, and a chunk that was met before
        needs no matching. Texts with a space before other white space are matched whole, and so are
        all texts by another pattern.
        """
        if not text:
            return b""
        if not self.cuts or self.odd_space(text):
            return self.chunk_ids(text)
        first, *others = text.split(" ")
        return self.chunk_ids(first) + b"".join(map(self.chunks.__getitem__, others))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(text) for text in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Counts:
    """Numbers of tokens of texts by some tokenizers; texts are cut and matched once for all that share a pattern."""

    def __init__(self, tokenizers: list[Tokenizer]):
        self.tokenizers = tokenizers
        self.by_pattern = {p: [k for k, t in enumerate(tokenizers) if t.pattern == p] for p in dict.fromkeys(t.pattern for t in tokenizers)}
        self.known = {p: (Chunks(), [np.zeros(0, dtype=np.int64) for _ in of]) for p, of in self.by_pattern.items()}

    def count_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each tokenizer the number of tokens of each text; a null text has none."""
        out: list[np.ndarray] = [None] * len(self.tokenizers)
        for pattern, of in self.by_pattern.items():
            for k, counts in zip(of, self._count(pattern, [self.tokenizers[k] for k in of], texts)):
                out[k] = counts
        return out

    def _count(self, pattern: str, tokenizers: list[Tokenizer], texts: list[str | None]) -> list[np.ndarray]:
        chunks, counts = self.known[pattern]
        if chunks.full:
            chunks.empty()
            counts[:] = [x[:0] for x in counts]
        keys, through = [], [0]
        for text in texts:
            if text:
                # A text's first chunk has no space in front; it is known by one, as no other chunk begins so.
                first, *others = cut(text) if tokenizers[0].cuts else (text,)
                keys.append(" " + first)
                keys += others
            through.append(len(keys))
        fresh = chunks.add(keys)
        counts[:] = [np.concatenate(x) for x in zip(counts, self._fresh(tokenizers, fresh))]
        number = chunks.numbers(keys)
        return [np.diff(np.concatenate([[0], np.cumsum(x[number])])[through]) for x in counts]

    @staticmethod
    def _fresh(tokenizers: list[Tokenizer], fresh: list[str]) -> list[np.ndarray]:
        """For each tokenizer the number of tokens of each chunk: matched together, a space before each chunk but first ones."""
        find = tokenizers[0].find
        begins = [k for k, c in enumerate(fresh) if c[0] == " "]
        others = [k for k, c in enumerate(fresh) if c[0] != " "]
        found = [find(fresh[k][1:]) for k in begins]
        sizes = [len(x) for x in found]
        pieces = list(chain.from_iterable(found))
        if others:
            matched = find(" " + " ".join([fresh[k] for k in others]))
            ends = np.cumsum(np.fromiter(map(len, matched), dtype=np.int64, count=len(matched)))
            last = np.searchsorted(ends, np.cumsum([len(fresh[k]) + 1 for k in others]))  # each chunk's last pre-token
            sizes += np.diff(last, prepend=-1).tolist()
            pieces += matched
        number = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        place = np.fromiter(map(number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        through = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
        distinct, out = [p.encode() for p in number], []
        for t in tokenizers:
            own = np.zeros(len(fresh), dtype=np.int64)
            own[begins + others] = np.diff(np.concatenate([[0], np.cumsum(t.sizes(distinct)[place])])[through])
            out.append(own)
        return out


def load(spark, path: str, pattern: str, counting: bool = False):
    """The tokenizer of a rank file as a broadcast variable, ready for ``Counts`` if asked for; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(Tokenizer(read_ranks(path), pattern, counting))


def encode(docs: DataFrame, tokenizer, column: str = "text", out: str = "token_ids", checked: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``out``: ids as little-endian unsigned 32-bit integers, four bytes a token.

    With ``checked`` also ``n_tokens``, and ``round_trip``: whether the ids decode to the text. Columns of
    these names that ``docs`` has already give way to the new ones.
    """
    made = {out: BinaryType()} | ({"n_tokens": LongType(), "round_trip": BooleanType()} if checked else {})
    kept = [c for c in docs.columns if c not in made or c == column]
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])  # own names: kept ones may repeat
    own_text = f"c{kept.index(column)}"
    names = [*source.columns, *[f"made{i}" for i in range(len(made))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer.value
        for batch in batches:
            for part in slices(batch, own_text):
                texts = part.column(kept.index(column)).to_pylist()
                ids = own.encode_all(texts)
                columns = [*part.columns, pa.array(ids, pa.binary())]
                if checked:
                    columns.append(pa.array([len(x) // 4 for x in ids], pa.int64()))
                    columns.append(pa.array([own.decode(x) == (t or "").encode() for x, t in zip(ids, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([*source.schema.fields, *[StructField(f"made{i}", kind) for i, kind in enumerate(made.values())]])
    found = source.mapInArrow(tidy(run, lambda: tokenizer.value.forget()), schema)
    shown = [(n, c) for n, c in zip(names, [*kept, *made]) if c not in made or n.startswith("made")]
    return found.select(*[F.col(n).alias(c) for n, c in shown])


def decode(encoded: DataFrame, tokenizer, column: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and ``out``: the bytes that the ids stand for."""
    kept = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                own = [tokenizer.value.decode(ids or b"") for ids in part.column(kept.index(column)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.binary())], [*kept, out])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out, BinaryType())]))


def round_trip_digests(docs: DataFrame, tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass; number of tokens and SHA-256 of ids and of decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids = own.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = StructType(
        [StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    )
    narrow = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    return narrow.mapInArrow(tidy(run, lambda: tokenizer.value.forget()), schema)
