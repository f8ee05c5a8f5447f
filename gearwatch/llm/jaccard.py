"""Similarity join of documents on word shingles by parity sketches.

A document's set is its distinct shingles of five words (lower-cased A to Z; with
fewer words, the whole sequence is one). Two documents link when
``percent`` of the union is shared at least. Sets of a and b elements that link differ in
at most k = (a + b) (100 - percent) / (100 + percent) elements.

Sketch. Every element toggles one bit of a sketch. Common elements cancel, so the
Hamming distance of two sketches is at most the symmetric difference of the sets.
A sketch has m blocks; k differences touch at most k of them, so linked sets agree
on m - k blocks or more. Blocks are very wide and sparse, and a block's content is
carried as the XOR of one 64-bit word per toggled bit. Per size band, documents that
agree on a block meet. An empty block tells nothing: a set with e empty blocks is
covered if m - k > e, as then one of the agreeing blocks has content. A set that is
not covered is sketched again, first with frequent elements, then by other hashes,
and in the last resort meets on empty blocks too, so no link is lost.

Frequent elements (those of passages that very many documents share) are left out of
the first sketch: any set of elements common to all documents may be left out, as
differences can only become fewer. They are counted over all documents.

Groups. Documents that meet are not paired with each other. Each is first compared
with the least of its group; then only members that are still in different components
are paired. Comparison is by a narrow folded sketch, then exactly by the texts.
Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearwatch.llm.common import packed
from gearwatch.llm.components import components
from gearwatch.llm.words import Words, mix, slices
from gearwatch.session import materialize

SHINGLE = 5
PERCENT = 80
COMBINE_BYTES = 16 << 20  # text bytes whose documents are looked at together in a task
BUCKET_BYTES = 16 << 20
FREQUENT_HERE = 8  # times an element must be seen among the documents looked at together to be counted as frequent
FREQUENT_MOST = 1 << 17  # frequent elements that are broadcast, 8 bytes each
FILTER_BITS = 1 << 23  # one mebibyte
TILE = 2048  # members of a group that a task compares with as many others
SKETCHES = 4  # the first without frequent elements
BAND = 1.6
_NODE, _BLOCK, _CODE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


class Sets:
    """Shingle sets of some texts: ``element`` sorted within ``text``, ``size`` and ``node`` per text."""

    def __init__(self, texts: pa.Array, width: int = SHINGLE):
        words = Words(texts)
        shingles = words.windows(words.hashes(lower=True), width)
        place = words.position
        valid = (place == 0) | (place + width <= np.repeat(words.count, words.count))
        text, element = words.text[valid], shingles[valid]
        order = np.lexsort((element, text))
        text, element = text[order], element[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (element[1:] != element[:-1])
        self.text, self.element = text[new], element[new]
        self.size = np.bincount(self.text, minlength=words.n_texts)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.zeros(len(self.element) + 1, dtype=np.uint64)
        np.cumsum(mix(self.element ^ _NODE), out=total[1:])
        self.node = mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64) * _NODE)

    def of(self, k: int) -> np.ndarray:
        return self.element[self.first[k] : self.first[k + 1]]

    def narrow_sketches(self) -> list[bytes]:
        """One parity sketch per text with four bits or more an element."""
        bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(4 * self.size, 1))).astype(np.int64))
        base = np.cumsum(bits) - bits
        at = base[self.text] + (self.element & (bits[self.text] - 1).astype(np.uint64)).astype(np.int64)
        packed_bits = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little")
        return [packed_bits[b // 8 : (b + n) // 8].tobytes() for b, n in zip(base, bits)]


def distance_at_least(a: bytes, b: bytes) -> int:
    """Hamming distance of two parity sketches after folding the wider one to the other's width."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _bands(percent: int) -> list[tuple[int, int, int, int]]:
    """(least size, most size, most differences k, blocks m) of each size band."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * BAND))
        k = 2 * high * (100 - percent) // (100 + percent)
        out.append((low, high, k, k + 1 + (0 if k == 0 else 2 + (35 * k) // 100)))
        low = high + 1
    return out


class Keys:
    """Keys on which documents meet, collected over slices of text."""

    def __init__(self, percent: int, frequent: np.ndarray):
        self.percent, self.frequent = percent, frequent
        self.bands = _bands(percent)
        self.low = np.array([b[0] for b in self.bands])
        self.reset()

    def reset(self) -> None:
        self.seen: set[int] = set()
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.mostly_frequent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, sets: Sets) -> None:
        node = sets.node.view(np.int64)
        fresh = np.zeros(len(node), dtype=bool)
        for i in np.flatnonzero(sets.size):
            if (x := int(node[i])) not in self.seen:  # equal sets are one node
                self.seen.add(x)
                fresh[i] = True
        own = np.searchsorted(self.low, sets.size, "right") - 1
        rare = np.ones(len(sets.element), dtype=bool)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, sets.element), len(self.frequent) - 1)
            rare = self.frequent[at] != sets.element
        for step in (0, 1):  # larger partners lie in the same band or, for sets near its end, in the next one
            band = np.minimum(own + step, len(self.bands) - 1)
            low, _, k, m = np.array(self.bands, dtype=np.int64)[band].T
            here = fresh & (100 * sets.size >= self.percent * low) & (k > 0)  # at k = 0 linked sets are equal
            if step:
                here &= band > own
            self._meet(sets, node, here, band, k, m, rare, 0)

    def _meet(self, sets: Sets, node, here, band, k, m, rare, number: int) -> None:
        """Keys of sketch ``number`` for the texts ``here``; those not covered go on to the next sketch."""
        if not here.any():
            return
        use = here[sets.text] & (rare if number == 0 else True)
        text, element = sets.text[use], sets.element[use]
        start = np.cumsum(np.where(here, m, 0)) - np.where(here, m, 0)  # blocks of all texts side by side
        spread = mix(element ^ (_BLOCK + np.uint64(number)))
        block = ((spread >> np.uint64(32)) * m[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = start[text] + block
        order = np.argsort(at, kind="stable")
        at, code, text = at[order], mix(element ^ _CODE)[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        content = np.bitwise_xor.reduceat(code, first) if len(first) else np.zeros(0, np.uint64)
        owner, block = text[first], at[first] - start[text[first]]
        empty = m - np.bincount(owner, minlength=len(m))
        open_ = here & (m - k <= empty)
        keys = self._key(content, band[owner], block, number)
        if number == SKETCHES - 1 and open_.any():
            missing = np.ones(int(np.where(here, m, 0).sum()), dtype=bool)
            missing[at[first]] = False
            holder = np.repeat(np.arange(len(m)), np.where(here, m, 0))
            gaps = np.flatnonzero(missing & open_[holder])
            owner = np.concatenate([owner, holder[gaps]])
            keys = np.concatenate([keys, self._key(np.zeros(len(gaps), np.uint64), band[holder[gaps]], gaps - start[holder[gaps]], number)])
        if number == 0:
            self.rows.append((keys, node[owner]))
        else:
            own_rare = np.bincount(sets.text, rare, minlength=len(m)).astype(np.int64)
            self.mostly_frequent.append((keys, node[owner], own_rare[owner]))
        if number < SKETCHES - 1:
            self._meet(sets, node, open_, band, k, m, rare, number + 1)

    @staticmethod
    def _key(content, band, block, number: int):
        return mix(content + mix((band.astype(np.uint64) << np.uint64(40)) + block.astype(np.uint64) * np.uint64(SKETCHES) + np.uint64(number)))

    def flush(self, buckets: int, turn: int) -> pa.RecordBatch:
        """Rows (bucket, kind, nodes, counts, keys): keys of kind 1 by bucket; of kind 2 to any bucket."""
        out: list[tuple[int, int, bytes, bytes, bytes]] = []
        if self.rows:
            keys, nodes = (np.concatenate(x) for x in zip(*self.rows))
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((nodes, bucket))
            keys, nodes = keys[order], nodes[order]
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(at)):
                own, count = _runs(nodes[at[b] : at[b + 1]])
                out.append((int(b), 1, own.tobytes(), count.astype(np.uint32).tobytes(), keys[at[b] : at[b + 1]].tobytes()))
        if self.mostly_frequent:
            keys, nodes, rare = (np.concatenate(x) for x in zip(*self.mostly_frequent))
            for part in range(0, len(keys), 1 << 16):
                k, n, r = (x[part : part + (1 << 16)] for x in (keys, nodes, rare))
                out.append(((turn + part) % buckets, 2, n.tobytes(), r.tobytes(), k.tobytes()))
        self.reset()
        names = ["bucket", "kind", "nodes", "counts", "keys"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.concatenate([first, [len(values)]]))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """Slices of text, and None after every ``COMBINE_BYTES`` and at the end."""
    size = 0
    for batch in batches:
        for part in slices(batch, "text"):
            yield part
            size += part.nbytes
            if size >= COMBINE_BYTES:
                yield None
                size = 0
    yield None


def _sets_and_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0, doc, size, node, sketch) by document and (kind 1, null, times, element, null) of frequent elements."""
    names = ["kind", "doc", "size", "node", "sketch"]
    own: list[np.ndarray] = []
    seen: set[int] = set()
    for part in _combined(batches):
        if part is not None:
            sets = Sets(part.column("text"))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(n, np.int32)),
                    part.column("id"),
                    pa.array(sets.size.astype(np.int64)),
                    pa.array(sets.node.view(np.int64), mask=sets.size == 0),
                    pa.array(sets.narrow_sketches(), pa.binary()),
                ],
                names,
            )
            fresh = np.array([x not in seen for x in sets.node.tolist()], dtype=bool)
            seen.update(sets.node.tolist())
            own.append(sets.element[fresh[sets.text]])
        elif own:
            element, times = np.unique(np.concatenate(own), return_counts=True)
            often = times >= max(FREQUENT_HERE, len(seen) // 500)
            k = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(k, np.int32)),
                    pa.nulls(k, pa.int64()),
                    pa.array(times[often].astype(np.int64)),
                    pa.array(element[often].view(np.int64)),
                    pa.nulls(k, pa.binary()),
                ],
                names,
            )
            own, seen = [], set()


def _keys(percent: int, frequent, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(percent, frequent.value)
        turn = 0
        for part in _combined(batches):
            if part is not None:
                keys.add(Sets(part.column("text")))
            else:
                yield keys.flush(buckets, turn)
                turn += 7

    return run


def _groups(_key, table):
    """Of one bucket: rows (0, least node of a group, node), (1, group, node) of groups over two, (2, key, node) passed on.

    The rows passed on also have the number of the node's elements that are not frequent.
    """
    kinds = table.column("kind").to_pylist()
    cols = {name: table.column(name).to_pylist() for name in ("nodes", "counts", "keys")}
    keys, nodes, passed = [], [], [np.zeros((0, 3), np.int64)]
    for i, kind in enumerate(kinds):
        own, k = np.frombuffer(cols["nodes"][i], np.int64), np.frombuffer(cols["keys"][i], np.uint64)
        if kind == 2:
            passed.append(np.stack([k.view(np.int64), own, np.frombuffer(cols["counts"][i], np.int64)], axis=1))
        else:
            keys.append(k)
            nodes.append(np.repeat(own, np.frombuffer(cols["counts"][i], np.uint32)))
    out = [(2, np.concatenate(passed))]
    if keys:
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new], nodes[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([first, [len(keys)]]))
        many = np.repeat(size > 1, size)
        least = np.repeat(nodes[first], size)  # nodes ascend within a group
        is_first = np.zeros(len(keys), dtype=bool)
        is_first[first] = True
        pairs = np.stack([least, nodes], axis=1)[many & ~is_first]
        out.append((0, np.unique(pairs, axis=0) if len(pairs) else pairs))
        # Groups of equal members are one group; it is named by a hash of its members.
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(nodes.view(np.uint64) ^ _NODE), dtype=np.uint64)])
        name = mix(total[first + size] - total[first] + size.astype(np.uint64))
        _, once = np.unique(name, return_index=True)
        keep = np.zeros(len(first), dtype=bool)
        keep[once] = True
        keep = np.repeat(keep & (size > 2), size)
        out.append((1, np.stack([np.repeat(name, size).view(np.int64), nodes], axis=1)[keep]))
    return pa.table(
        {
            "kind": pa.array(np.concatenate([np.full(len(x), k, np.int32) for k, x in out])),
            "a": pa.array(np.concatenate([x[:, 0] for _, x in out])),
            "b": pa.array(np.concatenate([x[:, 1] for _, x in out])),
            "rare": pa.array(np.concatenate([x[:, 2] if k == 2 else np.zeros(len(x), np.int64) for k, x in out])),
        }
    )


def _near_by_sketch(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            most = size * (100 - percent) // (100 + percent)
            least = [distance_at_least(a, b) for a, b in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())]
            near = pa.array(np.array(least, dtype=np.int64) <= most)
            yield batch.select(["a", "b", "doc_a", "doc_b"]).filter(near)

    return run


def _across(percent: int):
    """Pairs of one tile of a group that may link and lie in different components.

    Members of the most frequent component are compared with the others only.
    """

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        chunk, node, c, size = (table.column(x).to_numpy() for x in ("chunk", "node", "c", "size"))
        sketches = table.column("sketch").to_pylist()
        width = min(len(x) for x in sketches)
        folded = [np.frombuffer(x, np.uint64).reshape(-1, width // 8) for x in sketches]
        bits = np.stack([np.bitwise_xor.reduce(x, axis=0) for x in folded])
        value, times = np.unique(c, return_counts=True)
        major = c == value[times.argmax()]
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        sides = [(left[~major[left]], right)]
        if i != j:
            sides.append((left[major[left]], right[~major[right]]))
        found = []
        for x, y in sides:
            step = max(1, (1 << 21) // max(1, len(y) * bits.shape[1]))
            for low in range(0, len(x), step):
                a = x[low : low + step]
                least = np.bitwise_count(bits[a][:, None, :] ^ bits[y][None, :, :]).sum(axis=2, dtype=np.int64)
                over = least - (size[a][:, None] + size[y][None, :]) * (100 - percent) // (100 + percent)
                at, to = np.nonzero((over <= 0) & (c[a][:, None] != c[y][None, :]))
                found.append((a[at], y[to]))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _apart(member: DataFrame, nodes: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (g, node) of one group that may link, in different components so far.

    A group is compared in tiles of ``TILE`` members against ``TILE`` members.
    """
    labelled = materialize(member.join(label, "node", "left").select("g", "node", F.coalesce("component", "node").alias("c")))
    apart = labelled.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high")
    chunks = F.ceil(F.col("n") / TILE).cast("long")
    placed = labelled.join(apart, "g").select("g", "node", "c", F.pmod(F.xxhash64("node"), chunks).alias("chunk"), chunks.alias("chunks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    tiles = placed.select("g", "node", "c", "chunk", F.explode(every).alias("other"))
    tiles = tiles.select("g", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "c", "chunk")
    return tiles.join(nodes.select("node", "size", "sketch"), "node").groupBy("g", "i", "j").applyInArrow(_across(percent), "a long, b long").distinct()


def _linked(percent: int):
    def run(_key, table):
        """Links between each leader and the members that came with it."""
        table = table.combine_chunks()
        found: dict[tuple[int, int], tuple[dict[int, np.ndarray], list[int]]] = {}
        for batch in table.to_batches():
            for part in slices(batch, "text"):
                sets = Sets(part.column("text"))
                actual = sets.node.view(np.int64).tolist()
                for i, (leader, chunk, node) in enumerate(zip(part.column("leader").to_pylist(), part.column("chunk").to_pylist(), part.column("node").to_pylist())):
                    if actual[i] == node:  # another row of this id may have another text
                        found.setdefault((leader, chunk), {})[node] = sets.of(i).copy()
        links = []
        for (leader, _), members in found.items():
            if leader not in members:
                continue
            head = members.pop(leader)
            for node, own in members.items():
                small, large = (own, head) if len(own) < len(head) else (head, own)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                if 100 * common >= percent * (len(own) + len(head) - common):
                    links.append((leader, node))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _mostly(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of these ids and few others, so that a join after it does not shuffle all texts.

    A bit map of hashed ids, of ``FILTER_BITS`` at most and so of a fixed size, is broadcast.
    With more ids than fit it would let most documents through, and is left out.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits"))
    words = materialize(words)
    if words.count() > FILTER_BITS // 128:
        return docs
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words.collect():
        bits[r["word"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select(["id", "text"]).filter(pa.array(hit.astype(bool)))

    return docs.select("id", "text", place.alias("place")).mapInArrow(run, docs.schema)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, each: int = 128) -> DataFrame:
    """The pairs (a, b) of nodes that link: by narrow sketch, then by the texts, which travel once per leader a and member b."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("doc").alias(f"doc_{s}"), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    near = materialize(
        pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near_by_sketch(percent), "a long, b long, doc_a long, doc_b long")
    )
    n_near = near.count()
    if not n_near:
        return near.select("a", "b")
    count = near.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    chunked = near.join(count, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / each)).cast("long"))
    heads = chunked.select("a", "chunk", "doc_a").distinct().select(F.col("doc_a").alias("id"), F.col("a").alias("leader"), "chunk", F.col("a").alias("node"))
    members = chunked.select(F.col("doc_b").alias("id"), F.col("a").alias("leader"), "chunk", F.col("b").alias("node"))
    parts = max(64, n_near // each)
    asked = heads.union(members).withColumn("part", F.pmod(F.xxhash64("leader", "chunk"), F.lit(parts)))
    return _mostly(docs.select("id", "text"), asked.select("id")).join(asked, "id").groupBy("part").applyInArrow(_linked(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), node (its set).

    Documents without words link with nothing. Rows of one doc_id count as one document
    for its component, whichever of their texts links. A row with a null doc_id takes no
    part and has a null component. ``percent`` must lie between 63 and 100,
    so that the sizes of linked sets lie in one size band or in adjacent ones.
    """
    if not 63 <= percent <= 100:
        raise ValueError("percent must lie between 63 and 100")
    source = packed(docs, id_col, text_col).select("id", "text")
    known = source.where("id IS NOT NULL")
    spark = docs.sparkSession
    first = materialize(source.mapInArrow(_sets_and_frequent, "kind int, doc long, size long, node long, sketch binary"))
    sets = first.where("kind = 0").select("doc", "size", "node", "sketch")
    often = first.where("kind = 1").groupBy("node").agg(F.sum("size").alias("times")).orderBy(F.desc("times"), "node").limit(FREQUENT_MOST)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["node"] for r in often.collect()], dtype=np.int64).view(np.uint64)))
    total = sets.agg(F.sum("size")).first()[0] or 0
    buckets = max(64, -(-6 * total // BUCKET_BYTES))  # about 0.6 keys of 10 bytes an element

    met = materialize(
        known.mapInArrow(_keys(percent, frequent, buckets), "bucket long, kind int, nodes binary, counts binary, keys binary")
        .groupBy("bucket")
        .applyInArrow(_groups, "kind int, a long, b long, rare long")
    )
    nodes = materialize(
        sets.where("node IS NOT NULL AND doc IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc").alias("doc"), F.min("size").alias("size"), F.min("sketch").alias("sketch"))
    )
    passed = met.where("kind = 2").select("a", "b").distinct()
    # The leader has fewest elements of its own, so it is near most of its group.
    least = met.where("kind = 2").groupBy("a").agg(F.min(F.struct("rare", "b"))["b"].alias("leader"))
    stars = passed.join(least, "a").where("leader != b").select(F.col("leader").alias("a"), "b")
    tested = materialize(met.where("kind = 0").select("a", "b").union(stars).distinct())
    links = materialize(_verified(tested, nodes, known, percent))

    # Members of a group that are still apart: those pairs, and no others, remain to be tested.
    member = met.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("node")).union(passed.select("a", "b"))
    label = components(links)
    rest = materialize(_apart(member, nodes, label, percent).join(tested, ["a", "b"], "left_anti"))
    found = materialize(_verified(rest, nodes, known, percent))
    if not found.isEmpty():
        links = links.union(found)
        label = components(links)

    # Sets of one doc_id hang together as well.
    both = sets.where("node IS NOT NULL AND doc IS NOT NULL").groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    if not both.isEmpty():
        label = components(links.union(sets.join(both, "doc").where("node != a").select("a", F.col("node").alias("b"))))
    whole = nodes.join(label, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("c"))
    smallest = whole.groupBy("c").agg(F.min("doc").alias("component_id"))
    of_node = whole.join(smallest, "c").select("node", "component_id")
    return sets.join(of_node, "node", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"),
        "node",
    )
