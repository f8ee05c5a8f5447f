"""Language identification of words by a linear-chain conditional random field.

Words are runs of letters. A word's score for each language adds learned weights of
its prefixes and suffixes of one to three bytes, its byte trigrams, and its membership
in each language's lexicon (words common in the training texts of that language), all hashed except the lexicon. A
learned matrix scores the step from one word's language to the next one's, so a chain of
words is labelled together, and text that switches language inside is labelled part by part.
Posteriors come from forward-backward. Chains are runs of up to ``CHAIN`` words of one text.

The model is fitted to at most ``per_language`` labelled texts of each language (lowest hashes of the id, texts above
``fit_bytes`` last) that come to ``fit_bytes`` bytes together; if the first one alone is longer, to as many of its characters. It is fitted by stochastic gradient of the conditional likelihood. Documents carry one label, so
training chains are spliced from runs of words of different documents; where the runs meet, steps
between languages are seen. Fitting takes one task, whose input is bounded as said; the
model has a fixed size and is broadcast. All texts are labelled whole, where they are read.

A document's language is the one with the highest mean posterior over its words, and that
mean is its score. Null texts and texts without a letter are ``und`` with score 0, and so is
every text if there is nothing to learn from. A null id is not held out and is not learned from.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gearwatch.llm.common import tidy
from gearwatch.llm.words import Words, mix, powers, slices
from gearwatch.llm.words import _BYTE

PER_LANGUAGE = 200
FIT_BYTES = 1 << 19  # UTF-8 bytes of one language's training texts at most
CHAIN = 64
TABLE = 1 << 15
LEXICON = 2000  # words of each language's lexicon at most
UNKNOWN = "und"
SLICE = 1 << 19  # text bytes labelled at once; each takes about a hundred bytes of memory
SEED = 11
_LETTER = regex.compile(r"\p{L}").search

NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


class Features:
    """Hashed features of the words of some texts; the texts are lower-cased first."""

    def __init__(self, texts: pa.Array):
        lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        self.words = words = Words(lowered, NOT_LETTER)
        data = words.data
        power, self.inverse = powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])
        self.start, self.end = words.start, words.end
        self.word = self._hash(self.start, self.end)

    def _hash(self, begin, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def affixes(self) -> np.ndarray:
        """(words, 6) places in the affix table."""
        out = []
        for n in (1, 2, 3):
            out.append(self._hash(self.start, np.minimum(self.start + n, self.end)) + np.uint64(n))
            out.append(self._hash(np.maximum(self.end - n, self.start), self.end) + np.uint64(n + 8))
        return np.stack([(mix(x) % np.uint64(TABLE)).astype(np.int32) for x in out], axis=1)

    def grams(self) -> np.ndarray:
        """Place in the trigram table of the three bytes from each byte on."""
        begin = np.arange(max(0, len(self.words.data) - 2))
        return (self._hash(begin, begin + 3) % np.uint64(TABLE)).astype(np.int32)


class Model:
    """Weights by language: affixes, grams, lexicon membership, bias; and the step matrix."""

    def __init__(self, languages: list[str], lexicon: dict[int, list[int]]):
        k = len(languages)
        self.languages = languages
        self.affix = np.zeros((TABLE, k), np.float32)
        self.gram = np.zeros((TABLE, k), np.float32)
        self.member = np.zeros((k, k), np.float32)
        self.bias = np.zeros(k, np.float32)
        self.step = np.zeros((k, k), np.float32)
        known = np.array(sorted(lexicon), dtype=np.uint64)
        self.lex_hash = known
        self.lex_in = np.zeros((len(known), k), np.float32)
        for row, h in enumerate(known.tolist()):
            self.lex_in[row, lexicon[h]] = 1

    def lexicon_rows(self, word: np.ndarray) -> np.ndarray:
        """Row of ``lex_in`` for each word, -1 for unknown words."""
        if not len(self.lex_hash):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.lex_hash, word), len(self.lex_hash) - 1)
        return np.where(self.lex_hash[at] == word, at, -1)

    def emissions(self, features: Features) -> np.ndarray:
        """(words, languages) scores."""
        place = features.affixes()
        out = self.bias + self.affix[place[:, 0]]
        for i in range(1, place.shape[1]):
            out += self.affix[place[:, i]]
        grams = features.grams()
        total = np.zeros((len(grams) + 1, len(self.languages)), dtype=np.float64)
        np.cumsum(self.gram[grams], axis=0, out=total[1:])
        first, last = np.minimum(features.start, len(grams)), np.minimum(np.maximum(features.end - 2, features.start), len(grams))
        out += (total[last] - total[first]).astype(np.float32)
        row = self.lexicon_rows(features.word)
        known = row >= 0
        out[known] += self.lex_in[row[known]] @ self.member
        return out


def forward_backward(score: np.ndarray, step: np.ndarray, length: np.ndarray, steps: bool = False):
    """Posteriors (chains, places, labels) of padded chains, and with ``steps`` the expected step counts."""
    n, t_max, k = score.shape
    local = np.exp(score - score.max(axis=2, keepdims=True))
    move = np.exp(step - step.max())
    alpha = np.empty_like(local)
    alpha[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, t_max):
        here = (alpha[:, t - 1] @ move) * local[:, t]
        alpha[:, t] = here / here.sum(axis=1, keepdims=True)
    beta = np.ones((n, k), dtype=local.dtype)
    post = np.empty_like(local)
    expected = np.zeros((k, k))
    for t in range(t_max - 1, -1, -1):
        inside = (t + 1 < length)[:, None]  # a next word exists
        if t + 1 < t_max:
            ahead = local[:, t + 1] * beta
            if steps:
                joint = alpha[:, t, :, None] * move * ahead[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                expected += joint[inside[:, 0]].sum(axis=0)
            back = ahead @ move.T
            beta = np.where(inside, back / back.sum(axis=1, keepdims=True), np.float32(1))
        both = alpha[:, t] * beta
        post[:, t] = both / both.sum(axis=1, keepdims=True)
    return (post, expected) if steps else post


def chained(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain for texts with ``count`` words each."""
    chains = -(-count // CHAIN)
    text = np.repeat(np.arange(len(count)), chains)
    number = np.arange(len(text)) - np.repeat(np.cumsum(chains) - chains, chains)
    first = (np.cumsum(count) - count)[text] + number * CHAIN
    return first, np.minimum(CHAIN, count[text] - number * CHAIN)


def word_posteriors(model: Model, features: Features) -> np.ndarray:
    """(words, languages) posteriors."""
    first, length = chained(features.words.count)
    score = model.emissions(features)
    out = np.empty_like(score)
    order = np.argsort(length, kind="stable")
    for low in range(0, len(order), 4096):  # chains of like length together, so padding stays small
        own = order[low : low + 4096]
        places = first[own][:, None] + np.arange(int(length[own].max()))
        inside = np.arange(places.shape[1]) < length[own][:, None]
        padded = score[np.minimum(places, len(score) - 1)]
        padded[~inside] = 0
        out[places[inside]] = forward_backward(padded, model.step, length[own])[inside]
    return out


def fit(texts: list[str], labels: list[str], rounds: int = 6, batch: int = 256, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """A model from labelled texts."""
    rng = np.random.default_rng(SEED)
    languages = sorted(set(labels))
    k = len(languages)
    of_text = np.array([languages.index(x) for x in labels])
    features = Features(pa.array(texts, pa.large_string()))
    words = features.words
    label = np.repeat(of_text, words.count)
    lexicon: dict[int, list[int]] = {}  # languages of each word
    for i in range(k):
        value, times = np.unique(features.word[label == i], return_counts=True)
        common = value[np.argsort(-times, kind="stable")[:LEXICON]]
        for h in common[np.sort(times)[::-1][: len(common)] > 1].tolist():
            lexicon.setdefault(h, []).append(i)
    model = Model(languages, lexicon)
    if not len(label):
        return model
    affix, grams, row = features.affixes(), features.grams(), model.lexicon_rows(features.word)
    # Chains of up to 64 words, spliced from runs of 8 to 32 words of any texts.
    runs = [(a, min(a + int(rng.integers(8, 33)), b)) for a, b in zip(words.first[:-1], words.first[1:]) for a in range(a, b, 32)]
    order = rng.permutation(len(runs))
    chains, now = [], []
    for r in order:
        now.extend(range(*runs[r]))
        if len(now) >= CHAIN:
            chains.append(np.array(now[:CHAIN]))
            now = []
    if now:
        chains.append(np.array(now))
    squares = [np.full_like(x, 1e-3) for x in (model.affix, model.gram, model.member, model.bias, model.step)]
    flat = lambda place, delta: np.stack([np.bincount(place, delta[:, i], TABLE) for i in range(k)], axis=1).astype(np.float32)
    for _ in range(rounds):
        for low in range(0, len(chains), batch):
            own = chains[low : low + batch]
            length = np.array([len(c) for c in own])
            places = np.zeros((len(own), int(length.max())), dtype=np.int64)
            for i, c in enumerate(own):
                places[i, : len(c)] = c
            inside = np.arange(places.shape[1]) < length[:, None]
            at = places[inside]
            gram_of, gram_word = _gram_list(features, at, len(grams))
            score = model.bias + model.affix[affix[at]].sum(axis=1)
            if len(gram_of):
                score = score + np.stack([np.bincount(gram_word, model.gram[grams[gram_of], i], len(at)) for i in range(k)], axis=1)
            known = row[at] >= 0
            score[known] += model.lex_in[row[at][known]] @ model.member
            padded = np.zeros((*places.shape, k))
            padded[inside] = score
            post, expected = forward_backward(padded, model.step.astype(float), length, steps=True)
            true = np.zeros((len(at), k))
            true[np.arange(len(at)), label[at]] = 1
            delta = true - post[inside]
            y = np.zeros(places.shape, dtype=np.int64)
            y[inside] = label[at]
            both = inside[:, 1:]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            grads = [
                flat(affix[at].ravel(), np.repeat(delta, affix.shape[1], axis=0)),
                flat(grams[gram_of], delta[gram_word]) if len(gram_of) else np.zeros_like(model.gram),
                (model.lex_in[row[at][known]].T @ delta[known]).astype(np.float32),
                delta.sum(axis=0).astype(np.float32),
                (seen - expected).astype(np.float32),
            ]
            for weight, grad, square in zip((model.affix, model.gram, model.member, model.bias, model.step), grads, squares):
                grad = grad / len(own) - decay * weight
                square += grad * grad
                weight += rate * grad / np.sqrt(square) * (grad != 0)
    return model


def _gram_list(features: Features, at: np.ndarray, n_grams: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all trigrams of the words ``at``, and which of those words each belongs to."""
    first = features.start[at]
    size = np.maximum(np.minimum(features.end[at] - 2, n_grams) - first, 0)
    word = np.repeat(np.arange(len(at)), size)
    return np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + first[word], word


def held_out(id_col: str = "doc_id"):
    """True for the quarter of ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, fit_bytes: int = FIT_BYTES) -> Model | None:
    """The model of the labelled documents that are not held out; None if there are none."""
    ident, text, lang = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    usable = docs.where(ident.isNotNull() & ~held_out(id_col) & lang.isNotNull() & text.isNotNull())
    long = F.octet_length("text") > fit_bytes
    order = Window.partitionBy("lang").orderBy(long, F.xxhash64("id"), "text")
    sofar = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sample = usable.select(ident.cast("long").alias("id"), text.alias("text"), lang.cast("string").alias("lang"))
    sample = sample.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    sample = sample.withColumn("sofar", sofar).where((F.col("sofar") <= fit_bytes) | (F.col("n") == 1))
    sample = sample.select("id", F.when(long, F.substring("text", 1, fit_bytes)).otherwise(F.col("text")).alias("text"), "lang").repartition(1)

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["id"], r["text"], r["lang"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r["text"] for r in rows], [r["lang"] for r in rows]))])], ["model"])

    made = sample.mapInArrow(tidy(run), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def predictions(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    features = Features(texts)
    words = features.words
    post = word_posteriors(model, features) if len(words.start) else np.zeros((0, len(model.languages)))
    total = np.zeros((len(post) + 1, len(model.languages)))
    np.cumsum(post, axis=0, out=total[1:])
    mean = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(words.count, 1)[:, None]
    best = mean.argmax(axis=1)
    has = [bool(t) and _LETTER(t) is not None for t in texts.to_pylist()]
    name = [model.languages[b] if ok and n else UNKNOWN for b, ok, n in zip(best.tolist(), has, words.count.tolist())]
    score = np.where([x != UNKNOWN for x in name], np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
    return name, score


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    source = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, SLICE):
                if shared.value is None or not shared.value.languages:
                    name, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                else:
                    name, score = predictions(shared.value, part.column(names.index(text)))
                made = [pa.array(name, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, "lang_pred", "score"])

    schema = StructType([*source.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    row = F.struct(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    return source.mapInArrow(tidy(run), schema).select(row.alias("row"), "lang_pred", "score")
