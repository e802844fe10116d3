"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score, the sum over its distinct words of the weights of
each word's features, and a document is toxic if any sentence is: p = 1 - product(1 - p_s). A word's features are the word
itself and its runs of 3 to 7 bytes, ends marked, so that unseen forms of an offensive stem score as well, in any
language. The weights are learned from document labels alone; the sentence scores then show where the offence is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import PUNCTUATION, chunks, mixed, utf8

#: Labelled documents that the model is fitted on, about; chosen by a hash of doc_id.
SAMPLE = 16_000
#: Toxic documents of the sample that need to have a feature.
LEAST_DOCS = 5
#: Bytes of the runs that are features, < and > marking a word's ends.
RUNS = (3, 4, 5, 6, 7)
#: Bytes of the shortest words that have features; shorter ones say nothing by themselves.
SHORTEST = 3
#: Hash slots of features.
SLOTS = 1 << 22
#: A feature's documents are toxic more often than the sample's, by at least so many nats of a binomial tail's bound.
EVIDENCE = 12.0
#: Words whose features are computed at once, and words whose scores are remembered by a task.
WORDS, KNOWN = 50_000, 500_000
STOP = b"\x01"
_FACTOR = 0x9E3779B97F4A7C15
_BACK = pow(_FACTOR, -1, 1 << 64)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation, with STOP after each sentence; . ! ? and newlines end sentences."""
    t = utf8(text and text.lower()).replace(STOP, b" ")
    for end in (b".", b"!", b"?", b"\n"):
        t = t.replace(end, b" \x01 ")
    return [*t.translate(None, PUNCTUATION).split(), STOP]


def word_slots(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The slots of the words' features, and whose they are, for WORDS words at a time. A run's hash comes from prefix sums
    of a polynomial, so the work is that of arrays."""
    for first in range(0, len(words), WORDS):
        some = words[first : first + WORDS]
        text = np.frombuffer(b"<" + b"><".join(some) + b">", np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, some), np.int64, len(some)) + 2
        stop = np.cumsum(size)
        power = np.cumprod(np.full(len(text), _FACTOR, np.uint64))
        back = np.cumprod(np.full(len(text), _BACK, np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text + np.uint64(1)) * power)))
        owner, at = np.repeat(np.arange(len(some), dtype=np.int32), size), np.arange(len(text))
        slots, owners = [], []
        for n in (0, *RUNS):
            begin = (stop - size)[size >= SHORTEST + 2] if n == 0 else at[(at + n <= stop[owner]) & (size[owner] >= SHORTEST + 2)]
            end = stop[owner[begin]] if n == 0 else begin + n
            slots.append((mixed((total[end] - total[begin]) * back[begin] + np.uint64(n)) % np.uint64(SLOTS)).astype(np.int32))
            owners.append(owner[begin] + np.int32(first))
        yield np.concatenate(slots), np.concatenate(owners)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate((x[:1] == x[:1], x[1:] != x[:-1]))]


def _coded(texts: list[str | None], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all tokens, new words being added to number (STOP: 0), and the tokens of each text."""
    parts, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = tokens(t)
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        sizes[i] = len(found)
    return np.concatenate(parts), sizes


def _bags(code: np.ndarray, sizes: np.ndarray, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sentence and word of each distinct pair with a useful word, and the text of each sentence."""
    stops = code == 0
    sentence = np.cumsum(stops) - stops
    text = np.repeat(np.arange(len(sizes)), sizes)[stops]
    hit = useful[code] & ~stops
    both = _distinct(sentence[hit] * len(useful) + code[hit])
    return both // len(useful), both % len(useful), text


def noisy_or(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The score of each of n texts, by the scores of their sentences."""
    return 1 - np.exp(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


@dataclass
class Model:
    slots: np.ndarray  # of the features, sorted
    weight: np.ndarray
    bias: float
    number: dict[bytes, int] = field(default_factory=lambda: {STOP: 0}, repr=False)
    known: np.ndarray = field(default_factory=lambda: np.zeros(1), repr=False)

    @classmethod
    def of(cls, words: dict[bytes, float], bias: float) -> Model:
        """A model of whole words only."""
        slots = np.array([next(word_slots([w]))[0][0] for w in words], np.int64)
        order = np.argsort(slots)
        return cls(slots[order], np.array(list(words.values()))[order], bias)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(len(words))
        out = np.zeros(len(words))
        for slot, owner in word_slots(words):
            at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            hit = self.slots[at] == slot
            out += np.bincount(owner[hit], self.weight[at[hit]], minlength=len(words))
        return out

    def sentence_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The score of every sentence, and its text's number."""
        if len(self.number) > KNOWN:
            self.number, self.known = {STOP: 0}, np.zeros(1)
        code, sizes = _coded(texts, self.number)
        fresh = list(self.number)[len(self.known) :]
        self.known = np.concatenate((self.known, self.word_scores(fresh)))
        sentence, word, text = _bags(code, sizes, self.known != 0)
        z = self.bias + np.bincount(sentence, self.known[word], minlength=len(text))
        return 1 / (1 + np.exp(-z)), text

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return noisy_or(*self.sentence_scores(texts), len(texts))


def _chosen(y: np.ndarray, code: np.ndarray, sizes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots whose documents are toxic significantly more often than the sample's, and the (slot, word) pairs of them
    as places among the chosen slots and numbers of words."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    both = _distinct(doc[code > 0] * len(words) + code[code > 0])
    doc, word = both // len(words), both % len(words)
    # here a document counts once for each word; what is no more frequent in toxic ones then needs no exact count
    rate = min(max(float(np.mean(y)), 1e-6), 1 - 1e-6)
    by_word = [np.bincount(word, y[doc] == label, minlength=len(words)) for label in (0, 1)]
    seen = [np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)]
    for slot, owner in word_slots(words[1:]):
        for label in (0, 1):
            seen[label] += np.bincount(slot, by_word[label][owner + 1], minlength=SLOTS).astype(np.float32)
    likely = (seen[1] >= LEAST_DOCS) & (seen[1] >= min(1.0, 1.3 * rate) * (seen[0] + seen[1]))
    kept = [(slot[k], owner[k] + np.int32(1)) for slot, owner in word_slots(words[1:]) for k in [likely[slot]]]
    slot, owner = (np.concatenate([np.zeros(0, np.int32), *x]) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int32),) * 2
    order = np.lexsort((slot, owner))
    slot, owner = slot[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(words) + 1))
    hits = [np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)]
    cuts = np.searchsorted(doc, np.arange(0, len(sizes) + 100, 100))
    for a, b in zip(cuts, cuts[1:], strict=False):
        d, w = doc[a:b], word[a:b]
        many = first[w + 1] - first[w]
        at = np.repeat(first[w] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pairs = _distinct(np.repeat(d, many) * SLOTS + slot[at])
        d, s = pairs // SLOTS, pairs % SLOTS
        for label in (0, 1):
            np.add.at(hits[label], s[y[d] == label], 1)
    used = np.flatnonzero(hits[1] >= LEAST_DOCS)
    n = (hits[0] + hits[1])[used]
    share = hits[1][used] / n
    nats = n * (share * np.log(share / rate) + np.where(share < 1, (1 - share) * np.log(np.maximum(1 - share, 1e-300) / (1 - rate)), 0))
    chosen = used[(share > rate) & (nats >= min(EVIDENCE, -LEAST_DOCS * np.log(rate)))]
    if not len(chosen):
        return chosen, slot[:0], owner[:0]
    at = np.minimum(np.searchsorted(chosen, slot), len(chosen) - 1)
    hit = chosen[at] == slot
    return chosen, at[hit], owner[hit]


def loss(weights: np.ndarray, sentence: np.ndarray, word: np.ndarray, text: np.ndarray, slot: np.ndarray, owner: np.ndarray, y: np.ndarray, n_words: int, prior: float, positive: float) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of noisy-or, toxic documents weighing `positive`, with a Gaussian prior, and its gradient by
    the weights and, last, the bias."""
    score = np.bincount(owner, weights[slot], minlength=n_words)
    z = weights[-1] + np.bincount(sentence, score[word], minlength=len(text))
    total = np.bincount(text, np.logaddexp(0, z), minlength=len(y))  # -log(1 - p)
    value = np.where(y > 0, positive * np.log(np.maximum(-np.expm1(-total), 1e-300)), -total).mean() - prior * (weights[:-1] ** 2).sum() / 2 / len(y)
    up = np.where(y > 0, positive * np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), -1.0)
    slope = up[text] / (1 + np.exp(-z)) / len(y)
    by_word = np.bincount(word, slope[sentence], minlength=n_words)
    by_slot = np.bincount(slot, by_word[owner], minlength=len(weights) - 1)
    return float(value), np.append(by_slot - prior * weights[:-1] / len(y), slope.sum())


def fit(texts: list[str | None], labels: np.ndarray, rounds: int = 150, rate: float = 0.08, prior: float = 0.1, positive: float = 2.0) -> Model:
    """Maximises the noisy-or likelihood of the whole sample by Adam, after choosing the features. Features of the same
    words are one in training and share its weight."""
    empty = Model(np.zeros(0, np.int64), np.zeros(0), -7.0)
    if not len(labels):
        return empty
    number, y = {STOP: 0}, (np.asarray(labels, float) > 0).astype(float)
    code, sizes = _coded(texts, number)
    chosen, slot, owner = _chosen(y, code, sizes, list(number))
    if not len(chosen):
        return empty
    useful = np.zeros(len(number), bool)
    useful[owner] = True
    sentence, word, text = _bags(code, sizes, useful)
    mark = np.bincount(slot, np.random.default_rng(5).random(len(number))[owner], minlength=len(chosen))
    _, group, members = np.unique(mark, return_inverse=True, return_counts=True)
    pairs = _distinct(group[slot] * len(number) + owner)
    slot, owner = pairs // len(number), pairs % len(number)
    # only useful words and sentences with one differ from the bias
    known, word = np.unique(word, return_inverse=True)
    keep = useful[owner] & np.isin(owner, known)
    slot, owner = slot[keep], np.searchsorted(known, owner[keep])
    weights = np.append(np.zeros(len(members)), -6.0)
    m, v = np.zeros(len(weights)), np.zeros(len(weights))
    for step in range(1, rounds + 1):
        _, grad = loss(weights, sentence, word, text, slot, owner, y, len(known), prior, positive)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        weights = weights + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    shared = (weights[:-1] / members)[group]
    keep = np.abs(shared) > 1e-4
    return Model(chosen[keep], shared[keep], float(weights[-1]))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about `sample` rows of labelled (doc_id, text, label 0/1), all of them if there are fewer, in one task."""
    rows = labelled.where("label is not null").select("doc_id", "text", "label")
    n = rows.count()
    if n > sample:
        rows = rows.where(F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("fit"))) < int(2**32 * sample / n))
    models = rows.repartition(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(bytes(models[0][0])) if models else fit([], np.zeros(0))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pickled model of all rows, whose number train bounds."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    model = fit([r[1] for r in rows], np.array([r[2] for r in rows]))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def _scored(model: bytes, where: float | None):
    own: Model = pickle.loads(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            p, text = own.sentence_scores(batch.column(1).to_pylist())
            columns, names = [batch.column(0), pa.array(noisy_or(p, text, batch.num_rows))], ["doc_id", "score"]
            if where is not None:
                number = np.arange(len(text)) - np.searchsorted(text, text)
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for i in np.flatnonzero(p >= where).tolist():
                    found[text[i]].append({"sentence": int(number[i]), "score": float(p[i])})
                kind = pa.list_(pa.struct([("sentence", pa.int64()), ("score", pa.float64())]))
                columns.append(pa.array(found, kind))
                names.append("offending")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _accepted(model: bytes, text: int, most: float):
    own: Model = pickle.loads(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            yield batch.filter(pa.array(own.scores(batch.column(text).to_pylist()) < most))

    return run


def accept(docs: DataFrame, model: Model, most: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under `most`; odd rows as in score."""
    return docs.mapInArrow(_accepted(pickle.dumps(model), docs.columns.index("text"), most), docs.schema)


def score(docs: DataFrame, model: Model, where: float | None = 0.3) -> DataFrame:
    """doc_id, score, offending for each row of docs (doc_id, text); offending lists the sentences (number from 0, score)
    that score at least `where`; with where None that column is left out.

    Null and empty texts are one empty sentence and get the bias' score; a very long text is scored whole, in memory
    of its size; equal texts tie; repeated rows give repeated rows; null doc_ids are kept; an empty table gives an empty
    table; other columns are ignored. The score depends on the text alone."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, score double" + (", offending array<struct<sentence:bigint,score:double>>" if where is not None else "")
    return docs.select("doc_id", "text").mapInArrow(_scored(pickle.dumps(model), where), schema)
