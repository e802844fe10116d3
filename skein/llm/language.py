"""Language identification by a linear-chain conditional random field over words.

Each word's emission is the sum of weights of its prefixes, suffixes, character n-grams and, from a lexicon of the
words seen in training, the word itself; the chain has learned transitions between languages. Forward-backward gives
each word's posterior, so text that switches between languages is labelled word by word; a document gets the language
with the largest mean posterior.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import PUNCTUATION, chunks, utf8

SLOTS = 1 << 16
#: Documents that the model is fitted on, at most, for each language.
SAMPLE = 700
#: Words of a training sequence; sequences join pieces of documents in several languages.
LENGTH = 40
#: Bytes of words whose features are listed at once.
LONG = 4096
DROPPED = PUNCTUATION + b"0123456789"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation and digits."""
    return utf8(text and text.lower()).translate(None, DROPPED).split()


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "replace")) % (SLOTS - 1) + 1


def features(word: bytes, lexicon: dict[bytes, int]) -> list[int]:
    """Slots of the word's features; slot 0 is the lexicon's missing word, whose weight stays 0."""
    b = f"<{word.decode('utf-8', 'replace')}>"
    return _affixes(b) + [_slot(b[i : i + n]) for n in (2, 3) for i in range(len(b) + 1 - n)] + ([SLOTS + lexicon[word]] if word in lexicon else [])


def _affixes(b: str) -> list[int]:
    return [_slot(name) for name in (f"p{b[:2]}", f"p{b[:3]}", f"p{b[:4]}", f"s{b[-2:]}", f"s{b[-3:]}", f"s{b[-4:]}")]


@dataclass
class Model:
    langs: list[str]
    lexicon: dict[bytes, int]
    weight: np.ndarray  # features x languages
    move: np.ndarray  # log transition scores
    start: np.ndarray
    known: dict[bytes, np.ndarray] = field(default_factory=dict, repr=False)

    def emissions(self, distinct: list[bytes]) -> np.ndarray:
        """exp of the emission scores of distinct words; words met before are remembered."""
        fresh = [w for w in distinct if w not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > 400_000:
                self.known.clear()
                fresh = distinct
            slots = [features(w, self.lexicon) if len(w) <= LONG else [0] for w in fresh]
            sizes = np.array([len(s) for s in slots])
            flat = np.fromiter((x for s in slots for x in s), np.int64, int(sizes.sum()))
            e = np.add.reduceat(self.weight[flat], np.cumsum(sizes) - sizes, axis=0)
            for i, w in enumerate(fresh):
                if len(w) > LONG:
                    e[i] = self._long(w)
            e = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -30)).astype(np.float32)
            self.known.update(zip(fresh, e, strict=True))
        return np.array([self.known[w] for w in distinct], np.float32).reshape(-1, len(self.langs))

    def _long(self, word: bytes) -> np.ndarray:
        """The sum of weights of a long word's features, piece by piece: text without white space is one word."""
        b = f"<{word.decode('utf-8', 'replace')}>"
        total = self.weight[_affixes(b)].sum(axis=0, dtype=float)
        if word in self.lexicon:
            total = total + self.weight[SLOTS + self.lexicon[word]]
        for at in range(0, len(b), LONG):
            piece = b[at : at + LONG + 2]
            total = total + self.weight[[_slot(piece[i : i + n]) for n in (2, 3) for i in range(min(LONG, len(piece) + 1 - n))]].sum(axis=0, dtype=float)
        return total

    def posteriors(self, texts: list[str | None], summed: bool = True) -> list[np.ndarray]:
        """For each text its words' posteriors summed over words, or one row a word."""
        found = [words_of(t) for t in texts]
        seen: dict[bytes, int] = {}
        ids = [np.fromiter([seen.setdefault(w, len(seen)) for w in ws], np.int64, len(ws)) for ws in found]
        k = len(self.langs)
        out = [np.zeros(k) if summed else np.zeros((0, k))] * len(texts)
        if not seen:
            return out
        table = self.emissions(list(seen))
        order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: -len(ids[i]))
        move, start = np.exp(self.move).astype(np.float32), np.exp(self.start).astype(np.float32)
        at = 0
        while at < len(order):
            longest = len(ids[order[at]])
            group = order[at : at + max(1, min(512, 1_500_000 // longest))]
            at += len(group)
            for i, p in zip(group, self._smoothed([ids[i] for i in group], table, move, start, summed), strict=True):
                out[i] = p
        return out

    def _smoothed(self, ids: list[np.ndarray], table: np.ndarray, move: np.ndarray, start: np.ndarray, summed: bool) -> list[np.ndarray]:
        """Forward-backward over sequences sorted by falling length; step t works on those that reach it."""
        sizes = np.array([len(x) for x in ids])
        longest = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        code = np.zeros((longest, len(ids)), np.int32)
        for j, x in enumerate(ids):
            code[: len(x), j] = x
        forward = np.empty((longest, len(ids), len(start)), np.float32)
        a = start * table[code[0]]
        forward[0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, longest):
            n = active[t]
            a = (forward[t - 1, :n] @ move) * table[code[t, :n]]
            forward[t, :n] = a / a.sum(axis=1, keepdims=True)
        back = np.ones((len(ids), len(start)), np.float32)
        total = np.zeros((len(ids), len(start)))
        each = np.zeros((0 if summed else longest, len(ids), len(start)))
        for t in range(longest - 1, -1, -1):
            n = active[t]
            g = forward[t, :n] * back[:n]
            g /= g.sum(axis=1, keepdims=True)
            total[:n] += g
            if not summed:
                each[t, :n] = g
            if t:
                b = (table[code[t, :n]] * back[:n]) @ move.T
                back[:n] = b / b.sum(axis=1, keepdims=True)
        return list(total) if summed else [each[:n, j] for j, n in enumerate(sizes.tolist())]


def _sequences(by_lang: list[list[list[bytes]]], rng: np.random.Generator, n: int) -> list[tuple[list[bytes], list[int]]]:
    """Sequences of LENGTH words from runs of documents; the language changes now and then."""
    out = []
    for _ in range(n):
        words: list[bytes] = []
        tags: list[int] = []
        lang = int(rng.integers(len(by_lang)))
        while len(words) < LENGTH:
            doc = by_lang[lang][int(rng.integers(len(by_lang[lang])))]
            size = min(len(doc), LENGTH - len(words), 1 + int(rng.geometric(0.08)))
            at = int(rng.integers(len(doc) - size + 1))
            words += doc[at : at + size]
            tags += [lang] * size
            lang = int(rng.integers(len(by_lang)))
        out.append((words, tags))
    return out


def fit(texts: list[str], langs: list[str], sequences: int = 3000, rounds: int = 60, rate: float = 0.15) -> Model:
    """Maximises the conditional likelihood of synthetic code-switched sequences by Adam."""
    rng = np.random.default_rng(11)
    names = sorted(set(langs))
    by_lang = [[w for t, own in zip(texts, langs, strict=True) if own == name and (w := words_of(t))] for name in names]
    names, by_lang = [n for n, d in zip(names, by_lang, strict=True) if d], [d for d in by_lang if d]
    k = len(names)
    if k < 2:
        return Model(names or ["und"], {}, np.zeros((SLOTS, max(1, k))), np.zeros((max(1, k),) * 2), np.zeros(max(1, k)))
    made = _sequences(by_lang, rng, sequences)
    seen: dict[bytes, int] = {}
    code = np.array([[seen.setdefault(w, len(seen)) for w in words] for words, _ in made]).T
    tags = np.array([t for _, t in made]).T
    often = np.bincount(code.ravel())
    lexicon = {w: j for j, w in enumerate(w for w, i in seen.items() if often[i] >= 3)}
    slots = [features(w, lexicon) for w in seen]
    data = Sequences(code, tags, np.array([x for s in slots for x in s]), np.array([len(s) for s in slots]))
    params = [np.zeros((SLOTS + len(lexicon), k)), np.zeros((k, k)), np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        for i, g in enumerate(gradient(params, data)[1]):
            one, two = moments[i]
            one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
            moments[i] = one, two
            params[i] = params[i] + rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-5)
    return Model(names, lexicon, params[0].astype(np.float32), params[1], params[2])


@dataclass
class Sequences:
    code: np.ndarray  # step x sequence: the number of each word
    tags: np.ndarray  # and its language
    slots: np.ndarray  # of all words' features, one word after the other
    sizes: np.ndarray  # features of each word


def gradient(params: list[np.ndarray], data: Sequences, prior: float = 1e-4) -> tuple[float, list[np.ndarray]]:
    """The mean conditional log-likelihood of the tags with a Gaussian prior on the weights, and its gradient by weights,
    transitions and start."""
    weight, move, start = params
    (length, n), k = data.code.shape, len(start)
    heads, owner = np.cumsum(data.sizes) - data.sizes, np.repeat(np.arange(len(data.sizes)), data.sizes)
    raw = np.add.reduceat(weight[data.slots], heads, axis=0)
    top = raw.max(axis=1, keepdims=True)
    e = np.exp(np.maximum(raw - top, -30))[data.code]
    m, s = np.exp(move), np.exp(start)
    forward, value = np.empty((length, n, k)), top[data.code].sum()
    for t in range(length):
        a = (s if t == 0 else forward[t - 1] @ m) * e[t]
        total = a.sum(axis=1, keepdims=True)
        value += np.log(total).sum()
        forward[t] = a / total
    back, expected = np.ones((n, k)), np.zeros((k, k))
    gamma = np.empty_like(forward)
    for t in range(length - 1, -1, -1):
        g = forward[t] * back
        gamma[t] = g / g.sum(axis=1, keepdims=True)
        if t:
            right = e[t] * back
            pair = forward[t - 1][:, :, None] * m * right[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = right @ m.T
            back /= back.sum(axis=1, keepdims=True)
    hot = np.eye(k)[data.tags]
    error = hot - gamma
    by_word = np.stack([np.bincount(data.code.ravel(), error[:, :, j].ravel(), minlength=len(data.sizes)) for j in range(k)], axis=1)
    by_slot = np.stack([np.bincount(data.slots, by_word[owner, j], minlength=len(weight)) for j in range(k)], axis=1)
    actual = np.zeros((k, k))
    np.add.at(actual, (data.tags[:-1].ravel(), data.tags[1:].ravel()), 1)
    score = np.take_along_axis(raw[data.code], data.tags[:, :, None], axis=2).sum() + (actual * move).sum() + start[data.tags[0]].sum()
    return float((score - value) / n - prior * (weight**2).sum() / 2), [by_slot / n - prior * weight, (actual - expected) / n, (hot[0] - gamma[0]).mean(axis=0)]


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on up to about `sample` rows of each language of labelled (doc_id, text, lang), chosen by a hash of doc_id, in
    one task. Nulls are left out; an empty table gives a model without languages. The counts, a row a language, are
    broadcast: the number of languages is taken to be small, and a join by shuffle would deal all texts by language."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    chance = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("fit")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    rows = rows.join(F.broadcast(counts), "lang").where(chance * F.col("n") < 2**32 * sample).select("doc_id", "text", "lang")
    models = rows.repartition(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(bytes(models[0][0])) if models else fit([], [])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pickled model of all rows, whose number train bounds."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])


def _runs(p: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of words with one language, from the words' posteriors."""
    best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
    cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
    return [{"first": a, "end": b, "lang": langs[best[a]], "score": float(p[a:b, best[a]].mean())} for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _predicted(model: bytes, spans: bool):
    own: Model = pickle.loads(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            texts = batch.column(1).to_pylist()
            lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
            langs, scores, runs = [], [], []
            for ok, p in zip(lettered, own.posteriors([t if ok else None for t, ok in zip(texts, lettered, strict=True)], summed=not spans), strict=True):
                if spans:
                    runs.append(_runs(p, own.langs))
                    p = p.sum(axis=0)
                best = int(p.argmax())
                langs.append(own.langs[best] if ok and p.sum() > 0 else "und")
                scores.append(float(min(1.0, p[best] / p.sum())) if ok and p.sum() > 0 else 0.0)
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *([pa.array(runs, pa.list_(SPAN))] if spans else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", *(["spans"] if spans else [])])

    return run


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (the mean posterior of that language) for each row of docs (doc_id, text); with spans also
    the runs of words of one language (first word, end, lang, mean posterior), for text that switches.

    A null text or one without a letter is `und` with score 0; of languages with equal means the first by code point
    wins; a text of any length is read whole, long words piece by piece; repeated rows give repeated rows; null doc_ids are
    kept; an empty table gives an empty table; other columns are ignored. The prediction depends on the text alone."""
    kind = dict(docs.dtypes)["doc_id"]
    model.known.clear()
    schema = f"doc_id {kind}, lang_pred string, score double" + (", spans array<struct<first:bigint,end:bigint,lang:string,score:double>>" if spans else "")
    return docs.select("doc_id", "text").mapInArrow(_predicted(pickle.dumps(model), spans), schema)


def label_words(text: str, model: Model) -> list[tuple[str, str, float]]:
    """Each word of text with its language and posterior."""
    (p,) = model.posteriors([text], summed=False)
    return [(w.decode("utf-8", "replace"), model.langs[int(row.argmax())], float(row.max())) for w, row in zip(words_of(text), p, strict=True)]
