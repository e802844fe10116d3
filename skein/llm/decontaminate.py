"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every three consecutive words of a test item are a possible seed; of each item the rarer ones in the training corpus are
used. Where two or more seeds of an item fall close together in a document, the item is aligned with that passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import chunks, plain_words

GRAM = 3
#: Words of test items that are searched for at once; more items make more passes.
BLOCK_WORDS = 400_000


@dataclass
class Index:
    """A block of test items: word numbers from 1, items as word numbers, and the grams with the places they have."""

    vocab: dict[bytes, int]
    items: list[np.ndarray]
    names: list[int | None]
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # grams[i] is at places first[i] to first[i + 1]
    item: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, block: list[tuple[int | None, list[bytes]]]) -> Index:
        vocab: dict[bytes, int] = {}
        items = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words], np.int64) for _, words in block]
        codes = [_codes(x) for x in items]
        gram = np.concatenate([*codes, np.zeros(0, np.int64)])
        item = np.concatenate([*(np.full(len(c), i) for i, c in enumerate(codes)), np.zeros(0, np.int64)]).astype(np.int64)
        offset = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[order], return_index=True)
        return cls(vocab, items, [n for n, _ in block], grams, np.append(first, len(gram)), item[order], offset[order])

    def rare(self, counts: np.ndarray, share: float) -> np.ndarray:
        """Which places are seeds: each item's grams up to the given quantile of their corpus counts."""
        of = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        seed = np.zeros(len(self.item), bool)
        order = np.argsort(self.item, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(self.item[order])) + 1):
            c = counts[of[places]]
            seed[places] = c <= np.quantile(c, share) if len(c) else False
        return seed


def _codes(ids: np.ndarray) -> np.ndarray:
    """The gram at each place, 0 where a word is unknown; word numbers are under 2^21."""
    if len(ids) < GRAM:
        return ids[:0]
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    return np.where((a > 0) & (b > 0) & (c > 0), (a << 42) | (b << 21) | c, 0)


def _places(texts: list[str | None], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts with a 0 between two, where each text starts, and the places with a known gram."""
    get = index.vocab.get
    ids: list[int] = []
    starts = []
    for text in texts:
        starts.append(len(ids))
        ids += [get(w, 0) for w in plain_words(text)]
        ids.append(0)
    every = np.array(ids, np.int64)
    codes = _codes(every)
    at = np.flatnonzero(codes)
    g = np.searchsorted(index.grams, codes[at])
    g[g == len(index.grams)] = 0
    hit = index.grams[g] == codes[at] if len(index.grams) else np.zeros(len(at), bool)
    return every, np.array(starts, np.int64), np.stack((at[hit], g[hit]))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score (a match 1, a mismatch or gap -1) and where it starts and ends in passage; of
    equal ones the one that ends first. Word number 0 matches nothing. Each score carries where its alignment starts, so
    two rows of the matrix are held, whatever the passage's length."""
    m = len(item)
    score, origin = np.zeros(m + 1, np.int32), np.zeros(m + 1, np.int64)
    best, span = 0, (0, 0)
    step, place = np.arange(m + 1, dtype=np.int32), np.arange(m + 1)
    for i in range(1, len(passage) + 1):
        word = passage[i - 1]
        diagonal = np.full(m + 1, -1, np.int32)
        diagonal[1:] = score[:-1] + np.where((item == word) & (word > 0), 1, -1)
        row = np.maximum(np.maximum(diagonal, score - 1), 0)
        begun = np.where(row == diagonal, np.concatenate(([i], np.where(score[:-1] > 0, origin[:-1], i - 1))), np.where(row > 0, origin, i))
        reach = np.maximum.accumulate(row + step)  # gaps in the passage
        begun = begun[np.maximum.accumulate(np.where(row + step == reach, place, 0))]
        score, origin = reach - step, begun
        top = int(score.argmax())
        if score[top] > best:
            best, span = int(score[top]), (int(origin[top]), i)
    return best, *span


def seeds_needed(size: int, least: float) -> int:
    """Distinct seeds that a passage needs to be aligned: two, but one for items so short that a copy which reaches the
    threshold may keep no more than one."""
    return 2 if least * size > 4 * GRAM else 1


def find(texts: list[str | None], index: Index, seed: np.ndarray, least: float) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """By (text, item): score, first word, end word and seeds of the best alignment that reaches `least`."""
    ids, starts, (at, g) = _places(texts, index)
    if not len(at):
        return {}
    many = np.diff(index.first)[g]
    place = np.repeat(index.first[g], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(at, many)
    ok = seed[place]
    at, item, offset = at[ok], index.item[place[ok]], index.offset[place[ok]]
    doc = np.searchsorted(starts, at, side="right") - 1
    if not len(at):
        return {}
    order = np.lexsort((at, item, doc))
    at, item, offset, doc = at[order], item[order], offset[order], doc[order]
    size = np.array([len(x) for x in index.items], np.int64)
    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > size[item[1:]])))
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(at))
    ends = np.append(starts[1:], len(ids)) - 1
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
        i, k = int(item[a]), int(doc[a])
        need = min(2, int(size[i]) - GRAM + 1)
        if b - a < need or len(set(offset[a:b].tolist())) < need:
            continue
        lo = max(int(starts[k]), int(at[a]) - int(size[i]))
        hi = min(int(ends[k]), int(at[b - 1]) + GRAM + int(size[i]))
        if np.isin(index.items[i], ids[lo:hi]).sum() < least * size[i]:
            continue
        score, x, y = align(index.items[i], ids[lo:hi])
        if score >= least * size[i] and score / size[i] > best.get((k, i), (0.0,))[0]:
            best[k, i] = (score / int(size[i]), lo + x - int(starts[k]), lo + y - int(starts[k]), b - a)
    return best


def _search(index: Index, seed: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            best = find(batch.column(1).to_pylist(), index, seed, least)
            keys = list(best)
            found = [best[k] for k in keys]
            docs = batch.column(0).take(pa.array([k for k, _ in keys], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs.cast(pa.int64()), pa.array([index.names[i] for _, i in keys], pa.int64()), *(pa.array([f[j] for f in found], t) for j, t in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "item_id", "score", "first_word", "end_word", "seeds"])

    return run


def _clean(index: Index, seed: np.ndarray, least: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            stays = np.ones(batch.num_rows, bool)
            stays[[k for k, _ in find(batch.column(text).to_pylist(), index, seed, least)]] = False
            yield batch.filter(pa.array(stays))

    return run


def _counts(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.grams), np.int64)
        for batch in chunks(batches, 1):
            total += np.bincount(_places(batch.column(1).to_pylist(), index)[2][1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["g", "n"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = plain_words(row.text)
        if len(words) >= GRAM:
            block.append((row.item_id, words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _indexes(texts: DataFrame, benchmark: DataFrame, share: float) -> Iterator[tuple[Index, np.ndarray]]:
    """Each block's index and its seeds, after a pass that counts the block's grams in all texts."""
    for block in _blocks(benchmark):
        index = Index.of(block)
        counts = np.zeros(len(index.grams), np.int64)
        for row in texts.mapInArrow(_counts(index), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
            counts[row.g] = row.n
        yield index, index.rare(counts, share)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, share: float = 0.75) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word, seeds: one row for each document and test item with an alignment
    score of at least `least` times the item's words; documents without such an item have no row.

    Words are lower-cased and lose ASCII punctuation. Seeds are, of each item, the grams up to the quantile `share` of
    their counts in the corpus: an item that leaked into many documents keeps seeds. Test items are read in blocks of
    BLOCK_WORDS words; what a task holds is one block's index, whatever their number. Items of fewer than three words
    match nothing; a copy edited so often that fewer seeds stay than seeds_needed is not found. Of equal alignments the
    first in the text counts. Null and empty texts match nothing; a text of any length is searched whole; a null doc_id or
    item_id is passed on; repeated rows give repeated rows; an empty table on either side gives an empty table; other
    columns are ignored."""
    schema = "doc_id long, item_id long, score double, first_word long, end_word long, seeds long"
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for index, seed in _indexes(texts, benchmark, share):
        found = texts.mapInArrow(_search(index, seed, least), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, share: float = 0.75) -> DataFrame:
    """The rows of docs, with all their columns, that leak no test item; odd rows as in leaks."""
    out = docs
    for index, seed in _indexes(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, share):
        out = out.mapInArrow(_clean(index, seed, least, docs.columns.index("text")), docs.schema)
    return out
