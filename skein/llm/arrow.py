"""Helpers for operators that run in Python on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII punctuation, deleted from words where an operator compares words without it.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text worked on at once; a longer text is one chunk.
CHUNK = 8 << 20


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts in column `text` of each piece hold about `most` bytes."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], np.int64) if batch.num_rows else np.zeros(0, np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return utf8(text and text.lower()).translate(None, PUNCTUATION).split()


def coded(words: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each word its number among the distinct words, and the distinct words' XXH64."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    return ids, np.fromiter([xxhash.xxh64_intdigest(w, seed) for w in seen], np.uint64, len(seen))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
