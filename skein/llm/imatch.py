"""Document fingerprints by I-Match with randomised lexicons.

Terms within a band of inverse document frequency are kept. Each of 64 lexicon subsets, drawn at random with densities
1/4 to 1/512, hashes the sorted distinct terms that a document has in it; the fingerprint is the list of these hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import chunks, coded, mixed, plain_words, utf8
from .common import materialise

SUBSETS = 64
#: Bytes of text for each range of documents.
PER_BUCKET = 8 << 20
#: Characters of text that are fingerprinted at once.
BLOCK = 1_000_000
#: Bytes of text whose terms are counted at once, and counts that a task holds before it passes them on.
PIECE, PENDING = 1 << 20, 1 << 20


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term number) of the distinct terms of each text, sorted, and the terms' hashes."""
    found = [plain_words(t) for t in texts]
    words = [w for ws in found for w in ws]
    ids, hashes = coded(words, 7)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), [len(w) for w in found])
    rank = np.empty(len(hashes), np.int64)
    order = np.argsort(hashes, kind="stable")
    rank[order] = np.arange(len(hashes))
    both = np.unique(text * max(1, len(hashes)) + rank[ids]) if len(ids) else text
    return both // max(1, len(hashes)), both % max(1, len(hashes)), hashes[order]


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of all parts, sorted, and their counts."""
    term, where = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
    n = np.zeros(len(term), np.int64)
    np.add.at(n, where, np.concatenate([n for _, n in found]))
    return term, n


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n: in how many texts each term is. Texts are cut into words a PIECE at a time, and counts of PENDING terms are
    held back to be summed."""
    found, pending = [], 0
    for batch in chunks(batches, 0, PIECE):
        _, term, hashes = _terms(batch.column(0).to_pylist())
        found.append((hashes, np.bincount(term, minlength=len(hashes))))
        pending += len(hashes)
        if pending > PENDING:
            found = [_summed(found)]
            pending = len(found[0][0])
            if 2 * pending > PENDING:
                yield _counts(*found[0])
                found, pending = [], 0
    if found:
        yield _counts(*_summed(found))


def _counts(term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])


def lexicon(docs: DataFrame, n: int, rarest: float = 0.002, commonest: float = 0.2) -> np.ndarray:
    """The terms (hashes, sorted) within the band: in a share of the n documents from rarest to commonest. Every term is
    counted exactly, over all documents. At most the distinct terms of an average document over `rarest` are in the
    band, however many documents there are, so the driver can hold them."""
    found = docs.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = found.where((F.col("n") >= rarest * n) & (F.col("n") <= commonest * n)).select("term").toArrow()
    return np.sort(band["term"].to_numpy().view(np.uint64))


def fingerprint_all(texts: list[str], band: np.ndarray) -> np.ndarray:
    """A row of 64 hashes of 16 bits for each text; 0 marks a subset in which the text has no term. A text without any
    term in the band is fingerprinted on all its terms."""
    out, at = [np.zeros((0, SUBSETS), np.uint16)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < BLOCK):
            size += len(texts[end])
            end += 1
        out.append(_fingerprints(texts[at:end], band))
        at = end
    return np.concatenate(out)


def _fingerprints(texts: list[str], band: np.ndarray) -> np.ndarray:
    text, term, hashes = _terms(texts)
    out = np.zeros((len(texts), SUBSETS), np.uint64)
    if not len(text):
        return out.astype(np.uint16)
    within = band[np.minimum(np.searchsorted(band, hashes), len(band) - 1)] == hashes if len(band) else np.zeros(len(hashes), bool)
    has = np.zeros(len(texts), bool)
    has[text[within[term]]] = True
    keep = within[term] | ~has[text]
    text, term = text[keep], term[keep]
    used, where = np.unique(term, return_inverse=True)
    for k in range(SUBSETS):
        drawn = mixed(hashes[used] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        member = drawn >> np.uint64(32) < np.uint64(1 << (30 - k % 8))  # a share of 2^-(2 + k % 8)
        at = np.flatnonzero(member[where])
        if len(at):
            row = text[at]
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[row[starts], k] = np.add.reduceat(mixed(drawn[where[at]] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1), starts)
            out[row[starts], k] |= np.uint64(1) << np.uint64(63)  # a sum may be 0
    return np.where(out > 0, mixed(out) % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of agreeing hashes among the subsets in which either has a term; two empty fingerprints agree."""
    some = (a > 0) | (b > 0)
    n = some.sum(axis=1)
    return np.where(n > 0, ((a == b) & some).sum(axis=1) / np.maximum(n, 1), 1.0)


def _pack(ends: np.ndarray | None):
    """bucket, tail, doc_id, v and the compressed text. With ends, of rows doc_id, v, text, dealt to their ranges; without,
    of rows bucket, doc_id, v, text that another range has at its tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in chunks(batches, 2 if ends is not None else 3, PIECE):
            *key, text = b.columns
            key = [_bucket(ends, key[0]), *key] if ends is not None else key
            tail = pa.array(np.full(b.num_rows, ends is None))
            yield pa.RecordBatch.from_arrays([key[0], tail, *key[1:], pa.array([z.compress(utf8(t.as_py())) for t in text], pa.binary())], names=["bucket", "tail", "doc_id", "v", "z"])

    return run


def _bucket(ends: np.ndarray, ids: pa.Array) -> pa.Array:
    """The range of each doc_id, by binary search; null ones are in the last."""
    bucket = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(ends), np.searchsorted(ends, ids.fill_null(0).to_numpy(zero_copy_only=False)))
    return pa.array(bucket.astype(np.int64))


def _dealt(ends: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_bucket(ends, b.column(0)), *b.columns], names=["bucket", "doc_id", "v"])

    return run


OUT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(band: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("tail", "doc_id", "v", "z")), strict=True), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
        texts = [unzip.decompress(r[3]).decode("utf-8", "surrogatepass") for r in rows]
        n = sum(not r[0] for r in rows)
        after = [texts[i + 1] if i + 1 < len(texts) else texts[i] for i in range(n)]
        edited = [t[: len(t) - len(t) // 4] + nxt[: len(t) // 4] for t, nxt in zip(texts, after, strict=False)]
        own, changed = fingerprint_all(texts, band), fingerprint_all(edited, band)
        following = np.concatenate((own[1:], own[-1:]))[:n]
        text = lambda f: [x.astype(">u2").tobytes().hex() for x in f]
        return pa.table([pa.array([r[1] for r in rows[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([utf8(e) for e in edited], pa.binary()).cast(pa.string(), safe=False), pa.array(text(own[:n]), pa.string()), pa.array(text(changed), pa.string()), pa.array(likeness(own[:n], changed)), pa.array(likeness(own[:n], following))], names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return run


def fingerprints(docs: DataFrame, rarest: float = 0.002, commonest: float = 0.2) -> DataFrame:
    """doc_id, n_chars, edited (the text whose last quarter comes from the next document), fingerprint,
    edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text).

    Documents follow each other by doc_id, null last, rows of one doc_id by a hash of the text, and the last is followed
    by the first. Null and empty texts have the fingerprint of zeros, as have texts of punctuation only; equal texts have equal fingerprints; a single
    row follows itself; an empty table gives an empty table; other columns are ignored. Documents are dealt by ranges of
    doc_id, sized by the bytes of text; a range also gets the first document of the next one. A very long text is
    fingerprinted whole; the rows of one doc_id, and those without any, are in one range and one task."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("v"), "text")
    size, n = base.agg(F.sum(F.octet_length("text")), F.count("*")).collect()[0]
    if not n:
        return spark.createDataFrame([], OUT)
    band = lexicon(base, n, rarest, commonest)
    buckets = max(4, int((size or 0) // PER_BUCKET))
    ends = np.array(sorted(set(base.where("doc_id is not null").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets))), np.int64)
    heads = base.select("doc_id", "v").mapInArrow(_dealt(ends), "bucket long, doc_id long, v long").groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")).alias("h"))
    heads = materialise(heads)
    # the range before each one gets its first document; all ranges but the last have one, as their ends are doc_ids
    last = heads.agg(F.max("bucket")).scalar()
    into = heads.select(F.when(F.col("bucket") == heads.agg(F.min("bucket")).scalar(), last).otherwise(F.col("bucket") - 1).alias("into"), F.col("h.doc_id").alias("head"), F.col("h.v").alias("head_v"))
    tails = base.join(into, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("v") == F.col("head_v"))).select(F.col("into").alias("bucket"), "doc_id", "v", "text")
    # dealt and compressed in one worker: texts reach Python once, and a task has one worker
    kind = "bucket long, tail boolean, doc_id long, v long, z binary"
    packed = base.mapInArrow(_pack(ends), kind).union(tails.mapInArrow(_pack(None), kind))
    return packed.groupBy("bucket").applyInArrow(_compare(band), OUT)
