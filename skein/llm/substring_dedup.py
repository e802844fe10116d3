"""Substring dedup by super-k-mer partitioning.

A window is 20 consecutive words of a document. Its minimiser is the least hash among its runs of 5 words; consecutive
windows with the same minimiser travel as one packed string to the minimiser's bucket, where sorting finds the windows
that occur again. Equal strings are merged before the shuffle, and again in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import chunks, coded, mixed, utf8

WINDOW, RUN = 20, 5
#: Bytes of text for each bucket; packed strings hold about three times as much.
PER_BUCKET = 4 << 20
ODD = 0x9E3779B97F4A7C15
NONE = -(2**63)

Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries, built by doubling."""
    out, have, power = None, 0, 1
    block, size = h, 1
    while True:
        if n & size:
            if out is None:
                out, have = block, size
            else:  # out covers `have` entries; append a block of `size`
                m = min(len(out), len(block) - have)
                out = out[: max(m, 0)] * np.uint64(pow(ODD, size, 1 << 64)) + block[have : have + max(m, 0)]
                have += size
        if size * 2 > n:
            break
        m = max(len(block) - size, 0)
        block = block[:m] * np.uint64(pow(ODD, size, 1 << 64)) + block[size : size + m]
        size *= 2
    return mixed(out)


def _sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have < n:
        step = min(have, n - have)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def super_kmers(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed strings of all texts with text number, first window, window count and minimiser."""
    found = [t.split() for t in texts]
    counts = np.array([len(w) for w in found], np.int64)
    words = [w for ws in found for w in ws]
    empty = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return [], empty, empty, empty, np.zeros(0, np.uint64)
    ids, hashes = coded(words)
    least = _sliding_min(_run_hash(hashes[ids], RUN), WINDOW - RUN + 1)
    text = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    n = len(words) - WINDOW + 1
    at = np.arange(n)
    valid = at + WINDOW <= ends[text[:n]]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return [], empty, empty, empty, np.zeros(0, np.uint64)
    index = np.cumsum(fresh)
    windows = np.bincount(index[valid] - 1, minlength=len(first))
    joined = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate(([0], stop[:-1] + 1))
    packed = [joined[a:b] for a, b in zip(begin[first].tolist(), stop[first + windows + WINDOW - 2].tolist(), strict=True)]
    return packed, text[first], first - (ends - counts)[text[first]], windows, least[first]


def _merged(packed: list[bytes], d: np.ndarray, v: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, Spans]:
    """Which strings to keep (the earliest of equal ones), and the window spans known to occur earlier."""
    seen: dict[bytes, int] = {}
    of = np.empty(len(packed), np.int64)
    order = np.lexsort((s, v, d))
    for i in order.tolist():
        of[i] = seen.setdefault(packed[i], i)
    again = of != np.arange(len(packed))
    later = again & ((d != d[of]) | (v != v[of]) | (s != s[of]))
    return np.flatnonzero(~again), (d[later], v[later], s[later], s[later] + w[later])


def _repeats(packed: list[bytes], d: np.ndarray, v: np.ndarray, s: np.ndarray, w: np.ndarray) -> Spans:
    """Spans of windows, among these packed strings, whose words also start earlier."""
    words = b" ".join(packed).split(b" ")
    ids, hashes = coded(words)
    h = _run_hash(hashes[ids], WINDOW)
    base = np.concatenate(([0], np.cumsum(w + WINDOW - 1)[:-1]))
    which = np.repeat(np.arange(len(w)), w)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(w) - w, w)
    at = base[which] + offset
    h = h[at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twin = np.concatenate((same, [False])) | np.concatenate(([False], same))
    pick = order[twin]
    if not len(pick):
        return d[:0], v[:0], s[:0], s[:0]
    dd, vv, ss = d[which[pick]], v[which[pick]], s[which[pick]] + offset[pick]
    rank = np.lexsort((ss, vv, dd, h[pick]))
    pick, dd, vv, ss, hh = pick[rank], dd[rank], vv[rank], ss[rank], h[pick][rank]
    head = np.concatenate(([True], hh[1:] != hh[:-1]))
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    differs = np.zeros(len(pick), bool)
    for j in range(WINDOW):
        differs |= ids[at[pick] + j] != ids[at[pick[lead]] + j]
    if differs.any():  # two word sequences with one hash: sort these by the words themselves
        seen: dict[bytes, int] = {}
        for i in range(len(pick)):
            p = int(at[pick[i]])
            lead[i] = seen.setdefault(ids[p : p + WINDOW].tobytes(), i)
    later = (dd != dd[lead]) | (vv != vv[lead]) | (ss != ss[lead])
    dd, vv, ss = dd[later], vv[later], ss[later]
    rank = np.lexsort((ss, vv, dd))
    dd, vv, ss = dd[rank], vv[rank], ss[rank]
    if not len(ss):
        return dd, vv, ss, ss
    cut = np.concatenate(([True], (dd[1:] != dd[:-1]) | (vv[1:] != vv[:-1]) | (ss[1:] > ss[:-1] + 1)))
    last = np.append(np.flatnonzero(cut)[1:], len(ss)) - 1
    return dd[cut], vv[cut], ss[cut], ss[last] + 1


PACKED = "bucket long, packed binary, d binary, v binary, s binary, w binary"
SPANS = "d long, v long, a long, b long"


def _pack(buckets: int):
    names = ["bucket", "packed", "d", "v", "s", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in chunks(batches, 2):
            d0, v0 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            packed, text, s, w, least = super_kmers([utf8(t) for t in batch.column(2).to_pylist()])
            if not packed:
                continue
            d, v = d0[text], v0[text]
            keep, spans = _merged(packed, d, v, s, w)
            rows = []
            if len(spans[0]):
                rows.append((int(least[0] % np.uint64(buckets)), None, *(x.tobytes() for x in spans)))
            bucket = (least[keep] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keep, bucket = keep[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
            for x, y in zip(cuts, cuts[1:], strict=False):
                k = keep[x:y]
                rows.append((int(bucket[x]), zip_.compress(b"\n".join([packed[i] for i in k.tolist()])), d[k].tobytes(), v[k].tobytes(), s[k].tobytes(), w[k].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    return run


def _count(table: pa.Table) -> pa.Table:
    unzip = zstandard.ZstdDecompressor()
    out: list[Spans] = []
    packed: list[bytes] = []
    kept: list[list[np.ndarray]] = []
    for row in table.to_pylist():
        spans = [np.frombuffer(row[k], np.int64) for k in "dvsw"]
        if row["packed"] is None:
            out.append(tuple(spans))
        else:
            packed += unzip.decompress(row["packed"]).split(b"\n")
            kept.append(spans)
    if packed:
        d, v, s, w = (np.concatenate(x) for x in zip(*kept, strict=True))
        keep, spans = _merged(packed, d, v, s, w)
        out += [spans, _repeats([packed[i] for i in keep.tolist()], d[keep], v[keep], s[keep], w[keep])]
    return pa.table({n: np.concatenate(x) for n, x in zip("dvab", zip(*out, strict=True), strict=True)})


def repeated_spans(docs: DataFrame, buckets: int) -> DataFrame:
    """d, v, a, b: the windows of document (d, v) that start at words a to b-1 also start earlier. docs: d, v, text."""
    rows = docs.select("d", "v", "text").mapInArrow(_pack(buckets), PACKED)
    return rows.groupBy("bucket").applyInArrow(_count, SPANS)


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(utf8(t)) for t in batch.column(2).to_pylist()], pa.binary())], names=["d", "v", "z"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, total, gone = [], [], []
        for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = unzip.decompress(z).split()
            kept = words
            if spans:
                lost = np.zeros(len(words) + 1, np.int64)
                for x in spans:
                    lost[x["a"]] += 1
                    lost[x["b"] + WINDOW - 1] -= 1
                stays = np.cumsum(lost)[:-1] == 0
                kept = [w for w, ok in zip(words, stays.tolist(), strict=True) if ok]
            texts.append(b" ".join(kept).decode("utf-8", "replace"))
            total.append(len(words))
            gone.append(len(words) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["d", "text", "n_words", "n_removed"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed for each row of docs (doc_id, text).

    A word goes if a window of 20 words that covers it also starts earlier (smaller doc_id, or earlier in the same
    document); windows are judged on the input. Null texts have no words; texts of fewer than 20 words stay; a null
    doc_id sorts first; rows that repeat doc_id and text share one verdict, rows that repeat only the doc_id are
    ordered by a hash of the text; an empty table gives an empty table; other columns are ignored. The number of
    buckets follows the bytes of text, so that one bucket stays about as large at every size."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("d"), F.xxhash64("text").alias("v"), "text")
    size = base.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = max(8, int(size // PER_BUCKET))
    spans = repeated_spans(base, buckets).groupBy("d", "v").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    zipped = base.mapInArrow(_zip, "d long, v long, z binary")
    out = zipped.join(spans, ["d", "v"], "left").select("d", "z", "spans").mapInArrow(_cut, "d long, text string, n_words long, n_removed long")
    return out.select(F.nullif("d", F.lit(NONE)).alias("doc_id"), "text", "n_words", "n_removed")
