"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is a ring of 16 segments of 4 bits. If two fingerprints differ in at most k = 4 bits, some segment
starts a chain whose first l segments differ in at most l * k / 16 bits, for every l up to 16. So its first three
segments agree and its next four hold at most one difference: three of these four agree too. Those six segments make
the join key, 64 keys a fingerprint, 24 bits each; a pair that meets is tested for the whole chain and then by its
Hamming distance. Only distinct fingerprints meet, and in a large group only the links of a spanning tree are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

BITS = 4
SEGMENTS = 16
#: Fingerprints of one key that are compared in one task; larger groups are compared block by block.
BLOCK = 20_000


def shingles(text: str | None, size: int) -> list[int]:
    """The 64-bit hash of each run of `size` words, of all words if there are fewer; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, size: int = 4) -> int:
    return condensed(shingles(text, size))


def condensed(hashes: list[int]) -> int:
    """The bits that are set in over half the hashes."""
    if not hashes:
        return 0
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp long (the fingerprint's bits, signed) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def chained(x: np.ndarray) -> np.ndarray:
    """Whether the differences x (uint64) have a start from which every chain keeps within its budget."""
    nibble = np.stack([np.bitwise_count((x >> np.uint64(4 * i)) & np.uint64(15)) for i in range(SEGMENTS)], axis=-1)
    budget = np.arange(1, SEGMENTS + 1) * BITS // SEGMENTS
    fits = np.zeros(x.shape, bool)
    for i in range(SEGMENTS):
        fits |= (np.cumsum(np.roll(nibble, -i, axis=-1), axis=-1, dtype=np.int16) <= budget).all(axis=-1)
    return fits


def _linked(x: np.ndarray) -> np.ndarray:
    near = chained(x)
    near[near] = np.bitwise_count(x[near]) <= BITS
    return near


def _tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one group; each fingerprint is compared only with those not reached yet."""
    left, a, b = fps[1:], [], []
    todo = [fps[0]]
    while todo or len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        at = todo.pop()
        near = np.bitwise_count(left ^ at) <= BITS
        if near.any():
            near[near] = chained(left[near] ^ at)
            found = left[near]
            a.append(np.full(len(found), at))
            b.append(found)
            todo.extend(found)
            left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """key is sorted; whole groups only."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lengths = np.diff(np.append(starts, len(key)))
    a, b = [], []
    large = lengths > 48
    for s, n in zip(starts[large].tolist(), lengths[large].tolist(), strict=True):
        x, y = _tree(np.unique(fp[s : s + n]))
        a.append(x), b.append(y)
    room = np.repeat(np.where(large, 0, starts + lengths), lengths)  # end of each row's group
    i = np.arange(len(key))
    for step in range(1, 48):
        i = i[i + step < room[i]]
        if not len(i):
            break
        near = np.bitwise_count(fp[i] ^ fp[i + step]) <= BITS
        x, y = fp[i[near]], fp[i[near] + step]
        ok = _linked(x ^ y) if len(x) else near[:0]
        a.append(x[ok]), b.append(y[ok])
    return np.concatenate(a) if a else fp[:0], np.concatenate(b) if b else fp[:0]


def _keyed(fps: DataFrame) -> DataFrame:
    """key, fp: the 64 keys of each fingerprint: the start's number above 24 bits of it, and which segment is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = []
                for i in range(SEGMENTS):
                    r = (fp >> np.uint64(4 * i)) | (fp << np.uint64((64 - 4 * i) % 64)) if i else fp
                    for out in range(4):
                        kept = [0, 1, 2, *(3 + j for j in range(4) if j != out)]
                        bits = sum(((r >> np.uint64(4 * s)) & np.uint64(15)) << np.uint64(4 * n) for n, s in enumerate(kept))
                        keys.append(bits | np.uint64((i * 4 + out) << 24))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, 64).view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the rows of each key; rows come sorted by key, and the last key waits for the next batch."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if len(key) and (cut := int(np.searchsorted(key, key[-1]))) > 50_000:
            yield _edges(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield _edges(key, fp)


def _edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    a, b = _links(key, fp)
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p).view(np.int64)) for p in pairs], names=["a", "b"])


def linked_fingerprints(fps: DataFrame) -> DataFrame:
    """a, b: enough of the links among distinct fingerprints (fp) to connect all that are linked. A key that more than
    BLOCK fingerprints share is cut into blocks, and each two blocks meet in a task of their own."""
    keyed = materialise(_keyed(fps))
    hot = materialise(keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).alias("blocks")))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot.isEmpty():
        return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_grouped, "a long, b long")
    cold = keyed.join(hot, "key", "left_anti").select(F.xxhash64("key").alias("key"), "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    split = keyed.join(hot, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    split = split.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    return cold.union(split).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_grouped, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text); component_id is the
    smallest doc_id reachable over links of at most 4 differing bits.

    Null, empty and blank texts have fingerprint zero, linked like any other; texts of fewer than `size` words are one
    shingle; repeated rows give repeated rows; null doc_ids are never a component's id unless nothing else is there; an
    empty table gives an empty table; other columns are ignored."""
    prints = materialise(fingerprints(docs, size))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    group = components(linked_fingerprints(distinct))
    named = distinct.join(group, distinct["fp"] == group["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = named.join(least, "c").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
