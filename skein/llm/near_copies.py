"""Near copies of whole documents: SimHash with pigeonring filtering, then the exact Jaccard of word shingles, at least 4/5.

Two texts are compared if their SimHash fingerprints differ in at most simhash.BITS bits, found by the pigeonring keys of
simhash.py, or share a MinHash band. The fingerprints alone can't reach the bound: at a Jaccard of 0.8 two of them differ in
10 bits on average and often in 16, and keys for so wide a budget would let unrelated texts meet. The bands are there for
the pairs beyond the budget: 32 keys of 4 minima each miss a pair at the bound with a probability of 5e-8, closer ones with
less. Candidates only say which texts belong to one family; families meet in pairs of blocks, where each candidate pair is
tested by its exact Jaccard, and only the links of a spanning tree are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import chunks
from .common import components, materialise
from .simhash import BITS, condensed, linked_fingerprints, shingles

SIZE = 5
#: Texts are near copies if they share so many parts of so many of their distinct shingles.
SHARED, OF = 4, 5
BANDS, ROWS = 32, 4
#: Texts of a family that are compared in one task; larger families are compared block by block.
BLOCK = 512
_FACTORS = np.random.default_rng(8).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(9).integers(1, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    return _distinct(shingles(text, size))


def _distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; sets without any share all keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[at : at + 4096, None] * _FACTORS).min(axis=0))
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)


def _keyed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 2):
            fps, keys = [], []
            for text in b.column(2).to_pylist():
                hashes = shingles(text, size)
                fps.append(condensed(hashes))
                keys.append(bands(_distinct(hashes)).view(np.int64))
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "t", "fp", "keys"])

    return run


def tree(texts: list[str | None], size: int = SIZE) -> list[tuple[int, int]]:
    """Links that span the groups of near copies among the texts; each is compared only with those not reached yet."""
    hashes = [shingles(t, size) for t in texts]
    fps, sets = np.array([condensed(h) for h in hashes], np.uint64), [_distinct(h) for h in hashes]
    sizes = np.array([len(s) for s in sets])
    keys = np.array([bands(s) for s in sets]).reshape(len(sets), BANDS)
    left, todo, out = np.arange(len(sets)), [], []
    while todo or len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        at = todo.pop()
        n = sizes[left]
        fits = (keys[left] == keys[at]).any(axis=1) | (np.bitwise_count(fps[left] ^ fps[at]) <= BITS)
        fits &= OF * np.minimum(n, sizes[at]) >= SHARED * np.maximum(n, sizes[at])
        for i in np.flatnonzero(fits).tolist():
            other = sets[left[i]]
            place = np.searchsorted(sets[at], other)
            place[place == len(sets[at])] = 0
            both = int((sets[at][place] == other).sum()) if len(other) else 0
            fits[i] = (OF + SHARED) * both >= SHARED * (len(other) + len(sets[at]))
        near = left[fits].tolist()
        out += [(at, i) for i in near]
        todo += near
        left = left[~fits]
    return out


def _linked(size: int):
    def links(ids: list[int], texts: list[str | None]) -> pa.RecordBatch:
        pairs = [(ids[i], ids[j]) for i, j in tree(texts, size)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts = None, [], []
        for b in chunks(batches, 2):
            for k, t, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if len(ids) > 1:
                        yield links(ids, texts)
                    key, ids, texts = k, [], []
                ids.append(t)
                texts.append(text)
        if len(ids) > 1:
            yield links(ids, texts)

    return run


def _near_prints(distinct: DataFrame) -> DataFrame:
    """a, b: enough links to connect all texts (t, fp) whose fingerprints differ in at most BITS bits."""
    first = materialise(distinct.groupBy("fp").agg(F.min("t").alias("low")))
    one, two = first.toDF("a", "t_a"), first.toDF("b", "t_b")
    near = linked_fingerprints(first).distinct().join(one, "a").join(two, "b").select(F.col("t_a").alias("a"), F.col("t_b").alias("b"))
    return near.union(distinct.join(first, "fp").where("t <> low").select("t", "low"))


def _groups(own: DataFrame, size: int) -> DataFrame:
    """t, c: the group of each distinct text, by its hash. own: doc_id, t, text."""
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = own.mapInArrow(_keyed(size), "doc_id long, t long, fp long, keys array<long>")
    distinct = materialise(prints.groupBy("t").agg(F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    keyed = distinct.select("t", F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min("t").alias("low"), F.count("*").alias("n")).where("n > 1")
    banded = keyed.join(low, "key").where("t <> low").select(F.col("t").alias("a"), F.col("low").alias("b"))
    family = components(_near_prints(distinct.select("t", "fp")).union(banded))
    family = materialise(family.distinct())
    blocks = family.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    texts = own.join(family, own["t"] == family["node"]).groupBy("t", "component").agg(F.min("text").alias("text")).join(blocks, "component")
    split = texts.withColumn("own", F.pmod(F.xxhash64("t"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    split = split.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "t", "text")
    group = components(split.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_linked(size), "a long, b long"))
    return distinct.join(group, distinct["t"] == group["node"], "left").select("t", F.coalesce("component", "t").alias("c"))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def near_copies(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, component_id for each row of docs (doc_id, text); component_id is the smallest doc_id reachable over links
    of texts whose sets of `size`-word shingles have a Jaccard of at least SHARED / OF.

    Shingles and equal texts are told apart by 64-bit hashes. Null, empty and blank texts are copies of each other; texts
    of fewer than `size` words are one shingle; a very long text is read whole; repeated rows give repeated rows; null
    doc_ids are never a component's id unless nothing else is there; an empty table gives an empty table; other columns are
    ignored."""
    own = _own(docs)
    named = own.select("doc_id", "t").join(_groups(own, size), "t")
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "c").select("doc_id", "component_id")


def first_copies(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row of docs, with all its columns, for each group of near copies: the one with the smallest doc_id (null last)
    and, of rows that repeat it, the one with the smallest hash of its text. Texts as in near_copies; rows that repeat
    doc_id and text count as copies, and one of them stays."""
    own = _own(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("t").alias("t"))
    first = own.select("doc_id", "t").join(_groups(own, size), "t").groupBy("c").agg(F.min(rank).alias("f")).select("f.id", F.col("f.t").alias("first_t"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_t"))
    kept = rows.join(first, (F.col("row_t") == F.col("first_t")) & F.col("row_id").eqNullSafe(F.col("id")))
    place = F.row_number().over(Window.partitionBy("row_t", "row_id").orderBy(F.lit(1)))
    return kept.withColumn("place", place).where("place = 1").select("row.*")
