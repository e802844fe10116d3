"""The pipeline's near copies against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_first(texts):
    """The number of the first text of each one's group."""
    sets, first = [brute_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and first[i] != first[j]:
                a, b = sorted((first[i], first[j]))
                first = [a if f == b else f for f in first]
    return first


def copies():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(50):
        base = rng.choices(vocab, k=rng.choice([6, 30, 120, 300]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 3, 8])):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w[: len(w) - rng.randrange(1 + len(w) // 8)]))
    return [*texts, None, "", " \n", "one two", "One  TWO", "two one", texts[0], texts[5].upper()]


@pytest.mark.parametrize("block", [near_copies.BLOCK, 3])
def test_near_copies_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = copies()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    want = brute_first(texts)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    texts = copies()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    want = brute_first(texts)
    assert any(bin(simhash.fingerprint(t) ^ simhash.fingerprint(texts[f])).count("1") > 8 for t, f in zip(texts, want, strict=True))
    kept = corpus_pipeline.dedup_documents(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """Near copies whose SimHash fingerprints are close meet without any band in common."""
    apart = np.random.default_rng(4)
    monkeypatch.setattr(near_copies, "bands", lambda found: np.random.default_rng(found).integers(0, 1 << 63, 32, np.uint64))
    words = [f"w{apart.integers(10**9)}" for _ in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "end"]), " ".join(words[::-1]), " ".join(words[:200])]
    sets = [near_copies.shingle_set(t) for t in texts]
    assert 0 < bin(simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[1], 5)).count("1") <= simhash.BITS
    assert not set(near_copies.bands(sets[0])) & set(near_copies.bands(sets[1]))
    assert near_copies.tree(texts) == [(0, 1)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, df, "").collect()) == [0, 2, 3]
