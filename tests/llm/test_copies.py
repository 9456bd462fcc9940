"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import itertools

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from dossier.llm import copies
from dossier.llm.common import save
from dossier.llm.simhash import fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def brute(texts):
    """The first of each component of pairs with a similarity of 0.8 or more, and how many pairs there are under 0.9."""
    sets = [grams(t) for t in texts]
    root, between = list(range(len(texts))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        union = len(sets[i] | sets[j])
        if 5 * both >= 4 * union:
            between += 10 * both < 9 * union
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}, between


@pytest.mark.parametrize("piece", [512, 3])
def test_stage_drops_what_brute_force_drops(spark, monkeypatch, piece):
    monkeypatch.setattr(copies, "PIECE", piece)
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(2000)]
    texts = []
    for k in range(60):
        base = list(rng.choice(words, 200))
        texts.append(" ".join(base))
        for _ in range(2):
            other = list(base)
            for at in rng.choice(200, int(rng.integers(2, 7)), replace=False):
                other[at] = f"changed{k}"
            texts.append(" ".join(other))
    chain = list(rng.choice(words, 200))  # each like the one before, the last unlike the first
    for k in range(12):
        chain[k * 15 + 3] = f"link{k}"
        texts.append(" ".join(chain))
    texts += ["", " ", "one", "one", "One two"]
    want, between = brute(texts)
    assert between > 60
    docs = save(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3), "documents")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_what_simhash_links_is_compared_without_bands(spark, monkeypatch):
    """Near copies whose fingerprints link (op1's method) are found even if no band says so; those that aren't similar enough stay."""
    monkeypatch.setattr(copies, "bands", lambda grams: np.array([xxhash.xxh64_intdigest(grams.tobytes() + bytes([i])) >> 1 for i in range(copies.BANDS)], np.int64))
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(2000)]
    texts = []
    for k in range(12):
        base = list(rng.choice(words, 300))
        texts.append(" ".join(base))
        base[k] = f"changed{k}"
        texts.append(" ".join(base))
        texts.append(" ".join(rng.choice(words, 300)))
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if bin((fingerprint(texts[i].encode(), 3) ^ fingerprint(texts[j].encode(), 3)) & (2**64 - 1)).count("1") <= 3]
    want = brute(texts)[0]
    assert len(links) > 6
    docs = save(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3), "documents")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(range(len(texts))) - {j for _, j in links}
    assert want <= got
