"""Decoding keeps the order of tokens, and a worker holds no second merge table."""

import numpy as np
import public_tokenizers

from dossier.llm import bpe


def coder():
    return bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_runs_of_tokens_keep_their_order():
    """Runs of many lengths in one call, over the size of a vector of the database, against a table of the tokens' bytes."""
    c, rng = coder(), np.random.default_rng(3)
    size = np.concatenate([rng.integers(0, 9, 20_000), [5000, 0, 1]])
    token = rng.integers(0, len(c.ranks), int(size.sum()))
    of = {r: b for b, r in c.ranks.items()}
    edge = np.concatenate([[0], np.cumsum(size)])
    assert c.decode(size, token) == [b"".join(of[int(t)] for t in token[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def test_worker_holds_merges_once():
    """The merge table as Python objects is built for huge pieces alone."""
    bpe.coder.cache_clear()
    c = coder()
    assert not [k for k, v in vars(c).items() if isinstance(v, list) and len(v) > 1000]
    want = c.heaped(b"ab" * 5000)
    assert c.decode(np.array([len(want)]), want) == [b"ab" * 5000]


def test_rounds_without_a_sort(monkeypatch):
    """Rows handed on in order give the tokens of the sorting query; rows out of order are noticed and sorted."""
    c, rng = coder(), np.random.default_rng(5)
    pieces = [bytes(rng.choice(list(b"abcdeinrst "), int(n))) for n in rng.integers(2, 250, 300)]
    assert "ORDER BY" not in bpe.UNSORTED
    want = [x.tolist() for x in c.merged(pieces, bpe.ENCODE)]
    assert [x.tolist() for x in c.merged(pieces, bpe.UNSORTED)] == want
    monkeypatch.setattr(bpe, "UNSORTED", bpe.UNSORTED + " ORDER BY hash(key)")
    assert [x.tolist() for x in c.merged(pieces, bpe.UNSORTED)] == want


def test_pieces_met_again_are_remembered_first(monkeypatch):
    """From task to task a worker keeps the pieces that texts share, not any that were met last."""
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "WAITING", 200)
    c = bpe.Coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for _ in c.encode(["shared " + " ".join(f"q{chr(97 + t)}{chr(97 + i // 26)}{chr(97 + i % 26)}zz" for i in range(300)) for t in range(6)]):
        pass
    c.rest()
    assert len(c.known) <= 50
    assert "shared" in c.known
