"""Ranked search against plain counting."""

import math
import re
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from dossier.llm import ranking

RNG = np.random.default_rng(12)
WORDS = ["".join(RNG.choice(list("abcdefgh"), 3)) for _ in range(120)] + ["é", "Ünï", "42", "日本"]
ODDS = 1 / np.arange(1, len(WORDS) + 1)


def prose(n):
    return "".join(w + RNG.choice([" ", "-", "\n", "_", "\x7f", ". "]) for w in RNG.choice(WORDS, n, p=ODDS / ODDS.sum()))


DOCS = [(i, prose(int(RNG.integers(1, 60)))) for i in range(400)]
DOCS += [(400 + i, DOCS[7][1].upper()) for i in range(30)] + [(7, DOCS[7][1]), (7, DOCS[7][1]), (None, DOCS[7][1]), (None, None), (900, None), (901, ""), (902, " -\n"), (903, "a" * 5000), (904, prose(4000)), (-5, DOCS[7][1]), (2**62, WORDS[0])]
ITEMS = [(i, prose(int(RNG.integers(1, 25)))) for i in range(25)] + [(3, WORDS[0]), (3, f"{WORDS[0]} {WORDS[0]} É é"), (80, None), (81, ""), (82, "zzzz"), (83, "a" * 5000)]


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    own = [(i, Counter(t), len(t)) for i, x in docs if (t := terms(x))]
    total = sum(n for *_, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in own:
            m = 100 - 25 + (25 * n * len(own)) // total
            s = sum(math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize(("k", "size", "part"), [(20, 4_000_000, 200_000), (5, 900, 30), (1, 20_000, 200_000)])
def test_search(spark, k, size, part):
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in DOCS], "doc_id bigint, text string, score int, q int").repartition(3)
    items = spark.createDataFrame([(i, x, 1) for i, x in ITEMS], "item_id bigint, text string, rank int")
    got = ranking.search(ranking.index(docs, size), items, k, terms=part)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(DOCS, ITEMS, k)))


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert ranking.search(ranking.index(none), items).count() == 0
    assert ranking.search(ranking.index(spark.createDataFrame([(1, " "), (2, None)], "doc_id bigint, text string")), items).count() == 0
    assert ranking.search(ranking.index(spark.createDataFrame(DOCS, "doc_id bigint, text string")), items.where("false")).count() == 0


def test_long_texts_are_split_between_terms():
    text = b"word " * 300_000 + b"x" * 3_000_000 + b" end"
    assert [w for p in ranking.pieces(text) for w in p] == text.split()


def test_block_bounds_spare_blocks():
    """A full heap and a frequent term beside a rare one: most blocks of the frequent term stay packed, with the same result."""
    texts = [f"often {'rare' if i % 500 == 0 else ''} " + "pad " * (i % 7) for i in range(3000)]
    row = ranking.indexed(pa.array(range(3000)), pa.array([x.encode() for x in texts]))
    cells = {c: row.column(c)[0] for c in row.schema.names}
    n, total = 3000, row.column("n_terms")[0].as_py()
    shard = ranking.Shard(cells, pa.array(["often", "rare"]), n, total)
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    weights = np.array([10, 5000])
    want = ranking.asked(shard, np.array([0, 1]), weights, none, 5)
    again = ranking.Shard(cells, pa.array(["often", "rare"]), n, total)
    got = ranking.asked(again, np.array([0, 1]), weights, want, 5)
    assert len(again.open) < len(shard.open) / 3
    assert got[0][0] == want[0][0]


def test_a_shard_is_a_row_group(spark):
    """Readers hold a row group at once, writers a hundred rows or a row group."""
    texts = spark.createDataFrame(DOCS, "doc_id bigint, text string").coalesce(1)
    files = ranking.index(texts, 900).inputFiles()
    found = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in files]
    assert sum(m.num_rows for m in found) > 20
    assert all(m.row_group(i).num_rows == 1 for m in found for i in range(m.num_row_groups))
