"""The training-data operators against brute force, with the awkward cases of the tables' columns."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from dossier.llm import bpe, contamination, html, langid, lines, mixing, neighbours, quality, simhash, suffixes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghij"), 4)) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def texts():
    shared, base = prose(120), prose(200)
    near = base.split()
    near[50] = "changed"
    return [None, "", " \n\t", "one", "one", base, base, " ".join(near), prose(30) + " " + shared, shared + " " + prose(40), "a" * 900, prose(3000), "É Übung " + prose(20)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None)], SCHEMA).withColumnRenamed("source", "fp").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, texts, empty):
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs, largest=4).collect() if r["doc_id"] is not None}
    fp = {i: simhash.fingerprint((t or "").encode(), 3) for i, t in enumerate(texts)}
    assert {i: x[0] for i, x in got.items()} == fp
    near = {i: {j for j in fp if ((fp[i] ^ fp[j]) & (2**64 - 1)).bit_count() <= 3} for i in fp}
    for i in fp:
        reach, todo = set(), {i}
        while todo:
            reach |= todo
            todo = set().union(*(near[j] for j in todo)) - reach
        assert got[i][1] == min(reach)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("batch", [3, 10_000])
def test_hot_blocks_are_split(spark, batch):
    """With batches of three rows a block of more than eight is handed on over many batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        check_hot_blocks(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def check_hot_blocks(spark):
    base = int(RNG.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in RNG.integers(0, 62, (200, 2))})
    edges = simhash.close_edges(spark.createDataFrame([(x,) for x in fps], "fp bigint"), 3, largest=8).collect()
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert ((e["a"] ^ e["b"]) & (2**64 - 1)).bit_count() <= 3
        root[find(e["a"])] = find(e["b"])
    want = {x: x for x in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                x, y = a, b
                while want[x] != x:
                    x = want[x]
                while want[y] != y:
                    y = want[y]
                want[x] = y
    assert len({find(x) for x in fps}) == sum(want[x] == x for x in fps)


@pytest.mark.parametrize("hot", [200_000, 1])
def test_suffixes(docs, texts, empty, hot):
    every = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        every.update(b[p : p + 400] for p in range(len(b) - 399))
    want = {}
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if every[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        want[hashlib.md5(b).digest()] = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
    got = {bytes(r["key"]): [tuple(s) for s in r["spans"]] for r in suffixes.repeats(docs, hot=hot, run=50).collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert suffixes.repeats(empty).count() == 0


def test_merge_is_sorted():
    entries = sorted((RNG.choice(list(b"ab"), 12).astype(np.uint8).tobytes(), b"", i, 0) for i in range(300))
    runs = [suffixes.front_coded(entries[i::7]) for i in range(7)]
    got = list(suffixes.merged(runs))
    assert [e[0] for _, e in got] == [e[0] for e in entries]
    assert all(k == suffixes.common(a[0], b[0]) for (_, a), (k, b) in zip(got, got[1:], strict=False))


def test_contamination(spark, docs, texts, empty):
    bench = spark.createDataFrame([(1, " ".join(texts[11].split()[100:115])), (2, "one"), (3, None), (4, "!!"), (5, "É übung")], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in contamination.contamination(docs, bench).collect()}
    assert got[11] == (15, ["1"]) and got[3] == (1, ["2"]) and got[0] == (0, []) and got[5] == (0, [])
    assert got[12] == (0, [])  # only A-Z are lower-cased
    assert contamination.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert contamination.contamination(empty, bench).count() == 0


def test_bpe(docs, texts, empty):
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encoded(docs, path, p.PATTERN)
    got = {r["doc_id"]: r["ids"] for r in rows.collect()}
    assert all(got[i] == enc.encode_ordinary(t or "") for i, t in enumerate(texts))
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decoded(rows, path, p.PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    assert bpe.encoded(empty, path, p.PATTERN).count() == 0


def test_lines(spark, empty):
    rows = [(2, "x\nA  b\n\n"), (1, "a B\nx"), (3, None), (4, ""), (2, "x")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in lines.drop_repeated_lines(docs, least=1, short=1).collect()}
    assert got == {(1, "a B\nx", 0), (2, "\n", 2), (2, "", 1), (3, None, 0), (4, "", 0)}
    assert lines.drop_repeated_lines(empty).count() == 0


def test_language(spark, empty):
    rows = [(i, prose(30) if i % 2 else prose(30).translate(str.maketrans("abcdefghij", "qrstuvwxyz")), "en" if i % 2 else "xx", None, None) for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, None, "en", None, None), (41, "12 34", None, None, None)], SCHEMA)
    got = {r["doc_id"]: r for r in langid.identified(docs, docs.where("doc_id < 20")).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "xx") and 0 <= got[i]["score"] <= 1 for i in range(40))
    assert got[40]["lang_pred"] == got[41]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in langid.identified(docs, empty).collect()} == {"und"}


def test_quality(spark, docs, empty):
    good = [(i, prose(60), "en", None, None) for i in range(60)]
    bad = [(100 + i, " | ".join(w.upper() + "%%" for w in prose(40).split()), "en", None, None) for i in range(5)]
    table = spark.createDataFrame([*good, *bad, (200, None, None, None, None), (201, "", "fr", None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["rejected"] for r in quality.judged(table, labels).collect()}
    assert all(got[100 + i] for i in range(5)) and sum(got[i] for i in range(60)) <= 1 and not got[200] and not got[201]
    assert quality.judged(empty, labels).count() == 0


def test_mixing(docs, texts):
    flagged = docs.withColumn("out", docs["doc_id"] >= 9)
    got = {r["doc_id"]: r for r in mixing.scores(flagged, "out").collect()}
    train = Counter(w for i, t in enumerate(texts[:9]) for w in [*(t or "").encode().lower().split(), None])
    n = sum(train.values())
    for i, t in enumerate(texts):
        w = [*(t or "").encode().lower().split(), None]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in train for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((train[x] + 1) / (n + len(train) + 1)) for x in w))
        assert r["score"] < 0
    assert got[5]["score"] > got[11]["score"] * len(texts[5]) / len(texts[11])


def test_neighbours(spark):
    x = RNG.normal(size=(600, 8)).astype(float)
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (800, [0.0] * 8), (900, [float("nan")] * 8), (1000, [1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id % 100 = 0"), leaf=32, trees=4, leaves=60).toPandas()
    assert set(got["query_id"]) == {0, 100, 200, 300, 400, 500}
    hit = 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        own = own.sort_values("rank")
        assert own["score"].is_monotonic_increasing and len(own) == 10
        hit += len(set(best) & set(own["vec_id"]))
    assert hit / 60 >= 0.9
    assert neighbours.nearest(table.limit(0), table).count() == 0


def test_html(spark):
    page = '<html><head><title>T</title><script>var a="</p>"</script></head><body><nav><a href=/>Menu</a></nav><div class="ad">Buy this now, it is very good, really.</div><article><h1>Head</h1><p><b>First &amp; long, with words.<br><p>Second   one, also\nlong.</article><footer>&copy; foot</footer>'
    assert html.main_text(page) == "Head\nFirst & long, with words.\nSecond one, also long."
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>a <b")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extracted(pages).collect()}
    assert got[2] == got[3] == "" and got[4] == "a"
