"""The pipeline's stages, each on its own input, against brute force; awkward rows and clashing names."""

import pytest

import corpus_pipeline
from dossier.llm import contamination, copies, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `_rid` string, n int, `row` string, `_text` string, hot string"
LONG = "The meeting of the town council was held on a rainy evening and lasted until well after midnight because nobody wanted to give way on the matter of the bridge. "


def prose(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 977}" for i in range(n))


ITEM = prose(90, 14)
TEXTS = [None, "", " \t", "one two", "one two", prose(1, 60), prose(1, 60), prose(1, 59) + " other", prose(2, 60), prose(3, 30) + " " + ITEM, LONG * 2 + prose(4, 30), prose(5, 30) + LONG * 2, prose(6, 4000)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", len(t or ""), "r", i, "w", "t", "h") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, (None, "a null id", None, None, None, None, None, None, None, None)], SCHEMA)
    docs.coalesce(1).write.parquet(f"{d}/documents.parquet")
    docs.limit(0).write.parquet(f"{d}/empty.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (5, 8, 10, 99)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_near_duplicates(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect() if r["doc_id"] is not None)
    kept = []
    for i, t in enumerate(TEXTS):  # chains of near copies: joined to any earlier text
        own = shingles(t)
        if not any(len(own & shingles(u)) / len(own | shingles(u)) >= 0.8 for u in TEXTS[:i]):
            kept.append(i)
    assert got == kept
    assert corpus_pipeline.near_duplicates(spark, docs, folder).columns == docs.columns


def test_repeated_strings(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_strings(spark, docs, folder).collect()}
    seen, n = set(), corpus_pipeline.REPEATED
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - n + 1):
            if data[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(data[p : p + n])
        assert (got[i] or "") == bytes(x for x, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert LONG in got[10] and LONG not in got[11] and got[0] is None


def test_decontamination(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.decontaminated(spark, docs, folder).collect()]
    assert len(got) == len(TEXTS) and set(range(len(TEXTS))) - set(got) == {9}


@pytest.mark.parametrize("most", [10**6, 1])
def test_contamination_against_brute_force(spark, monkeypatch, most):
    """The same with a benchmark that is broadcast and with one that isn't."""
    import re

    monkeypatch.setattr(contamination, "BROADCAST_ROWS", most)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {1: ITEM, 2: "one two", 3: None, 4: "w1 W2 é", 5: prose(6, 4000)[300:420]}
    texts = {i: t for i, t in enumerate([*TEXTS, "x w1, W2; É y", "x w1 w2 é one-two", ITEM + " " + ITEM])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in contamination.contamination(docs, spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()}
    want = {}
    for i, t in texts.items():
        w = words(t)
        hit, found = set(), set()
        for k, x in items.items():
            own = words(x)
            for p in range(max(1, len(own) - 9)) if own else ():
                win = own[p : p + 10]
                for q in range(len(w) - len(win) + 1):
                    if w[q : q + len(win)] == win:
                        hit |= set(range(q, q + len(win)))
                        found.add(str(k))
        want[i] = (len(w), len(hit), sorted(found))
    assert got == want


def test_quality(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.quality_filter(spark, docs, folder)
    assert got.columns == docs.columns
    ids = {r["doc_id"] for r in got.collect()}
    assert {0, 1, 2, 5, 8, 10} <= ids and None in ids


def test_toxic_words(spark):
    clean = [prose(i, 40) for i in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(clean)] + [(100 + i, f"{prose(i + 200, 20)} Idiot, {prose(i + 300, 20)}", "en") for i in range(12)] + [(200, prose(400, 20) + " IDIOT! " + prose(401, 20) + " idiot", "en"), (203, prose(403, 20) + " (idiot)", "en"), (201, prose(402, 40), "en"), (202, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(12)], "doc_id bigint, quality int, toxic int")
    found = quality.suspect_words(docs, labels, quality.trusted_rows(docs, labels))
    assert found == {"idiot"}
    rows = quality.judged(docs, labels).collect()
    got = {r["doc_id"]: (r["n_suspect"], r["rejected"]) for r in rows}
    assert all(r["rejected"] == (r["n_suspect"] > 1 or (r["log_perplexity"] or 0) > r["threshold"]) for r in rows if r["threshold"] is not None)
    assert got[200] == (2, True) and got[203][0] == 1 and got[201] == (0, False) and got[202] == (0, False) and not any(got[i][1] for i in range(60))


def test_copies_are_kept_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r["_rid"] for r in copies.drop_near_copies(docs).collect()} <= {"r", None}


def test_empty_tables(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/empty.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, empty, folder)
        assert got.columns == empty.columns and got.count() == 0


def test_run(spark, folder):
    import hashlib

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert 9 not in got and 6 not in got and {5, 8, 10, 11} <= set(got)
    data = got[8]
    assert data["decoded_sha256"] == hashlib.sha256(TEXTS[8].encode()).hexdigest() and data["n_tokens"] == len(data["ids"])
