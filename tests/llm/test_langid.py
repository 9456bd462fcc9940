"""Rejection limits of op5_langid, and models of more rows than are broadcast."""

import numpy as np
import pytest

from dossier.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ALPHABETS = {"en": "abcdefghij", "xx": "pqrstuvwxy", "zz": "klmnoABCDE", "yy": "αβγδεζηθικ"}


@pytest.fixture(scope="module")
def docs(spark):
    """300 documents of each of four languages; the first two are learned."""
    rng = np.random.default_rng(3)
    rows = []
    for k, (lang, letters) in enumerate(ALPHABETS.items()):
        words = ["".join(rng.choice(list(letters), 4)) for _ in range(300)]
        rows += [(1000 * k + i, " ".join(rng.choice(words, 30)), lang, None, None) for i in range(300)]
    return spark.createDataFrame([*rows, (9000, None, "en", None, None), (9001, "12", None, None, None)], SCHEMA)


def test_unlearned_languages_are_refused(docs):
    got = langid.identified(docs, docs.where("lang in ('en', 'xx') and doc_id % 4 <> 2"), keep=("doc_id", "lang")).collect()
    held = [r for r in got if r["lang"] in ("en", "xx") and r["doc_id"] % 4 == 2]
    unknown = [r for r in got if r["lang"] in ("zz", "yy")]
    assert len(held) == 150 and sum(r["accepted"] for r in held) >= 135
    assert len(unknown) == 600 and not any(r["accepted"] for r in unknown)


def test_limits_do_not_depend_on_what_is_scored(docs):
    training = docs.where("lang in ('en', 'xx')")
    alone = langid.identified(docs.where("doc_id < 50"), training).collect()
    among = {r["doc_id"]: r for r in langid.identified(docs, training).collect()}
    assert all(among[r["doc_id"]] == r for r in alone)


def test_a_large_model_gives_the_same(docs, monkeypatch):
    training = docs.where("lang <> 'yy' and doc_id % 4 <> 2")
    want = sorted(langid.identified(docs, training).collect(), key=lambda r: r["doc_id"])
    monkeypatch.setattr(langid, "MOST_ROWS", 10)
    assert sorted(langid.identified(docs, training).collect(), key=lambda r: r["doc_id"]) == want
