"""Whose documents set the thresholds of op2_quality."""

import numpy as np
import pytest

from dossier.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark):
    """400 trusted documents of one language and 4 of another, each with junk."""
    rng = np.random.default_rng(9)
    rows = []
    for lang, n, letters, first in (("en", 400, "abcdefghij", 0), ("xx", 4, "klmnopqrst", 1000)):
        words = ["".join(rng.choice(list(letters), 4)) for _ in range(200)]
        rows += [(first + i, " ".join(rng.choice(words, 60)), lang, None, None) for i in range(n)]
        rows += [(first + 500 + i, " ".join("%|" + w.upper() for w in rng.choice(words, 60)), lang, None, None) for i in range(5)]
    labels = [(r[0], 1, 0) for r in rows if r[0] % 1000 < 500]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_every_language_has_a_threshold(tables, monkeypatch):
    monkeypatch.setattr(quality, "TRUSTED", 20)
    docs, labels = tables
    fitted = quality.trusted_rows(docs, labels).where("fitted").groupBy("lang").count().collect()
    assert dict(fitted)["xx"] == 4 and 5 <= dict(fitted)["en"] <= 40
    got = quality.judged(docs, labels).collect()
    assert all(r["threshold"] is not None for r in got)
    assert all(r["rejected"] for r in got if r["doc_id"] % 1000 >= 500)


def test_thresholds_cover_all_trusted_documents_outside_the_fit(tables):
    docs, labels = tables
    apart = {r["doc_id"] for r in quality.trusted_rows(docs, labels).where("not fitted").collect()}
    assert 40 <= len(apart) <= 120
    got = quality.judged(docs, labels, quantile=1.0, margin=1.0).collect()
    assert {r["threshold"] for r in got if r["lang"] == "en"} == {max(r["log_perplexity"] for r in got if r["doc_id"] in apart)}
