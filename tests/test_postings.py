"""The table of postings against the search over the texts themselves: appends, pruned reads, near words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import postings, search

RNG = np.random.default_rng(8)
LETTERS = list("abcé")
TEXTS = [" ".join("".join(RNG.choice(LETTERS, int(RNG.integers(1, 9)))) for _ in range(int(RNG.integers(0, 30)))) for _ in range(200)] + [None, "", "Ação, AÇÃO e acao!", "x" * 40, "preventivamentes", "preventivamente"]


def rows(spark, lo, hi):
    data = [(i, 1, t, "d", t, None) for i, t in enumerate(TEXTS)][lo:hi]
    return spark.createDataFrame(data, "documento_id bigint, pagina int, texto string, tipo string, descricao string, data string")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    out = postings.Postings(spark, f"file://{tmp_path_factory.mktemp('postings')}/p")
    for lo, hi in ((0, 90), (90, 150), (150, len(TEXTS))):
        out.append(rows(spark, lo, hi), F.col("texto"))
    return out


@pytest.mark.parametrize("query", ["ab", "ação", "a b c", "zzz", ""])
def test_pages(spark, table, query):
    own = rows(spark, 0, len(TEXTS)).withColumn("texto", F.coalesce("texto", F.lit("")))
    got = [(r.documento_id, round(r.relevancia, 9)) for r in table.pages(query, 1000).collect()]
    assert got == [(r.documento_id, round(r.relevancia, 9)) for r in search.search_pages(own, query, 1000).collect()]


@pytest.mark.parametrize("query", ["ab", "acao e", "a b", "zzz ab", ""])
def test_events(spark, table, query):
    own = rows(spark, 0, len(TEXTS)).drop("tipo").withColumn("tipo", F.lit("")).withColumnRenamed("documento_id", "andamento_id")
    want = {r.andamento_id for r in search.search_events(own, query, 1000).collect()}
    assert {r.documento_id for r in table.events(rows(spark, 0, len(TEXTS)), query, 1000).collect()} == want


def test_questions_read_only_their_buckets(spark, table):
    found, n = table.of("ab")
    assert n == 1
    plan = found._jdf.queryExecution().executedPlan()
    pruned = str(plan.toString()).split("PartitionFilters: [")[1].split("]")[0]
    assert "balde" in pruned and "lote" in pruned
    plan.executeCollect()
    scan = plan.collectLeaves().head()
    files = len(table.table("postings").inputFiles())
    assert 0 < scan.metrics().get("numFiles").get().value() == files / postings.BUCKETS == 3  # of each append one


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("query", ["abcab", "cabbage", "preventivamnte", "preventivamenttes", "ba", "bcabc aab", "é"])
def test_near_words(spark, table, query):
    words = {w for t in TEXTS if t for w in spark.range(1).select(search.tokens(F.lit(t)).alias("w")).first().w} if not WORDS else WORDS
    WORDS.update(words)
    asked = spark.range(1).select(text.normalize_name(F.lit(query)).alias("q")).first().q.split()
    want = {(w, q) for w in words for q in asked if w.startswith(q) or distance(w, q) <= int(len(q) * 0.1 + 0.5)}
    assert {tuple(r) for r in table.near(query).collect()} == want
    own = rows(spark, 0, len(TEXTS)).withColumn("id", F.col("documento_id"))
    met = {(r.documento_id, r.pontos) for r in table.fuzzy(own, query, 1000).collect()}
    assert met == {(r.id, r.pontos) for r in search.search_prefix_fuzzy(own, query, 1000).collect()}
    assert bool(met) == bool(want)


WORDS = set()


def test_an_append_that_dies_is_not_seen(spark, tmp_path):
    out = postings.Postings(spark, f"file://{tmp_path}/p")
    assert out.pages("ab").count() == 0 and out.near("ab").count() == 0
    out.append(rows(spark, 0, 50), F.col("texto"))
    before = out.pages("ab", 1000).collect()
    out._write(out.table("postings").withColumn("lote", F.lit(2).cast("bigint")), "postings", "balde")  # as if it had ended here
    assert out.pages("ab", 1000).collect() == before
    assert out.append(rows(spark, 50, 60), F.col("texto")) == 2
    assert {r.documento_id for r in out.pages("a b c ab ba", 1000).collect()} <= set(range(60))


def test_folding_keeps_letters_letters():
    assert all(a.isalnum() == b.isalnum() for a, b in zip(text._FROM, text._TO, strict=True) if a != "\xa0")


def test_a_text_is_split_once(spark, tmp_path, monkeypatch):
    """The plan of an append folds each text in one place: it stood in the length, the words and a filter on their number."""
    from pyspark.sql import DataFrame

    from dossier.operators import postings

    plans = []
    write = postings.Postings._write

    def seen(self, df: DataFrame, name: str, *by: str) -> None:
        if name == "postings":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(self, df, name, *by)

    monkeypatch.setattr(postings.Postings, "_write", seen)
    rows = spark.createDataFrame([(1, "Été à Paris, l'été"), (2, None), (3, "x y")], "id bigint, texto string")
    found = postings.Postings(spark, f"file://{tmp_path}/p", "id bigint")
    found.append(rows, rows["texto"])
    assert plans[0].count("split(") == 1
    assert plans[0].count("hashpartitioning(id") == 1
    assert sorted(map(tuple, found.table("postings").select("id", "t", "tf", "n").collect())) == [(1, "A", 1, 5), (1, "ETE", 2, 5), (1, "L", 1, 5), (1, "PARIS", 1, 5), (3, "X", 1, 2), (3, "Y", 1, 2)]
