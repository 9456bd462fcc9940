"""Queries over whole tables and whole texts."""

import re
import unicodedata

from dossier.plans import queries


def test_all_texts_are_normalised_whole(spark, tmp_path):
    """Against Python's own decomposition: every language, and what stands far from the start."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "x" * 80 + " straße  Ñandú\tÄÖÜ¿¡", "de"), (-2, None, "es"), (-3, " É\n", None)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))

    def normal(text):
        if text is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
        return re.sub(r"\s+", " ", bare).strip().upper()

    want = {r["doc_id"]: normal(r["text"]) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    assert {r["doc_id"]: r["nome"] for r in queries.queries()["n1_texts"](spark, str(tmp_path)).collect()} == want


def test_distance_goes_on_until_nothing_new_is_met(spark, tmp_path):
    chain = [(o, s) for o in range(1, 6) for s in (o, o + 1)]  # s1 - o1 - s2 - o2 - ... - s6
    spark.createDataFrame([*chain, (99, 99)], "l_orderkey bigint, l_suppkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["id"]: r["distancia"] for r in queries.g9_distance(spark, str(tmp_path)).collect()}
    assert got == {f"s{k}": 2 * k - 2 for k in range(1, 7)} | {f"o{k}": 2 * k - 1 for k in range(1, 6)}
