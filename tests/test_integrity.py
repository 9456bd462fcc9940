"""The digest tree: bounded leaves, stable under other rows' changes, comparisons that find what differs; places in an order."""

import hashlib

import pytest
from pyspark.sql import functions as F

from dossier.operators import integrity
from dossier.operators.order import placed

SCHEMA = "conteudo string, chave bigint, sha256 string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, data):
    return spark.createDataFrame([(c, k, sha(f"{c}{k}{v}")) for (c, k), v in data.items()], SCHEMA)


def tree(data, width):
    level = {}
    for (c, k), v in sorted(data.items()):
        level.setdefault((c, k // width), []).append(sha(f"{c}{k}{v}"))
    level, out, n = {b: sha("\n".join(x)) for b, x in level.items()}, [], 0
    while True:
        out += [(c, n, b, h) for (c, b), h in level.items()]
        if all(b == 0 for _, b in level):
            break
        up = {}
        for (c, b), h in sorted(level.items()):
            up.setdefault((c, b // width), []).append(h)
        level, n = {b: sha("\n".join(x)) for b, x in up.items()}, n + 1
    return [*out, (None, n + 1, 0, sha("\n".join(h for _, h in sorted(level.items()))))] if level else []


DATA = {("a", k): k for k in range(0, 300, 2)} | {("b", 1000): 1, ("c", 0): 1}


@pytest.mark.parametrize("data", [DATA, {("a", 0): 1}, {}])
def test_tree(spark, data):
    got = integrity.digest_tree(rows(spark, data), 4)
    assert sorted(((r.conteudo, r.nivel, r.bloco, r.sha256) for r in got.collect()), key=str) == sorted(tree(data, 4), key=str)
    n = {r.conteudo: r.linhas for r in integrity.totals(got, ("a", "b", "z")).collect()}
    assert n == {"a": sum(c == "a" for c, _ in data), "b": sum(c == "b" for c, _ in data), "z": 0}


@pytest.mark.parametrize(("gone", "came", "changed"), [([], [], []), ([("a", 10)], [("a", 11), ("b", 5)], [("a", 200), ("c", 0)]), ([("b", 1000)], [], []), ([], [("a", 9000)], [])])
def test_differences(spark, gone, came, changed):
    after = {k: v for k, v in DATA.items() if k not in gone} | {k: 0 for k in came} | {k: -1 for k in changed}
    old, new = rows(spark, DATA), rows(spark, after)
    leaves = integrity.differing_leaves(integrity.digest_tree(old, 4), integrity.digest_tree(new, 4), 4)
    assert {tuple(r) for r in leaves.collect()} == {(c, k // 4) for c, k in gone + came + changed}
    got = {(r.conteudo, r.chave): r.estado for r in integrity.differing_rows(old, new, leaves, 4).collect()}
    assert got == {k: "sumiu" for k in gone} | {k: "apareceu" for k in came} | {k: "mudou" for k in changed}


def test_places(spark):
    """Nulls first, ties apart, groups spread over tasks, sums of weights and totals."""
    data = [("x" if i % 3 else None, None if i == 7 else i // 2, i % 5) for i in range(200)] + [("y", 1, 2)]
    df = spark.createDataFrame(data, "g string, k int, w int").repartition(4)
    for weight, of in ((None, lambda r: 1), (F.col("w"), lambda r: r.w)):
        got = placed(df, ["g"], ["k", "w"], "p", weight, "t").collect()
        for g in (None, "x", "y"):
            own = sorted((r for r in got if r.g == g), key=lambda r: (r.k is not None, r.k or 0, r.w))
            ends = sorted((r.p, r.p + of(r)) for r in own)
            assert [e for _, e in ends[:-1]] == [s for s, _ in ends[1:]] and ends[0][0] == 0 and {r.t for r in own} == {ends[-1][1]}
            assert [r.p for r in own] == sorted(r.p for r in own)
    assert sorted(r.p for r in placed(df, [], ["k", "w"], "p").collect()) == list(range(201))
    assert placed(df.where("false"), [], ["k"]).count() == 0
