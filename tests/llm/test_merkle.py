"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from dossier.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, at string, grp int, h string"
BIG = 2**53 + 1
DOCS = [(i, "s" if i % 3 else None, ("en", "de", None)[min(i % 5, 2)], None if i % 11 == 0 else i, None if i % 13 == 0 else "é" * (i % 4)) for i in range(70)]
DOCS += [(7, "s", "en", 7, "é"), (7, "s", "en", 7, "é"), (None, None, None, None, None), (BIG, "", "é", 1, "x" * 100_000), (BIG + 1, "", "Z", 1, "")]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    for level in levels[:-1]:
        yield i % 2, [level[i ^ 1]] if i ^ 1 < len(level) else []
        i //= 2


def brute(docs):
    least = lambda x: (x is not None, x if x is not None else 0)
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((d for d in docs if d[2] == g), key=lambda d: (least(d[0]), tree(d))) for g in langs}
    trees = {g: grown([tree(d) for d in own[g]]) for g in langs}
    over = grown([trees[g][-1][0] for g in langs])
    root = over[-1][0]
    for k, g in enumerate(langs):
        for i, d in enumerate(own[g]):
            steps = [*path(trees[g], i), *path(over, k)]
            h = tree(d)
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None:
                h = tree((*d[:3], d[3] + 1, d[4]))
            for odd, kin in steps:
                h = sha(*kin, h) if odd else sha(h, *kin)
            yield d[0], tree(d), trees[g][-1][0], root, sha(*(x for _, kin in steps for x in kin)), h, h == root


@pytest.mark.parametrize(("rows", "width"), [(DOCS, 2), (DOCS, 4), (DOCS, 512), (DOCS[:1], 4), (DOCS[1:2] * 3, 2), ([d for d in DOCS if d[2] is None], 4)])
def test_manifest(spark, rows, width):
    docs = spark.createDataFrame([(*d, "x", 1, "y") for d in rows], SCHEMA).repartition(3)
    got = merkle.documents_manifest(docs, width).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert any(not r["verified"] for r in got) or len(rows) < 5


def test_no_rows(spark):
    got = merkle.documents_manifest(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.count() == 0


def test_one_change_is_seen(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(40)]
    root = lambda r: merkle.documents_manifest(spark.createDataFrame([(*d, "", 0, "") for d in r], SCHEMA), 4).first()["root"]
    changed = [*rows[:20], (20, "s", "en", 1, "text 20."), *rows[21:]]
    assert root(rows) == root(rows[::-1]) != root(changed)
