"""Merkle manifest: a digest tree over a table's rows, a proof for each row, and what a row's change does to the root.

Rows are leaves. Those of one group, in order, are reduced two by two (a last one alone becomes the digest of itself) to the group's
root; the groups' roots, in order, are reduced likewise. Rows are dealt by superblocks of SUPER places, so a task holds no more
than one superblock's digests however large a group is, and a tree of n rows takes log(n) / log(SUPER) rounds up and as many down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import save
from dossier.operators.order import placed

#: Places in a superblock, a power of two.
SUPER = 512
#: The columns of a document's digest, in its order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "grp string, at bigint, n bigint, h string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: Callable[[str], Column] = F.col) -> Column:
    """SHA-256 of the fields, each as byte count, colon and value, or a hyphen where it is null."""
    text = [row(f).cast("string") for f in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def levels(n: int, width: int) -> int:
    """Rounds of pairing that n nodes take inside one superblock of `width` places."""
    return min(width.bit_length() - 1, (n - 1).bit_length())


def reduced(hashes: list[str], rounds: int) -> list[list[str]]:
    """The nodes of each level, from the given ones to what is left after `rounds` pairings."""
    out = [hashes]
    for _ in range(rounds):
        last = out[-1]
        out.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def parents(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes (grp, at, n, h) one superblock up: n is how many nodes the group has on that level."""

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        n, first = int(pdf["n"].iloc[0]), pdf.iloc[0]
        top = reduced(pdf["h"].tolist(), levels(n, width))[-1]
        return pd.DataFrame({"grp": [first["grp"]], "at": [int(first["at"]) // width], "n": [-(-n // width)], "h": top})

    return nodes.groupBy("grp", F.expr(f"at div {width}").alias("block")).applyInPandas(up, NODES)


def proofs(nodes: DataFrame, outer: DataFrame, schema: str, finish: Callable[[pd.DataFrame, list[str], list[str], str], pd.DataFrame], width: int) -> DataFrame:
    """Cogroups each superblock's nodes with the path above it, reduces it again, and gives finish(rows, turns, siblings, subroot).

    outer: (grp, at, turns, siblings, subroot), at being a superblock's number: for each level above it `<` if the sibling lies before, `>` if
    behind, `=` if there is none, and the siblings' digests. A superblock has one row there.
    """

    def down(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("at").reset_index(drop=True)
        rounds = levels(int(left["n"].iloc[0]), width)
        tree = reduced(left["h"].tolist(), rounds)
        above, kin, subroot = (right[c].iloc[0] for c in ("turns", "siblings", "subroot"))
        turns, siblings = [], []
        for i in range(len(left)):
            t, s = [], []
            for level in tree[:rounds]:
                j = i ^ 1
                t.append("=" if j >= len(level) else "<" if j < i else ">")
                s.append(level[j] if j < len(level) else "")
                i >>= 1
            turns.append("".join(t) + above)
            siblings.append("".join(s) + kin)
        return finish(left, turns, siblings, subroot)

    near = nodes.withColumn("block", F.expr(f"at div {width}"))
    far = outer.withColumnRenamed("at", "block")
    return near.groupBy("grp", "block").cogroup(far.groupBy("grp", "block")).applyInPandas(down, schema)


PATHS = "grp string, at bigint, turns string, siblings string, subroot string"


def _path(rows: pd.DataFrame, turns: list[str], siblings: list[str], subroot: str) -> pd.DataFrame:
    return pd.DataFrame({"grp": rows["grp"], "at": rows["at"], "turns": turns, "siblings": siblings, "subroot": subroot})


def climbed(nodes: DataFrame, name: str, width: int) -> list[DataFrame]:
    """The nodes of each superblock level, the last with one node a group. One short job a level."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(save(parents(out[-1], width), name))
    return out


def descended(steps: list[DataFrame], top: DataFrame, name: str, width: int) -> DataFrame:
    """The path above each superblock of steps[0], from the paths of the last level's nodes."""
    path = top
    for nodes in reversed(steps[1:-1]):
        path = save(proofs(nodes, path, PATHS, _path, width), name)
    return path


def folded(start: str, turns: str, siblings: str) -> str:
    """The root that a leaf and its siblings give."""
    h, at = start, 0
    for t in turns:
        kin = siblings[at : at + 64] if t != "=" else ""
        at += len(kin)
        h = digest(kin + h if t == "<" else h + kin)
    return h


def manifest(rows: DataFrame, key: str, group: str, tampered: str, width: int = SUPER) -> DataFrame:
    """For each of rows (key, group, leaf, and `tampered`, another leaf or null): key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Groups are ordered bytewise, null first and a group of its own; leaves by key, null first, equal keys by leaf. proof_sha256 is the
    digest of the siblings from the leaf to the root. folded_root folds `tampered`, or the leaf where it is null, with the original
    siblings; verified says whether that gives the root. A single row is its own root and its proof the digest of nothing. No rows
    give no rows. Other columns are ignored.
    """
    kind = rows.select(key).schema[0].dataType.simpleString()
    leaves = save(rows.select(F.col(key).alias("id"), F.col(group).cast("string").alias("grp"), F.col("leaf").alias("h"), F.col(tampered).alias("other")), "leaves")
    # The key goes to pandas as text, since integers with nulls would become floats.
    nodes = save(placed(leaves, ["grp"], ["id", "h"], "at", total="n").withColumn("id", F.col("id").cast("string")), "nodes")
    own = climbed(nodes.select("grp", "at", "n", "h"), "levels", width)
    ranked = placed(save(own[-1].select(F.col("grp").alias("group"), "h"), "subroots"), [], ["group"], "at", total="n")
    ranked = save(ranked.select("group", F.lit("").alias("grp"), "at", "n", "h"), "groups")
    over = climbed(ranked.select("grp", "at", "n", "h"), "upper", width)
    top = over[-1].first()  # one row, none of an empty table
    root = top["h"] if top else ""
    none = over[-1].select("grp", F.lit(0).cast("bigint").alias("at"), F.lit("").alias("turns"), F.lit("").alias("siblings"), F.lit("").alias("subroot"))

    def named(pdf: pd.DataFrame, turns: list[str], siblings: list[str], _: str) -> pd.DataFrame:
        return pd.DataFrame({"grp": pdf["group"], "at": 0, "turns": turns, "siblings": siblings, "subroot": pdf["h"]})

    tops = save(proofs(ranked, descended(over, none, "upper_paths", width), PATHS, named, width), "group_paths")
    path = descended(own, tops, "paths", width)

    def finish(pdf: pd.DataFrame, turns: list[str], siblings: list[str], subroot: str) -> pd.DataFrame:
        start = np.where(pdf["other"].isna(), pdf["h"], pdf["other"])
        got = [folded(h, t, s) for h, t, s in zip(start, turns, siblings, strict=True)]
        out = {"id": pdf["id"], "leaf": pdf["h"], "subroot": subroot, "root": root, "proof_sha256": [digest(s) for s in siblings]}
        return pd.DataFrame(out | {"folded_root": got, "verified": [x == root for x in got]})

    found = proofs(nodes, path, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", finish, width)
    return found.select(F.col("id").cast(kind).alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampering(every: int = 7) -> Column:
    """Whether the row is one whose n_chars is raised by one in the trial of the manifest."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))


def documents_manifest(docs: DataFrame, width: int = SUPER) -> DataFrame:
    """The manifest of documents (doc_id, source, lang, n_chars, text), in groups by lang, with some rows tampered with (see tampering)."""
    raised = lambda f: F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f)
    rows = docs.select("doc_id", "lang", leaf().alias("leaf"), F.when(tampering(), leaf(raised)).alias("tampered"))
    return manifest(rows, "doc_id", "lang", "tampered", width)
