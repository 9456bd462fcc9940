"""Near copies by exact Jaccard similarity of word shingles; SimHash links and MinHash bands say which documents are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import blob, components, numbered, save, tidy
from dossier.llm.simhash import close_edges, fingerprint

SEED = 42
#: Two documents are compared if one of the bands, each the least values of WIDTH hash functions, is the same in both: at a
#: similarity of 0.8 all but 5 in 100,000 pairs are.
BANDS, WIDTH = 25, 5
#: Bits in which linked SimHash fingerprints differ at most, and words of their shingles, as in op1.
DISTANCE, FINGER = 3, 3
#: Near copies have at least NUM / DEN of their distinct shingles in common.
NUM, DEN = 4, 5
#: Members of a bucket that are compared with one another in one task; larger buckets are dealt into pieces, each pair of which is compared.
PIECE = 512
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. Fewer words than the width: one of the whole sequence."""
    words = data.lower().split()
    grams = {b" ".join(words)} if len(words) <= width else set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in grams), np.uint64, len(grams)))


def bands(grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), 4096):
        np.minimum(least, (_FACTORS[:, None] * grams[None, lo : lo + 4096]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in least.reshape(BANDS, WIDTH)], np.uint64).view(np.int64)


def similar(both, a, b):
    """Whether sets of a and b members with `both` in common are near copies."""
    return DEN * both >= NUM * (a + b - both)


def near_copies(rows: DataFrame, width: int = 5) -> DataFrame:
    """For each of rows (doc_id, text, _rid) its _rid, doc_id, set (a digest of its shingles) and root.

    Rows with the same root are those that chains of near copies reach. A bucket holds what agrees in a MinHash band, or a component of
    SimHash fingerprints that link: so what SimHash links is compared too, even where no band is the same. Every bucket's members are compared until the exact
    comparisons connect them or none is left: first with the bucket's least member, then, in buckets that this leaves in
    several components, each member outside the largest component with every other.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, width) for x in b.column("_text").to_pylist()]
            own = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            keys = pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
            fps = pa.array([fingerprint(x, FINGER) for x in b.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_rid"), b.column("doc_id"), pa.array(own, pa.binary()), pa.array(list(map(len, sets)), pa.int32()), keys, fps], names=["_rid", "doc_id", "set", "n", "bands", "fp"])
        tidy()

    texts = rows.select("_rid", "doc_id", blob().alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = save(texts.mapInArrow(sign, f"_rid bigint, doc_id {kind}, set binary, n int, bands array<bigint>, fp bigint"), "bands")
    own = signed.groupBy("set").agg(F.min("_rid").alias("_rid"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    fps = save(signed.select("set", "fp").distinct(), "fingerprints")  # of equal sets too fingerprints may differ
    linked = components(close_edges(fps.select("fp").distinct(), DISTANCE)).withColumnRenamed("node", "fp")
    linked = fps.join(linked, "fp", "left").select("set", F.coalesce("root", "fp").alias("key")).distinct().join(own, "set")
    keyed = own.select("set", "_rid", "n", F.posexplode("bands").alias("band", "key")).unionByName(linked.select("set", "_rid", "n", F.lit(BANDS).alias("band"), "key"))
    keyed = save(keyed, "keyed")
    bucket = save(keyed.groupBy("band", "key").agg(F.count("*").alias("members"), F.min(F.struct("set", "n")).alias("center")).where("members > 1"), "buckets")
    members = save(keyed.join(bucket, ["band", "key"]).select("band", "key", "set", "_rid", "n", "members", "center"), "members")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x, width).view(np.int64) for x in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("set"), pa.array(found, pa.list_(pa.int64()))], names=["set", "grams"])
        tidy()

    some = members.select("_rid", "set").distinct()
    held = save(texts.join(some, "_rid").select("set", "_text").mapInArrow(grams, "set binary, grams array<bigint>"), "shingles")

    # Each member with its bucket's least one.
    least, most = F.least("n", "center.n"), F.greatest("n", "center.n")
    stars = members.where("set <> center.set").where(similar(least, least, most)).select("set", F.col("center.set").alias("other")).distinct()
    both = stars.join(held, "set").join(held.select(F.col("set").alias("other"), F.col("grams").alias("others")), "other")
    common = F.size(F.array_intersect("grams", "others"))
    edges = save(both.where(similar(common, F.size("grams"), F.size("others"))).select(F.col("set").alias("a"), F.col("other").alias("b")), "near")
    roots = save(components(edges), "roots")

    # The others of buckets that hold several components still. A bucket of two is done.
    placed = members.where("members > 2").join(roots.withColumnRenamed("node", "set"), "set", "left").select("band", "key", "set", F.coalesce("root", "set").alias("root"))
    sizes = placed.groupBy("band", "key", "root").agg(F.count("*").alias("c"))
    split = sizes.groupBy("band", "key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("a"), F.sum("c").alias("c"), F.count("*").alias("roots")).where("roots > 1")
    split = split.select("band", "key", "main", F.ceil(F.col("a") / PIECE).cast("int").alias("a"), F.ceil((F.col("c") - F.col("a")) / PIECE).cast("int").alias("b"))
    dealt = placed.join(split, ["band", "key"]).withColumn("in_main", F.col("root") == F.col("main"))
    # Pieces 0 to a - 1 are the largest component's, the next b the others'; pairs within the largest component are none of ours.
    piece = F.when(F.col("in_main"), F.pmod(F.xxhash64("set"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("set"), F.col("b"))).cast("int")
    cells = F.when(F.col("in_main"), F.transform(F.sequence(F.col("a"), F.col("a") + F.col("b") - 1), lambda j: F.struct(F.col("piece").alias("i"), j.alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("a") + F.col("b") - 1), lambda j: F.struct(F.least(j, "piece").alias("i"), F.greatest(j, "piece").alias("j")))
    )
    celled = dealt.withColumn("piece", piece).select("band", "key", "set", "root", "piece", F.inline(cells)).join(held, "set")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, bytes]] = []
        left, right = pdf[pdf["piece"] == pdf["i"]], pdf[pdf["piece"] == pdf["j"]]
        if len(left) and len(right):
            size = left["grams"].map(len).to_numpy()
            whole, owner = np.concatenate(left["grams"].to_list()), np.repeat(np.arange(len(left)), size)
            ids, own = left["set"].to_list(), left["root"].to_list()
            for s, r, g in zip(right["set"], right["root"], right["grams"], strict=True):
                at = np.minimum(np.searchsorted(g := np.sort(g), whole), len(g) - 1)
                found = np.bincount(owner[g[at] == whole], minlength=len(left))
                near = {own[k]: ids[k] for k in np.flatnonzero(similar(found, size, len(g))) if own[k] != r}
                out += [(s, x) for x in near.values()]  # one for each component
        return pd.DataFrame(out, columns=["a", "b"])

    more = save(celled.groupBy("band", "key", "i", "j").applyInPandas(compare, "a binary, b binary"), "near")
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    return signed.select("_rid", "doc_id", "set").join(roots.withColumnRenamed("node", "set"), "set", "left").select("_rid", "doc_id", "set", F.coalesce("root", "set").alias("root"))


def drop_near_copies(docs: DataFrame, width: int = 5, stable: bool = False) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id, then the first in the table. Columns stay as they are."""
    rows = numbered(docs, stable)
    first = near_copies(rows.select("_rid", "row.doc_id", "row.text"), width).groupBy("root").agg(F.min_by("_rid", F.struct(F.col("doc_id").isNull(), "doc_id", "_rid")).alias("_rid"))
    return rows.join(first.select("_rid"), "_rid", "left_semi").select("row.*")
