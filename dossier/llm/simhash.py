"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import blob, components, parts, save, tidy

SEED = 42
#: A block's fingerprints are compared pair by pair in one task up to this many; larger blocks are split by further bits.
LARGEST_BLOCK = 2048


def fingerprint(data: bytes, width: int) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included. Fewer words than the width: the whole sequence; none: 0."""
    words = data.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) <= width else list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in grams], dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        ones += np.unpackbits(hashes[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and fp (long) for each row of docs. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x, width) for x in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, pa.int64())], names=[*keep, "fp"])
        tidy()

    chosen = docs.select(*keep, blob().alias("_text"))
    return chosen.mapInArrow(run, with_fp(chosen, keep))


def with_fp(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", fp bigint"


def masks(distance: int, n: int) -> list[int]:
    """Sets of bits of which two fingerprints within the distance share at least one whole: all but `distance` of r blocks.

    r is the least for which a key has three bits more than n fingerprints need to tell them apart.
    """
    r = next((r for r in range(distance + 1, 17) if 64 * (r - distance) / r >= math.log2(max(n, 2)) + 3), 16)
    edge = [round(64 * i / r) for i in range(r + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(r)]
    return [sum(x) for x in itertools.combinations(block, r - distance)]


def finer(mask: int, distance: int) -> list[int]:
    """The free bits of a mask dealt into distance + 1 blocks: a close pair that shares the mask shares one of them too."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    size = math.ceil(len(free) / (distance + 1))
    return [mask | sum(free[i : i + size]) for i in range(0, len(free), size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of fp (distinct) under Hamming distance: fewer than members, never all pairs."""
    out, left = [], np.ones(len(fp), bool)
    for i in range(len(fp)):
        if left[i]:
            left[i] = False
            todo = [i]
            while todo and left.any():
                near = np.flatnonzero(left & (np.bitwise_count(fp ^ fp[(j := todo.pop())]) <= distance))
                left[near] = False
                out += [(j, int(k)) for k in near]
                todo += near.tolist()
    return out


def linked(keyed: DataFrame, distance: int, largest: int) -> DataFrame:
    """From rows (mask, part, fp), edges (a, b) of each block that is small enough, and rows (a, mask) of the others.

    A block is held until it has more than `largest` members; from then on its rows are handed on as they come.
    """

    def splits(mask: int) -> bool:
        return mask.bit_count() < 64 - 11

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, handed = np.empty((3, 0), np.int64), None  # rows of a block that may go on; the block that is handed on
        for batch in itertools.chain(batches, [None]):
            new = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]) if batch is not None else np.empty((3, 0), np.int64)
            x = np.concatenate([rest, new], axis=1)
            rest = x[:, :0]
            if not x.shape[1]:
                continue
            edge = np.concatenate([[0], np.flatnonzero(np.any(x[:2, 1:] != x[:2, :-1], axis=0)) + 1, [x.shape[1]]])
            size, last = np.diff(edge), len(edge) - 2
            goes_on = tuple(x[:2, 0]) == handed
            a, c, m = [], [], []
            for k in sorted({*np.flatnonzero(size > 1).tolist(), 0, last}):
                mask, fp = int(x[0, edge[k]]) & ((1 << 64) - 1), np.ascontiguousarray(x[2, edge[k] : edge[k + 1]])
                if (k == 0 and goes_on) or (len(fp) > largest and splits(mask)):
                    handed = tuple(x[:2, edge[k]])
                    a += fp.tolist()
                    c += [None] * len(fp)
                    m += [signed(mask)] * len(fp)
                elif k == last and batch is not None:
                    rest = x[:, edge[k] :]
                else:
                    pairs = forest(fp.view(np.uint64), distance)
                    a += [int(fp[i]) for i, _ in pairs]
                    c += [int(fp[j]) for _, j in pairs]
                    m += [None] * len(pairs)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(m, pa.int64())], names=["a", "b", "mask"])

    n = parts(keyed.sparkSession)
    return keyed.repartition(n, "mask", "part").sortWithinPartitions("mask", "part").mapInArrow(run, "a bigint, b bigint, mask bigint")


def close_edges(fps: DataFrame, distance: int, largest: int = LARGEST_BLOCK) -> DataFrame:
    """Edges (a, b) that connect just what Hamming distances up to `distance` connect among the distinct fp of fps.

    Fingerprints that agree on a mask form a block; each block yields a spanning forest of its close pairs. A block of more
    than `largest` members is split by more of its bits, again by the pigeonhole rule, until it is small or its members
    differ in 11 bits only; so no block is gathered whole and no pair is lost.
    """
    spark = fps.sparkSession
    level = masks(distance, fps.count())
    part = lambda m: F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part"))
    keyed = fps.select("fp", F.inline(F.array(*map(part, level)))).select("mask", "part", "fp")
    edges = []
    while True:
        got = save(linked(keyed, distance, largest), "blocks")
        edges.append(got.where("mask is null").select("a", "b"))
        hot = got.where("mask is not null")
        found = [r[0] & ((1 << 64) - 1) for r in hot.select("mask").distinct().collect()]  # masks, of which there is a fixed number
        if not found:
            break
        again = spark.createDataFrame([(signed(m), signed(x)) for m in found for x in finer(m, distance)], "mask bigint, next bigint")
        keyed = hot.join(F.broadcast(again), "mask").select(F.col("next").alias("mask"), F.expr("a & next").alias("part"), F.col("a").alias("fp")).distinct()
    out = edges[0]
    for x in edges[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, largest: int = LARGEST_BLOCK, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: the columns in keep, fp, root (the component's smallest fp) and component_id, the smallest doc_id that links of at most `distance` bits reach.

    keep holds doc_id. Rows with null or empty text have fingerprint 0 and are linked like any other; rows with the same
    doc_id are documents of their own; a null doc_id is never a component's id unless it has no other. Other columns are
    ignored, an empty table gives an empty result.
    """
    found = save(fingerprints(docs, width, keep), "fingerprints")
    own = save(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(close_edges(own.select("fp"), distance, largest))
    placed = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = placed.join(low, "root").select("fp", "root", "component_id")
    return found.join(labels, "fp").select(*keep, "fp", "root", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
