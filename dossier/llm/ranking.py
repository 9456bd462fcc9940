"""Ranked lexical search: Block-Max MaxScore over shards of compressed postings, whose heaps are merged.

A shard is a few megabytes of documents, indexed as one row: the documents' ids and lengths, its terms, and each term's postings in
blocks of BLOCK documents, packed to one, two or four bytes a number. A block says its first and last document, its largest count and
its shortest document; since a score rises with the count and falls with the length, that bounds what any document in it can get, for
all collection statistics. Statistics of the whole collection come from the shards' rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.blocks import chunks
from dossier.llm.common import blob, numbered, save, tidy
from dossier.llm.contamination import words
from dossier.operators.order import placed

#: Bytes of text in a shard, about; a longer document is a shard of its own.
SHARD = 4_000_000
#: Parquet asks for the size of what it holds after a hundred rows at the soonest, and a row group is read at once. A shard is one by itself.
ROW_GROUPS = {"parquet.block.row.count.limit": "1"}
#: Documents in a block.
BLOCK = 64
#: Distinct terms of the questions that one job takes, about: what a worker holds of them. More questions go in further jobs.
QUESTION_TERMS = 200_000
#: Bytes of a document split into words at once.
PIECE = 1 << 20
#: Separators become spaces, A-Z becomes a-z; other bytes, all those over 0x7F among them, are parts of terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
BLOCKS = np.dtype([("first", "u4"), ("last", "u4"), ("top", "u4"), ("short", "u4"), ("doc_at", "u4"), ("tf_at", "u4"), ("n", "u1"), ("doc_w", "u1"), ("tf_w", "u1")])
SCHEMA = "n_docs bigint, n_terms bigint, ids array<bigint>, lengths binary, terms array<string>, dfs array<int>, starts binary, blocks binary, " + ", ".join(f"{k}{w} binary" for k in ("docs", "tfs") for w in (1, 2, 4))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms in order, a piece at a time, cut between terms."""
    flat, lo = text.translate(TABLE), 0
    while lo < len(flat):
        hi = flat.find(b" ", lo + PIECE)
        hi = len(flat) if hi < 0 else hi
        yield flat[lo:hi].split()
        lo = hi


def _packed(values: np.ndarray, most: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
    """(each block's bytes a number, its place among the blocks of that width, the numbers of each width)."""
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype("u1")
    at, of, pool = np.zeros(len(n), "u4"), np.repeat(width, n), {}
    for w in (1, 2, 4):
        mine = width == w
        at[mine] = np.cumsum(n[mine]) - n[mine]
        pool[w] = values[of == w].astype(f"u{w}").tobytes()
    return width, at, pool


def indexed(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
    """One shard's row, without documents that have no term; none if no document has any."""
    vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
    found, lengths, kept = [], [], []
    for i in range(len(texts)):
        terms = [np.fromiter(map(vocabulary.__getitem__, p), np.int64, len(p)) for p in pieces(texts[i].as_py())]
        if n := sum(map(len, terms)):
            found += terms
            lengths.append(n)
            kept.append(i)
    if not kept:
        return None
    names = np.array(list(vocabulary), object)
    order = np.argsort(names)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    lengths = np.array(lengths, "u4")
    keys, tf = np.unique(rank[np.concatenate(found)] << 32 | np.repeat(np.arange(len(kept)), lengths), return_counts=True)
    del found, vocabulary
    term, doc = keys >> 32, keys & 0xFFFFFFFF
    start = np.searchsorted(term, np.arange(len(names) + 1))
    at = np.flatnonzero((np.arange(len(term)) - start[term]) % BLOCK == 0)
    n = np.diff(np.append(at, len(term)))
    blocks = np.zeros(len(at), BLOCKS)
    blocks["first"], blocks["last"], blocks["n"] = doc[at], doc[at + n - 1], n
    blocks["top"], blocks["short"] = np.maximum.reduceat(tf, at), np.minimum.reduceat(lengths[doc], at)
    blocks["doc_w"], blocks["doc_at"], docs = _packed(doc - np.repeat(doc[at], n), blocks["last"] - blocks["first"], n)
    blocks["tf_w"], blocks["tf_at"], tfs = _packed(tf, blocks["top"], n)
    row = {
        "n_docs": len(kept), "n_terms": int(lengths.sum()), "ids": ids.take(pa.array(kept)), "lengths": lengths.tobytes(),
        "terms": pa.array(list(names[order]), pa.binary()).cast(pa.string()), "dfs": pa.array(np.diff(start), pa.int32()),
        "starts": np.searchsorted(at, start).astype("u4").tobytes(), "blocks": blocks.tobytes(),
        **{f"docs{w}": x for w, x in docs.items()}, **{f"tfs{w}": x for w, x in tfs.items()},
    }
    listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    return pa.RecordBatch.from_pydict({k: listed(v) if isinstance(v, pa.Array) else pa.array([v]) for k, v in row.items()})


def index(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """The shards of docs (doc_id, text), saved in the shared folder; search() reads them for any questions."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in chunks(batches, size):
            if row := indexed(b.column("doc_id"), b.column("_text")):
                yield row
            tidy()

    return save(docs.select(F.col("doc_id").cast("bigint"), blob("text").alias("_text")).mapInArrow(build, SCHEMA), "shards", **ROW_GROUPS)


class Shard:
    """One shard's row, opened for the terms that are asked; blocks are unpacked when a document in them may count."""

    def __init__(self, row: dict, asked: pa.Array, n_docs: int, n_terms: int) -> None:
        number = pc.index_in(row["terms"].values, asked)
        here = np.flatnonzero(np.asarray(number.is_valid()))
        self.slot = np.full(len(asked), -1)
        self.slot[np.asarray(number.drop_null())] = np.arange(len(here))
        starts = np.frombuffer(row["starts"].as_py(), "u4").astype(int)
        self.lo, self.hi = starts[here], starts[here + 1]
        self.blocks = np.frombuffer(row["blocks"].as_py(), BLOCKS)
        self.row, self.pools, self.open = row, {}, {}
        ids = row["ids"].values
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(pc.fill_null(ids, np.iinfo(np.int64).max))
        lengths = np.frombuffer(row["lengths"].as_py(), "u4").astype(np.int64)
        self.norm = 75 + 25 * lengths * n_docs // n_terms
        short = 75 + 25 * self.blocks["short"].astype(np.int64) * n_docs // n_terms
        self.most = self.impact(self.blocks["top"].astype(np.int64), short)
        self.bound = np.array([self.most[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)], np.int64)

    @staticmethod
    def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 12 * norm)

    def _numbers(self, kind: str, width: int, at: int, n: int) -> np.ndarray:
        key = f"{kind}{width}"
        if key not in self.pools:
            self.pools[key] = np.frombuffer(self.row[key].as_py(), f"u{width}")
        return self.pools[key][at : at + n].astype(np.int64)

    def unpacked(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block, kept for the shard's other questions."""
        if b not in self.open:
            x = self.blocks[b]
            docs = self._numbers("docs", x["doc_w"], x["doc_at"], x["n"]) + int(x["first"])
            self.open[b] = docs, self.impact(self._numbers("tfs", x["tf_w"], x["tf_at"], x["n"]), self.norm[docs])
        return self.open[b]


Heap = tuple[np.ndarray, np.ndarray, np.ndarray]  # scores, ids, whether the id is null


def asked(shard: Shard, terms: np.ndarray, weights: np.ndarray, heap: Heap, k: int) -> Heap:
    """The heap with the shard's documents in it that are among the k best by (score, smaller id)."""
    slot = shard.slot[terms]
    lists, weights = slot[slot >= 0], weights[slot >= 0]
    least = int(heap[0][-1]) if len(heap[0]) == k else 1
    bounds = weights * shard.bound[lists]
    order = np.argsort(bounds, kind="stable")
    lists, weights, below = lists[order], weights[order], np.cumsum(bounds[order])
    # Documents that are in none but the first lists can't reach the least score in the heap.
    first = int(np.searchsorted(below, least))
    if first == len(lists):
        return heap
    total = np.zeros(len(shard.norm), np.int64)
    for x, w in zip(lists[first:], weights[first:], strict=True):
        for b in range(shard.lo[x], shard.hi[x]):
            docs, impacts = shard.unpacked(b)
            total[docs] += w * impacts
    cand = np.flatnonzero(total)
    for j in range(first - 1, -1, -1):
        cand = cand[total[cand] + below[j] >= least]
        if not len(cand):
            return heap
        lo, hi = shard.lo[lists[j]], shard.hi[lists[j]]
        own = shard.blocks[lo:hi]
        at = np.searchsorted(own["last"], cand)
        inside = (at < len(own)) & (own["first"][np.minimum(at, len(own) - 1)] <= cand)
        most = np.where(inside, weights[j] * shard.most[lo:hi][np.minimum(at, len(own) - 1)], 0)
        keep = total[cand] + most + (below[j - 1] if j else 0) >= least
        inside = inside[keep]
        cand, wanted = cand[keep], np.unique(at[keep][inside])
        if not len(wanted):
            continue
        docs, impacts = (np.concatenate(v) for v in zip(*(shard.unpacked(lo + b) for b in wanted), strict=True))
        place = np.minimum(np.searchsorted(docs, cand), len(docs) - 1)
        total[cand] += np.where(docs[place] == cand, weights[j] * impacts[place], 0)
    cand = cand[total[cand] >= least]
    score, ids, null = (np.concatenate(v) for v in zip(heap, (total[cand], shard.ids[cand], shard.null[cand]), strict=True))
    best = np.lexsort((null, ids, -score))[:k]
    return score[best], ids[best], null[best]


FOUND = "q bigint, doc_id bigint, score bigint"


def search(shards: DataFrame, questions: DataFrame, k: int = 20, key: str = "item_id", terms: int = QUESTION_TERMS) -> DataFrame:
    """(key, rank, doc_id, score): for each of questions (key, text) the k documents of highest score, all if fewer.

    Scores are integers: the sum over the question's terms, repeats included, of the term's weight (from how many documents hold it)
    times its impact (from its count, damped by the document's length against the mean). Equal scores rank by smaller id, null last;
    documents that share no term have no score. Rows with equal key or doc_id count each for itself. Null and empty texts find
    nothing and are found by nothing.
    """
    spark = shards.sparkSession
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    rows = numbered(questions.select(key, "text"))
    each = rows.select("_rid", F.explode(words(F.col("row.text"))).alias("term")).groupBy("_rid", "term").agg(F.count("*").alias("n"))
    each = save(each, "question_terms")
    size = each.groupBy("_rid").agg(F.count("*").alias("size"))
    part = save(placed(size, [], ["_rid"], "at", F.col("size")).select("_rid", F.expr(f"at div {terms}").alias("part")), "question_parts")
    each = each.join(part, "_rid")
    frequency = shards.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"))))
    found = spark.createDataFrame([], FOUND)
    for p in range((part.agg(F.max("part")).first()[0] or 0) + 1 if n_docs else 0):
        mine = each.where(F.col("part") == p)
        df = frequency.join(F.broadcast(mine.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
        got = mine.join(df, "term").select("_rid", "term", "n", "df").toArrow()  # about `terms` rows
        found = found.unionByName(_searched(shards, got, n_docs, n_terms, k))
    row = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(row)).where(F.col("rank") <= k)
    return best.join(rows, F.col("q") == F.col("_rid")).select(F.col(f"row.`{key}`").alias(key), "rank", "doc_id", "score")


def _searched(shards: DataFrame, got: pa.Table, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Rows (q, doc_id, score): each task's heaps for the questions' terms (_rid, term, n, df)."""
    vocabulary = pc.unique(got["term"])
    number = np.asarray(pc.index_in(got["term"], vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in got["df"].to_pylist()], np.int64)
    rid, times = np.asarray(got["_rid"]), np.asarray(got["n"])
    order = np.argsort(rid, kind="stable")
    rid, number, weight = rid[order], number[order], (weight * times)[order]
    qs, starts = np.unique(rid, return_index=True)
    shared = shards.sparkSession.sparkContext.broadcast((vocabulary.to_pylist(), number, weight, qs, np.append(starts, len(rid))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, weight, qs, edge = shared.value
        names = pa.array(names, pa.string())
        heaps: list[Heap] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(qs)
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({c: b.column(c)[i] for c in b.schema.names}, names, n_docs, n_terms)
                for q in range(len(qs)):
                    span = slice(edge[q], edge[q + 1])
                    heaps[q] = asked(shard, number[span], weight[span], heaps[q], k)
        for q, (score, ids, null) in zip(qs, heaps, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids, mask=null), pa.array(score)], names=["q", "doc_id", "score"])

    return shards.select(*[c for c in shards.columns if c not in ("n_docs", "n_terms", "dfs")]).mapInArrow(run, FOUND)
