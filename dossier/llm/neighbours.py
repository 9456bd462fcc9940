"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue for all trees, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dossier.llm.common import parts, save

#: Trees; rows that the hyperplanes are fitted on, at most; a leaf's rows of these.
TREES, SAMPLE, LEAF = 8, 20_000, 100
#: Leaves that a query takes from the queue.
LEAVES = 300
#: Rows or queries of a leaf that are compared in one task.
CHUNK = 4_096
VALID = "embedding is not null and vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"


class Forest:
    """Nodes of all trees in one array. A node at or above len(left) is leaf number (node - len(left))."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        planes, cuts, sons, roots, leaves = [], [], [], [], []

        def grow(rows: np.ndarray) -> int:
            x = sample[rows]
            for _ in range(3):
                if len(rows) <= leaf:
                    break
                a, b = x[rng.choice(len(rows), 2, replace=False)]
                w = a - b + rng.normal(scale=1e-3, size=x.shape[1])
                w /= np.linalg.norm(w)
                along = x @ w
                cut = float(np.median(along))
                right = along > cut
                if right.any() and not right.all():
                    at = len(planes)
                    planes.append(w), cuts.append(cut), sons.append(None)
                    sons[at] = (grow(rows[~right]), grow(rows[right]))
                    return at
            leaves.append(len(rows))
            return -len(leaves)

        for _ in range(trees):
            roots.append(grow(np.arange(len(sample))))
        self.planes = np.array(planes).reshape(len(planes), sample.shape[1])
        self.cuts, self.sons, self.roots, self.n_leaves = np.array(cuts), np.array(sons, np.int64).reshape(-1, 2), roots, len(leaves)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x (rows) in each tree (columns)."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.cuts[node]
                at[inner] = self.sons[node, right.astype(int)]
            out[:, t] = -at - 1
        return out

    def search(self, x: np.ndarray, leaves: int) -> list[list[int]]:
        """The leaves to look at for each row of x: all trees share a queue by how far a query is on the wrong side."""
        out = []
        for lo in range(0, len(x), 256):
            off = x[lo : lo + 256] @ self.planes.T - self.cuts if len(self.planes) else np.zeros((len(x[lo : lo + 256]), 0))
            for row in off.tolist():
                queue = [(0.0, r) for r in self.roots]
                heapq.heapify(queue)
                got: list[int] = []
                while queue and len(got) < leaves:
                    worst, node = heapq.heappop(queue)
                    while node >= 0:
                        side = int(row[node] > 0)
                        heapq.heappush(queue, (max(worst, abs(row[node])), int(self.sons[node, 1 - side])))
                        node = int(self.sons[node, side])
                    got.append(-node - 1)
                out.append(got)
        return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, leaves: int = LEAVES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each of queries its k nearest of vectors (vec_id, embedding) that the forest finds.

    score is the Euclidean distance in double precision, nearest first, ties to the smaller vec_id; the query's own vec_id is
    no candidate. Vectors that are null, zero or hold null or non-finite components, and those of another length than the
    commonest, take no part. The trees are fitted on the `sample` rows of smallest hash; every row is indexed. Equal vectors
    are indexed once, with their k + 1 smallest ids. Columns besides vec_id and embedding are ignored.
    """
    spark = vectors.sparkSession
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.select("vec_id", doubles).where(VALID)
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims = length["d"]
    rows = rows.where(F.size("embedding") == dims)
    asked = save(queries.select("vec_id", doubles).where(VALID).where(F.size("embedding") == dims).dropDuplicates(["vec_id"]), "queries")
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    forest = spark.sparkContext.broadcast(Forest(np.unique(np.array([r[0] for r in taken]), axis=0), trees, leaf))

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(-1, dims)

    def unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a batch as one row with their least ids."""
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = matrix(b.column("embedding")), b.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            own: dict[bytes, list[int]] = {}
            for i in order:
                held = own.setdefault(x[i].tobytes(), [])
                if len(held) <= k and int(ids[i]) not in held[-1:]:
                    held.append(int(ids[i]))
            data = np.frombuffer(b"".join(own), np.float64)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * dims, pa.int32()), pa.array(data))
            yield pa.RecordBatch.from_arrays([vec, pa.array(list(own.values()), pa.list_(pa.int64()))], names=["embedding", "ids"])

    one = rows.mapInArrow(unify, "embedding array<double>, ids array<bigint>").groupBy("embedding")
    one = save(one.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")), "vectors")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("embedding"), b.column("ids"), pa.array(forest.value.leaves_of(matrix(b.column("embedding"))).tolist(), pa.list_(pa.int64()))], names=["embedding", "ids", "leaves"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(forest.value.search(matrix(b.column("embedding")), leaves), pa.list_(pa.int64()))], names=["vec_id", "embedding", "leaves"])

    indexed = save(one.mapInArrow(index, "embedding array<double>, ids array<bigint>, leaves array<bigint>"), "indexed")
    searched = save(asked.mapInArrow(ask, "vec_id bigint, embedding array<double>, leaves array<bigint>"), "searched")
    # How many pieces a leaf's rows and its queries are dealt into; there are as many numbers as leaves, which the sample bounds.
    pieces = lambda df: {r[0]: -(-r[1] // CHUNK) for r in df.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    row_pieces, query_pieces = pieces(indexed), pieces(searched)
    many = [(x, row_pieces.get(x, 1), query_pieces.get(x, 1)) for x in range(forest.value.n_leaves)]
    number = F.broadcast(spark.createDataFrame(many, "leaf bigint, row_pieces int, query_pieces int"))
    rows_in = indexed.select("embedding", "ids", F.explode("leaves").alias("leaf")).join(number, "leaf")
    rows_in = rows_in.withColumn("r", F.pmod(F.xxhash64("embedding"), F.col("row_pieces")).cast("int")).select("leaf", "r", F.explode(F.sequence(F.lit(0), F.col("query_pieces") - 1)).alias("q"), "embedding", "ids")
    queries_in = searched.select("vec_id", "embedding", F.explode("leaves").alias("leaf")).join(number, "leaf")
    queries_in = queries_in.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.col("query_pieces")).cast("int")).select("leaf", F.explode(F.sequence(F.lit(0), F.col("row_pieces") - 1)).alias("r"), "q", "vec_id", "embedding")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of a piece of a leaf for each of its queries, by exact distance."""
        out: list[tuple[int, list, float]] = []
        if len(left) and len(right):
            x, y = np.stack(left["embedding"]), np.stack(right["embedding"])
            ids = list(left["ids"])
            first = np.array([i[0] for i in ids])
            for q, v in zip(right["vec_id"], y, strict=True):
                exact = np.sqrt(((x - v) ** 2).sum(axis=1))
                # All rows up to the k + 1st distance, equal ones included, are ordered by distance and id.
                at = np.flatnonzero(exact <= np.partition(exact, k)[k]) if len(exact) > k + 1 else np.arange(len(exact))
                for j in at[np.lexsort((first[at], exact[at]))][: k + 1]:
                    out.append((q, ids[j], exact[j]))
        return pd.DataFrame(out, columns=["query_id", "ids", "score"])

    n = parts(spark)
    found = rows_in.repartition(n, "leaf", "r", "q").groupBy("leaf", "r", "q").cogroup(queries_in.groupBy("leaf", "r", "q")).applyInPandas(rerank, "query_id bigint, ids array<bigint>, score double")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
