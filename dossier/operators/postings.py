"""A table of postings that outlives one question: texts are split once, questions read the buckets of their words.

Under a root: `postings` (word, row's key, count, length of its text), partitioned by append (lote) and bucket of the word (balde);
`palavras`, the words in order; `vizinhas`, each word with one letter left out, in buckets of what is left; `lotes`, the log of whole
appends with their numbers of texts and words. An append writes partitions of its own and its row in the log last, so questions never
see a part of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.filters import snippet
from dossier.operators.search import bm25, deletions, edits, once, query_tokens, tokens
from dossier.sources.shared import opened

#: Buckets of words. A bucket grows with the corpus, but a word's rows lie together in it, and Parquet skips the others.
BUCKETS = 64
#: Letters of the shortest word that one edit may reach: a word of the question needs five.
SHORTEST = 4


def bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _schema(name: str, key: str) -> str:
    own = {"postings": f"t string, {key}, tf bigint, n int, lote bigint, balde int", "palavras": "t string, lote bigint", "vizinhas": "variante string, t string, lote bigint, balde int", "lotes": "textos bigint, palavras bigint, lote bigint"}
    return own[name]


class Postings:
    """The table under root of rows with a key (columns with types, as in a schema)."""

    def __init__(self, spark: SparkSession, root: str, key: str = "documento_id bigint, pagina int") -> None:
        self.spark, self.root, self.key = spark, root, key
        self.names = [f.split()[0] for f in key.split(", ")]

    def table(self, name: str) -> DataFrame:
        """A table's rows of whole appends."""
        every = opened(self.spark, f"{self.root}/{name}", _schema(name, self.key))
        return every if name == "lotes" else every.where(F.col("lote").isin(self.appends()))

    def appends(self) -> list[int]:
        return [r["lote"] for r in self.table("lotes").select("lote").collect()]  # one row an append

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lote", *by).parquet(f"{self.root}/{name}")

    def append(self, rows: DataFrame, text: Column) -> int:
        """Adds rows (key columns and what text is made of), each of a key that isn't there yet, and returns the append's number.

        Null text has no words. A word that very many rows hold is split over tasks when it is written.
        """
        lote = F.lit(number := max(self.appends(), default=0) + 1).cast("bigint").alias("lote")
        # Dealt by key, texts are split by as many tasks as there are, however few files hold them, and counted where they are split.
        counted = rows.select(*self.names, text.alias("x")).repartition(*self.names).select(*self.names, once(tokens(F.col("x"))).alias("w")).select(*self.names, F.greatest(F.size("w"), F.lit(0)).alias("n"), F.explode("w").alias("t"))
        found = counted.groupBy(*self.names, "n", "t").agg(F.count("*").alias("tf")).select("t", *self.names, "tf", "n", lote, bucket(F.col("t")).alias("balde"))
        self._write(found.hint("rebalance", "balde").sortWithinPartitions("balde", "t"), "postings", "balde")
        mine = opened(self.spark, f"{self.root}/postings", _schema("postings", self.key)).where(F.col("lote") == number)
        self._write(mine.select("t").distinct().repartitionByRange("t").sortWithinPartitions("t").select("t", lote), "palavras")
        words = opened(self.spark, f"{self.root}/palavras", _schema("palavras", self.key)).where(F.col("lote") == number)
        left = words.where(F.length("t") >= SHORTEST).select("t", F.explode(deletions(F.col("t"))).alias("variante"))
        self._write(left.select("variante", "t", lote, bucket(F.col("variante")).alias("balde")).hint("rebalance", "balde").sortWithinPartitions("balde", "variante"), "vizinhas", "balde")
        self._write(mine.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("palavras")).select(F.lit(rows.count()).cast("bigint").alias("textos"), "palavras", lote), "lotes")
        return number

    def asked(self, query: str) -> tuple[list[str], list[int]]:
        """(the question's words, their buckets), so that reads can be pruned by them."""
        got = self.spark.range(1).select(F.explode(query_tokens(query)).alias("t")).select("t", bucket(F.col("t")).alias("balde")).collect()
        return [r["t"] for r in got], sorted({r["balde"] for r in got})

    def of(self, query: str) -> tuple[DataFrame, int]:
        """(postings of the question's words, how many words it has): only their buckets are read."""
        words, buckets = self.asked(query)
        return self.table("postings").where(F.col("balde").isin(buckets) & F.col("t").isin(words)), len(words)

    def pages(self, query: str, limit: int = 50) -> DataFrame:
        """The rows (key, relevancia) most relevant to the question by BM25, as search.search_pages gives them."""
        whole = self.table("lotes").agg(F.sum("textos").alias("pages"), (F.sum("palavras") / F.sum("textos")).alias("mean"))
        return bm25(self.of(query)[0], whole, self.names, limit)

    def events(self, rows: DataFrame, query: str, limit: int = 50) -> DataFrame:
        """Those of rows that hold every word of the question, newest first, with a snippet, as search.search_events gives them."""
        found, n = self.of(query)
        held = found.groupBy(*self.names).agg(F.count_distinct("t").alias("_n")).where(F.col("_n") == n).drop("_n")
        hit = rows.join(held, self.names) if n else rows
        return hit.withColumn("trecho", snippet(F.col("descricao"), query)).orderBy(F.desc_nulls_last("data"), *self.names).limit(limit)

    def near(self, query: str, fuzz: float = 0.1) -> DataFrame:
        """Pairs (t, q): words of the table that start with a word of the question or lie within so many edits of it.

        One edit is found by the letter that is left out on either side, in the buckets of the question's variants; more edits, for
        which a word needs fifteen letters, among the words of about its length.
        """
        words, _ = self.asked(query)
        out = self.spark.createDataFrame([], "t string, q string")
        every = self.table("palavras").select("t")
        for q in words:  # a question's words
            k, size = edits(len(q), fuzz), F.length("t")
            near = every.where(F.startswith("t", F.lit(q)))
            if k == 1:
                left = self.spark.range(1).select(F.explode(deletions(F.lit(q))).alias("v")).select("v", bucket(F.col("v")).alias("b")).collect()
                met = self.table("vizinhas").where(F.col("balde").isin(sorted({r["b"] for r in left})) & F.col("variante").isin([r["v"] for r in left])).select("t")
                near = near.union(met.where(F.levenshtein("t", F.lit(q)) <= 1))
            elif k > 1:
                near = near.union(every.where(size.between(len(q) - k, len(q) + k)).where(F.levenshtein("t", F.lit(q)) <= k))
            out = out.union(near.distinct().withColumn("q", F.lit(q)))
        return out

    def fuzzy(self, rows: DataFrame, query: str, limit: int = 100, fuzz: float = 0.1) -> DataFrame:
        """Rows (key, tipo, pontos, trecho) of which a word is near a word of the question; pontos counts the question's words met."""
        near = self.near(query, fuzz).withColumn("balde", bucket(F.col("t")))
        met = self.table("postings").join(near, ["balde", "t"]).groupBy(*self.names).agg(F.count_distinct("q").alias("pontos"))
        best = met.orderBy(F.desc("pontos"), *self.names).limit(limit)
        return rows.join(F.broadcast(best), self.names).withColumn("trecho", snippet(F.col("texto"), query)).select(*self.names, "tipo", "pontos", "trecho")
