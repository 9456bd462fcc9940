"""Full-text search over tables of postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import without_marks
from dossier.operators.filters import snippet

K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    """A text's words, folded as normalize_name does; white space parts words anyway, so it isn't collapsed first."""
    return F.filter(F.split(F.upper(without_marks(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def once(c: Column) -> Column:
    """c as the output of a generator: columns made of it take the value, where a plain column would be worked out in each of them."""
    return F.explode(F.array(c))


def query_tokens(query: str) -> Column:
    return F.array_distinct(tokens(F.lit(query)))


def search_events(events: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Events that hold every word of the query, newest first, with a snippet."""
    own = events.withColumn("_t", tokens(F.concat_ws(" ", "tipo", "descricao")))
    hit = own.where(F.forall(query_tokens(query), lambda q: F.array_contains("_t", q))).drop("_t")
    return hit.withColumn("trecho", snippet(F.col("descricao"), query)).orderBy(F.desc_nulls_last("data"), "andamento_id").limit(limit)


def bm25(postings: DataFrame, whole: DataFrame, key: Sequence[str], limit: int) -> DataFrame:
    """Rows (key, relevancia) from postings (key, t, tf, n) of a question's words and one row (pages, mean) about all texts."""
    often = postings.groupBy("t").agg(F.count("*").alias("df"))
    joined = postings.join(F.broadcast(often), "t").join(F.broadcast(whole))  # one row a word of the query, and one row
    idf = F.log(1 + (F.col("pages") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return joined.groupBy(*key).agg(F.sum(score).alias("relevancia")).orderBy(F.desc("relevancia"), *key).limit(limit)


def search_pages(pages: DataFrame, query: str, limit: int = 50, key: tuple[str, ...] = ("documento_id", "pagina")) -> DataFrame:
    """The pages most relevant to the query by BM25 (k1 1.2, b 0.75); only postings of its words are scored. For more than one question
    on the same pages see postings."""
    counted = pages.select(*key, tokens(F.col("texto")).alias("_t")).withColumn("n", F.size("_t"))
    whole = counted.agg(F.count("*").alias("pages"), F.avg("n").alias("mean"))
    wanted = query_tokens(query)
    postings = counted.select(*key, "n", F.explode(F.filter("_t", lambda t: F.array_contains(wanted, t))).alias("t")).groupBy(*key, "n", "t").agg(F.count("*").alias("tf"))
    return bm25(postings, whole, key, limit)


def edits(letters: int, fuzz: float = 0.1) -> int:
    """How many edits a question's word of so many letters allows."""
    return int(letters * fuzz + 0.5)


def deletions(word: Column) -> Column:
    """The word, and the word without each of its letters: two words one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))))


def search_prefix_fuzzy(rows: DataFrame, query: str, limit: int = 100, key: str = "id", fuzz: float = 0.1) -> DataFrame:
    """Rows (id, tipo, texto) of which a word starts with a word of the query or lies within a tenth of its length in edits.

    Words one edit apart meet by what is left of both without a letter; for more edits, which need fifteen letters, words of about the
    length are compared. The score counts the query's words that were met. For more than one question see postings.
    """
    postings = rows.select(key, F.explode(F.array_distinct(tokens(F.col("texto")))).alias("t"))
    words = postings.select("t").distinct()
    asked = rows.sparkSession.range(1).select(F.explode(query_tokens(query)).alias("q")).withColumn("k", F.floor(F.length("q") * fuzz + 0.5).cast("int"))
    asked = F.broadcast(asked)  # a question's words
    prefix = words.join(asked, F.startswith("t", F.col("q"))).select("t", "q")
    left = words.withColumn("v", F.explode(deletions(F.col("t"))))
    one = left.join(F.broadcast(asked.where("k = 1").withColumn("v", F.explode(deletions(F.col("q"))))), "v").where("levenshtein(t, q) <= 1").select("t", "q")
    more = words.join(asked.where("k > 1"), F.length("t").between(F.length("q") - F.col("k"), F.length("q") + F.col("k"))).where("levenshtein(t, q) <= k").select("t", "q")
    near = prefix.union(one).union(more).distinct()
    met = postings.join(near, "t").groupBy(key).agg(F.count_distinct("q").alias("pontos"))
    best = met.orderBy(F.desc("pontos"), key).limit(limit)
    return rows.join(F.broadcast(best), key).withColumn("trecho", snippet(F.col("texto"), query)).select(key, "tipo", "pontos", "trecho")
