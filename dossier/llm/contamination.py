"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dossier.llm.common import numbered, save

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words in a shingle, the token of the set join.
SHINGLE = 3
#: The benchmark's distinct shingles are broadcast up to this many (about 60 MB), beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of digits, letters and all that is not ASCII."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def shingles(at: str, size: int) -> Column:
    """The array's runs of `size` words, each joined by spaces."""
    if size == 1:
        return F.col(at)
    join = lambda i: F.concat_ws(" ", *(F.get(F.col(at), i + k) for k in range(size)))
    return F.when(F.size(at) >= size, F.transform(F.sequence(F.lit(0), F.size(at) - size), join)).otherwise(F.array().cast("array<string>"))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item_id, words): each run of `window` words of an item; an item of fewer words is one window, of none has none."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    span = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return w.select("item_id", F.explode(F.transform(span, lambda i: F.slice("w", i, window))).alias("words")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, stable: bool = False) -> DataFrame:
    """See hits_of, for docs that carry no row numbers yet (stable: see common.numbered)."""
    rows = numbered(docs.select("doc_id", "text"), stable)
    return hits_of(rows.select("_rid", "row.doc_id", "row.text"), benchmark, window)


def hits_of(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each of rows (_rid, doc_id, text): _rid, doc_id, n_words, n_hit, item_ids (sorted array of strings) and n_items.

    Every window is reduced to its shingles, ordered by how often they occur in the documents. Only the rarest, a prefix
    of length one, proposes places, since containment needs all of them; places that do not fit the document's length fall
    away, the others hold if each shingle of the window stands at its offset. Null text has no words, null items and items
    without words have no windows; equal windows of several items are checked once; other columns are ignored.
    """
    wins = save(windows(benchmark, window), "windows")
    distinct = wins.select("words").distinct()
    size = F.least(F.size("words"), F.lit(SHINGLE))
    pieces = distinct.select(F.md5(F.concat_ws(" ", "words")).alias("wid"), "words", size.alias("size"))
    sizes = sorted(r[0] for r in pieces.select("size").distinct().collect())  # at most SHINGLE numbers
    parts = [pieces.where(F.col("size") == s).select("wid", F.size("words").alias("len"), F.posexplode(shingles("words", s)).alias("off", "shingle")) for s in sizes]
    empty = rows.sparkSession.createDataFrame([], "wid string, len int, off int, shingle string")
    for p in parts:
        empty = empty.unionByName(p)
    tokens = save(empty, "tokens")

    # One pass over the texts: the places of the benchmark's shingles, and one row for each document (the empty shingle, which no text has).
    # A benchmark too large to be broadcast meets the texts by a shuffle; documents then have their rows from a pass of their own.
    wanted = tokens.select("shingle").distinct()
    small = tokens.count() <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda df: df)
    w = rows.select("_rid", "doc_id", words(F.col("text")).alias("w")).select("_rid", "doc_id", F.coalesce(F.size("w"), F.lit(0)).alias("n"), F.coalesce("w", F.array().cast("array<string>")).alias("w"))
    w = w.withColumn("n", F.greatest("n", F.lit(0)))
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("shingle")))
    every = [F.transform(shingles("w", s), lambda x, i: F.struct(i.alias("pos"), x.alias("shingle"))) for s in sizes]
    if small:
        wanted = F.broadcast(wanted.union(rows.sparkSession.createDataFrame([("",)], "shingle string")))
        found = save(w.select("_rid", "doc_id", "n", F.inline(F.concat(own, *every))).join(wanted, "shingle"), "places")
    else:
        placed = w.select("_rid", "doc_id", "n", F.inline(F.concat(own, *every)))
        found = save(placed.where("pos >= 0").join(wanted, "shingle").unionByName(placed.where("pos < 0")), "places")

    places = found.where("pos >= 0").select("_rid", "n", "pos", "shingle")
    common = places.groupBy("shingle").agg(F.count("*").alias("often"))
    rarest = W.partitionBy("wid").orderBy("often", "shingle", "off")
    prefix = tokens.join(common, "shingle").withColumn("rank", F.row_number().over(rarest)).where("rank = 1").select("wid", "len", "off", "shingle")
    tried = places.join(near(prefix), "shingle").select("_rid", "wid", "len", "n", (F.col("pos") - F.col("off")).alias("start"))
    tried = tried.where("start >= 0 and start + len <= n").select("_rid", "wid", "len", "start").distinct()
    needed = tokens.groupBy("wid").agg(F.count("*").alias("needed"))
    there = tried.join(near(tokens.select("wid", "off", "shingle")), "wid").select("_rid", "wid", "len", "start", (F.col("start") + F.col("off")).alias("pos"), "shingle")
    held = there.join(places.select("_rid", "pos", "shingle"), ["_rid", "pos", "shingle"]).groupBy("_rid", "wid", "len", "start").agg(F.count("*").alias("held"))
    hits = save(held.join(near(needed), "wid").where("held = needed").select("_rid", "wid", "len", "start"), "hits")

    covered = hits.select("_rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("_rid").agg(F.count("*").alias("n_hit"))
    owners = wins.select(F.md5(F.concat_ws(" ", "words")).alias("wid"), F.col("item_id").cast("string").alias("item")).distinct()
    items = hits.select("_rid", "wid").distinct().join(near(owners) if wins.count() <= BROADCAST_ROWS else owners, "wid").select("_rid", "item").distinct().groupBy("_rid").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    every_row = found.where("pos < 0").select("_rid", "doc_id", F.col("n").cast("long").alias("n_words"))
    out = every_row.join(covered, "_rid", "left").join(items, "_rid", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("_rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), ids.alias("item_ids"), F.size(ids).cast("long").alias("n_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, stable: bool = False) -> DataFrame:
    """docs without the rows in which a window of a benchmark item occurs. Columns stay as they are."""
    rows = numbered(docs, stable)
    hit = hits_of(rows.select("_rid", "row.doc_id", "row.text"), benchmark, window).where("n_hit > 0").select("_rid")
    return rows.join(hit, "_rid", "left_anti").select("row.*")
