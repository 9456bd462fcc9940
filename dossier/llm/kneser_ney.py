"""Interpolated modified Kneser-Ney estimates of character n-grams, as DataFrame aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.blocks import ROWS, as_batch, sharded
from dossier.llm.common import save

#: The probability below single characters is uniform over this many.
CHARACTERS = 65_536
_M = np.uint64(0x9E3779B97F4A7C15)


def padded(word: str, order: int) -> str:
    """A word between the spaces that start and end it."""
    return " " * (order - 1) + word + " "


def gram_counts(words: dict[str, int], order: int) -> dict[str, int]:
    """Counts of the n-grams of padded words, each word as often as given."""
    out: dict[str, int] = {}
    for w, c in words.items():
        p = padded(w, order)
        for i in range(len(w) + 1):
            g = p[i : i + order]
            out[g] = out.get(g, 0) + c
    return out


def estimated(counts: DataFrame, order: int) -> DataFrame:
    """The model of counts (lang, gram, c), each gram `order` characters: rows (lang, level, backs, gram, value).

    value is log10 of a gram's interpolated probability after its first characters or, where backs, of the weight with which a
    context hands on to the next shorter one. Below the highest level counts are the numbers of distinct characters before a
    gram. Discounts D1, D2 and D3+ come from each language's and level's counts of counts; where these are too few for the
    formula a discount is 0.5, 0.75 or 0.9 times its count.
    """
    tables = {order: save(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")}
    for k in range(order - 1, 0, -1):
        tables[k] = save(tables[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), "grams")
    out: list[DataFrame] = []
    lower = None
    for k in range(1, order + 1):
        t = tables[k].withColumn("context", F.substring("gram", 1, k - 1))
        n = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        given = [(1, 0.5), (2, 1.5), (3, 2.7)]
        d = [F.coalesce(F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.lit(0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))), F.lit(x)).alias(f"d{i}") for i, x in given]
        discounts = t.groupBy("lang").agg(*n).select("lang", *d)
        # One row for each language: the discounts ride along with the context's sums.
        kinds = [F.count(F.when(F.col("c") == 1, 1)).alias("k1"), F.count(F.when(F.col("c") == 2, 1)).alias("k2"), F.count(F.when(F.col("c") > 2, 1)).alias("k3")]
        contexts = t.groupBy("lang", "context").agg(F.sum("c").alias("total"), *kinds).join(discounts, "lang")
        contexts = contexts.withColumn("back", (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total"))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = t.join(contexts, ["lang", "context"]).select("lang", "gram", ((F.col("c") - F.least(cut, F.col("c"))) / F.col("total")).alias("own"), "back")
        if lower is None:
            p = rows.select("lang", "gram", (F.col("own") + F.col("back") / CHARACTERS).alias("p"))
        else:
            shorter = lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("q"))
            p = rows.withColumn("short", F.substring("gram", 2, k - 1)).join(shorter, ["lang", "short"]).select("lang", "gram", (F.col("own") + F.col("back") * F.col("q")).alias("p"))
        lower = save(p, "level")
        out.append(lower.select("lang", F.lit(k).alias("level"), F.lit(False).alias("backs"), "gram", F.log10("p").alias("value")))
        out.append(contexts.select("lang", F.lit(k).alias("level"), F.lit(True).alias("backs"), F.col("context").alias("gram"), F.log10("back").alias("value")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def salted(level: int, backs: bool, salt: int = 0) -> np.uint64:
    return np.uint64((0x632BE59BD9B4E019 * (2 * level + backs + 1) ^ salt) & 0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def key_of(gram: str, level: int, backs: bool, salt: int = 0) -> int:
    """The number under which a gram's (or context's) value is stored."""
    h = np.full(1, salted(level, backs, salt))
    for c in gram:
        h = h * _M + np.uint64(ord(c) + 1)
    return int(mixed(h)[0])


def salt_of(lang: str) -> int:
    return key_of(lang, 0, False)


def dealt_model(model: DataFrame, n: int) -> DataFrame:
    """Rows (block, shard, keys, vals) of what estimated() gives, each language under keys of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [b.column(c).to_pylist() for c in ("lang", "level", "backs", "gram", "value")]
            salts = {x: salt_of(x) for x in set(rows[0])}
            keys = np.array([key_of(g, k, back, salts[x]) for x, k, back, g, _ in zip(*rows, strict=True)], np.uint64)
            keys, first = np.unique(keys, return_index=True)
            yield as_batch(list(sharded(-1, keys, n, np.array(rows[4], np.float32)[first])))

    return model.mapInArrow(run, ROWS)


def window_keys(points: np.ndarray, ends: np.ndarray, order: int, salt: int = 0) -> dict[tuple[int, bool], np.ndarray]:
    """For each predicted place (index into points) the keys of its grams and their contexts, by (level, backs)."""
    out = {}
    for k in range(1, order + 1):
        for backs in (False, True):
            h = np.full(len(ends), salted(k, backs, salt))
            for j in range(k - 1, int(backs) - 1, -1):
                h = h * _M + (points[ends - j].astype(np.uint64) + np.uint64(1))
            out[k, backs] = mixed(h)
    return out


def word_places(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all padded words, the places to predict, the number of places of each word)."""
    points = np.frombuffer("".join([padded(w, order) for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(n + order - 1) - (n + order - 1) + order - 1
    ends = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return points, ends, n


def backed_off(look, keys: dict[tuple[int, bool], np.ndarray], order: int) -> np.ndarray:
    """log10 probability of each place. look(keys) gives values, NaN where a key isn't stored."""
    p = look(keys[1, False])
    base = look(keys[1, True]) - np.log10(CHARACTERS)
    p = np.where(np.isnan(p), np.where(np.isnan(base), -np.log10(CHARACTERS), base), p)
    for k in range(2, order + 1):
        own, back = look(keys[k, False]), look(keys[k, True])
        p = np.where(np.isnan(own), np.where(np.isnan(back), p, back + p), own)
    return p
