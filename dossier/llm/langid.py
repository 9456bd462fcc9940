"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm import kneser_ney as kn
from dossier.llm.blocks import BLOCK, ROWS, Batch, answered, as_batch, chunks, scored, sharded
from dossier.llm.common import parts, save

ORDER = 3
#: A model of more rows than this is not broadcast: blocks of documents ask its shards for what they need, with the same result.
MOST_ROWS = 4_000_000
#: Words whose scores a worker remembers.
REMEMBERED = 300_000
#: How much of its calibration documents a language accepts: one in CALIBRATION training texts, which are not counted. A language
#: with fewer than LEAST of them counts all of its training documents and is calibrated on them.
ACCEPTED, CALIBRATION, LEAST = 0.999, 8, 20
_words = regex.compile(r"\p{L}+").findall


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def gram_rows(docs: DataFrame, order: int) -> DataFrame:
    """Rows (lang, gram, c) of docs (lang, text): each task counts its words, then the n-grams of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, dict[str, int]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, own in words.items():
                got = kn.gram_counts(own, order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(list(got)), pa.array(list(got.values()), pa.int64())], names=["lang", "gram", "c"])
            words.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                own = words.setdefault(lang, {})
                for w in words_of(text.as_py()):
                    own[w] = own.get(w, 0) + 1
            if sum(map(len, words.values())) > REMEMBERED:
                yield from rows()
        yield from rows()

    return docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, gram string, c bigint")


class Model:
    """Sorted keys, and for each the value in each language (NaN: none)."""

    def __init__(self, rows: list, order: int):
        self.order, self.langs = order, sorted({r["lang"] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        keys = np.array([kn.key_of(r["gram"], r["level"], r["backs"]) for r in rows], np.uint64)
        self.keys, where = np.unique(keys, return_inverse=True)
        self.values = np.full((len(self.langs), len(self.keys)), np.nan, np.float32)
        for i, r in zip(where, rows, strict=True):
            self.values[at[r["lang"]], i] = r["value"]

    def scores(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word (rows) in each language (columns)."""
        points, ends, n = kn.word_places(words, self.order)
        keys = kn.window_keys(points, ends, self.order)
        found = {}
        for k, x in keys.items():
            i = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            found[k] = (i, self.keys[i] != x)
        out = np.empty((len(words), len(self.langs)))
        edge = np.cumsum(n) - n
        for lang, own in enumerate(self.values):
            look = lambda at, own=own: np.where(at[1], np.nan, own[at[0]])
            out[:, lang] = np.add.reduceat(kn.backed_off(look, found, self.order), edge)
        return out


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def verdict(ids: list[int], table: np.ndarray, size: np.ndarray, langs: list[str]) -> tuple[str, float, float | None]:
    """(language, score, cross entropy) of a text, from its words' rows in table (log10 probabilities) and size (characters)."""
    if not ids or not langs:
        return "und", 0.0, None
    h = -table[ids].sum(axis=0) / size[ids].sum()
    best = int(h.argmin())
    return langs[best], float(1 / np.power(10.0, h[best] - h).sum()), float(h[best])


def verdict_batch(b: Batch, keep: tuple[str, ...], found: list[tuple[str, float, float | None]]) -> Batch:
    pred, score, cost = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64())], names=[*keep, "lang_pred", "score", "cross_entropy"])


def numbered(texts: list[str | None], number: dict[str, int]) -> list[list[int]]:
    return [[number.setdefault(w, len(number)) for w in words_of(t)] if t else [] for t in texts]


def by_broadcast(rows: DataFrame, keep: tuple[str, ...], model, schema: str) -> DataFrame:
    """Verdicts on rows (keep, _text) under a model that each worker holds."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        m = model.value
        number: dict[str, int] = {}
        table = np.empty((0, len(m.langs) if m else 0))
        size = np.empty(0)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                if len(number) > REMEMBERED:
                    number.clear()
                    table, size = table[:0], size[:0]
                known = len(number)
                ids = numbered(part.column("_text").to_pylist(), number)
                if m and len(number) > known:
                    new = list(number)[known:]
                    table = np.concatenate([table, m.scores(new)])
                    size = np.concatenate([size, np.fromiter(map(len, new), float, len(new)) + 1])
                yield verdict_batch(part, keep, [verdict(i, table, size, m.langs if m else []) for i in ids])

    return rows.mapInArrow(run, schema)


def by_shards(rows: DataFrame, keep: tuple[str, ...], model: DataFrame, langs: list[str], order: int, schema: str) -> DataFrame:
    """The same under a model (rows of dealt_model) that no worker holds whole. A block's keys grow with the languages, so blocks are smaller the more there are."""
    n, block = parts(rows.sparkSession), max(BLOCK // len(langs), 100_000)
    salts = [kn.salt_of(x) for x in langs]

    def keys_of(b: Batch) -> tuple[np.ndarray, tuple]:
        number: dict[str, int] = {}
        ids = numbered(b.column("_text").to_pylist(), number)
        words = list(number)
        if not words:
            return np.empty(0, np.uint64), (ids, words, [], None)
        points, ends, places = kn.word_places(words, order)
        grams = [kn.window_keys(points, ends, order, x) for x in salts]
        return np.unique(np.concatenate([np.unique(x) for own in grams for x in own.values()])), (ids, words, grams, np.cumsum(places) - places)

    def ask(batches: Iterator[Batch]) -> Iterator[Batch]:
        for at, b in chunks(batches, block):
            keys = keys_of(b)[0]
            if len(keys):
                yield as_batch(list(sharded(at, keys, n)))

    def score(b: Batch, state: tuple, keys: np.ndarray, vals: np.ndarray) -> Batch:
        ids, words, grams, edge = state
        table = np.empty((len(words), len(langs)))
        look = lambda k: vals[np.searchsorted(keys, k)]  # noqa: E731  every key was asked for
        for lang, own in enumerate(grams):
            table[:, lang] = np.add.reduceat(kn.backed_off(look, own, order), edge)
        size = np.fromiter(map(len, words), float, len(words)) + 1
        return verdict_batch(b, keep, [verdict(i, table, size, langs) for i in ids])

    answers = answered(rows.mapInArrow(ask, ROWS), model, np.nan, np.float32)
    return scored(rows, answers, keys_of, score, n, schema, np.float32, block)


def identified(docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",), order: int = ORDER) -> DataFrame:
    """For each row of docs the columns in keep, lang_pred, score, cross_entropy and accepted.

    The models are learned from training (lang, text); rows without either are left out. lang_pred has the lowest mean
    negative log10 probability a character (cross_entropy) over the text's words, ties to the first name in order; it is
    `und`, with score 0, if the text is null or has no letter, or nothing was learned. score is the share of the best
    language's likelihood a character among all. accepted tells whether cross_entropy is within what all but a thousandth of
    the language's calibration documents have that the models give to it; it is the rejection rule for callers that want one.
    Calibration documents are those of training whose text's hash says so, and docs have no part in the limits.
    """
    spark = docs.sparkSession
    learned = training.where("lang is not null and text is not null").select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0).alias("_apart"))
    few = save(learned.groupBy("lang").agg((F.count_if("_apart") < LEAST).alias("_few")), "few")
    learned = learned.join(F.broadcast(few), "lang")  # one row for each language
    model_rows = save(kn.estimated(gram_rows(learned.where("_few or not _apart"), order), order), "model")
    n = model_rows.count()
    if n > MOST_ROWS:
        langs = sorted(r["lang"] for r in model_rows.select("lang").distinct().collect())
        model = save(kn.dealt_model(model_rows, parts(spark)), "shards")
    else:
        model = spark.sparkContext.broadcast(Model(model_rows.collect(), order) if n else None)

    def judged(df: DataFrame, cols: tuple[str, ...], name: str) -> DataFrame:
        kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in cols)
        schema = f"{kinds}, lang_pred string, score double, cross_entropy double"
        rows = df.select(*cols, F.col("text").alias("_text"))
        return save(by_shards(rows, cols, model, langs, order, schema) if n > MOST_ROWS else by_broadcast(rows, cols, model, schema), name)

    found = judged(docs, keep, "languages")
    own = judged(learned.where("_few or _apart"), ("lang",), "calibration").where("lang = lang_pred")
    limits = own.groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", ACCEPTED, 10_000).alias("limit"))
    return found.join(F.broadcast(limits), "lang_pred", "left").select(*keep, "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") <= F.col("limit"), F.lit(False)).alias("accepted"))
