"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import kneser_ney as kn
from dossier.llm.blocks import ROWS, Batch, answered, as_batch, chunks, scored, sharded
from dossier.llm.common import parts, save

ORDER = 3
#: Of a language with ENOUGH trusted documents or more its model is trained on SHARE of them, so that its threshold comes from the
#: others; TRUSTED, if set, bounds how many that are, about. None: all of them.
TRUSTED, ENOUGH, SHARE = None, 100, 0.8
#: Document ids that are broadcast, at most.
MOST_IDS = 1_000_000
#: A document is rejected if its perplexity is over this quantile of its language's trusted documents, raised by the margin.
QUANTILE, MARGIN = 0.995, 1.15
#: How many different toxic texts a suspect word is in at least, how many times more often than in trusted ones, how many such words
#: count at most, and how many a text needs at least to be rejected.
IN_TEXTS, ODDS, SUSPECTS, HELD = 5, 20.0, 10_000, 2
_letters = regex.compile(r"\p{L}+").findall


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids that are labelled good and not toxic by every label they have."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    return good.select("doc_id")


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, fitted, alone) of all trusted documents: whether the language's model is trained on it, and whether
    its language has too few for any to be kept apart."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).join(trusted_ids(labels), "doc_id").distinct()
    # One row for each language.
    part = F.least(F.lit(SHARE), TRUSTED / F.col("n")) if TRUSTED else F.lit(SHARE)
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.col("n") < ENOUGH).alias("alone"), part.alias("share"))
    fitted = F.col("alone") | (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    return rows.join(F.broadcast(share), "lang").select("doc_id", "lang", fitted.alias("fitted"), "alone")


def suspect_words(docs: DataFrame, labels: DataFrame, trusted: DataFrame) -> frozenset[str]:
    """Words that set texts labelled toxic apart from trusted ones (see IN_TEXTS), lower case.

    Few words decide toxicity, which a perplexity over whole texts can't see. Equal texts count once.
    """
    toxic = labels.where("toxic = 1 and doc_id is not null").select("doc_id", F.lit(1).alias("toxic")).distinct()
    marked = toxic.unionByName(trusted.where("fitted").select("doc_id", F.lit(0).alias("toxic")).distinct())
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two numbers
    if not sizes.get(1) or not sizes.get(0):
        return frozenset()
    chosen = F.broadcast(marked) if sum(sizes.values()) <= MOST_IDS else marked
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy(F.md5("text").alias("d")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    texts = save(texts.select("toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("words")), "labelled")
    n = texts.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("g")).first()
    words = texts.select("toxic", F.explode("words").alias("word")).where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("g"))
    odds = F.col("t") / (n["t"] or 1) >= ODDS * (F.col("g") + 0.5) / ((n["g"] or 0) + 1)
    rows = words.where((F.col("t") >= IN_TEXTS) & odds).orderBy(F.desc("t"), "word").limit(SUSPECTS).collect()
    return frozenset(r["word"] for r in rows)


def gram_rows(docs: DataFrame, order: int) -> DataFrame:
    """Rows (lang, gram, c) of the words (runs without white space) of docs (_lang, _text)."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        for _, b in chunks(batches):
            words: dict[str, dict[str, int]] = {}
            for lang, text in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist(), strict=True):
                own = words.setdefault(lang, {})
                for w in text.split():
                    own[w] = own.get(w, 0) + 1
            for lang, own in words.items():
                got = kn.gram_counts(own, order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(list(got)), pa.array(list(got.values()), pa.int64())], names=["lang", "gram", "c"])

    return docs.mapInArrow(run, "lang string, gram string, c bigint")


def block_words(b: Batch) -> Iterator[tuple[str, list[int], list[list[int]], list[str]]]:
    """(language, its rows, each row's word numbers, the words) of a block."""
    langs = b.column("_lang").to_pylist()
    texts = b.column("_text").to_pylist()
    for lang in sorted(set(langs)):
        number: dict[str, int] = {}
        rows = [i for i, x in enumerate(langs) if x == lang]
        ids = [[number.setdefault(w, len(number)) for w in texts[i].split()] for i in rows]
        yield lang, rows, ids, list(number)


def language_keys(words: list[str], order: int, lang: str) -> tuple[dict, np.ndarray]:
    points, ends, n = kn.word_places(words, order)
    return kn.window_keys(points, ends, order, kn.salt_of(lang)), np.cumsum(n) - n


def perplexities(docs: DataFrame, trusted: DataFrame, keep: tuple[str, ...] = ("doc_id",), order: int = ORDER, suspects: frozenset[str] = frozenset()) -> DataFrame:
    """For each row of docs (doc_id, text, lang) the columns in keep, lang, n_places, log_perplexity and n_suspect.

    n_suspect is how many of the text's words are suspects, whatever their case and the punctuation at them.

    log_perplexity is the mean negative log10 probability of a character of the text's words (and of the end of each), null
    if there is no word. The model is each language's own, trained on the documents of trusted (doc_id); a language with
    none gives every character the same probability. Null text counts as empty, null lang as a language of its own.
    """
    n = parts(docs.sparkSession)
    chosen = docs.select(*keep, F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("text", F.lit("")).alias("_text"))
    small = trusted.count() <= MOST_IDS
    training = docs.join(F.broadcast(trusted) if small else trusted, "doc_id", "left_semi").select(F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("text", F.lit("")).alias("_text"))
    model = kn.estimated(gram_rows(training, order), order)

    def keys_of(b: Batch) -> tuple[np.ndarray, list]:
        state = [(rows, ids, words, *language_keys(words, order, lang)) for lang, rows, ids, words in block_words(b) if words]
        found = [np.unique(x) for own in state for x in own[3].values()]
        return np.unique(np.concatenate([np.empty(0, np.uint64), *found])), state

    def ask(batches: Iterator[Batch]) -> Iterator[Batch]:
        for block, b in chunks(batches):
            keys = keys_of(b)[0]
            if len(keys):
                yield as_batch(list(sharded(block, keys, n)))

    def score(b: Batch, state: list, keys: np.ndarray, vals: np.ndarray) -> Batch:
        places, cost, bad = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, np.nan), np.zeros(b.num_rows, np.int64)
        look = lambda k: vals[np.searchsorted(keys, k)]  # noqa: E731  every key was asked for
        for rows, ids, words, grams, edge in state:
            own = np.add.reduceat(kn.backed_off(look, grams, order), edge)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            mark = np.array([not suspects.isdisjoint(_letters(w.lower())) for w in words]) if suspects else np.zeros(len(words), bool)
            for i, w in zip(rows, ids, strict=True):
                if w:
                    places[i] = size[w].sum()
                    cost[i] = -own[w].sum() / places[i]
                    bad[i] = mark[w].sum()
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), b.column("_lang"), pa.array(places), pa.array(cost, mask=places == 0), pa.array(bad)], names=[*keep, "lang", "n_places", "log_perplexity", "n_suspect"])

    answers = answered(chosen.mapInArrow(ask, ROWS), kn.dealt_model(model, n), np.nan, np.float32)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return scored(chosen, answers, keys_of, score, n, f"{kinds}, lang string, n_places bigint, log_perplexity double, n_suspect bigint", np.float32)


def judged(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """For each row of docs the columns in keep (doc_id among them), lang, log_perplexity, threshold, n_suspect and rejected.

    threshold is the quantile of log_perplexity of all the language's trusted documents that its model isn't trained on, times
    the margin; where the language has too few to keep any apart, of all its trusted documents. A document is rejected if it is
    over it, or if it has HELD suspect words (see suspect_words) or more, and more than that quantile of the same documents,
    all languages together. One without words or in a language without trusted documents (threshold null) passes the first test.
    """
    trusted = save(trusted_rows(docs, labels), "trusted")
    suspects = suspect_words(docs, labels, trusted)
    found = save(perplexities(docs, trusted.where("fitted").select("doc_id").distinct(), keep, suspects=suspects), "perplexities")
    judges = found.select("doc_id", "lang", "log_perplexity", "n_suspect").join(trusted.where("alone or not fitted"), ["doc_id", "lang"])
    limits = judges.groupBy("lang").agg((F.percentile_approx("log_perplexity", quantile, 10_000) * margin).alias("threshold"))
    most = max(judges.agg(F.percentile_approx("n_suspect", quantile, 10_000)).first()[0] or 0, HELD - 1)
    over = F.coalesce(F.col("log_perplexity") > F.col("threshold"), F.lit(False)) | (F.col("n_suspect") > most)
    return found.join(F.broadcast(limits), "lang", "left").select(*keep, "lang", "log_perplexity", "threshold", "n_suspect", over.alias("rejected"))
