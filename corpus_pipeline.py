"""From raw documents to token ids: STAGES in order, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import bpe, contamination, copies, quality, suffixes
from dossier.llm.common import numbered, save


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: neither of high perplexity nor with words of toxic texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = numbered(docs, stable=True)
    found = quality.judged(rows.select("_rid", "row.doc_id", "row.text", "row.lang"), labels, keep=("doc_id", "_rid"))
    return rows.join(found.where("rejected").select("_rid"), "_rid", "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: linked SimHash fingerprints and MinHash bands, then a Jaccard similarity of 0.8 or
    more of five-word shingles."""
    return copies.drop_near_copies(docs, stable=True)


#: Bytes of a string that repeats. Passages of over 50 words have more in nearly all languages; 400 bytes would miss many.
REPEATED = 200


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 200 or more that also stand earlier; a string's first occurrence stays."""
    return suffixes.drop_repeats(docs, REPEATED, keep_first=True, stable=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), stable=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with digests of the ids and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoded(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontaminated),
    ("tokens", tokens),
]

#: The stages can't all be said in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
