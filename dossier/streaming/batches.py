"""Folders that a stream's batches write, and their compaction.

Batch N writes `lote=N` under a folder and never another's, so a batch that runs again writes the same. compact() folds the batches up
to one of them into `base=N`. Readers take the newest whole base and the batches behind it: what a read costs depends on what the fold
leaves and on the batches since, not on how many there ever were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/lote={batch}")


def _listed(spark: SparkSession, folder: str) -> tuple[dict[int, str], dict[int, str]]:
    """(paths of the whole bases, paths of the batches) by number; folder names alone, listed by the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"base": {}, "lote": {}}
    for status in fs.listStatus(path) if fs.exists(path) else []:
        name, _, number = status.getPath().getName().partition("=")
        whole = name == "lote" or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
        if name in found and whole:
            found[name][int(number)] = f"{folder}/{name}={number}"
    return found["base"], found["lote"]


def read(spark: SparkSession, folder: str, schema: str, upto: int | None = None) -> DataFrame:
    """The rows of the newest base and of the batches behind it (all of them up to a batch's number, if given), with lote: the batch, or
    the base's number. No rows if nothing was written."""
    bases, batches = _listed(spark, folder)
    base = max((n for n in bases if upto is None or n <= upto), default=-1)
    paths = ([bases[base]] if base >= 0 else []) + [p for n, p in sorted(batches.items()) if n > base and (upto is None or n <= upto)]
    if not paths:
        return spark.createDataFrame([], f"{schema}, lote bigint")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"(?:base|lote)=(\d+)/[^/]*$", 1).cast("bigint")
    return spark.read.schema(schema).parquet(*paths).select("*", number.alias("lote"))


def compact(spark: SparkSession, folder: str, schema: str, fold: Callable[[DataFrame], DataFrame]) -> int | None:
    """Folds everything up to the last batch into a new base, whose number it returns (none if there is nothing new).

    fold takes the rows without lote and gives rows of the schema; folding its result again with more rows must give what folding all
    at once gives. Batches and bases that the base before already covered are deleted; what this one covers stays until the next, for
    readers that have begun. Run one compaction at a time; a stream may go on meanwhile.
    """
    bases, batches = _listed(spark, folder)
    last = max(batches, default=-1)
    old = max(bases, default=-1)
    if last <= old:
        return None
    fold(read(spark, folder, schema, last).drop("lote")).write.mode("overwrite").parquet(f"{folder}/base={last}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for path in [p for n, p in bases.items() if n < old] + [p for n, p in batches.items() if n <= old]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    return last
