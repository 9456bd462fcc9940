"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, from spark.checkpoint.dir; a temporary one only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder, with these options of the writer, and reads it back: a cut in the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, stable: bool = False) -> DataFrame:
    """Rows (_rid, row): each row of docs as a struct, so that no column of docs can clash with one of ours, under a number that
    rises with its place in the table.

    The rows are written to the shared folder with their numbers, which later reads then repeat. stable says that docs comes
    straight from files (no shuffle, sample or non-deterministic column), so that reading it again gives the same order, and no
    copy is made.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*docs.columns).alias("row"))
    return rows if stable else save(rows, "rows")


#: Tasks that rows of one key are spread over.
SALTS = 64


def with_first(rows: DataFrame, key: str, place: Column, spread: Column) -> DataFrame:
    """Those of rows whose key others share, with copies (how many do) and first (the least place among them).

    Rows of a key are dealt to SALTS tasks by the hash of spread, both when they are counted and when they meet the result, so a
    key that a third of all rows have is never gathered.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    some = dealt.groupBy(key, "_salt").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    whole = some.groupBy(key).agg(F.min("first").alias("first"), F.sum("copies").alias("copies")).where("copies > 1")
    return dealt.join(some.select(key, "_salt").join(whole, key), [key, "_salt"]).drop("_salt")


def blob(column: str = "text") -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the system: workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable, for nodes that have an edge.

    Alternates large and small stars until a round changes nothing; every step is a grouped minimum and a join, so no
    component is gathered anywhere.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        out = (
            large.join(small, "a")
            .select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
            .where("a <> b")
            .distinct()
        )
        now, before = save(out, "edges"), seen
        seen = mark(now)
        if seen == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
