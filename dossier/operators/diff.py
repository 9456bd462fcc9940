"""What changed between collection runs, and whether stored content still has its digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def previous_run(runs: DataFrame) -> DataFrame:
    """Each full run (incidente, coleta_id) with the one before it of the same case."""
    w = W.partitionBy("incidente").orderBy("coleta_id")
    return runs.withColumn("anterior", F.lag("coleta_id").over(w)).where("anterior is not null")


def diff_runs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (incidente, anterior, coleta_id, lista, efeito, hash_natural, item): what appeared and disappeared between two runs.

    items: (incidente, coleta_id, lista, posicao, hash_natural, item). A list counts only where both runs have it. Rows keep
    posicao, their place in the list.
    """
    lists = items.select("incidente", "coleta_id", "lista").distinct()
    both = pairs.join(lists, ["incidente", "coleta_id"]).join(lists.withColumnRenamed("coleta_id", "anterior"), ["incidente", "anterior", "lista"])
    key = ["incidente", "anterior", "coleta_id", "lista", "hash_natural"]
    new = both.join(items, ["incidente", "coleta_id", "lista"])
    old = both.join(items.withColumnRenamed("coleta_id", "anterior"), ["incidente", "anterior", "lista"])
    came = new.join(old.select(key).distinct(), key, "left_anti").withColumn("efeito", F.lit("apareceu"))
    went = old.join(new.select(key).distinct(), key, "left_anti").withColumn("efeito", F.lit("sumiu"))
    return came.unionByName(went)


def diff_tabs(pairs: DataFrame, tabs: DataFrame) -> DataFrame:
    """For each pair of runs and tab: igual, mudou, so_em_a or so_em_b by digest. tabs: (incidente, coleta_id, aba, sha256)."""
    key = ["incidente", "anterior", "coleta_id"]
    a = pairs.join(tabs.withColumnRenamed("coleta_id", "anterior"), ["incidente", "anterior"]).select(*key, "aba", F.col("sha256").alias("a"))
    b = pairs.join(tabs, ["incidente", "coleta_id"]).select(*key, "aba", F.col("sha256").alias("b"))
    state = F.when(F.col("a").isNull(), "so_em_b").when(F.col("b").isNull(), "so_em_a").when(F.col("a") == F.col("b"), "igual").otherwise("mudou")
    return a.join(b, [*key, "aba"], "full_outer").select(*key, "aba", state.alias("estado"))


def diff_header(pairs: DataFrame, headers: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows (incidente, anterior, coleta_id, campo, antes, depois) for header fields that differ; nulls compare as values."""
    key = ["incidente", "anterior", "coleta_id"]
    pick = lambda p: [F.col(f).cast("string").alias(f"{p}_{f}") for f in fields]
    a = headers.select("incidente", F.col("coleta_id").alias("anterior"), *pick("a"))
    b = headers.select("incidente", "coleta_id", *pick("b"))
    both = pairs.join(a, ["incidente", "anterior"]).join(b, ["incidente", "coleta_id"])
    each = F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f"a_{f}").alias("antes"), F.col(f"b_{f}").alias("depois")) for f in sorted(fields)))
    return both.select(*key, F.inline(each)).where("not (antes <=> depois)")


def change_log(pairs: DataFrame, items: DataFrame, headers: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of all changes, counts for each pair of runs): pairs without a change are in the counts."""
    key = ["incidente", "anterior", "coleta_id"]
    lists = diff_runs(pairs, items).select(*key, F.col("lista").alias("o_que"), "efeito", "item")
    head = diff_header(pairs, headers, fields).select(*key, F.col("campo").alias("o_que"), F.lit("mudou").alias("efeito"), F.concat_ws(" -> ", F.coalesce("antes", F.lit("")), F.coalesce("depois", F.lit(""))).alias("item"))
    log = lists.unionByName(head)
    n = lambda x: F.count(F.when(F.col("efeito") == x, 1)).alias(x)
    counts = pairs.select(key).join(log, key, "left").groupBy(*key).agg(n("sumiu"), n("apareceu"), n("mudou"))
    return log, counts


def change_history_totals(counts: DataFrame) -> DataFrame:
    """Totals a round (coleta_id) and, with a null round, over all."""
    return counts.rollup("coleta_id").agg(*(F.sum(c).alias(c) for c in ("sumiu", "apareceu", "mudou")))


def verify_blobs(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each recorded (raw_path, sha256) as ok, divergente or ausente. blobs: (path, content)."""
    real = blobs.select(F.col("path").alias("raw_path"), F.sha2("content", 256).alias("real"))
    state = F.when(F.col("real").isNull(), "ausente").when(F.col("real") == F.col("sha256"), "ok").otherwise("divergente")
    return refs.select("raw_path", "sha256").distinct().join(real, "raw_path", "left").select("raw_path", "sha256", state.alias("estado"))


def integrity_manifest(rows: DataFrame, key: Sequence[str], group: str) -> DataFrame:
    """For each group and (group null) for all: rows and one digest over the content in order of key.

    A row's digest is of its columns as JSON; a group's of its rows' digests in order; the root of the groups' in order. So
    no list holds more than a group's digests.
    """
    digest = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    ordered = F.sort_array(F.collect_list(F.struct(*key, digest.alias("_d"))))
    groups = rows.groupBy(group).agg(F.count("*").alias("linhas"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["_d"]), "\n"), 256).alias("sha256"))
    root = groups.agg(F.sum("linhas").alias("linhas"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(group, "sha256"))), lambda x: x["sha256"]), "\n"), 256).alias("sha256"))
    return groups.unionByName(root.withColumn(group, F.lit(None).cast(rows.schema[group].dataType)))
