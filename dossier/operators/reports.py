"""Counts and reports over the fact tables; every child is summed up before it meets its case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_counts(cases: DataFrame, children: Mapping[str, DataFrame], captures: DataFrame) -> DataFrame:
    """Each case with the number of rows of every child (incidente), its last capture, and whether it was collected at all."""
    out = cases
    for name, df in children.items():
        out = out.join(df.groupBy("incidente").agg(F.count("*").alias(name)), "incidente", "left")
    last = captures.groupBy("incidente").agg(F.max("fetched_at").alias("ultima_coleta"))
    out = out.join(last, "incidente", "left").fillna(0, list(children))
    return out.withColumn("coletado", F.col("ultima_coleta").isNotNull())


def function_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("incidente", "funcao").agg(F.count("*").alias("documentos"))


def value_counts(df: DataFrame, column: str, top: int | None = None, bare: bool = False) -> DataFrame:
    """How often each value occurs, most frequent first; bare drops what stands in brackets at its end."""
    c = F.regexp_replace(column, r"\s*\([^)]*\)\s*$", "") if bare else F.col(column)
    out = df.groupBy(c.alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out.limit(top) if top else out


def projection_counts(tables: Mapping[str, DataFrame], incidente: int | None = None) -> DataFrame:
    """(tabela, linhas), of one case where the table has cases."""
    out = None
    for name, df in tables.items():
        rows = df.where(F.col("incidente") == incidente) if incidente is not None and "incidente" in df.columns else df
        one = rows.agg(F.lit(name).alias("tabela"), F.count("*").alias("linhas"))
        out = one if out is None else out.unionByName(one)
    return out


def gaps_report(cases: DataFrame, captures: DataFrame, docs: DataFrame, layers: DataFrame, extractions: DataFrame, cited: DataFrame) -> DataFrame:
    """(lacuna, item): what is missing: cases not collected, documents not downloaded, without text or statements, sealed cases, external cited cases."""
    text = lambda c: F.col(c).cast("string").alias("item")
    rows = [
        ("processo_nao_coletado", cases.where("status = 'resolvido'").join(captures.select("incidente").distinct(), "incidente", "left_anti").select(text("incidente"))),
        ("documento_nao_baixado", docs.where("sha256 is null").select(text("documento_id"))),
        ("sem_camada_de_texto", layers.where("not tem_texto").select(text("documento_id"))),
        ("sem_extracao", docs.where("sha256 is not null").join(extractions.where("status = 'ok' and validas > 0").select("documento_id").distinct(), "documento_id", "left_anti").select(text("documento_id"))),
        ("sigiloso", cases.where("publicidade = 'Sigiloso'").select(text("incidente"))),
        ("citado_externo", cited.where("incidente_citado is null").select(F.concat_ws(" ", "classe", F.col("numero").cast("string")).alias("item"))),
    ]
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("lacuna"), "item")
        out = one if out is None else out.unionByName(one)
    return out


def meta_counts(tables: Mapping[str, DataFrame], captures: DataFrame) -> DataFrame:
    """Row counts of all tables, the runs in order and each case's last capture, as (chave, valor)."""
    counts = projection_counts(tables).select(F.col("tabela").alias("chave"), F.col("linhas").cast("string").alias("valor"))
    runs = captures.select(F.lit("coleta").alias("chave"), F.col("coleta_id").alias("valor")).distinct()
    last = captures.groupBy("incidente").agg(F.max("fetched_at").alias("t")).select(F.concat(F.lit("coletado_em:"), F.col("incidente").cast("string")).alias("chave"), F.col("t").cast("string").alias("valor"))
    return counts.unionByName(runs).unionByName(last)


def unified_search_rows(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Events and document chunks as rows of one searchable table."""
    a = events.select(F.lit("andamento").alias("tipo"), F.col("andamento_id").cast("string").alias("id"), "incidente", "data", F.concat_ws(". ", "tipo", "descricao").alias("texto"))
    b = chunks.select(F.lit("documento").alias("tipo"), F.concat_ws(":", F.col("documento_id").cast("string"), F.col("ordem").cast("string")).alias("id"), "incidente", F.col("pagina_inicio").alias("pagina"), "texto")
    return a.unionByName(b, allowMissingColumns=True)


def nested(parent: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """parent with each child's rows as an array of structs, in the order of its columns."""
    out = parent
    for name, (df, columns) in children.items():
        out = out.join(df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)), key, "left")
    return out
