"""The unified timeline of all cases, and the chronology of events, dated statements and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import Rules, event_category


def label_case(df: DataFrame, cases: DataFrame, fallback: bool = False) -> DataFrame:
    """df with processo, the case's class and number; rows of unknown cases go, or show the id where fallback is set."""
    label = cases.select("incidente", F.concat_ws(" ", "classe", F.col("numero").cast("string")).alias("processo"))
    got = df.join(label, "incidente", "left" if fallback else "inner")
    return got.withColumn("processo", F.coalesce("processo", F.col("incidente").cast("string"))) if fallback else got


def with_snapshot(df: DataFrame, snapshots: DataFrame, sid: str = "snapshot_first_seen") -> DataFrame:
    """df with coleta, the capture that its provenance id names."""
    return df.join(snapshots.select(F.col("sid").alias(sid), F.struct(F.col("sid").alias("id"), "fetched_at", "sha256", "url", "aba").alias("coleta")), sid, "left")


def event_payload(events: DataFrame, docs: DataFrame, petitions: DataFrame, assertions: DataFrame) -> DataFrame:
    """Events with their documents as an array, their petition and the number of their documents' assertions.

    docs: (andamento_id, documento_id, titulo); petitions: (andamento_id, peticao); assertions: (documento_id).
    """
    said = assertions.groupBy("documento_id").agg(F.count("*").alias("n"))
    own = docs.join(said, "documento_id", "left").groupBy("andamento_id").agg(F.sort_array(F.collect_list(F.struct("documento_id", "titulo"))).alias("documentos"), F.coalesce(F.sum("n"), F.lit(0)).alias("assercoes"))
    out = events.join(own, "andamento_id", "left").join(petitions, "andamento_id", "left")
    none = F.array().cast("array<struct<documento_id:bigint,titulo:string>>")
    return out.withColumns({"documentos": F.coalesce("documentos", none), "assercoes": F.coalesce("assercoes", F.lit(0))})


def unified_timeline(events: DataFrame, rules: Rules, cases: DataFrame | None = None) -> DataFrame:
    """All events with category (and case label), by day, case and place in the list, last first."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in events.columns else F.lit(False)
    out = events.withColumn("categoria", event_category(F.col("tipo"), flag("e_decisao"), flag("e_pauta"), rules))
    out = label_case(out, cases) if cases is not None else out
    return out.orderBy("data", "incidente", F.desc("posicao"))


def group_by_day(events: DataFrame) -> DataFrame:
    """Each day's events, newest day first."""
    return events.groupBy("data").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("incidente", "posicao", "tipo"))).alias("eventos")).orderBy(F.desc_nulls_last("data"))


def decision_rows(items: DataFrame, docs: DataFrame, event_docs: DataFrame, events: DataFrame) -> DataFrame:
    """Decision items with case and day, the earliest linked event's where the item names none; newest first."""
    first = event_docs.join(events.select("andamento_id", "data"), "andamento_id").groupBy("documento_id").agg(F.min("data").alias("data_andamento"))
    got = items.join(docs.select("documento_id", "incidente", "titulo"), "documento_id").join(first, "documento_id", "left")
    return got.withColumn("data", F.coalesce(F.col("data").cast("date"), "data_andamento")).orderBy(F.desc_nulls_last("data"), "documento_id")


def chronology(events: DataFrame, dates: DataFrame, assertions: DataFrame, decisions: DataFrame, cases: DataFrame, categories: Sequence[str], start: str) -> tuple[DataFrame, DataFrame]:
    """(rows (data, fonte, tipo, classe, incidente, processo, texto, contexto), totals by source).

    Of the portal come events of the categories (classe: the category), of documents assertions with exactly one date (their kind) and
    dated decisions (their result). contexto is `caso` from the start on and `referencia` before, always `caso` for events. Rows of
    cases that aren't known go.
    """
    context = F.when(F.col("data") >= F.lit(start).cast("date"), "caso").otherwise("referencia")
    detail = F.when(F.coalesce("descricao", F.lit("")) != "", F.concat(F.lit(" — "), "descricao")).otherwise("")
    row = lambda df, source, kind, group, said, where: df.select("data", F.lit(source).alias("fonte"), F.lit(kind).alias("tipo"), F.col(group).alias("classe"), "incidente", said.alias("texto"), where.alias("contexto"))
    a = row(events.where(F.col("categoria").isin(*categories)), "portal", "andamento", "categoria", F.concat("tipo", detail), F.lit("caso"))
    said = dates.where("n_datas = 1").select("assercao_id", "data").join(assertions.select("assercao_id", "incidente", "tipo_epistemico", "texto"), "assercao_id")
    b = row(said, "documento", "assercao", "tipo_epistemico", F.col("texto"), context)
    c = row(decisions.where("data is not null"), "documento", "decisao", "resultado", F.concat("pedido", F.lit(" → "), "decisao"), context)
    rows = label_case(a.unionByName(b).unionByName(c), cases)
    return rows.orderBy("data", "fonte", "tipo", "incidente"), rows.groupBy("fonte").agg(F.count("*").alias("n"))
