"""Filters of timelines, decisions, entities and flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import clean_ws, normalize_name


def matches_all_terms(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows in whose columns, taken together, every word of the query occurs, whatever its accents and case."""
    text = normalize_name(F.concat_ws(" ", *columns))
    words = F.filter(F.split(normalize_name(F.lit(query)), " "), lambda w: w != "")
    return df.where(F.forall(words, lambda w: F.contains(text, w)))


def either(test: Column | None) -> Column:
    return F.lit(True) if test is None else test


def filter_timeline(df: DataFrame, tipo: str | None = None, epistemico: str | None = None, decisions: bool = False, with_document: bool = False, start: str | None = None, end: str | None = None, incidente: int | None = None, query: str = "") -> DataFrame:
    """Events by type, kind of any attached assertion (array tipos_epistemicos), decision flag, documents (array), days, case and words."""
    tests = [
        F.col("tipo") == tipo if tipo else None,
        F.array_contains("tipos_epistemicos", epistemico) if epistemico else None,
        F.col("e_decisao") if decisions else None,
        F.size("documentos") > 0 if with_document else None,
        F.col("data") >= F.lit(start).cast("date") if start else None,
        F.col("data") <= F.lit(end).cast("date") if end else None,
        F.col("incidente") == incidente if incidente is not None else None,
    ]
    for t in tests:
        df = df.where(either(t))
    return matches_all_terms(df, query, ["tipo", "descricao"]) if query.strip() else df


def filter_decisions(df: DataFrame, incidente: int | None = None, resultado: str | None = None, quem_pediu: str | None = None, query: str = "") -> DataFrame:
    for c, v in (("incidente", incidente), ("resultado", resultado), ("quem_pediu", quem_pediu)):
        df = df.where(either(F.col(c) == v if v is not None else None))
    return matches_all_terms(df, query, ["pedido", "decisao"]) if query.strip() else df


def filter_entities(df: DataFrame, situacao: str | None = None, tipo: str | None = None, incidente: int | None = None, query: str = "") -> DataFrame:
    """Entities by status, type, any mention's case (array mencoes) and words of the name."""
    df = df.where(either(F.col("situacao") == situacao if situacao else None)).where(either(F.col("tipo") == tipo if tipo else None))
    df = df.where(either(F.exists("mencoes", lambda m: m["incidente"] == incidente) if incidente is not None else None))
    return matches_all_terms(df, query, ["nome"]) if query.strip() else df


def filter_flows(df: DataFrame, natureza: str | None = None, tipo: str | None = None, ano: str | None = None, status: str | None = None, query: str = "", columns: Sequence[str] = ("origem", "destino")) -> DataFrame:
    """Flows by nature (no type summaries unless asked for), type, year of the date or else of the period, status and words."""
    df = df.where(F.col("natureza") == natureza) if natureza else df.where("natureza <> 'resumo_tipo'")
    df = df.where(either(F.col("tipo") == tipo if tipo else None)).where(either(F.col("situacao") == status if status else None))
    df = df.where(either(F.substring(F.coalesce("data", "periodo_inicio"), 1, 4) == ano if ano else None))
    return matches_all_terms(df, query, columns) if query.strip() else df


def nulls_last(column: str, ascending: bool = True) -> Column:
    return F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)


def snippet(text: Column, query: str, before: int = 120, length: int = 320) -> Column:
    """A piece of the text around the query's first word."""
    at = F.instr(normalize_name(text), normalize_name(F.lit(query.split()[0] if query.split() else "")))
    return clean_ws(F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(length)))
