"""Citations of cases and statutes, links between events, petitions and notices, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.extract import case_hits, cited_articles, cited_numbers, dates_in_text, statute_hits
from dossier.functions.text import extract
from dossier.sources.shared import save, spread


def _counted(pages: DataFrame, hits: Column, key: list[str]) -> DataFrame:
    """One row a page and key: how often it was hit and the first hit's quote."""
    rows = pages.select("documento_id", "pagina", F.posexplode(hits).alias("at", "x")).select("documento_id", "pagina", "at", "x.*")
    return rows.groupBy("documento_id", "pagina", *key).agg(F.count("*").alias("ocorrencias"), F.min_by("trecho", "at").alias("trecho"))


def cited_cases(pages: DataFrame, quotes: bool = True) -> DataFrame:
    """(documento_id, pagina, classe, numero, ocorrencias, trecho) of pages (documento_id, pagina, texto); without quotes no trecho."""
    key = ["classe", "numero"]
    if quotes:
        return _counted(pages, case_hits(F.col("texto")), key)
    return cited_numbers(pages.select("documento_id", "pagina", "texto"), "texto").groupBy("documento_id", "pagina", *key).agg(F.count("*").alias("ocorrencias"))


def cited_statutes(pages: DataFrame, quotes: bool = True) -> DataFrame:
    """(documento_id, pagina, dispositivo, artigo, diploma, ocorrencias, trecho); without quotes no trecho."""
    key = ["dispositivo", "artigo", "diploma"]
    if quotes:
        return _counted(pages, statute_hits(F.col("texto")), key)
    return cited_articles(pages.select("documento_id", "pagina", "texto"), "texto").groupBy("documento_id", "pagina", *key).agg(F.count("*").alias("ocorrencias"))


def dates_in_quote(assertions: DataFrame) -> DataFrame:
    """(assercao_id, data, literal, n_datas): each assertion's different dates, with the first literal of each."""
    rows = assertions.select("assercao_id", F.posexplode(dates_in_text(F.col("trecho_fonte"))).alias("at", "x"))
    one = rows.groupBy("assercao_id", F.col("x.data").alias("data")).agg(F.min_by("x.literal", "at").alias("literal"))
    return one.withColumn("n_datas", F.count("*").over(W.partitionBy("assercao_id")))


def link_event_petition(events: DataFrame, petitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, ambiguous events): an event's petition number meets the petitions of its case by what stands before the slash.

    Only events with exactly one candidate are linked.
    """
    number = extract(F.col("descricao"), r"Peti[çc][ãa]o(?: Sigilosa| F[íi]sica| Eletr[ôo]nica)?:\s*(\d{3,7})\b")
    asked = events.select("andamento_id", "incidente", number.alias("numero_citado")).where("numero_citado is not null")
    there = petitions.select("peticao_id", "incidente", F.split_part("numero", F.lit("/"), F.lit(1)).alias("numero_citado"))
    found = asked.join(there, ["incidente", "numero_citado"]).groupBy("andamento_id", "numero_citado").agg(F.count("*").alias("n"), F.min("peticao_id").alias("peticao_id"))
    return found.where("n = 1").drop("n"), found.where("n > 1").select("andamento_id", "numero_citado", "n")


def link_notice_event(pages: DataFrame, events: DataFrame) -> DataFrame:
    """(documento_id, andamento_id, pagina, tipo, data): lines `- type - dd/mm/yyyy` of a notice's events block, met with the case's events."""
    line = r"(?m)^\s*-\s*(.+?)\s*-\s*(\d{2}/\d{2}/\d{4})\s*$"
    block = F.substring(F.col("texto"), F.locate("Andamento(s):", F.col("texto")), F.lit(1 << 30))
    named = pages.where(F.contains("texto", F.lit("Andamento(s):")))
    zipped = F.arrays_zip(F.regexp_extract_all(block, F.lit(line), F.lit(1)).alias("t"), F.regexp_extract_all(block, F.lit(line), F.lit(2)).alias("d"))
    cited = named.select("documento_id", "incidente", "pagina", F.explode(zipped).alias("x"))
    cited = cited.select("documento_id", "incidente", "pagina", F.trim("x.t").alias("tipo"), F.to_date(F.try_to_timestamp("x.d", F.lit("dd/MM/yyyy"))).alias("data"))
    return cited.join(events.select("andamento_id", "incidente", "tipo", "data"), ["incidente", "tipo", "data"]).groupBy("documento_id", "andamento_id", "tipo", "data").agg(F.min("pagina").alias("pagina"))


def resolve_citations(refs: DataFrame, cases: DataFrame) -> DataFrame:
    """refs with the known case's id, null for external ones."""
    return refs.join(cases.select("classe", "numero", F.col("incidente").alias("incidente_citado")), ["classe", "numero"], "left")


def statute_documents(refs: DataFrame) -> DataFrame:
    """(dispositivo, documento_id, pagina, ocorrencias): each statute's documents with first page and occurrences, a row each."""
    return refs.groupBy("dispositivo", "documento_id").agg(F.min("pagina").alias("pagina"), F.sum("ocorrencias").alias("ocorrencias"))


def statute_summary(refs: DataFrame) -> DataFrame:
    """For each statute: different documents, occurrences, and the documents with first page and occurrences, by documents then occurrences.

    lista holds a statute's documents in one row; where they are very many, leave it out and take statute_documents.
    """
    docs = statute_documents(refs)
    out = docs.groupBy("dispositivo").agg(F.count("*").alias("documentos"), F.sum("ocorrencias").alias("ocorrencias"), F.sort_array(F.collect_list(F.struct("documento_id", "pagina", "ocorrencias"))).alias("lista"))
    return out.orderBy(F.desc("documentos"), F.desc("ocorrencias"), "dispositivo")


def count_by_code(refs: DataFrame, top: int | None = None) -> DataFrame:
    out = refs.groupBy("diploma").agg(F.count_distinct("documento_id").alias("documentos")).orderBy(F.desc("documentos"), "diploma")
    return out.limit(top) if top else out


def cited_cases_summary(refs: DataFrame, docs: DataFrame, cases: DataFrame) -> DataFrame:
    """For each cited case: documents, occurrences, the citing cases and the known id."""
    own = refs.join(docs.select("documento_id", "incidente"), "documento_id").groupBy("classe", "numero").agg(F.count_distinct("documento_id").alias("documentos"), F.sum("ocorrencias").alias("ocorrencias"), F.sort_array(F.collect_set("incidente")).alias("citado_em"))
    return resolve_citations(own, cases)


def cross_case_citations(refs: DataFrame, docs: DataFrame, cases: DataFrame, statutes: DataFrame, top: int = 40) -> tuple[DataFrame, DataFrame]:
    """(cases cited by several cases or three documents, statutes cited by several cases: the top ones)."""
    own = cited_cases_summary(refs, docs, cases)
    several = own.where("size(citado_em) > 1 or documentos >= 3").withColumn("interno", F.col("incidente_citado").isNotNull())
    met = save(statutes.select("dispositivo", "documento_id").join(docs.select("documento_id", "incidente"), "documento_id"), "statutes")
    rows = met.count()
    different = lambda c, name: spread(met.select("dispositivo", c), rows, "dispositivo", c).distinct().groupBy("dispositivo").agg(F.count(c).alias(name))
    laws = different("incidente", "processos").join(different("documento_id", "documentos"), "dispositivo")
    return several, laws.where("processos > 1").orderBy(F.desc("processos"), F.desc("documentos"), "dispositivo").limit(top)
