"""Documents, their pages and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import Rules, document_function, extract

# An authentication code with password; headings, numbered paragraphs and footers of a ruling.
CODE = r"[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}"
HEADING = r"^\s*(RELATÓRIO|RELATORIO|VOTO|VOTO VOGAL|VOTO VISTA|DECISÃO|DECISAO|DESPACHO|EMENTA|ACÓRDÃO|ACORDAO|DISPOSITIVO|EXTRATO DE ATA|CERTIDÃO DE JULGAMENTO)\s*:?\s*$"
PARAGRAPH = r"^\s*(\d{1,3})\.\s+\S"
FOOTER = r"Documento assinado digitalmente conforme MP.*?(?:senha\s+[0-9A-F-]{19})"


def decision_documents(docs: DataFrame, event_docs: DataFrame, events: DataFrame, rules: Rules, kept: tuple[str, ...] = ("decisao", "acordao", "voto")) -> DataFrame:
    """Documents with text whose function is a decision's; the function knows whether any linked event is a decision."""
    flag = event_docs.join(events.select("andamento_id", "e_decisao"), "andamento_id").groupBy("documento_id").agg(F.bool_or("e_decisao").alias("e_decisao"))
    got = docs.where("chars > 0").join(flag, "documento_id", "left").withColumn("e_decisao", F.coalesce("e_decisao", F.lit(False)))
    return got.withColumn("funcao", document_function(F.col("titulo"), F.col("e_decisao"), rules)).where(F.col("funcao").isin(*kept))


def has_text_layer(pages: DataFrame, least: int = 40) -> DataFrame:
    """For each document: pages, and whether at least half of them have `least` letters or digits."""
    good = F.length(F.regexp_replace(F.coalesce("texto", F.lit("")), r"[^\p{L}\p{N}]", "")) >= least
    return pages.groupBy("documento_id").agg(F.count("*").alias("paginas"), (2 * F.count(F.when(good, 1)) >= F.count("*")).alias("tem_texto"))


def joined_pages(mark: Column, between: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pagina", mark.alias("t")))), lambda x: x["t"]), between)


def auth_code(pages: DataFrame) -> DataFrame:
    """The first authentication code and password of each document, in capitals."""
    text = pages.groupBy("documento_id").agg(joined_pages(F.col("texto"), "\n").alias("texto"))
    pattern = rf"(?iu)c[oó]digo\s+({CODE})\s+e\s+senha\s+({CODE})"
    return text.where(F.col("texto").rlike(pattern)).select("documento_id", F.upper(F.regexp_extract("texto", pattern, 1)).alias("codigo"), F.upper(F.regexp_extract("texto", pattern, 2)).alias("senha"))


def assemble_input(pages: DataFrame) -> DataFrame:
    """Each document's pages in order, each behind its number."""
    mark = F.concat(F.lit("[página "), F.col("pagina").cast("string"), F.lit("]\n"), F.coalesce("texto", F.lit("")))
    return pages.groupBy("documento_id").agg(joined_pages(mark, "\n\n").alias("entrada"))


def text_lines(pages: DataFrame) -> DataFrame:
    """Rows (documento_id, pagina, at, linha, cru, titulo, abre) of the lines that carry text, footers left out.

    cru is the length before trailing space went, titulo the heading that a line is, abre whether a chunk begins with it.
    """
    rows = pages.select("documento_id", "pagina", F.posexplode(F.split("texto", r"\R")).alias("at", "l")).where(~F.col("l").rlike(rf"(?is){FOOTER}") & F.col("l").rlike(r"(?U)\S"))
    title = F.upper(extract(F.col("l"), f"(?isuU){HEADING}"))
    return rows.select("documento_id", "pagina", "at", F.regexp_replace("l", r"(?U)\s+$", "").alias("linha"), F.length("l").alias("cru"), title.alias("titulo"), (title.isNotNull() | F.col("l").rlike(f"(?U){PARAGRAPH}")).alias("abre"))


def chunk_pages(pages: DataFrame, max_chars: int = 1800) -> DataFrame:
    """(documento_id, ordem, pagina_inicio, pagina_fim, secao, texto, chars): greedy chunks of whole lines.

    A chunk ends before a heading, before a numbered paragraph and before it would grow too long; footers are skipped. A document's
    lines meet in one task in order, which Spark sorts on disk if it must, and one pass over them holds a chunk at a time.
    """
    lines = text_lines(pages).repartition("documento_id").sortWithinPartitions("documento_id", "pagina", "at")
    kinds = {n: lines.schema[n].dataType for n in ("documento_id", "pagina")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = open_ = None  # the chunk: its number, first and last page, section, lines
        size, section = 0, None
        for b in batches:
            out = []
            for d, page, line, raw, title, opens in zip(*(b.column(n).to_pylist() for n in ("documento_id", "pagina", "linha", "cru", "titulo", "abre")), strict=True):
                new = open_ is None or d != doc
                if new or (size > 0 and (opens or size + raw > max_chars)):
                    if open_:
                        out.append((doc, *open_))
                    section = title if title is not None else None if new else section
                    open_, doc, size = [0 if new else open_[0] + 1, page, page, section, []], d, 0
                section = title if title is not None else section
                open_[2] = page
                open_[4].append(line)
                size += len(line) + 1
            yield rows(out, b.schema)
        if open_:
            yield rows([(doc, *open_)], b.schema)

    def rows(chunks: list[tuple], given: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*chunks, strict=True)) or [()] * 6
        types = [given.field("documento_id").type, pa.int32(), *[given.field("pagina").type] * 2, pa.string()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=False)), pa.array(["\n".join(x) for x in cols[5]], pa.string())], names=["documento_id", "ordem", "pagina_inicio", "pagina_fim", "secao", "texto"])

    page = kinds["pagina"].simpleString()
    found = lines.mapInArrow(run, f"documento_id {kinds['documento_id'].simpleString()}, ordem int, pagina_inicio {page}, pagina_fim {page}, secao string, texto string")
    return found.withColumn("texto", F.regexp_replace("texto", r"(?U)^\s+", "")).withColumn("chars", F.length("texto"))


def pending_downloads(docs: DataFrame) -> DataFrame:
    return docs.where("sha256 is null")


def pages_missing(docs: DataFrame, pages: DataFrame) -> DataFrame:
    return docs.where("sha256 is not null").join(pages.select("documento_id").distinct(), "documento_id", "left_anti")


def pending_documents(docs: DataFrame, extractions: DataFrame, version: str, model: str) -> DataFrame:
    """Documents with text that have no extraction in order for their digest, this prompt version and model."""
    done = extractions.where((F.col("prompt_version") == version) & (F.col("modelo") == model) & (F.col("status") == "ok")).select("documento_id", F.col("sha256_documento").alias("sha256"))
    return docs.where("chars > 0").join(done, ["documento_id", "sha256"], "left_anti")


def token_estimate(pages: DataFrame, prompt_tokens: int = 0) -> DataFrame:
    """One row: documents, pages, characters, tokens at four characters each plus the prompt's, and the largest document."""
    docs = pages.groupBy("documento_id").agg(F.sum(F.length("texto")).alias("chars"), F.count("*").alias("paginas"))
    return docs.agg(F.count("*").alias("documentos"), F.sum("paginas").alias("paginas"), F.sum("chars").alias("chars"), (F.floor(F.sum("chars") / 4) + prompt_tokens * F.count("*")).alias("tokens"), F.max_by("documento_id", F.struct("chars", "documento_id")).alias("maior_documento"))
