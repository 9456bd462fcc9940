"""Chunks of pages against a plain walk over the lines, in several batches and in one very long document."""

import time

import pytest

from dossier.operators.documents import chunk_pages


def walked(lines, most):
    """(ordem, first page, last page, section, text) of lines (page, text, title, opens)."""
    out, size, section = [], 0, None
    for page, text, title, opens in lines:
        if not out or opens or size + len(text) > most:
            out.append([len(out), page, page, None, []])
            size, section = 0, title or section
            out[-1][3] = section
        section = title or section
        out[-1][2] = page
        out[-1][4].append(text.rstrip())
        size += len(text.rstrip()) + 1
    return [(*x[:4], "\n".join(x[4]).lstrip()) for x in out]


def lines_of(doc, n):
    for i in range(n):
        page = i // 40 + 1
        if i % 97 == 5:
            yield page, "  VOTO :", "VOTO", True
        elif i % 61 == 7:
            yield page, f"{i % 1000}. Parágrafo é", None, True
        else:
            yield page, f"linha {doc} {i} " + "x" * (i * 7 % 50) + "  ", None, False


def pages_of(doc, n):
    texts = {}
    for page, text, *_ in lines_of(doc, n):
        texts.setdefault(page, []).append(text)
    return [(doc, p, "\r\n\n".join(x)) for p, x in texts.items()]


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_chunks(spark, batch):
    sizes = {1: 300, 2: 1, 3: 1000, None: 50}
    rows = [r for d, n in sizes.items() for r in pages_of(d, n)] + [(4, 1, None), (5, 1, " \n")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for r in chunk_pages(spark.createDataFrame(rows, "documento_id bigint, pagina int, texto string").repartition(3), 400).collect():
            assert r.chars == len(r.texto)
            got.setdefault(r.documento_id, []).append((r.ordem, r.pagina_inicio, r.pagina_fim, r.secao, r.texto))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {d: sorted(x) for d, x in got.items()} == {d: walked(lines_of(d, n), 400) for d, n in sizes.items()}
    assert chunk_pages(spark.createDataFrame([], "documento_id bigint, pagina int, texto string")).count() == 0


def test_a_document_of_very_many_lines(spark):
    """Linear time: a document of a million lines."""
    pages = spark.range(1, 10_001).selectExpr("7 AS documento_id", "cast(id AS int) AS pagina", "repeat(concat('linha ', id, '\\n'), 100) AS texto")
    began = time.time()
    got = chunk_pages(pages).selectExpr("count(*) AS n", "sum(chars + 1) AS c", "max(ordem) + 1 AS m").first()
    assert got.n == got.m > 1000 and got.c == sum(100 * len(f"linha {i}\n") for i in range(1, 10_001))
    assert time.time() - began < 90
