"""Column functions and extractors on literals."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import extract, text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "value", "expected"),
    [
        (text.normalize_name, "  João  da Conceição ª ", "JOAO DA CONCEICAO A"),
        (text.normalize_key, "Acme Participações S.A.", "ACME PARTICIPACOES SA"),
        (text.normalize_key, "Acme S/A", "ACME SA"),
        (text.minister_name, "MIN. ANA LIMA (relatora)", "ANA LIMA"),
        (text.likely_company, "Padaria Boa Ltda.", "pessoa_juridica"),
        (text.likely_company, "Maria Silva", None),
        (text.cents, "R$ 1.234,56", 123456),
        (text.mask_document, "123.456.789-01", "***.456.789-**"),
        (text.mask_document, "11222333000181", "11.222.333/0001-81"),
        (text.mask_text, "CPF 12345678901 e 11.222.333/0001-81", "CPF ***.456.789-** e 11.222.333/0001-81"),
        (text.mask_phone, "tel 5561999998888", "tel 5561•••••••••"),
        (text.mask_plate, "carro ABC1D23, ADI 1234", "carro [placa omitida], ADI 1234"),
        (text.normalize_role, "ADV.(A/S)", "advogado"),
        (text.normalize_role, "X.", "desconhecido:X."),
        (text.clean_ws, " a  b\n", "a b"),
    ],
)
def test_text(spark, make, value, expected):
    assert one(spark, value, make) == expected


def test_registration(spark):
    got = one(spark, "ANA LIMA (317282/SP, 5922-A/AP)", text.split_registration)
    assert (got["nome"], got["oab"]) == ("ANA LIMA", ["317282/SP", "5922-A/AP"])


def test_dates(spark):
    got = one(spark, "em 31/02/2026, 3.6.2026, 1º de junho de 2026 e 05/05/1970", extract.dates_in_text)
    assert [(str(x["data"]), x["literal"]) for x in got] == [("2026-06-03", "3.6.2026"), ("2026-06-01", "1º de junho de 2026")]


def test_citations(spark):
    got = one(spark, "Vide Pet 16.669, Inq nº 5026 e Pet 2024; arts. 319, 320 do CPP e art. 5º da Lei 6.385/76.", extract.case_hits)
    assert [(x["classe"], x["numero"]) for x in got] == [("Pet", 16669), ("Inq", 5026)]
    got = one(spark, "arts. 319, 320 do CPP; art. 27 da Lei 6.385/76", extract.statute_hits)
    assert [x["dispositivo"] for x in got] == ["art. 319 CPP", "art. 320 CPP", "art. 27 Lei 6.385/1976"]


def test_alias_chain():
    assert text.canonical({"a": "b", "b": "a", "c": "a"})["a"] == "a"
