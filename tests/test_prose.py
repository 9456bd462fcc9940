"""Conversations retold in prose: each branch of the grammar on a small page."""

import pytest

from dossier.sources.prose import conversation_items

OWNERS = ("ANA MÁRCIA LIMA", "ANA LIMA")
COLUMNS = ("tipo", "de", "para", "texto", "data", "hora", "fuso", "lado", "citacoes", "falas", "numero")


def item(tipo, texto, **more):
    if tipo == "relato":
        more = {"citacoes": [], "falas": []} | more
    return tuple({"tipo": tipo, "texto": texto, **more}.get(k) for k in COLUMNS)


ALONE = [
    (
        "Em 03/04/2024, às 09:08:07 -03:00, RUI DIAS pede a ANA\nLIMA que “Mande hoje”:\nPágina 3 de 9\nIPJ-A nº 12/2026",
        item("mensagem", "Mande hoje", de="RUI DIAS", para="ANA LIMA", data="2024-04-03", hora="09:08", fuso="-03:00", lado="recebida"),
    ),
    ("Às 09:08 UTC-3, ANA MARCIA LIMA responde “ Já foi ”.", item("mensagem", "Já foi", de="ANA MARCIA LIMA", hora="09:08", fuso="UTC-3", lado="enviada")),
    ('Em seguida, às 10:42:02 - 03:00, ANA LIMA pergunta "Quando?" e espera.', item("mensagem", "Quando?", de="ANA LIMA", hora="10:42", fuso="- 03:00", lado="enviada")),
    ('“Rui Oficina” avisa a “Ana Casa” que “Pronto”.', item("mensagem", "Pronto", de="Rui Oficina", para="Ana Casa", lado="recebida")),
    ("ANA LIMA diz a RUI que fica com “casa e carro”.", item("relato", "ANA LIMA diz a RUI que fica com “casa e carro”.", de="ANA LIMA", lado="enviada", citacoes=["casa e carro"], falas=["casa e carro"])),
    (
        "RUI responde que “não quer”, depois acrescenta “nem pode”.",
        item("relato", "RUI responde que “não quer”, depois acrescenta “nem pode”.", de="RUI", lado="recebida", citacoes=["não quer", "nem pode"], falas=["não quer", "nem pode"]),
    ),
    ("ANA LIMA retoma o caso com RUI, que afirma que vai “pagar já”:", item("relato", "ANA LIMA retoma o caso com RUI, que afirma que vai “pagar já”:", citacoes=["pagar já"])),
    ("RUI explica que ANA responde que “não há prazo”.", item("relato", "RUI explica que ANA responde que “não há prazo”.", citacoes=["não há prazo"])),
    (
        "RUI explica que, segundo “Beto”, o “prazo acabou”.",
        item("relato", "RUI explica que, segundo “Beto”, o “prazo acabou”.", de="RUI", lado="recebida", citacoes=["Beto", "prazo acabou"], falas=["prazo acabou"]),
    ),
    (
        "Em 03/04/2024, o contato denominado “Lia Paz” (terminal 5511912345678), envia texto às 10:00, no qual “a minuta segue”.",
        item("relato", "Em 03/04/2024, o contato denominado “Lia Paz” (terminal 5511•••••••••), envia texto às 10:00, no qual “a minuta segue”.", de="Lia Paz", lado="recebida", citacoes=["Lia Paz", "a minuta segue"], falas=["a minuta segue"]),
    ),
    ("RUI envia um texto a “Beto da Silva FEIRA”.", item("relato", "RUI envia um texto a “Beto da Silva FEIRA”.", citacoes=["Beto da Silva FEIRA"])),
    ("RUI envia “Carro preto” e “ABC1D23”.", item("relato", "RUI envia “Carro preto” e “[placa omitida]”.", de="RUI", lado="recebida", citacoes=["Carro preto", "[placa omitida]"], falas=["Carro preto", "[placa omitida]"])),
    ("ANA LIMA encaminha “Rua Oculta 9”.", item("mensagem", "[endereço omitido]", de="ANA LIMA", lado="enviada")),
    ("O laudo “tmp” chegou; “isto”, responde RUI.", None),
    ("Sem conversa alguma. “Logs” é como se chama a pasta.", None),
    ("Figura 7 – Ordem dos fatos de 05/11/2025", None),
    ("", None),
    (None, None),
]


@pytest.fixture(scope="module")
def alone(spark):
    pages = spark.createDataFrame([(1, n, t) for n, (t, _) in enumerate(ALONE)], "documento_id bigint, pagina int, texto string")
    got = {}
    for r in conversation_items(pages, OWNERS, ("Rua Oculta 9",)).collect():
        got.setdefault(r.pagina, []).append(tuple(r[k] for k in COLUMNS))
    return got


@pytest.mark.parametrize("n", range(len(ALONE)))
def test_a_sentence_alone(alone, n):
    assert alone.get(n) == (None if ALONE[n][1] is None else [ALONE[n][1]])


def test_captions_and_titles_go_on(spark):
    page = (
        "5.4 Cobranças do primeiro contrato da loja com\no escritório de ANA LIMA\nEm outro trecho, RUI fala da loja.\n"
        "Figura 12 – RUI diz a ANA LIMA que o contrato é o\nmais caro de todos e\nSegundo a perícia, nada falta.\nFigura 13 - Nota.\nRUI pede o “recibo de março”."
    )
    spark_page = spark.createDataFrame([(1, 2, page), (1, 3, "RUI diz “a”.\x0cIsto basta.")], "documento_id bigint, pagina int, texto string")
    got = [(r.pagina, r.ordem, r.tipo, r.numero, r.conversa, r.texto) for r in conversation_items(spark_page, OWNERS).orderBy("pagina", "ordem").collect()]
    assert got == [
        (2, 0, "secao", None, None, "5.4 Cobranças do primeiro contrato da loja com o escritório de ANA LIMA"),
        (2, 1, "relato", None, None, "Em outro trecho, RUI fala da loja."),
        (2, 2, "figura", 12, True, "RUI diz a ANA LIMA que o contrato é o mais caro de todos e"),
        (2, 3, "relato", None, None, "Segundo a perícia, nada falta."),
        (2, 4, "figura", 13, False, "Nota."),
        (2, 5, "relato", None, None, "RUI pede o “recibo de março”."),
        (3, 0, "mensagem", None, None, "a"),
        (3, 1, "relato", None, None, "Isto basta."),
    ]


def test_numbers_and_times_do_not_end_a_sentence(spark):
    pages = spark.createDataFrame([(1, 1, "RUI envia nota de R$ 3.422.268,14. Na sequência, às 15:10:00 -03:00, ANA LIMA responde “ok”.")], "documento_id bigint, pagina int, texto string")
    got = [(r.tipo, r.texto, r.verbo, r.trecho) for r in conversation_items(pages, OWNERS).orderBy("ordem").collect()]
    assert got == [
        ("relato", "RUI envia nota de R$ 3.422.268,14.", None, "RUI envia nota de R$ 3.422.268,14."),
        ("mensagem", "ok", "responde", "Na sequência, às 15:10:00 -03:00, ANA LIMA responde “ok”."),
    ]


def test_a_long_page_and_many_capitals(spark):
    long = "RUI diz “a”. " * 2_000 + "PALAVRA " * 5_000
    pages = spark.createDataFrame([(1, 1, long)], "documento_id bigint, pagina int, texto string")
    rows = conversation_items(pages).groupBy("tipo").count().collect()
    assert {r["tipo"]: r["count"] for r in rows} == {"mensagem": 2_000, "relato": 1}
