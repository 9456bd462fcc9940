"""Datasets of money flows and proofs, and the stream of changes, on rows of known result."""

import json
import random
import shutil
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq

from dossier.operators import datasets, flows
from dossier.sources.shared import shared_dir
from dossier.streaming.ingest import changes, stream_changes


PAGE = "IGREJA TESTE 57.391.420/0001-63 Titular\nFULANO DA SILVA 027.818.816-86 Remetente\n26 lançamento(s)\nno total de: R$19.205.000,00"


def dataset(name="1", **changes):
    """A valid dataset; changes of fields of its flow, or of the communication where they are its own."""
    tx = {"origem": "027.818.816-86", "destino": "57.391.420/0001-63", "valor": "19.205.000,00", "tipo": "pix", "natureza": "agregado", "quantidade": 26, "pagina": 3, "trecho": "26 lançamento(s) no total de: R$19.205.000,00"}
    com = {"secao": "suspeita", "numero": "1", "titular": "57.391.420/0001-63", "valor": "57.110.313,00", "periodo_inicio": "2024-12-24", "pagina_inicio": 3, "pagina_fim": 3, "informacoes": "CPF 027.818.816-86"}
    com["participacoes"] = [{"nome": "IGREJA TESTE", "documento": "57.391.420/0001-63", "papel": "titular"}, {"nome": "FULANO DA SILVA", "documento": "027.818.816-86", "papel": "remetente", "atividade": "ADVOGADO"}]
    com["ocorrencias"] = [{"norma": "Carta-Circular", "codigo": "IV-a"}]
    com = {k: changes.pop(k, v) for k, v in com.items()}
    com["transacoes"] = changes.pop("transacoes", [tx | changes])
    return {"fonte": {"tipo": "rif", "identificador": name, "orgao": "COAF", "documento": {"endpoint": "docs", "id_portal": "p"}, "incidente": 7}, "comunicacoes": [com]}


def pages(spark):
    return spark.createDataFrame([(1, 1, "A empresa pagou\nR$ 1.234,56 a Ana"), (274, 3, PAGE)], "documento_id bigint, pagina int, texto string")


def given(spark, *sets):
    """(datasets (name, content), pages, documents) as the functions take them."""
    rows = [(n, x if isinstance(x, str) or x is None else json.dumps(x)) for n, x in sets]
    documents = spark.createDataFrame([(274, "docs", "p"), (9, "docs", "other")], "documento_id bigint, endpoint string, id_portal string")
    return datasets.flow_datasets(spark.createDataFrame(rows, "conjunto string, value string")), pages(spark), documents


def test_validation(spark):
    flow = dataset()["comunicacoes"][0]["transacoes"][0]
    bad = {
        "ends": ({"origem": None, "destino": None}, ["comunicacoes[0].transacoes[0] both ends missing"]),
        "several": ({"transacoes": [flow | {"trecho": "isto não está", "tipo": "cripto", "valor": "19205000"}]}, ["comunicacoes[0].transacoes[0].tipo unknown type", "comunicacoes[0].transacoes[0].trecho quote not on page", "comunicacoes[0].transacoes[0].valor malformed amount"]),
        "second": ({"transacoes": [flow, flow | {"pagina": 9}]}, ["comunicacoes[0].transacoes[1].pagina no such page"]),
        "word": ({"quantidade": "x"}, ["comunicacoes[0].transacoes[0].quantidade bad quantity"]),
        "empty": ({"trecho": ""}, ["comunicacoes[0].transacoes[0].trecho quote not on page"]),
        "role": ({"participacoes": [{"nome": None, "documento": "1", "papel": "dono"}]}, ["comunicacoes[0].participacoes[0].documento unknown document", "comunicacoes[0].participacoes[0].nome missing", "comunicacoes[0].participacoes[0].papel unknown role"]),
    }
    source = [f"fonte.{n} missing" for n in ("documento", "identificador", "incidente", "orgao", "tipo")]
    twice = dataset()
    twice["comunicacoes"] *= 2
    right = {"spaces": {"trecho": "26  lançamento(s)\nno total de:R$19.205.000,00"}, "blank": {"trecho": " "}, "status": {"situacao": "previsto"}, "none": {"transacoes": []}, "nulls": {"participacoes": None, "transacoes": None, "ocorrencias": None, "valor": ""}}
    sets = [(k, dataset(**v)) for k, (v, _) in bad.items()] + [(k, dataset(**v)) for k, v in right.items()] + [("json", "{"), ("null", None), ("twice", twice)]
    got = {}
    for r in datasets.validate_flows(*given(spark, *sets)).collect():
        got.setdefault(r.conjunto, []).append(f"{r.caminho} {r.erro}")
    want = {k: v for k, (_, v) in bad.items()} | {"json": source, "null": source, "twice": ["comunicacoes[1].numero repeated number"]}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert datasets.validate_flows(*given(spark, ("x", "{"))).where("false").count() == 0


def seen(spark, root):
    found = datasets.tables(spark, root, spark.createDataFrame([("nome:FULANO DA SILVA",)], "chave string"))
    return {n: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str) for n, df in found.items()}


def test_loads_replace_their_source_alone(spark, tmp_path):
    root = f"file://{tmp_path}/fluxos"
    assert all(not rows for rows in seen(spark, root).values())
    assert datasets.load(*given(spark, ("a", dataset("1")), ("b", dataset("2"))), root).count() == 0
    first = seen(spark, root)
    assert {n: len(x) for n, x in first.items()} == {"fontes": 2, "comunicacoes": 2, "participacoes": 4, "bens": 0, "transacoes": 2, "ocorrencias": 2, "atores": 2}
    found = datasets.tables(spark, root, spark.createDataFrame([("nome:FULANO DA SILVA",)], "chave string"))
    who = {r.chave: r for r in found["atores"].collect()}
    assert (who["cpf:818816"].documento, who["cpf:818816"].entidade, who["cpf:818816"].atividade) == ("***.818.816-**", "nome:FULANO DA SILVA", "ADVOGADO")
    assert (who["cnpj:57391420000163"].tipo, who["cnpj:57391420000163"].entidade) == ("pessoa_juridica", None)
    assert "027.818.816-86" not in str(first)
    tx = found["transacoes"].first()
    assert (tx.centavos, tx.origem, tx.situacao) == (1_920_500_000, "cpf:818816", "efetuado")
    # Loaded again, the tables stay as they are.
    datasets.load(*given(spark, ("a", dataset("1")), ("b", dataset("2"))), root)
    assert seen(spark, root) == first
    # An invalid dataset writes nothing, beside a valid one that replaces its source.
    faults = datasets.load(*given(spark, ("c", dataset("1", trecho="nada disso")), ("d", dataset("2", participacoes=[{"nome": "NOVA", "documento": "nome:Nova", "papel": "outros", "tipo": "pessoa_fisica"}], transacoes=[]))), root)
    assert {r.conjunto for r in faults.collect()} == {"c"}
    last = seen(spark, root)
    assert {n: len(x) for n, x in last.items()} == {"fontes": 2, "comunicacoes": 2, "participacoes": 3, "bens": 0, "transacoes": 1, "ocorrencias": 2, "atores": 3}
    key = found["fontes"].where("identificador = '1'").first().fonte
    assert all([r for r in last[n] if key in str(r)] == [r for r in first[n] if key in str(r)] for n in ("comunicacoes", "participacoes", "transacoes", "ocorrencias"))


def test_a_load_that_dies_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/fluxos"
    datasets.load(*given(spark, ("a", dataset("1"))), root)
    before = seen(spark, root)
    datasets.load(*given(spark, ("b", dataset("1", transacoes=[])), ("c", dataset("2"))), root)
    shutil.rmtree(tmp_path / "fluxos" / "cargas" / "carga=2")  # as if it had ended before its log was written
    assert seen(spark, root) == before
    datasets.load(*given(spark, ("b", dataset("1", transacoes=[]))), root)
    assert not seen(spark, root)["transacoes"] and len(seen(spark, root)["fontes"]) == 1


def test_actors_by_name(spark, tmp_path):
    """The first sighting names an actor; a later one may say what it is."""
    root = f"file://{tmp_path}/fluxos"
    paid = dataset()["comunicacoes"][0]["transacoes"][0] | {"origem": "nome: José 027.818.816-86", "destino": "11222333000181"}
    datasets.load(*given(spark, ("a", dataset("1", participacoes=[], titular=None, transacoes=[paid]))), root)
    people = [{"nome": "Empresa", "documento": "11.222.333/0001-81", "papel": "outros", "atividade": "x"}, {"nome": "Outro", "documento": "nome:JOSÉ 027.818.816-86", "papel": "outros", "tipo": "pessoa_fisica"}]
    datasets.load(*given(spark, ("b", dataset("2", participacoes=people, titular=None, transacoes=[]))), root)
    got = {r.chave: (r.nome, r.tipo, r.atividade) for r in datasets.tables(spark, root, spark.createDataFrame([], "chave string"))["atores"].collect()}
    assert got == {"cnpj:11222333000181": ("11.222.333/0001-81", "pessoa_juridica", "x"), "nome:JOSE ***.818.816-**": ("José ***.818.816-**", "pessoa_fisica", None)}


def test_evidence(spark):
    proof = "array<struct<assercao:bigint,secao:string,numero:string,origem:string,destino:string,documento:bigint,pagina:int,trecho:string>>"
    said, paid, page = (7, None, None, None, None, None, None, None), (None, "A", "1", "x", None, None, None, None), (None, None, None, None, None, 1, 1, "pagou R$ 1.234,56")
    lost = (8, None, None, None, None, None, None, None)
    steps = spark.createDataFrame([("p1", [said, paid, page]), ("p2", [lost]), ("p3", []), ("p4", None)], f"passo string, provas {proof}")
    assertions = spark.createDataFrame([(7, "afirma")], "assercao_id bigint, texto string")
    coms = spark.createDataFrame([("A", "1", "c1")], "secao string, numero string, com_id string")
    tx = spark.createDataFrame([("c1", "t1", "x", "y", 100), ("c1", "t2", "z", "y", 900), ("c1", "t3", "x", "w", 300)], "com_id string, tx_id string, origem string, destino string, centavos bigint")
    proofs, errors = flows.resolve_evidence(steps, assertions, coms, tx, pages(spark))
    got = {(r.passo, r.k): (r.prova, r.achado, r.centavos, r.transacoes) for r in proofs.collect()}
    assert got == {("p1", 0): ("assercao", "afirma", None, None), ("p1", 1): ("comunicacao", "c1", 400, ["t3", "t1"]), ("p1", 2): ("documento", "pagou R$ 1.234,56", None, None)}
    assert {(r.passo, r.erro) for r in errors.collect()} == {("p2", "missing proof"), ("p3", "step without proof"), ("p4", "step without proof")}


def test_stream_of_changes(spark, tmp_path):
    from dossier.streaming.ingest import ITEMS

    names = [f.split()[0] for f in ITEMS.split(", ")]
    (tmp_path / "in").mkdir()
    fill = {"incidente": 1, "lista": "andamentos", "posicao": 0}
    for k, run in enumerate(["r1", "r2"]):
        lines = [{n: fill.get(n, f"{n}{h}") for n in names} | {"coleta_id": run} for h in range(k, k + 2)]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
    for _ in range(2):  # started again, it finds nothing new
        stream_changes(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/t", f"file://{tmp_path}/c").awaitTermination()
    got = changes(spark, f"file://{tmp_path}/t")
    assert {(r.efeito, r.anterior, r.coleta_id, r.hash_natural) for r in got.collect()} == {("sumiu", "r1", "r2", "hash_natural0"), ("apareceu", "r1", "r2", "hash_natural2")}


def test_a_load_holds_few_datasets_at_once(spark, tmp_path):
    """What a load keeps of its datasets is read by row groups, whose rows a reader holds together: 12 MB of text take several."""
    draw = random.Random(4)
    sets = [(f"d{i}", dataset(str(i), informacoes="".join(draw.choices("abcdefgh ", k=400_000)))) for i in range(30)]
    found, text, documents = given(spark, *sets)
    before = set(Path(urlparse(shared_dir(spark)).path).glob("datasets-*"))
    assert datasets.load(found.coalesce(1), text, documents, f"file://{tmp_path}/fluxos").count() == 0
    (kept,) = set(Path(urlparse(shared_dir(spark)).path).glob("datasets-*")) - before
    meta = [pq.ParquetFile(f).metadata for f in kept.glob("*.parquet")]
    groups = [m.row_group(i) for m in meta for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 30
    assert max(g.num_rows for g in groups) <= 20
    assert datasets.table(spark, f"file://{tmp_path}/fluxos", "comunicacoes").agg({"informacoes": "max"}).first()[0] == max(x["comunicacoes"][0]["informacoes"] for _, x in sets)
