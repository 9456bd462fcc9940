"""Steps whose tasks hold a bounded number of rows, however many rows there are."""

from collections import defaultdict

import pytest

from dossier.operators import graph, references
from dossier.sources import shared


@pytest.fixture
def fine(monkeypatch):
    """Few rows a task, so that small tables are spread like large ones."""
    monkeypatch.setattr(shared, "ROWS", 20)


def test_tasks_grow_with_the_table(spark, fine):
    sizes = lambda n: shared.spread(spark.range(n), n, "id").rdd.glom().map(len).collect()
    assert len(sizes(0)) == 4
    assert len(sizes(2000)) == 100
    assert max(sizes(8000)) < 3 * shared.ROWS


def test_citations_are_met_in_many_tasks(spark, fine):
    """Edges of more tasks than shuffle partitions, as a slow version gives them: several pages a document, a case that cites itself."""
    refs = [(d, p, "Pet", 10 + (d * 7 + p) % 9) for d in range(300) for p in range(1 + d % 3)]
    docs = [(d, d % 5) for d in range(290)]
    cases = [(i, "Pet", 10 + i) for i in range(4)]
    known = {n: f"caso:{i}" for i, _, n in cases}
    want = defaultdict(list)
    for d, p, c, n in refs:
        a, b = f"caso:{d % 5}", known.get(n, f"externo:{c} {n}")
        if d < 290 and a != b:
            want[a, b].append((d, p))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = graph.citation_edges(frame(refs, "documento_id bigint, pagina int, classe string, numero bigint"), frame(docs, "documento_id bigint, incidente bigint"), frame(cases, "incidente bigint, classe string, numero bigint"), most=4)
    assert edges.rdd.getNumPartitions() >= 20
    got = {(r.origem, r.destino): (r.n, r.fontes) for r in edges.collect()}
    assert got == {k: (len({d for d, _ in v}), [f"{d}:{p}" for d, p in sorted(v)[:4]]) for k, v in want.items()}


def test_pairs_are_met_in_many_tasks(spark, fine):
    links = [(a, f"k{(a * 3 + j) % 11}") for a in range(200) for j in range(4)]
    rows = spark.createDataFrame([*links, *links[:50]], "assercao_id bigint, chave string")
    names = spark.createDataFrame([(f"k{i}", "ministro" if i == 0 else "parte") for i in range(11)], "chave string, tipo string")
    want = defaultdict(list)
    for a in range(200):
        own = sorted({k for x, k in links if x == a} - {"k0"})
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                want[f"entidade:{x}", f"entidade:{y}"].append(a)
    edges = graph.cocitation_edges(rows, names, most=3)
    assert edges.rdd.getNumPartitions() >= 20
    assert {(r.origem, r.destino): (r.n, r.fontes) for r in edges.collect()} == {k: (len(v), [str(a) for a in sorted(v)[:3]]) for k, v in want.items()}


def test_statutes_are_counted_in_many_tasks(spark, fine):
    laws = [(d, f"art. {(d + j) % 6}") for d in range(300) for j in range(2)]
    docs = spark.createDataFrame([(d, d % 7 if d % 6 else 0) for d in range(300)], "documento_id bigint, incidente bigint")
    none = spark.createDataFrame([], "documento_id bigint, pagina int, classe string, numero bigint, ocorrencias bigint")
    cases = spark.createDataFrame([], "incidente bigint, classe string, numero bigint")
    got = references.cross_case_citations(none, docs, cases, spark.createDataFrame([*laws, *laws[:9]], "documento_id bigint, dispositivo string"))[1]
    want = [(a, len({d % 7 if d % 6 else 0 for d, x in laws if x == a}), len({d for d, x in laws if x == a})) for a in {x for _, x in laws}]
    assert [tuple(r) for r in got.select("dispositivo", "processos", "documentos").collect()] == sorted(want, key=lambda r: (-r[1], -r[2], r[0]))


def test_distances_are_found_in_many_tasks(spark, fine):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n2", f"leaf{i}") for i in range(400)], "origem string, destino string")
    got = {r.id: r.distancia for r in graph.seed_distance(edges, spark.createDataFrame([("n0",)], "id string")).collect()}
    assert got == {**{f"n{i}": i for i in range(7)}, **{f"leaf{i}": 3 for i in range(400)}}
