"""The graph of cases, entities and citations: typed edges with sources, degrees, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import minister_key, name_key
from dossier.sources.shared import save, spread


def case_id(incidente: str = "incidente") -> F.col:
    return F.concat(F.lit("caso:"), F.col(incidente).cast("string"))


def external_id(classe: str, numero: str) -> F.col:
    return F.concat(F.lit("externo:"), F.col(classe), F.lit(" "), F.col(numero).cast("string"))


def entity_id(chave: str = "chave") -> F.col:
    return F.concat(F.lit("entidade:"), F.col(chave))


def case_nodes(cases: DataFrame, relations: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, tipo, rotulo, externo): known cases, related ones that aren't known, cited ones that aren't known."""
    label = F.concat_ws(" ", "classe", F.col("numero").cast("string"))
    known = cases.select(case_id().alias("id"), F.lit("processo").alias("tipo"), label.alias("rotulo"), F.lit(False).alias("externo"))
    keys = cases.select("classe", "numero")
    others = relations.select(F.col("classe_destino").alias("classe"), F.col("numero_destino").alias("numero")).union(citations.select("classe", "numero")).distinct().join(keys, ["classe", "numero"], "left_anti")
    return known.unionByName(others.select(external_id("classe", "numero").alias("id"), F.lit("processo").alias("tipo"), label.alias("rotulo"), F.lit(True).alias("externo")))


def entity_nodes(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, tipo, rotulo, externo, processos, papeis) of entities."""
    own = mentions.groupBy("chave").agg(F.count_distinct("incidente").alias("processos"), F.sort_array(F.collect_set("papel")).alias("papeis"))
    return entities.join(own, "chave", "left").select(entity_id().alias("id"), "tipo", F.col("nome").alias("rotulo"), F.lit(False).alias("externo"), F.coalesce("processos", F.lit(0)).alias("processos"), "papeis")


def _edge(df: DataFrame, a, b, kind: str, n=None, sources=None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(a.alias("origem"), b.alias("destino"), F.lit(kind).alias("tipo"), (F.lit(1) if n is None else n).cast("bigint").alias("n"), (none if sources is None else sources).alias("fontes"))


def target(df: DataFrame, cases: DataFrame, classe: str, numero: str) -> DataFrame:
    """df with destino_id, the known case's node or the external one."""
    known = cases.select(F.col("classe").alias("_c"), F.col("numero").alias("_n"), F.col("incidente").alias("_i"))
    return df.join(known, (F.col(classe) == F.col("_c")) & (F.col(numero) == F.col("_n")), "left").withColumn("destino_id", F.coalesce(case_id("_i"), external_id(classe, numero))).drop("_c", "_n", "_i")


def relation_edges(relations: DataFrame, cases: DataFrame) -> DataFrame:
    got = target(relations, cases, "classe_destino", "numero_destino")
    return _edge(got, case_id("incidente_origem"), F.col("destino_id"), "relacao").distinct()


def party_edges(mentions: DataFrame) -> DataFrame:
    return _edge(mentions.groupBy("chave", "incidente").agg(F.count("*").alias("n")), entity_id(), case_id(), "parte_em", F.col("n"))


def origin_number_matches(cases: DataFrame) -> DataFrame:
    """Weak edges: an origin number of at most seven digits that is another case's number."""
    own = cases.select("incidente", F.explode("numeros_origem").alias("x")).where(F.col("x").rlike(r"^\d{1,7}$")).select("incidente", F.col("x").cast("bigint").alias("numero")).distinct()
    other = cases.select("numero", F.col("incidente").alias("outro"))
    return _edge(own.join(other, "numero").where("incidente <> outro"), case_id(), case_id("outro"), "numero_origem")


def represents(mentions: DataFrame) -> DataFrame:
    """(incidente, advogado, representado): a block's lawyers represent all others of the nearest earlier block that has any."""
    blocks = mentions.groupBy("incidente", "bloco").agg(F.max(F.col("papel") != "advogado").alias("outros"))
    ahead = W.partitionBy("incidente").orderBy("bloco").rowsBetween(W.unboundedPreceding, -1)
    near = blocks.withColumn("alvo", F.last(F.when(F.col("outros"), F.col("bloco")), ignorenulls=True).over(ahead)).select("incidente", "bloco", "alvo")
    lawyers = mentions.where("papel = 'advogado'").join(near, ["incidente", "bloco"]).where("alvo is not null").select("incidente", "alvo", F.col("chave").alias("advogado"))
    others = mentions.where("papel <> 'advogado'").select("incidente", F.col("bloco").alias("alvo"), F.col("chave").alias("representado"))
    return lawyers.join(others, ["incidente", "alvo"]).select("incidente", "advogado", "representado").distinct()


def representation_edges(mentions: DataFrame) -> DataFrame:
    got = represents(mentions).groupBy("advogado", "representado").agg(F.count("*").alias("n"))
    return _edge(got, entity_id("advogado"), entity_id("representado"), "representa", F.col("n"))


def first_sources(df: DataFrame, rows: int, key: list[str], source, order: list[str], most: int, different: bool = False) -> DataFrame:
    """For each key of df, which has about so many rows, n rows and the first `most` sources: ranked before they are collected, so no list
    grows beyond it. With `different` n is how many values the first column of the order has."""
    w = W.partitionBy(*key).orderBy(*order)
    ranked = spread(df.select(*dict.fromkeys([*key, *order])), rows, *key).withColumn("_r", F.row_number().over(w))
    n = F.count("*")
    if different:
        ranked = ranked.withColumn("_new", ~F.col(order[0]).eqNullSafe(F.lag(order[0]).over(w)) & F.col(order[0]).isNotNull())
        n = F.count_if("_new")
    return ranked.groupBy(*key).agg(n.alias("n"), F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", source.alias("_s"))))), lambda x: x["_s"]).alias("fontes"))


def citation_edges(citations: DataFrame, docs: DataFrame, cases: DataFrame, most: int = 25) -> DataFrame:
    """Case to cited case: n documents; sources are document and page. Citations of the case itself don't count."""
    met = citations.select("documento_id", "pagina", "classe", "numero").join(docs.select("documento_id", "incidente"), "documento_id")
    own = save(target(met, cases, "classe", "numero").where(case_id() != F.col("destino_id")).select("incidente", "destino_id", "documento_id", "pagina"), "cited")
    page = F.concat_ws(":", F.col("documento_id").cast("string"), F.col("pagina").cast("string"))
    got = first_sources(own, own.count(), ["incidente", "destino_id"], page, ["documento_id", "pagina"], most, different=True)
    return _edge(got, case_id(), F.col("destino_id"), "cita_processo", F.col("n"), F.col("fontes"))


def cited_in_edges(links: DataFrame, assertions: DataFrame, most: int = 25) -> DataFrame:
    """Entity to the case whose assertions cite it."""
    own = save(links.join(assertions.select("assercao_id", "incidente"), "assercao_id").select("chave", "incidente", "assercao_id"), "cited")
    got = first_sources(own, own.count(), ["chave", "incidente"], F.col("assercao_id").cast("string"), ["assercao_id"], most)
    return _edge(got, entity_id(), case_id(), "citado_em", F.col("n"), F.col("fontes"))


def speaker_edges(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    """Speaker to case for each epistemic type, the speaker met by minister key, then by name key."""
    keys = entities.select("chave")
    asked = assertions.where("atribuida_a is not null").withColumns({"m": minister_key(F.col("atribuida_a")), "p": name_key(F.col("atribuida_a"))})
    found = asked.join(keys.withColumnRenamed("chave", "cm"), F.col("m") == F.col("cm"), "left").join(keys.withColumnRenamed("chave", "cp"), F.col("p") == F.col("cp"), "left").withColumn("chave", F.coalesce("cm", "cp")).where("chave is not null")
    got = found.groupBy("chave", "incidente", "tipo_epistemico").agg(F.count("*").alias("n"))
    return got.select(entity_id().alias("origem"), case_id().alias("destino"), F.concat(F.lit("afirma_em:"), "tipo_epistemico").alias("tipo"), "n", F.array().cast("array<string>").alias("fontes"))


#: Members of a group that meet in one key at most, about; larger groups are dealt into tiles, and pairs of tiles are the keys.
TILE = 500


def pairs_within(members: DataFrame, group: str, name: str, tile: int = TILE, rows: int | None = None) -> DataFrame:
    """(group, a, b), a < b: all pairs of different members (group, name) of a group, whose names are distinct in it; rows is
    how many members there are about, counted if not given.

    A group of n members has n / tile tiles; each member goes to the pairs of its own tile with the others, so a key holds two tiles
    however large its group is.
    """
    members = spread(members, members.count() if rows is None else rows, group)
    sizes = members.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_k", F.ceil(F.col("_n") / tile).cast("int"))
    n = sizes.agg(F.sum(F.col("_n") * F.col("_k"))).first()[0] or 0
    dealt = members.join(sizes.select(group, "_k"), group).withColumn("_t", F.pmod(F.xxhash64(name), F.col("_k")).cast("int"))
    left = dealt.select(group, F.col(name).alias("_l"), F.col("_t").alias("_i"), F.explode(F.expr("sequence(_t, _k - 1)")).alias("_j"))
    right = dealt.select(group, F.col(name).alias("_r"), F.explode(F.expr("sequence(0, _t)")).alias("_i"), F.col("_t").alias("_j"))
    met = spread(left, n, group, "_i", "_j").join(spread(right, n, group, "_i", "_j"), [group, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_l") < F.col("_r")))
    return met.select(group, F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b"))


def cocitation_edges(links: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """Unordered pairs of entities in the same assertion; ministers and lawyers are left out."""
    others = entities.where("tipo not in ('ministro', 'advogado')").select("chave").hint("shuffle_hash")  # hashed, so the links aren't sorted
    met = save(links.join(others, "chave").select("assercao_id", "chave"), "met")
    own = save(spread(met, rows := met.count(), "assercao_id").distinct(), "members")
    groups = spread(own, rows, "assercao_id").groupBy("assercao_id").agg(F.count("*").alias("n"))
    pairs = groups.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint")).first()[0] or 0
    got = first_sources(pairs_within(own, "assercao_id", "chave", rows=rows), pairs, ["a", "b"], F.col("assercao_id").cast("string"), ["assercao_id"], most)
    return _edge(got, entity_id("a"), entity_id("b"), "co_citacao", F.col("n"), F.col("fontes"))


def minister_edges(cases: DataFrame, votes: DataFrame) -> DataFrame:
    led = cases.where("relator is not null").withColumn("chave", minister_key(F.col("relator")))
    cast = votes.withColumn("chave", minister_key(F.col("ministro"))).groupBy("chave", "incidente").agg(F.count("*").alias("n"))
    return _edge(led, entity_id(), case_id(), "relator_de").unionByName(_edge(cast, entity_id(), case_id(), "votou_em", F.col("n")))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("origem", "destino")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("grau"))


def build_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their degree; those without an edge go unless they are known cases."""
    got = nodes.join(degrees(edges), "id", "left").withColumn("grau", F.coalesce("grau", F.lit(0)))
    return got.where("grau > 0 or (tipo = 'processo' and not externo)")


def seed_distance(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(id, distancia): least number of undirected edges (origem, destino) from any seed (id); unreachable nodes have no row.

    A frontier is joined with the edges until nothing new is met, each round written to the shared folder. The frontier's ids are
    hashed, so a node's edges only pass by, however many it has.
    """
    both = save(edges.select(F.col("origem").alias("id"), F.col("destino").alias("next")).union(edges.select("destino", "origem")), "edges")
    both = save(spread(both, n := both.count(), "id", "next").distinct(), "edges")
    dealt = spread(both, n, "id")
    reached = save(seeds.select("id").distinct().withColumn("distancia", F.lit(0)), "reached")
    frontier, d = reached.select("id"), 0
    while most is None or d < most:
        d += 1
        met = dealt.join(frontier.hint("shuffle_hash"), "id").select(F.col("next").alias("id"))
        step = spread(met, n, "id").distinct().join(reached.select("id"), "id", "left_anti").withColumn("distancia", F.lit(d))
        step = save(step, "frontier")
        if step.isEmpty():
            break
        reached, frontier = reached.unionByName(step), step.select("id")
    return reached


def expand_frontier(seeds: DataFrame, relations: DataFrame, cases: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases reached within depth, those at depth + 1, related ones that aren't resolved): breadth first over resolved cases."""
    got = target(relations, cases, "classe_destino", "numero_destino")
    resolved = got.where(F.startswith("destino_id", F.lit("caso:")))
    edges = resolved.select(case_id("incidente_origem").alias("origem"), F.col("destino_id").alias("destino"))
    far = seed_distance(edges, seeds.select(case_id().alias("id")), depth + 1)
    pending = got.where(~F.startswith("destino_id", F.lit("caso:"))).select(F.col("classe_destino").alias("classe"), F.col("numero_destino").alias("numero")).distinct()
    return far.where(F.col("distancia") <= depth), far.where(F.col("distancia") == depth + 1), pending


def relations_report(relations: DataFrame, cases: DataFrame) -> DataFrame:
    """(origem, destino, tipo) labels in order."""
    label = cases.select(F.col("incidente").alias("incidente_origem"), F.concat_ws(" ", "classe", F.col("numero").cast("string")).alias("origem"))
    return relations.join(label, "incidente_origem").select("origem", F.concat_ws(" ", "classe_destino", F.col("numero_destino").cast("string")).alias("destino"), "tipo").orderBy("origem", "tipo", "destino")


def top_hubs(nodes: DataFrame, edges: DataFrame, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """(entities, external cases) of highest degree."""
    got = nodes.join(degrees(edges), "id")
    best = lambda df: df.orderBy(F.desc("grau"), "id").limit(n)
    return best(got.where("tipo <> 'processo'")), best(got.where("tipo = 'processo' and externo"))
