"""Money flows in integer cents: actors, totals, edges, reports and evidence. Datasets and their tables: see datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import actor_key, mask_document, mask_text, name_key, strip_all_ws

SUMMARY = "resumo_tipo"
#: Flows that count as money paid: carried out, and not a summary of others.
COUNTED = f"situacao = 'efetuado' and natureza <> '{SUMMARY}'"


def build_actors(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row an actor key. refs: (documento, nome, atividade, ordem): first name, masked, first activity, type other than unknown if
    any gives one, masked document, and the entity of that name."""
    keyed = refs.withColumn("a", actor_key(F.col("documento"))).select("*", "a.chave", "a.tipo")
    first = lambda c, test: F.min_by(c, F.when(test, F.col("ordem")))
    own = keyed.groupBy("chave").agg(
        mask_text(first("nome", F.col("nome").isNotNull())).alias("nome"),
        first("atividade", F.col("atividade").isNotNull()).alias("atividade"),
        F.coalesce(first("tipo", F.col("tipo") != "desconhecido"), F.lit("desconhecido")).alias("tipo"),
        mask_document(F.min_by("documento", "ordem")).alias("documento"),
    )
    known = entities.select(F.col("chave").alias("entidade"))
    return own.join(known, name_key(F.col("nome")) == F.col("entidade"), "left")


def actor_totals(tx: DataFrame) -> DataFrame:
    """(ator, entrada, saida, n_transacoes): flows carried out that aren't summaries; a flow to oneself counts at both ends."""
    ends = tx.where(COUNTED).select(F.inline(F.array(F.struct(F.col("origem").alias("ator"), F.lit(0).cast("bigint").alias("e"), F.col("centavos").alias("s")), F.struct(F.col("destino").alias("ator"), F.col("centavos").alias("e"), F.lit(0).cast("bigint").alias("s")))))
    return ends.where("ator is not null").groupBy("ator").agg(F.sum("e").alias("entrada"), F.sum("s").alias("saida"), F.count("*").alias("n_transacoes"))


def actor_flow_counts(tx: DataFrame) -> DataFrame:
    """(ator, n_fluxos): flows of any status, one to oneself once."""
    return tx.select("tx_id", F.explode(F.array_distinct(F.array_compact(F.array("origem", "destino")))).alias("ator")).groupBy("ator").agg(F.count("*").alias("n_fluxos"))


def flow_edges(tx: DataFrame) -> DataFrame:
    """Directed pairs with both ends: sum, number, ids, natures, types and sections."""
    own = tx.where(COUNTED).where("origem is not null and destino is not null")
    sets = [F.sort_array(F.collect_set(c)).alias(a) for c, a in (("natureza", "naturezas"), ("tipo", "tipos"), ("secao", "secoes"))]
    return own.groupBy("origem", "destino").agg(F.sum("centavos").alias("centavos"), F.count("*").alias("n"), F.sort_array(F.collect_list("tx_id")).alias("transacoes"), *sets)


def undirected_edges(coms: DataFrame, participations: DataFrame, tx: DataFrame) -> DataFrame:
    """(com_id, a, b, centavos): communications with an amount other than zero but no flow and at least two holders or sellers; the main
    holder, if it is one of them, else the lowest, is tied to every other. coms: (com_id, titular, centavos); participations: (com_id, ator, papel)."""
    bare = coms.where("centavos <> 0").join(tx.select("com_id").distinct(), "com_id", "left_anti")
    people = bare.join(participations.where("papel in ('titular', 'vendedor')"), "com_id")
    own = people.groupBy("com_id", "titular", "centavos").agg(F.sort_array(F.collect_set("ator")).alias("todos")).where("size(todos) > 1")
    a = F.when(F.array_contains("todos", F.col("titular")), F.col("titular")).otherwise(F.get("todos", F.lit(0)))
    return own.withColumn("a", a).select("com_id", "a", F.explode(F.array_remove("todos", F.col("a"))).alias("b"), "centavos")


def flow_nodes(actors: DataFrame, edges: DataFrame) -> DataFrame:
    """The actors that an edge (origem, destino) touches."""
    return actors.join(edges.select(F.explode(F.array("origem", "destino")).alias("chave")).distinct(), "chave", "left_semi")


def flow_summary(tx: DataFrame) -> DataFrame:
    """(medida, valor, n, centavos): by nature, section and year of paid flows, and the dated and whole totals."""
    rows = lambda kind, value: F.struct(F.lit(kind).alias("medida"), value.cast("string").alias("valor"))
    year = F.substring(F.coalesce("data", "periodo_inicio"), 1, 4)
    kinds = [rows("natureza", F.col("natureza")), rows("secao", F.col("secao")), rows("ano", F.when(F.expr(COUNTED), F.coalesce(year, F.lit("sem data")))), rows("total", F.when(F.expr(COUNTED), F.lit("pago"))), rows("datado", F.when(F.expr(COUNTED) & F.col("data").isNotNull(), F.lit("pago")))]
    each = tx.select("centavos", F.inline(F.array(*kinds))).where("valor is not null")
    return each.groupBy("medida", "valor").agg(F.count("*").alias("n"), F.sum("centavos").alias("centavos"))


def flow_rows(tx: DataFrame, coms: DataFrame, actors: DataFrame) -> DataFrame:
    """One row a flow with names and masked documents of both ends, source and section."""
    named = lambda p: actors.select(F.col("chave").alias(p), F.col("nome").alias(f"{p}_nome"), F.col("documento").alias(f"{p}_documento"))
    return tx.join(coms.select("com_id", "fonte_id", "secao", "numero"), "com_id").join(named("origem"), "origem", "left").join(named("destino"), "destino", "left")


def actor_status(actors: DataFrame, mentions: DataFrame) -> DataFrame:
    """Actors with the roles and cases of their entity."""
    own = mentions.groupBy(F.col("chave").alias("entidade")).agg(F.sort_array(F.collect_set("papel")).alias("papeis"), F.sort_array(F.collect_set("incidente")).alias("incidentes"))
    return actors.join(own, "entidade", "left")


def communication_rows(coms: DataFrame, participations: DataFrame, tx: DataFrame, assets: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Communications with their numbers of participations, flows and assets and their occurrences' labels."""
    n = lambda df, name: df.groupBy("com_id").agg(F.count("*").alias(name))
    labels = occurrences.groupBy("com_id").agg(F.array_join(F.sort_array(F.collect_set("rotulo")), " | ").alias("ocorrencias"))
    out = coms
    for side in (n(participations, "participacoes"), n(tx, "transacoes"), n(assets, "bens")):
        out = out.join(side, "com_id", "left")
    return out.join(labels, "com_id", "left").fillna(0, ["participacoes", "transacoes", "bens"])


def asset_rows(assets: DataFrame) -> DataFrame:
    """Assets without what identifies them."""
    return assets.drop("identificacao")


def reconcile(coms: DataFrame, tx: DataFrame) -> DataFrame:
    """Reported credits and debits of communications (com_id, titular, creditos, debitos) against their type summaries, with the difference."""
    into, out = (F.col("destino") == F.col("titular"), F.col("origem") == F.col("titular"))
    joined = coms.join(tx.where(F.col("natureza") == SUMMARY).select("com_id", "origem", "destino", "centavos"), "com_id", "left")
    sums = joined.groupBy("com_id", "titular", "creditos", "debitos").agg(F.coalesce(F.sum(F.when(into, F.col("centavos"))), F.lit(0)).alias("resumo_creditos"), F.coalesce(F.sum(F.when(out, F.col("centavos"))), F.lit(0)).alias("resumo_debitos"))
    return sums.withColumns({"falta_creditos": F.col("creditos") - F.col("resumo_creditos"), "falta_debitos": F.col("debitos") - F.col("resumo_debitos")})


def top_counterparties(tx: DataFrame, k: int = 3) -> DataFrame:
    """(ator, sentido, lista): each actor's k largest payers and payees, itself left out."""
    own = tx.where(COUNTED).where("origem is not null and destino is not null and origem <> destino").groupBy("origem", "destino").agg(F.sum("centavos").alias("centavos"))
    both = own.select(F.inline(F.array(F.struct(F.col("origem").alias("ator"), F.lit("pagou").alias("sentido"), F.col("destino").alias("outro"), "centavos"), F.struct(F.col("destino").alias("ator"), F.lit("recebeu").alias("sentido"), F.col("origem").alias("outro"), "centavos"))))
    ranked = both.withColumn("r", F.row_number().over(W.partitionBy("ator", "sentido").orderBy(F.desc("centavos"), "outro"))).where(F.col("r") <= k)
    return ranked.groupBy("ator", "sentido").agg(F.sort_array(F.collect_list(F.struct("r", "outro", "centavos"))).alias("lista"))


def top_pairs(tx: DataFrame, n: int = 15) -> DataFrame:
    """The largest payer and payee pairs of any status; an unknown end is one; summaries don't count."""
    unknown = F.lit("não informado")
    return tx.where(F.col("natureza") != SUMMARY).groupBy(F.coalesce("origem", unknown).alias("origem"), F.coalesce("destino", unknown).alias("destino")).agg(F.sum("centavos").alias("centavos"), F.count("*").alias("n")).orderBy(F.desc("centavos"), "origem", "destino").limit(n)


def top_receivers(tx: DataFrame, n: int = 5) -> DataFrame:
    return actor_totals(tx).where("entrada > 0").orderBy(F.desc("entrada"), "ator").limit(n).select("ator", "entrada")


def top_payers(tx: DataFrame, n: int = 5) -> DataFrame:
    return actor_totals(tx).where("saida > 0").orderBy(F.desc("saida"), "ator").limit(n).select("ator", "saida")


def resolve_evidence(steps: DataFrame, assertions: DataFrame, coms: DataFrame, tx: DataFrame, pages: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(proofs, errors) of steps (passo, provas: array of struct(assercao, secao, numero, origem, destino, documento, pagina, trecho)).

    A proof is an assertion, a communication with its flows between the given ends (sum and the largest ones), or a page that
    holds the quote. A missing proof and a step without any is an error.
    """
    rows = steps.select("passo", F.posexplode("provas").alias("k", "p")).select("passo", "k", "p.*")
    a = rows.where("assercao is not null").join(assertions.select(F.col("assercao_id").alias("assercao"), F.col("texto").alias("achado")), "assercao", "left").select("passo", "k", F.lit("assercao").alias("prova"), "achado", F.lit(None).cast("bigint").alias("centavos"), F.lit(None).cast("array<string>").alias("transacoes"))
    named = rows.where("assercao is null and numero is not null").select("passo", "k", "secao", "numero", F.col("origem").alias("po"), F.col("destino").alias("pd"))
    c = named.join(coms.select("secao", "numero", "com_id"), ["secao", "numero"], "left").join(tx.select("com_id", "tx_id", "origem", "destino", F.col("centavos").alias("v")), "com_id", "left")
    fits = (F.col("po").isNull() | (F.col("po") == F.col("origem"))) & (F.col("pd").isNull() | (F.col("pd") == F.col("destino")))
    ranked = c.withColumn("v", F.when(fits, F.col("v"))).withColumn("r", F.row_number().over(W.partitionBy("passo", "k").orderBy(F.desc_nulls_last("v"), "tx_id")))
    b = ranked.groupBy("passo", "k").agg(F.lit("comunicacao").alias("prova"), F.max("com_id").alias("achado"), F.sum("v").alias("centavos"), F.transform(F.sort_array(F.collect_list(F.when((F.col("r") <= most) & F.col("v").isNotNull(), F.struct("r", "tx_id")))), lambda x: x["tx_id"]).alias("transacoes"))
    d = rows.where("assercao is null and numero is null and documento is not null").join(pages.select(F.col("documento_id").alias("documento"), "pagina", "texto"), ["documento", "pagina"], "left")
    held = F.when(F.contains(strip_all_ws(F.col("texto")), strip_all_ws(F.col("trecho"))), F.col("trecho"))
    d = d.select("passo", "k", F.lit("documento").alias("prova"), held.alias("achado"), F.lit(None).cast("bigint").alias("centavos"), F.lit(None).cast("array<string>").alias("transacoes"))
    proofs = a.unionByName(b).unionByName(d)
    missing = rows.select("passo", "k").join(proofs.where("achado is not null").select("passo", "k"), ["passo", "k"], "left_anti").select("passo", F.lit("missing proof").alias("erro"))
    empty = steps.where("provas is null or size(provas) = 0").select("passo", F.lit("step without proof").alias("erro"))
    return proofs.where("achado is not null"), missing.unionByName(empty)
