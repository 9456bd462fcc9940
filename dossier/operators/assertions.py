"""Statements that count only where their quote stands on the page named."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import judgement_terms, quote_norm

# Kinds of statements and of the entities in them, results of requests.
KINDS = ("fato_processual", "alegacao_parte", "fundamento_decisorio")
ENTITIES = ("pessoa", "organizacao", "orgao_publico", "ministro", "advogado", "desconhecido")
RESULTS = ("deferido", "indeferido", "parcialmente_deferido", "homologado", "referendado", "negado_seguimento", "nao_conhecido", "prejudicado", "determinado_de_oficio", "outro")
ITEM = "struct<k:int,tipo:string,texto:string,pagina:int,trecho_fonte:string,atribuida_a:string,entidades:array<struct<nome:string,tipo:string>>,pedido:string,quem_pediu:string,resultado:string,decisao:string,quem_decidiu:string,data:string,condicoes:array<string>>"


def _page(x: object) -> int | None:
    """A page number of one or more as JSON may give it: an integer, a whole float or digits in a string, never a boolean."""
    if isinstance(x, float) and x.is_integer():
        x = int(x)
    elif isinstance(x, str) and x.strip().lstrip("+-").isdigit():
        x = int(x)
    return x if isinstance(x, int) and not isinstance(x, bool) and x >= 1 else None


def _texts(item: dict, least: dict[str, int], optional: Sequence[str] = ()) -> dict | None:
    """The item's texts; none if one isn't a text or has fewer characters than least asks."""
    if any(not isinstance(item.get(n), str) or len(item[n]) < k for n, k in least.items()):
        return None
    if any(item.get(n) is not None and not isinstance(item[n], str) for n in optional):
        return None
    return {n: item.get(n) for n in [*least, *optional]}


def _assertion(item: dict) -> dict | None:
    got = _texts(item, {"tipo_epistemico": 1, "texto": 1, "trecho_fonte": 1}, ("atribuida_a",))
    names = item.get("entidades", [])
    if got is None or got["tipo_epistemico"] not in KINDS or (page := _page(item.get("pagina"))) is None or not isinstance(names, list):
        return None
    if not all(isinstance(e, dict) and (t := _texts(e, {"nome": 1, "tipo": 1})) and t["tipo"] in ENTITIES for e in names):
        return None
    return {"tipo": got.pop("tipo_epistemico"), **got, "pagina": page, "entidades": [{"nome": e["nome"], "tipo": e["tipo"]} for e in names]}


def _decision(item: dict) -> dict | None:
    got = _texts(item, {"pedido": 3, "resultado": 1, "decisao": 3, "quem_decidiu": 2, "trecho_fonte": 3}, ("quem_pediu", "data"))
    terms = item.get("condicoes", [])
    if got is None or got["resultado"] not in RESULTS or (page := _page(item.get("pagina"))) is None or not isinstance(terms, list) or not all(isinstance(x, str) for x in terms):
        return None
    return {**got, "pagina": page, "condicoes": terms}


def _checked(responses: DataFrame, field: str, one: Callable[[dict], dict | None]) -> DataFrame:
    """responses (id, resposta) with rejeicao, the reason why the whole response doesn't count, and itens."""
    names = [x.split(":")[0] for x in "k tipo texto pagina trecho_fonte atribuida_a entidades pedido quem_pediu resultado decisao quem_decidiu data condicoes".split()]

    @F.pandas_udf(f"struct<rejeicao:string,itens:array<{ITEM}>>")
    def check(text: pd.Series) -> pd.DataFrame:
        why, found = [], []
        for t in text:
            try:
                data = json.loads(t)
            except (TypeError, ValueError):
                why.append("json"), found.append([])
                continue
            items = data.get(field) if isinstance(data, dict) else None
            got = [one(x) if isinstance(x, dict) else None for x in items] if isinstance(items, list) else [None]
            if any(x is None for x in got) or not isinstance(data.get("observacoes"), (str, type(None))):
                why.append("schema"), found.append([])
            else:
                why.append(None), found.append([{n: k if n == "k" else x.get(n) for n in names} for k, x in enumerate(got)])
        return pd.DataFrame({"rejeicao": why, "itens": found})

    return responses.withColumn("_c", check("resposta")).select(*responses.columns, "_c.*")


def _validated(responses: DataFrame, pages: DataFrame, field: str, one: Callable[[dict], dict | None], most: int) -> tuple[DataFrame, DataFrame]:
    """(items with motivo, null where they count; (documento_id, status, validas, descartadas)).

    An item is dropped if its page isn't one of the document's, or its quote is empty, too long or not on that page.
    """
    got = _checked(responses, field, one)
    rows = got.select("documento_id", F.explode("itens").alias("i")).select("documento_id", "i.*")
    norm = pages.select("documento_id", "pagina", quote_norm(F.col("texto")).alias("_t"))
    met = rows.join(norm, ["documento_id", "pagina"], "left")
    quote = quote_norm(F.col("trecho_fonte"))
    why = F.when(F.col("_t").isNull(), "pagina inexistente").when(quote == "", "trecho vazio").when(F.length("trecho_fonte") > most, "trecho longo").when(~F.contains("_t", quote), "trecho fora da pagina")
    items = met.withColumn("motivo", why).drop("_t")
    n = items.groupBy("documento_id").agg(F.count(F.when(F.col("motivo").isNull(), 1)).alias("validas"), F.count("motivo").alias("descartadas"))
    status = got.select("documento_id", F.coalesce(F.concat(F.lit("rejeitada:"), "rejeicao"), F.lit("ok")).alias("status")).join(n, "documento_id", "left")
    return items, status.fillna(0, ["validas", "descartadas"])


def validate_assertions(responses: DataFrame, pages: DataFrame, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """responses: (documento_id, resposta); pages: (documento_id, pagina, texto). See _validated."""
    return _validated(responses, pages, "assercoes", _assertion, most)


def validate_decisions(responses: DataFrame, pages: DataFrame, most: int = 300) -> tuple[DataFrame, DataFrame]:
    return _validated(responses, pages, "itens", _decision, most)


def extraction_log(results: DataFrame) -> DataFrame:
    """The latest result of each document, digest, prompt version and model."""
    w = W.partitionBy("documento_id", "sha256_documento", "prompt_version", "modelo").orderBy(F.desc("executada_em"))
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assertion_counts(assertions: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Each case's assertions of each kind, zeros kept."""
    return assertions.groupBy("incidente").pivot("tipo_epistemico", list(kinds)).count().fillna(0)


def neutrality_violations(assertions: DataFrame, decisions: DataFrame, terms: Sequence[str], legal: Sequence[str]) -> DataFrame:
    """Generated texts with loaded words: facts of procedure, requests and decisions."""
    facts = assertions.where("tipo_epistemico = 'fato_processual'").select(F.col("assercao_id").alias("id"), F.lit("assercao").alias("origem"), "texto")
    asked = decisions.select(F.col("decisao_id").alias("id"), F.lit("decisao").alias("origem"), F.explode(F.array("pedido", "decisao")).alias("texto"))
    return facts.unionByName(asked).withColumn("termos", judgement_terms(F.col("texto"), terms, legal)).where("size(termos) > 0")
