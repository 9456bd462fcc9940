"""People, organisations and ministers resolved to keys; proposals for names that may be the same."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import Rules, classify_first_match, entity_key, entity_type, likely_company, minister_key, minister_name, name_key, normalize_key, normalize_name
from dossier.sources.shared import save


def canonical_name(mentions: DataFrame, key: str = "chave") -> DataFrame:
    """The most frequent spelling of each key, ties to the first seen. mentions: (key, nome, id)."""
    own = mentions.groupBy(key, "nome").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return own.groupBy(key).agg(F.min_by("nome", F.struct(-F.col("n"), "first")).alias("nome"))


def build_entities(parties: DataFrame, minister_names: DataFrame, groups: Rules, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(chave, tipo, nome, natureza_provavel, grupo, origem): one row a key.

    parties: (id, nome, papel, oab, e_placeholder). minister_names: (nome, ordem), names from headers, lists and votes; of a
    minister's spellings the one that is first seen last counts, and a minister's row comes before a party's.
    """
    real = parties.where("not e_placeholder").withColumn("chave", entity_key(F.col("papel"), F.col("nome"), F.col("oab"), aliases)).withColumn("tipo", entity_type(F.col("papel")))
    kinds = real.groupBy("chave").agg(F.max_by("tipo", F.struct(F.col("id"))).alias("tipo"))
    group = classify_first_match(normalize_name(F.col("nome")), groups)
    own = canonical_name(real).join(kinds, "chave").select("chave", "tipo", "nome", likely_company(F.col("nome")).alias("natureza_provavel"), group.alias("grupo"), F.lit("partes").alias("origem"))
    spelled = minister_names.where("nome is not null").select(minister_name(F.col("nome")).alias("nome"), "ordem").groupBy("nome").agg(F.min("ordem").alias("ordem"))
    ministers = spelled.withColumn("chave", minister_key(F.col("nome"), aliases)).groupBy("chave").agg(F.max_by("nome", "ordem").alias("nome"))
    court = ministers.select("chave", F.lit("ministro").alias("tipo"), "nome", F.lit(None).cast("string").alias("natureza_provavel"), F.lit("Supremo Tribunal Federal").alias("grupo"), F.lit("portal").alias("origem"))
    return own.join(court.select("chave"), "chave", "left_anti").unionByName(court)


def entity_mentions(parties: DataFrame, entities: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(chave, parte_id, incidente, papel, bloco) of parties that stand for someone."""
    keyed = parties.where("not e_placeholder").withColumn("chave", entity_key(F.col("papel"), F.col("nome"), F.col("oab"), aliases))
    return keyed.join(entities.select("chave"), "chave").select("chave", F.col("id").alias("parte_id"), "incidente", "papel", "bloco")


def resolve_cited_entities(cited: DataFrame, entities: DataFrame, aliases: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(links (assercao_id, chave), new entities): names in assertions (assercao_id, nome, tipo) met with known keys.

    A name typed or prefixed as a minister's takes that key, others the name key; then a lawyer of the same stored name;
    what is left becomes an entity of its own from the documents.
    """
    minister = (F.col("tipo") == "ministro") | F.col("nome").rlike(r"(?i)^\s*(?:MIN\.?|MINISTR[OA])\s+")
    asked = cited.withColumn("pedida", F.when(minister, minister_key(F.col("nome"), aliases)).otherwise(name_key(F.col("nome"), aliases)))
    known = entities.select(F.col("chave").alias("pedida"), F.col("chave").alias("achada"))
    lawyers = entities.where("tipo = 'advogado'").groupBy(F.col("nome").alias("_n")).agg(F.min("chave").alias("advogado"))
    found = asked.join(known, "pedida", "left").join(lawyers, normalize_name(F.col("nome")) == F.col("_n"), "left").withColumn("chave", F.coalesce("achada", "advogado", "pedida"))
    fresh = found.where("achada is null and advogado is null").groupBy("chave").agg(F.min_by("nome", "assercao_id").alias("nome"), F.min_by("tipo", "assercao_id").alias("tipo"))
    return found.select("assercao_id", "chave").distinct(), fresh.withColumn("origem", F.lit("documento"))


def _share_a_piece(names: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: ids of names (id, norm, len), of which the longer holds one of the shorter's pieces about where it stands there.

    A name of n characters has the pieces that its longest partner needs, n * (2 / threshold - 1): one more than may break.
    """
    stretch, slack = 2 / threshold - 1, 1e-9
    broken = lambda n: F.floor((1 - threshold) * (1 + stretch) * n + slack).cast("int")
    start = lambda n, i: F.floor(i * n / (broken(n) + 1)).cast("int")
    cut = lambda n, i: start(n, i + 1) - start(n, i)
    key = lambda n, i, at: F.xxhash64(n, i, F.substring(F.col("norm"), at + 1, cut(n, i)))
    length = F.col("len")
    own = names.select("id", "len", F.explode(F.transform(F.sequence(F.lit(0), broken(length)), lambda i: key(length, i, start(length, i)))).alias("k"))

    # A longer name of m characters asks for each length n of a partner, each piece i and each place that it may have moved to.
    partners = names.select("id", "norm", "len", F.explode(F.sequence(F.ceil(length / stretch - slack).cast("int"), length)).alias("n"))
    n = F.col("n")
    most = F.floor((1 - threshold) * (length + n) + slack)
    back, on = F.floor((most - (length - n)) / 2).cast("int"), F.floor((most + (length - n)) / 2).cast("int")
    pieces = partners.select("id", "norm", "len", "n", back.alias("back"), on.alias("on"), F.explode(F.sequence(F.lit(0), broken(n))).alias("i")).where("back >= 0")
    at, i = start(n, F.col("i")), F.col("i")
    low, high = F.greatest(at - F.col("back"), F.lit(0)), F.least(at + F.col("on"), length - cut(n, i))
    asked = pieces.withColumns({"low": low, "high": high}).where("low <= high").select("id", "n", F.explode(F.array_distinct(F.transform(F.sequence("low", "high"), lambda p: key(n, i, p)))).alias("k"))
    met = own.select(F.col("id").alias("x"), F.col("len").alias("n"), "k").join(asked.select(F.col("id").alias("y"), "n", "k"), ["n", "k"]).where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def propose_aliases(entities: DataFrame, threshold: float = 0.9, least: int = 12) -> DataFrame:
    """(a, b, semelhanca, contido): pairs of entities (id, tipo, chave, nome) whose normalised names are alike; proposals only.

    Alike: a matching-blocks ratio of at least the threshold, or one name's words all in the other's with the same first and
    last. Names under `least` characters and lawyers are left out. Names are unified first, so equal ones are never paired.
    Candidates come without loss: of T characters in both at most d = (1 - threshold) * T match nothing, each of which breaks one of
    the shorter name's pieces; cut into more pieces than that, one stands whole in the longer name, at most d places off.
    """
    names = entities.where("tipo <> 'advogado'").withColumn("norm", normalize_key(F.col("nome"))).where(F.length("norm") >= least)
    one = save(names.groupBy("norm").agg(F.min("id").alias("id")).withColumn("len", F.length("norm")), "names")
    near = _share_a_piece(one, threshold)
    # A name inside another has all its words there: its rarest one, with the first and last, meets only names that may hold it.
    words = one.withColumn("w", F.split("norm", " ")).where("size(w) >= 2").select("id", "w", F.get("w", F.lit(0)).alias("f"), F.element_at("w", -1).alias("l"))
    each = words.select("id", "f", "l", F.explode(F.array_distinct("w")).alias("t"))
    rare = each.join(each.groupBy("f", "l", "t").agg(F.count("*").alias("n")), ["f", "l", "t"]).groupBy("id").agg(F.min_by("t", F.struct("n", "t")).alias("t"))
    held = each.withColumnRenamed("id", "b").join(words.join(rare, "id").select(F.col("id").alias("a"), "f", "l", "t", F.col("w").alias("wa")), ["f", "l", "t"]).where("a <> b")
    held = held.join(words.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b").where("size(array_except(wa, wb)) = 0")
    inside = held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("contido")).distinct()
    pairs = near.join(inside, ["a", "b"], "full_outer").join(one.select(F.col("id").alias("a"), F.col("norm").alias("nome_a")), "a").join(one.select(F.col("id").alias("b"), F.col("norm").alias("nome_b")), "b")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            most = 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y))
            out.append(difflib.SequenceMatcher(None, x, y).ratio() if most >= threshold else most)
        return pd.Series(out)

    rated = pairs.withColumn("semelhanca", ratio("nome_a", "nome_b")).withColumn("contido", F.coalesce("contido", F.lit(False)))
    return rated.where((F.col("semelhanca") >= threshold) | F.col("contido")).select("a", "b", "nome_a", "nome_b", "semelhanca", "contido").orderBy(F.desc("semelhanca"), "a", "b")


def entities_in_many_cases(mentions: DataFrame) -> DataFrame:
    """Entities in more than one case, with each case's roles in order."""
    roles = mentions.groupBy("chave", "incidente").agg(F.sort_array(F.collect_set("papel")).alias("papeis"))
    return roles.groupBy("chave").agg(F.count("*").alias("processos"), F.sort_array(F.collect_list(F.struct("incidente", "papeis"))).alias("onde")).where("processos > 1")


def rapporteur_cases(cases: DataFrame) -> DataFrame:
    return cases.where("relator is not null").groupBy(minister_key(F.col("relator")).alias("chave")).agg(F.sort_array(F.collect_list("incidente")).alias("incidentes"))


def entity_record(entities: DataFrame, mentions: DataFrame, links: DataFrame, statuses: Mapping[str, str]) -> DataFrame:
    """Entities with their mentions, each with its status, and the number of assertions that cite them."""
    from dossier.functions.text import role_status

    own = mentions.groupBy("chave").agg(F.sort_array(F.collect_list(F.struct("incidente", "papel", role_status(F.col("papel"), statuses).alias("situacao")))).alias("mencoes"))
    n = links.groupBy("chave").agg(F.count_distinct("assercao_id").alias("assercoes"))
    out = entities.join(own, "chave", "left").join(n, "chave", "left")
    return out.withColumns({"assercoes": F.coalesce("assercoes", F.lit(0)), "situacao": F.when(F.col("mencoes").isNull(), "citado em documento").otherwise(F.get("mencoes", F.lit(0))["situacao"])})


def entity_voices(assertions: DataFrame, links: DataFrame) -> DataFrame:
    """For each entity and epistemic type: assertions, and who speaks how often."""
    rows = links.join(assertions.select("assercao_id", "tipo_epistemico", "atribuida_a"), "assercao_id")
    own = rows.groupBy("chave", "tipo_epistemico", "atribuida_a").agg(F.count("*").alias("n"))
    return own.groupBy("chave", "tipo_epistemico").agg(F.sum("n").alias("assercoes"), F.sort_array(F.collect_list(F.struct("n", "atribuida_a")), asc=False).alias("vozes"))
