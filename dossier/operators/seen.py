"""Facts with provenance: natural keys, folds of repeated observations, merges with a documented order.

Observations carry sid, the rank of the capture (see sources.registry). All folds are grouped aggregates with map-side
partial results; "first" and "last" always mean by (sid, posicao) or the order named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def json_piece(df: DataFrame, column: str) -> Column:
    """A column as one element of a compact JSON array; null stays null."""
    c = F.col(column)
    inner = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def natural_hash(df: DataFrame, kind: str, columns: Sequence[str], name: str = "hash_natural") -> DataFrame:
    """SHA-256 of the compact JSON array [kind, columns...], UTF-8, nothing escaped that needn't be."""
    kind_json = '"' + kind.replace("\\", "\\\\").replace('"', '\\"') + '"'
    pieces = [F.lit(kind_json), *(json_piece(df, c) for c in columns)]
    return df.withColumn(name, F.sha2(F.concat(F.lit("["), F.concat_ws(",", *pieces), F.lit("]")), 256))


def ordinal(df: DataFrame, capture: Sequence[str], content: Sequence[str], position: str = "posicao", name: str = "ordinal") -> DataFrame:
    """Numbers equal rows of a capture from the oldest, which stands last in its list; new rows on top change no number."""
    w = W.partitionBy(*capture, *content).orderBy(F.col(position).desc())
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))


def event_hash(events: DataFrame, capture: Sequence[str], content: Sequence[str], position: str = "posicao") -> DataFrame:
    return natural_hash(ordinal(events, capture, content, position), "andamento", [*content, "ordinal"])


def upsert_seen(observations: DataFrame, key: str = "hash_natural", keep: Sequence[str] = (), full: Column | None = None) -> DataFrame:
    """One row a key: snapshot_first_seen, snapshot_last_seen, keep as first observed and posicao as last.

    full tells which observations come from a whole list; only these move the last sight and the position.
    """
    full = F.lit(True) if full is None else full
    at = F.struct("sid", "posicao")
    return observations.groupBy(key).agg(
        F.min("sid").alias("snapshot_first_seen"),
        F.coalesce(F.max(F.when(full, F.col("sid"))), F.min("sid")).alias("snapshot_last_seen"),
        F.coalesce(F.max_by("posicao", F.when(full, at)), F.min_by("posicao", at)).alias("posicao"),
        *(F.min_by(c, at).alias(c) for c in keep),
    )


def subset_flags(observations: DataFrame, key: str = "hash_natural", full_tab: str = "andamentos", flags: dict[str, str] | None = None) -> DataFrame:
    """For each key whether it was seen in each subset tab, and aba_origem, the tab that has it where the full list hasn't."""
    flags = flags or {"decisoes": "e_decisao", "pautas": "e_pauta", "recursos": "e_recurso"}
    seen = [F.max(F.col("aba") == tab).alias(name) for tab, name in flags.items()]
    only = F.when(~F.max(F.col("aba") == full_tab), F.min_by("aba", F.struct("sid", "aba")))
    return observations.groupBy(key).agg(*seen, only.alias("aba_origem"))


def dedup_snapshots(registry: DataFrame, keys: Sequence[str] = ("coleta_id", "aba", "url", "fetched_at"), order: str = "sid") -> DataFrame:
    """The first row of each key."""
    return registry.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def latest_header(headers: DataFrame, fields: Sequence[str], key: str = "incidente") -> DataFrame:
    """The latest header's fields, with the first and last sight."""
    last = F.max_by(F.struct(*fields), "sid").alias("h")
    return headers.groupBy(key).agg(last, F.min("sid").alias("snapshot_first_seen"), F.max("sid").alias("snapshot_last_seen"), F.min("fetched_at").alias("primeira_coleta"), F.max("fetched_at").alias("ultima_coleta")).select(key, "h.*", "snapshot_first_seen", "snapshot_last_seen", "primeira_coleta", "ultima_coleta")


def header_versions(headers: DataFrame, fields: Sequence[str], key: str = "incidente") -> DataFrame:
    """The different contents a header has had, each with the first capture that showed it."""
    hashed = natural_hash(headers, "cabecalho", fields, "hash")
    return hashed.groupBy(key, "hash").agg(F.min("sid").alias("snapshot_id"), F.min_by(F.struct(*fields), "sid").alias("campos"))


def last_value(c: str, order: str = "sid") -> Column:
    """The last value that isn't null."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)


def first_value(c: str, order: str = "sid") -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)


def merge_cases(sightings: DataFrame, last: Sequence[str] = ("incidente", "observacao"), first: Sequence[str] = ("profundidade",)) -> DataFrame:
    """One row a (classe, numero): `semente` if it ever was one, else `resolvido`, else the last status; other fields as named."""
    status = F.when(F.max(F.col("status") == "semente"), "semente").when(F.max(F.col("status") == "resolvido"), "resolvido").otherwise(F.max_by("status", "sid"))
    return sightings.groupBy("classe", "numero").agg(status.alias("status"), *map(last_value, last), *map(first_value, first))


def merge_documents(links: DataFrame) -> DataFrame:
    """One row a (endpoint, id_portal): first title, first sight."""
    return links.groupBy("endpoint", "id_portal").agg(first_value("titulo"), F.min("sid").alias("snapshot_first_seen"))


def event_documents(links: DataFrame) -> DataFrame:
    return links.select("hash_natural", "endpoint", "id_portal").distinct()


def fold_downloads(documents: DataFrame, downloads: DataFrame) -> DataFrame:
    """Documents with what their downloads say: last digest, path, capture, status, format; first time. Known from either side."""
    key = ["endpoint", "id_portal"]
    got = downloads.groupBy(*key).agg(last_value("sha256"), last_value("raw_path"), F.max_by("http_status", "sid").alias("status"), F.max("sid").alias("snapshot_id"), F.min(F.when(F.col("sha256").isNotNull(), F.col("fetched_at"))).alias("baixado_em"), last_value("formato_real"))
    return documents.join(got, key, "full_outer")


def event_type_dictionary(events: DataFrame) -> DataFrame:
    return events.groupBy("tipo").agg(first_value("explicacao_portal"), F.min("sid").alias("snapshot_first_seen"))


def merge_judgment_lists(lists: DataFrame) -> DataFrame:
    """One row a list hash, its first content and last sight."""
    own = [c for c in lists.columns if c not in ("hash", "sid", "votos")]
    return lists.groupBy("hash").agg(*(F.min_by(c, "sid").alias(c) for c in own), F.min("sid").alias("snapshot_first_seen"), F.max("sid").alias("snapshot_last_seen"))


def list_votes(lists: DataFrame) -> DataFrame:
    """Votes of judgment lists, the first sighting of each (hash, ordem, ministro)."""
    votes = lists.select("hash", "sid", F.explode("votos").alias("v")).select("hash", "sid", "v.*")
    return votes.withColumn("_n", F.row_number().over(W.partitionBy("hash", "ordem", "ministro").orderBy("sid"))).where("_n = 1").drop("_n", "sid")


def merge_bills(rows: DataFrame) -> DataFrame:
    """One row a (casa, codigo): its queries in the order first seen, last summary, last author and date, first and last sight."""
    met = rows.groupBy("casa", "codigo", "consulta").agg(F.min("sid").alias("first"))
    queries = met.groupBy("casa", "codigo").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "consulta"))), lambda x: x["consulta"]).alias("consultas"))
    out = rows.groupBy("casa", "codigo").agg(F.max_by("ementa", "sid").alias("ementa"), last_value("autor"), last_value("data"), F.min("sid").alias("snapshot_first_seen"), F.max("sid").alias("snapshot_last_seen"))
    return out.join(queries, ["casa", "codigo"])


def source_history(sources: DataFrame, captures: DataFrame) -> DataFrame:
    """Each source with its captures in order, the latest, the number of different contents and whether it changed."""
    one = F.struct("fetched_at", "sha256", "http_status")
    got = captures.groupBy("fonte_id").agg(F.sort_array(F.collect_list(one)).alias("historico"), F.max(one).alias("ultima"), F.count_distinct("sha256").alias("conteudos"))
    return sources.join(got, "fonte_id", "left").withColumns({"conteudos": F.coalesce("conteudos", F.lit(0)), "mudou": F.coalesce(F.col("conteudos") > 1, F.lit(False))})


def relations_table(relations: DataFrame) -> DataFrame:
    """The first sighting of each (incidente_origem, classe_destino, numero_destino, tipo)."""
    w = W.partitionBy("incidente_origem", "classe_destino", "numero_destino", "tipo").orderBy("sid", "posicao")
    return relations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def content_dedup(blobs: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """One row a digest: how many copies and the first path."""
    return blobs.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("sha256")).agg(F.min(path).alias(path), F.count("*").alias("copias"))
