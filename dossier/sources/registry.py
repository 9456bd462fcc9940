"""Capture registries, raw blobs and archives as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import extract
from dossier.operators.order import placed

REGISTRY = (
    "coleta_id string, incidente bigint, aba string, url string, url_final string, fetched_at timestamp, http_status int, "
    "sha256 string, bytes bigint, raw_path string, content_type string, user_agent string, erro string, redirects array<array<string>>, "
    "classe string, numero bigint, profundidade int, incidente_resolvido bigint, endpoint string, id_portal string, "
    "formato_real string, titulo string, status string"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All JSON lines under path with sid, the rank by run id and place in the file; blank lines don't count."""
    lines = spark.read.text(path).select(F.input_file_name().alias("arquivo"), F.monotonically_increasing_id().alias("linha"), "value")
    rows = lines.where(F.trim("value") != "").select("arquivo", "linha", F.from_json("value", REGISTRY).alias("r")).select("arquivo", "linha", "r.*")
    return with_sid(rows, ["arquivo", "linha"])


def with_sid(rows: DataFrame, line: list[str]) -> DataFrame:
    """sid: the run's rank among runs in the upper half, the line's rank in its run in the lower; neither is a sort in one task."""
    rank = placed(rows.select("coleta_id").distinct(), [], ["coleta_id"], "_run")
    own = placed(rows, ["coleta_id"], line, "_line")
    return own.join(rank, "coleta_id").withColumn("sid", (F.col("_run") + 1) * F.lit(1 << 32) + F.col("_line") + 1).drop("_run", "_line")


def run_kind(coleta_id) -> F.col:
    full, stamp = r"^\d{8}T\d{6}Z-\d+$", r"^\d{8}T\d{6}Z-"
    return F.when(coleta_id.rlike(full), "completa").when(coleta_id.rlike(stamp + "resolucoes-"), "resolucoes").when(coleta_id.rlike(stamp + "documentos-"), "documentos").when(coleta_id.rlike(stamp + "sessao-"), "sessao").otherwise("outra")


def classify_runs(registry: DataFrame) -> DataFrame:
    """One row a run: tipo, the case of a full run, number of lines. A full run with several cases is an error."""
    runs = registry.groupBy("coleta_id").agg(F.count_distinct("incidente").alias("casos"), F.min("incidente").alias("incidente"), F.count("*").alias("linhas"))
    kind = run_kind(F.col("coleta_id"))
    several = (kind == "completa") & (F.col("casos") > 1)
    checked = F.when(several, F.raise_error(F.concat(F.lit("run with several cases: "), F.col("coleta_id"))).cast("string")).otherwise(kind)
    return runs.select("coleta_id", checked.alias("tipo"), F.when(kind == "completa", F.col("incidente")).alias("incidente"), "linhas")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files with content and digest."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def first_ok_per_tab(registry: DataFrame) -> DataFrame:
    """The first capture with status 200 of each run and tab."""
    w = W.partitionBy("coleta_id", "aba").orderBy("sid")
    return registry.where("http_status = 200").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def register_archive(files: DataFrame) -> DataFrame:
    """Documents of unpacked bundles (path, content, acervo if there are several): folder/NNNNN title_hash8.pdf or .rtf; other files are
    left out. Of a bundle's files with the same folder, number and hash the first counts; bundles number their files by themselves."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    pattern = r"(?i)^(\d{5}) (.+)_([0-9a-f]{8})\.(pdf|rtf)$"
    got = files.where(name.rlike(pattern))
    part = lambda i: F.regexp_extract(name, pattern, i)
    bundle = ["acervo"] if "acervo" in files.columns else []
    rows = got.select(F.concat(folder, F.lit("/"), part(1), F.lit("_"), part(3)).alias("id_portal"), part(2).alias("titulo"), F.lower(part(4)).alias("formato"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("bytes"), "path", *bundle)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*bundle, "id_portal").orderBy("path"))).where("_n = 1").drop("_n", "path", *bundle)


def recently_captured(registry: DataFrame, now, max_age_hours: int = 12) -> DataFrame:
    """Cases whose header was captured without error within the last hours."""
    last = registry.where("aba = 'casca' and http_status = 200").groupBy("incidente").agg(F.max("fetched_at").alias("ultima"))
    return last.where(F.col("ultima") >= now - F.expr(f"interval {max_age_hours} hours"))


def hash8(path) -> F.col:
    return extract(path, r"_([0-9a-f]{8})\.")
