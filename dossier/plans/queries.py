"""The operators over the test tables: each query says which table plays which role."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import diff, filters, flows, graph, postings, reports, search, seen
from dossier.plans import chronology
from dossier.sources.shared import folder, spread

# A short rule list for the test tables' event types.
RULES = [("peticao", ["^SIGNUP"]), ("decisao", ["^PURCHASE"]), ("tramitacao", ["^CLICK", "^VIEW"])]
RULES_SQL = "CASE WHEN event_type LIKE 'signup%' THEN 'peticao' WHEN event_type LIKE 'purchase%' THEN 'decisao' WHEN event_type LIKE 'click%' OR event_type LIKE 'view%' THEN 'tramitacao' ELSE 'outro' END"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Events as docket events of a user's case, each seen by the captures of three days."""
    e = t(spark, d, "events").select("event_id", F.col("user_id").alias("incidente"), F.to_date("ts").alias("data"), F.col("event_type").alias("tipo"), F.col("props").alias("descricao"))
    return e.withColumn("sid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.unix_date("data") + k).cast("bigint")))).withColumn("posicao", F.col("event_id").cast("int"))


OBS = "SELECT event_id, user_id AS incidente, ts::DATE AS data, event_type AS tipo, props AS descricao, (ts::DATE - DATE '1970-01-01')::BIGINT + k AS sid, event_id AS posicao FROM events, (SELECT unnest([0, 1, 2]) AS k)"


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """The unified timeline: first and last sight of each event, its category, in order."""
    obs = seen.natural_hash(observations(spark, d), "andamento", ["incidente", "tipo", "descricao"])
    folded = seen.upsert_seen(obs, keep=("incidente", "data", "tipo", "descricao"))
    return chronology.unified_timeline(folded, RULES).select("incidente", "data", "tipo", "descricao", "categoria", "posicao", "snapshot_first_seen", "snapshot_last_seen")


def k1_hash(spark: SparkSession, d: str) -> DataFrame:
    return seen.natural_hash(t(spark, d, "nation"), "nation", ["n_name", "n_regionkey"]).select("n_nationkey", "hash_natural")


def k2_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return seen.ordinal(t(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"], "l_linenumber").select("l_orderkey", "l_linenumber", "ordinal")


def k3_seen(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d).withColumn("k", F.concat_ws("|", F.col("incidente").cast("string"), "tipo", "descricao"))
    return seen.upsert_seen(obs, key="k").select("k", "snapshot_first_seen", "snapshot_last_seen", F.col("posicao").cast("bigint").alias("posicao"))


def k5_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return seen.dedup_snapshots(t(spark, d, "events"), keys=("user_id", "event_type"), order="event_id").select("user_id", "event_type", "event_id")


def k6_headers(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("incidente"), "o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("sid"), F.to_date("o_orderdate").alias("fetched_at"))
    return seen.latest_header(o, ["o_orderstatus", "o_orderpriority"])


def k7_versions(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("incidente"), "o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("sid"))
    return seen.header_versions(o, ["o_orderstatus", "o_orderpriority"]).select("incidente", "snapshot_id", "campos.o_orderstatus", "campos.o_orderpriority")


def k16_content(spark: SparkSession, d: str) -> DataFrame:
    return seen.content_dedup(t(spark, d, "documents"), "text", "doc_id")


def d1_diff(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select(F.col("user_id").alias("incidente"), F.date_format("ts", "yyyy-MM-dd").alias("coleta_id"), F.lit("andamentos").alias("lista"), F.concat_ws("|", "event_type", "props").alias("hash_natural")).distinct()
    items = e.withColumn("item", F.col("hash_natural")).withColumn("posicao", F.lit(0))
    pairs = diff.previous_run(e.select("incidente", "coleta_id").distinct())
    return diff.diff_runs(pairs, items).select("incidente", "anterior", "coleta_id", "efeito", "item")


def d6_integrity(spark: SparkSession, d: str) -> DataFrame:
    refs = t(spark, d, "documents").select(F.col("doc_id").alias("raw_path"), F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha256"))
    blobs = t(spark, d, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return diff.verify_blobs(refs, blobs).groupBy("estado").agg(F.count("*").alias("n"))


def n1_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The SQL's upper case goes letter by letter, so ß has one capital there, not two."""
    return t(spark, d, "documents").where("lang = 'fr'").select("doc_id", text.normalize_name(F.translate(F.substring("text", 1, 60), "ß", "ẞ")).alias("nome"))


def n1_texts(spark: SparkSession, d: str) -> DataFrame:
    """n1_normalize on the whole texts of all documents."""
    return t(spark, d, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("nome"))


def n7_rules(spark: SparkSession, d: str) -> DataFrame:
    kind = text.classify_first_match(text.normalize_name(F.col("p_type")), [("metal", ["STEEL", "BRASS"]), ("outro_metal", ["COPPER|TIN|NICKEL"])], "outro")
    return t(spark, d, "part").groupBy(kind.alias("grupo")).agg(F.count("*").alias("n"))


def n12_phones(spark: SparkSession, d: str) -> DataFrame:
    digits = F.concat(F.lit("tel "), F.lpad(F.col("o_orderkey").cast("string"), 11, "5"), F.lit(" fim"))
    return t(spark, d, "orders").select("o_orderkey", text.mask_phone(digits).alias("texto"))


def a9_values(spark: SparkSession, d: str) -> DataFrame:
    return reports.value_counts(t(spark, d, "orders"), "o_orderpriority")


def a7_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = t(spark, d, "customer").select(F.col("c_custkey").alias("incidente"))
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("incidente"), F.to_date("o_orderdate").alias("fetched_at"))
    return reports.case_counts(cases, {"pedidos": o}, o)


def w5_counterparties(spark: SparkSession, d: str) -> DataFrame:
    return flows.top_counterparties(money(spark, d)).select("ator", "sentido", F.inline("lista")).select("ator", "sentido", "r", "outro", "centavos")


def money(spark: SparkSession, d: str) -> DataFrame:
    """Line items as flows: the customer's nation pays the supplier's, R is a summary, F is paid."""
    l = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    l = l.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return l.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tx_id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("origem"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("destino"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("centavos"),
        F.when(F.col("l_returnflag") == "R", flows.SUMMARY).otherwise("individual").alias("natureza"),
        F.when(F.col("l_linestatus") == "F", "efetuado").otherwise("previsto").alias("situacao"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("data"),
        F.lit(None).cast("string").alias("periodo_inicio"),
        F.col("l_returnflag").alias("tipo"),
        F.col("l_linestatus").alias("secao"),
    )


MONEY = """SELECT 'n' || c_nationkey AS origem, 'n' || s_nationkey AS destino, round(l_extendedprice * 100)::BIGINT AS centavos,
  CASE WHEN l_returnflag = 'R' THEN 'resumo_tipo' ELSE 'individual' END AS natureza, CASE WHEN l_linestatus = 'F' THEN 'efetuado' ELSE 'previsto' END AS situacao,
  strftime(l_shipdate, '%Y') AS ano FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""
COUNTED = "situacao = 'efetuado' AND natureza <> 'resumo_tipo'"


def m4_totals(spark: SparkSession, d: str) -> DataFrame:
    return flows.actor_totals(money(spark, d))


def m5_edges(spark: SparkSession, d: str) -> DataFrame:
    return flows.flow_edges(money(spark, d)).select("origem", "destino", "centavos", "n")


def t2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return flows.top_pairs(money(spark, d))


def f5_flows(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_flows(money(spark, d), ano="1996", status="efetuado").groupBy("origem").agg(F.count("*").alias("n"), F.sum("centavos").alias("centavos"))


def g6_cocitation(spark: SparkSession, d: str) -> DataFrame:
    l = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("assercao_id"), F.col("l_suppkey").alias("s"))
    links = spread(l, l.count(), "assercao_id").distinct().select("assercao_id", F.concat(F.lit("s"), F.col("s").cast("string")).alias("chave"))
    names = links.select("chave").distinct().withColumn("tipo", F.lit("parte"))
    return graph.cocitation_edges(links, names).select("origem", "destino", "n")


def g9_distance(spark: SparkSession, d: str) -> DataFrame:
    l = t(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s"))
    l = spread(l, l.count(), "l_orderkey").distinct()
    edges = l.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("origem"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("destino"))
    return graph.seed_distance(edges, spark.createDataFrame([("s1",)], "id string"))


def x7_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages from a table of postings that two appends have filled."""
    pages = t(spark, d, "documents").select(F.col("doc_id").alias("documento_id"), F.lit(1).alias("pagina"), F.col("text").alias("texto"))
    found = postings.Postings(spark, folder(spark, "postings"))
    for half in (0, 1):
        found.append(pages.where(F.pmod("documento_id", F.lit(2)) == half), F.col("texto"))
    return found.pages("queen pour elle", 20).select("documento_id", F.round("relevancia", 6).alias("relevancia"))


def f2_terms(spark: SparkSession, d: str) -> DataFrame:
    return filters.matches_all_terms(t(spark, d, "documents"), "the reré", ["text"]).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (timeline, k1_hash, k2_ordinal, k3_seen, k5_snapshots, k6_headers, k7_versions, k16_content, d1_diff, d6_integrity, n1_normalize, n1_texts, n7_rules, n12_phones, a9_values, a7_cases, w5_counterparties, m4_totals, m5_edges, t2_pairs, f5_flows, g6_cocitation, g9_distance, x7_pages, f2_terms)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    ends = f"SELECT origem AS ator, 0 AS e, centavos AS s FROM m WHERE {COUNTED} UNION ALL SELECT destino, centavos, 0 FROM m WHERE {COUNTED}"
    pairs = f"SELECT origem, destino, sum(centavos)::BIGINT AS centavos, count(*) AS n FROM m WHERE {COUNTED} GROUP BY ALL"
    day = "SELECT DISTINCT user_id AS incidente, strftime(ts, '%Y-%m-%d') AS c, event_type || '|' || props AS item FROM events"
    return {
        "timeline": f"WITH o AS ({OBS}) SELECT incidente, arg_min(data, (sid, posicao)) AS data, tipo, descricao, {RULES_SQL.replace('event_type', 'tipo')} AS categoria, arg_max(posicao, (sid, posicao))::INT AS posicao, min(sid) AS snapshot_first_seen, max(sid) AS snapshot_last_seen FROM o GROUP BY incidente, tipo, descricao",
        "k1_hash": """SELECT n_nationkey, sha256('["nation","' || n_name || '",' || n_regionkey || ']') AS hash_natural FROM nation""",
        "k2_ordinal": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber DESC) - 1 AS ordinal FROM lineitem",
        "k3_seen": f"WITH o AS ({OBS}) SELECT incidente || '|' || tipo || '|' || descricao AS k, min(sid) AS snapshot_first_seen, max(sid) AS snapshot_last_seen, arg_max(posicao, (sid, posicao)) AS posicao FROM o GROUP BY 1",
        "k5_snapshots": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
        "k6_headers": "SELECT o_custkey AS incidente, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, min(o_orderkey) AS snapshot_first_seen, max(o_orderkey) AS snapshot_last_seen, min(o_orderdate)::DATE AS primeira_coleta, max(o_orderdate)::DATE AS ultima_coleta FROM orders GROUP BY 1",
        "k7_versions": "SELECT o_custkey AS incidente, min(o_orderkey) AS snapshot_id, o_orderstatus, o_orderpriority FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority",
        "k16_content": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copias FROM documents GROUP BY 1",
        "d1_diff": f"WITH e AS ({day}), r AS (SELECT incidente, c, lag(c) OVER (PARTITION BY incidente ORDER BY c) AS a FROM (SELECT DISTINCT incidente, c FROM e)) "
        "SELECT incidente, a AS anterior, c AS coleta_id, 'apareceu' AS efeito, item FROM r JOIN e USING (incidente, c) WHERE a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e f WHERE f.incidente = r.incidente AND f.c = r.a AND f.item = e.item) "
        "UNION ALL SELECT r.incidente, r.a, r.c, 'sumiu', e.item FROM r JOIN e ON e.incidente = r.incidente AND e.c = r.a WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.incidente = r.incidente AND f.c = r.c AND f.item = e.item)",
        "d6_integrity": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'ausente' WHEN doc_id % 10 = 0 THEN 'divergente' ELSE 'ok' END AS estado, count(*) AS n FROM documents GROUP BY 1",
        "n1_normalize": "SELECT doc_id, upper(strip_accents(trim(regexp_replace(left(text, 60), '\\s+', ' ', 'g')))) AS nome FROM documents WHERE lang = 'fr'",
        "n7_rules": "SELECT CASE WHEN regexp_matches(upper(p_type), 'STEEL|BRASS') THEN 'metal' WHEN regexp_matches(upper(p_type), 'COPPER|TIN|NICKEL') THEN 'outro_metal' ELSE 'outro' END AS grupo, count(*) AS n FROM part GROUP BY 1",
        "n12_phones": "SELECT o_orderkey, 'tel ' || left(lpad(o_orderkey::VARCHAR, 11, '5'), 4) || repeat('•', 7) || ' fim' AS texto FROM orders",
        "a9_values": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
        "a7_cases": "SELECT c_custkey AS incidente, count(o_orderkey) AS pedidos, max(o_orderdate)::DATE AS ultima_coleta, count(o_orderkey) > 0 AS coletado FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
        "w5_counterparties": f"WITH m AS ({MONEY}), p AS ({pairs}), b AS (SELECT origem AS ator, 'pagou' AS sentido, destino AS outro, centavos FROM p WHERE origem <> destino UNION ALL SELECT destino, 'recebeu', origem, centavos FROM p WHERE origem <> destino) SELECT ator, sentido, row_number() OVER (PARTITION BY ator, sentido ORDER BY centavos DESC, outro)::INT AS r, outro, centavos FROM b QUALIFY r <= 3",
        "m4_totals": f"WITH m AS ({MONEY}) SELECT ator, sum(e)::BIGINT AS entrada, sum(s)::BIGINT AS saida, count(*) AS n_transacoes FROM ({ends}) GROUP BY 1",
        "m5_edges": f"WITH m AS ({MONEY}) {pairs}",
        "t2_pairs": f"WITH m AS ({MONEY}) SELECT origem, destino, sum(centavos)::BIGINT AS centavos, count(*) AS n FROM m WHERE natureza <> 'resumo_tipo' GROUP BY ALL ORDER BY centavos DESC, origem, destino LIMIT 15",
        "f5_flows": f"WITH m AS ({MONEY}) SELECT origem, count(*) AS n, sum(centavos)::BIGINT AS centavos FROM m WHERE natureza <> 'resumo_tipo' AND ano = '1996' AND situacao = 'efetuado' GROUP BY 1",
        "f2_terms": "SELECT doc_id FROM documents WHERE contains(upper(strip_accents(text)), 'THE') AND contains(upper(strip_accents(text)), 'RERE')",
        "g9_distance": "WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'o' || l_orderkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), s AS (SELECT 's1' AS id, 0 AS k UNION SELECT u.b, s.k + 1 FROM s JOIN u ON u.a = s.id WHERE s.k < 6) SELECT id, min(k) AS distancia FROM s GROUP BY 1",
        "x7_pages": r"WITH t AS (SELECT doc_id, list_filter(string_split_regex(upper(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents), n AS (SELECT count(*) AS pages, avg(len(t)) AS mean FROM t), q AS (SELECT unnest(['QUEEN', 'POUR', 'ELLE']) AS q), f AS (SELECT doc_id, len(t) AS n, q, len(list_filter(t, lambda x: x = q)) AS tf FROM t, q), h AS (SELECT * FROM f WHERE tf > 0), d AS (SELECT q, count(*) AS df FROM h GROUP BY 1) SELECT doc_id AS documento_id, round(sum(ln(1 + (pages - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS relevancia FROM h JOIN d USING (q), n GROUP BY 1 ORDER BY sum(ln(1 + (pages - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) DESC, 1 LIMIT 20",
        "g6_cocitation": "WITH l AS (SELECT DISTINCT l_orderkey AS o, 's' || l_suppkey AS k FROM lineitem) SELECT 'entidade:' || a.k AS origem, 'entidade:' || b.k AS destino, count(*) AS n FROM l a JOIN l b ON a.o = b.o AND a.k < b.k GROUP BY ALL",
    }
