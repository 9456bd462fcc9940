"""One query for each training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, contamination, html, langid, lines, merkle, mixing, neighbours, pii, quality, ranking, simhash, suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.scores(docs.withColumn("_out", langid.remainder(F.col("doc_id"), 7) == 2), "_out")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.remainder(F.col("doc_id"), 4)
    found = langid.identified(docs, docs.where(fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents"), stable=True)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_units", "n_removed", spans.alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), stable=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"), stable=True)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(ranking.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_quality, op3_mixing, op4_bpe, op5_langid, op6_lines, op7_contamination, op8_suffixes, op9_neighbours, op10_html, op11_merkle, op12_search, op13_pii)}


OP6 = r"""
WITH units AS (
  SELECT *, CASE WHEN form = '' THEN 0 ELSE len(string_split(form, ' ')) END >= 4 AS counts FROM (SELECT doc_id, u.i - 1 AS pos, u.unit, lower(trim(regexp_replace(u.unit, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS form
  FROM (SELECT doc_id, unnest(list_transform(string_split(regexp_replace(text, '([.!?]\s|\n)', '\1' || chr(57344), 'g'), chr(57344)), lambda x, i: {'unit': x, 'i': i})) AS u FROM documents))
), placed AS (
  SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins,
    row_number() OVER (PARTITION BY doc_id, counts ORDER BY pos) AS k, counts AND row_number() OVER (PARTITION BY form ORDER BY doc_id, pos) > 1 AS again
  FROM units
), runs AS (
  SELECT doc_id, min(pos) AS lo, max(pos) AS hi, count(*) AS n, min(begins) AS s, max(begins + length(unit)) AS e
  FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM placed WHERE again)
  GROUP BY doc_id, run HAVING sum(len(string_split(form, ' '))) >= 20
), gone AS (
  SELECT doc_id, sum(n)::BIGINT AS n_removed, string_agg(s || '-' || e, ',' ORDER BY lo) AS removed FROM runs GROUP BY 1
), kept AS (
  SELECT p.doc_id, count(*) FILTER (counts) AS n_units,
    string_agg(unit, '' ORDER BY pos) FILTER (r.lo IS NULL) AS text
  FROM placed p LEFT JOIN runs r ON r.doc_id = p.doc_id AND p.pos BETWEEN r.lo AND r.hi GROUP BY 1
)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
"""


#: A document's fields as its digest takes them, and CRC-32 of the decimal id, bit by bit.
_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_TEXTS = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars", "text")]
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in _TEXTS) + ")"
_RAISED = _LEAF.replace("n_chars::VARCHAR", "(n_chars + 1)::VARCHAR")
_CRC = "xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"

OP11 = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_RAISED} END AS other FROM documents)
), own AS (
  SELECT lang, 0 AS lev, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM own WHERE n > 1 GROUP BY lang, lev, n, pos // 2
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1
), upper AS (
  SELECT 0 AS lev, pos, n, h FROM subroots
  UNION ALL SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lev, n, pos // 2
), steps AS (
  SELECT l.lang, l.pos, m.lev, CASE WHEN k.h IS NULL THEN '=' WHEN k.pos < m.pos THEN '<' ELSE '>' END AS turn, coalesce(k.h, '') AS kin
  FROM leaves l JOIN own m ON m.lang IS NOT DISTINCT FROM l.lang AND m.pos = l.pos >> m.lev AND m.n > 1
  LEFT JOIN own k ON k.lang IS NOT DISTINCT FROM m.lang AND k.lev = m.lev AND k.pos = xor(m.pos, 1)
  UNION ALL
  SELECT l.lang, l.pos, 100 + m.lev, CASE WHEN k.h IS NULL THEN '=' WHEN k.pos < m.pos THEN '<' ELSE '>' END, coalesce(k.h, '')
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN upper m ON m.pos = s.pos >> m.lev AND m.n > 1
  LEFT JOIN upper k ON k.lev = m.lev AND k.pos = xor(m.pos, 1)
), paths AS (
  SELECT lang, pos, string_agg(kin, '' ORDER BY lev) AS kin, list(turn || kin ORDER BY lev) AS turns FROM steps GROUP BY 1, 2
)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.kin, '')) AS proof_sha256,
  list_reduce([coalesce(l.other, l.leaf)] || coalesce(p.turns, []), lambda a, x: CASE x[1] WHEN '<' THEN sha256(x[2:] || a) WHEN '>' THEN sha256(a || x[2:]) ELSE sha256(a) END) AS folded_root,
  folded_root = r.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN upper r ON r.n = 1
LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
"""


_WORDS = r"""list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY term, n_docs),
q AS (SELECT r AS q, item_id, term, count(*) AS n FROM (SELECT item_id, row_number() OVER () AS r, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT q, item_id, r, doc_id, sum(n * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (r), g GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_lines": OP6, "op11_merkle": OP11, "op12_search": OP12}
