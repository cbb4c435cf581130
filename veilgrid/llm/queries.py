"""The queries of this subpackage: each applies an operator to a whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm import chat_format, collocations, embedding_dedup, lm_scoring, mixing, packing, periodic_runs, quality_classifier, quality_rules, secrets, simhash, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_read(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.chat_digest(rows.union(extra))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_copies(_read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_read(spark, sf_dir, "pages"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_dedup.embedding_links(_read(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents")).drop("host_rate")


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(periodic_runs.with_planted_runs(_read(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_format": op3_chat_format,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_source_mixing": op5_source_mixing,
    "op6_warc": op6_warc,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_quality_rules": op8_quality_rules,
    "op9_bestfit_packing": op9_bestfit_packing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

def _control_pattern() -> str:
    return "\\\\|" + "|".join(re.escape(c) for c in chat_format.CONTROL)


_ESCAPES = f"len(regexp_extract_all({{}}, '{_control_pattern()}'))"
_WORDS = "[^\\x20\\x09-\\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat_format.TURN)} + {len(chat_format.END)} + 2 + length(role) + length(role) - length(replace(role, chr(10), '')) + {_ESCAPES.format("role")} + length(text) + {_ESCAPES.format("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g""",
    "op7_embedding_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.a = c.a""",
    "op8_quality_rules": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{_WORDS}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS ls FROM d),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
k AS (SELECT doc_id, list(i) AS l FROM (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM i) GROUP BY doc_id, k HAVING count(*) > 1),
m AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(x, x + 8)) AS p FROM (SELECT doc_id, unnest(l) AS x FROM k)) GROUP BY doc_id),
r AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN m ON m.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS b FROM f GROUP BY source),
a AS (SELECT sum(b) / sum(n) AS m, sum(n) AS total, count(*) AS k, sum(b * b / n) / sum(n) - (sum(b) / sum(n)) * (sum(b) / sum(n)) AS spread FROM h),
p AS (SELECT m, greatest(1.0, least(1000.0, 1 / greatest(CASE WHEN m * (1 - m) > 0 AND k / total < 1 THEN (spread / (m * (1 - m)) - k / total) / (1 - k / total) ELSE 0.0 END, 0.001) - 1)) AS q FROM a),
z AS (SELECT m, q, least(m + 3 * sqrt(m * (1 - m) / (q + 1)), (m + 1) / 2) AS lim FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ((h.b + z.m * z.q) / (h.n + z.q) > z.lim) AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, z""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(ws) >= k)),
c AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
d AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c q ON s.lang = q.lang AND q.k > s.k AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * q.f >= 100 * s.f),
x AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM c ANTI JOIN d USING (lang, phrase) WHERE k >= 2),
y AS (SELECT x.lang, x.phrase, cut, x.f AS a, l.f AS l, r.f AS r, t.n, (1000 * x.f * t.n) // (l.f * r.f) AS score FROM x JOIN t ON t.lang = x.lang
  JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z QUALIFY rank <= 2000""",
}
