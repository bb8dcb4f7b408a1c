"""The queries of the corpus operators, as (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.llm import chat, knn, licenses, lines, mixing, neardup, oracles, pieces, quality, shards, substrings
from simvane.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_fingerprint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digests(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_signals(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *(F.element_at("gram_chars", n).alias(f"gram_{n}_chars") for n in quality.GRAM_LIMITS))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken().drop("mark", "nth")


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op10_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("mark")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_fingerprint_runs, op3_quality_rules, op4_line_dedup, op5_voronoi_knn, op6_bounded_ring, op7_source_mix, op8_chat_snapshots, op9_sentencepiece, op10_sketch_neardup)}

_WORD = r"[^\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op2_fingerprint_runs": oracles.SUBSTRINGS,
    "op3_quality_rules": oracles.quality(quality.GRAM_LIMITS, quality.LINE_LIMIT, quality.MIN_WORDS),
    "op10_sketch_neardup": oracles.NEAR_DUPLICATES,
    "op4_line_dedup": rf"""
WITH ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), spoken AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS nr FROM ln WHERE regexp_matches(line, '{_WORD}')
), win AS (
  SELECT doc_id, nr, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM spoken WINDOW w AS (PARTITION BY doc_id ORDER BY nr)
), later AS (
  SELECT doc_id, nr FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, nr) AS nth FROM win WHERE c IS NOT NULL) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, nr + d AS nr FROM later, (SELECT unnest([0, 1, 2]) AS d)
), marked AS (
  SELECT ln.doc_id, ln.pos, ln.line, s.nr, g.nr AS gone FROM ln LEFT JOIN spoken s ON s.doc_id = ln.doc_id AND s.pos = ln.pos LEFT JOIN gone g ON g.doc_id = ln.doc_id AND g.nr = s.nr
), per AS (
  SELECT doc_id, count(nr) AS n_lines, count(gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '') AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256 FROM documents d LEFT JOIN per USING (doc_id)""",
    "op5_voronoi_knn": """
WITH u AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
), v AS (
  SELECT vec_id, i, floor(1024 * x::DOUBLE)::BIGINT AS x FROM u
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score FROM v a JOIN v b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1, 2
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op8_chat_snapshots": """
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nr FROM conversations
), p AS (
  SELECT conv_id, nr, count(*) OVER (PARTITION BY conv_id) AS total, list({'r': role, 'x': text}) OVER (PARTITION BY conv_id ORDER BY nr) AS said FROM t
), w AS (
  SELECT min(conv_id) AS conv_id, said, nr AS n_turns, count(*) AS n_copies FROM p WHERE nr = total GROUP BY said, nr
), k AS (
  SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.nr < p.total AND p.nr = w.n_turns AND p.said = w.said)
)
SELECT k.conv_id, k.n_turns, k.n_copies, string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.nr) AS rendered
FROM k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL""",
}
