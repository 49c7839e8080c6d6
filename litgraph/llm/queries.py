"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, html_extract, jaccard_join, language_id, license_scan, merkle_manifest, quality_rules, sentence_pieces, sharding, token_alignment, token_count
from .common import id_remainder, read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), n_shards=8)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    profiles = language_id.train(docs, ~held_out)
    return language_id.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    ensemble = quality_rules.train(docs, read(spark, sf_dir, "labels"), ~held_out)
    return quality_rules.score_quality(docs, ensemble).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read(spark, sf_dir, "embeddings"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.count_tokens(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.encode_decode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered).otherwise(F.col("text"))
    return merkle_manifest.verify(read(spark, sf_dir, "documents"), tampered)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_sharding, op3_decontamination, op4_bpe, op5_language_id, op6_html_extraction, op7_jaccard_join, op8_quality_rules, op9_embedding_dedup, op10_token_count, op11_token_alignment, op12_sentence_pieces, op13_merkle_manifest, pipeline)
}

#: Trees level by level, siblings gathered by level, folded by a reduction; CRC-32 from its table.
MERKLE_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t
),
docs AS (
  SELECT doc_id, source,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
      CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END) AS head,
    text,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 5 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS received
  FROM documents, crc_table
),
hashed AS (
  SELECT doc_id, source,
    sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    sha256(concat(head, CASE WHEN received IS NULL THEN '-' ELSE concat(strlen(received), ':', received) END)) AS received_leaf
  FROM docs
),
leaves AS (
  SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM hashed
),
nodes(source, level, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, level, pos // 16, n
),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
),
tops(level, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 16, n
),
steps AS (
  SELECT l.id, n.level, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < l.pos // (16 ** n.level)::BIGINT), '') AS lft,
    coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > l.pos // (16 ** n.level)::BIGINT), '') AS rgt
  FROM leaves l JOIN nodes n ON l.source IS NOT DISTINCT FROM n.source AND n.n > 1 AND n.pos // 16 = l.pos // (16 ** (n.level + 1))::BIGINT
  GROUP BY l.id, n.level
),
top_steps AS (
  SELECT s.source, 100 + t.level AS level, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (16 ** t.level)::BIGINT), '') AS lft,
    coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (16 ** t.level)::BIGINT), '') AS rgt
  FROM subroots s JOIN tops t ON t.n > 1 AND t.pos // 16 = s.pos // (16 ** (t.level + 1))::BIGINT
  GROUP BY s.source, t.level
),
paths AS (
  SELECT id, list(concat(lft, '|', rgt) ORDER BY level) AS steps, string_agg(concat(lft, rgt), '' ORDER BY level) AS proof
  FROM (SELECT * FROM steps UNION ALL SELECT l.id, t.level, t.lft, t.rgt FROM leaves l JOIN top_steps t ON l.source IS NOT DISTINCT FROM t.source) GROUP BY id
),
folded AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(l.received_leaf, coalesce(p.steps, [])), lambda h, s: sha256(concat(split_part(s, '|', 1), h, split_part(s, '|', 2)))) AS folded_root
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN paths p ON l.id = p.id
)
SELECT *, folded_root = root AS verified FROM folded
"""

#: The other operators are learned, fuzzy, random or vocabulary-driven, or too slow in SQL on
#: whole tables: they are tested against brute force and the libraries instead.
ORACLE_SQL: dict[str, str] = {"op13_merkle_manifest": MERKLE_SQL}
