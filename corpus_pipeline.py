"""Corpus pipeline: language, quality, near-duplicates, benchmark leaks, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgraph.llm import bpe, decontaminate, jaccard_join, language_id, quality_rules
from litgraph.llm.common import id_remainder, key_map, read, shared_folder
from litgraph.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder of checkpoints and read again."""
    path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters (``und``): nulls, empty texts and texts of other characters.

    Repeated rows and rows with null ids are judged by their texts like any others; an empty
    table gives an empty one; other columns are not kept.
    """
    profiles = language_id.train(docs, id_remainder(F.col("doc_id"), 3) != 1)
    found = language_id.identify(docs, profiles, keep=tuple(COLUMNS[1:]))
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is under the threshold; null and empty texts have a score like any other.

    Equal texts get equal decisions whatever their ids. Labels without id, text or quality
    teach nothing; without any labels the score is the same for all. An empty table gives an
    empty one; other columns are not kept.
    """
    ensemble = quality_rules.train(docs, read(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0)
    return quality_rules.score_quality(docs, ensemble, keep=tuple(COLUMNS[1:])).filter("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, of those with the smallest id the one with the least digests, and all rows without words.

    Rows are linked by id and text digests, as ids may be null or repeat; of rows equal in
    both one stays. Only rows that may have to go, by a bit map of their keys, are joined to
    the links; the other texts are not shuffled.
    """
    none = F.lit(0).cast(docs.schema["doc_id"].dataType)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", none).alias("id"), F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"))
    # a component is named by its least key
    linked = jaccard_join.link(docs.select(key.alias("key"), "text"), id_col="key").filter("n_shingles > 0")
    known = linked.groupBy("key").agg(F.min("component_id").alias("kept"), F.count("*").alias("n")).filter("key <> kept or n > 1")
    known = stored(spark, known.select(F.xxhash64("key").alias("hash"), "key", (F.col("key") != F.col("kept")).alias("gone")), "known")
    at_stake = key_map(known, "hash")
    rows = docs.select(*COLUMNS).withColumn("key", key)
    rows = rows.withColumn("maybe", at_stake.column(F.xxhash64("key")))
    judged = rows.filter("maybe").join(known.select("key", "gone"), "key", "left").filter("gone is null or not gone")
    one = F.when(F.col("gone").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    judged = judged.withColumn("one", one).dropDuplicates(["key", "one"])
    return rows.filter("not maybe").select(*COLUMNS).union(judged.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of the benchmark; null and empty texts hold none.

    Repeated rows and null ids are judged like any others; an empty benchmark rejects
    nothing; an empty table gives an empty one; other columns are not kept.
    """
    leaks = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS[1:]))
    return leaks.filter(F.size("spans") == 0).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document: (doc_id, n_tokens, ids_sha256, decoded_sha256); null texts count as empty.

    Repeated rows give repeated results, null ids stay null, an empty table gives none.
    """
    return bpe.digests(bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: Learned stages have no SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(spark, docs, name)
    return docs
