"""Papers that arrive in batches become items, mentions and resolved entities; a batch that comes twice counts once.

The store is a log: a batch writes only its own partition and reads only earlier ones, so
writing it again gives the same. The graph is read from the log by merging.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalize_surface
from ..operators.analytics import keyword_entities
from ..operators.resolution import resolve_entities
from ..sources.papers import incremental_new_items

ITEMS, MENTIONS = "key string, text string", "key string, entity_type string, name string, confidence double"


def create_store(spark: SparkSession, store: str) -> None:
    """An empty log, unless there is one."""
    for table, schema in (("items", ITEMS), ("mentions", MENTIONS)):
        spark.createDataFrame([], schema).withColumn("batch_id", F.lit(-1).cast("long")).write.mode("append").partitionBy("batch_id").parquet(f"{store}/{table}")
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store}/{table}/batch_id=-1")


def read_log(spark: SparkSession, store: str, table: str) -> DataFrame:
    schema = {"items": ITEMS, "mentions": MENTIONS}[table]
    return spark.read.schema(f"{schema}, batch_id long").parquet(f"{store}/{table}")


def ingest_batch(batch: DataFrame, batch_id: int, store: str, patterns: DataFrame, cap: int = 10) -> None:
    """Writes a batch's new items (key, text) and the entities that ``patterns`` find in them.

    Items of earlier batches are left out; of equal keys in one batch the least text stays;
    items without a key are no items. Whatever this batch wrote before is replaced.
    """
    spark = batch.sparkSession
    earlier = read_log(spark, store, "items").filter(F.col("batch_id") < batch_id)
    one = batch.filter("key is not null").groupBy("key").agg(F.min("text").alias("text"))
    incremental_new_items(earlier, one, "key").select("key", "text").write.mode("overwrite").parquet(f"{store}/items/batch_id={batch_id}")
    new = spark.read.schema(ITEMS).parquet(f"{store}/items/batch_id={batch_id}")
    found = keyword_entities(new.withColumnRenamed("key", "doc_id"), patterns, cap).withColumnRenamed("doc_id", "key")
    found.select("key", "entity_type", "name", F.col("confidence").cast("double").alias("confidence")).write.mode("overwrite").parquet(f"{store}/mentions/batch_id={batch_id}")


def ingest_stream(items: DataFrame, store: str, patterns: Callable[[SparkSession], DataFrame], checkpoint: str, cap: int = 10):
    """Starts a query that ingests a stream of items (key, text) batch by batch until what is there now is done."""
    create_store(items.sparkSession, store)

    def apply(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, store, patterns(batch.sparkSession), cap)

    return items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_entities(spark: SparkSession, store: str, source: Column | None = None) -> DataFrame:
    """Entities of the whole log, resolved by type and surface form: (entity_type, canonical, name, confidence, alias_count, source_count, n_rows).

    Sources are items, or what ``source`` makes of their keys; nulls are none.
    """
    rows = read_log(spark, store, "mentions").withColumn("source_id", F.col("key") if source is None else source).drop("key").withColumn("canonical", normalize_surface(F.col("name")))
    return resolve_entities(rows)


def stored_relationships(spark: SparkSession, store: str) -> DataFrame:
    """(source_id, target_id, relationship_type, weight): pairs of resolved entities that items mention together, 1 for each item."""
    rows = read_log(spark, store, "mentions").select("key", F.concat_ws(":", "entity_type", normalize_surface(F.col("name"))).alias("entity")).distinct()
    pairs = rows.alias("a").join(rows.alias("b"), "key").filter("a.entity < b.entity")
    return pairs.groupBy(F.col("a.entity").alias("source_id"), F.col("b.entity").alias("target_id")).agg(F.count("*").cast("double").alias("weight")).withColumn("relationship_type", F.lit("CO_OCCURS_WITH"))


def compact(spark: SparkSession, store: str, target: str, upto: int) -> None:
    """Writes the log to ``target`` with all batches up to ``upto`` in one partition, that of batch ``upto``."""
    for table in ("items", "mentions"):
        log = read_log(spark, store, table)
        log.withColumn("batch_id", F.greatest("batch_id", F.lit(upto))).write.mode("overwrite").partitionBy("batch_id").parquet(f"{target}/{table}")
