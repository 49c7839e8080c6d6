"""Duplicate entities become one: properties are merged, edges repointed, equal edges dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import durable


def canonical_ids(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(id, canonical_id) of every entity: the earliest by (created, id) of those with equal ``keys``; by a combined minimum, so a key of any size is no single task."""
    first = entities.groupBy(*keys).agg(F.min_by("id", F.struct("created", "id")).alias("canonical_id"))
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return entities.alias("e").join(first.alias("f"), on).select("e.id", "canonical_id")


def merge_duplicates(entities: DataFrame, edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) after entities with equal ``keys`` are merged into the earliest.

    ``entities`` has id, created, properties (map) and the keys, ``edges`` id, created,
    source_id, target_id, relationship_type and more. A canonical entity has the properties of
    all its duplicates, of one name the value of the latest by (created, id). Edges follow
    their ends; of those that are then equal the earliest by (created, id) stays, with its
    other columns. Ends that are no entity stay as they are; loops stay.
    """
    mapping = durable(canonical_ids(entities, keys))
    moved = entities.join(mapping, "id")
    pairs = moved.select("canonical_id", "created", "id", F.explode("properties").alias("name", "value"))
    latest = pairs.groupBy("canonical_id", "name").agg(F.max_by("value", F.struct("created", "id")).alias("value"))
    merged = latest.groupBy("canonical_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_merged"))  # one entity's own names
    kept = moved.filter("id = canonical_id").drop("canonical_id").join(merged, F.col("id") == F.col("canonical_id"), "left").drop("canonical_id")
    kept = kept.withColumn("properties", F.coalesce("_merged", "properties")).drop("_merged").select(*entities.columns)
    changed = mapping.filter("id <> canonical_id")
    end = lambda c: changed.select(F.col("id").alias(c), F.col("canonical_id").alias(f"_{c}"))
    rows = edges.join(end("source_id"), "source_id", "left").join(end("target_id"), "target_id", "left")
    rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("source_id", "target_id")}).select(*edges.columns)
    rest = [c for c in edges.columns if c not in ("source_id", "target_id", "relationship_type")]
    first = rows.groupBy("source_id", "target_id", "relationship_type").agg(F.min_by(F.struct(*rest), F.struct("created", "id")).alias("_first"))
    return kept, first.select("source_id", "target_id", "relationship_type", "_first.*").select(*edges.columns)
