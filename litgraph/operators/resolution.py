"""Entity resolution: names to canonical names, candidate pairs to alias clusters, merged rows and edges.

Aliases and sources stay in rows of their own; a hub's are counted, never gathered into a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .analytics import acronym_definition
from .graph import connected_components
from .relational import spread

#: A long form followed by its acronym in parentheses (fixed value).
ACRONYM = r"^\s*([^()]+?)\s*\(([A-Za-z][A-Za-z0-9.-]{1,15})\)\s*$"


def learn_acronyms(names: DataFrame, name_col: str = "name", order_col: str = "id") -> DataFrame:
    """(acronym, long_form) of names such as ``Long Form (LF)``, where LF are the initials or the start of a single word; the last in ``order_col`` wins."""
    name = F.col(name_col)
    found = names.filter(acronym_definition(name).isNotNull()).select(
        S.acronym_key(F.regexp_extract(name, ACRONYM, 2)).alias("acronym"),
        S.normalize_surface(F.regexp_extract(name, ACRONYM, 1)).alias("long_form"),
        F.col(order_col).alias("_order"),
    )
    return found.groupBy("acronym").agg(F.max_by("long_form", F.struct("_order", "long_form")).alias("long_form"))


def canonicalize_names(names: DataFrame, acronyms: DataFrame, name_col: str = "name") -> DataFrame:
    """Adds ``canonical``: the surface form, or the long form if the name is a known acronym or ends in one."""
    name = F.col(name_col)
    own = F.when(acronym_definition(name).isNotNull(), F.regexp_extract(name, ACRONYM, 1)).otherwise(name)
    rows = names.withColumn("_surface", S.normalize_surface(own)).withColumn("_key", S.acronym_key(own))
    known = acronyms.select(F.col("acronym").alias("_key"), "long_form")
    out = rows.join(known, "_key", "left").withColumn("canonical", F.coalesce("long_form", "_surface"))
    return out.select(*names.columns, "canonical")


def resolve_entities(rows: DataFrame, keys: tuple[str, ...] = ("entity_type", "canonical")) -> DataFrame:
    """One row for each key: the most confident name, and how many names and sources it has.

    ``rows`` has the keys, name, confidence and source_id. Ties go to the last name.
    """
    # a source's rows meet in one task of many, where its first is marked; then only names are left
    of_source = Window.partitionBy(*keys, "source_id")
    each = spread(rows.select(*keys, "name", "confidence", "source_id"), *keys, "source_id").groupBy(*keys, "source_id", "name").agg(F.max("confidence").alias("confidence"), F.count("*").alias("_n"))
    first = (F.row_number().over(of_source.orderBy("name")) == 1) & F.col("source_id").isNotNull()
    named = each.withColumn("_first", first.cast("long")).groupBy(*keys, "name").agg(F.max("confidence").alias("confidence"), F.sum("_n").alias("_n"), F.sum("_first").alias("_sources"))
    best = F.max_by("name", F.struct("confidence", "name"))
    return named.groupBy(*keys).agg(
        best.alias("name"), F.max("confidence").alias("confidence"), F.count("name").alias("alias_count"), F.sum("_sources").alias("source_count"), F.sum("_n").alias("n_rows")
    )


def resolution_members(rows: DataFrame, keys: tuple[str, ...] = ("entity_type", "canonical")) -> DataFrame:
    """(keys, name, source_id) of what was resolved, distinct."""
    return rows.select(*keys, "name", "source_id").distinct()


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """One row: raw rows, resolved entities, merged ones and their share (0 without rows)."""
    raw, n = F.coalesce(F.sum("n_rows"), F.lit(0)), F.count("*")
    rate = F.when(raw == 0, 0.0).otherwise((raw - n) / raw)
    return resolved.agg(raw.alias("raw"), n.alias("resolved"), (raw - n).alias("merged"), rate.alias("merge_rate"))


def union_candidates(*pairs: DataFrame) -> DataFrame:
    """The best score of each unordered pair of frames (id1, id2, score)."""
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    ordered = out.filter("id1 <> id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "score")
    return ordered.groupBy("id1", "id2").agg(F.max("score").alias("score"))


def alias_clusters(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(id, canonical_id) for every id in ``pairs``: the member with most uses, then confidence, then length of name, then id.

    ``names`` has id, name, uses and confidence.
    """
    edges = pairs.select(F.col("id1").alias("source_id"), F.col("id2").alias("target_id"), F.lit("SAME_AS").alias("relationship_type"), F.lit(1.0).alias("weight"))
    members = connected_components(edges).join(names, "id")
    best = members.groupBy("component").agg(F.max_by("id", F.struct("uses", "confidence", F.length("name"), "id")).alias("canonical_id"))
    return members.join(best, "component").select("id", "canonical_id")


def false_merge_audit(confirmed: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` confirmed pairs (id1, id2, score) that are least alike."""
    return confirmed.orderBy("score", "id1", "id2").limit(k)


def disambiguate_by_synonym(rows: DataFrame, synonyms: DataFrame) -> DataFrame:
    """One row for each lower-case name after ``synonyms`` (name, preferred): best confidence and number of sources."""
    lower = rows.withColumn("_name", F.lower("name"))
    known = synonyms.select(F.lower("name").alias("_name"), F.lower("preferred").alias("_preferred"))
    named = lower.join(known, "_name", "left").withColumn("canonical", F.coalesce("_preferred", "_name"))
    return named.groupBy("canonical").agg(F.max("confidence").alias("confidence"), F.countDistinct("source_id").alias("source_count"))


def merge_concepts(relationships: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends repointed by ``mapping`` (id, canonical_id); loops that this makes go, of equal edges the heaviest stays."""
    source = mapping.select(F.col("id").alias("source_id"), F.col("canonical_id").alias("_source"))
    target = mapping.select(F.col("id").alias("target_id"), F.col("canonical_id").alias("_target"))
    moved = relationships.join(source, "source_id", "left").join(target, "target_id", "left")
    loop = (F.col("source_id") != F.col("target_id")) & (F.coalesce("_source", "source_id") == F.coalesce("_target", "target_id"))
    ends = [F.coalesce("_source", "source_id").alias("source_id"), F.coalesce("_target", "target_id").alias("target_id")]
    return moved.filter(~loop).select(*ends, "relationship_type", "weight").groupBy("source_id", "target_id", "relationship_type").agg(F.max("weight").alias("weight"))


def merge_duplicate_entities(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(id, canonical_id): of the rows with equal keys the earliest by (n, id) is canonical."""
    first = F.first("id").over(Window.partitionBy(*keys).orderBy("n", "id"))
    return entities.select("id", first.alias("canonical_id"))
