"""Searches that combine retrievers: chunks with their parents, seeds with a walk, gaps near a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import durable
from .overview import prefix_dedupe
from .relational import incident_edges, search_trigram, top_by
from .retrieval import with_cosine


def hierarchical_search(chunks: DataFrame, query: DataFrame, k: int, least: float = 0.5, sections: list[str] | None = None) -> DataFrame:
    """The ``k`` best chunks for a query vector with their parents' text: (id, score, section_type, text, parent_id, parent_text).

    ``chunks`` has id, parent_id (null for parents), section_type, text and embedding. Of
    those with a cosine of at least ``least`` the 2 k best are fetched, children before
    parents of the same score, then by id; of chunks whose texts begin alike the best stays.
    """
    kept = chunks if sections is None else chunks.filter(F.col("section_type").isin(sections))
    scored = with_cosine(kept.filter("embedding is not null"), query).filter(F.col("cosine") >= least).withColumnRenamed("cosine", "score")
    best = scored.orderBy(F.desc("score"), F.col("parent_id").isNull(), "id").limit(2 * k).select("id", "parent_id", "section_type", "text", "score")
    parents = chunks.select(F.col("id").alias("parent_id"), F.col("text").alias("parent_text"))
    best = prefix_dedupe(best, 2 * k)
    # 2 k rows at most look for their parents
    found = parents.join(F.broadcast(best), "parent_id", "right")
    return found.orderBy(F.desc("score"), F.col("parent_id").isNull(), "id").limit(k).select("id", "score", "section_type", "text", "parent_id", "parent_text")


def bounded_walk(edges: DataFrame, seeds: DataFrame, hops: int, limit: int) -> DataFrame:
    """The first ``limit`` nodes (id, hop) by least number of hops from ``seeds`` (id), then by id.

    The walk ends with the hop that completes the limit: later ones can't be among the first.
    """
    steps = incident_edges(edges).select("id", "other")
    seen = durable(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, hops + 1):
        if seen.count() >= limit:
            break
        new = steps.join(frontier.select("id"), "id", "left_semi").select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        # of one hop no more than the limit can count, and the next ones start from all only if it is not reached
        new = durable(new.withColumn("hop", F.lit(hop)))
        if new.isEmpty():
            break
        frontier, seen = new, seen.union(new)
    return seen.orderBy("hop", "id").limit(limit)


def hybrid_search(entities: DataFrame, edges: DataFrame, text: str, query: DataFrame, k: int = 5, hops: int = 2, limit: int = 50) -> DataFrame:
    """(id, hop, found_by): the ``k`` entities (id, name, embedding) nearest to the query vector, the ``k`` names most like ``text``, and what is near them.

    ``found_by`` is vector, text, or graph for what the walk from these seeds adds; of an
    entity that several find the first of these counts. The first ``limit`` by hop and id.
    """
    vector = with_cosine(entities.filter("embedding is not null"), query).orderBy(F.desc("cosine"), "id").limit(k).select("id", F.lit(0).alias("by"))
    names = search_trigram(entities, text, 0.1, k).select("id", F.lit(1).alias("by"))
    seeds = durable(vector.union(names).groupBy("id").agg(F.min("by").alias("by")))
    near = bounded_walk(edges, seeds, hops, limit)
    by = F.when(F.col("by") == 0, "vector").when(F.col("by") == 1, "text").otherwise("graph")
    return near.join(F.broadcast(seeds), "id", "left").select("id", "hop", by.alias("found_by"))  # 2 k seeds


def paper_gap_connections(matched: DataFrame, gaps: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Gaps that a paper may help to bridge: (paper_id, gap_id, label_a, label_b, found_by), the first ``k`` of each paper by gap_id.

    ``matched`` (paper_id, id, cluster_id) holds the entities found in papers, ``gaps`` gap_id,
    a, b and bridges (ids). Gaps count whose bridges hold one of a paper's entities; for a
    paper without such a gap, those that one of its clusters borders on. Missing labels read
    as unknown.
    """
    bridges = gaps.select("gap_id", F.explode("bridges").alias("id")).distinct()
    direct = matched.select("paper_id", "id").join(bridges, "id").select("paper_id", "gap_id", F.lit("bridge").alias("found_by")).distinct()
    rest = matched.filter("cluster_id is not null").select("paper_id", "cluster_id").distinct().join(direct.select("paper_id").distinct(), "paper_id", "left_anti")
    sides = gaps.select("gap_id", F.explode(F.array("a", "b")).alias("cluster_id"))
    by_cluster = rest.join(sides, "cluster_id").select("paper_id", "gap_id", F.lit("cluster").alias("found_by")).distinct()
    first = top_by(direct.union(by_cluster), ["paper_id"], [F.col("gap_id")], k)
    called = lambda c: labels.select(F.col("cluster_id").alias(c), F.col("label").alias(f"label_{c}"))
    named = first.join(gaps.select("gap_id", "a", "b"), "gap_id").join(called("a"), "a", "left").join(called("b"), "b", "left")
    return named.select("paper_id", "gap_id", F.coalesce("label_a", F.lit("Unknown Cluster A")).alias("label_a"), F.coalesce("label_b", F.lit("Unknown Cluster B")).alias("label_b"), "found_by")


def nearest_entities(entities: DataFrame, query: DataFrame, k: int, kind: str | None = None, least: float | None = None) -> DataFrame:
    """The ``k`` entities (id, name, entity_type, embedding) nearest to a query vector (embedding, one row), of one type if ``kind`` is given: (id, name, entity_type, score), ties by id."""
    own = entities if kind is None else entities.filter(F.col("entity_type") == kind)
    rows = with_cosine(own.filter("embedding is not null"), query).withColumnRenamed("cosine", "score")
    kept = rows if least is None else rows.filter(F.col("score") >= least)
    return kept.orderBy(F.desc("score"), "id").limit(k).select("id", "name", "entity_type", "score")


def similar_entities(entities: DataFrame, node: str, k: int) -> DataFrame:
    """The ``k`` entities nearest to one's own vector, itself left out: (id, name, entity_type, score).

    One without a vector gets others of its type instead, the first ``k`` by name and id, with
    a null score; an unknown one gets nothing.
    """
    asked = durable(entities.filter(F.col("id") == node).select("entity_type", "embedding").limit(1))  # one row
    near = nearest_entities(entities.filter(F.col("id") != node), asked.filter("embedding is not null"), k)
    type_ = F.broadcast(asked.filter("embedding is null").select("entity_type"))
    same = entities.filter(F.col("id") != node).join(type_, "entity_type", "left_semi").orderBy("name", "id").limit(k)
    return near.union(same.select("id", "name", "entity_type", F.lit(None).cast("double")))


def search_chunks(chunks: DataFrame, papers: DataFrame, query: DataFrame, k: int, sections: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The ``k`` (1 to 100) chunks (id, paper_id, section_type, text, embedding) nearest to a query vector with a cosine of at least ``least``, with their papers' titles.

    Of the given sections only, if any; chunks without a known paper have no title.
    """
    k = max(1, min(k, 100))
    kept = chunks if sections is None else chunks.filter(F.col("section_type").isin(sections))
    best = with_cosine(kept.filter("embedding is not null"), query).filter(F.col("cosine") >= least).orderBy(F.desc("cosine"), "id").limit(k)
    found = papers.select("paper_id", "title").join(F.broadcast(best), "paper_id", "right")  # 100 rows at most
    return found.select("id", "paper_id", "title", "section_type", "text", F.col("cosine").alias("score"))
