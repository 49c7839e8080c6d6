"""Summaries of the graph's nodes, clusters and records, and slices of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import durable
from .relational import incident_edges, top_by


def papers_with_authors(papers: DataFrame, authored: DataFrame, names: DataFrame) -> DataFrame:
    """Papers with the sorted distinct names of their authors; no author gives an empty array."""
    named = authored.join(names.select(F.col("id").alias("target_id"), "name"), "target_id")
    lists = named.groupBy(F.col("source_id").alias("paper_id")).agg(F.sort_array(F.collect_set("name")).alias("authors"))
    return papers.join(lists, "paper_id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def counts_with_zero(nodes: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds to each of ``nodes`` how many ``rows`` have its id in ``key``; counted before the join."""
    n = rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    return nodes.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def lowest_degree(nodes: DataFrame, edges: DataFrame, most: int | None, k: int) -> DataFrame:
    """The ``k`` nodes with the fewest edges, at most ``most`` of them, ties by id."""
    rows = counts_with_zero(nodes, incident_edges(edges), "id", "degree")
    kept = rows if most is None else rows.filter(F.col("degree") <= most)
    return kept.orderBy("degree", "id").limit(k)


def finding_relationships(findings: DataFrame, concepts: DataFrame, default: float = 0.8) -> DataFrame:
    """SUPPORTS and CONTRADICTS edges from the arrays of findings (id, supports, contradicts, confidence) to known concepts."""

    def kind(column: str, name: str) -> DataFrame:
        return findings.select(F.col("id").alias("source_id"), F.explode(column).alias("target_id"), F.lit(name).alias("relationship_type"), F.coalesce("confidence", F.lit(default)).alias("weight"))

    rows = kind("supports", "SUPPORTS").union(kind("contradicts", "CONTRADICTS"))
    return rows.join(concepts.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "relationship_type", "weight")


def result_profile(rows: DataFrame) -> DataFrame:
    """Rows and range of years of each entity type."""
    return rows.groupBy("entity_type").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def share_of(rows: DataFrame, key: str, counted: Column) -> DataFrame:
    """Rows of each value of ``key`` and the share of them for which ``counted`` holds."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.count_if(counted) / F.count("*"), 6).alias("share"))


def evidence_counts(rows: DataFrame, key: str, distinct: dict[str, str]) -> DataFrame:
    """For each ``key`` the number of distinct values of several columns: (name of the count, column)."""
    return rows.groupBy(key).agg(*(F.countDistinct(c).alias(k) for k, c in distinct.items()))


def member_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with the clusters ca and cb of their ends; edges that leave the partition are not in it."""
    side = lambda end, c: membership.select(F.col("id").alias(end), F.col("cluster_id").alias(c))
    return edges.join(side("source_id", "ca"), "source_id").join(side("target_id", "cb"), "target_id")


def cluster_edge_counts(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges that touch each cluster; one that stays inside counts once."""
    ends = member_edges(edges, membership)
    touched = ends.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("cluster_id"))
    return touched.groupBy("cluster_id").agg(F.count("*").alias("n_edges"))


def cluster_adjacency(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges between each pair of clusters that has any: (a, b, n_edges), a < b."""
    ends = member_edges(edges, membership).filter("ca <> cb")
    return ends.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n_edges"))


def intra_cluster_density(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges inside each cluster over n(n - 1) / 2; 0 for a cluster of one."""
    inside = member_edges(edges, membership).filter("ca = cb").groupBy(F.col("ca").alias("cluster_id")).agg(F.count("*").alias("m"))
    rows = membership.groupBy("cluster_id").agg(F.count("*").alias("n")).join(inside, "cluster_id", "left")
    possible = F.col("n") * (F.col("n") - 1) / 2
    return rows.select("cluster_id", "n", F.when(F.col("n") > 1, F.round(F.coalesce("m", F.lit(0)) / possible, 6)).otherwise(0.0).alias("density"))


def cluster_coverage(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Share of ``nodes`` that are in a cluster."""
    marked = nodes.select("id").join(membership.select("id").distinct().withColumn("_in", F.lit(1)), "id", "left")
    return marked.agg(F.count("*").alias("n"), F.count("_in").alias("clustered")).withColumn("coverage", F.round(F.try_divide("clustered", "n"), 6))


def prefix_dedupe(rows: DataFrame, k: int, chars: int = 100) -> DataFrame:
    """The best row (id, text, score) for each lower-cased beginning of the text, then the ``k`` best."""
    keyed = rows.withColumn("_key", F.lower(F.substring("text", 1, chars)))
    return top_by(keyed, ["_key"], [F.desc("score"), F.asc("id")], 1).drop("_key").orderBy(F.desc("score"), "id").limit(k)


def top_percent(rows: DataFrame, score: str, percent: float) -> DataFrame:
    """The ceil(n * percent) rows of the highest score, ties by id.

    Only ids and scores are sorted, by ranges: the rank is a place in a global sort's
    partition plus the sizes of those before, so no window gathers all rows in one task. The
    sorted rows are checkpointed: their partitions must be the same each time they are read.
    """
    rows = durable(rows.select("id", score))  # read to sample the ranges, to sort and to count
    ordered = rows.orderBy(F.desc(score), "id").withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ordered = durable(ordered)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = rows.agg(F.ceil(F.count("*") * F.lit(percent)).alias("_keep"))
    placed = ordered.join(F.broadcast(before.select("_part", "_first", "_before")), "_part").crossJoin(F.broadcast(total))
    return placed.filter(F.col("_before") + F.col("_i") - F.col("_first") < F.col("_keep")).select("id", score)


def graph_snapshot(nodes: DataFrame, edges: DataFrame, year: int) -> DataFrame:
    """Edges whose ends both exist by ``year`` with the opacity of the source, which fades after five years, to 0.3.

    Targets go first: ends that have no year are mostly targets, and their edges are not shuffled again.
    """
    age = F.lit(year) - F.col("year")
    seen = nodes.filter(F.col("year") <= year).select("id", F.when(age > 5, F.greatest(F.lit(0.3), 1 - 0.1 * (age - 5))).otherwise(1.0).alias("opacity"))
    left = edges.join(seen.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return left.join(seen.withColumnRenamed("id", "source_id"), "source_id").select(*edges.columns, "opacity")


def hybrid_merge(vector: DataFrame, traversal: DataFrame) -> DataFrame:
    """Ids of both searches, each once, with the search that found it; the vector search comes first."""
    rows = vector.select("id", F.lit(0).alias("p")).union(traversal.select("id", F.lit(1)))
    return rows.groupBy("id").agg(F.min("p").alias("p"), F.count_distinct("p").alias("n_searches")).select("id", F.when(F.col("p") == 0, "vector").otherwise("graph").alias("found_by"), "n_searches")


def slice_graph(edges: DataFrame, scores: DataFrame, score: str, k: int) -> DataFrame:
    """The edges that are left when the ``k`` nodes of the highest score go."""
    gone = F.broadcast(scores.orderBy(F.desc(score), "id").limit(k).select("id"))  # k rows
    return edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")


def set_similarity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jaccard similarity and overlap coefficient of two tables' distinct keys; null when both are empty."""
    rows = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    n = rows.agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
    return n.select("common", F.round(F.try_divide(F.col("common"), F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"), F.round(F.try_divide(F.col("common"), F.least("na", "nb")), 6).alias("overlap"))
