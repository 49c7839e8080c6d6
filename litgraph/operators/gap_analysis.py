"""The analysis of structural gaps from clusters to bridges, and what it says of the clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .analytics import fallback_label
from .gaps import bridge_candidates, gap_sides, potential_edges
from .graph import detect_gaps, durable

#: Colours that clusters take in turn.
COLOURS = 10


def cluster_summary(members: DataFrame, edges: DataFrame, scores: DataFrame, keywords: int = 5) -> DataFrame:
    """(cluster_id, label, keywords, colour, size, n_edges, density, mean_centrality) of each cluster.

    ``members`` is (id, cluster_id, name, n), ``scores`` (id, centrality; 0 where it is
    missing). Keywords are the names of the first ``keywords`` members by (n, id), the label
    comes from them. Density is the share of a cluster's pairs that edges connect, whatever
    their direction and number; 0 for one member.
    """
    own = members.join(scores.select("id", "centrality"), "id", "left")
    sizes = own.groupBy("cluster_id").agg(F.count("*").alias("size"), F.round(F.avg(F.coalesce("centrality", F.lit(0.0))), 6).alias("mean_centrality"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("n", "id"))
    first = members.withColumn("place", place).filter(F.col("place") <= keywords).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("k"))
    names = F.transform("k", lambda k: k["name"])
    at = lambda end, c: members.select(F.col("id").alias(end), F.col("cluster_id").alias(c))
    inside = edges.join(at("source_id", "cluster_id"), "source_id").join(at("target_id", "other"), "target_id").filter("cluster_id = other and source_id <> target_id")
    inside = inside.select("cluster_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct().groupBy("cluster_id").agg(F.count("*").alias("n_edges"))
    rows = sizes.join(first, "cluster_id").join(inside, "cluster_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    density = F.when(F.col("size") < 2, 0.0).otherwise(F.round(2 * F.col("n_edges") / (F.col("size") * (F.col("size") - 1)), 6))
    return rows.select("cluster_id", fallback_label(names).alias("label"), names.alias("keywords"), F.pmod("cluster_id", F.lit(COLOURS)).cast("int").alias("colour"), "size", "n_edges", density.alias("density"), "mean_centrality")


@dataclass(frozen=True)
class GapAnalysis:
    """What ``analyze_gaps`` finds, each part a table."""

    clusters: DataFrame
    gaps: DataFrame
    bridges: DataFrame
    potential_edges: DataFrame
    summary: DataFrame


def analyze_gaps(members: DataFrame, edges: DataFrame, scores: DataFrame, top: int = 5, least: float = 0.3, dense: float = 0.15) -> GapAnalysis:
    """Gaps between clusters, with bridges and potential edges of the ``top`` weakest, and one row that sums it up.

    ``members`` is (id, cluster_id, name, n, embedding), ``scores`` (id, centrality). The
    summary has the clusters, gaps, their mean strength, and whether that is over ``dense``:
    then the gaps are only weaker than other connections (well_connected).
    """
    clusters = cluster_summary(members, edges, scores)
    gaps = durable(detect_gaps(edges, members.select("id", "cluster_id")).withColumnRenamed("place", "gap_id"))
    named = clusters.select("cluster_id", "label")
    called = lambda c: named.select(F.col("cluster_id").alias(c), F.col("label").alias(f"label_{c}"))
    labelled = gaps.join(called("a"), "a").join(called("b"), "b").select("gap_id", "a", "b", "label_a", "label_b", "n_edges", "gap_strength")
    weakest = gaps.filter(F.col("gap_id") <= top)
    sides = durable(gap_sides(weakest, members))
    vectors = members.select("id", "embedding")
    bridges = bridge_candidates(sides, vectors, scores.select("id", F.col("centrality").alias("betweenness")))
    near = potential_edges(sides, vectors, 5, least)
    mean = F.round(F.avg("gap_strength"), 6)
    found = gaps.agg(F.count("*").alias("n_gaps"), mean.alias("mean_strength"))
    sizes = members.agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_concepts"))
    summary = sizes.crossJoin(found).withColumn("well_connected", F.coalesce(F.col("mean_strength") > dense, F.lit(False)))  # one row each
    return GapAnalysis(clusters, labelled, bridges, near, summary)
