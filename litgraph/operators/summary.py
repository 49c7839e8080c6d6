"""What a project holds, how good its clusters are, and answers about its gaps."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analytics import diversity_index, silhouette_cosine
from .gap_analysis import cluster_summary
from .gaps import gap_sides
from .graph import cluster_coherence, detect_gaps, durable, modularity
from .overview import cluster_coverage, lowest_degree

#: Types of entities that are shown (fixed values).
SHOWN = ("Concept", "Method", "Finding", "Problem", "Dataset", "Metric", "Innovation", "Limitation")


def first_names(gaps: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Adds names_a and names_b: the names of the first ``k`` members of both clusters (a, b) of few gaps (gap_id)."""
    named = gap_sides(gaps, members, k).join(members.select("id", "name"), "id")
    lists = named.groupBy("gap_id", "side").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("l"))
    out = gaps
    for side in "AB":
        own = lists.filter(F.col("side") == side).select("gap_id", F.transform("l", lambda x: x["name"]).alias(f"names_{side.lower()}"))
        out = out.join(own, "gap_id", "left")
    return out


def cluster_quality(members: DataFrame, nodes: DataFrame, links: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """One row (modularity, interpretation, diversity, density, silhouette, coherence, coverage) of a clustering.

    ``members`` is (id, cluster_id, embedding), ``nodes`` (id) all that could be clustered,
    ``links`` edges between them with weights, ``inner`` those of them among members if they are known already. Coherence is the mean over clusters of two or
    more vectors; density counts a pair of nodes once, whatever its edges.
    """
    membership = members.select("id", "cluster_id")
    q = modularity(durable(links if inner is None else inner), membership)
    read = F.when(F.col("modularity") >= 0.5, "strong").when(F.col("modularity") >= 0.3, "moderate").otherwise("weak")
    sizes = membership.groupBy("cluster_id").agg(F.count("*").alias("size"))
    diversity = diversity_index(sizes).agg(F.coalesce(F.max("diversity"), F.lit(0.0)).alias("diversity"))
    n = nodes.agg(F.count("*").alias("_n"))
    pairs = links.filter("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct().agg(F.count("*").alias("_m"))
    density = n.crossJoin(pairs).select(F.when(F.col("_n") > 1, F.round(2 * F.col("_m") / (F.col("_n") * (F.col("_n") - 1)), 6)).otherwise(0.0).alias("density"))
    silhouette = silhouette_cosine(members).select("silhouette")
    coherence = cluster_coherence(members).agg(F.round(F.coalesce(F.avg("coherence"), F.lit(0.0)), 6).alias("coherence"))
    coverage = cluster_coverage(nodes, membership).select("coverage")
    out = q.withColumn("interpretation", read)
    for row in (diversity, density, silhouette, coherence, coverage):
        out = out.crossJoin(row)  # one row each
    return out


class ProjectSummary:
    """Overview of a project; each part is a table that is only computed when it is asked for. Overview, quality and temporal have one row.

    ``entities`` is (id, name, entity_type, first_year, last_year), ``members`` (id, cluster_id,
    name, n, embedding) those in clusters, ``links`` the weighted edges among concepts,
    ``scores`` (id, centrality). Top entities are the ``k`` shown ones of the highest score;
    emerging ones were first seen within ``span`` years of the last year. The strongest
    ``n_gaps`` of the gaps found are named by their clusters' labels and first five members.
    ``inner`` are the links with both ends among the members, if they are known already.
    """

    def __init__(self, papers: DataFrame, entities: DataFrame, edges: DataFrame, members: DataFrame, links: DataFrame, scores: DataFrame, span: int = 2, k: int = 10, n_gaps: int = 5, inner: DataFrame | None = None):
        self.papers, self.entities, self.edges, self.members, self.links, self.scores = papers, entities, edges, members, links, scores
        self.span, self.k, self.n_gaps, self.inner = span, k, n_gaps, links if inner is None else inner
        self.shown = entities.filter(F.col("entity_type").isin(*SHOWN))

    @property
    def overview(self) -> DataFrame:
        one = lambda df, name: df.agg(F.count("*").alias(name))
        kinds = self.shown.agg(F.round(F.countDistinct("entity_type") / len(SHOWN), 6).alias("type_diversity"))
        return one(self.papers, "n_papers").crossJoin(one(self.entities, "n_entities")).crossJoin(one(self.edges, "n_relationships")).crossJoin(kinds)  # one row each

    @property
    def types(self) -> DataFrame:
        return self.entities.groupBy("entity_type").agg(F.count("*").alias("n"))

    @property
    def quality(self) -> DataFrame:
        return cluster_quality(self.members, self.shown.filter("entity_type = 'Concept'").select("id"), self.links, self.inner)

    @property
    def scored(self) -> DataFrame:
        return self.shown.join(self.scores.select("id", "centrality"), "id", "left")

    @property
    def top_entities(self) -> DataFrame:
        best = self.scored.filter("centrality is not null").orderBy(F.desc("centrality"), "id").limit(self.k)
        return best.select("id", "name", "entity_type", F.round("centrality", 6).alias("centrality"))

    @cached_property
    def clusters(self) -> DataFrame:
        return durable(cluster_summary(self.members, self.inner, self.scores, 8))

    @property
    def communities(self) -> DataFrame:
        return self.clusters.select("cluster_id", "label", "size", F.col("keywords").alias("names"))

    @property
    def gaps(self) -> DataFrame:
        found = detect_gaps(self.inner, self.members.select("id", "cluster_id")).orderBy(F.desc("gap_strength"), "a", "b").limit(self.n_gaps)
        found = first_names(durable(found.select(F.col("place").alias("gap_id"), "a", "b", "gap_strength")), self.members, 5)
        for c in "ab":
            label = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
            found = found.join(self.clusters.select(F.col("cluster_id").alias(c), label.alias(f"label_{c}")), c)
        return found.select("gap_id", "a", "b", "label_a", "label_b", "names_a", "names_b", "gap_strength")

    @property
    def temporal(self) -> DataFrame:
        return self.entities.agg(F.min("first_year").alias("min_year"), F.max(F.coalesce("last_year", "first_year")).alias("max_year"))

    @property
    def emerging(self) -> DataFrame:
        recent = self.scored.crossJoin(F.broadcast(self.temporal)).filter(F.col("first_year") >= F.col("max_year") - self.span)  # one row
        return recent.orderBy(F.desc(F.coalesce("centrality", F.lit(0.0))), "id").limit(self.k).select("id", "name", "first_year")


#: The function that makes a summary.
project_summary = ProjectSummary


class GapAnswer:
    """Where research is missing: weak gaps, entities with few edges, methods hardly used, and what to do; a part is only computed when it is asked for.

    ``gaps`` is (gap_id, a, b, gap_strength), or a function that finds them: the ten weakest count, with the first three names
    of both clusters. ``entities`` (id, name, entity_type) that are concepts, methods or
    findings with at most ``few`` edges are underexplored, the ten with the fewest; the five
    methods with the fewest edges are hardly used. With ``least`` only edges of that weight
    count, a missing weight as 1. Ties go by id. Recommendations (place, text) are at most
    five sentences from these tables; without gaps and underexplored entities one says so.
    """

    def __init__(self, gaps: DataFrame | Callable[[], DataFrame], members: DataFrame, entities: DataFrame, edges: DataFrame, least: float | None = None, few: int = 2):
        self.found, self.members, self.few = gaps, members, few
        self.trusted = edges if least is None else edges.filter(F.coalesce("weight", F.lit(1.0)) >= least)
        self.known = entities.filter(F.col("entity_type").isin("Concept", "Method", "Finding")).select("id", "name", "entity_type")

    @cached_property
    def gaps(self) -> DataFrame:
        found = self.found() if callable(self.found) else self.found
        weak = found.orderBy("gap_strength", "a", "b").limit(10).select("gap_id", "a", "b", F.round("gap_strength", 3).alias("gap_strength"))
        return durable(first_names(durable(weak), self.members, 3))

    @cached_property
    def underexplored(self) -> DataFrame:
        return durable(lowest_degree(self.known, self.trusted, self.few, 10))

    @cached_property
    def methods(self) -> DataFrame:
        return durable(lowest_degree(self.known.filter("entity_type = 'Method'"), self.trusted, None, 5))

    @property
    def recommendations(self) -> DataFrame:
        weak, rare, methods = self.gaps, self.underexplored, self.methods

        def text_of(rows: DataFrame, k: int, order: list, place: int, text: str) -> DataFrame:
            """One sentence from the first ``k`` names of a table of at most ten rows; none if it is empty."""
            first = rows.orderBy(*order).limit(k)
            names = first.agg(F.array_sort(F.collect_list(F.struct("degree", "id", "name"))).alias("l")).filter(F.size("l") > 0)
            return names.select(F.lit(place).alias("place"), F.concat(F.lit(text), F.array_join(F.transform("l", lambda x: x["name"]), ", ")).alias("text"))

        side = lambda c: F.array_join(F.slice(f"names_{c}", 1, 2), ", ")
        explore = F.concat(F.lit("Explore the connection between "), side("a"), F.lit(" and "), side("b"), F.lit(" (gap strength: "), F.format_string("%.1f%%", F.col("gap_strength") * 100), F.lit(")"))
        ordered = weak.orderBy("gap_strength", "a", "b").limit(3).select(F.struct("gap_strength", "a", "b").alias("o"), explore.alias("text"))
        numbered = ordered.agg(F.array_sort(F.collect_list(F.struct("o", "text"))).alias("l")).select(F.posexplode("l").alias("i", "x"))  # three rows
        said = numbered.select((F.col("i") + 1).alias("place"), F.col("x.text").alias("text"))
        said = said.union(text_of(rare, 3, ["degree", "id"], 4, "These concepts need more research coverage: "))
        said = said.union(text_of(methods, 2, ["degree", "id"], 5, "Consider applying underutilized methods: "))
        nothing = weak.select("gap_id").union(rare.select(F.lit(0))).agg(F.count("*").alias("n")).filter("n = 0")
        said = said.union(nothing.select(F.lit(6), F.lit("No structural gaps detected. Consider refreshing gap analysis from the graph panel.")))
        return said


#: The function that makes an answer.
gap_answer = GapAnswer
