"""Centralities and walks as iterated joins: the tables of distances and ranks stay distributed, the driver sees counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import degree, durable, multi_hop


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, w) of undirected edges without loops, parallel edges as one of their total weight."""
    one = edges.filter("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum("weight").alias("w"))
    return durable(one.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").union(one.select("b", "a", "w")))


#: Steps of an iteration that are planned together, between two checks for its end.
STEPS = 5


def settle(step, state: DataFrame, tolerance: float, rounds: int, finish=lambda x: x) -> tuple[DataFrame, bool]:
    """Repeats ``step`` on (id, x), and ``finish`` after every few steps, until these change all x together by less than ``tolerance``; also whether they got there."""
    for _ in range(-(-rounds // STEPS)):
        moved = state
        for _ in range(STEPS):
            moved = step(moved)
        new = durable(finish(durable(moved)).join(state.select("id", F.col("x").alias("_x")), "id"))
        change = new.agg(F.sum(F.abs(F.col("x") - F.col("_x")))).first()[0] or 0.0
        state = new.select("id", "x")
        if change < tolerance:
            return state, True
    return state, False


def pagerank_converged(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """Weighted PageRank (id, pagerank) that sums to 1, to ``tolerance`` a node; every node of ``edges`` but those with loops alone has a neighbour, so no rank is lost."""
    steps = both_ways(edges)
    total = steps.groupBy("id").agg(F.sum("w").alias("_t"))
    links = durable(steps.join(total, "id").select("id", "other", (F.col("w") / F.col("_t")).alias("share")))
    n = max(total.count(), 1)
    walk = lambda r: r.join(links, "id").groupBy(F.col("other").alias("id")).agg(((1 - damping) / n + damping * F.sum(F.col("x") * F.col("share"))).alias("x"))
    ranks, near = settle(walk, total.select("id", F.lit(1.0 / n).alias("x")), n * tolerance, rounds)
    if not near:
        raise RuntimeError(f"PageRank did not settle in {rounds} rounds")
    return ranks.select("id", F.col("x").alias("pagerank"))


def eigenvector(edges: DataFrame, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """Weighted eigenvector centrality (id, eigenvector) of length 1 by power iteration; the degree centrality where that does not settle."""
    steps = both_ways(edges)
    nodes = steps.select("id").distinct()
    n = max(nodes.count(), 1)

    def power(state: DataFrame) -> DataFrame:
        return state.union(state.join(steps, "id").select(F.col("other"), F.col("x") * F.col("w"))).groupBy("id").agg(F.sum("x").alias("x"))

    def scaled(moved: DataFrame) -> DataFrame:
        length = moved.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_l"))  # one row
        return moved.crossJoin(F.broadcast(length)).select("id", (F.col("x") / F.col("_l")).alias("x"))

    found, near = settle(power, nodes.select("id", F.lit(1.0 / n).alias("x")), n * tolerance, rounds, scaled)
    return found.select("id", F.col("x").alias("eigenvector")) if near else degree(edges).select("id", F.col("centrality").alias("eigenvector"))


def walk_sums(dag: DataFrame, values: DataFrame, back: bool, rounds: int) -> DataFrame:
    """(s, id, x): the sum over all walks of ``dag`` (s, id, other) to a node of the value where the walk begins; against the edges with ``back``. No walk may have more than ``rounds`` edges."""
    a, b = ("other", "id") if back else ("id", "other")
    edges = dag.select("s", F.col(a).alias("id"), F.col(b).alias("_to"))
    total = now = durable(values)
    for _ in range(rounds):
        now = durable(now.join(edges, ["s", "id"]).groupBy("s", F.col("_to").alias("id")).agg(F.sum("x").alias("x")))
        if now.isEmpty():
            return durable(total.groupBy("s", "id").agg(F.sum("x").alias("x")))
        total = total.union(now)
    raise RuntimeError(f"walks are longer than {rounds} edges: weights must be greater than 0")


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Normalised betweenness (id, betweenness) over shortest weighted paths from ``sources`` (id; all nodes without it, else scaled up).

    Distances come from relaxing all sources at once, paths and dependencies from sums over
    the walks of the shortest-path graph, a join and an aggregation for each edge of the longest
    path. The tables have a row for each source and node that it reaches: choose
    ``sources`` on large graphs. Weights are lengths and must be greater than 0.
    """
    steps = both_ways(edges)
    nodes = durable(steps.select("id").distinct())
    starts = nodes if sources is None else durable(nodes.join(sources.select("id").distinct(), "id", "left_semi"))
    n, k = nodes.count(), starts.count()
    reach = near = durable(starts.select(F.col("id").alias("s"), "id", F.lit(0.0).alias("d")))
    rounds = n + 1  # a shortest path has less edges than there are nodes
    for _ in range(rounds):
        step = near.join(steps, "id").groupBy("s", F.col("other").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        old = reach.select("s", "id", F.col("d").alias("_d"))
        near = durable(step.join(old, ["s", "id"], "left").filter("_d is null or d < _d").drop("_d"))
        if near.isEmpty():
            break
        reach = durable(reach.join(near, ["s", "id"], "left_anti").union(near.select("s", "id", "d")))
    else:
        raise ValueError("weights must be greater than 0")
    ends = reach.select("s", F.col("id").alias("other"), F.col("d").alias("_e"))
    dag = durable(reach.join(steps, "id").join(ends, ["s", "other"]).filter(F.col("d") + F.col("w") == F.col("_e")).select("s", "id", "other"))
    paths = walk_sums(dag, starts.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("x")), False, rounds).withColumnRenamed("x", "paths")
    inner = paths.filter("s <> id")
    shares = walk_sums(dag, inner.select("s", "id", (1 / F.col("paths")).alias("x")), True, rounds)
    passed = inner.join(shares, ["s", "id"]).groupBy("id").agg(F.sum(F.col("paths") * F.col("x") - 1).alias("_b"))
    scale = n / k / ((n - 1) * (n - 2)) if n > 2 and k else 0.0
    return nodes.join(passed, "id", "left").select("id", (F.coalesce("_b", F.lit(0.0)) * scale).alias("betweenness"))


def centrality_table(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, degree, centrality, pagerank, eigenvector, betweenness) of every node with a neighbour."""
    out = degree(edges, distinct=True).join(pagerank_converged(edges), "id")
    return out.join(eigenvector(edges), "id").join(betweenness(edges, sources), "id")


def subgraph(edges: DataFrame, centre: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes nearest to ``centre`` (id) within ``depth`` hops as (id, hop), and the edges among them."""
    nodes = durable(multi_hop(edges, centre, depth).orderBy("hop", "id").limit(most))
    inside = edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return nodes, inside


def citation_ego(cites: DataFrame, centre: DataFrame, depth: int, most: int) -> DataFrame:
    """Edges (source_id, target_id, relation, level) around ``centre`` (id): at each level the first ``most`` references and citations of each new paper."""
    seen = frontier = durable(centre.select("id").distinct())
    found = []
    for level in range(1, depth + 1):
        ways = [("references", "source_id", "target_id"), ("citations", "target_id", "source_id")]
        rows = [cites.join(frontier.withColumnRenamed("id", own), own, "left_semi").select(F.col(own).alias("own"), F.col(other).alias("id"), F.lit(kind).alias("relation")) for kind, own, other in ways]
        place = F.row_number().over(Window.partitionBy("own", "relation").orderBy("id"))
        step = durable(rows[0].union(rows[1]).withColumn("_r", place).filter(F.col("_r") <= most).drop("_r"))
        out = F.col("relation") == "references"
        found.append(step.select(F.when(out, F.col("own")).otherwise(F.col("id")).alias("source_id"), F.when(out, F.col("id")).otherwise(F.col("own")).alias("target_id"), "relation", F.lit(level).alias("level")))
        frontier = durable(step.select("id").distinct().join(seen, "id", "left_anti"))
        seen = durable(seen.union(frontier))
    every = found[0]
    for rows in found[1:]:
        every = every.union(rows)
    # an edge found from both ends keeps how it was found first
    first = F.struct("level", F.when(F.col("relation") == "references", 0).otherwise(1))
    return every.groupBy("source_id", "target_id").agg(F.min_by("relation", first).alias("relation"), F.min("level").alias("level"))


def collection_tree(rows: DataFrame, join: str = " > ", rounds: int = 100) -> DataFrame:
    """(id, depth, path) of (id, parent_id, name), from the rows without a parent down; rows in a ring are in no path."""
    level = durable(rows.filter("parent_id is null").select("id", F.lit(0).alias("depth"), F.col("name").alias("path")))
    out = level
    for depth in range(1, rounds + 1):
        above = level.select(F.col("id").alias("parent_id"), "path")
        level = durable(rows.join(above, "parent_id").select("id", F.lit(depth).alias("depth"), F.concat_ws(join, "path", "name").alias("path")))
        if level.isEmpty():
            return out
        out = out.union(level)
    raise RuntimeError(f"collections are nested more than {rounds} deep")


def citation_network(papers: DataFrame, works: DataFrame, references: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Local papers (doi) found among ``works`` (work_id, doi) with their first ``most`` references (work_id, place, cited_id).

    Gives nodes (work_id, is_local) and edges (source_id, target_id).
    """
    from ..functions.scalars import normalize_doi

    local = papers.select(normalize_doi(F.col("doi")).alias("doi")).distinct().join(works.select("work_id", normalize_doi(F.col("doi")).alias("doi")), "doi").select("work_id").distinct()
    place = F.row_number().over(Window.partitionBy("work_id").orderBy("place", "cited_id"))
    edges = references.join(local, "work_id", "left_semi").withColumn("_r", place).filter(F.col("_r") <= most).select(F.col("work_id").alias("source_id"), F.col("cited_id").alias("target_id"))
    ends = local.select("work_id", F.lit(True).alias("_l")).union(edges.select("target_id", F.lit(False)))
    return ends.groupBy("work_id").agg(F.max("_l").alias("is_local")), edges
