"""Graph algorithms as iterated DataFrame jobs, and gap analytics over clusters."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import incident_edges


#: Setting by which the shuffle files of an execution are removed at its end; it holds for DataFrames made while it is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ADAPTIVE, PARTITIONS = "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"
#: Edges of a graph that are worth a task of their own.
PART_EDGES = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which the whole cluster shares; only in local mode, as in tests, a temporary one where it is unset."""
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir():
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame, parts: int | None = None, dealt: bool = False) -> DataFrame:
    """Writes ``df`` to the checkpoint folder that the whole cluster shares and reads it from there.

    Its shuffle files go as soon as it is written, not when the driver happens to collect garbage. With ``parts``, every shuffle
    makes that many partitions. With ``dealt``, Spark knows how what it reads was dealt and sorted, which it forgets of plans that it adapts while they run.
    """
    spark = df.sparkSession
    shared_folder(spark)
    settings = {CLEANUP: "true", **({PARTITIONS: str(parts)} if parts else {}), **({ADAPTIVE: "false"} if dealt else {})}
    before = {k: spark.conf.get(k, "false") if k == CLEANUP else spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return df.select("*").checkpoint()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v) as (id, component = smallest id reachable).

    In each round every node goes over to the first of itself and its neighbours in a random order, edges inside what became one
    node go, and equal ones count once: edges shrink by a share in each round, until none is left. An order holds for two rounds,
    after which a star is one node. Neighbour lists are never gathered: a hub only takes part in a map-side combined minimum
    and in joins that adaptive execution can split. Self loops are ignored; ids that have no edge are not in the result.
    """
    ends = lambda df: df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, went = durable(ends(edges)), []
    most = parts = 1 + (left := edges.count()) // PART_EDGES
    few = lambda df: df.coalesce(parts)  # noqa: E731  # no more tasks than a small graph is worth
    while left or not went:
        if len(went) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(went) // 2)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = few(few(both).groupBy("u").agg(F.min(place("v")).alias("m"))).select("u", F.least("m", place("u"))["id"].alias("m"))
        went.append(first := durable(first, parts))
        moved = few(edges.join(first, "u")).select(F.col("m").alias("u"), "v")
        moved = few(moved.join(first.select(F.col("u").alias("v"), "m"), "v")).select("u", F.col("m").alias("v"))
        edges = durable(few(ends(moved)), parts)
        parts = 1 + (left := edges.count()) // PART_EDGES
    parts = most
    found = went.pop()
    for first in reversed(went):
        found = few(first.join(found.select(F.col("u").alias("m"), F.col("m").alias("_m")), "m", "left")).select("u", F.coalesce("_m", "m").alias("m"))
    found = durable(found, parts)
    return found.join(found.groupBy("m").agg(F.min("u").alias("component")), "m").select(F.col("u").alias("id"), "component")


def multi_hop(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Least number of hops from ``starts`` (id) along edges in both directions: (id, hop)."""
    steps = incident_edges(edges).select("id", "other").distinct()
    seen = starts.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        new = frontier.join(steps, "id").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = durable(new.withColumn("hop", F.lit(hop)))
        seen = seen.union(frontier)
    return seen


def degree(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """Degree of each node over the greatest degree; multi-edges count, or collapse with ``distinct``."""
    n = F.countDistinct("other") if distinct else F.count("*")
    d = incident_edges(edges).groupBy("id").agg(n.alias("degree"))
    greatest = d.agg(F.max("degree").alias("m"))  # one row
    return d.crossJoin(F.broadcast(greatest)).select("id", "degree", F.round(F.col("degree") / F.col("m"), 6).alias("centrality"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Undirected PageRank of a fixed number of rounds, scaled by its greatest value; nodes without edges are not in it."""
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, 1 + 2 * edges.count() // PART_EDGES)
    links = incident_edges(edges).select("id", "other").withColumn("out", F.count("*").over(Window.partitionBy("id")))
    links = durable(links, parts, dealt=True)  # dealt and sorted by node once: in each round only the contributions move
    nodes = links.select("id").distinct()
    n = nodes.count()
    ranks = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        sent = links.join(ranks.hint("merge"), "id").groupBy(F.col("other").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("s"))
        ranks = sent.select("id", ((1 - damping) / max(n, 1) + damping * F.col("s")).alias("rank"))
        if i % 5 == 4 or i == rounds - 1:
            ranks = durable(ranks, parts, dealt=True)
    greatest = ranks.agg(F.max("rank").alias("m"))
    return ranks.crossJoin(F.broadcast(greatest)).select("id", (F.col("rank") / F.col("m")).alias("pagerank"))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id reachable along edges; an id with nothing but self loops is its own component."""
    found = components(edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")), max_rounds)
    alone = edges.filter("source_id = target_id").select(F.col("source_id").alias("id")).distinct().join(found, "id", "left_anti")
    return found.union(alone.select("id", F.col("id").alias("component")))


def neighbour_gap(edges: DataFrame) -> DataFrame:
    """Share of a node's neighbour pairs that are not adjacent; 0 with fewer than two neighbours."""
    e = edges.filter("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    both = e.select(F.col("a").alias("id"), F.col("b").alias("other")).union(e.select("b", "a"))
    d = both.groupBy("id").agg(F.count("*").alias("d"))
    corner = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").join(e.select("a", F.col("b").alias("c")), ["a", "c"])
    triangles = corner.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    score = F.when(F.col("d") < 2, 0.0).otherwise(1 - F.coalesce("t", F.lit(0)) / pairs)
    return d.join(triangles, "id", "left").select("id", F.round(score, 6).alias("gap_score"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Newman's modularity of a partition (id, cluster_id); edges outside the partition do not count."""
    ends = edges.join(membership.select(F.col("id").alias("source_id"), F.col("cluster_id").alias("ca")), "source_id").join(membership.select(F.col("id").alias("target_id"), F.col("cluster_id").alias("cb")), "target_id")
    inner = ends.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    deg = ends.select(F.col("ca").alias("c"), "weight").union(ends.select("cb", "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    square = deg.agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inner.crossJoin(square).select(F.round(F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))


def scaled_modularity(rows: DataFrame) -> DataFrame:
    """Adds the modularity shifted and scaled to 0 to 1 (scaled)."""
    return rows.withColumn("scaled", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("modularity") + 0.5) / 1.5)), 6))


def cluster_pairs(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """All pairs of clusters with the edges between them and strength = edges / (size a x size b).

    The cross join is of clusters, of which there are as many as the clustering was asked for.
    """
    sizes = membership.groupBy("cluster_id").agg(F.count("*").alias("size"))
    pairs = sizes.select(F.col("cluster_id").alias("a"), F.col("size").alias("na")).crossJoin(sizes.select(F.col("cluster_id").alias("b"), F.col("size").alias("nb"))).filter("a < b")
    ends = edges.join(membership.select(F.col("id").alias("source_id"), F.col("cluster_id").alias("ca")), "source_id").join(membership.select(F.col("id").alias("target_id"), F.col("cluster_id").alias("cb")), "target_id")
    between = ends.filter("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n_edges"))
    rows = pairs.join(between, ["a", "b"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return rows.withColumn("strength", F.col("n_edges") / (F.col("na") * F.col("nb")))


def detect_gaps(edges: DataFrame, membership: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """Weakly connected cluster pairs, weakest first: under min(0.3, p25 + 0.1), at least ``least``, at most ``most``."""
    rows = durable(cluster_pairs(edges, membership))  # few, and read twice
    cut = rows.agg(F.least(F.lit(0.3), F.percentile("strength", 0.25) + 0.1).alias("cut"))
    ranked = rows.crossJoin(F.broadcast(cut)).withColumn("place", F.row_number().over(Window.orderBy("strength", "a", "b")))
    return ranked.filter(((F.col("strength") < F.col("cut")) | (F.col("place") <= least)) & (F.col("place") <= most)).select("a", "b", "n_edges", F.round("strength", 9).alias("gap_strength"), "place")


def cluster_coherence(vectors: DataFrame) -> DataFrame:
    """Mean cosine of different members of each cluster, from the sum of unit vectors: (cluster_id, embedding) in."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    parts = vectors.filter("embedding is not null").select("cluster_id", v.alias("_v")).withColumn("_n", norm).filter("_n > 0").select("cluster_id", F.posexplode("_v").alias("i", "x"), "_n")
    sums = parts.groupBy("cluster_id", "i").agg(F.sum(F.col("x") / F.col("_n")).alias("s"), F.count("*").alias("n"))
    out = sums.groupBy("cluster_id").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n")).filter("n > 1")
    return out.select("cluster_id", "n", F.round((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("coherence"))


def cluster_diversity(sizes: DataFrame) -> DataFrame:
    """Entropy, normalised entropy, share of the largest and Gini of cluster sizes (cluster_id, size)."""
    w = Window.orderBy("size", "cluster_id")
    rows = sizes.withColumn("total", F.sum("size").over(Window.partitionBy())).withColumn("k", F.count("*").over(Window.partitionBy())).withColumn("r", F.row_number().over(w))
    p = F.col("size") / F.col("total")
    out = rows.agg(F.max("k").alias("k"), F.sum(-p * F.log(p)).alias("h"), F.max(p).alias("d"), F.sum(F.col("r") * F.col("size")).alias("rs"), F.max("total").alias("total"))
    normal = F.when(F.col("k") > 1, F.col("h") / F.log(F.col("k"))).otherwise(0.0)
    gini = 2 * F.col("rs") / (F.col("k") * F.col("total")) - (F.col("k") + 1) / F.col("k")
    return out.select(F.col("k").alias("n_clusters"), F.round("h", 6).alias("entropy"), F.round(normal, 6).alias("normalised"), F.round("d", 6).alias("dominant"), F.round(gini, 6).alias("gini"))


def vector_topk(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` vectors nearest to each query (query_id, q) by cosine. Queries are a small given set, compared in one pass."""
    from ..functions.scalars import cosine_similarity

    rows = vectors.filter("embedding is not null").crossJoin(F.broadcast(query)).withColumn("similarity", cosine_similarity(F.col("embedding"), F.col("q")))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", id_col, F.round("similarity", 6).alias("similarity"), "place")


def vector_topk_blocks(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "id", vector_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """``vector_topk`` for query sets that grow with the table: blocks of vectors meet blocks of queries, and a meeting keeps each query's ``k`` best.

    Only vectors of a query's length are compared with it; vectors that are null or hold null or non-finite components are left out.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    fine = lambda v: F.col(v).isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = vectors.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(fine("v"))
    q = query.select("query_id", F.col("q").cast("array<double>").alias("q")).filter(fine("q"))
    sizes = v.agg(F.count("*")).first()[0], q.agg(F.count("*")).first()[0]
    n_v, n_q = max(1, -(-sizes[0] // vector_block)), max(1, -(-sizes[1] // query_block))
    dealt = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    v = dealt(v.select("id", "v", F.size("v").alias("size")), "i", n_v, "j", n_q)
    q = dealt(q.select("query_id", "q", F.size("q").alias("size")), "j", n_q, "i", n_v)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, [("id", "ascending")])).combine_chunks() if left.num_rows else left
        rows = [t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0)) for t, c in ((left, "v"), (right, "q"))]
        picked, similarity = np.zeros((0, right.num_rows), np.int64), np.zeros((0, right.num_rows))
        if left.num_rows and right.num_rows:
            # component by component, so that equal vectors get equal sums wherever they stand
            total, norm = np.zeros((left.num_rows, right.num_rows)), [np.zeros(len(x)) for x in rows]
            for x, y in zip(rows[0].T, rows[1].T, strict=True):
                total += x[:, None] * y
                norm = [norm[0] + x * x, norm[1] + y * y]
            norms = np.sqrt(norm[0])[:, None] * np.sqrt(norm[1])
            total = np.divide(total, norms, out=np.zeros_like(total), where=norms != 0)
            picked = np.argsort(-total, axis=0, kind="stable")[:k]
            similarity = np.take_along_axis(total, picked, axis=0)
        asked = np.broadcast_to(np.arange(right.num_rows), picked.shape)
        return pa.table([right.column("query_id").take(pa.array(asked.ravel())), left.column("id").take(pa.array(picked.ravel())), pa.array(similarity.ravel())], ["query_id", "id", "similarity"])

    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((q, "query_id"), (v, "id"))}
    keys = ["size", "i", "j"]
    rows = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(best, f"query_id {kind['query_id']}, id {kind['id']}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", F.col("id").alias(id_col), F.round("similarity", 6).alias("similarity"), "place")
