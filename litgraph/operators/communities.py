"""Communities of a graph by modularity: local moves, refinement and contraction, each an aggregation over edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .analytics import fallback_label
from .graph import PART_EDGES, components, durable, shared_folder

#: Most rounds of moves on a level.
ROUNDS = 10


def links_of(edges: DataFrame) -> DataFrame:
    """Undirected links (u, v, w) in both directions, weights of equal pairs summed; a self loop once, its weight twice."""
    w = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0)).cast("double")
    ends = edges.select("source_id", "target_id", w.alias("w")).filter("source_id is not null and target_id is not null")
    both = ends.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), "w").unionAll(ends.select("target_id", "source_id", "w"))
    return both.groupBy("u", "v").agg(F.sum("w").alias("w"))


def quality(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``labels`` (id, c) over links in both directions."""
    own = links.join(labels.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
    sums = own.groupBy("cu").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = sums.agg(F.sum("inside").alias("inside"), F.sum("k").alias("m2"), F.sum(F.col("k") * F.col("k")).alias("square")).first()
    return (row["inside"] / row["m2"] - resolution * row["square"] / row["m2"] ** 2) if row["m2"] else 0.0


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: unlike a checkpoint it keeps nothing of the plan that made it, which would grow from round to round."""
    path = f"{shared_folder(df.sparkSession)}/communities-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def options(links: DataFrame, state: DataFrame, total: float, resolution: float) -> DataFrame:
    """What each node of ``state`` (id, c, k) could gain: (id, own, k, whole, inside, stay, go, to).

    The worth of community c for a node i of degree k is w(i, c) - resolution * k * K / 2m, K being
    the degrees of c without i. ``to`` is the neighbouring community of the greatest worth,
    ties to the smallest. One aggregation over links gives all w(i, c).
    """
    sizes = state.groupBy("c").agg(F.sum("k").alias("whole"))
    near = links.filter("u <> v").join(state.select(F.col("id").alias("v"), "c"), "v").groupBy(F.col("u").alias("id"), "c").agg(F.sum("w").alias("w"))
    own = state.join(sizes, "c").select("id", F.col("c").alias("own"), "k", F.col("whole").alias("own_whole"))
    rated = near.join(sizes, "c").join(own, "id", "right")
    other = F.col("c") != F.col("own")
    worth = F.when(other, F.col("w") - resolution * F.col("k") * F.col("whole") / total)
    best = rated.groupBy("id", "own", "k", "own_whole").agg(
        F.coalesce(F.max(F.when(F.col("c") == F.col("own"), F.col("w"))), F.lit(0.0)).alias("inside"), F.max(worth).alias("go"), F.max_by("c", F.when(other, F.struct(worth, -F.col("c")))).alias("to")
    )
    stay = F.col("inside") - resolution * F.col("k") * (F.col("own_whole") - F.col("k")) / total
    return best.withColumn("stay", stay)


def local_moves(links: DataFrame, state: DataFrame, total: float, resolution: float, rounds: int = ROUNDS) -> DataFrame:
    """(id, c, k) after moves until no node gains, or rounds make the partition no better: the best partition seen."""
    size = links.agg(F.count("*").alias("n"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w"))).alias("loops")).first()
    loops, parts = size["loops"] or 0.0, 1 + size["n"] // PART_EDGES
    best, score, missed = state, -2.0, 0
    for turn in range(rounds + 1):
        # no more tasks than the graph is worth
        now = written(options(links, state, total, resolution).coalesce(parts))
        wants = F.coalesce(F.col("go") > F.col("stay") + 1e-12, F.lit(False))
        row = now.agg(F.sum("inside").alias("i"), F.sum(F.col("k") * F.col("own_whole")).alias("s"), F.count_if(wants).alias("n")).first()
        value = (row["i"] + loops) / total - resolution * row["s"] / total**2
        if value > score + 1e-12:
            best, score, missed = now.select("id", F.col("own").alias("c"), "k"), value, 0
        else:
            missed += 1
        if missed == 2 or not row["n"]:
            break
        # about half of the nodes may move in a round, so that neighbours do not swap for ever
        free = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
        state = now.select("id", F.when(wants & free, F.col("to")).otherwise(F.col("own")).alias("c"), "k")
    return best


def communities(edges: DataFrame, resolution: float = 1.0, levels: int = 6, rounds: int = ROUNDS) -> DataFrame:
    """Communities of an undirected weighted graph (source_id, target_id, weight): (id, community), named by their smallest id.

    On each level nodes move to the community of the best modularity gain; within each
    community the nodes then start alone again and merge only inside it (refinement); these
    parts become the nodes of the next level, which starts from the unrefined communities. A
    null or zero weight counts as 1. What is not connected inside is split at the end, so
    every community is connected. Nodes without an edge are not in it. All state is in tables:
    a round is two aggregations over links, whose size shrinks from level to level.
    """
    names = edges.select(F.explode(F.array("source_id", "target_id")).alias("name")).filter("name is not null").distinct()
    # long ids in the order of the names
    nodes = durable(names.repartitionByRange("name").sortWithinPartitions("name").select("name", F.monotonically_increasing_id().alias("id")))
    number = lambda c, o: nodes.select(F.col("name").alias(c), F.col("id").alias(o))
    plain = links_of(edges).withColumnsRenamed({"u": "source_id", "v": "target_id"})
    base = durable(plain.join(number("source_id", "u"), "source_id").join(number("target_id", "v"), "target_id").select("u", "v", "w"))
    links, place = base, nodes.select("id", F.col("id").alias("at"))
    labels = nodes.select("id", F.col("id").alias("c"))
    total = base.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return nodes.select(F.col("name").alias("id"), F.col("name").alias("community"))
    for _ in range(levels):
        degrees = links.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))
        state = local_moves(links, durable(labels.join(degrees, "id")), total, resolution, rounds)
        refined = refine(links, state, total, resolution, rounds)
        counts = refined.agg(F.count("*").alias("before"), F.countDistinct("part").alias("after")).first()
        place = durable(place.join(refined.select(F.col("id").alias("at"), "part", "c"), "at").select("id", F.col("part").alias("at"), "c"))
        found = place.select("id", "c")
        place = place.select("id", "at")
        if counts["after"] == counts["before"]:
            break
        side = lambda c, o: refined.select(F.col("id").alias(c), F.col("part").alias(o))
        links = durable(links.join(side("u", "pu"), "u").join(side("v", "pv"), "v").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(F.sum("w").alias("w")))
        labels = refined.groupBy(F.col("part").alias("id")).agg(F.min("c").alias("c"))
    whole = connected(base, found)
    named = whole.join(nodes, "id").select("name", "c")
    smallest = named.groupBy("c").agg(F.min("name").alias("community"))
    return durable(named.join(smallest, "c").select(F.col("name").alias("id"), "community"))


def refine(links: DataFrame, state: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """(id, c, part): parts of each community of ``state`` (id, c, k), merged from single nodes along links inside it."""
    c = lambda end, name: state.select(F.col("id").alias(end), F.col("c").alias(name))
    inside = written(links.join(c("u", "cu"), "u").join(c("v", "cv"), "v").filter("cu = cv").select("u", "v", "w"))
    alone = state.select("id", F.col("id").alias("c"), "k")
    parts = local_moves(inside, alone, total, resolution, rounds)
    return written(parts.select("id", F.col("c").alias("part")).join(state.select("id", "c"), "id"))


def connected(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (id, c) with what no link inside a community connects split; a community is named by its smallest id."""
    c = lambda end, name: labels.select(F.col("id").alias(end), F.col("c").alias(name))
    inside = links.filter("u < v").join(c("u", "cu"), "u").join(c("v", "cv"), "v").filter("cu = cv").select("u", "v")
    found = components(inside).select("id", F.col("component").alias("root"))
    return labels.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("c"))


def community_table(members: DataFrame, entities: DataFrame, least: int = 3, names: int = 10) -> DataFrame:
    """(community, size, label, detection_method, level) of the communities (id, community) with at least ``least`` members.

    The label comes from the first ``names`` members by id.
    """
    sizes = members.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    placed = members.join(entities.select("id", "name"), "id").withColumn("place", F.row_number().over(Window.partitionBy("community").orderBy("id")))
    first = placed.filter(F.col("place") <= names).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("n"))
    label = fallback_label(F.transform("n", lambda n: n["name"]))
    return sizes.join(first, "community", "left").select("community", "size", label.alias("label"), F.lit("leiden").alias("detection_method"), F.lit(0).alias("level"))
