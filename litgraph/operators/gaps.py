"""What could close the gaps between clusters. Gaps are few (``detect_gaps`` keeps ten), concepts many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import cosine_similarity, dot
from .graph import durable
from .relational import joinable, spread

#: Most gaps that are sent to every task at once.
MOST_GAPS = 1_000


def gap_sides(gaps: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    """(gap_id, side A or B, place, id): the first ``k`` members (cluster_id, id, n) of both clusters (a, b) of each gap."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("n", "id"))
    first = members.withColumn("place", place).filter(F.col("place") <= k).select("cluster_id", "place", "id")
    one = lambda side, c: gaps.select("gap_id", F.lit(side).alias("side"), F.col(c).alias("cluster_id")).join(first, "cluster_id").select("gap_id", "side", "place", "id")
    return one("A", "a").union(one("B", "b"))


def unit(vector) -> F.Column:
    """The vector in doubles at length 1; null if it has none."""
    v = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(dot(vector, vector))
    return F.when(length > 0, F.transform(F.arrays_zip(v.alias("v"), F.array_repeat(length, F.size(vector)).alias("l")), lambda p: p["v"] / p["l"]))


def bridge_candidates(sides: DataFrame, vectors: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best concepts outside both sides of each gap: (gap_id, id, score, place).

    score = sqrt(mean cosine to side A x mean cosine to side B) x (1 + betweenness); a negative
    product gives no score. The means are dot products with each side's sum of unit vectors.
    ``vectors`` is (id, embedding), ``scores`` (id, betweenness; 0 where it is missing).
    """
    units = vectors.filter("embedding is not null").select("id", unit(F.col("embedding")).alias("u")).filter("u is not null")
    sizes = sides.groupBy("gap_id", "side").agg(F.count("*").alias("_n"))
    sums = sides.join(units, "id").select("gap_id", "side", F.posexplode("u").alias("i", "x")).groupBy("gap_id", "side", "i").agg(F.sum("x").alias("x"))
    means = sums.groupBy("gap_id", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m")).join(sizes, ["gap_id", "side"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("m", "_n")))
    both = means.groupBy("gap_id").agg(of("A").alias("A"), of("B").alias("B")).filter("A is not null and B is not null")
    if both.count() > MOST_GAPS:
        raise ValueError(f"more than {MOST_GAPS} gaps at once")
    near = {s: dot(F.col("u"), F.col(f"{s}.m")) / F.col(f"{s}._n") for s in "AB"}
    rows = units.join(scores.select("id", "betweenness"), "id", "left").crossJoin(F.broadcast(both)).withColumn("_p", near["A"] * near["B"]).filter("_p >= 0")
    rows = rows.select("gap_id", "id", (F.sqrt("_p") * (1 + F.coalesce("betweenness", F.lit(0.0)))).alias("score")).join(F.broadcast(sides.select("gap_id", "id")), ["gap_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("gap_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def bridges_by_betweenness(scores: DataFrame, inside: DataFrame, least: float = 0.1, k: int = 10) -> DataFrame:
    """The ``k`` concepts of the greatest betweenness over ``least``; members of the gap's clusters (``inside``: id) count half: (id, score)."""
    known = scores.join(inside.select("id", F.lit(0.5).alias("_f")).distinct(), "id", "left")
    return known.select("id", (F.col("betweenness") * F.coalesce("_f", F.lit(1.0))).alias("score")).filter(F.col("score") > least).orderBy(F.desc("score"), "id").limit(k)


def potential_edges(sides: DataFrame, vectors: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """The ``k`` nearest pairs across each gap of at least this cosine: (gap_id, source_id, target_id, similarity, place)."""
    rows = sides.join(vectors.filter("embedding is not null"), "id")
    a, b = (rows.filter(F.col("side") == s).select("gap_id", F.col("id").alias(c), F.col("embedding").alias(f"_{s}")) for s, c in (("A", "source_id"), ("B", "target_id")))
    pairs = a.join(b, "gap_id").withColumn("similarity", cosine_similarity(F.col("_A"), F.col("_B"))).filter(F.col("similarity") >= least)
    place = F.row_number().over(Window.partitionBy("gap_id").orderBy(F.desc("similarity"), "source_id", "target_id"))
    return pairs.select("gap_id", "source_id", "target_id", "similarity", place.alias("place")).filter(F.col("place") <= k)


def bridge_relationships(bridges: DataFrame, sides: DataFrame, first: int = 3) -> DataFrame:
    """BRIDGES_GAP edges from each bridge (gap_id, id) to the first concepts of both sides."""
    ends = sides.filter(F.col("place") <= first).select("gap_id", F.col("id").alias("target_id"), "side")
    return bridges.select("gap_id", F.col("id").alias("source_id")).join(ends, "gap_id").select("gap_id", "source_id", "target_id", F.lit("BRIDGES_GAP").alias("relationship_type"), F.lit(0.6).alias("confidence"), "side")


def frontier_scores(gaps: DataFrame) -> DataFrame:
    """Impact, feasibility and quadrant of each gap.

    ``gaps`` has gap_id, size_a, size_b, bridges (names), rank_a and rank_b (mean PageRank of
    each side), similarities (of its potential edges) and gap_strength.
    """
    product = F.col("size_a") * F.col("size_b")
    most = gaps.agg(F.greatest(F.max(product), F.lit(1)).alias("_most"))  # one row
    n, kinds, s = F.size("bridges"), F.size(F.array_distinct("bridges")), F.array_sort("similarities")
    some = F.size(s) > 0
    impact = 0.25 * F.sqrt(product / F.col("_most")) + 0.25 * F.least(n, F.lit(10)) / 10 + 0.3 * (F.col("rank_a") + F.col("rank_b")) / 2 + 0.2 * F.least(kinds, F.lit(8)) / 8
    over = F.when(some, F.size(F.filter(s, lambda x: x > 0.5)) / F.size(s)).otherwise(0.3)
    median = F.when(some, F.get(s, F.floor(F.size(s) / 2).cast("int"))).otherwise(0.0)
    spread = F.when(some, F.array_max(s) - F.array_min(s)).otherwise(0.0)
    feasible = 0.25 * over + 0.2 * median + 0.2 * F.least(n, F.lit(5)) / 5 + 0.15 * (1 - F.col("gap_strength")) + 0.2 * spread
    level = lambda c: F.when(F.col(c) >= 0.5, "high").otherwise("low")
    inside = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 3)
    rows = gaps.crossJoin(F.broadcast(most)).select("gap_id", inside(impact).alias("impact"), inside(feasible).alias("feasibility"))
    return rows.withColumn("quadrant", F.concat(level("impact"), F.lit("_impact_"), level("feasibility"), F.lit("_feasibility")))


def bridge_hypothesis(names: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges between the concepts that a hypothesis names one after the other.

    ``names`` is (gap_id, place, name); a name stands for the smallest id that has it,
    without regard to case; names that no entity has are passed over, those of one place go by id. Edges that exist, in
    either direction, and loops are left out.
    """
    known = durable(entities.groupBy(F.lower("name").alias("_key")).agg(F.min("id").alias("id")))
    # names compress well and are put together to few tasks, which then hold far more than that
    found = spread(names.withColumn("_key", F.lower("name")).join(joinable(known), "_key").select("gap_id", "place", "id"), "gap_id")
    found = found.withColumn("_next", F.lead("id").over(Window.partitionBy("gap_id").orderBy("place", "id")))
    pairs = found.filter("_next is not null and _next <> id").select("gap_id", F.col("id").alias("source_id"), F.col("_next").alias("target_id")).distinct()
    old = edges.select("source_id", "target_id").union(edges.select("target_id", "source_id"))
    for end in ("source_id", "target_id"):  # edges of other ids can meet no pair
        old = old.join(joinable(known.select(F.col("id").alias(end))), end, "left_semi")
    old = durable(old.select("source_id", "target_id").distinct())
    return pairs.join(joinable(old), ["source_id", "target_id"], "left_anti").select("gap_id", "source_id", "target_id")


def gap_trace(edges: DataFrame, names: DataFrame, gaps: DataFrame) -> DataFrame:
    """BRIDGES_GAP edges (gap_id, source_id, target_id, confidence, weight) of ``gaps`` with both names; a missing confidence is the weight, or 0.5."""
    rows = edges.filter("relationship_type = 'BRIDGES_GAP'").join(gaps.select("gap_id"), "gap_id", "left_semi")
    called = lambda end: names.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
    rows = rows.join(called("source"), "source_id", "left").join(called("target"), "target_id", "left")
    return rows.select("gap_id", "source_name", "target_name", F.coalesce("confidence", "weight", F.lit(0.5)).alias("confidence"))


def evaluate_gaps(truth: DataFrame, found: DataFrame, least: float = 0.3) -> DataFrame:
    """Precision, recall and F1 of gaps by project, and how many matched.

    Both inputs are (project_id, gap, concept). Each true gap in order takes the free found gap
    that shares most with it (Jaccard of lower-case concepts, at least ``least``, the first of several).
    Only pairs that share a concept and reach ``least`` are matched, a project's in one task.
    """
    import pyarrow as pa

    t, f = (d.select("project_id", F.col("gap").alias(c), F.lower("concept").alias("concept")).distinct() for d, c in ((truth, "t"), (found, "f")))
    nt, nf = t.groupBy("project_id", "t").agg(F.count("*").alias("nt")), f.groupBy("project_id", "f").agg(F.count("*").alias("nf"))
    pairs = t.join(f, ["project_id", "concept"]).groupBy("project_id", "t", "f").agg(F.count("*").alias("n")).join(nt, ["project_id", "t"]).join(nf, ["project_id", "f"])
    pairs = pairs.select("project_id", "t", "f", (F.col("n") / (F.col("nt") + F.col("nf") - F.col("n"))).alias("j")).filter(F.col("j") >= least)

    def greedy(rows: pa.Table) -> pa.Table:
        taken, done = set(), set()
        for r in sorted(rows.to_pylist(), key=lambda r: (r["t"], -r["j"], r["f"])):
            if r["t"] not in done and r["f"] not in taken:
                done.add(r["t"])
                taken.add(r["f"])
        return pa.table([rows.column("project_id").slice(0, 1), pa.array([len(done)], pa.int64())], ["project_id", "matched"])

    kind = truth.schema["project_id"].dataType.simpleString()
    matched = pairs.groupBy("project_id").applyInArrow(greedy, f"project_id {kind}, matched long")
    n = nt.groupBy("project_id").agg(F.count("*").alias("n_true")).join(nf.groupBy("project_id").agg(F.count("*").alias("n_found")), "project_id", "full_outer")
    rows = n.join(matched, "project_id", "left").na.fill(0, ["n_true", "n_found", "matched"])
    share = lambda c: F.when(F.col(c) > 0, F.col("matched") / F.col(c)).otherwise(0.0)
    f1 = F.when(F.col("matched") > 0, 2 * F.col("matched") / (F.col("n_true") + F.col("n_found"))).otherwise(0.0)
    return rows.select("project_id", "n_true", "n_found", "matched", F.round(share("n_found"), 4).alias("precision"), F.round(share("n_true"), 4).alias("recall"), F.round(f1, 4).alias("f1"))
