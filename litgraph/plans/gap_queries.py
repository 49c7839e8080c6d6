"""Registered queries of centralities, walks and gaps, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import centrality as C
from ..operators import gaps as K
from ..operators import graph as G
from ..operators.relational import joinable
from .registry import GAPS_SQL, co_edges, query


def trade(g):
    """Nations as a small weighted graph over all line items: from the customer's nation to the supplier's, by number of items."""
    items = g.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    buyers = g.table("orders").join(g.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").cast("string").alias("source_id"))
    sellers = g.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("target_id"))
    return items.join(sellers, "l_suppkey").join(buyers, "l_orderkey").groupBy("source_id", "target_id").agg(F.sum("n").cast("double").alias("weight")).withColumn("relationship_type", F.lit("TRADES"))


@query()
def h9_pagerank_converged(g):
    return C.pagerank_converged(trade(g)).select("id", F.round("pagerank", 6).alias("pagerank"))


@query()
def h11_betweenness(g):
    return C.betweenness(trade(g)).select("id", F.round("betweenness", 6).alias("betweenness"))


@query()
def h12_eigenvector(g):
    return C.eigenvector(trade(g)).select("id", F.round("eigenvector", 6).alias("eigenvector"))


@query()
def h15_centrality_table(g):
    return C.centrality_table(trade(g))


@query()
def k3_bridge_concepts_by_betweenness(g):
    inside = g.table("nation").filter("n_regionkey in (0, 1)").select(F.col("n_nationkey").cast("string").alias("id"))
    return K.bridges_by_betweenness(C.betweenness(trade(g)), inside, 0.01)


AROUND = "relationship_type IN ('CITES', 'AUTHORED_BY')"
STEPS_SQL = f"e AS (SELECT source_id, target_id, relationship_type FROM relationships WHERE {AROUND}), st AS (SELECT source_id AS id, target_id AS other FROM e UNION SELECT target_id, source_id FROM e)"


@query(f"WITH {STEPS_SQL}, h1 AS (SELECT DISTINCT other AS id FROM st WHERE id = 'A1'), h2 AS (SELECT DISTINCT other AS id FROM h1 JOIN st USING (id)), n AS (SELECT id, min(hop) AS hop FROM (SELECT 'A1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1 ORDER BY hop, id LIMIT 8) SELECT source_id, target_id, relationship_type FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def h2_subgraph(g):
    return C.subgraph(g.relationships.filter(AROUND), g.entities.filter("id = 'A1'"), 2, 8)[1].select("source_id", "target_id", "relationship_type")


def level_sql(frontier: str) -> str:
    return f"SELECT source_id, target_id, target_id AS id FROM e WHERE source_id IN ({frontier}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY target_id) <= 4 UNION ALL SELECT source_id, target_id, source_id FROM e WHERE target_id IN ({frontier}) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY source_id) <= 4"


@query(f"WITH {STEPS_SQL}, f0 AS (SELECT 'A1' AS id), l1 AS ({level_sql('SELECT id FROM f0')}), f1 AS (SELECT DISTINCT id FROM l1 WHERE id NOT IN (SELECT id FROM f0)), l2 AS ({level_sql('SELECT id FROM f1')}) SELECT source_id, target_id, CAST(min(level) AS INT) AS level FROM (SELECT source_id, target_id, 1 AS level FROM l1 UNION ALL SELECT source_id, target_id, 2 FROM l2) GROUP BY 1, 2")
def h3_citation_ego(g):
    return C.citation_ego(g.relationships.filter(AROUND), g.entities.filter("id = 'A1'"), 2, 4).select("source_id", "target_id", "level")


TREE_SQL = "WITH RECURSIVE r AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 6 THEN p_partkey // 6 END AS parent_id, p_name AS name FROM part), t AS (SELECT id, 0 AS depth, name AS path FROM r WHERE parent_id IS NULL UNION ALL SELECT r.id, depth + 1, path || ' > ' || name FROM t JOIN r ON r.parent_id = t.id) SELECT * FROM t"


@query(TREE_SQL, views=False)
def h4_collection_tree(g):
    parent = F.when(F.col("p_partkey") >= 6, F.floor(F.col("p_partkey") / 6))
    return C.collection_tree(g.table("part").select(F.col("p_partkey").alias("id"), parent.alias("parent_id"), F.col("p_name").alias("name")))


@query("WITH w AS (SELECT paper_id AS work_id, lower(doi) AS doi FROM papers), l AS (SELECT DISTINCT work_id FROM w WHERE doi IN (SELECT lower(doi) FROM papers WHERE source = 'F')), e AS (SELECT paper_id AS source_id, concept_id AS target_id FROM paper_concepts WHERE paper_id IN (SELECT work_id FROM l) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY length(concept_id), concept_id) <= 3), n AS (SELECT work_id, true AS l FROM l UNION ALL SELECT target_id, false FROM e) SELECT work_id, max(l) AS is_local FROM n GROUP BY 1")
def h16_citation_network(g):
    references = g.paper_concepts.select(F.col("paper_id").alias("work_id"), F.length("concept_id").alias("place"), F.col("concept_id").alias("cited_id"))
    return C.citation_network(g.papers.filter("source = 'F'"), g.papers.select(F.col("paper_id").alias("work_id"), "doi"), references, 3)[0]


#: The first members of both clusters of each gap, after the common tables of the gaps.
SIDES_SQL = "f AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY n, id) AS place FROM concepts WHERE cluster_id IS NOT NULL QUALIFY place <= 5), sides AS (SELECT g.place AS gap_id, 'A' AS side, f.place, id FROM gaps g JOIN f ON cluster_id = a UNION ALL SELECT g.place, 'B', f.place, id FROM gaps g JOIN f ON cluster_id = b)"
HEAD, TAIL = GAPS_SQL.strip().rsplit("\nSELECT", 1)
GAP_VIEWS = f"{HEAD}, gaps AS (SELECT{TAIL}), {SIDES_SQL}, v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM concepts WHERE embedding IS NOT NULL), used AS (SELECT concept_id AS id, count(*) AS n FROM paper_concepts GROUP BY 1), bt AS (SELECT id, n / (SELECT max(n) FROM used) AS b FROM used)"
BRIDGES_SQL = f"{GAP_VIEWS}, near AS (SELECT x.id, s.gap_id, s.side, sum(list_cosine_similarity(x.e, y.e)) AS t FROM v x, sides s JOIN v y ON y.id = s.id GROUP BY 1, 2, 3), sn AS (SELECT gap_id, side, count(*) AS n FROM sides GROUP BY 1, 2), mn AS (SELECT id, gap_id, max(t / n) FILTER (side = 'A') AS a, max(t / n) FILTER (side = 'B') AS b FROM near JOIN sn USING (gap_id, side) GROUP BY 1, 2), br AS (SELECT gap_id, id, sqrt(a * mn.b) * (1 + coalesce(bt.b, 0)) AS score FROM mn LEFT JOIN bt USING (id) WHERE a * mn.b >= 0 AND NOT EXISTS (SELECT 1 FROM sides s WHERE s.gap_id = mn.gap_id AND s.id = mn.id) QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY score DESC, id) <= 5)"


def gaps_and_sides(g):
    members = g.concepts.filter("cluster_id is not null")
    gaps = G.durable(G.detect_gaps(co_edges(g), members.select("id", "cluster_id")).withColumn("gap_id", F.col("place")))
    return gaps, K.gap_sides(gaps, members)


def bridges(g, sides):
    used = g.paper_concepts.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("n"))
    most = used.agg(F.max("n").alias("m"))  # one row
    scores = used.crossJoin(F.broadcast(most)).select("id", (F.col("n") / F.col("m")).alias("betweenness"))
    return K.bridge_candidates(sides, g.concepts.select("id", "embedding"), scores)


@query(f"{BRIDGES_SQL} SELECT gap_id, id, round(score, 6) AS score FROM br")
def k2_bridge_candidates(g):
    return bridges(g, gaps_and_sides(g)[1]).select("gap_id", "id", F.round("score", 6).alias("score"))


EDGES_SQL = "pe AS (SELECT x.gap_id, x.id AS source_id, y.id AS target_id, list_cosine_similarity(a.e, b.e) AS similarity FROM sides x JOIN sides y ON y.gap_id = x.gap_id AND x.side = 'A' AND y.side = 'B' JOIN v a ON a.id = x.id JOIN v b ON b.id = y.id WHERE similarity >= 0.05 QUALIFY row_number() OVER (PARTITION BY x.gap_id ORDER BY similarity DESC, source_id, target_id) <= 5)"


@query(f"{GAP_VIEWS}, {EDGES_SQL} SELECT gap_id, source_id, target_id, round(similarity, 6) AS similarity FROM pe")
def k4_potential_edges(g):
    found = K.potential_edges(gaps_and_sides(g)[1], g.concepts.select("id", "embedding"), 5, 0.05)
    return found.select("gap_id", "source_id", "target_id", F.round("similarity", 6).alias("similarity"))


@query(f"{BRIDGES_SQL} SELECT br.gap_id, br.id AS source_id, s.id AS target_id, 'BRIDGES_GAP' AS relationship_type, 0.6::DOUBLE AS confidence, side FROM br JOIN sides s ON s.gap_id = br.gap_id AND s.place <= 3")
def k5_bridge_relationships(g):
    sides = gaps_and_sides(g)[1]
    return K.bridge_relationships(bridges(g, sides), sides)


@query(f"{BRIDGES_SQL}, {EDGES_SQL}, sz AS (SELECT cluster_id AS c, count(*) AS n FROM concepts WHERE cluster_id IS NOT NULL GROUP BY 1), rr AS (SELECT gap_id, avg(coalesce(b, 0)) FILTER (side = 'A') AS ra, avg(coalesce(b, 0)) FILTER (side = 'B') AS rb FROM sides LEFT JOIN bt USING (id) GROUP BY 1), l AS (SELECT gap_id, list(similarity ORDER BY similarity) AS s FROM pe GROUP BY 1), nb AS (SELECT gap_id, count(*) AS k FROM br GROUP BY 1), x AS (SELECT g.place AS gap_id, p.n * q.n AS prod, coalesce(k, 0) AS k, ra, rb, coalesce(s, []) AS s, gap_strength FROM gaps g JOIN sz p ON p.c = a JOIN sz q ON q.c = b JOIN rr ON rr.gap_id = g.place LEFT JOIN l ON l.gap_id = g.place LEFT JOIN nb ON nb.gap_id = g.place), y AS (SELECT gap_id, round(least(1.0, 0.25 * sqrt(prod / max(prod) OVER ()) + 0.25 * least(k, 10) / 10 + 0.3 * (ra + rb) / 2 + 0.2 * least(k, 8) / 8), 3) AS impact, round(least(1.0, CASE WHEN len(s) > 0 THEN 0.25 * len(list_filter(s, lambda z: z > 0.5)) / len(s) + 0.2 * s[len(s) // 2 + 1] + 0.2 * (s[len(s)] - s[1]) ELSE 0.075 END + 0.2 * least(k, 5) / 5 + 0.15 * (1 - gap_strength)), 3) AS feasibility FROM x) SELECT *, CASE WHEN impact >= 0.5 THEN 'high' ELSE 'low' END || '_impact_' || CASE WHEN feasibility >= 0.5 THEN 'high' ELSE 'low' END || '_feasibility' AS quadrant FROM y")
def k6_gap_frontier_scores(g):
    gaps, sides = gaps_and_sides(g)
    sizes = g.concepts.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    used = g.paper_concepts.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("n"))
    most = used.agg(F.max("n").alias("m"))  # one row
    ranks = sides.join(used, "id", "left").crossJoin(F.broadcast(most)).withColumn("x", F.coalesce(F.col("n") / F.col("m"), F.lit(0.0)))
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("x")))
    named = bridges(g, sides).groupBy("gap_id").agg(F.collect_list("id").alias("bridges"))  # at most five
    near = K.potential_edges(sides, g.concepts.select("id", "embedding"), 5, 0.05).groupBy("gap_id").agg(F.collect_list("similarity").alias("similarities"))  # at most five
    rows = gaps.join(sizes.select(F.col("cluster_id").alias("a"), F.col("n").alias("size_a")), "a").join(sizes.select(F.col("cluster_id").alias("b"), F.col("n").alias("size_b")), "b")
    rows = rows.join(ranks.groupBy("gap_id").agg(side("A").alias("rank_a"), side("B").alias("rank_b")), "gap_id").join(named, "gap_id", "left").join(near, "gap_id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return K.frontier_scores(rows.select("gap_id", "size_a", "size_b", none("bridges", "string"), "rank_a", "rank_b", none("similarities", "double"), "gap_strength"))


@query("WITH n AS (SELECT l_orderkey AS gap_id, l_linenumber AS place, upper(p_name) AS name FROM lineitem JOIN part ON p_partkey = l_partkey), k AS (SELECT lower(p_name) AS key, min('C' || p_partkey) AS id FROM part GROUP BY 1), f AS (SELECT gap_id, id, lead(id) OVER (PARTITION BY gap_id ORDER BY place, id) AS nx FROM n JOIN k ON key = lower(name)), p AS (SELECT DISTINCT gap_id, id AS source_id, nx AS target_id FROM f WHERE nx IS NOT NULL AND nx <> id), old AS (SELECT 'C' || p_partkey AS a, 'C' || (p_partkey + 3) AS b FROM part) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM old WHERE (a = source_id AND b = target_id) OR (b = source_id AND a = target_id))", views=False)
def k8_apply_bridge_hypothesis(g):
    part = g.table("part")
    called = joinable(part.select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("name")))
    names = g.table("lineitem").join(called, "l_partkey").select(F.col("l_orderkey").alias("gap_id"), F.col("l_linenumber").alias("place"), "name")
    entities = part.select(g.key("C", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    old = part.select(g.key("C", "p_partkey").alias("source_id"), F.concat(F.lit("C"), (F.col("p_partkey") + 3).cast("string")).alias("target_id"))
    return K.bridge_hypothesis(names, entities, old)


@query(f"{BRIDGES_SQL} SELECT br.gap_id, x.name AS source_name, y.name AS target_name, 0.6::DOUBLE AS confidence FROM br JOIN sides s ON s.gap_id = br.gap_id AND s.place <= 3 JOIN concepts x ON x.id = br.id JOIN concepts y ON y.id = s.id")
def k7_gap_repro_trace(g):
    gaps, sides = gaps_and_sides(g)
    edges = K.bridge_relationships(bridges(g, sides), sides).withColumn("weight", F.lit(1.0))
    return K.gap_trace(edges, g.concepts.select("id", "name"), gaps)


@query()
def k10_evaluate_gaps(g):
    """True gaps are brands, found gaps sizes: both over all parts, by type."""
    rows = g.table("part").select(F.col("p_type").alias("project_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    name = F.concat_ws(" ", "name", F.col("size").cast("string"))
    return K.evaluate_gaps(rows.select("project_id", F.col("brand").alias("gap"), name.alias("concept")), rows.select("project_id", F.col("size").alias("gap"), name.alias("concept")), 0.1)
