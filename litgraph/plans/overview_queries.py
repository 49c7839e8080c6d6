"""Registered queries of summaries and slices of the graph, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overview as V
from ..operators.relational import incident_edges
from .registry import query

MEMBERS_SQL = "members AS (SELECT id, cluster_id FROM concepts WHERE cluster_id IS NOT NULL)"
PAIRS_SQL = "links AS (SELECT a.id AS source_id, b.id AS target_id FROM concepts a JOIN concepts b ON b.n IN (a.n + 1, a.n + 7))"


def members(g):
    return g.concepts.filter("cluster_id is not null").select("id", "cluster_id")


def links(g):
    """Concepts joined to those whose number is one and seven higher."""
    a = g.concepts.select(F.col("id").alias("source_id"), F.explode(F.array(F.col("n") + 1, F.col("n") + 7)).alias("n"))
    return a.join(g.concepts.select(F.col("id").alias("target_id"), "n"), "n").select("source_id", "target_id", F.lit("RELATED_TO").alias("relationship_type"), F.lit(1.0).alias("weight"))


@query("SELECT p.paper_id, coalesce(string_agg(DISTINCT c.c_name, '|'), '') AS authors FROM papers p LEFT JOIN customer c ON 'A' || c.c_custkey = p.author_id GROUP BY 1")
def c2_papers_with_authors(g):
    rows = V.papers_with_authors(g.papers, g.relationships.filter("relationship_type = 'AUTHORED_BY'"), g.entities.filter("entity_type = 'Author'"))
    return rows.select("paper_id", F.array_join("authors", "|").alias("authors"))


@query("SELECT c.id, count(p.paper_id) AS n_papers FROM concepts c LEFT JOIN paper_concepts p ON p.concept_id = c.id GROUP BY 1")
def d2_concept_frequency(g):
    return V.counts_with_zero(g.concepts.select("id"), g.relationships.filter("relationship_type = 'DISCUSSES_CONCEPT'"), "target_id", "n_papers")


@query("SELECT 'F' || l_orderkey || '-' || l_linenumber AS source_id, 'C' || l_partkey AS target_id, CASE l_returnflag WHEN 'R' THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS relationship_type, coalesce(round(1 - l_discount, 6), 0.8) AS weight FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_partkey IN (SELECT n FROM concepts)")
def d11_finding_relationships(g):
    item = F.array(F.concat(F.lit("C"), F.col("l_partkey").cast("string")))
    findings = g.table("lineitem").select(
        F.concat(F.lit("F"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"),
        F.when(F.col("l_returnflag") == "R", item).alias("supports"), F.when(F.col("l_returnflag") == "A", item).alias("contradicts"), F.round(1 - F.col("l_discount"), 6).alias("confidence"),
    )
    return V.finding_relationships(findings, g.concepts)


@query("WITH e AS (SELECT source_id AS id FROM relationships UNION ALL SELECT target_id FROM relationships WHERE source_id <> target_id) SELECT n.id, n.name, count(e.id) AS degree FROM (SELECT id, name FROM entities WHERE entity_type IN ('Concept', 'Method')) n LEFT JOIN e ON e.id = n.id GROUP BY 1, 2 HAVING count(e.id) <= 25 ORDER BY degree, id LIMIT 10")
def d24_low_degree_entities(g):
    return V.lowest_degree(g.entities.filter("entity_type in ('Concept', 'Method')").select("id", "name"), g.relationships, 25, 10)


@query("SELECT m.id, m.name, count(p.paper_id) AS degree FROM entities m LEFT JOIN paper_methods p ON p.method_id = m.id WHERE entity_type = 'Method' GROUP BY 1, 2 ORDER BY degree, id LIMIT 5")
def d25_underused_methods(g):
    return V.lowest_degree(g.entities.filter("entity_type = 'Method'").select("id", "name"), g.relationships.filter("relationship_type = 'USES_METHOD'"), None, 5)


@query("SELECT entity_type, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM entities GROUP BY 1")
def d26_result_profile(g):
    return V.result_profile(g.entities)


@query("SELECT lang, count(*) AS n, round(count_if(source IS NOT NULL AND n_chars > 500) / count(*), 6) AS share FROM documents GROUP BY 1", views=False)
def d29_open_access_stats(g):
    return V.share_of(g.table("documents"), "lang", F.col("source").isNotNull() & (F.col("n_chars") > 500))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1", views=False)
def d30_section_summary(g):
    return g.table("documents").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT concept_id, count(DISTINCT paper_id) AS papers, count(DISTINCT year) AS years, count(DISTINCT source) AS sources FROM paper_concepts JOIN papers USING (paper_id) GROUP BY 1")
def d36_concept_evidence(g):
    return V.evidence_counts(g.paper_concepts.join(g.papers, "paper_id"), "concept_id", {"papers": "paper_id", "years": "year", "sources": "source"})


@query(f"WITH {MEMBERS_SQL}, {PAIRS_SQL}, e AS (SELECT a.cluster_id AS ca, b.cluster_id AS cb FROM links JOIN members a ON a.id = source_id JOIN members b ON b.id = target_id) SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, count(*) AS n_edges FROM e WHERE ca <> cb GROUP BY 1, 2")
def d41_cluster_adjacency(g):
    return V.cluster_adjacency(links(g), members(g))


@query(f"WITH {MEMBERS_SQL}, {PAIRS_SQL}, e AS (SELECT a.cluster_id AS ca, b.cluster_id AS cb FROM links JOIN members a ON a.id = source_id JOIN members b ON b.id = target_id) SELECT cluster_id, count(*) AS n_edges FROM (SELECT ca AS cluster_id FROM e UNION ALL SELECT cb FROM e WHERE ca <> cb) GROUP BY 1")
def d42_cluster_edge_counts(g):
    return V.cluster_edge_counts(links(g), members(g))


@query(f"WITH {MEMBERS_SQL}, {PAIRS_SQL}, i AS (SELECT a.cluster_id, count(*) AS m FROM links JOIN members a ON a.id = source_id JOIN members b ON b.id = target_id WHERE a.cluster_id = b.cluster_id GROUP BY 1), s AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1) SELECT cluster_id, n, CASE WHEN n > 1 THEN round(coalesce(m, 0) / (n * (n - 1) / 2), 6) ELSE 0.0 END AS density FROM s LEFT JOIN i USING (cluster_id)")
def j5_intra_cluster_density(g):
    return V.intra_cluster_density(links(g), members(g))


@query(f"WITH {MEMBERS_SQL} SELECT count(*) AS n, count(m.id) AS clustered, round(count(m.id) / count(*), 6) AS coverage FROM concepts LEFT JOIN members m USING (id)")
def j8_cluster_coverage(g):
    return V.cluster_coverage(g.concepts, members(g))


@query("SELECT id, score FROM (SELECT doc_id AS id, n_chars % 97 AS score, row_number() OVER (PARTITION BY lower(substr(text, 1, 100)) ORDER BY n_chars % 97 DESC, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1 ORDER BY score DESC, id LIMIT 50", views=False)
def e4_text_prefix_dedupe(g):
    rows = g.table("documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text", (F.col("n_chars") % 97).alias("score"))
    return V.prefix_dedupe(rows, 50).select("id", "score")


@query("WITH d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM relationships UNION ALL SELECT target_id FROM relationships WHERE source_id <> target_id) GROUP BY 1) SELECT id, degree FROM d QUALIFY row_number() OVER (ORDER BY degree DESC, id) <= ceil(count(*) OVER () * 0.2)")
def e7_top_percent_nodes(g):
    return V.top_percent(incident_edges(g.relationships).groupBy("id").agg(F.count("*").alias("degree")), "degree", 0.2)


@query("SELECT r.source_id, r.target_id, round(CASE WHEN 2001 - s.year > 5 THEN greatest(0.3, 1 - 0.1 * (2001 - s.year - 5)) ELSE 1.0 END, 6)::DOUBLE AS opacity FROM relationships r JOIN papers s ON s.paper_id = source_id JOIN papers t ON t.paper_id = target_id WHERE s.year <= 2001 AND t.year <= 2001")
def e10_graph_snapshot(g):
    return V.graph_snapshot(g.entities, g.relationships, 2001).select("source_id", "target_id", F.round("opacity", 6).alias("opacity"))


@query("SELECT year AS first_year, count(*) AS n FROM entities WHERE year IS NOT NULL GROUP BY 1")
def e12_first_year_histogram(g):
    return g.entities.filter("year is not null").groupBy(F.col("year").alias("first_year")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT id, count(*) AS k FROM (SELECT source_id AS id FROM relationships UNION ALL SELECT target_id FROM relationships WHERE source_id <> target_id) GROUP BY 1), gone AS (SELECT id FROM d ORDER BY k DESC, id LIMIT 20) SELECT source_id, target_id, relationship_type FROM relationships WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def f7_slice_graph(g):
    degrees = incident_edges(g.relationships).groupBy("id").agg(F.count("*").alias("degree"))
    return V.slice_graph(g.relationships, degrees, "degree", 20).select("source_id", "target_id", "relationship_type")


@query("WITH a AS (SELECT DISTINCT concept_id FROM paper_concepts JOIN papers USING (paper_id) WHERE year = 1995), b AS (SELECT DISTINCT concept_id FROM paper_concepts JOIN papers USING (paper_id) WHERE year = 2001), c AS (SELECT count(*) AS common FROM a SEMI JOIN b USING (concept_id)), s AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb) SELECT common, round(common / (na + nb - common), 6) AS jaccard, round(common / least(na, nb), 6) AS overlap FROM c, s")
def g4_set_similarity(g):
    rows = g.paper_concepts.join(g.papers, "paper_id")
    return V.set_similarity(rows.filter("year = 1995"), rows.filter("year = 2001"), "concept_id")


@query("WITH v AS (SELECT id FROM concepts WHERE embedding IS NOT NULL), t AS (SELECT DISTINCT concept_id AS id FROM paper_concepts) SELECT coalesce(v.id, t.id) AS id, CASE WHEN v.id IS NOT NULL THEN 'vector' ELSE 'graph' END AS found_by, CASE WHEN v.id IS NOT NULL AND t.id IS NOT NULL THEN 2 ELSE 1 END AS n_searches FROM v FULL JOIN t ON v.id = t.id")
def g5_hybrid_merge(g):
    return V.hybrid_merge(g.concepts.filter("embedding is not null"), g.paper_concepts.withColumnRenamed("concept_id", "id"))
