"""Registered queries of evidence, collections and records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evidence as E
from ..operators import graph as G
from .registry import CO, GAPS_SQL, co_edges, query


@query("SELECT id FROM concepts JOIN part ON p_partkey = n WHERE p_brand = 'Brand#5' OR p_type = 'PROMO'")
def b11_entities_in_collection(g):
    c = g.table("part").select(g.key("C", "p_partkey").alias("id"), F.array("p_brand", "p_type").alias("collections"))
    return E.entities_in_collection(c, "Brand#5").union(E.entities_in_collection(c, "PROMO")).select("id").distinct()


@query("WITH s AS (SELECT o_custkey AS project_id, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_orderkey AS paper FROM orders LEFT JOIN s ON project_id = o_custkey WHERE o_orderstatus <> 'F' AND (last IS NULL OR o_orderdate > last)", views=False)
def b12_papers_pending_sync(g):
    o = g.table("orders").select(F.col("o_orderkey").alias("paper"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "F", F.lit("known")).alias("key"))
    synced = o.filter("key is not null").groupBy("project_id").agg(F.max("created").alias("last"))
    return E.papers_pending_sync(o, synced).select("paper")


def turns(g):
    """Turns of conversations as chunks of a paper each."""
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return g.table("conversations").select(F.col("conv_id").alias("paper_id"), F.col("conv_id").alias("project_id"), name.alias("chunk_id"), F.col("turn").alias("place"), F.col("turn").alias("n"), "role", "text")


TURNS_SQL = "t AS (SELECT conv_id AS paper_id, conv_id || '-' || turn AS chunk_id, turn AS place, turn AS n, role, text FROM conversations)"


@query(f"WITH {TURNS_SQL}, e AS (SELECT DISTINCT conv_id AS id, unnest([conv_id || '-3', conv_id || '-0', conv_id || '-2', conv_id || '-99']) AS chunk_id FROM conversations) SELECT id, chunk_id, t.paper_id, p.title, place FROM e JOIN t USING (chunk_id) LEFT JOIN papers p ON p.n = t.paper_id QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, chunk_id) <= 2")
def c5_entity_source_chunks(g):
    listed = F.to_json(F.array(*(F.concat_ws("-", F.col("conv_id").cast("string"), F.lit(i)) for i in ("3", "0", "2", "99"))))
    entities = g.table("conversations").select(F.col("conv_id").alias("id"), listed.alias("chunk_ids")).distinct()
    return E.entity_source_chunks(entities, turns(g), g.papers.select(F.col("n").alias("paper_id"), "title"), 2)


HEAD, TAIL = GAPS_SQL.strip().rsplit("\nSELECT", 1)


@query(f"{HEAD}, gaps AS (SELECT{TAIL}), l AS (SELECT cluster_id, min(name) AS label FROM concepts GROUP BY 1) SELECT g.a, g.b, gap_strength, place AS gap_id, x.label AS label_a, y.label AS label_b FROM gaps g LEFT JOIN l x ON x.cluster_id = g.a LEFT JOIN l y ON y.cluster_id = g.b WHERE n_edges % 3 <> 0")
def c7_gap_overview(g):
    gaps = G.detect_gaps(co_edges(g), g.concepts.filter("cluster_id is not null").select("id", "cluster_id"))
    gaps = gaps.select("a", "b", "gap_strength", F.col("place").alias("gap_id"), F.when(F.col("n_edges") % 3 == 0, "dismissed").when(F.col("n_edges") % 3 == 1, "new").alias("status"))
    return E.gap_overview(gaps, g.concepts.groupBy("cluster_id").agg(F.min("name").alias("label"))).drop("status")


#: The first words of each turn, as entities of its conversation.
WORDS_SQL = "w AS (SELECT paper_id, place, string_split(text, ' ') AS w FROM t)"


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, e AS (SELECT DISTINCT paper_id, paper_id || ':' || lower(x) AS entity_id, lower(x) AS name FROM (SELECT paper_id, unnest(w[1:3]) AS x FROM w) WHERE length(x) >= 3) SELECT DISTINCT entity_id, chunk_id FROM e JOIN t USING (paper_id) WHERE contains(lower(text), lower(name))", views=False)
def c10_entity_chunk_links(g):
    words = turns(g).select("paper_id", F.explode(F.slice(F.split("text", " "), 1, 3)).alias("name")).select("paper_id", F.lower("name").alias("name")).distinct()
    return E.entity_chunk_links(words.withColumn("entity_id", F.concat_ws(":", F.col("paper_id").cast("string"), "name")), turns(g))


PAIRS_SQL = "p AS (SELECT DISTINCT paper_id, paper_id AS rel_id, w[1] AS a, w[2] AS b FROM w WHERE place = 0 AND len(w) > 1)"


def pairs(g):
    w = turns(g).filter("place = 0").withColumn("w", F.split("text", " ")).filter(F.size("w") > 1)
    return w.select("project_id", F.col("project_id").alias("rel_id"), F.get("w", F.lit(0)).alias("source_name"), F.get("w", F.lit(1)).alias("target_name")).distinct()


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {PAIRS_SQL} SELECT rel_id, chunk_id, n FROM p JOIN t USING (paper_id) WHERE contains(lower(text), lower(a)) AND contains(lower(text), lower(b)) QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY n DESC, chunk_id) <= 5", views=False)
def c11_co_mention_chunks(g):
    return E.co_mention_chunks(pairs(g), turns(g)).select("rel_id", "chunk_id", "n")


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {PAIRS_SQL}, s AS (SELECT paper_id AS rel_id, chunk_id, text FROM t WHERE length(text) > 600), c AS (SELECT rel_id, chunk_id, text FROM p JOIN t USING (paper_id) WHERE contains(lower(text), lower(a)) AND contains(lower(text), lower(b)) AND place % 2 = 0 QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY n DESC, chunk_id) <= 5), u AS (SELECT *, 0 AS tier, 'stored' AS source FROM s UNION ALL SELECT *, 1, 'co_mention' FROM c), b AS (SELECT * FROM u QUALIFY tier = min(tier) OVER (PARTITION BY rel_id)), r AS (SELECT DISTINCT paper_id AS rel_id FROM t) SELECT r.rel_id, chunk_id, substr(text, 1, 2000) AS text, coalesce(source, 'none') AS source FROM r LEFT JOIN b USING (rel_id)", views=False)
def g3_relationship_evidence(g):
    t = turns(g)
    stored = t.filter(F.length("text") > 600).withColumnRenamed("project_id", "rel_id")
    met = E.co_mention_chunks(pairs(g), t.filter("place % 2 = 0"))
    return E.evidence_cascade(t.select(F.col("project_id").alias("rel_id")), [("stored", stored), ("co_mention", met)])


@query(f"WITH {CO}, x AS (SELECT m.method_id AS source_id, c.concept_id AS target_id, count(*) AS n FROM paper_methods m JOIN paper_concepts c USING (paper_id) GROUP BY 1, 2 HAVING n >= 2) SELECT a AS source_id, b AS target_id, 'CO_OCCURS_WITH' AS relationship_type, w::DOUBLE AS weight FROM co WHERE w >= 2 UNION ALL SELECT source_id, target_id, 'USES_METHOD', round(least(1.0, n / 5), 6) FROM x")
def d13_build_all_relationships(g):
    left, right = g.paper_methods.withColumnRenamed("method_id", "source_id"), g.paper_concepts.withColumnRenamed("concept_id", "target_id")
    uses = A.cross_relationships(left, right, 2, 5.0, "USES_METHOD").withColumnRenamed("confidence", "weight")
    met = co_edges(g, 2)
    return E.build_all_relationships([met, uses, met.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relationship_type", "weight")])


@query("WITH e AS (SELECT DISTINCT p_partkey::VARCHAR AS source, 'Inventor' AS target_type, unnest(string_split(p_name, ' ')) AS target, 'INVENTED_BY' AS relationship_type, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT p_partkey::VARCHAR, 'Department', p_brand, 'DEVELOPED_IN', 0.8 FROM part) SELECT * FROM e", views=False)
def d33_typed_record_graph(g):
    parts = g.table("part").select("p_partkey", F.concat(F.split("p_name", " "), F.array(F.lit(" "))).alias("inventors"), F.array("p_brand", "p_brand").alias("departments"))
    return E.typed_record_graph(parts, "p_partkey", "Patent", {"inventors": ("Inventor", "INVENTED_BY", 1.0), "departments": ("Department", "DEVELOPED_IN", 0.8)})[1]


@query("SELECT CASE source WHEN 'F' THEN 'openalex' WHEN 'O' THEN 'semantic_scholar' ELSE 'zotero' END AS provider, paper_id AS work_id, title, year, doi, CASE WHEN source IN ('F', 'O') THEN n % 100 END AS citations, author_id || CASE WHEN source IN ('F', 'O') THEN '' ELSE ' Jr' END AS authors FROM papers")
def a4_normalize_api_works(g):
    p = g.papers.withColumn("c", F.col("n") % 100)
    doi = F.concat(F.lit("https://doi.org/"), F.upper("doi"))
    alex = F.to_json(F.struct(F.col("paper_id").alias("id"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), doi.alias("doi"), F.col("c").alias("cited_by_count"), F.array(F.struct(F.struct(F.col("author_id").alias("display_name")).alias("author"))).alias("authorships")))
    scholar = F.to_json(F.struct(F.col("paper_id").alias("paperId"), "title", "year", F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.col("c").alias("citationCount"), F.array(F.struct(F.col("author_id").alias("name"))).alias("authors")))
    data = F.struct("title", F.concat(F.lit("May 3, "), F.col("year").cast("string")).alias("date"), F.col("doi").alias("DOI"), F.array(F.struct(F.col("author_id").alias("firstName"), F.lit("Jr").alias("lastName"))).alias("creators"))
    zotero = F.to_json(F.struct(F.col("paper_id").alias("key"), data.alias("data")))
    by_source = lambda x, y, z: F.when(F.col("source") == "F", x).when(F.col("source") == "O", y).otherwise(z)
    rows = p.select(by_source(F.lit("openalex"), F.lit("semantic_scholar"), F.lit("zotero")).alias("provider"), by_source(alex, scholar, zotero).alias("json"))
    return E.normalize_api_works(rows).withColumn("authors", F.array_join("authors", "|"))


@query("WITH w AS (SELECT id, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS term FROM concepts), c AS (SELECT id, term, count(*) AS tf FROM w WHERE length(term) > 1 AND term <> 'brand' GROUP BY 1, 2), k AS (SELECT term, sum(tf) AS uses, count(*) AS df FROM c GROUP BY 1 ORDER BY uses DESC, term LIMIT 12), x AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM concepts)) / (1 + df)) + 1) AS x FROM c JOIN k USING (term)) SELECT id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM x")
def j4_tfidf_features(g):
    return E.tfidf_features(g.concepts.select("id", "name"), 12, ("brand",)).select("id", "term", F.round("weight", 6).alias("weight"))
