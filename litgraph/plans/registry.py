"""Registered queries of the graph operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import relational as R
from ..operators import similarity as L
from .views import SQL, Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a function of the graph tables, and its SQL over them (or over the given tables alone)."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            ORACLE_SQL[f.__name__] = (f"WITH {SQL}, {text[5:]}" if text.startswith("WITH ") else f"WITH {SQL} {text}") if views else text
        return f

    return add


def ends(*columns: str):
    return [F.col(c) for c in columns]


@query("SELECT id, entity_type, name, n FROM entities WHERE entity_type = 'Concept' ORDER BY n DESC, id LIMIT 50 OFFSET 10")
def b1_list_entities(g):
    return R.list_entities(g.entities, "Concept", 50, 10).select("id", "entity_type", "name", "n")


@query("SELECT source_id, target_id, relationship_type FROM relationships WHERE relationship_type = 'CITES' ORDER BY 1, 2, 3 LIMIT 100 OFFSET 20")
def b2_list_relationships(g):
    return R.list_relationships(g.relationships, "CITES", 100, 20).select("source_id", "target_id", "relationship_type")


@query("WITH nodes AS (SELECT id FROM entities WHERE n % 3 <> 0) SELECT source_id, target_id, relationship_type FROM relationships WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)")
def b4_visible_edges(g):
    return R.visible_edges(g.entities.filter("n % 3 <> 0"), g.relationships).select("source_id", "target_id", "relationship_type")


@query("SELECT id, name FROM entities WHERE contains(lower(name), '#00000') ORDER BY CASE WHEN lower(name) = '#00000' THEN 0 ELSE 1 END, name, id LIMIT 40")
def b5_search_substring(g):
    return R.search_substring(g.entities, "#00000", 40).select("id", "name")


TRIGRAM_SQL = """
WITH words AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM concepts),
grams AS (SELECT DISTINCT id, substr('  ' || w || ' ', i, 3) AS g FROM (SELECT id, w, unnest(range(1, length(w) + 2)) AS i FROM words)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id)
"""


@query(TRIGRAM_SQL + ", q AS (SELECT unnest(['  b', ' br', 'bra', 'ran', 'and', 'nd ', '  1', ' 12', '12 ']) AS g), hit AS (SELECT id, count(*) AS k FROM grams JOIN q USING (g) GROUP BY id) SELECT id, round(k / (n + 9 - k), 6) AS similarity FROM hit JOIN sizes USING (id) WHERE round(k / (n + 9 - k), 6) > 0.1 ORDER BY 2 DESC, 1 LIMIT 100")
def b6_search_trigram(g):
    return R.search_trigram(g.concepts, "brand 12", 0.1, 100).select("id", "similarity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE 1 - l_discount * 6 >= 0.6", views=False)
def b7_low_trust_filter(g):
    rows = g.table("lineitem").withColumn("confidence", F.lit(None).cast("string")).withColumn("score", 1 - F.col("l_discount") * 6)
    return R.low_trust_filter(rows, ["confidence", "score"]).select("l_orderkey", "l_linenumber")


@query("SELECT id, year FROM entities WHERE year IS NULL OR year BETWEEN 1996 AND 1998")
def b8_year_range(g):
    return R.year_range(g.entities, 1996, 1998).select("id", "year")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events", views=False)
def b14_parse_properties(g):
    return g.table("events").select("event_id", F.from_json("props", "map<string,string>")["k"].try_cast("double").alias("k"))


@query("SELECT r.source_id, r.target_id, s.name AS source_name, t.name AS target_name FROM relationships r JOIN entities s ON s.id = source_id JOIN entities t ON t.id = target_id WHERE relationship_type = 'USES_METHOD'")
def c1_edges_with_names(g):
    return R.edges_with_names(g.relationships.filter("relationship_type = 'USES_METHOD'"), g.entities).select("source_id", "target_id", "source_name", "target_name")


@query("SELECT e.id, count(r.source_id) AS n_edges FROM entities e LEFT JOIN relationships r ON r.source_id = e.id OR (r.target_id = e.id AND r.source_id <> r.target_id) WHERE e.entity_type = 'Author' GROUP BY e.id")
def c3_incident_edges(g):
    authors = g.entities.filter("entity_type = 'Author'").select("id")
    return authors.join(R.incident_edges(g.relationships), "id", "left").groupBy("id").agg(F.count("other").alias("n_edges"))


@query(TRIGRAM_SQL + ", keyed AS (SELECT g.id, g.g, c.source, c.name FROM grams g JOIN concepts c USING (id) WHERE c.n % 4 = 0), pairs AS (SELECT a.id AS id1, b.id AS id2, count(*) AS k FROM keyed a JOIN keyed b ON a.g = b.g AND a.source = b.source AND a.id < b.id GROUP BY 1, 2) SELECT id1, id2, round(k / (x.n + y.n - k), 6) AS similarity FROM pairs JOIN sizes x ON x.id = id1 JOIN sizes y ON y.id = id2 WHERE round(k / (x.n + y.n - k), 6) >= 0.85".replace(" WHERE c.n % 4 = 0", ""))
def c6_duplicate_entity_pairs(g):
    return R.duplicate_pairs(g.concepts, ["source"], 0.85).select("id1", "id2", "similarity")


@query("SELECT c.id, c.name, c.cluster_id, count(p.paper_id) AS n_papers FROM concepts c LEFT JOIN paper_concepts p ON p.concept_id = c.id GROUP BY 1, 2, 3")
def c8_concept_overview(g):
    n = g.paper_concepts.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("k"))
    return g.concepts.join(n, "id", "left").select("id", "name", "cluster_id", F.coalesce("k", F.lit(0)).alias("n_papers"))


@query("SELECT count(*) AS n_papers, count_if(EXISTS (SELECT 1 FROM paper_concepts c WHERE c.paper_id = p.paper_id)) AS covered FROM papers p")
def c9_paper_coverage(g):
    covered = g.papers.join(g.paper_concepts, "paper_id", "left_semi").agg(F.count("*").alias("covered"))
    return g.papers.agg(F.count("*").alias("n_papers")).crossJoin(covered)


@query("WITH m AS (SELECT c.id, c.name, p.paper_id FROM concepts c JOIN paper_concepts p ON p.concept_id = c.id WHERE c.source = 'ECONOMY' OR c.n % 50 = 0) SELECT DISTINCT a.id AS source_id, b.id AS target_id, 'SAME_AS' AS relationship_type FROM m a JOIN m b ON a.name = b.name AND a.id < b.id AND a.paper_id <> b.paper_id".replace(" WHERE c.source = 'ECONOMY' OR c.n % 50 = 0", ""))
def c13_cross_paper_links(g):
    m = g.concepts.join(g.paper_concepts.withColumnRenamed("concept_id", "id"), "id")
    return R.cross_paper_links(m.select("id", "name", F.lit("Concept").alias("entity_type"), "paper_id"))


@query("WITH a AS (SELECT DISTINCT lower(name) AS name FROM concepts WHERE n % 2 = 0), b AS (SELECT DISTINCT lower(name) AS name FROM concepts WHERE n % 2 = 1) SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' ELSE 'common' END AS where_found FROM a FULL JOIN b ON a.name = b.name")
def c15_compare_projects(g):
    return R.compare_names(g.concepts.filter("n % 2 = 0"), g.concepts.filter("n % 2 = 1"))


@query("SELECT 'node' AS part, entity_type AS kind, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'edge', relationship_type, count(*) FROM relationships GROUP BY 2")
def d1_graph_stats(g):
    nodes = g.entities.groupBy(F.lit("node").alias("part"), F.col("entity_type").alias("kind")).agg(F.count("*").alias("n"))
    return nodes.union(g.relationships.groupBy(F.lit("edge"), F.col("relationship_type")).agg(F.count("*")))


@query("SELECT c.id, count(p.paper_id) AS n_papers FROM concepts c LEFT JOIN paper_concepts p ON p.concept_id = c.id GROUP BY c.id HAVING count(p.paper_id) < 22")
def d3_underconnected_concepts(g):
    return c8_concept_overview(g).filter("n_papers < 22").select("id", "n_papers")


@query("WITH s AS (SELECT a.paper_id, b.paper_id AS other, count(DISTINCT a.concept_id) AS shared FROM paper_concepts a JOIN paper_concepts b ON a.concept_id = b.concept_id AND a.paper_id <> b.paper_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY shared DESC, other) AS place FROM s) SELECT paper_id, other, shared FROM r WHERE place <= 3")
def d5_similar_papers(g):
    return R.similar_by_shared(g.paper_concepts, 3)


@query("SELECT a.concept_id AS a, b.concept_id AS b, count(*) AS n_papers, round(least(1.0, count(*) / 10.0), 6) AS confidence, array_to_string(list_sort(list(a.paper_id))[1:10], ',') AS papers FROM paper_concepts a JOIN paper_concepts b ON a.paper_id = b.paper_id AND a.concept_id < b.concept_id GROUP BY 1, 2 HAVING count(*) >= 2")
def d6_cooccurrence_relationships(g):
    return A.cooccurrence(g.paper_concepts, "concept_id").withColumn("papers", F.array_join("papers", ","))


@query("SELECT a.concept_id AS a, b.concept_id AS b, min(a.paper_id) AS first_paper FROM paper_concepts a JOIN paper_concepts b ON a.paper_id = b.paper_id AND a.concept_id < b.concept_id GROUP BY 1, 2")
def d7_cooccurrence_first_seen(g):
    return A.pairs_per_paper(g.paper_concepts, "concept_id").groupBy("a", "b").agg(F.min("paper_id").alias("first_paper"))


@query("WITH n AS (SELECT concept_id, count(*) AS n FROM paper_concepts GROUP BY 1), s AS (SELECT a.concept_id AS a, b.concept_id AS b, count(*) AS shared FROM paper_concepts a JOIN paper_concepts b ON a.paper_id = b.paper_id AND a.concept_id < b.concept_id GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON x.concept_id = a JOIN n y ON y.concept_id = b")
def d8_cooccurrence_jaccard(g):
    return A.cooccurrence_jaccard(g.paper_concepts, "concept_id", 2)


@query("SELECT method_id AS source_id, concept_id AS target_id, 'APPLIES_TO' AS relationship_type, round(least(1.0, count(*) / 5.0), 6) AS confidence FROM paper_methods JOIN paper_concepts USING (paper_id) GROUP BY 1, 2 HAVING count(*) >= 2")
def d9_method_concept_relationships(g):
    return A.cross_relationships(g.paper_methods.withColumnRenamed("method_id", "source_id"), g.paper_concepts.withColumnRenamed("concept_id", "target_id"), 2, 5.0, "APPLIES_TO")


@query("WITH e AS (SELECT a.concept_id AS s, b.concept_id AS t, least(1.0, count(*) / 10.0) AS w FROM paper_concepts a JOIN paper_concepts b ON a.paper_id = b.paper_id AND a.concept_id <> b.concept_id GROUP BY 1, 2) SELECT least(s, t) AS source_id, greatest(s, t) AS target_id, 'CO_OCCURS_WITH' AS relationship_type, round(max(w), 6) AS weight FROM e GROUP BY 1, 2")
def d12_dedupe_relationships(g):
    one = A.cooccurrence(g.paper_concepts, "concept_id", 1).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("CO_OCCURS_WITH").alias("relationship_type"), F.col("confidence").alias("weight"))
    return R.dedupe_relationships(one.union(one.select("target_id", "source_id", "relationship_type", "weight")))


@query("SELECT min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n_years, count(year) AS with_year, count_if(year IS NULL) AS without_year FROM entities")
def d14_temporal_stats(g):
    return g.entities.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("year").alias("n_years"), F.count("year").alias("with_year"), F.count_if(F.col("year").isNull()).alias("without_year"))


@query("SELECT concept_id AS id, min(year) AS first_seen_year, max(year) AS last_seen_year FROM paper_concepts JOIN papers USING (paper_id) GROUP BY 1")
def d15_backfill_temporal(g):
    return g.paper_concepts.join(g.papers.select("paper_id", "year"), "paper_id").groupBy(F.col("concept_id").alias("id")).agg(F.min("year").alias("first_seen_year"), F.max("year").alias("last_seen_year"))


@query("SELECT user_id, api_type, CAST(ts AS DATE) AS day, CAST(sum(call_count) AS BIGINT) AS calls, count(*) AS requests, round(avg(response_time_ms), 6) AS mean_ms, count_if(response_status >= 400) AS errors FROM usage WHERE CAST(ts AS DATE) >= DATE '2024-01-05' GROUP BY 1, 2, 3")
def d16_usage_daily(g):
    return A.usage_daily(g.usage, "2024-01-05")


@query("WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(call_count) AS BIGINT) AS used, CASE user_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 20 END AS quota FROM usage GROUP BY 1, 2, 4) SELECT user_id, day, used, quota, greatest(quota - used, 0) AS remaining, used >= quota AS exceeded, used > 0.8 * quota AS warning FROM d")
def d17_quota_status(g):
    quota = F.when(F.col("user_id") % 3 == 0, 5).when(F.col("user_id") % 3 == 1, 10).otherwise(20)
    used = g.usage.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("call_count").alias("used")).withColumn("quota", quota)
    return used.withColumns({"remaining": F.greatest(F.col("quota") - F.col("used"), F.lit(0)), "exceeded": F.col("used") >= F.col("quota"), "warning": F.col("used") > 0.8 * F.col("quota")})


@query("SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY 1", views=False)
def d20_conversation_summaries(g):
    return g.table("conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))


@query("WITH d AS (SELECT n, (doi IS NOT NULL AND min(n) OVER (PARTITION BY doi) < n) OR min(n) OVER (PARTITION BY title) < n AS dup FROM papers) SELECT count(*) AS identified, count_if(dup) AS duplicates, count_if(NOT dup) AS screened FROM d")
def d22_prisma_flow(g):
    return A.prisma_flow(g.papers)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY api_type ORDER BY response_time_ms, id) AS r, count(*) OVER (PARTITION BY api_type) AS k FROM usage) SELECT api_type, count(*) AS n, round(avg(response_time_ms), 6) AS mean_ms, round(max(CASE WHEN r = floor(k * 0.95) + 1 THEN response_time_ms END), 6) AS p95_ms, round(max(response_time_ms), 6) AS max_ms FROM r GROUP BY 1")
def d27_latency_summary(g):
    return A.latency_summary(g.usage, ["api_type"])


@query("SELECT response_status, api_type, count(*) AS n, round(avg(response_time_ms), 6) AS mean_ms, max(ts) AS last_ts FROM usage GROUP BY 1, 2")
def d28_error_breakdown(g):
    return g.usage.groupBy("response_status", "api_type").agg(F.count("*").alias("n"), F.round(F.avg("response_time_ms"), 6).alias("mean_ms"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))


@query("SELECT count(*) AS total, count(embedding) AS with_vector, CASE WHEN count(embedding) > 0 THEN 'ready' ELSE 'pending' END AS state FROM concepts")
def d38_embedding_coverage(g):
    return g.concepts.agg(F.count("*").alias("total"), F.count("embedding").alias("with_vector"), F.when(F.count("embedding") > 0, "ready").otherwise("pending").alias("state"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn, role, text) AS thread FROM conversations GROUP BY 1", views=False)
def d39_conversation_threads(g):
    c = g.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["text"]).cast("string"))), "|").alias("thread"))


@query("SELECT y AS year, count(paper_id) AS n FROM range(1990, 2031) t(y) LEFT JOIN papers ON year = y GROUP BY 1")
def d43_papers_per_year(g):
    years = g.spark.range(1990, 2031).select(F.col("id").alias("year"))
    n = g.papers.groupBy("year").agg(F.count("*").alias("k"))
    return years.join(n, "year", "left").select("year", F.coalesce("k", F.lit(0)).alias("n"))


@query("WITH c AS (SELECT year, count(*) AS new_count FROM papers GROUP BY 1), t AS (SELECT year, string_agg(title, '|' ORDER BY title, paper_id) AS top_names FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY title, paper_id) AS r FROM papers) WHERE r <= 5 GROUP BY 1) SELECT c.year, new_count, CAST(sum(new_count) OVER (ORDER BY c.year) AS BIGINT) AS cumulative, top_names FROM c JOIN t USING (year)")
def e1_temporal_timeline(g):
    return A.temporal_timeline(g.papers.select(F.col("paper_id").alias("id"), F.col("title").alias("name"), "year"))


@query("WITH f AS (SELECT concept_id AS id, min(year) AS first, max(year) AS last, count(*) AS papers FROM paper_concepts JOIN papers USING (paper_id) GROUP BY 1), k AS (SELECT *, CASE WHEN first >= (SELECT max(last) FROM f) - 2 AND papers >= 2 THEN 'emerging' WHEN last <= (SELECT max(last) FROM f) - 3 THEN 'declining' WHEN papers >= 3 THEN 'stable' END AS trend FROM f) SELECT * FROM k WHERE trend IS NOT NULL")
def e2_temporal_trends(g):
    rows = g.paper_concepts.join(g.papers.select("paper_id", "year"), "paper_id").groupBy(F.col("concept_id").alias("id"))
    return A.temporal_trends(rows.agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("papers")))


@query("WITH r AS (SELECT doc_id, lang, n_chars, sum(length(text) // 4) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS t FROM documents) SELECT lang, doc_id FROM r WHERE t <= 40000", views=False)
def e5_context_budget(g):
    return R.context_budget(g.table("documents"), ["lang"], 40000, score="n_chars", tie="doc_id").select("lang", "doc_id")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3", views=False)
def e6_search_by_section(g):
    return R.top_by(g.table("documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id")


@query("SELECT cluster_id, count(*) AS size, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM concepts WHERE cluster_id IS NOT NULL GROUP BY 1")
def e11_cluster_share(g):
    from pyspark.sql.window import Window

    n = g.concepts.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size"))
    return n.withColumn("percent", F.round(100 * F.col("size") / F.sum("size").over(Window.partitionBy()), 6))


COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"WITH r AS (SELECT b.n AS query_id, a.id, {COSINE} AS s, row_number() OVER (PARTITION BY b.n ORDER BY {COSINE} DESC, a.id) AS place FROM concepts a, concepts b WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND b.n IN (1, 2, 3)) SELECT query_id, id, round(s, 6) AS similarity, place FROM r WHERE place <= 10")
def f3_vector_topk_batch(g):
    q = g.concepts.filter("n in (1, 2, 3) and embedding is not null").select(F.col("n").alias("query_id"), F.col("embedding").alias("q"))
    return G.vector_topk(g.concepts.select("id", "embedding"), q, 10)


@query(f"WITH r AS (SELECT b.n AS query_id, a.id, {COSINE} AS s, row_number() OVER (PARTITION BY b.n ORDER BY {COSINE} DESC, a.id) AS place FROM concepts a, concepts b WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND b.n % 100 = 0) SELECT query_id, id, round(s, 6) AS similarity, place FROM r WHERE place <= 10")
def f3_vector_topk_hundredths(g):
    """Every concept whose number 100 divides as a query against all concepts."""
    q = g.concepts.filter("n % 100 = 0 and embedding is not null").select(F.col("n").alias("query_id"), F.col("embedding").alias("q"))
    return G.vector_topk_blocks(g.concepts.select("id", "embedding"), q, 10)


@query("WITH a AS (SELECT paper_id FROM paper_concepts WHERE concept_id IN (SELECT id FROM concepts WHERE cluster_id = 1)), b AS (SELECT paper_id FROM paper_concepts WHERE concept_id IN (SELECT id FROM concepts WHERE cluster_id = 2)) SELECT coalesce(x.paper_id, y.paper_id) AS paper_id, CASE WHEN x.paper_id IS NOT NULL AND y.paper_id IS NOT NULL THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS relevance FROM (SELECT DISTINCT * FROM a) x FULL JOIN (SELECT DISTINCT * FROM b) y ON x.paper_id = y.paper_id")
def g2_evidence_relevance_union(g):
    of = lambda c: g.paper_concepts.join(g.concepts.filter(f"cluster_id = {c}").select(F.col("id").alias("concept_id")), "concept_id", "left_semi").select("paper_id").distinct()
    x, y = of(1).withColumn("x", F.lit(True)), of(2).withColumn("y", F.lit(True))
    return x.join(y, "paper_id", "full_outer").select("paper_id", F.when(F.col("x") & F.col("y"), 0.9).otherwise(0.6).alias("relevance"))


@query("SELECT p_partkey, trim(regexp_replace(translate(lower(p_name || '_' || p_brand), '_-/().', '      '), '\\s+', ' ', 'g')) AS surface, regexp_replace(lower(p_name || '_' || p_brand), '[^a-z0-9]', '', 'g') AS acronym FROM part", views=False)
def s1_normalize_surface(g):
    name = F.concat_ws("_", "p_name", "p_brand")
    return g.table("part").select("p_partkey", S.normalize_surface(name).alias("surface"), S.acronym_key(name).alias("acronym"))


@query("SELECT paper_id, '10.1/' || substr(author_id, 2) || '.' || (n % 7) AS doi FROM papers")
def s6_normalize_doi(g):
    return g.papers.select("paper_id", S.normalize_doi(F.concat(F.lit("HTTPS://doi.org/"), "doi")).alias("doi"))


@query("SELECT a.p_partkey AS p1, b.p_partkey AS p2, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey", views=False)
def s5_levenshtein(g):
    p = g.table("part").filter("p_brand is not null and p_size is not null")
    pairs = R.member_pairs(p.select(F.col("p_partkey").alias("id"), F.struct("p_brand", "p_size").alias("key"), F.col("p_name").alias("name")))
    return pairs.select(F.col("id1").alias("p1"), F.col("id2").alias("p2"), F.levenshtein("name1", "name2").alias("distance"))


@query(f"SELECT a.vec_id AS v1, b.vec_id AS v2, round({COSINE}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND {COSINE} >= 0.3", views=False)
def c12_semantic_relationships(g):
    pairs = L.cosine_pairs_in_blocks(g.table("embeddings").filter("label is not null"), 0.3, ["label"], "vec_id")
    return pairs.select(F.col("id1").alias("v1"), F.col("id2").alias("v2"), F.round("similarity", 6).alias("similarity"))


HOP_SQL = """
WITH steps AS (SELECT source_id AS id, target_id AS other FROM relationships WHERE relationship_type IN ('CITES', 'AUTHORED_BY') UNION SELECT target_id, source_id FROM relationships WHERE relationship_type IN ('CITES', 'AUTHORED_BY')),
h0 AS (SELECT 'A1' AS id), h1 AS (SELECT DISTINCT other AS id FROM h0 JOIN steps USING (id)), h2 AS (SELECT DISTINCT other AS id FROM h1 JOIN steps USING (id)), h3 AS (SELECT DISTINCT other AS id FROM h2 JOIN steps USING (id))
SELECT id, CAST(min(hop) AS INT) AS hop FROM (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) GROUP BY id
"""


@query(HOP_SQL)
def h1_multi_hop(g):
    return G.multi_hop(g.relationships.filter("relationship_type in ('CITES', 'AUTHORED_BY')"), g.entities.filter("id = 'A1'"), 3)


@query("WITH e AS (SELECT source_id AS id FROM relationships UNION ALL SELECT target_id FROM relationships WHERE source_id <> target_id), d AS (SELECT id, count(*) AS degree FROM e GROUP BY 1) SELECT id, degree, round(degree / (SELECT max(degree) FROM d), 6) AS centrality FROM d")
def h7_degree_centrality(g):
    return G.degree(g.relationships)


@query("WITH e AS (SELECT source_id, target_id FROM relationships WHERE relationship_type = 'CITES') SELECT id, min(id) OVER (PARTITION BY substr(id, 1, 0) || a) AS component FROM (SELECT p.paper_id AS id, p.author_id AS a FROM papers p WHERE p.paper_id IN (SELECT source_id FROM e UNION SELECT target_id FROM e))")
def h5_connected_components(g):
    return G.connected_components(g.relationships.filter("relationship_type = 'CITES'"))


@query()
def h8_pagerank_fixed(g):
    return G.pagerank(g.relationships.filter("relationship_type in ('CITES', 'AUTHORED_BY')"))


CO = "co AS (SELECT a.concept_id AS a, b.concept_id AS b, count(*) AS w FROM paper_concepts a JOIN paper_concepts b ON a.paper_id = b.paper_id AND a.concept_id < b.concept_id GROUP BY 1, 2)"


def co_edges(g, least: int = 1, among: DataFrame | None = None) -> DataFrame:
    """Pairs of concepts of a paper, ``among`` those with these ids if given: others are left out before they are paired."""
    used = g.paper_concepts
    if among is not None:
        used = used.join(among.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    rows = A.pairs_per_paper(used, "concept_id").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight")).filter(F.col("weight") >= least)
    return rows.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("CO_OCCURS_WITH").alias("relationship_type"), "weight")


@query(f"WITH {CO}, e AS (SELECT a, b FROM co WHERE w >= 2), steps AS (SELECT a AS id, b AS o FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT id, count(*) AS d FROM steps GROUP BY 1), t AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), tn AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1) SELECT d.id, round(CASE WHEN d < 2 THEN 0.0 ELSE 1 - coalesce(t, 0) / (d * (d - 1) / 2) END, 6) AS gap_score FROM d LEFT JOIN tn USING (id)")
def h10_neighbour_gap(g):
    return G.neighbour_gap(co_edges(g, 2))


@query(f"WITH {CO}, e AS (SELECT x.cluster_id AS ca, y.cluster_id AS cb, w FROM co JOIN concepts x ON x.id = a JOIN concepts y ON y.id = b WHERE x.cluster_id IS NOT NULL AND y.cluster_id IS NOT NULL), d AS (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM e UNION ALL SELECT cb, w FROM e) GROUP BY 1) SELECT round(sum(CASE WHEN ca = cb THEN w ELSE 0 END) / sum(w) - (SELECT sum(d * d) FROM d) / (4.0 * sum(w) * sum(w)), 6) AS modularity FROM e")
def h13_modularity(g):
    return G.modularity(co_edges(g), g.concepts.filter("cluster_id is not null").select("id", "cluster_id"))


GAPS_SQL = f"""
WITH {CO}, m AS (SELECT id, cluster_id FROM concepts WHERE cluster_id IS NOT NULL), s AS (SELECT cluster_id, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT x.cluster_id AS a, y.cluster_id AS b, x.n AS na, y.n AS nb FROM s x JOIN s y ON x.cluster_id < y.cluster_id),
k AS (SELECT least(x.cluster_id, y.cluster_id) AS a, greatest(x.cluster_id, y.cluster_id) AS b, count(*) AS n_edges FROM co JOIN m x ON x.id = co.a JOIN m y ON y.id = co.b WHERE x.cluster_id <> y.cluster_id GROUP BY 1, 2),
r AS (SELECT a, b, coalesce(n_edges, 0) AS n_edges, coalesce(n_edges, 0) / (na * nb) AS s FROM p LEFT JOIN k USING (a, b)),
o AS (SELECT *, row_number() OVER (ORDER BY s, a, b) AS place, (SELECT least(0.3, quantile_cont(s, 0.25) + 0.1) FROM r) AS cut FROM r)
SELECT a, b, n_edges, round(s, 9) AS gap_strength, place FROM o WHERE (s < cut OR place <= 3) AND place <= 10
"""


@query(GAPS_SQL)
def k1_detect_gaps(g):
    return G.detect_gaps(co_edges(g), g.concepts.filter("cluster_id is not null").select("id", "cluster_id"))


@query("WITH v AS (SELECT label AS cluster_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT cluster_id, e, sqrt(list_dot_product(e, e)) AS n FROM v), x AS (SELECT cluster_id, unnest(e) / n AS x, generate_subscripts(e, 1) AS i FROM u), s AS (SELECT cluster_id, i, sum(x) AS s, count(*) AS n FROM x GROUP BY 1, 2) SELECT cluster_id, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS coherence FROM s GROUP BY 1", views=False)
def j7_cluster_coherence(g):
    return G.cluster_coherence(g.table("embeddings").select(F.col("label").alias("cluster_id"), "embedding"))


@query("WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1), r AS (SELECT *, sum(size) OVER () AS total, count(*) OVER () AS k, row_number() OVER (ORDER BY size, label) AS r FROM s) SELECT max(k) AS n_clusters, round(sum(-size / total * ln(size / total)), 6) AS entropy, round(sum(-size / total * ln(size / total)) / ln(max(k)), 6) AS normalised, round(max(size / total), 6) AS dominant, round(2 * sum(r * size) / (max(k) * max(total)) - (max(k) + 1) / max(k), 6) AS gini FROM r", views=False)
def j9_cluster_diversity(g):
    return G.cluster_diversity(g.table("embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("size")))


PREDICTIONS = "r AS (SELECT quality AS truth, 1 - toxic AS predicted FROM labels)"


def predictions(g) -> DataFrame:
    return g.table("labels").select(F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted"))


@query(f"WITH {PREDICTIONS} SELECT truth, predicted, count(*) AS n FROM r GROUP BY 1, 2", views=False)
def o2_confusion_matrix(g):
    return A.classification_counts(predictions(g))


@query(f"WITH {PREDICTIONS}, l AS (SELECT truth AS label FROM r UNION SELECT predicted FROM r), c AS (SELECT label, count_if(truth = label AND predicted = label) AS tp, count_if(predicted = label) AS said, count_if(truth = label) AS real FROM l, r GROUP BY 1), m AS (SELECT label, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN real > 0 THEN tp / real ELSE 0 END AS q FROM c) SELECT label, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM m", views=False)
def o1_classification_metrics(g):
    return A.classification_metrics(predictions(g))


UPSERT = "old AS (SELECT source_id, target_id, weight FROM relationships WHERE relationship_type = 'DISCUSSES_CONCEPT' AND CAST(substr(source_id, 2) AS BIGINT) % 3 <> 0), new AS (SELECT source_id, target_id, 2.5::DOUBLE AS weight FROM relationships WHERE relationship_type = 'DISCUSSES_CONCEPT' AND CAST(substr(source_id, 2) AS BIGINT) % 2 = 0)"


def old_and_new(g) -> tuple[DataFrame, DataFrame]:
    rows = g.relationships.filter("relationship_type = 'DISCUSSES_CONCEPT'").withColumn("_n", F.expr("cast(substr(source_id, 2) as bigint)"))
    return rows.filter("_n % 3 <> 0").select("source_id", "target_id", "weight"), rows.filter("_n % 2 = 0").select("source_id", "target_id", F.lit(2.5).alias("weight"))


@query(f"WITH {UPSERT} SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.target_id, o.target_id) AS target_id, coalesce(n.weight, o.weight) AS weight FROM old o FULL JOIN new n ON o.source_id = n.source_id AND o.target_id = n.target_id")
def a7_upsert_relationships_replace(g):
    return R.upsert(*old_and_new(g), ["source_id", "target_id"])


@query(f"WITH {UPSERT} SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.target_id, o.target_id) AS target_id, CASE WHEN o.weight IS NULL THEN n.weight WHEN n.weight IS NULL THEN o.weight ELSE o.weight + 1 END AS weight FROM old o FULL JOIN new n ON o.source_id = n.source_id AND o.target_id = n.target_id")
def a8_upsert_relationships_increment(g):
    return R.upsert_increment(*old_and_new(g), ["source_id", "target_id"])


@query(f"WITH {UPSERT} SELECT source_id, target_id, weight FROM old UNION ALL SELECT source_id, target_id, weight FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source_id = n.source_id AND o.target_id = n.target_id)")
def a9_insert_ignore_relationships(g):
    old, new = old_and_new(g)
    return R.insert_ignore(old, new, ["source_id", "target_id"], [F.desc("weight")])


@query("WITH s AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey AS key, CASE WHEN s.key IS NOT NULL THEN 'modified' ELSE 'new' END AS change FROM orders LEFT JOIN s ON s.key = o_orderkey WHERE o_orderkey % 10 > 6 UNION ALL SELECT key, 'deleted' FROM s WHERE key % 5 = 1", views=False)
def a15_version_delta(g):
    o = g.table("orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 10).alias("version"))
    return R.version_delta(o.filter("key % 3 = 0").select("key"), o, 6, o.filter("key % 5 = 1").select("key"))
