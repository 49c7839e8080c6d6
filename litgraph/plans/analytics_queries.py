"""Registered queries of scalar functions, cluster quality, evaluation, evidence and access, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import analytics as N
from ..operators import graph as G
from ..operators.relational import incident_edges, upsert
from .registry import query


@query("SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM entities")
def s2_acronym_key(g):
    return g.entities.select("id", S.acronym_key(F.col("name")).alias("key"))


@query(r"SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(lower(name)), '\s+', ' ', 'g'), '[^\w\s-]', '', 'g'), '-+', '-', 'g') AS plain FROM entities")
def s4_normalize_string(g):
    return g.entities.select("id", S.normalize_string(F.col("name")).alias("plain"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'USES_METHOD' WHEN 'view' THEN 'ADDRESSES' WHEN 'error' THEN 'RELATED_TO' ELSE upper(event_type) END AS kind FROM events", views=False)
def s7_normalize_relationship_type(g):
    kind = F.when(F.col("event_type") == "click", " uses_methodology ").when(F.col("event_type") == "view", "addresses_problem").when(F.col("event_type") != "error", F.col("event_type"))
    return g.table("events").select("event_id", S.normalize_relationship_type(kind).alias("kind"))


NEXT_SQL = "SELECT a.id, b.id AS other, a.name AS x, b.name AS y, a.embedding AS u, b.embedding AS v FROM concepts a JOIN concepts b ON b.n = a.n + 1"


def next_concepts(g):
    """Each concept beside the one with the next number."""
    c = g.concepts.select("id", "name", "embedding", "n")
    return c.select("id", F.col("name").alias("x"), F.col("embedding").alias("u"), (F.col("n") + 1).alias("n")).join(c.select(F.col("id").alias("other"), F.col("name").alias("y"), F.col("embedding").alias("v"), "n"), "n")


@query(f"WITH p AS ({NEXT_SQL}) SELECT id, other, round(len(list_intersect(list_distinct(string_split(lower(x), ' ')), list_distinct(string_split(lower(y), ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(lower(x), ' '), string_split(lower(y), ' ')))), 6) AS jaccard FROM p")
def s9_token_jaccard(g):
    return next_concepts(g).select("id", "other", F.round(S.token_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(f"WITH p AS ({NEXT_SQL}) SELECT id, other, round(list_cosine_similarity(u::DOUBLE[], v::DOUBLE[]), 6) AS cosine FROM p WHERE u IS NOT NULL AND v IS NOT NULL")
def s11_cosine_similarity(g):
    rows = next_concepts(g).filter("u is not null and v is not null")
    return rows.select("id", "other", F.round(S.cosine_similarity(F.col("u"), F.col("v")), 6).alias("cosine"))


@query("SELECT doc_id, concat_ws('_', source, '1', CAST(doc_id AS VARCHAR), substr(md5(substr(text, 1, 100)), 1, 8)) AS chunk_id FROM documents", views=False)
def s15_chunk_id(g):
    return g.table("documents").select("doc_id", S.chunk_id(F.col("source"), F.lit(1), F.col("doc_id"), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents", views=False)
def s16_token_estimate(g):
    return g.table("documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN c_mktsegment || '|' || c_name WHEN c_nationkey < 16 THEN 'Doe|Roe' ELSE c_name || ', ' || c_mktsegment END AS authors FROM customer", views=False)
def s18_split_authors(g):
    text = F.when(F.col("c_nationkey") < 8, F.concat("c_mktsegment", F.lit(" ; "), "c_name", F.lit(";"))).when(F.col("c_nationkey") < 16, "Doe, Roe,").otherwise(F.concat("c_name", F.lit(", "), "c_mktsegment"))
    return g.table("customer").select("c_custkey", F.array_join(S.split_authors(text), "|").alias("authors"))


@query("SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.5 THEN 'Strong' WHEN c_acctbal / 10000 >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS band FROM customer", views=False)
def s19_quality_bands(g):
    return g.table("customer").select("c_custkey", S.quality_band(F.col("c_acctbal") / 10000).alias("band"))


@query("SELECT id, entity_type || ': ' || name || coalesce(' - ' || CAST(year AS VARCHAR), '') AS text FROM entities")
def s23_embedding_text(g):
    return g.entities.select("id", S.embedding_text(F.col("entity_type"), F.col("name"), F.col("year").cast("string")).alias("text"))


@query("WITH w AS (SELECT id, string_split(name, ' ') AS w FROM concepts) SELECT id, array_to_string(list_transform(list_sort(list_transform(list_zip(w, range(len(w))), lambda x: {'l': length(x[1]), 'p': x[2], 'w': x[1]}))[1:2], lambda x: x.w), ' & ') AS label FROM w")
def s14_fallback_label(g):
    return g.concepts.select("id", N.fallback_label(F.split("name", " ")).alias("label"))


@query("SELECT m.method_id AS source_id, c.concept_id AS target_id, 'ADDRESSES' AS relationship_type, round(least(1.0, count(*) / 3.0), 6) AS confidence FROM paper_methods m JOIN paper_concepts c USING (paper_id) GROUP BY 1, 2")
def d10_problem_concept_relationships(g):
    return A.cross_relationships(g.paper_methods.select("paper_id", F.col("method_id").alias("source_id")), g.paper_concepts.select("paper_id", F.col("concept_id").alias("target_id")), 1, 3.0, "ADDRESSES")


@query("SELECT c.id, count(p.paper_id) AS n_links, count(p.paper_id) AS n_papers FROM concepts c LEFT JOIN paper_concepts p ON p.concept_id = c.id GROUP BY 1 HAVING count(p.paper_id) < 30 ORDER BY n_papers, id LIMIT 20")
def d4_concepts_few_paper_neighbours(g):
    return N.few_paper_neighbours(g.concepts, g.relationships, g.papers, 30, 20)


@query("SELECT o_orderpriority AS project, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS synced, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1", views=False)
def d18_sync_stats(g):
    rows = g.table("orders").withColumnRenamed("o_orderpriority", "project")
    return N.conditional_counts(rows, ["project"], {"synced": F.col("o_orderstatus") == "F", "pending": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 200000})


@query("SELECT l_returnflag AS entity_type, l_linestatus AS source, count(*) AS n, round(avg(1 - l_discount), 6) AS mean_confidence FROM lineitem GROUP BY 1, 2", views=False)
def d19_entity_source_distribution(g):
    rows = g.table("lineitem").groupBy(F.col("l_returnflag").alias("entity_type"), F.col("l_linestatus").alias("source"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(1 - F.col("l_discount")), 6).alias("mean_confidence"))


@query("WITH m AS (SELECT paper_id, concept_id AS e FROM paper_concepts UNION ALL SELECT paper_id, method_id FROM paper_methods), per AS (SELECT e, count(*) AS n FROM m GROUP BY 1) SELECT round((SELECT count(DISTINCT entity_type) FROM entities) / 8.0, 6) AS type_diversity, round((SELECT count(DISTINCT paper_id) FROM m) / (SELECT count(*) FROM papers), 6) AS coverage, round(sum(n) / (SELECT count(DISTINCT paper_id) FROM m), 6) AS entities_per_paper, round(count(*) FILTER (n >= 3) / count(*), 6) AS shared_often FROM per")
def d21_entity_quality(g):
    mentions = g.paper_concepts.select("paper_id", F.col("concept_id").alias("entity_id")).union(g.paper_methods)
    return N.entity_quality(mentions, g.entities, g.papers)


@query("SELECT lower(trim(c_name)) AS author, count(DISTINCT o_orderkey) AS paper_count FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", views=False)
def d31_author_entities(g):
    names = g.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.lower(F.trim("c_name")).alias("author"))
    return g.table("orders").join(names, "o_custkey").groupBy("author").agg(F.countDistinct("o_orderkey").alias("paper_count"))


@query("SELECT 'P' || l_orderkey AS source_id, 'C' || l_partkey AS target_id, round(max(1 - l_discount), 6) AS weight FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) GROUP BY 1, 2", views=False)
def d32_paper_concept_edges(g):
    rows = g.table("lineitem").join(g.table("part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    return rows.groupBy(g.key("P", "l_orderkey").alias("source_id"), g.key("C", "l_partkey").alias("target_id")).agg(F.round(F.max(1 - F.col("l_discount")), 6).alias("weight"))


@query("WITH p AS (SELECT concept_id AS id, count(*) AS n_papers FROM paper_concepts GROUP BY 1), a AS (SELECT 'C' || l_partkey AS id, count(DISTINCT l_suppkey) AS n_aliases FROM lineitem GROUP BY 1) SELECT c.id, c.name, coalesce(n_papers, 0) AS n_papers, coalesce(n_aliases, 0) AS n_aliases FROM concepts c LEFT JOIN p USING (id) LEFT JOIN a USING (id)")
def d34_concept_summary(g):
    papers = g.paper_concepts.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("n_papers"))
    aliases = g.table("lineitem").groupBy(g.key("C", "l_partkey").alias("id")).agg(F.countDistinct("l_suppkey").alias("n_aliases"))
    return g.concepts.select("id", "name").join(papers, "id", "left").join(aliases, "id", "left").na.fill(0, ["n_papers", "n_aliases"])


@query("SELECT o_orderkey AS claim, o_orderstatus AS kind, count(l_orderkey) AS n_snippets, coalesce(string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus), '') AS sections FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2", views=False)
def d35_claim_evidence(g):
    snippets = g.table("lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg(F.count("*").alias("n_snippets"), F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("sections"))
    return g.table("orders").select(F.col("o_orderkey").alias("claim"), F.col("o_orderstatus").alias("kind")).join(snippets, "claim", "left").na.fill(0, ["n_snippets"]).na.fill("", ["sections"])


@query("WITH c AS (SELECT c_nationkey AS k, count(*) AS n_authors FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n_methods FROM supplier GROUP BY 1), o AS (SELECT c_nationkey AS k, count(*) AS n_papers FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT n_nationkey AS project_id, coalesce(n_authors, 0) AS n_authors, coalesce(n_methods, 0) AS n_methods, coalesce(n_papers, 0) AS n_papers FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey LEFT JOIN o ON o.k = n_nationkey", views=False)
def d37_project_stats(g):
    count = lambda df, key, name: df.groupBy(F.col(key).alias("project_id")).agg(F.count("*").alias(name))
    papers = g.table("orders").join(g.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    out = g.table("nation").select(F.col("n_nationkey").alias("project_id"))
    for part in (count(g.table("customer"), "c_nationkey", "n_authors"), count(g.table("supplier"), "s_nationkey", "n_methods"), count(papers, "c_nationkey", "n_papers")):
        out = out.join(part, "project_id", "left")
    return out.na.fill(0)


@query("SELECT r_name AS team, count(c_custkey) AS members FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", views=False)
def d40_team_member_counts(g):
    members = g.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"))
    rows = g.table("nation").join(members, "n_nationkey", "left").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("team")).agg(F.coalesce(F.sum("members"), F.lit(0)).alias("members"))


@query("WITH e AS (SELECT relationship_type, target_id AS other FROM relationships WHERE source_id = 'P1' UNION ALL SELECT relationship_type, source_id FROM relationships WHERE target_id = 'P1') SELECT relationship_type, count(*) AS n, string_agg(DISTINCT other, ',' ORDER BY other) AS others FROM e GROUP BY 1")
def d44_neighbours_by_type(g):
    return N.neighbours_by_type(g.relationships, "P1").withColumn("others", F.array_join("others", ","))


@query("WITH k AS (SELECT floor(c_acctbal / 1000)::BIGINT AS cx, floor(c_nationkey / 5)::BIGINT AS cy, c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY ALL) SELECT cx, cy, sum(n)::BIGINT AS n_nodes, first(kind ORDER BY n DESC, kind) AS dominant FROM k GROUP BY 1, 2", views=False)
def e8_grid_aggregate(g):
    return N.grid_aggregate(g.table("customer").select(F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"), F.col("c_mktsegment").alias("kind")), 1000, 5)


@query("SELECT DISTINCT ON (user_id) user_id, event_type, event_id FROM events ORDER BY user_id, event_id", views=False)
def e9_latest_by_key(g):
    rows = g.table("events").groupBy("user_id").agg(F.min_by(F.struct("event_type", "event_id"), "event_id").alias("first"))
    return rows.select("user_id", "first.event_type", "first.event_id")


VECTOR_SQL = "SELECT c.id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM concepts c, concepts q WHERE q.id = 'C1' AND c.embedding IS NOT NULL"


def scored(g, node):
    """Vectors of concepts beside that of one of them, which is one row."""
    one = g.concepts.filter(F.col("id") == node).select(F.col("embedding").alias("q"))
    rows = g.concepts.filter("embedding is not null").crossJoin(F.broadcast(one))
    return rows.withColumn("score", F.round(S.cosine_similarity(F.col("embedding"), F.col("q")), 6))


@query(f"{VECTOR_SQL} ORDER BY score DESC, c.id LIMIT 10")
def f1_vector_topk_entities(g):
    return scored(g, "C1").select("id", "score").orderBy(F.desc("score"), "id").limit(10)


@query(f"{VECTOR_SQL} AND c.id <> 'C1' ORDER BY score DESC, c.id LIMIT 10")
def f2_similar_entities(g):
    return scored(g, "C1").filter("id <> 'C1'").select("id", "score").orderBy(F.desc("score"), "id").limit(10)


@query("SELECT d.doc_id, d.source, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, embeddings q WHERE q.vec_id = 0 AND round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) >= 0.1 ORDER BY score DESC, d.doc_id LIMIT 20", views=False)
def f4_search_chunks(g):
    e = g.table("embeddings")
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    rows = e.crossJoin(F.broadcast(one)).select(F.col("vec_id").alias("doc_id"), F.round(S.cosine_similarity(F.col("embedding"), F.col("q")), 6).alias("score")).filter("score >= 0.1")
    return rows.join(g.table("documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "score").orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score FROM events ORDER BY score DESC NULLS LAST, event_id LIMIT 25", views=False)
def f5_top_entities_by_score(g):
    score = F.expr("try_cast(get_json_object(props, '$.k') AS double)").alias("score")
    return g.table("events").select("event_id", score).orderBy(F.desc_nulls_last("score"), "event_id").limit(25)


@query("WITH e AS (SELECT source_id AS id FROM relationships UNION ALL SELECT target_id FROM relationships WHERE source_id <> target_id), d AS (SELECT id, count(*) AS degree FROM e GROUP BY 1) SELECT d.id, n.name, degree FROM d JOIN entities n USING (id) ORDER BY degree DESC, d.id LIMIT 10")
def f6_top_bridges(g):
    best = incident_edges(g.relationships).groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(10)
    return g.entities.select("id", "name").join(F.broadcast(best), "id").select("id", "name", "degree")  # ten rows


@query("WITH s AS (SELECT paper_id FROM paper_methods WHERE method_id = 'M1' INTERSECT SELECT paper_id FROM paper_methods WHERE method_id = 'M2') SELECT p.paper_id, p.title FROM s JOIN papers p USING (paper_id) UNION ALL SELECT paper_id, title FROM papers WHERE paper_id IN (SELECT paper_id FROM paper_methods WHERE method_id = 'M3')")
def g1_shared_entity_chunks(g):
    of = lambda m: g.paper_methods.filter(F.col("method_id") == m).select("paper_id")
    shared = of("M1").intersect(of("M2")).union(of("M3"))
    return shared.join(g.papers.select("paper_id", "title"), "paper_id")


@query("WITH u AS (SELECT o_custkey, o_orderpriority AS v FROM orders UNION SELECT o_custkey, o_orderstatus FROM orders) SELECT o_custkey, string_agg(v, '|' ORDER BY v) AS ids FROM u GROUP BY 1", views=False)
def g6_merge_id_arrays(g):
    sets = g.table("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set("o_orderstatus").alias("b"))
    return sets.select("o_custkey", F.array_join(F.array_sort(F.array_distinct(F.array_union("a", "b"))), "|").alias("ids"))


@query("WITH n AS (SELECT count(DISTINCT id) AS n FROM (SELECT source_id AS id FROM relationships UNION ALL SELECT target_id FROM relationships)), m AS (SELECT count(*) AS m FROM (SELECT DISTINCT least(source_id, target_id), greatest(source_id, target_id) FROM relationships WHERE source_id <> target_id)) SELECT n AS n_nodes, m AS n_edges, round(2.0 * m / (n * (n - 1)), 9) AS density FROM n, m")
def h14_density(g):
    near = incident_edges(g.relationships)
    nodes, edges = near.agg(F.countDistinct("id").alias("n_nodes")), near.filter("id < other").select("id", "other").distinct().agg(F.count("*").alias("n_edges"))
    return nodes.crossJoin(edges).withColumn("density", F.round(2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 9))


@query("WITH s AS (SELECT cluster_id, count(*) AS n FROM concepts WHERE cluster_id IS NOT NULL GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p, count(*) OVER () AS k FROM s) SELECT k, round(sum(-p * ln(p + 1e-10)) / ln(k), 6) AS diversity FROM p GROUP BY k")
def j10_diversity_index(g):
    return N.diversity_index(g.concepts.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size")))


@query("WITH v AS (SELECT id, cluster_id AS c, embedding::DOUBLE[] AS e FROM concepts WHERE embedding IS NOT NULL), d AS (SELECT a.id, a.c, b.c AS o, avg(1 - list_cosine_similarity(a.e, b.e)) AS d FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3), s AS (SELECT id, max(d) FILTER (c = o) AS a, min(d) FILTER (c <> o) AS b FROM d GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s")
def j6_silhouette_cosine(g):
    return N.silhouette_cosine(g.concepts)


METRICS = ", ".join(f"round(avg(h{k} / {k}.0), 6) AS precision_{k}, round(avg(h{k} / wanted), 6) AS recall_{k}" for k in (1, 3, 5, 10))


@query(f"WITH r AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS p, l_returnflag = 'R' AS rel FROM lineitem), s AS (SELECT q, count(*) FILTER (rel) AS wanted, min(p) FILTER (rel) AS f, {', '.join(f'count(*) FILTER (rel AND p <= {k}) AS h{k}' for k in (1, 3, 5, 10))} FROM r GROUP BY 1) SELECT count(*) AS n_queries, {METRICS}, round(avg(1.0 / f), 6) AS mrr, round(avg(CASE WHEN h10 > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM s WHERE wanted > 0", views=False)
def o3_retrieval_metrics(g):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    return N.retrieval_metrics(g.table("lineitem").select(F.col("l_orderkey").alias("query"), place.alias("place"), (F.col("l_returnflag") == "R").alias("relevant")))


@query("SELECT count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(value), 6) AS mean_ms FROM events", views=False)
def o4_execution_metrics(g):
    return N.execution_metrics(g.table("events").select((F.col("event_type") != "error").alias("success"), F.col("value").alias("time_ms")), [])


@query("SELECT role AS key, count(*) AS n, round(avg((CASE WHEN contains(lower(coalesce(text, '')), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), 'ing') THEN 1 ELSE 0 END) / 2.0), 6) AS keyword_coverage, round(avg(len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> ''))), 6) AS mean_words FROM conversations GROUP BY 1", views=False)
def o5_generation_metrics(g):
    return N.generation_metrics(g.table("conversations").select(F.col("role").alias("key"), "text"), ["the", "ing"])


@query("SELECT json_extract_string(props, '$.k') AS task, count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1", views=False)
def o9_metrics_by_task_type(g):
    rows = g.table("events").select(F.get_json_object("props", "$.k").alias("task"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("time_ms"))
    return N.execution_metrics(rows, ["task"])


@query("SELECT o_orderkey AS item, CASE WHEN o_orderstatus = 'P' THEN 'not_synced' ELSE 'synced' END AS status, CASE WHEN year(o_orderdate) > 1998 THEN 'remote_newer' WHEN year(o_orderdate) < 1998 THEN 'local_newer' ELSE 'in_sync' END AS side FROM orders", views=False)
def b13_paper_sync_status(g):
    items = g.table("orders").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("key"), F.year("o_orderdate").alias("remote"), F.lit(1998).alias("local"))
    return N.sync_status(items).select("item", "status", "side")


@query("WITH t AS (SELECT s_nationkey AS project_id, s_suppkey AS user_id, 1 AS r FROM supplier UNION ALL SELECT nation.n_nationkey, s_suppkey, 2 FROM nation JOIN nation h ON h.n_regionkey = nation.n_regionkey JOIN supplier ON s_nationkey = h.n_nationkey UNION ALL SELECT n_nationkey, s_suppkey, 3 FROM nation, supplier WHERE n_regionkey = 0) SELECT project_id, user_id, CASE min(r) WHEN 1 THEN 'owner' WHEN 2 THEN 'member' ELSE 'public' END AS role FROM t GROUP BY 1, 2", views=False)
def b9_accessible_projects(g):
    s, n = g.table("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("home")), g.table("nation")
    owners = s.select(F.col("home").alias("project_id"), "user_id")
    homes = s.join(n.select(F.col("n_nationkey").alias("home"), "n_regionkey"), "home")
    members = homes.join(n.select(F.col("n_nationkey").alias("project_id"), "n_regionkey"), "n_regionkey").select("project_id", "user_id")
    return N.accessible_projects(owners, members, n.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("project_id")), s)


@query("SELECT 'P' || l_orderkey AS source_id, 'C' || l_partkey AS target_id, l_linenumber AS piece, round(1 - l_discount, 6) AS relevance, p.title FROM lineitem JOIN papers p ON p.n = l_orderkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY round(1 - l_discount, 6) DESC, l_linenumber) <= 1")
def c4_evidence_for_relationship(g):
    rows = g.table("lineitem").select(g.key("P", "l_orderkey").alias("source_id"), g.key("C", "l_partkey").alias("target_id"), g.key("P", "l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("piece"), F.round(1 - F.col("l_discount"), 6).alias("relevance"))
    return N.relationship_evidence(rows, g.papers, 1)


@query("SELECT n_name AS child, r_name AS parent, 'PART_OF' AS relationship_type FROM nation JOIN region ON r_regionkey = n_regionkey", views=False)
def c17_concept_hierarchy(g):
    rows = g.table("nation").join(g.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.lit("PART_OF").alias("relationship_type"))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean_ms, round(max(value), 6) AS max_ms, (SELECT round(value, 6) FROM events ORDER BY value, event_id LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) FROM events)) AS p95_ms FROM events", views=False)
def d27_latency_overall(g):
    return A.latency_summary(g.usage, [])


@query("SELECT id, entity_type FROM entities WHERE entity_type IN ('Concept', 'Method', 'Author') ORDER BY entity_type = 'Author', entity_type, id LIMIT 300")
def b3_visualization_nodes(g):
    return N.visualization_nodes(g.entities, ["Concept", "Method", "Author"], ["Paper", "Author"], 300).select("id", "entity_type")


@query("SELECT n_name AS name, n_regionkey AS project_id FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1)", views=False)
def b10_restrict_to_accessible(g):
    s = g.table("supplier").filter("s_suppkey = 1").join(g.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("n_regionkey")
    return g.table("nation").join(s, "n_regionkey", "left_semi").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("project_id"))


@query("WITH w AS (SELECT min(n) AS work_id, lower(doi) AS k, arg_min(year, n) AS year FROM papers WHERE source = 'F' GROUP BY 2), t AS (SELECT lower(title) AS k, arg_min(year, n) AS year FROM papers WHERE source = 'F' GROUP BY 1) SELECT p.paper_id, p.title, coalesce(CASE WHEN p.source <> 'O' THEN p.year END, w.year, t.year) AS year FROM papers p LEFT JOIN w ON w.k = lower(p.doi) LEFT JOIN t ON t.k = lower(p.title)")
def c16_enrich_papers(g):
    works = g.papers.filter("source = 'F'").select(F.col("n").alias("work_id"), "doi", "title", "year")
    papers = g.papers.select("paper_id", "doi", "title", F.when(F.col("source") != "O", F.col("year")).alias("year"))
    return N.enrich_papers(papers, works, ["year"]).select("paper_id", "title", "year")


#: Patterns of entities in texts (fixed values): type, name, pattern, confidence.
PATTERNS = [("Concept", "the", "\\bthe\\b", 0.7), ("Concept", "and", "\\band\\b", 0.7), ("Concept", "of", "\\bof\\b", 0.7), ("Method", "tion", "tion\\b", 0.6), ("Finding", "numbers", "[0-9]{3}", 0.5)]
PATTERNS_SQL = ", ".join(f"({i}, '{t}', '{n}', '{p}', {c})" for i, (t, n, p, c) in enumerate(PATTERNS))


@query(f"WITH k(place, entity_type, name, pattern, confidence) AS (VALUES {PATTERNS_SQL}) SELECT doc_id, entity_type, name, confidence::DOUBLE AS confidence FROM documents JOIN k ON regexp_matches(lower(text), pattern) QUALIFY row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY place) <= 2", views=False)
def m4_keyword_entities(g):
    rules = g.spark.createDataFrame([(i, *p) for i, p in enumerate(PATTERNS)], "place int, entity_type string, name string, pattern string, confidence double")
    return N.keyword_entities(g.table("documents"), rules, 2)


@query("WITH c AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN conv_id || '-' || min(turn) OVER (PARTITION BY conv_id) END AS parent_id, turn AS place FROM conversations) SELECT a.id, b.id AS other, CASE WHEN a.id = b.id THEN 'target' WHEN b.parent_id IS NULL THEN 'parent' WHEN a.parent_id IS NULL THEN 'child' ELSE 'sibling' END AS role, b.place FROM c a JOIN c b ON coalesce(a.parent_id, a.id) = coalesce(b.parent_id, b.id)", views=False)
def m5_chunk_context(g):
    c = g.table("conversations").withColumn("first", F.min("turn").over(Window.partitionBy("conv_id")))
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col(turn).cast("string"))
    return N.chunk_context(c.select(name("turn").alias("id"), F.when(F.col("turn") > F.col("first"), name("first")).alias("parent_id"), F.col("turn").alias("place")))


@query("SELECT l_orderkey AS paper, p_name AS name, l_linenumber AS section FROM lineitem JOIN part ON p_partkey = l_partkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, p_name ORDER BY l_linenumber) = 1", views=False)
def m7_section_entity_dedupe(g):
    rows = g.table("lineitem").join(g.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return rows.groupBy(F.col("l_orderkey").alias("paper"), F.col("p_name").alias("name")).agg(F.min("l_linenumber").alias("section"))


@query(f"WITH s AS ({VECTOR_SQL.replace('SELECT c.id,', 'SELECT c.id, c.cluster_id,')} ORDER BY score DESC, c.id LIMIT 20), r AS (SELECT cluster_id, count(*) AS n, round(avg(score), 6) AS mean_score FROM s GROUP BY 1) SELECT *, CASE WHEN mean_score >= 0.5 THEN 'strong' WHEN mean_score >= 0.2 THEN 'moderate' ELSE 'weak' END AS strength FROM r")
def n5_cluster_relevance(g):
    return N.cluster_relevance(scored(g, "C1"), 20)


@query("WITH e AS (SELECT source_id AS id FROM relationships UNION ALL SELECT target_id FROM relationships WHERE source_id <> target_id), d AS (SELECT n.id, n.name, count(*) AS degree FROM e JOIN entities n USING (id) GROUP BY 1, 2 ORDER BY degree DESC, n.id LIMIT 30) SELECT 'What is ' || name || '?' AS query, id AS relevant_id FROM d")
def o7_auto_ground_truth(g):
    return N.ground_truth_queries(g.entities, g.relationships, 30)


@query("WITH old AS (SELECT l_partkey AS concept, l_suppkey AS alias, max(l_tax) AS confidence FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), new AS (SELECT l_partkey AS concept, l_suppkey AS alias, max(l_discount) AS confidence FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT concept, alias, round(coalesce(new.confidence, old.confidence), 6) AS confidence FROM old FULL JOIN new USING (concept, alias)", views=False)
def a10_upsert_aliases(g):
    old = g.table("lineitem").filter("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("concept"), F.col("l_suppkey").alias("alias")).agg(F.round(F.max("l_tax"), 6).alias("confidence"))
    new = g.table("lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("concept"), F.col("l_suppkey").alias("alias")).agg(F.round(F.max("l_discount"), 6).alias("confidence"))
    return upsert(old, new, ["concept", "alias"])


@query("WITH n AS (SELECT p_partkey, p_name, CASE WHEN p_size < 20 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), '') ELSE upper(p_brand[1:2]) || 'Q' END AS a FROM part) SELECT p_partkey, CASE WHEN lower(a) = array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: w[1]), '') THEN lower(a) END AS acronym FROM n", views=False)
def s3_acronym_definition(g):
    initials = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.upper(F.substring(w, 1, 1))), "")
    short = F.when(F.col("p_size") < 20, initials).otherwise(F.concat(F.upper(F.substring("p_brand", 1, 2)), F.lit("Q")))
    return g.table("part").select("p_partkey", N.acronym_definition(F.concat("p_name", F.lit(" ("), short, F.lit(")"))).alias("acronym"))


@query("SELECT a.p_partkey AS id, b.p_partkey AS other, concat_ws(',', CASE WHEN a.p_brand = b.p_brand THEN 'brand' END, CASE WHEN a.p_size = b.p_size THEN 'size' END, CASE WHEN a.p_type = b.p_type THEN 'type' END) AS same, concat_ws(',', CASE WHEN a.p_brand <> b.p_brand THEN 'brand' END, CASE WHEN a.p_size <> b.p_size THEN 'size' END, CASE WHEN a.p_type <> b.p_type THEN 'type' END) AS differ FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1", views=False)
def s24_property_diff(g):
    bag = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"))
    p = g.table("part").select("p_partkey", bag.alias("bag"))
    rows = p.select(F.col("p_partkey").alias("id"), F.col("bag").alias("a"), (F.col("p_partkey") + 1).alias("other")).join(p.select(F.col("p_partkey").alias("other"), F.col("bag").alias("b")), "other")
    same, differ = N.property_diff(F.col("a"), F.col("b"))
    return rows.select("id", "other", F.array_join(same, ",").alias("same"), F.array_join(differ, ",").alias("differ"))


@query("WITH f AS (SELECT o_orderpriority AS review, year(o_orderdate)::INT AS year, count(*) AS identified, count(*) FILTER (o_orderstatus <> 'P') AS screened, count(*) FILTER (o_orderstatus = 'F') AS included FROM orders GROUP BY 1, 2) SELECT review, year, concat_ws(',', CASE WHEN screened > identified THEN 'screened' END, CASE WHEN included > screened THEN 'included' END, CASE WHEN 2 * included < screened THEN 'few included' END, CASE WHEN identified > screened THEN 'unscreened' END) AS errors FROM f", views=False)
def d23_prisma_validate(g):
    flow = g.table("orders").groupBy(F.col("o_orderpriority").alias("review"), F.year("o_orderdate").alias("year"))
    flow = flow.agg(F.count("*").alias("identified"), F.count_if(F.col("o_orderstatus") != "P").alias("screened"), F.count_if(F.col("o_orderstatus") == "F").alias("included"))
    found = N.checks({"screened": F.expr("screened > identified"), "included": F.expr("included > screened"), "few included": F.expr("2 * included < screened"), "unscreened": F.expr("identified > screened")})
    return flow.select("review", "year", F.array_join(found, ",").alias("errors"))


@query()
def j1_cluster_embeddings(g):
    return N.cluster_embeddings(g.concepts, 10)


@query()
def j3_optimal_k_elbow(g):
    k, costs = N.optimal_k_elbow(g.concepts)
    return g.spark.createDataFrame([(k, i + 3, float(c)) for i, c in enumerate(costs)], "best int, k int, cost double")
