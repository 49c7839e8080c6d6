"""Registered queries of reviews, quotas, access and searches with all their parameters, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reviews as R
from ..operators import search as N
from ..operators.graph import modularity, scaled_modularity
from .registry import CO, co_edges, query

#: Papers of a year are a review; those of an open order are not screened, urgent ones are included.
REVIEW_SQL = """r AS (SELECT year, n, doi, title, source <> 'O' AS screened, title[1] IN ('1', '2') AS included, source = 'F' AS has_pdf FROM papers),
d AS (SELECT *, (doi IS NOT NULL AND min(n) OVER (PARTITION BY year, doi) < n) OR min(n) OVER (PARTITION BY year, title) < n AS dup FROM r),
c AS (SELECT year, count(*) AS identified, count_if(dup) AS duplicates, count_if(screened AND NOT included) AS excluded, count_if(has_pdf) AS assessed, count_if(included) AS included FROM d GROUP BY 1),
flow AS (SELECT year, identified, duplicates, identified - duplicates AS records_screened, excluded, identified - duplicates - excluded AS sought, identified - duplicates - excluded - assessed AS not_retrieved, assessed, assessed - included AS reports_excluded, included FROM c)"""


def flow(g) -> DataFrame:
    first = F.substring("title", 1, 1)
    return R.review_flow(g.papers.select("year", "n", "doi", "title", (F.col("source") != "O").alias("screened"), first.isin("1", "2").alias("included"), (F.col("source") == "F").alias("has_pdf")), ["year"])


@query(f"WITH {REVIEW_SQL} SELECT * FROM flow")
def d22_review_flow(g):
    return flow(g)


@query(f"WITH {REVIEW_SQL} SELECT year, concat_ws('; ', CASE WHEN records_screened > identified - duplicates THEN 'Records screened exceeds records after deduplication' END, CASE WHEN excluded > records_screened THEN 'Records excluded exceeds records screened' END, CASE WHEN assessed > records_screened - excluded THEN 'Reports assessed exceeds eligible records' END, CASE WHEN included > assessed THEN 'Studies included exceeds reports assessed' END) AS errors FROM flow")
def d23_review_errors(g):
    return R.review_errors(flow(g), ["year"]).withColumn("errors", F.array_join("errors", "; "))


#: Customers are projects, their segment is the plan (machinery has none), a plan allows as many calls as its nations; suppliers' keys have limits of their own.
QUOTA_SQL = """pl AS (SELECT c_mktsegment AS plan, count(DISTINCT c_nationkey) AS daily_limit FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1),
u AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts::DATE = (SELECT max(ts)::DATE FROM events) GROUP BY 1, 2),
us AS (SELECT user_id, sum(n)::BIGINT AS used, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS api_calls FROM u GROUP BY 1),
q AS (SELECT c_custkey AS project_id, coalesce(s_nationkey, daily_limit, (SELECT daily_limit FROM pl WHERE plan = 'BUILDING'))::BIGINT AS daily_limit, coalesce(used, 0) AS used, coalesce(api_calls, '') AS api_calls FROM customer LEFT JOIN pl ON plan = c_mktsegment LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN us ON user_id = c_custkey)"""


@query(f"WITH {QUOTA_SQL} SELECT project_id, daily_limit, used, greatest(daily_limit - used, 0) AS remaining, used >= daily_limit AS exceeded, used > 0.8 * daily_limit AS warning, api_calls FROM q", views=False)
def d17_quota_report(g):
    customers = g.table("customer")
    plans = customers.filter("c_mktsegment <> 'MACHINERY'").groupBy(F.col("c_mktsegment").alias("plan")).agg(F.countDistinct("c_nationkey").alias("daily_limit"))
    usage = g.table("events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("api_type"), F.to_date("ts").alias("day"), F.lit(1).cast("bigint").alias("call_count"))
    last = usage.agg(F.max("day")).first()[0]
    own = g.table("supplier").select(F.col("s_suppkey").alias("project_id"), F.col("s_nationkey").cast("bigint").alias("daily_limit"))
    rows = R.quota_report(customers.select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("plan")), plans, own, usage, last, "BUILDING")
    calls = F.array_join(F.transform(F.map_entries("api_calls"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.withColumn("api_calls", calls)


@query("WITH p AS (SELECT s_nationkey AS k FROM supplier WHERE s_suppkey = 1 UNION SELECT c_nationkey FROM customer WHERE c_custkey = 1 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 3) SELECT o_orderkey, c_nationkey AS project_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT k FROM p)", views=False)
def b10_restrict_to_accessible(g):
    orders = g.table("orders").join(g.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project_id")), "o_custkey").select("o_orderkey", "project_id")
    owners = g.table("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("project_id"))
    members = g.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("project_id"))
    return R.restrict_to_accessible(orders, 1, owners, members, g.table("nation").filter("n_regionkey = 3").select(F.col("n_nationkey").alias("project_id")))


@query(f"WITH {CO}, e AS (SELECT a AS source_id, b AS target_id, 'CO_OCCURS_WITH' AS relationship_type, w::DOUBLE AS weight FROM co UNION ALL SELECT source_id, target_id, relationship_type, weight FROM relationships), k AS (SELECT * FROM e WHERE source_id IN (SELECT id FROM entities WHERE entity_type <> 'Author') AND target_id IN (SELECT id FROM entities WHERE entity_type <> 'Author') ORDER BY weight DESC, source_id, target_id, relationship_type LIMIT 5000) SELECT k.*, CASE WHEN relationship_type = 'CO_OCCURS_WITH' THEN greatest(1, (SELECT w FROM co WHERE a = source_id AND b = target_id)) END AS shared_papers FROM k")
def b4_edges_with_shared_papers(g):
    edges = co_edges(g).unionByName(g.relationships.select("source_id", "target_id", "relationship_type", "weight"))
    return R.edges_with_shared_papers(g.entities.filter("entity_type <> 'Author'"), edges, g.paper_concepts.withColumnRenamed("concept_id", "id"), 5000)


COS_SQL = "list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT c.id, c.name, c.entity_type, round({COS_SQL}, 6) AS score FROM concepts c, concepts q WHERE q.id = 'C7' AND c.embedding IS NOT NULL AND {COS_SQL} >= 0.05 ORDER BY {COS_SQL} DESC, c.id LIMIT 25")
def f1_nearest_entities(g):
    found = N.nearest_entities(g.concepts, g.concepts.filter("id = 'C7'").select("embedding"), 25, "Concept", 0.05)
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT c.id, c.name, c.entity_type, round({COS_SQL}, 6) AS score FROM concepts c, concepts q WHERE q.id = 'C7' AND c.id <> 'C7' AND c.embedding IS NOT NULL ORDER BY {COS_SQL} DESC, c.id LIMIT 10")
def f2_similar_to_entity(g):
    return N.similar_entities(g.concepts, "C7", 10).withColumn("score", F.round("score", 6))


@query("SELECT id, name, entity_type, CAST(NULL AS DOUBLE) AS score FROM entities WHERE entity_type = 'Method' AND id <> 'M3' ORDER BY name, id LIMIT 10")
def f2_similar_without_vector(g):
    vectors = g.concepts.select("id", "embedding")
    return N.similar_entities(g.entities.join(vectors, "id", "left").select("id", "name", "entity_type", "embedding"), "M3", 10)


@query(f"SELECT c.doc_id AS id, 'P' || c.doc_id AS paper_id, p.title, c.source AS section_type, round({COS_SQL}, 6) AS score FROM (SELECT doc_id, source, embedding FROM documents JOIN embeddings ON vec_id = doc_id) c LEFT JOIN papers p ON p.n = c.doc_id, embeddings q WHERE q.vec_id = 3 AND c.source IN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY 1 LIMIT 2) AND {COS_SQL} >= 0.05 ORDER BY {COS_SQL} DESC, c.doc_id LIMIT 100")
def f4_search_sections(g):
    vectors, documents = g.table("embeddings"), g.table("documents")
    chunks = documents.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select(F.col("doc_id").alias("id"), g.key("P", "doc_id").alias("paper_id"), F.col("source").alias("section_type"), "text", "embedding")
    wanted = [r[0] for r in documents.filter("source is not null").select("source").distinct().orderBy("source").limit(2).collect()]  # two values
    found = N.search_chunks(chunks, g.papers, vectors.filter("vec_id = 3").select("embedding"), 500, wanted, 0.05)
    return found.drop("text").withColumn("score", F.round("score", 6))


@query(f"SELECT modularity, round(least(1, greatest(0, (modularity + 0.5) / 1.5)), 6) AS scaled FROM (SELECT round(coalesce(sum(CASE WHEN ca = cb THEN w END), 0) / sum(w) - (SELECT sum(d * d) FROM (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM e UNION ALL SELECT cb, w FROM e) GROUP BY 1)) / (4.0 * sum(w) * sum(w)), 6) AS modularity FROM e)".replace("SELECT modularity", f"WITH {CO}, e AS (SELECT x.cluster_id AS ca, y.cluster_id AS cb, w FROM co JOIN concepts x ON x.id = a JOIN concepts y ON y.id = b WHERE x.cluster_id IS NOT NULL AND y.cluster_id IS NOT NULL) SELECT modularity", 1))
def h13_modularity_scaled(g):
    return scaled_modularity(modularity(co_edges(g), g.concepts.filter("cluster_id is not null").select("id", "cluster_id")))
