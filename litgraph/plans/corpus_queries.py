"""Registered queries of sources, entity resolution, retrieval and usage events, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolution as L
from ..operators import retrieval as N
from ..sources import papers as P
from ..streaming import usage as U
from .registry import query


@query(
    "SELECT 'P' || o_orderkey AS paper_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Ann; Bob' WHEN o_orderkey % 5 = 1 THEN 'Ann, B 2' ELSE 'Ann|Bob' END AS authors_text, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'F'",
    views=False,
)
def a1_normalize_papers(g):
    o, n = g.table("orders"), F.col("o_orderkey") % 5
    raw = o.select(
        F.lit("").alias("paper_id"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("id"), F.when(n == 0, "Ann; Bob").when(n == 1, "Ann, B 2").otherwise("Ann , Bob").alias("authors"),
        F.when(F.col("o_orderkey") % 4 == 0, "n.d.").otherwise(F.year("o_orderdate").cast("string")).alias("year"), F.when(F.col("o_orderstatus") == "F", "Exclude").otherwise("include").alias("decision"), F.col("o_orderpriority").alias("priority"),
    )
    joined = F.when(F.array_contains("authors", "Ann") & (F.col("paper_id").substr(2, 20).cast("long") % 5 == 0), F.array_join("authors", "; ")).otherwise(F.array_join("authors", "|"))
    return P.normalize_papers(raw).select("paper_id", joined.alias("authors_text"), "year", F.col("properties")["priority"].alias("priority"))


@query("SELECT doc_id, md5(rtrim(text, ' ')) AS digest FROM documents WHERE trim(text, ' ') <> ''", views=False)
def a5_abstract_from_inverted_index(g):
    index = P.inverted_index(g.table("documents").filter("text is not null"))
    return index.select("doc_id", F.md5(P.abstract_from_inverted_index(F.col("index"))).alias("digest"))


@query(
    "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 <> 0 THEN 'old' || p_partkey ELSE 'new' || p_partkey END AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS size, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS type, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 2 ELSE 1 END AS n_sources FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0",
    views=False,
)
def a6_upsert_entities(g):
    part = g.table("part").withColumn("key", F.col("p_partkey"))

    def side(prefix: str, where: str, *properties):
        rows = part.filter(where)
        return rows.select(F.concat(F.lit(prefix), F.col("key").cast("string")).alias("id"), "key", F.create_map(*properties).alias("properties"), F.lit(None).cast("array<float>").alias("embedding"), F.array(F.lit(prefix)).alias("source_paper_ids"))

    old = side("old", "key % 3 <> 0", F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    new = side("new", "key % 2 = 0", F.lit("size"), (F.col("p_size") + 1).cast("string"))
    return P.upsert_entities(old, new, ["key"]).select("key", "id", F.col("properties")["size"].cast("int").alias("size"), F.col("properties")["type"].alias("type"), F.size("source_paper_ids").alias("n_sources"))


@query("SELECT c.id, c.name, c.cluster_id, count(p.paper_id) AS paper_count FROM concepts c JOIN paper_concepts p ON p.concept_id = c.id GROUP BY 1, 2, 3")
def a12_concept_frequency(g):
    n = g.paper_concepts.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("paper_count"))
    return g.concepts.join(n, "id").select("id", "name", "cluster_id", "paper_count")


@query("SELECT id, user_id FROM usage WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY")
def a13_retention_filter(g):
    return P.retention_filter(g.usage, "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 10).select("id", "user_id")


@query("SELECT count(*) AS checked, count_if(o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS added, count_if(o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS skipped FROM orders", views=False)
def a14_incremental_new_items(g):
    stored = g.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return P.ingest_counts(stored, g.table("orders").select(F.col("o_custkey").alias("key")), "key")


NAMED_SQL = "named AS (SELECT id, n, source AS long_name, CASE n % 4 WHEN 0 THEN source || ' (' || substr(source, 1, 3) || ')' WHEN 1 THEN lower(source) WHEN 2 THEN substr(source, 1, 3) ELSE source || ' (' || substr(source, 1, 2) || 'q)' END AS name, lower(source) || CASE WHEN n % 4 = 3 THEN ' ' || lower(substr(source, 1, 2)) || 'q' ELSE '' END AS canonical, n % 100 / 100.0 AS confidence FROM concepts)"


def named(g) -> DataFrame:
    """Concepts called by their type: as a long form with acronym, in lower case, by the acronym, or with a note in parentheses that is no acronym of it."""
    beside = lambda short: F.concat("source", F.lit(" ("), short, F.lit(")"))
    by_rest = [beside(F.substring("source", 1, 3)), F.lower("source"), F.substring("source", 1, 3), beside(F.concat(F.substring("source", 1, 2), F.lit("q")))]
    name = F.coalesce(*(F.when(F.col("n") % 4 == i, v) for i, v in enumerate(by_rest)))
    return g.concepts.select("id", "n", F.lit("Concept").alias("entity_type"), name.alias("name"), (F.col("n") % 100 / 100).alias("confidence"))


@query(f"WITH {NAMED_SQL} SELECT DISTINCT lower(substr(long_name, 1, 3)) AS acronym, lower(long_name) AS long_form FROM named WHERE n % 4 = 0")
def l1_learn_acronyms(g):
    return L.learn_acronyms(named(g))


@query(f"WITH {NAMED_SQL} SELECT id, canonical FROM named")
def l2_canonicalize_names(g):
    rows = named(g)
    return L.canonicalize_names(rows, L.learn_acronyms(rows)).select("id", "canonical")


MENTIONS_SQL = f"{NAMED_SQL}, mentions AS (SELECT paper_id, canonical, name, confidence FROM paper_concepts JOIN named ON id = concept_id)"


def mentions(g) -> DataFrame:
    rows = named(g)
    canonical = L.canonicalize_names(rows, L.learn_acronyms(rows))
    return g.paper_concepts.join(canonical.withColumnRenamed("id", "concept_id"), "concept_id").withColumnRenamed("paper_id", "source_id")


@query(f"WITH {MENTIONS_SQL} SELECT canonical, arg_max(name, (confidence, name)) AS name, max(confidence) AS confidence, count(DISTINCT name) AS alias_count, count(DISTINCT paper_id) AS source_count FROM mentions GROUP BY 1")
def l7_resolve_entities(g):
    return L.resolve_entities(mentions(g)).select("canonical", "name", "confidence", "alias_count", "source_count")


@query(f"WITH {MENTIONS_SQL} SELECT count(*) AS raw, count(DISTINCT canonical) AS resolved, count(*) - count(DISTINCT canonical) AS merged, (count(*) - count(DISTINCT canonical)) / count(*) AS merge_rate FROM mentions")
def l8_resolution_stats(g):
    return L.resolution_stats(L.resolve_entities(mentions(g)))


def neighbours(g, step: int, score: float) -> DataFrame:
    """Pairs of concepts whose numbers are ``step`` apart in the same block of four."""
    a = g.concepts.select(F.col("id").alias("id1"), "n")
    b = g.concepts.select(F.col("id").alias("id2"), (F.col("n") - step).alias("n"))
    return a.join(b, "n").filter(f"n % 4 + {step} < 4").select("id1", "id2", F.lit(score).alias("score"))


@query("SELECT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2, CASE WHEN b.n - a.n = 1 THEN 0.9 ELSE 0.8 END::DOUBLE AS score FROM concepts a JOIN concepts b ON a.n // 4 = b.n // 4 AND b.n - a.n IN (1, 2)")
def l5_union_candidates(g):
    swapped = neighbours(g, 1, 0.9).select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "score")
    return L.union_candidates(neighbours(g, 1, 0.7), swapped, neighbours(g, 2, 0.8))


@query("WITH u AS (SELECT concept_id, count(*) AS uses FROM paper_concepts GROUP BY 1), m AS (SELECT id, n // 4 AS b, coalesce(uses, 0) AS uses, length(name) AS l FROM concepts LEFT JOIN u ON concept_id = id), s AS (SELECT *, count(*) OVER (PARTITION BY b) AS k FROM m) SELECT id, first(id) OVER (PARTITION BY b ORDER BY uses DESC, l DESC, id DESC) AS canonical_id FROM s WHERE k > 1")
def l6_alias_clusters(g):
    uses = g.paper_concepts.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("uses"))
    names = g.concepts.join(uses, "id", "left").select("id", "name", F.coalesce("uses", F.lit(0)).alias("uses"), F.lit(1.0).alias("confidence"))
    return L.alias_clusters(neighbours(g, 1, 0.9), names)


@query("SELECT a.id AS id1, b.id AS id2, round(abs(a.n % 7 - b.n % 7) / 7.0, 6) AS score FROM concepts a JOIN concepts b ON b.n = a.n + 1 WHERE a.n % 4 < 3 ORDER BY score, id1, id2 LIMIT 10")
def l9_false_merge_audit(g):
    n = lambda c: F.expr(f"cast(substr({c}, 2) as long) % 7")
    return L.false_merge_audit(neighbours(g, 1, 0.9).withColumn("score", F.round(F.abs(n("id1") - n("id2")) / 7, 6)))


@query(f"WITH {MENTIONS_SQL} SELECT CASE WHEN lower(name) = 'sma' OR lower(name) = 'small' THEN 'tiny' ELSE lower(name) END AS canonical, max(confidence) AS confidence, count(DISTINCT paper_id) AS source_count FROM mentions GROUP BY 1")
def l10_disambiguate_by_synonym(g):
    synonyms = named(g).filter("lower(name) in ('sma', 'small')").select("name", F.lit("Tiny").alias("preferred")).distinct()
    return L.disambiguate_by_synonym(mentions(g), synonyms)


@query("WITH m AS (SELECT id, 'C' || (n - n % 4) AS canonical_id FROM concepts WHERE n >= 4) SELECT DISTINCT r.source_id, coalesce(m.canonical_id, r.target_id) AS target_id, relationship_type, weight FROM relationships r LEFT JOIN m ON m.id = r.target_id")
def l13_merge_concepts(g):
    mapping = g.concepts.filter("n >= 4").select("id", F.concat(F.lit("C"), (F.col("n") - F.col("n") % 4).cast("string")).alias("canonical_id"))
    return L.merge_concepts(g.relationships, mapping)


@query("SELECT id, first(id) OVER (PARTITION BY lower(name), source ORDER BY n, id) AS canonical_id FROM concepts")
def e3_merge_duplicate_entities(g):
    return L.merge_duplicate_entities(g.concepts.withColumn("key", F.lower("name")), ["key", "source"])


COSINE_SQL = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3), c AS (SELECT vec_id AS id, label, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS cosine FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q)"


def query_vector(g) -> DataFrame:
    return g.table("embeddings").filter("vec_id = 3")


@query(f"WITH {COSINE_SQL} SELECT id, round(0.3 * coalesce(CASE WHEN label > 2 THEN label / 10.0 END, 0.5) + 0.7 * cosine, 6) AS final_score FROM c ORDER BY 0.3 * coalesce(CASE WHEN label > 2 THEN label / 10.0 END, 0.5) + 0.7 * cosine DESC, id LIMIT 20")
def n3_rerank(g):
    rows = g.table("embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") > 2, F.col("label") / 10).alias("score"), "embedding")
    return N.rerank(rows, query_vector(g), 20).withColumn("final_score", F.round("final_score", 6))


@query(f"WITH {COSINE_SQL}, k AS (SELECT id, cosine AS score, length(text) // 4 AS tokens FROM c JOIN documents ON doc_id = id WHERE text IS NOT NULL ORDER BY score DESC, id LIMIT 10), s AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM k) SELECT id, round(score, 6) AS score, tokens FROM s WHERE used <= 4000")
def n2_retrieval_context(g):
    chunks = g.table("documents").filter("text is not null").join(g.table("embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("id"), "text", "embedding")
    return N.retrieval_context(chunks, query_vector(g)).withColumn("score", F.round("score", 6))


@query("SELECT c_custkey, count(o_orderkey) AS n_results, CASE WHEN count(o_orderkey) = 0 THEN 'none' WHEN count(o_orderkey) < 3 THEN 'few' END AS warning FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", views=False)
def n8_provenance_warning(g):
    n = g.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    counts = g.table("customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_results"))
    return N.provenance_warning(counts)


MINUTE = "yyyy-MM-dd HH:mm"


@query("SELECT strftime(date_trunc('minute', ts) - to_minutes(CAST(k AS BIGINT)), '%Y-%m-%d %H:%M') AS start, count(*) AS total, count_if(response_status >= 400) AS errors, count_if(response_status BETWEEN 400 AND 499) AS errors_4xx, count_if(response_status >= 500) AS errors_5xx, count_if(response_status >= 400) / 5 AS errors_per_minute FROM usage, (SELECT unnest(range(5)) AS k) GROUP BY 1")
def p1_error_rate_windows(g):
    return U.error_rate_windows(g.usage).withColumn("start", F.date_format("start", MINUTE))


@query("SELECT user_id, api_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, CAST(sum(call_count) AS BIGINT) AS calls FROM usage GROUP BY 1, 2, 3")
def p2_usage_hourly(g):
    return U.usage_hourly(g.usage).withColumn("hour", F.date_format("hour", MINUTE))


@query()
def p3_rate_limit_decisions(g):
    return U.rate_limit_decisions(g.usage, 3, 7200.0)


@query("WITH m AS (SELECT user_id, api_type, date_trunc('minute', ts) AS minute, sum(call_count) AS calls FROM usage GROUP BY 1, 2, 3), r AS (SELECT user_id, api_type, minute, CAST(sum(calls) OVER (PARTITION BY user_id, api_type, CAST(minute AS DATE) ORDER BY minute ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM m) SELECT user_id, api_type, strftime(minute, '%Y-%m-%d %H:%M') AS minute, used, CASE WHEN used >= 3 THEN 'exceeded' WHEN used > 2.4 THEN 'warning' ELSE 'ok' END AS alert FROM r")
def p4_quota_alerts(g):
    return U.quota_alerts(g.usage, 3).withColumn("minute", F.date_format("minute", MINUTE))


@query("SELECT count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M') AS last, count(DISTINCT user_id) AS users, count(DISTINCT api_type) AS apis FROM usage WHERE response_status = 500")
def p6_status_incidents(g):
    return U.status_incidents(g.usage, 500).withColumn("last", F.date_format("last", MINUTE))


@query("SELECT user_id, id, api_type FROM usage QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1")
def p7_latest_progress(g):
    return U.latest_progress(g.usage)
