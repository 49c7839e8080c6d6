"""Registered queries of evaluations, project summaries and answers about gaps, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import summary as Y
from .matching_queries import GAP_HEAD, GAP_TAIL, SUMMARY_SQL, shares_of_papers
from .registry import CO, COSINE, ORACLE_SQL, co_edges, query

KS = (1, 3, 5, 10)


def truth_sql(entities: str, edges: str, most: int) -> str:
    """Common tables that end in truth (query_no, query, query_type, relevant)."""
    order = "weight DESC, source_id, target_id, relationship_type"
    return f"""ents AS ({entities}), eds AS ({edges}),
dg AS (SELECT id, count(*) AS d FROM (SELECT source_id AS id FROM eds UNION ALL SELECT target_id FROM eds WHERE source_id <> target_id) GROUP BY 1),
best AS (SELECT id, name, entity_type, coalesce(d, 0) AS d FROM ents LEFT JOIN dg USING (id) ORDER BY d DESC, id LIMIT {most // 2}),
about AS (SELECT 0 AS part, row_number() OVER (ORDER BY d DESC, id) AS place, CASE entity_type WHEN 'Method' THEN 'How is ' || name || ' used in this research?' ELSE 'What is ' || name || ' and how is it discussed?' END AS query, CASE entity_type WHEN 'Method' THEN 'method_inquiry' ELSE 'concept_search' END AS query_type, [id] AS relevant FROM best WHERE length(name) >= 3),
heavy AS (SELECT eds.*, s.name AS sn, t.name AS tn FROM eds JOIN ents s ON s.id = source_id JOIN ents t ON t.id = target_id ORDER BY {order} LIMIT 200),
pairs AS (SELECT * FROM heavy QUALIFY row_number() OVER (PARTITION BY least(sn, tn), greatest(sn, tn) ORDER BY {order}) = 1),
between_ AS (SELECT 1 AS part, row_number() OVER (ORDER BY {order}) AS place, 'What is the relationship between ' || sn || ' and ' || tn || '?' AS query, 'relationship_query' AS query_type, [source_id, target_id] AS relevant FROM pairs),
truth AS (SELECT CAST(row_number() OVER (ORDER BY part, place) AS INT) AS query_no, query, query_type, relevant FROM (SELECT * FROM about UNION ALL SELECT * FROM between_) QUALIFY query_no <= {most})"""


SHOWN_SQL = "SELECT id, name, entity_type FROM entities WHERE entity_type IN ('Concept', 'Method')"


@query(f"WITH {truth_sql(SHOWN_SQL, 'SELECT * FROM relationships', 40)} SELECT query_no, query, query_type, array_to_string(relevant, '|') AS relevant FROM truth")
def o7_ground_truth(g):
    known = g.entities.filter("entity_type in ('Concept', 'Method')").select("id", "name", "entity_type")
    return E.ground_truth(known, g.relationships, 40).withColumn("relevant", F.array_join("relevant", "|"))


CO_EDGES_SQL = "SELECT a AS source_id, b AS target_id, 'CO_OCCURS_WITH' AS relationship_type, w::DOUBLE AS weight FROM co"
FOUND_SQL = f"found AS (SELECT query_no, a.id, row_number() OVER (PARTITION BY query_no ORDER BY {COSINE} DESC, a.id) AS place FROM truth JOIN concepts b ON b.id = relevant[1] JOIN concepts a ON a.embedding IS NOT NULL AND b.embedding IS NOT NULL QUALIFY place <= 10)"
AT_SQL = ", ".join(f"round(avg(coalesce(h{k}, 0) / {k}.0), 6) AS precision_{k}, round(avg(coalesce(h{k}, 0) / wanted), 6) AS recall_{k}" for k in KS)
REPORT_SQL = f"hits AS (SELECT query_no, min(place) AS f, {', '.join(f'count_if(place <= {k}) AS h{k}' for k in KS)} FROM found JOIN truth USING (query_no) WHERE list_contains(relevant, id) GROUP BY 1), per AS (SELECT *, len(list_distinct(relevant)) AS wanted FROM truth LEFT JOIN hits USING (query_no)), scoped AS (SELECT 'all' AS scope, * FROM per UNION ALL SELECT query_type, * FROM per) SELECT scope, count(*) AS n_queries, {AT_SQL}, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(CASE WHEN h10 > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM scoped GROUP BY 1"


@query(f"WITH {CO}, {truth_sql('SELECT id, name, entity_type FROM concepts', CO_EDGES_SQL, 20)}, {FOUND_SQL}, {REPORT_SQL}")
def o8_evaluate_retrieval(g):
    return E.evaluate_retrieval(g.concepts.select("id", "name", "entity_type", "embedding"), co_edges(g), 20, KS)


#: Turns of conversations as runs of tasks: the intent is the role, read off the text; what is retrieved are a text's first words.
RUNS_SQL = r"""t AS (SELECT role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
runs AS (SELECT role AS expected_intent, CASE WHEN contains(text, chr(10)) THEN 'assistant' ELSE 'user' END AS predicted_intent, n > 100 AS success, n > 60 AS partial, n::DOUBLE AS time_ms, n * 2.0::DOUBLE AS latency_ms,
list_filter(string_split(lower(text), ' '), lambda w: w <> '')[1:12] AS retrieved, CASE role WHEN 'user' THEN ['the', 'in'] ELSE ['of', 'is', 'an'] END AS relevant, text AS response, ['the', 'ING'] AS keywords, CASE WHEN n <= 100 THEN 'failed' END AS error, CASE WHEN n <= 60 THEN 'short' END AS error_type FROM t)"""


def runs(g) -> DataFrame:
    t = g.table("conversations").select(F.col("role").alias("expected_intent"), F.coalesce("text", F.lit("")).alias("response")).withColumn("n", F.length("response"))
    words = F.slice(F.filter(F.split(F.lower("response"), " "), lambda w: w != ""), 1, 12)
    given = lambda *ws: F.array(*(F.lit(w) for w in ws))
    return t.select(
        "expected_intent", F.when(F.contains("response", F.lit("\n")), "assistant").otherwise("user").alias("predicted_intent"), (F.col("n") > 100).alias("success"), (F.col("n") > 60).alias("partial"),
        F.col("n").cast("double").alias("time_ms"), (F.col("n") * 2.0).alias("latency_ms"), words.alias("retrieved"), F.when(F.col("expected_intent") == "user", given("the", "in")).otherwise(given("of", "is", "an")).alias("relevant"),
        "response", given("the", "ING").alias("keywords"), F.when(F.col("n") <= 100, "failed").alias("error"), F.when(F.col("n") <= 60, "short").alias("error_type"),
    )


RATES_SQL = "round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(CASE WHEN partial AND NOT success THEN 1.0 ELSE 0 END), 6) AS partial_rate, round(avg(CASE WHEN success OR partial THEN 0 ELSE 1.0 END), 6) AS failure_rate, round(coalesce(avg(nullif(time_ms, 0)), 0), 6) AS mean_ms"
CLASSES_SQL = "classes AS (SELECT expected_intent AS c FROM runs UNION SELECT predicted_intent FROM runs), f AS (SELECT c, count_if(expected_intent = c AND predicted_intent = c) AS tp, count_if(expected_intent = c) AS re, count_if(predicted_intent = c) AS sa FROM classes, runs GROUP BY 1)"
F1_SQL = "(SELECT round(avg(round(CASE WHEN tp > 0 THEN 2.0 * tp / (re + sa) ELSE 0 END, 6)), 6) FROM f) AS macro_f1"
WORDS_SQL = r"len(list_filter(regexp_split_to_array(response, '\s+'), lambda w: w <> ''))"
KEYWORDS_SQL = "len(list_filter(keywords, lambda k: contains(lower(response), lower(k)))) / len(keywords)"


@query(f"WITH {RUNS_SQL}, {CLASSES_SQL} SELECT count(*) AS n, count_if(expected_intent = predicted_intent) AS correct, round(avg(CASE WHEN expected_intent = predicted_intent THEN 1.0 ELSE 0 END), 6) AS accuracy, {F1_SQL} FROM runs", views=False)
def o1_accuracy_summary(g):
    return E.accuracy_summary(runs(g).select(F.col("expected_intent").alias("truth"), F.col("predicted_intent").alias("predicted")))


@query(f"WITH {RUNS_SQL} SELECT expected_intent, count(*) AS n, count_if(success) AS successful, {RATES_SQL} FROM runs GROUP BY 1", views=False)
def o4_task_outcomes(g):
    return E.task_outcomes(runs(g), ("expected_intent",))


@query(f"WITH {RUNS_SQL} SELECT expected_intent, coalesce(error_type, 'unknown') AS error_type, count(*) AS n FROM runs WHERE error IS NOT NULL GROUP BY 1, 2", views=False)
def o4_error_types(g):
    return E.error_types(runs(g), ("expected_intent",))


@query(f"WITH {RUNS_SQL} SELECT expected_intent, count(*) AS n, round(avg({KEYWORDS_SQL}), 6) AS keyword_coverage, round(avg({WORDS_SQL}), 6) AS mean_words, round(avg(len(list_distinct(list_intersect(retrieved, relevant))) / len(relevant)), 6) AS citation_accuracy FROM runs GROUP BY 1", views=False)
def o5_answer_quality(g):
    return E.answer_quality(runs(g).withColumnsRenamed({"retrieved": "cited", "relevant": "expected"}), ("expected_intent",))


HITS_SQL = {k: f"len(list_distinct(list_intersect(retrieved[1:{k}], relevant)))" for k in KS}
RUN_AT_SQL = ", ".join(f"round(avg({h} / {k}.0), 6) AS precision_{k}, round(avg({h} / len(relevant)), 6) AS recall_{k}" for k, h in HITS_SQL.items())


@query(f"WITH {RUNS_SQL}, {CLASSES_SQL} SELECT count(*) AS n, round(avg(CASE WHEN expected_intent = predicted_intent AND success THEN 1.0 ELSE 0 END), 6) AS overall_success_rate, round(coalesce(avg(nullif(latency_ms, 0)), 0), 6) AS mean_latency_ms, round(avg(CASE WHEN expected_intent = predicted_intent THEN 1.0 ELSE 0 END), 6) AS accuracy, {RATES_SQL}, {RUN_AT_SQL}, round(avg(coalesce(1.0 / list_min(list_filter(list_transform(relevant, lambda r: coalesce(list_position(retrieved, r), 0)), lambda p: p > 0)), 0)), 6) AS mrr, round(avg(CASE WHEN {HITS_SQL[10]} > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg({KEYWORDS_SQL}), 6) AS keyword_coverage, round(avg({WORDS_SQL}), 6) AS mean_words, {F1_SQL} FROM runs", views=False)
def o6_end_to_end_metrics(g):
    return E.end_to_end_metrics(runs(g), KS)


@query(f"WITH {RUNS_SQL} SELECT expected_intent, count(*) AS n, round(avg(CASE WHEN expected_intent = predicted_intent THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(time_ms), 6) AS mean_ms FROM runs GROUP BY 1", views=False)
def o9_task_types(g):
    return E.task_types(runs(g))


DATED_SQL = "dated AS (SELECT id, name, entity_type, coalesce(e.year, f.first_year) AS first_year, coalesce(e.year, f.last_year) AS last_year FROM entities e LEFT JOIN (SELECT concept_id AS id, min(year) AS first_year, max(year) AS last_year FROM paper_concepts JOIN papers USING (paper_id) GROUP BY 1) f USING (id))"


def summary(g) -> Y.ProjectSummary:
    """Concepts were first and last seen in the years of their papers."""
    seen = g.paper_concepts.join(g.papers.select("paper_id", "year"), "paper_id").groupBy(F.col("concept_id").alias("id")).agg(F.min("year").alias("f"), F.max("year").alias("l"))
    dated = g.entities.select("id", "name", "entity_type", "year").join(seen, "id", "left").select("id", "name", "entity_type", F.coalesce("year", "f").alias("first_year"), F.coalesce("year", "l").alias("last_year"))
    members = g.concepts.filter("cluster_id is not null")
    return Y.project_summary(g.papers, dated, g.relationships, members, co_edges(g), shares_of_papers(g), 5, inner=co_edges(g, among=members))


@query("SELECT (SELECT count(*) FROM papers) AS n_papers, (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM relationships) AS n_relationships, (SELECT round(count(DISTINCT entity_type) / 8, 6) FROM entities WHERE entity_type IN ('Concept', 'Method')) AS type_diversity")
def n6_overview(g):
    return summary(g).overview


def part(name: str, column: str) -> str:
    return f"(SELECT {column} FROM ({ORACLE_SQL[name]}))"


#: Coherence of the clusters of concepts; its query takes all vectors.
COHERENCE_SQL = ORACLE_SQL["j7_cluster_coherence"].replace("label AS cluster_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings", "cluster_id, CAST(embedding AS DOUBLE[]) AS e FROM concepts WHERE cluster_id IS NOT NULL")


@query(f"WITH {CO}, q AS (SELECT {part('h13_modularity', 'modularity')} AS modularity) SELECT modularity, CASE WHEN modularity >= 0.5 THEN 'strong' WHEN modularity >= 0.3 THEN 'moderate' ELSE 'weak' END AS interpretation, {part('j10_diversity_index', 'diversity')} AS diversity, (SELECT round(2 * count(*) / (SELECT count(*) * (count(*) - 1) FROM concepts), 6) FROM co) AS density, {part('j6_silhouette_cosine', 'silhouette')} AS silhouette, (SELECT round(avg(coherence), 6) FROM ({COHERENCE_SQL})) AS coherence, (SELECT round(count(cluster_id) / count(*), 6) FROM concepts) AS coverage FROM q")
def n6_quality(g):
    return summary(g).quality.withColumn("silhouette", F.round("silhouette", 5))


USED_SQL = "used AS (SELECT concept_id AS id, count(*) AS k FROM paper_concepts GROUP BY 1), scores AS (SELECT id, k / (SELECT max(k) FROM used) AS centrality FROM used)"


@query(f"WITH {USED_SQL} SELECT id, name, entity_type, round(centrality, 6) AS centrality FROM entities JOIN scores USING (id) WHERE entity_type IN ('Concept', 'Method') ORDER BY scores.centrality DESC, id LIMIT 10")
def n6_top_entities(g):
    return summary(g).top_entities


EIGHT_SQL = SUMMARY_SQL.replace("QUALIFY place <= 5", "QUALIFY place <= 8")


@query(f"WITH {EIGHT_SQL} SELECT cluster_id, label, size, keywords AS names FROM sizes JOIN words USING (cluster_id)")
def n6_communities(g):
    return summary(g).communities.withColumn("names", F.array_join("names", "|"))


NAMES_SQL = "nm AS (SELECT cluster_id, name, row_number() OVER (PARTITION BY cluster_id ORDER BY n, id) AS place FROM concepts WHERE cluster_id IS NOT NULL), n2 AS (SELECT cluster_id, string_agg(name, ', ' ORDER BY place) FILTER (place <= 2) AS two, string_agg(name, '|' ORDER BY place) FILTER (place <= 3) AS three, string_agg(name, '|' ORDER BY place) FILTER (place <= 5) AS five, array_to_string((list(name ORDER BY length(name), place) FILTER (place <= 8))[1:2], ' & ') AS label FROM nm GROUP BY 1)"
GAPS_TABLE_SQL = f"{GAP_HEAD}, gaps AS (SELECT{GAP_TAIL}), {NAMES_SQL}"


@query(f"{GAPS_TABLE_SQL} SELECT place AS gap_id, gaps.a, gaps.b, x.label AS label_a, y.label AS label_b, x.five AS names_a, y.five AS names_b, gap_strength FROM gaps JOIN n2 x ON x.cluster_id = gaps.a JOIN n2 y ON y.cluster_id = gaps.b ORDER BY gap_strength DESC, gaps.a, gaps.b LIMIT 5")
def n6_gaps(g):
    return summary(g).gaps.withColumns({c: F.array_join(c, "|") for c in ("names_a", "names_b")})


@query(f"WITH {DATED_SQL} SELECT min(first_year) AS min_year, max(coalesce(last_year, first_year)) AS max_year FROM dated")
def n6_temporal(g):
    return summary(g).temporal


@query(f"WITH {USED_SQL}, {DATED_SQL} SELECT id, name, first_year FROM dated LEFT JOIN scores USING (id) WHERE entity_type IN ('Concept', 'Method') AND first_year >= (SELECT max(coalesce(last_year, first_year)) FROM dated) - 5 ORDER BY coalesce(centrality, 0) DESC, id LIMIT 10")
def n6_emerging(g):
    return summary(g).emerging


def answer(g) -> Y.GapAnswer:
    members = g.concepts.filter("cluster_id is not null")
    gaps = lambda: G.detect_gaps(co_edges(g, among=members), members.select("id", "cluster_id")).withColumnRenamed("place", "gap_id")
    return Y.gap_answer(gaps, members, g.entities.select("id", "name", "entity_type"), g.relationships, 0.6, 25)


WEAK_SQL = f"{GAPS_TABLE_SQL}, weak AS (SELECT place AS gap_id, gaps.a, gaps.b, round(gap_strength, 3) AS gap_strength, x.three AS names_a, y.three AS names_b, x.two AS ta, y.two AS tb, row_number() OVER (ORDER BY round(gap_strength, 3), gaps.a, gaps.b) AS r FROM gaps JOIN n2 x ON x.cluster_id = gaps.a JOIN n2 y ON y.cluster_id = gaps.b)"
RARE_SQL = "ed AS (SELECT source_id AS id FROM relationships UNION ALL SELECT target_id FROM relationships WHERE source_id <> target_id), dg AS (SELECT n.id, n.name, n.entity_type, count(ed.id) AS degree FROM entities n LEFT JOIN ed ON ed.id = n.id WHERE entity_type IN ('Concept', 'Method') GROUP BY 1, 2, 3), rare AS (SELECT *, row_number() OVER (ORDER BY degree, id) AS r FROM dg WHERE degree <= 25 QUALIFY r <= 10), meth AS (SELECT *, row_number() OVER (ORDER BY degree, id) AS r FROM dg WHERE entity_type = 'Method' QUALIFY r <= 5)"


@query(f"{WEAK_SQL} SELECT gap_id, a, b, gap_strength, names_a, names_b FROM weak")
def n7_gaps(g):
    return answer(g).gaps.withColumns({c: F.array_join(c, "|") for c in ("names_a", "names_b")})


@query(f"WITH {RARE_SQL} SELECT id, name, entity_type, degree FROM rare")
def n7_underexplored(g):
    return answer(g).underexplored


@query(f"WITH {RARE_SQL} SELECT id, name, entity_type, degree FROM meth")
def n7_methods(g):
    return answer(g).methods


@query(f"{WEAK_SQL}, {RARE_SQL} SELECT r AS place, 'Explore the connection between ' || ta || ' and ' || tb || ' (gap strength: ' || printf('%.1f%%', gap_strength * 100) || ')' AS text FROM weak WHERE r <= 3 UNION ALL SELECT 4, 'These concepts need more research coverage: ' || string_agg(name, ', ' ORDER BY r) FROM rare WHERE r <= 3 HAVING count(*) > 0 UNION ALL SELECT 5, 'Consider applying underutilized methods: ' || string_agg(name, ', ' ORDER BY r) FROM meth WHERE r <= 2 HAVING count(*) > 0")
def n7_recommendations(g):
    return answer(g).recommendations
