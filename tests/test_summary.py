"""Evaluations, summaries and answers about gaps: odd rows, empty tables and plain versions."""

import pytest
from pyspark.sql import functions as F

from litgraph.operators import evaluation as E
from litgraph.operators import reviews as R
from litgraph.operators import search as N
from litgraph.operators import summary as Y

ENTITY = "id string, name string, entity_type string, embedding array<double>"
EDGE = "source_id string, target_id string, relationship_type string, weight double"


def test_ground_truth_by_hand(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "Concept", None), ("b", "Bee", "Method", None), ("c", "xy", "Concept", None), ("d", None, "Concept", None), ("e", "Eff", "Finding", None), ("f", "", "Concept", None)], ENTITY)
    edges = spark.createDataFrame([("a", "b", "X", 2.0), ("b", "a", "Y", 5.0), ("a", "c", "X", 1.0), ("c", "b", "X", 1.0), ("e", "a", "X", 3.0), ("d", "a", "X", 9.0), ("f", "a", "X", 9.0), ("c", "c", "X", 4.0)], EDGE)
    got = [tuple(r) for r in E.ground_truth(nodes, edges, 10).orderBy("query_no").collect()]
    assert got == [
        (1, "What is Alpha and how is it discussed?", "concept_search", ["a"]),
        (2, "How is Bee used in this research?", "method_inquiry", ["b"]),
        (3, "What are the findings related to Eff?", "concept_search", ["e"]),
        (4, "What is the relationship between Bee and Alpha?", "relationship_query", ["b", "a"]),
        (5, "What is the relationship between xy and xy?", "relationship_query", ["c", "c"]),
        (6, "What is the relationship between Eff and Alpha?", "relationship_query", ["e", "a"]),
        (7, "What is the relationship between Alpha and xy?", "relationship_query", ["a", "c"]),
        (8, "What is the relationship between xy and Bee?", "relationship_query", ["c", "b"]),
    ]
    assert [r["query_no"] for r in E.ground_truth(nodes, edges, 5).orderBy("query_no").collect()] == [1, 2, 3, 4, 5]
    assert E.ground_truth(nodes.filter("false"), edges, 10).collect() == []


def test_retrieval_report_counts_silent_queries(spark):
    truth = spark.createDataFrame([(1, "s", ["a"]), (2, "s", ["b", "c", "b"]), (3, "t", ["z"]), (4, "t", [])], "query_no int, query_type string, relevant array<string>")
    found = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (2, "b", 1), (2, "y", 2), (2, "c", 3)], "query_no int, id string, place int")
    rows = {r["scope"]: r for r in E.retrieval_report(truth, found, (1, 3)).collect()}
    assert set(rows) == {"all", "s", "t"} and rows["all"]["n_queries"] == 4 and rows["t"]["mrr"] == 0
    assert rows["all"]["precision_1"] == 0.25 and rows["all"]["precision_3"] == pytest.approx((1 / 3 + 2 / 3) / 4)
    assert rows["all"]["recall_1"] == pytest.approx(0.5 / 4) and rows["s"]["recall_3"] == 1 and rows["s"]["mrr"] == 0.75 and rows["all"]["hit_rate"] == 0.5


def test_evaluate_retrieval_without_vectors(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "Concept", [1.0, 0.0]), ("b", "Beta", "Concept", [0.9, 0.1]), ("c", "Gamma", "Concept", None)], ENTITY)
    edges = spark.createDataFrame([("a", "b", "X", 2.0), ("c", "b", "X", 1.0)], EDGE)
    rows = {r["scope"]: r for r in E.evaluate_retrieval(nodes, edges, 8, (1, 3)).collect()}
    assert rows["concept_search"]["n_queries"] == 3 and rows["concept_search"]["precision_1"] == pytest.approx(2 / 3, abs=1e-6)
    assert rows["relationship_query"]["n_queries"] == 2 and rows["relationship_query"]["recall_3"] == 0.5
    assert E.evaluate_retrieval(nodes.filter("false"), edges, 8).collect() == []


RUN = "predicted_intent string, expected_intent string, success boolean, partial boolean, time_ms double, latency_ms double, retrieved array<string>, relevant array<string>, response string, keywords array<string>"


def test_end_to_end_metrics(spark):
    rows = [
        ("a", "a", True, None, 10.0, 5.0, ["x", "y", "x"], ["y", "z"], "Some words here", ["WORDS", "none"]),
        ("b", "a", False, True, 0.0, None, ["z"], ["z"], "", []),
        (None, "b", None, None, None, 15.0, None, None, None, ["k"]),
        ("b", "b", False, False, 30.0, 0.0, [], ["q"], " two  words ", ["two"]),
    ]
    r = E.end_to_end_metrics(spark.createDataFrame(rows, RUN), (1, 2)).first()
    assert (r["n"], r["overall_success_rate"], r["mean_latency_ms"], r["accuracy"], r["mean_ms"]) == (4, 0.25, 10.0, 0.5, 20.0)
    assert (r["success_rate"], r["partial_rate"], r["failure_rate"]) == (0.25, 0.25, 0.5)
    assert (r["precision_1"], r["precision_2"], r["recall_2"], r["mrr"], r["hit_rate"]) == (0.25, 0.25, 0.375, 0.375, 0.5)
    assert (r["keyword_coverage"], r["mean_words"], r["macro_f1"]) == (0.375, 1.25, pytest.approx((2 / 3 + 0.5 + 0) / 3, abs=1e-6))
    empty = E.end_to_end_metrics(spark.createDataFrame([], RUN)).first()
    assert empty["n"] == 0 and empty["overall_success_rate"] == 0 and empty["macro_f1"] == 0


def test_outcomes_and_answers(spark):
    tasks = spark.createDataFrame([("a", "a", True, True, 4.0, None, None), ("a", None, None, True, 0.0, "boom", None), ("b", "a", False, None, None, "bang", "late"), (None, "a", True, None, 1.0, "", "x")], "expected_intent string, predicted_intent string, success boolean, partial boolean, time_ms double, error string, error_type string")
    assert E.task_outcomes(tasks).first().asDict() == {"n": 4, "successful": 2, "success_rate": 0.5, "partial_rate": 0.25, "failure_rate": 0.25, "mean_ms": 2.5}
    assert sorted(tuple(r) for r in E.error_types(tasks).collect()) == [("late", 1), ("unknown", 1)]
    assert sorted(tuple(r) for r in E.task_types(tasks).collect()) == [("a", 2, 0.5, 0.5, 2.0), ("b", 1, 0.0, 0.0, 0.0)]
    said = spark.createDataFrame([("One TWO", ["two", "six"], ["p", "p", "q"], ["p", "r"]), (None, None, None, None), ("x", [], ["p"], [])], "response string, keywords array<string>, cited array<string>, expected array<string>")
    assert E.answer_quality(said).first().asDict() == {"n": 3, "keyword_coverage": pytest.approx(1 / 6, abs=1e-6), "mean_words": 1.0, "citation_accuracy": pytest.approx(1 / 6, abs=1e-6)}


def project(spark):
    members = spark.createDataFrame([(f"c{i}", i // 3, f"name {i}", i, [1.0, float(i // 3), 0.1 * i]) for i in range(9)], "id string, cluster_id int, name string, n int, embedding array<double>")
    links = spark.createDataFrame([("c0", "c1", "X", 1.0), ("c1", "c0", "X", 1.0), ("c1", "c2", "X", 1.0), ("c3", "c4", "X", 1.0), ("c2", "c3", "X", 1.0)], EDGE)
    return members, links


def test_gap_answer_of_few_gaps(spark):
    members, links = project(spark)
    gaps = spark.createDataFrame([(1, 0, 2, 0.0), (2, 0, 1, 0.1115)], "gap_id int, a int, b int, gap_strength double")
    nodes = spark.createDataFrame([("c1", "name 1", "Concept"), ("m", "ways", "Method"), ("p", "paper", "Paper")], "id string, name string, entity_type string")
    found = Y.gap_answer(gaps, members, nodes, links.withColumn("weight", F.when(F.col("source_id") == "c1", None).otherwise(0.1)), 0.6)
    assert [(r["gap_id"], r["names_a"], r["names_b"]) for r in found.gaps.orderBy("gap_strength").collect()] == [(1, ["name 0", "name 1", "name 2"], ["name 6", "name 7", "name 8"]), (2, ["name 0", "name 1", "name 2"], ["name 3", "name 4", "name 5"])]
    assert [tuple(r) for r in found.underexplored.orderBy("degree").collect()] == [("m", "ways", "Method", 0), ("c1", "name 1", "Concept", 2)]
    assert [tuple(r) for r in found.recommendations.orderBy("place").collect()] == [
        (1, "Explore the connection between name 0, name 1 and name 6, name 7 (gap strength: 0.0%)"),
        (2, "Explore the connection between name 0, name 1 and name 3, name 4 (gap strength: 11.2%)"),
        (4, "These concepts need more research coverage: ways, name 1"),
        (5, "Consider applying underutilized methods: ways"),
    ]
    nothing = Y.gap_answer(gaps.filter("false"), members, nodes.filter("false"), links)
    assert [r["place"] for r in nothing.recommendations.collect()] == [6] and nothing.gaps.collect() == []


def test_project_summary_of_empty_tables(spark):
    members, links = project(spark)
    nodes = spark.createDataFrame([(f"c{i}", f"name {i}", "Concept", 2000 + i, None) for i in range(9)] + [("x", None, "Paper", None, None)], "id string, name string, entity_type string, first_year int, last_year int")
    scores = spark.createDataFrame([("c3", 0.5), ("c8", 0.25)], "id string, centrality double")
    full = Y.project_summary(nodes, nodes, links, members, links, scores)
    assert full.overview.first().asDict() == {"n_papers": 10, "n_entities": 10, "n_relationships": 5, "type_diversity": 0.125}
    assert [r["id"] for r in full.emerging.collect()] == ["c8", "c6", "c7"] and [r["id"] for r in full.top_entities.collect()] == ["c3", "c8"]
    assert tuple(full.temporal.first()) == (2000, 2008)
    quality = full.quality.first()
    assert quality["density"] == round(2 * 4 / 72, 6) and quality["coverage"] == 1.0
    assert [(r["a"], r["b"]) for r in full.gaps.orderBy(F.desc("gap_strength"), "a").collect()] == [(0, 1), (0, 2), (1, 2)]
    no = lambda df: df.filter("false")
    empty = Y.project_summary(no(nodes), no(nodes), no(links), no(members), no(links), no(scores))
    assert empty.overview.first()["n_entities"] == 0 and empty.quality.count() == 1 and empty.gaps.collect() == empty.emerging.collect() == []


def test_reviews_quotas_and_access(spark):
    papers = spark.createDataFrame([(1, 1, "d", "t", True, True, True), (1, 2, "d", "u", True, False, None), (1, 3, None, "t", None, None, True), (1, 4, None, None, True, True, False), (1, 5, None, None, True, True, False), (2, 1, "d", "t", False, False, False)], "review int, n int, doi string, title string, screened boolean, included boolean, has_pdf boolean")
    flow = R.review_flow(papers, ["review"])
    assert sorted(tuple(r) for r in flow.collect()) == [(1, 5, 2, 3, 1, 2, 0, 2, -1, 3), (2, 1, 0, 1, 0, 1, 1, 0, 0, 0)]
    errors = {r["review"]: r["errors"] for r in R.review_errors(flow, ["review"]).collect()}
    assert errors == {1: ["Studies included exceeds reports assessed"], 2: []} and R.review_flow(papers.filter("false"), ["review"]).collect() == []

    projects = spark.createDataFrame([("a", "pro"), ("b", None), ("c", "odd"), ("d", "pro")], "project_id string, plan string")
    plans = spark.createDataFrame([("free", 5), ("pro", 10)], "plan string, daily_limit long")
    usage = spark.createDataFrame([("a", "x", "d1", 9), ("a", "y", "d1", 2), ("b", "x", "d1", 4), ("c", "x", "d0", 9), ("c", "x", "d1", 5)], "project_id string, api_type string, day string, call_count long")
    own = spark.createDataFrame([("d", 0)], "project_id string, daily_limit long")
    got = sorted(tuple(r) for r in R.quota_report(projects, plans, own, usage, "d1").collect())
    assert got == [("a", 10, 11, 0, True, True, {"x": 9, "y": 2}), ("b", 5, 4, 1, False, False, {"x": 4}), ("c", 5, 5, 0, True, True, {"x": 5}), ("d", 0, 0, 0, True, False, {})]

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3), (None, 4)], "project_id string, x int")
    link = spark.createDataFrame([("a", 7), ("c", 8)], "project_id string, user_id int")
    assert sorted(r["x"] for r in R.restrict_to_accessible(rows, 7, link, link.filter("false"), projects.filter("project_id = 'b'")).collect()) == [1, 2, 2]


def test_searches_with_all_parameters(spark):
    nodes = spark.createDataFrame([("a", "A", "Concept", [1.0, 0.0]), ("b", "B", "Concept", [1.0, 1.0]), ("c", "C", "Method", [1.0, 0.1]), ("d", "D", "Concept", None), ("e", "E", "Concept", [0.0, 0.0])], ENTITY)
    one = nodes.filter("id = 'a'").select("embedding")
    assert [r["id"] for r in N.nearest_entities(nodes, one, 2).collect()] == ["a", "c"] and [r["id"] for r in N.nearest_entities(nodes, one, 5, "Concept", 0.5).collect()] == ["a", "b"]
    assert [r["id"] for r in N.similar_entities(nodes, "a", 2).collect()] == ["c", "b"]
    assert [(r["id"], r["score"]) for r in N.similar_entities(nodes, "d", 2).collect()] == [("a", None), ("b", None)] and N.similar_entities(nodes, "z", 2).collect() == []
    chunks = spark.createDataFrame([(1, "p", "intro", "x", [1.0, 0.0]), (2, "q", "end", "y", [1.0, 0.2]), (3, "p", "intro", "z", [0.0, 1.0]), (4, None, None, None, [1.0, 0.1])], "id int, paper_id string, section_type string, text string, embedding array<double>")
    papers = spark.createDataFrame([("p", "P")], "paper_id string, title string")
    assert sorted((r["id"], r["title"]) for r in N.search_chunks(chunks, papers, one, 0).collect()) == [(1, "P")]
    assert sorted((r["id"], r["title"]) for r in N.search_chunks(chunks, papers, one, 9).collect()) == [(1, "P"), (2, None), (4, None)]
    assert [r["id"] for r in N.search_chunks(chunks, papers, one, 9, ["end"]).collect()] == [2]


def test_edges_with_shared_papers(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "id string")
    edges = spark.createDataFrame([("a", "b", "CO_OCCURS_WITH", 2.0), ("b", "c", "CO_OCCURS_WITH", 1.0), ("a", "c", "USES", 1.0), ("a", "x", "USES", 9.0)], EDGE)
    mentions = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "b"), (3, "c")], "paper_id int, id string")
    got = [tuple(r) for r in R.edges_with_shared_papers(nodes, edges, mentions, 3).collect()]
    assert sorted(got) == [("a", "b", "CO_OCCURS_WITH", 2.0, 2), ("a", "c", "USES", 1.0, None), ("b", "c", "CO_OCCURS_WITH", 1.0, 1)]
    assert len(R.edges_with_shared_papers(nodes, edges, mentions, 1).collect()) == 1


def test_parts_are_computed_only_when_asked_for(spark):
    nodes = spark.createDataFrame([("c1", "a", "Concept"), ("m1", "b", "Method")], "id string, name string, entity_type string")
    edges = spark.createDataFrame([("c1", "m1", "USES_METHOD", 1.0)], "source_id string, target_id string, relationship_type string, weight double")

    def never():
        raise AssertionError("gaps are not asked for")

    assert [r["id"] for r in Y.gap_answer(never, nodes, nodes, edges).methods.collect()] == ["m1"]


def test_incident_edges_are_read_once(spark):
    from litgraph.operators.relational import incident_edges

    edges = spark.createDataFrame([("a", "b", "t", 1.0), ("a", "a", "t", 2.0), (None, "c", "t", 3.0)], "source_id string, target_id string, relationship_type string, weight double")
    got = incident_edges(edges)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", "b", "t", 1.0), ("b", "a", "t", 1.0), ("a", "a", "t", 2.0), (None, "c", "t", 3.0)]))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_papers_take_all_partitions(spark):
    from litgraph.operators import aggregates as A

    rows = spark.createDataFrame([("p", "a"), ("p", "b")], "paper_id string, concept_id string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert A.pairs_per_paper(rows, "concept_id").rdd.getNumPartitions() == n


def test_top_percent_and_snapshot_read_their_rows_once(spark):
    from litgraph.operators import overview as V

    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            read.add(1)
            yield r

    rows = spark.createDataFrame([(str(i), i % 5) for i in range(10)], "id string, score int")
    counted = spark.createDataFrame(rows.rdd.mapPartitions(count), rows.schema)
    assert sorted(r["id"] for r in V.top_percent(counted, "score", 0.25).collect()) == ["3", "4", "9"]
    assert read.value == 10
    nodes = spark.createDataFrame([("a", 1990), ("b", 2000), ("m", None)], "id string, year int")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "m")], "source_id string, target_id string")
    got = V.graph_snapshot(nodes, edges, 2000).collect()
    assert sorted((r["source_id"], r["target_id"], round(r["opacity"], 6)) for r in got) == [("a", "b", 0.5), ("b", "a", 1.0)]
