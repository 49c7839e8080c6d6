from datetime import datetime, timedelta

from pyspark.sql import functions as F

from litgraph.operators import resolution
from litgraph.plans import registry
from litgraph.sources import papers
from litgraph.streaming import usage

START = datetime(2024, 1, 1)


def test_abstract_keeps_gaps(spark):
    row = spark.sql("select map('graph', array(1), 'a', array(0), 'gap', array(3)) as index")
    assert row.select(papers.abstract_from_inverted_index(F.col("index"))).first()[0] == "a graph  gap"


def test_papers_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,doi,title,authors,year,decision,venue\n,10.1/x,T,Ann; Bob,2020.0,include,V\nb,,U,\"Ann, Bob\",n.d.,,\nc,,W,X,2001,Excluded,\n")
    got = {r["paper_id"]: r for r in papers.read_papers_csv(spark, str(tmp_path / "p.csv")).collect()}
    assert sorted(got) == ["10.1/x", "b"]
    assert got["10.1/x"]["authors"] == ["Ann", "Bob"] == got["b"]["authors"]
    assert (got["10.1/x"]["year"], got["b"]["year"]) == (2020, None)
    assert (got["10.1/x"]["properties"], got["b"]["properties"]) == ({"venue": "V"}, {})


def test_replace_touches_only_its_projects(spark, tmp_path):
    path = str(tmp_path / "gaps")
    papers.replace_project_results(spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, gap int"), path)
    papers.replace_project_results(spark.createDataFrame([("p", 3)], "project_id string, gap int"), path)
    assert sorted((r["project_id"], r["gap"]) for r in spark.read.parquet(path).collect()) == [("p", 3), ("q", 2)]


def test_acronym_and_long_form_are_one_entity(spark):
    rows = spark.createDataFrame([(1, "Concept", "Graph Convolutional Network (GCN)", 0.9, "p1"), (2, "Concept", "GCN", 0.8, "p2"), (3, "Method", "GCN", 0.7, "p1")], "id int, entity_type string, name string, confidence double, source_id string")
    named = resolution.canonicalize_names(rows, resolution.learn_acronyms(rows))
    got = {(r["entity_type"], r["canonical"]): (r["name"], r["alias_count"], r["source_count"]) for r in resolution.resolve_entities(named).collect()}
    assert got == {("Concept", "graph convolutional network"): ("Graph Convolutional Network (GCN)", 2, 2), ("Method", "graph convolutional network"): ("GCN", 1, 1)}


def test_rejected_events_do_not_count(spark):
    rows = [(i, 1, START + timedelta(seconds=s)) for i, s in enumerate((0, 1, 2, 11))]
    got = usage.rate_limit_decisions(spark.createDataFrame(rows, "id int, user_id int, ts timestamp"), 2, 10.0)
    assert [r["allowed"] for r in got.orderBy("id").collect()] == [True, True, False, True]


def test_rate_limit_matches_brute_force(spark, sf):
    got = {r["id"]: (r["allowed"], r["remaining"]) for r in registry.QUERIES["p3_rate_limit_decisions"](spark, sf).collect()}
    rows = sorted((r["user_id"], r["ts"], r["event_id"]) for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    kept: dict = {}
    for user, ts, event in rows:
        recent = [t for t in kept.get(user, []) if t > ts - timedelta(seconds=7200)]
        allowed = len(recent) < 3
        kept[user] = recent + [ts] * allowed
        assert got[event] == (allowed, 3 - len(kept[user]))


def test_windows_on_a_stream(spark, sf, tmp_path):
    batch = registry.QUERIES["p2_usage_hourly"](spark, sf)
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("event_type").alias("api_type"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("call_count"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = usage.usage_hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    hour = F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour")
    got = {tuple(r) for r in spark.table("hourly").select("user_id", "api_type", hour, "calls").collect()}
    assert got == {tuple(r) for r in batch.select("user_id", "api_type", "hour", "calls").collect()}
