"""Steps of queries that larger tables made too large: same results as plain versions, in parts that stay small."""

import random

from pyspark.sql import functions as F

from litgraph.operators import gaps, graph
from litgraph.operators.relational import joinable


def test_few_rows_are_sent_to_tasks_and_many_are_sorted(spark):
    one = spark.range(50)
    plan = lambda most: one.join(joinable(spark.range(20), most), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(20) and "SortMergeJoin" in plan(19) and "Broadcast" not in plan(19)


def test_hypotheses_are_dealt_by_gap_and_only_meet_edges_of_named_ids(spark):
    rng = random.Random(4)
    entities = [(f"e{i}", rng.choice(["Ab", "aB", "c", "D", "é", "f"])) for i in range(12)]
    names = [(gap, place, rng.choice(["AB", "C", "d", "É", "none", "F"])) for gap in range(40) for place in range(6)]
    best = {}
    for i, n in entities:
        best[n.lower()] = min(i, best.get(n.lower(), i))
    ids = sorted(set(best.values()))
    edges = [(ids[0], ids[1]), (ids[2], ids[0]), ("x", ids[1])]
    want = set()
    for gap in range(40):
        chain = [best[n.lower()] for g, _, n in names if g == gap and n.lower() in best]
        want |= {(gap, a, b) for a, b in zip(chain, chain[1:], strict=False) if a != b and not {(a, b), (b, a)} & set(edges)}
    # edges of ids that no name stands for, many of them: they may not reach every task
    more = spark.range(300_000).selectExpr("concat('z', id) AS source_id", "concat('z', id + 1) AS target_id")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = gaps.bridge_hypothesis(frame(names, "gap_id int, place int, name string"), frame(entities, "id string, name string"), frame(edges, "source_id string, target_id string").union(more))
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert got.rdd.getNumPartitions() == 8  # as many as the session's shuffle partitions, not put together
    assert "Range" not in got._jdf.queryExecution().executedPlan().toString()


def test_links_and_ranks_stay_dealt_from_round_to_round(spark):
    settings = {k: spark.conf.get(k) for k in (graph.ADAPTIVE, graph.PARTITIONS)}
    links = graph.durable(spark.range(100).selectExpr("cast(id % 7 as string) AS id", "id AS other").groupBy("id").agg(F.sum("other").alias("out")), 5, dealt=True)
    ranks = graph.durable(links.groupBy("id").agg(F.max("out").alias("rank")), 5, dealt=True)
    assert {k: spark.conf.get(k) for k in settings} == settings
    joined = links.join(ranks.hint("merge"), "id")
    assert links.rdd.getNumPartitions() == ranks.rdd.getNumPartitions() == 5
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["out"]) for r in joined.collect()} == {(str(i), sum(range(i, 100, 7))) for i in range(7)}


def test_pagerank_of_rounds_that_five_does_not_divide(spark):
    rng = random.Random(8)
    edges = [(f"a{rng.randrange(20)}", f"a{rng.randrange(20)}") for _ in range(50)]
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        if a != b:
            near.setdefault(b, []).append(a)
    rank = dict.fromkeys(near, 1 / len(near))
    for _ in range(7):
        rank = {i: 0.15 / len(near) + 0.85 * sum(rank[j] / len(near[j]) for j in near for k in near[j] if k == i) for i in near}
    frame = spark.createDataFrame(edges, "source_id string, target_id string").selectExpr("*", "'CITES' AS relationship_type", "1.0D AS weight")
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(frame, 7).collect()}
    assert got.keys() == rank.keys() and all(abs(got[i] - rank[i] / max(rank.values())) < 1e-9 for i in rank)
    assert graph.pagerank(frame.limit(0)).count() == 0


def test_components_join_chains_stars_and_loops_in_few_small_rounds(spark, monkeypatch):
    rng = random.Random(6)
    chain = [f"c{i:03}" for i in rng.sample(range(200), 200)]
    edges = [*zip(chain, chain[1:], strict=False), *((f"h{i}", "hub") for i in range(300)), ("b", "a"), ("a", "b"), ("a", "a"), ("only", "only")]
    left = []
    kept = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, parts=None, **k: left.append((df.columns, parts, out := kept(df, parts, **k))) or out)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {**dict.fromkeys(chain, min(chain)), **dict.fromkeys(["hub", *(f"h{i}" for i in range(300))], "h0"), "a": "a", "b": "a"}
    sizes = [df.count() for columns, _, df in left if columns == ["u", "v"]]
    assert sizes[0] == 500 and sizes[-1] == 0 and sum(sizes) < 3 * sizes[0]  # before, all edges stayed in every round
    assert all(parts == 1 for _, parts, _ in left[1:])  # small graphs are not dealt over the session's shuffle partitions
    assert graph.components(spark.createDataFrame([], "u string, v string")).count() == 0
