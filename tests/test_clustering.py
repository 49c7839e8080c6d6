import random

import numpy as np

from litgraph.operators import analytics, graph


def test_cluster_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{c}-{i}", (10.0 * np.eye(4)[c] + rng.normal(0, 0.1, 4)).tolist()) for c in range(4) for i in range(25)]
    df = spark.createDataFrame([*rows, ("none", None), ("short", [1.0])], "id string, embedding array<double>")
    got = {r["id"]: r["cluster"] for r in analytics.cluster_embeddings(df, 4).collect()}
    assert got.keys() == {i for i, _ in rows} and len({(i.split("-")[0], c) for i, c in got.items()}) == 4
    assert analytics.cluster_embeddings(df.filter("id in ('n0-1', 'n0-2')"), 2).collect() == []
    best, costs = analytics.optimal_k_elbow(df.filter("size(embedding) = 4"), 2, 8)
    assert best == 3 + 1 and len(costs) == 7 and costs[2] < costs[0] / 10


def test_pagerank_against_plain_rounds(spark):
    rng = random.Random(3)
    edges = [(f"a{rng.randrange(30)}", f"a{rng.randrange(30)}") for _ in range(90)]
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(spark.createDataFrame(edges, "source_id string, target_id string").selectExpr("*", "'CITES' AS relationship_type", "1.0D AS weight")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        if a != b:
            near.setdefault(b, []).append(a)
    rank = dict.fromkeys(near, 1 / len(near))
    for _ in range(20):
        rank = {i: 0.15 / len(near) + 0.85 * sum(rank[j] / len(near[j]) for j in near for k in near[j] if k == i) for i in near}
    assert got.keys() == rank.keys()
    assert all(abs(got[i] - rank[i] / max(rank.values())) < 1e-9 for i in rank)


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(50)] + [("alone", "alone"), ("c000", "c000")]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "source_id string, target_id string")).collect()}
    assert {got[f"c{i:03}"] for i in range(61)} == {"c000"} and {got[f"h{i}"] for i in range(50)} == {"h0"} == {got["hub"]} and got["alone"] == "alone" and len(got) == 113
