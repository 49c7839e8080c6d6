"""Operators without SQL against plain versions."""

import random
import re
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.operators import analytics, centrality, gaps
from litgraph.operators import texts as T

EDGE = "source_id string, target_id string, weight double"


@pytest.fixture(scope="module")
def network():
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(26)} | {(20, 21), (21, 22)}
    return [(f"n{a:02}", f"n{b:02}", float(rng.randrange(1, 4))) for a, b in sorted(pairs)]


def shortest(nodes, edges, s):
    """All shortest paths from ``s``, found by trying every extension."""
    w = {(a, b): x for a, b, x in edges} | {(b, a): x for a, b, x in edges}
    best, paths, todo = {s: 0.0}, {s: [(s,)]}, [(s,)]
    while todo:
        p = todo.pop(0)
        d = sum(w[e] for e in pairwise(p))
        if d > best[p[-1]]:
            continue
        for v in nodes:
            if (p[-1], v) in w and v not in p:
                n = d + w[p[-1], v]
                if n < best.get(v, 1e9):
                    best[v], paths[v] = n, []
                if n == best[v]:
                    paths[v].append((*p, v))
                    todo.append((*p, v))
    return {v: [p for p in set(ps) if sum(w[e] for e in pairwise(p)) == best[v]] for v, ps in paths.items()}


def test_betweenness_counts_shortest_weighted_paths(spark, network):
    nodes = sorted({x for e in network for x in e[:2]})
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t, ps in shortest(nodes, network, s).items():
            for p in ps:
                for v in p[1:-1]:
                    want[v] += 1 / len(ps)
    scale = (len(nodes) - 1) * (len(nodes) - 2)
    edges = spark.createDataFrame(network, EDGE)
    got = {r["id"]: r["betweenness"] for r in centrality.betweenness(edges).collect()}
    assert got == pytest.approx({v: x / scale for v, x in want.items()})
    assert centrality.betweenness(edges.limit(0)).count() == 0


def test_ranks_are_those_of_the_matrix(spark, network):
    nodes = sorted({x for e in network for x in e[:2]})
    a = np.zeros((len(nodes), len(nodes)))
    for s, t, w in network:
        a[nodes.index(s), nodes.index(t)] = a[nodes.index(t), nodes.index(s)] = w
    edges = spark.createDataFrame([*network, ("n00", "n00", 9.0)], EDGE)
    p = 0.85 * (a / a.sum(1, keepdims=True)).T + 0.15 / len(nodes)
    rank = np.linalg.matrix_power(p, 200) @ np.full(len(nodes), 1 / len(nodes))
    got = {r["id"]: r["pagerank"] for r in centrality.pagerank_converged(edges).collect()}
    assert got == pytest.approx(dict(zip(nodes, rank, strict=True)), abs=1e-4)
    values, vectors = np.linalg.eigh(a)
    top = np.abs(vectors[:, np.argmax(values)])
    got = {r["id"]: r["eigenvector"] for r in centrality.eigenvector(edges.filter("source_id < 'n20'")).collect()}
    assert got == pytest.approx({n: x for n, x in zip(nodes, top, strict=True) if n < "n20"}, abs=1e-3)


def test_gaps_are_matched_in_order(spark):
    truth = [(1, 1, c) for c in "abcd"] + [(1, 2, c) for c in "abce"] + [(1, 3, "z")] + [(2, 1, "q")]
    found = [(1, 7, c) for c in "ABCD"] + [(1, 8, c) for c in "abx"] + [(3, 1, "q")]
    frame = lambda rows: spark.createDataFrame(rows, "project_id long, gap long, concept string")
    got = {r["project_id"]: (r["matched"], r["precision"], r["recall"], r["f1"]) for r in gaps.evaluate_gaps(frame(truth), frame(found)).collect()}
    assert got == {1: (2, 1.0, 0.6667, 0.8), 2: (0, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0)}


def test_sections_of_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "no header\nhere"), (5, "lost\nMethods\n\n a \n\nResults\nDiscussion"), (6, "Results"), (7, "ABSTRACT\nx\nTable 2: y\nz")]
    got = {}
    for r in T.split_sections(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append((r["section_type"], r["title"], r["content"], r["start_line"], r["end_line"]))
    assert got == {
        4: [("unknown", "", "no header\nhere", 0, 1)],
        5: [("methodology", "Methods", "a", 1, 4), ("results", "Results", "", 5, 5)],
        6: [("unknown", "", "Results", 0, 0)],
        7: [("abstract", "ABSTRACT", "x", 0, 1), ("table", "Table 2: y", "z", 2, 3)],
    }


def runs_of(paragraphs, target, overlap, least):
    """Chunks by hand: lists of paragraphs and their tokens."""
    out, held = [], []
    n = 0
    for p in paragraphs:
        if held and n + len(p) // 4 > target:
            out.append(("\n\n".join(held), n))
            held = held[-1:] if len(held[-1]) // 4 <= overlap else []
            n = sum(len(h) // 4 for h in held)
        held = [*held, p]
        n += len(p) // 4
    return out + ([("\n\n".join(held), n)] if held and n >= least else [])


def test_chunks_and_segments(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ". x", "? "]) for _ in range(n)).strip()
    docs = [(i, "\n\n".join(words(rng.randrange(1, 60)) for _ in range(rng.randrange(0, 30)))) for i in range(20)] + [(20, ""), (21, words(9000))]
    df = spark.createDataFrame(docs, "doc_id long, content string")
    got = {}
    for r in T.hierarchical_chunks(df, 60, 20, 10).orderBy("doc_id", "sequence_order").collect():
        got.setdefault(r["doc_id"], []).append((r["level"], r["chunk"], r["tokens"]))
    for i, text in docs:
        paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
        assert got[i] == [(0, text, len(text) // 4), *((1, *c) for c in runs_of(paragraphs, 60, 20, 10))]
    cut = {r["doc_id"]: r["s"] for r in df.select("doc_id", T.overlapping_segments(F.col("content"), 500, 50).alias("s")).collect()}
    for i, text in docs:
        s = cut[i]
        assert s[0] + "".join(x[50:] for x in s[1:]) == text and all(len(x) <= 500 for x in s)
        assert all(a[-50:] == b[:50] and (len(a) == 500 or a[-2:] in (". ", "? ", "! ")) for a, b in pairwise(s))


def test_bridges_inside_a_gap_count_half(spark):
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.15), ("d", 0.1), ("e", 0.3)], "id string, betweenness double")
    inside = spark.createDataFrame([("b",), ("c",), ("b",)], "id string")
    got = [(r["id"], r["score"]) for r in gaps.bridges_by_betweenness(scores, inside).collect()]
    assert got == [("a", 0.5), ("e", 0.3), ("b", 0.15)]
    assert [r["id"] for r in gaps.bridges_by_betweenness(scores, inside, k=1).collect()] == ["a"]


def test_keywords_end_at_ascii_words(spark):
    docs = spark.createDataFrame([(1, "nation"), (2, "nationé"), (3, "éthe"), (4, "nations"), (5, "TİON x"), (6, None)], "doc_id long, text string")
    rules = [(0, "M", "tion", r"tion\b", 0.6), (1, "C", "the", r"\bthe\b", 0.7), (2, "X", "inside", r"tio\Bns", 0.5)]
    patterns = spark.createDataFrame(rules, "place int, entity_type string, name string, pattern string, confidence double")
    found = analytics.keyword_entities(docs, patterns, 2)
    assert sorted((r["doc_id"], r["name"]) for r in found.collect()) == [(1, "tion"), (2, "tion"), (3, "the"), (4, "inside"), (5, "tion")]
