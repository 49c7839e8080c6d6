"""Steps that pair rows, against brute force and with their work counted."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from litgraph.functions import scalars as S
from litgraph.operators import relational, similarity


@pytest.fixture
def compared(monkeypatch):
    """The rows that the join on rare tokens gets, for each call."""
    sizes, join = [], similarity.overlap_pairs

    def counted(left, right, share):
        sizes.append([df.count() for df in (left, right) if df is not None])
        return join(left, right, share)

    monkeypatch.setattr(similarity, "overlap_pairs", counted)
    return sizes


def test_files_of_equal_words_are_compared_once(spark, compared):
    files = spark.createDataFrame([(i, f"d{i}", ["deep_graphs-of", "of_DEEP graphs", "other"][i % 3]) for i in range(60)], "file_id int, directory string, stem string")
    items = spark.createDataFrame([(f"K{i}", "Deep of graphs" if i else "deep", i) for i in range(40)], "item_key string, title string, place int")
    got = {r["file_id"]: r["item_key"] for r in similarity.match_files(files, items).collect()}
    assert got == {i: f"d{i}" if i % 3 == 2 else "K1" for i in range(60)}
    assert compared == [[2, 2]]


def test_duplicate_names_are_compared_once(spark, compared, monkeypatch):
    monkeypatch.setattr(relational, "PAIR_BLOCK", 7)
    names = ["deep graph network models", "deep graph network model", "deep graphs network models", "other", "!!", None]
    rows = [(f"e{i:02}", names[i % 6], [None, "x", "y"][i % 7 % 3]) for i in range(90)]
    got = relational.duplicate_pairs(spark.createDataFrame(rows, "id string, name string, kind string"), ["kind"], 0.7)
    ids = spark.createDataFrame([(a, b) for a in names[:4] for b in names[:4]], "a string, b string")
    like = {(r["a"], r["b"]): r["s"] for r in ids.withColumn("s", F.round(S.trigram_similarity(F.col("a"), F.col("b")), 6)).collect()}
    want = {(x[0], y[0]): like[x[1], y[1]] for x, y in combinations(rows, 2) if x[2] and x[2] == y[2] and like.get((x[1], y[1]), 0) >= 0.7}
    assert {(r["id1"], r["id2"]): r["similarity"] for r in got.collect()} == want and len(set(want.values())) > 1
    assert got.count() == len(want) and compared == [[8]]


def test_cosines_in_blocks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "VECTOR_BLOCK", 5)
    monkeypatch.setattr(similarity, "MOST_BLOCK", 13)
    rng = random.Random(4)
    rows = [(i, i % 2 or None, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(150)] + [(200, 1, None), (201, 1, [1.0, None, 1.0]), (202, 1, [1.0, 2.0])]
    got = similarity.cosine_pairs_in_blocks(spark.createDataFrame(rows, "id int, label int, embedding array<float>").filter("label is not null"), 0.3, ["label"]).collect()
    norm = lambda v: sum(x * x for x in v) ** 0.5
    fine = [r for r in rows if r[1] and r[2] and None not in r[2] and norm(r[2])]
    want = {(a[0], b[0]): s for a, b in combinations(fine, 2) if len(a[2]) == len(b[2]) and (s := sum(x * y for x, y in zip(a[2], b[2], strict=True)) / norm(a[2]) / norm(b[2])) >= 0.3}
    assert len(got) == len(want) > 500
    assert {(r["id1"], r["id2"]): r["similarity"] for r in got} == pytest.approx(want)


def test_pairs_of_a_key_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(relational, "PAIR_BLOCK", 6)
    monkeypatch.setattr(relational, "TASK_PAIRS", 500)
    rows = [(i, "hot" if i < 80 else f"k{i % 5}", f"n{i}") for i in range(120)] + [(500, None, "x"), (None, "hot", "x")]
    got = relational.member_pairs(spark.createDataFrame(rows, "id int, key string, name string"))
    want = [(a[0], b[0], a[2], b[2]) for a, b in combinations(rows[:120], 2) if a[1] == b[1]]
    assert sorted(map(tuple, got.select("id1", "id2", "name1", "name2").collect())) == sorted(want)
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 8 and max(r["count"] for r in tasks) < len(want) / 3


def test_similar_papers_by_shared_members(spark):
    rng = random.Random(8)
    mentions = sorted({(f"P{rng.randrange(60)}", f"C{min(rng.randrange(30), rng.randrange(30))}") for _ in range(260)} | {(f"Q{i}", "hub") for i in range(200)})
    got = relational.similar_by_shared(spark.createDataFrame(mentions, "paper_id string, concept_id string"), 3)
    held = defaultdict(set)
    for p, c in mentions:
        held[p].add(c)
    order = lambda p: sorted((-len(held[p] & held[o]), o) for o in held if o != p and held[p] & held[o])[:3]
    assert sorted(map(tuple, got.select("paper_id", "other", "shared").collect())) == sorted((p, o, -n) for p in held for n, o in order(p))


def test_links_between_papers_need_no_shuffle_of_pairs(spark):
    rng = random.Random(2)
    rows = [(f"e{i % 40}", rng.choice([None, "T"]) if i % 9 == 0 else "T", f"n{i % 40 % 3}", rng.choice([None, "p1", "p1", "p2"])) for i in range(70)] + [("e0", "T", "n9", "p1"), ("e1", "T", "n9", "p2"), ("e0", "T", "n1", "p2")]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and a[2] == b[2] and a[0] < b[0] and a[3] and b[3] and a[3] != b[3]}
    schema = "id string, entity_type string, name string, paper_id string"
    got = [tuple(r)[:2] for r in relational.cross_paper_links(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == len(want) > 100 and set(got) == want
    plain = relational.cross_paper_links(spark.createDataFrame([r for r in rows if r[2] != "n9"][:40], schema))
    assert "Aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_wide_cosines_visit_no_pivots(spark, monkeypatch):
    monkeypatch.setattr(similarity, "VECTOR_BLOCK", 5)
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "x"]), [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, kind string, embedding array<float>")
    in_blocks = {tuple(r)[:2]: r["similarity"] for r in similarity.cosine_pairs(df, 0.4, ["kind"]).collect()}
    plan = similarity.cosine_pairs(df, 0.4, ["kind"])._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(similarity, "WIDE", 0.0)
    by_pivots = {tuple(r)[:2]: r["similarity"] for r in similarity.cosine_pairs(df, 0.4, ["kind"]).collect()}
    assert in_blocks == pytest.approx(by_pivots) and len(in_blocks) > 100
    assert "pivot" not in plan
