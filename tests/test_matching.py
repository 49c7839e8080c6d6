"""Similarity joins, communities, silhouettes, bibliographies, tables and ingest against plain versions."""

import math
import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.functions import scalars as S
from litgraph.operators import clustering, communities, resolution, search, similarity, tables
from litgraph.operators.graph import durable
from litgraph.plans.matching_queries import CONCEPT_ALIASES
from litgraph.sources import bibliography
from litgraph.streaming import ingest


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def made_names(n, seed):
    rng = random.Random(seed)
    words = ["graph", "graphs", "neural", "network", "networks", "deep", "learning", "model", "of", "the", "a", "convolutional", "gcn"]
    return ["", "a", "é", "x" * 40, *(" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n)), *(f"the name {i}" for i in range(60))]


def test_similar_names_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "KEY_BLOCK", 16)
    names = sorted(set(made_names(150, 1)))
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r["id1"], r["id2"]): r["similarity"] for r in similarity.similar_names(df, 0.85).collect()}
    want = {(i, j): s for i in range(len(names)) for j in range(i + 1, len(names)) if names[i] and names[j] and (s := ratio(names[i], names[j])) >= 0.85}
    assert got == pytest.approx(want) and len(want) > 100


def test_string_candidates_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "KEY_BLOCK", 16)
    rng = random.Random(2)
    rows = [(rng.choice(["Concept", "Method"]), rng.choice(["x", "y", None]), n) for n in made_names(200, 3)] * 2
    rows.append(("Concept", "x", None))
    got = {tuple(r)[:4]: r["score"] for r in similarity.string_candidate_pairs(spark.createDataFrame(rows, "entity_type string, bucket string, name string"), 0.82).collect()}
    groups, want = defaultdict(set), {}
    for t, b, n in rows:
        if n is not None:
            groups[t, b].add(n)
    key = lambda n: re.sub("[^a-z0-9]", "", n.lower())
    for (t, b), found in groups.items():
        for x in found:
            for y in found:
                p, q = set(x.split()), set(y.split())
                if x < y and p and q and abs(len(x) - len(y)) <= 20:
                    bonus = 0.1 if key(x) and key(y) and (key(x).startswith(key(y)) or key(y).startswith(key(x))) else 0
                    score = min(1.0, 0.55 * ratio(x, y) + 0.45 * len(p & q) / len(p | q) + bonus)
                    if score >= 0.82:
                        want[t, b, x, y] = score
    assert got == pytest.approx(want) and len(want) > 20
    with pytest.raises(ValueError):
        similarity.string_candidate_pairs(spark.createDataFrame(rows, "entity_type string, bucket string, name string"), 0.6)


def normal(s):
    s = re.sub(r"\s+", " ", s.lower().strip())
    return re.sub("-+", "-", re.sub(r"[^\w\s-]", "", s))


def test_duplicate_concepts_keep_copies_together(spark):
    rows = [(1, "Graph Networks", None), (2, "graph  networks!", None), (3, "graph network", None), (4, "graph networks", 9), (5, None, None), (6, "other", None)]
    pairs, members = similarity.find_duplicate_concepts(spark.createDataFrame(rows, "id int, name string, canonical_id int"))
    assert [(r["id1"], r["id2"]) for r in pairs.collect()] == [(1, 3)]
    assert sorted(map(tuple, members.collect())) == [(1, 1), (2, 1), (3, 3), (6, 6)]


def test_normalize_concepts(spark):
    known = [*CONCEPT_ALIASES, "small ring", "red widget", "Red Widgets"]
    names = ["ML", "m.l.", " A.I. ", "Machine  Learning", "machine lerning", "red widgetts", "the K-12 thing (new)", "stored one", None, "", "ring", "ML", "deep-learning", "o'neil étude"]
    aliases = {normal(a): c for c, v in CONCEPT_ALIASES.items() for a in v}
    stored = {normal("Stored  One"): "small ring"}
    want = []
    for i, n in enumerate(names):
        if n is None:
            want.append((i, None, None, None))
            continue
        k = normal(n)
        scores = [(ratio(k, normal(c)), -p, c) for p, c in enumerate(known)]
        best = max(scores, default=(0, 0, ""))
        if k in aliases:
            want.append((i, aliases[k], 1.0, "alias"))
        elif k in stored:
            want.append((i, stored[k], 0.95, "db_alias"))
        elif best[0] >= 0.85:
            want.append((i, best[2], best[0], "fuzzy"))
        else:
            want.append((i, n.strip().title(), 1.0, "new"))
    got = similarity.normalize_concepts(
        spark.createDataFrame(list(enumerate(names)), "id int, name string"),
        spark.createDataFrame([(a, c) for c, v in CONCEPT_ALIASES.items() for a in v], "alias string, canonical string"),
        spark.createDataFrame([("Stored  One", "small ring")], "alias string, canonical string"),
        spark.createDataFrame(list(enumerate(known)), "place int, name string"),
    )
    found = sorted((r["id"], r["canonical_name"], r["confidence"], r["match_type"]) for r in got.collect())
    assert found == want and {w[3] for w in want} == {"alias", "db_alias", "fuzzy", "new", None}


@pytest.mark.parametrize("least", [0.4, 0.7, 0.95])
def test_cosine_pairs_are_all_pairs(spark, least):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, i % 2, (centres[i % 6] + rng.normal(size=8) * (0.1 + i % 3)).tolist()) for i in range(300)]
    rows += [(300 + i, 0, rows[0][2]) for i in range(30)] + [(400, 0, None), (401, 0, [0.0] * 8), (402, 0, [math.nan] * 8), (403, 1, [1.0, 2.0]), (404, 1, [2.0, 4.1]), (405, None, rows[0][2]), (406, None, rows[6][2])]
    df = spark.createDataFrame(rows, "id int, kind int, embedding array<double>")
    got = {(r["id1"], r["id2"]): r["similarity"] for r in similarity.cosine_pairs(df, least, ["kind"], pivots=5, block=16).collect()}
    first, want = {}, {}
    for i, kind, v in rows:
        if v is not None and all(map(math.isfinite, v)) and any(v):
            first.setdefault((kind, tuple(v)), i)
    for (k1, x), i in first.items():
        for (k2, y), j in first.items():
            if i < j and k1 == k2 and len(x) == len(y) and (s := np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) >= least:
                want[i, j] = s
    assert got == pytest.approx(want) and want
    members = {r["id"]: r["rep"] for r in similarity.vector_classes(df, ["kind"]).collect()}
    assert members[310] == 0 and members[405] == 405 and 400 not in members


def test_hot_words_are_dealt_over_blocks(spark, monkeypatch):
    """All names share all words but one, so every prefix has a hot word."""
    monkeypatch.setattr(similarity, "KEY_BLOCK", 8)
    rows = [(i, "g", ["hot", "very", f"w{i // 3}"]) for i in range(90)]
    got = similarity.overlap_pairs(spark.createDataFrame(rows, "id int, grp string, tokens array<string>"), None, 0.9 / 1.9)
    assert {(r["id1"], r["id2"]) for r in got.collect()} == {(i, j) for i in range(90) for j in range(i + 1, i // 3 * 3 + 3)}


def louvain(n, links):
    """Plain sequential moves and contraction: the modularity reached."""
    edges, owner = dict(links), list(range(n))

    def passes(nodes, edges):
        label, near, k = {i: i for i in nodes}, defaultdict(dict), defaultdict(float)
        for (i, j), w in edges.items():
            k[i] += w
            k[j] += w
            if i != j:
                near[i][j] = near[i].get(j, 0) + w
                near[j][i] = near[j].get(i, 0) + w
        total, size, moved = sum(k.values()), dict(k), True
        while moved:
            moved = False
            for i in nodes:
                options = defaultdict(float)
                for j, w in near[i].items():
                    options[label[j]] += w
                a = label[i]
                size[a] -= k[i]
                worth = lambda c: options.get(c, 0) - k[i] * size[c] / total  # noqa: B023, E731
                best = max([a, *options], key=worth)
                if worth(best) <= worth(a) + 1e-12:
                    best = a
                moved |= best != a
                label[i] = best
                size[best] += k[i]
        return label

    nodes = list(range(n))
    while True:
        label = passes(nodes, edges)
        owner = [label[o] for o in owner]
        merged = defaultdict(float)
        for (i, j), w in edges.items():
            merged[min(label[i], label[j]), max(label[i], label[j])] += w
        if len(set(label.values())) == len(nodes):
            return owner
        nodes, edges = sorted(set(label.values())), merged


def modularity(links, label):
    total, inside, k = sum(links.values()), 0.0, defaultdict(float)
    for (i, j), w in links.items():
        k[label[i]] += w
        k[label[j]] += w
        inside += w * (label[i] == label[j])
    return inside / total - sum(v * v for v in k.values()) / (4 * total * total)


def test_communities_of_planted_partitions(spark):
    rng = random.Random(6)
    n, groups = 90, 6
    links = {(i, j): 1.0 for i in range(n) for j in range(i + 1, n) if rng.random() < (0.5 if i % groups == j % groups else 0.02)}
    rows = [(f"n{i:03}", f"n{j:03}", w) for (i, j), w in links.items()] + [("n000", "n006", 0.0), ("solo", "solo", 1.0)]
    found = {r["id"]: r["community"] for r in communities.communities(spark.createDataFrame(rows, "source_id string, target_id string, weight double")).collect()}
    assert len(found) == n + 1 and found["solo"] == "solo"
    label = [found[f"n{i:03}"] for i in range(n)]
    assert modularity(links, label) >= modularity(links, louvain(n, links)) - 0.005
    assert all(min(f"n{i:03}" for i in range(n) if label[i] == c) == c for c in set(label))
    for c in set(label):  # connected inside
        inside, seen = {i for i in range(n) if label[i] == c}, set()
        todo = [min(inside)]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += [y if x == i else x for x, y in links if i in (x, y) and x in inside and y in inside]
        assert seen == inside


def test_community_table(spark):
    members = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(6)], "id int, community string")
    names = spark.createDataFrame([(i, f"name {i}" + "x" * (3 - i)) for i in range(6)], "id int, name string")
    assert [tuple(r) for r in communities.community_table(members, names, 3).collect()] == [("a", 4, "name 3 & name 2x", "leiden", 0)]
    empty = spark.createDataFrame([], "source_id string, target_id string, weight double")
    assert communities.communities(empty).collect() == []


def test_silhouettes_and_best_k(spark):
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(size=(40, 4)) * 0.3 + c for c in np.eye(4) * 6])
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [math.nan] * 4), (902, [1.0]), (903, [5.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    got = clustering.optimal_k_silhouette(df, 2, 6).collect()
    assert [r["k"] for r in got if r["best"]] == [4] and {r["size"] for r in got} == {4} and all(r["n"] == 160 for r in got)
    label = rng.integers(0, 3, 160)
    label[0] = 3  # a cluster of one
    from pyspark.ml.functions import array_to_vector

    given = spark.createDataFrame([(p.tolist(), int(c)) for p, c in zip(points, label, strict=True)], "v array<double>, k9 int").select(array_to_vector("v").alias("features"), "k9")
    square = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    want = []
    for i, c in enumerate(label):
        own = [j for j in range(160) if label[j] == c and j != i]
        if own:
            a, b = square[i, own].mean(), min(square[i, label == d].mean() for d in set(label.tolist()) - {c})
            want.append((b - a) / max(a, b))
        else:
            want.append(0.0)
    assert clustering.silhouettes(given, [9]).first()["silhouette"] == pytest.approx(np.mean(want))
    assert clustering.optimal_k_silhouette(df.limit(0)).collect() == []


RDF = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:z="z" xmlns:bib="b" xmlns:dc="d" xmlns:foaf="f" xmlns:dcterms="t" xmlns:link="l" xmlns:prism="p">
<bib:Article rdf:about="http://x#ONE"><dc:title> First </dc:title><dcterms:abstract> Some text </dcterms:abstract>
<bib:authors><rdf:Seq><rdf:li><foaf:Person><foaf:surname>Li</foaf:surname><foaf:givenName>Na</foaf:givenName></foaf:Person></rdf:li><rdf:li><foaf:Person><foaf:givenName>Q</foaf:givenName></foaf:Person></rdf:li></rdf:Seq></bib:authors>
<dc:date>March 12, 2019 (2020)</dc:date><dc:identifier>doi:10.1000/abc def</dc:identifier><dcterms:identifier>x</dcterms:identifier><dcterms:identifier>see 10.2000/zz</dcterms:identifier><link:link rdf:resource="a/b.PDF"/><link:link rdf:resource="#f1"/></bib:Article>
<bib:Book><dc:title>No key</dc:title></bib:Book><bib:Book rdf:about="#EMPTY"><dc:title></dc:title></bib:Book><bib:Thesis rdf:about="#T"><dcterms:abstract>no title</dcterms:abstract></bib:Thesis>
<z:Attachment rdf:about="#f1"><rdf:resource rdf:resource="files/1/c.pdf"/></z:Attachment></rdf:RDF>"""


def test_bibliography(spark, tmp_path):
    (tmp_path / "export.rdf").write_text(RDF)
    got = {r["item_key"]: r for r in bibliography.read_bibliography(spark, str(tmp_path)).collect()}
    one = got.pop("ONE")
    assert (one["title"], one["abstract"], one["authors"], one["year"], one["doi"], one["url"]) == ("First", "Some text", ["Li, Na"], 2019, "10.2000/zz", None)
    assert one["pdf_paths"] == ["a/b.PDF", "files/1/c.pdf"] and one["item_type"] == "Article"
    (key, book), = got.items()
    assert book["title"] == "No key" and re.fullmatch("[0-9a-f]{8}", key) and book["authors"] == [] and book["pdf_paths"] == []
    assert {r["item_key"] for r in bibliography.read_bibliography(spark, str(tmp_path)).collect()} == {"ONE", key}

def test_bibliography_documents(spark, tmp_path):
    """Nested items, links of their own document only, comments, an error at the end; streamed documents give the same."""
    root = RDF[: RDF.index("<bib:Article")]
    nested = '<bib:BookSection rdf:about="#S"><dc:title>Part é &amp; more</dc:title><dcterms:isPartOf><bib:Book rdf:about="#W"><dc:title>Whole</dc:title><bib:Book rdf:about="#N"><dc:title>inner</dc:title></bib:Book></bib:Book></dcterms:isPartOf><link:link rdf:resource="#f1"/></bib:BookSection>'
    quiet = '<!-- <bib:Book rdf:about="#C"><dc:title>comment</dc:title></bib:Book> --><bib:Book rdf:about="#Q"/>'
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.rdf").write_text(RDF)
    (tmp_path / "deep" / "b.rdf").write_text(f'{root}{nested}{quiet}<z:Attachment rdf:about="#f1"><rdf:resource rdf:resource="files/2/d.pdf"/></z:Attachment></rdf:RDF>')
    (tmp_path / "empty.rdf").write_text("")
    (tmp_path / "note.rdf").write_text(f"{root}</rdf:RDF>")
    rows = lambda largest: {r["item_key"]: r for r in bibliography.read_bibliography(spark, str(tmp_path), largest).collect()}
    got, streamed, both = rows(1 << 20), rows(0), rows(1_000)
    assert got == streamed == both
    assert got["ONE"]["pdf_paths"] == ["a/b.PDF", "files/1/c.pdf"] and got["S"]["pdf_paths"] == ["files/2/d.pdf"]
    assert got["S"]["title"] == "Part é & more" and got["W"]["item_type"] == "Book" and {"C", "N", "Q"}.isdisjoint(got)
    plan = bibliography.read_bibliography(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert [kind for kind, *_ in bibliography.cut_items(f'{root}<bib:Book rdf:about="#B"><dc:title>b</dc:title></bib:Book><bib:Thesis>'.encode())] == ["Book"]


def test_headers_are_classified_once_a_table(spark):
    """No filter on a table's type or model, nor a second one on scores, is computed for each row before the tables are joined."""
    headers = spark.createDataFrame([(1, "t", ["Model", "F1"]), (2, "GLUE", ["Dataset", "Model", "Recall"])], "table_id long, caption string, headers array<string>")
    rows = spark.createDataFrame([(1, 1, ["xy", "9"]), (1, 2, ["x", "9"]), (2, 1, ["", "ab", "n/a"]), (2, 2, ["", "ab", "1%"])], "table_id long, row_no long, cells array<string>")
    got = tables.table_results(headers.distinct(), rows)
    assert sorted(map(tuple, got.select("table_id", "row_no", "score_col", "source_name", "target_name", "metric_value").collect())) == [(1, 1, 1, "xy", "unknown_dataset", 9.0), (2, 2, 2, "ab", "glue", 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE(") and all("Generate" in line for line in plan.splitlines() if "RLIKE(" in line or "arrays_overlap" in line or "regexp_extract" in line)


def test_resolved_entities_are_spread(spark):
    """Sources are counted without copies of every row and in many tasks; missing values count as before."""
    rows = [("T", "c", "a", 0.5, "s1"), ("T", "c", "b", 0.5, "s1"), ("T", "c", "a", None, "s2"), ("T", "c", None, 0.9, None), ("T", None, "z", None, "s1"), ("T", "c", "a", 0.1, "s1")]
    got = resolution.resolve_entities(spark.createDataFrame(rows, "entity_type string, canonical string, name string, confidence double, source_id string"))
    assert {tuple(r) for r in got.collect()} == {("T", "c", None, 0.9, 2, 2, 5), ("T", None, "z", None, 1, 1, 1)}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan(got) and "REPARTITION_BY_NUM" in plan(got)


def test_headers_and_scores(spark):
    kinds = {"Model": "model", "Our approach": "model", "data-set": "dataset", "Benchmark": "dataset", "metric": "metric", "Accuracy (%)": "score", "hits@1": "score", "F1": "score", "Notes": "other", "p@5": "score", "recall/1": "score"}
    df = spark.createDataFrame(list(kinds.items()), "h string, want string")
    assert df.filter(tables.column_type(F.col("h")) != F.col("want")).collect() == []
    scores = {"91.5": 91.5, "0.856": 0.856, "91.5%": 91.5, "+3.": 3.0, "88 %": 88.0, "12.1†": 12.1, "n/a": None, "": None, "1.2.3": None, "~5": None, "90±": 90.0}
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in scores], "t string").select("t", tables.parse_score(F.col("t")).alias("s")).collect()}
    assert got == scores


def test_table_results(spark):
    t = spark.createDataFrame([(1, "On SST", ["Model", "Task", "F1"]), (2, None, ["Model", "Size"]), (3, None, ["Results", "F1"])], "table_id int, caption string, headers array<string>")
    r = spark.createDataFrame([(1, 0, ["BERT", "X", "90"]), (1, 1, ["bert", " ", "91.5%"]), (1, 2, ["b", "X", "1"]), (1, 3, ["F1", None, None]), (1, 4, ["x2"]), (2, 0, ["A1", "3"]), (3, 0, ["A1", "3"])], "table_id int, row_no int, cells array<string>")
    got = tables.table_results(t, r)
    assert sorted(tuple(x)[1:7] for x in got.collect()) == [(0, 2, "bert", "x", "F1", 90.0), (1, 2, "bert", "sst", "F1", 91.5)]
    assert {tuple(x)[1:] for x in tables.table_entities(got).collect()} == {("bert", "Method"), ("x", "Dataset"), ("sst", "Dataset"), ("f1", "Metric")}


def test_match_files(spark):
    items = spark.createDataFrame([("K1", "Deep learning for graphs", 0), ("K2", "deep learning of graphs", 1), ("K3", None, 2)], "item_key string, title string, place int")
    files = spark.createDataFrame([(1, "K2", "anything"), (2, "9", "Deep_Learning-graphs"), (3, "8", "unrelated"), (4, None, "deep learning graphs")], "file_id int, directory string, stem string")
    got = {r["file_id"]: (r["item_key"], r["matched_by"]) for r in similarity.match_files(files, items).collect()}
    assert got == {1: ("K2", "directory"), 2: ("K1", "title"), 3: ("8", "none"), 4: ("K1", "title")}


def test_bounded_walk_stops_at_the_limit(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "X", 1.0) for i in range(9)], "source_id string, target_id string, relationship_type string, weight double")
    seeds = spark.createDataFrame([("n4",)], "id string")
    walk = lambda hops, limit: [(r["id"], r["hop"]) for r in search.bounded_walk(edges, seeds, hops, limit).collect()]
    assert walk(2, 4) == [("n4", 0), ("n3", 1), ("n5", 1), ("n2", 2)]
    assert len(walk(9, 50)) == 10


PATTERNS = [(0, "Concept", "cat", r"\bcat\b", 0.7), (1, "Concept", "dog", r"\bdog\b", 0.6), (2, "Method", "run", r"runs?", 0.5)]
RULES = "place int, entity_type string, name string, pattern string, confidence double"


def graph_of(spark, store):
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    return rows(ingest.stored_entities(spark, store)), rows(ingest.stored_relationships(spark, store)), rows(ingest.read_log(spark, store, "items").select("key", "text"))


def test_ingest_batches_replays_and_a_stream_agree(spark, tmp_path):
    items = [("a", "cat runs"), ("b", "dog"), ("c", "cat and dog run"), ("a", "cat runs"), ("d", None), (None, "cat"), ("e", "nothing")]
    df = spark.createDataFrame(items, "key string, text string")
    rules = spark.createDataFrame(PATTERNS, RULES)
    whole = str(tmp_path / "whole")
    ingest.create_store(spark, whole)
    ingest.ingest_batch(df, 0, whole, rules)
    parts = str(tmp_path / "parts")
    ingest.create_store(spark, parts)
    ordered = [durable(df.filter("key in ('a', 'b')")), durable(df.filter("key = 'c' or key is null")), durable(df.filter("key in ('a', 'd', 'e')"))]
    for i, part in enumerate(ordered):
        ingest.ingest_batch(part, i, parts, rules)
    ingest.ingest_batch(ordered[1], 1, parts, rules)  # comes again
    ingest.ingest_batch(ordered[2], 2, parts, rules)
    assert graph_of(spark, whole) == graph_of(spark, parts)
    source = tmp_path / "source"
    for i in range(3):
        ordered[i].coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("key string, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    streamed = str(tmp_path / "streamed")
    ingest.ingest_stream(stream, streamed, lambda s: s.createDataFrame(PATTERNS, RULES), str(tmp_path / "progress")).awaitTermination()
    assert graph_of(spark, streamed) == graph_of(spark, whole) and ingest.read_log(spark, streamed, "items").select("batch_id").distinct().count() > 1
    ingest.compact(spark, parts, str(tmp_path / "small"), 1)
    assert graph_of(spark, str(tmp_path / "small")) == graph_of(spark, whole)


def test_title_case(spark):
    names = ["o'neil étude", "K-12 e-LEARNING", "(abc)def 3d", "", "ÉCOLE"]
    got = [r["t"] for r in spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(S.title_case(F.col("n")).alias("t")).collect()]
    assert got == [n.title() for n in names]


def test_ingest_finds_words_before_letters_of_other_scripts(spark, tmp_path):
    store = str(tmp_path / "log")
    ingest.create_store(spark, store)
    rules = spark.createDataFrame([(0, "M", "tion", r"tion\b", 0.6)], "place int, entity_type string, name string, pattern string, confidence double")
    for i, rows in enumerate([[("a", "nation"), ("b", "nationé")], [("c", "nationж"), ("d", "nations")]]):
        ingest.ingest_batch(spark.createDataFrame(rows, "key string, text string"), i, store, rules)
    assert [r["source_count"] for r in ingest.stored_entities(spark, store).collect()] == [3]


def test_ingest_counts_every_text_of_a_repeated_id(spark, con_of):
    from litgraph.plans import registry

    from .oracle import difference

    rows = [(1, "b the 123"), (1, "a of"), (2, "nation"), (2, "nation"), (None, "and"), (3, None), (4, "")]
    folder, con = con_of(rows)
    name = "p5_incremental_graph_ingest"
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], folder) is None


@pytest.fixture
def con_of(spark, tmp_path):
    """A folder with these documents, and DuckDB over it."""
    import duckdb

    def made(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        return str(tmp_path), con

    return made


def test_inverted_index_is_made_in_its_row(spark):
    from litgraph.sources import papers

    docs = spark.createDataFrame([(1, " b a  b"), (1, "c"), (2, " "), (3, None)], "doc_id long, text string")
    got = papers.inverted_index(docs)
    assert sorted((r["doc_id"], sorted(r["index"].items())) for r in got.collect()) == [(1, [("a", [2]), ("b", [1, 4])]), (1, [("c", [0])])]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
