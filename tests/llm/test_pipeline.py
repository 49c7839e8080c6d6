import corpus_pipeline
from litgraph.llm.queries import QUERIES

from . import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r["doc_id"]: r["text"] for r in rows}
        assert after.items() <= before.items() and len(rows) == len(after)
        if name == "near_duplicates":
            want = brute.jaccard_components(list(before.items()))
            assert after.keys() == {i for i, (_, c) in want.items() if i == c}
        if name == "decontamination":
            assert after.keys() == {i for i, t in before.items() if not brute.leaks(t, items)[1]}
        if name == "language_id":
            assert after.keys() == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        before = after
    assert len(before) > 50
    whole = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in whole} == before.keys()


def test_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, "ok text here", "en", "s", 3), (2, "ok text here", "en", "s", 3), (3, "x" * 2000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS id", "2 AS score")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() <= len(rows)
        assert stage(spark, docs.filter("false"), sf).collect() == []


def test_all_registered():
    assert {*QUERIES} >= {"pipeline"} and sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == [*range(1, 14)]


def test_near_duplicates_of_repeated_and_null_ids(spark, sf):
    one, two, three, four = ("".join(f"{c}{i} " for i in range(12)) for c in "abcd")
    rows = [(5, one), (5, one), (1, two), (2, two), (2, three), (None, four), (None, four), (7, ""), (7, ""), (None, None), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), sf).collect()
    want = [(5, one), (1, two), (2, three), (None, four), (7, ""), (7, ""), (None, None)]
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(str, want))
