from pyspark.sql import functions as F

from litgraph.operators import graph
from litgraph.plans import registry

from .oracle import connect, difference

SF = "/root/testdata/sf0.01"


def test_every_hundredth_concept_is_a_query(spark):
    name = "f3_vector_topk_hundredths"
    con = connect(SF)
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None
    want = con.sql("SELECT count(*) FROM part JOIN embeddings ON vec_id = p_partkey WHERE p_partkey % 100 = 0").fetchall()[0][0]
    assert registry.QUERIES[name](spark, SF).select("query_id").distinct().count() == want > 3


def test_blocks_agree_with_one_pass(spark):
    """Small blocks, equal vectors, a zero vector, null and short ones."""
    rows = [(f"v{i}", [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(60)]
    vectors = spark.createDataFrame([*rows, ("zero", [0.0, 0.0, 0.0]), ("none", None)], "id string, embedding array<double>")
    query = vectors.filter("embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    got = graph.vector_topk_blocks(vectors.union(spark.createDataFrame([("short", [1.0])], vectors.schema)), query, 4, vector_block=9, query_block=8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.vector_topk(vectors, query, 4).collect()))
    assert graph.vector_topk_blocks(vectors.filter("false"), query, 4).collect() == []
