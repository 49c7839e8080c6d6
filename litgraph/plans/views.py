"""The given tables as graph tables, once as DataFrames and once as SQL for the oracle.

Papers are orders, concepts parts, methods suppliers, authors customers. Ids are prefixed
by P, C, M and A. A concept's cluster and vector are those of the embedding with its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Graph:
    """Lazy graph tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    @property
    def papers(self) -> DataFrame:
        o = self.table("orders")
        doi = F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string"), F.lit("."), (F.col("o_orderkey") % 7).cast("string"))
        return o.select(self.key("P", "o_orderkey").alias("paper_id"), F.concat(F.col("o_orderpriority"), F.lit(" "), (F.col("o_orderkey") % 500).cast("string")).alias("title"), F.year("o_orderdate").alias("year"), doi.alias("doi"), self.key("A", "o_custkey").alias("author_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("n"))

    @property
    def concepts(self) -> DataFrame:
        e = self.table("embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding", F.col("label").alias("cluster_id"))
        return self.table("part").join(e, "p_partkey", "left").select(self.key("C", "p_partkey").alias("id"), F.lit("Concept").alias("entity_type"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), "embedding", "cluster_id", F.col("p_partkey").alias("n"), F.col("p_type").alias("source"))

    @property
    def entities(self) -> DataFrame:
        """Every entity: id, entity_type, name, year, n (its number, which stands for its time of creation)."""
        no_year = F.lit(None).cast("int").alias("year")
        parts = [
            self.papers.select(F.col("paper_id").alias("id"), F.lit("Paper").alias("entity_type"), F.col("title").alias("name"), "year", "n"),
            self.concepts.select("id", "entity_type", "name", no_year, "n"),
            self.table("supplier").select(self.key("M", "s_suppkey").alias("id"), F.lit("Method").alias("entity_type"), F.col("s_name").alias("name"), no_year, F.col("s_suppkey").alias("n")),
            self.table("customer").select(self.key("A", "c_custkey").alias("id"), F.lit("Author").alias("entity_type"), F.col("c_name").alias("name"), no_year, F.col("c_custkey").alias("n")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @property
    def paper_concepts(self) -> DataFrame:
        return self.table("lineitem").select(self.key("P", "l_orderkey").alias("paper_id"), self.key("C", "l_partkey").alias("concept_id")).distinct()

    @property
    def paper_methods(self) -> DataFrame:
        return self.table("lineitem").select(self.key("P", "l_orderkey").alias("paper_id"), self.key("M", "l_suppkey").alias("method_id")).distinct()

    @property
    def relationships(self) -> DataFrame:
        """Distinct typed edges: source_id, target_id, relationship_type, weight."""
        kind = lambda t: F.lit(t).alias("relationship_type")
        o = self.table("orders")
        before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        cites = o.withColumn("before", before).filter("before is not null")
        return (
            self.paper_concepts.select(F.col("paper_id").alias("source_id"), F.col("concept_id").alias("target_id"), kind("DISCUSSES_CONCEPT"))
            .union(self.paper_methods.select("paper_id", "method_id", kind("USES_METHOD")))
            .union(o.select(self.key("P", "o_orderkey"), self.key("A", "o_custkey"), kind("AUTHORED_BY")))
            .union(cites.select(self.key("P", "o_orderkey"), self.key("P", "before"), kind("CITES")))
            .withColumn("weight", F.lit(1.0))
        )

    @property
    def usage(self) -> DataFrame:
        e = self.table("events")
        status = F.when(F.col("event_type") == "error", 500).otherwise(200)
        return e.select(F.col("user_id"), F.col("event_type").alias("api_type"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("call_count"), status.alias("response_status"), F.col("value").alias("response_time_ms"), F.col("event_id").alias("id"))


SQL = """
papers AS (SELECT 'P' || o_orderkey AS paper_id, o_orderpriority || ' ' || (o_orderkey % 500) AS title, CAST(year(o_orderdate) AS INT) AS year, '10.1/' || o_custkey || '.' || (o_orderkey % 7) AS doi, 'A' || o_custkey AS author_id, o_orderstatus AS source, o_orderkey AS n FROM orders),
concepts AS (SELECT 'C' || p_partkey AS id, 'Concept' AS entity_type, p_name || ' ' || p_brand AS name, embedding, label AS cluster_id, p_partkey AS n, p_type AS source FROM part LEFT JOIN embeddings ON vec_id = p_partkey),
entities AS (SELECT paper_id AS id, 'Paper' AS entity_type, title AS name, year, n FROM papers UNION ALL SELECT id, entity_type, name, NULL, n FROM concepts UNION ALL SELECT 'M' || s_suppkey, 'Method', s_name, NULL, s_suppkey FROM supplier UNION ALL SELECT 'A' || c_custkey, 'Author', c_name, NULL, c_custkey FROM customer),
paper_concepts AS (SELECT DISTINCT 'P' || l_orderkey AS paper_id, 'C' || l_partkey AS concept_id FROM lineitem),
paper_methods AS (SELECT DISTINCT 'P' || l_orderkey AS paper_id, 'M' || l_suppkey AS method_id FROM lineitem),
cites AS (SELECT 'P' || o_orderkey AS source_id, 'P' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target_id FROM orders),
relationships AS (SELECT paper_id AS source_id, concept_id AS target_id, 'DISCUSSES_CONCEPT' AS relationship_type, 1.0::DOUBLE AS weight FROM paper_concepts UNION ALL SELECT paper_id, method_id, 'USES_METHOD', 1.0 FROM paper_methods UNION ALL SELECT paper_id, author_id, 'AUTHORED_BY', 1.0 FROM papers UNION ALL SELECT source_id, target_id, 'CITES', 1.0 FROM cites WHERE target_id IS NOT NULL),
usage AS (SELECT user_id, event_type AS api_type, ts, 1::BIGINT AS call_count, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS response_status, value AS response_time_ms, event_id AS id FROM events)
"""


def with_views(sql: str) -> str:
    """SQL text over the graph tables; ``sql`` may begin with further common tables, each followed by a comma and the word SELECT's query."""
    return f"WITH {SQL}, {sql}" if " AS (" in sql.split("SELECT", 1)[0] else f"WITH {SQL} {sql}"
