"""Papers from tables and provider records, and what is kept of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Screening decisions that drop a paper (fixed values).
REJECTED = ("exclude", "excluded", "reject", "rejected")
#: Columns of a paper; what a table has besides goes to its properties.
ID_COLUMNS = ("paper_id", "id", "doi")
KNOWN = (*ID_COLUMNS, "title", "abstract", "authors", "year", "decision")


def normalize_papers(raw: DataFrame) -> DataFrame:
    """(paper_id, title, abstract, authors array, year int, properties map) of a table of strings.

    Rows with a rejecting ``decision`` go. The id is the first of paper_id, id and doi that
    is not empty; a year that is no number is null; empty extra columns are no properties.
    """
    has = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    filled = lambda c: F.nullif(F.trim(has(c)), F.lit(""))
    extra = [c for c in raw.columns if c not in KNOWN]
    properties = F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]) if extra else F.create_map().cast("map<string,string>")
    kept = raw.filter(~F.lower(F.coalesce(F.trim(has("decision")), F.lit(""))).isin(*REJECTED))
    return kept.select(
        F.coalesce(*(filled(c) for c in ID_COLUMNS)).alias("paper_id"),
        filled("title").alias("title"),
        filled("abstract").alias("abstract"),
        S.split_authors(filled("authors")).alias("authors"),
        filled("year").try_cast("double").cast("int").alias("year"),
        F.map_filter(properties, lambda _, v: F.coalesce(v, F.lit("")) != "").alias("properties"),
    )


def read_papers_csv(spark: SparkSession, path: str) -> DataFrame:
    return normalize_papers(spark.read.csv(path, header=True, multiLine=False, escape='"'))


def read_graph(spark: SparkSession, path: str, project_id: str) -> dict[str, DataFrame]:
    """Entities, relationships, papers and chunks of one project, from folders partitioned by project_id."""
    return {t: spark.read.parquet(f"{path}/{t}").filter(F.col("project_id") == project_id) for t in ("entities", "relationships", "papers", "chunks")}


def abstract_from_inverted_index(index: Column) -> Column:
    """Text of a map from word to positions; positions without a word become empty words.

    The words are sorted by position once, so long texts cost n log n.
    """
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    words = F.array_sort(placed)
    before = F.concat(F.array(F.lit(0)), F.transform(words, lambda x: x["p"].cast("int")))
    # one longer than the words: its last pair has no word and is skipped
    spaced = F.zip_with(words, before, lambda x, p: F.concat(F.repeat(F.lit(" "), x["p"].cast("int") - p), x["w"]))
    return F.array_join(spaced, "")


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, index map of word to sorted positions) of each row with words, which are what single spaces part; empty ones are left out.

    A text's words stand in its row, so nothing is shuffled. Rows that share an id stay apart.
    """

    @F.arrow_udf("array<struct<w:string,places:array<int>>>")
    def entries(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("w", pa.string()), ("places", pa.list_(pa.int32()))]))

        def index(text: str | None) -> list[dict]:
            places: dict[str, list[int]] = {}
            for i, w in enumerate((text or "").split(" ")):
                if w:
                    places.setdefault(w, []).append(i)
            return [{"w": w, "places": p} for w, p in places.items()]

        # few texts at a time are Python objects
        return pa.concat_arrays([pa.array([index(t) for t in texts.slice(i, 64).to_pylist()], kind) for i in range(0, len(texts), 64)] or [pa.array([], kind)])

    return docs.select(id_col, entries(text_col).alias("e")).filter(F.size("e") > 0).select(id_col, F.map_from_entries("e").alias("index"))


def upsert_entities(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Merges by ``keys``, which must be unique in both: the existing id stays, incoming properties win, the incoming embedding wins if there is one, sources are united."""
    old, new = existing.alias("old"), incoming.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    none = F.create_map().cast("map<string,string>")
    was, now = F.coalesce("old.properties", none), F.coalesce("new.properties", none)
    no_source = F.array().cast("array<string>")
    return old.join(new, on, "full").select(
        F.coalesce("old.id", "new.id").alias("id"),
        *(F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in keys),
        F.map_concat(F.map_filter(was, lambda k, _: ~F.map_contains_key(now, k)), now).alias("properties"),
        F.coalesce("new.embedding", "old.embedding").alias("embedding"),
        F.array_union(F.coalesce("old.source_paper_ids", no_source), F.coalesce("new.source_paper_ids", no_source)).alias("source_paper_ids"),
    )


def incremental_new_items(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def ingest_counts(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: how many incoming rows were checked, added and skipped."""
    known = stored.select(key).distinct().withColumn("_known", F.lit(1))
    marked = incoming.select(key).join(known, key, "left")
    added = F.count_if(F.col("_known").isNull())
    return marked.agg(F.count("*").alias("checked"), added.alias("added"), (F.count("*") - added).alias("skipped"))


def retention_filter(rows: DataFrame, ts_col: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; rows without a time stay."""
    return rows.filter(F.col(ts_col).isNull() | (F.col(ts_col) >= as_of - F.make_dt_interval(F.lit(days))))


def replace_project_results(rows: DataFrame, path: str) -> None:
    """Rewrites the partitions of the projects in ``rows`` and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)
