"""Where entities, relationships and gaps are spoken of, and graphs from plain records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import dedupe_relationships, top_by

#: Shapes of the works that providers send (fixed values).
WORKS = {
    "openalex": "struct<id:string,display_name:string,publication_year:int,doi:string,cited_by_count:long,authorships:array<struct<author:struct<display_name:string>>>>",
    "semantic_scholar": "struct<paperId:string,title:string,year:int,externalIds:struct<DOI:string>,citationCount:long,authors:array<struct<name:string>>>",
    "zotero": "struct<key:string,data:struct<title:string,date:string,DOI:string,creators:array<struct<firstName:string,lastName:string>>>>",
}


def entities_in_collection(entities: DataFrame, key: str, keys_col: str = "collections") -> DataFrame:
    return entities.filter(F.array_contains(keys_col, key))


def papers_pending_sync(papers: DataFrame, synced: DataFrame) -> DataFrame:
    """Papers (project_id, key, created) without a key that are newer than their project's last success (project_id, last); any age where there was none."""
    rows = papers.filter("key is null").join(synced, "project_id", "left")
    return rows.filter(F.col("last").isNull() | (F.col("created") > F.col("last"))).drop("last")


def entity_source_chunks(entities: DataFrame, chunks: DataFrame, papers: DataFrame, k: int) -> DataFrame:
    """The first ``k`` chunks (chunk_id, paper_id, place) that each entity (id, chunk_ids as JSON) names, with their papers' titles where known; unknown chunks are passed over."""
    named = entities.select("id", F.explode(F.from_json("chunk_ids", "array<string>")).alias("chunk_id")).distinct()
    rows = top_by(named.join(chunks, "chunk_id"), ["id"], [F.col("place"), F.col("chunk_id")], k)
    return rows.join(papers.select("paper_id", "title"), "paper_id", "left").select("id", "chunk_id", "paper_id", "title", "place")


def gap_overview(gaps: DataFrame, clusters: DataFrame) -> DataFrame:
    """Gaps (gap_id, a, b, gap_strength, status) that were not dismissed, with the labels of both clusters (cluster_id, label)."""
    called = lambda c: clusters.select(F.col("cluster_id").alias(c), F.col("label").alias(f"label_{c}"))
    open_ = gaps.filter(~F.col("status").eqNullSafe("dismissed"))
    return open_.join(called("a"), "a", "left").join(called("b"), "b", "left").orderBy(F.desc("gap_strength"), "gap_id")


def says(text: Column, name: Column) -> Column:
    """Whether a text holds a name, without regard to case; signs have no special meaning."""
    return F.contains(F.lower(text), F.lower(name))


def entity_chunk_links(entities: DataFrame, chunks: DataFrame, least: int = 3) -> DataFrame:
    """Distinct (entity_id, chunk_id): a paper's chunks (paper_id, chunk_id, text) that hold the name, of ``least`` characters or more, of one of its entities (paper_id, entity_id, name)."""
    rows = entities.filter(F.length("name") >= least).join(chunks.select("paper_id", "chunk_id", "text"), "paper_id")
    return rows.filter(says(F.col("text"), F.col("name"))).select("entity_id", "chunk_id").distinct()


def co_mention_chunks(pairs: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The newest ``k`` chunks (project_id, chunk_id, text, n) that hold both names of a pair (project_id, rel_id, source_name, target_name)."""
    rows = pairs.join(chunks, "project_id").filter(says(F.col("text"), F.col("source_name")) & says(F.col("text"), F.col("target_name")))
    return top_by(rows.select("rel_id", "chunk_id", "text", "n"), ["rel_id"], [F.desc("n"), F.col("chunk_id")], k)


def evidence_cascade(relationships: DataFrame, tiers: list[tuple[str, DataFrame]], chars: int = 2000) -> DataFrame:
    """Evidence (rel_id, chunk_id, text) of the first tier that has any for a relationship (rel_id), texts cut to ``chars``; source ``none`` without any."""
    ranked = reduce(DataFrame.unionByName, [t.select("rel_id", "chunk_id", F.substring("text", 1, chars).alias("text"), F.lit(i).alias("_tier"), F.lit(name).alias("source")) for i, (name, t) in enumerate(tiers)])
    best = ranked.withColumn("_best", F.min("_tier").over(Window.partitionBy("rel_id"))).filter("_tier = _best").drop("_tier", "_best")
    return relationships.select("rel_id").distinct().join(best, "rel_id", "left").withColumn("source", F.coalesce("source", F.lit("none")))


def build_all_relationships(parts: list[DataFrame]) -> DataFrame:
    """All kinds of edges as one table (source_id, target_id, relationship_type, weight), each edge once."""
    return dedupe_relationships(reduce(DataFrame.unionByName, [p.select("source_id", "target_id", "relationship_type", "weight") for p in parts]))


def typed_record_graph(records: DataFrame, id_col: str, kind: str, fields: dict[str, tuple[str, str, float]]) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_type, name) and edges (source, target_type, target, relationship_type, weight) of records.

    ``fields`` gives for each list column the type of its members, and the type and weight of
    the edge from the record to them. Blank members and repeats are left out.
    """
    edges = []
    for column, (target, relation, weight) in fields.items():
        rows = records.select(F.col(id_col).cast("string").alias("source"), F.explode(column).alias("_m")).select("source", F.trim(F.col("_m").cast("string")).alias("target"))
        edges.append(rows.filter("target <> ''").distinct().select("source", F.lit(target).alias("target_type"), "target", F.lit(relation).alias("relationship_type"), F.lit(weight).alias("weight")))
    every = reduce(DataFrame.unionByName, edges)
    own = records.select(F.lit(kind).alias("entity_type"), F.col(id_col).cast("string").alias("name"))
    return own.union(every.select("target_type", "target")).distinct(), every


def normalize_api_works(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Works of providers (provider, JSON) in one schema: provider, work_id, title, year, doi, citations, authors.

    What a provider does not send is null; JSON that can't be read gives nulls, other providers no rows.
    """
    from ..functions.scalars import normalize_doi

    def one(provider: str, **columns: str) -> DataFrame:
        w = rows.filter(F.col("provider") == provider).select("provider", F.from_json(json_col, WORKS[provider]).alias("w"))
        return w.select("provider", *(F.expr(c).alias(n) for n, c in columns.items()))

    parts = [
        one("openalex", work_id="w.id", title="w.display_name", year="w.publication_year", doi="w.doi", citations="w.cited_by_count", authors="w.authorships.author.display_name"),
        one("semantic_scholar", work_id="w.paperId", title="w.title", year="w.year", doi="w.externalIds.DOI", citations="w.citationCount", authors="w.authors.name"),
        one("zotero", work_id="w.key", title="w.data.title", year="cast(nullif(regexp_extract(w.data.date, '[0-9]{4}', 0), '') as int)", doi="w.data.DOI", authors="transform(w.data.creators, c -> trim(concat_ws(' ', c.firstName, c.lastName)))"),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.withColumn("doi", normalize_doi(F.col("doi")))


def tfidf_features(names: DataFrame, most: int = 64, stop: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, weight): names (id, name) as unit vectors over the ``most`` commonest words of two characters or more; idf = ln((1 + n) / (1 + df)) + 1."""
    words = names.select("id", F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("term")).filter((F.length("term") > 1) & ~F.col("term").isin(*stop))
    counts = words.groupBy("id", "term").agg(F.count("*").alias("tf"))
    kept = counts.groupBy("term").agg(F.sum("tf").alias("uses"), F.count("*").alias("df")).orderBy(F.desc("uses"), "term").limit(most)
    n = names.agg(F.count("*").alias("n"))  # one row
    idf = F.broadcast(kept.crossJoin(n).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))  # at most ``most`` rows
    rows = counts.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
    return rows.select("id", "term", (F.col("x") / length).alias("weight"))
