"""Flows of reviews, quotas of projects, and what a user may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates_marked(papers: DataFrame, keys: list[str], columns: tuple[str, ...] = ("doi", "title")) -> DataFrame:
    """Adds whether an earlier paper (by n) of the same ``keys`` has this one's doi or title (is_duplicate); nulls equal nothing.

    The first n of each value is counted with map-side combining and joined back, so that no
    task holds all papers of one value.
    """
    out = papers
    for c in columns:
        first = papers.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.min("n").alias(f"_first_{c}"))
        out = out.join(first, [*keys, c], "left")
    earlier = [F.coalesce(F.col(f"_first_{c}") < F.col("n"), F.lit(False)) for c in columns]
    any_ = earlier[0]
    for e in earlier[1:]:
        any_ = any_ | e
    return out.withColumn("is_duplicate", any_).select(*papers.columns, "is_duplicate")


def review_flow(papers: DataFrame, keys: list[str]) -> DataFrame:
    """The flow of each review (``keys``) from its papers (n, doi, title, screened, included, has_pdf): one row of counts.

    identified, duplicates, records_screened = identified - duplicates, excluded (screened and
    not included), sought = records_screened - excluded, not_retrieved = sought - assessed,
    assessed (those with a PDF), reports_excluded = assessed - included, included. Null flags
    count as false. Differences may be negative; ``review_errors`` says which ones.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    counts = duplicates_marked(papers, keys).groupBy(*keys).agg(
        F.count("*").alias("identified"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("screened") & ~F.col("included")).alias("excluded"),
        F.count_if(yes("has_pdf")).alias("assessed"), F.count_if(yes("included")).alias("included"),
    )
    flow = counts.withColumn("records_screened", F.col("identified") - F.col("duplicates")).withColumn("sought", F.col("records_screened") - F.col("excluded"))
    flow = flow.withColumn("not_retrieved", F.col("sought") - F.col("assessed")).withColumn("reports_excluded", F.col("assessed") - F.col("included"))
    return flow.select(*keys, "identified", "duplicates", "records_screened", "excluded", "sought", "not_retrieved", "assessed", "reports_excluded", "included")


#: What is wrong with a flow (fixed values), each with when it holds.
REVIEW_ERRORS = {
    "Records screened exceeds records after deduplication": "records_screened > identified - duplicates",
    "Records excluded exceeds records screened": "excluded > records_screened",
    "Reports assessed exceeds eligible records": "assessed > records_screened - excluded",
    "Studies included exceeds reports assessed": "included > assessed",
}


def review_errors(flow: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, errors): an array of what is inconsistent in each flow, empty if nothing is."""
    return flow.select(*keys, F.array_compact(F.array(*(F.when(F.expr(c), F.lit(text)) for text, c in REVIEW_ERRORS.items()))).alias("errors"))


def quota_report(projects: DataFrame, plans: DataFrame, overrides: DataFrame, usage: DataFrame, day, default_plan: str = "free") -> DataFrame:
    """(project_id, daily_limit, used, remaining, exceeded, warning, api_calls) of each project on one day.

    ``projects`` is (project_id, plan), ``plans`` and ``overrides`` give daily_limit by plan and
    by project; an override wins, a missing or unknown plan is the default one. ``usage`` is
    (project_id, api_type, day, call_count). remaining is at least 0, exceeded from the limit
    on, warning over four fifths of it; api_calls maps each API, of which there are few, to
    its calls. Without any limit remaining is null.
    """
    per_api = usage.filter(F.col("day") == day).groupBy("project_id", "api_type").agg(F.sum("call_count").alias("n"))
    used = per_api.groupBy("project_id").agg(F.sum("n").alias("used"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("api_type", "n")))).alias("api_calls"))
    by_plan = plans.groupBy("plan").agg(F.max("daily_limit").alias("_plan_limit"))
    usual = by_plan.filter(F.col("plan") == default_plan).agg(F.max("_plan_limit").alias("_default"))
    own = overrides.groupBy("project_id").agg(F.max("daily_limit").alias("_own"))
    rows = projects.join(by_plan, "plan", "left").join(own, "project_id", "left").join(used, "project_id", "left").crossJoin(F.broadcast(usual))  # one row
    limit, n = F.coalesce("_own", "_plan_limit", "_default"), F.coalesce("used", F.lit(0))
    none = F.create_map().cast("map<string,bigint>")
    return rows.select("project_id", limit.alias("daily_limit"), n.alias("used"), F.when(limit.isNotNull(), F.greatest(limit - n, F.lit(0))).alias("remaining"), F.coalesce(n >= limit, F.lit(False)).alias("exceeded"), F.coalesce(n > 0.8 * limit, F.lit(False)).alias("warning"), F.coalesce("api_calls", none).alias("api_calls"))


def restrict_to_accessible(rows: DataFrame, user, owners: DataFrame, members: DataFrame, public: DataFrame) -> DataFrame:
    """The rows (project_id) that one user may see: of projects that they own or are a member of, and of public ones; no table of all users is needed."""
    mine = lambda df: df.filter(F.col("user_id") == user).select("project_id")
    return rows.join(mine(owners).union(mine(members)).union(public.select("project_id")).distinct(), "project_id", "left_semi")


def edges_with_shared_papers(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, most: int) -> DataFrame:
    """The ``most`` heaviest edges among ``nodes`` (id), ties by ids; CO_OCCURS_WITH edges with how many papers mention both ends, at least 1, others with null.

    ``mentions`` is (paper_id, id). Papers are joined to the kept edges only; no list of a
    node's papers is gathered.
    """
    ids = nodes.select("id").distinct()
    both = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    key = ["source_id", "target_id", "relationship_type"]
    kept = both.select(*key, "weight").orderBy(F.desc("weight"), *key).limit(most)
    said = mentions.select("paper_id", "id").distinct()
    pairs = kept.filter("relationship_type = 'CO_OCCURS_WITH'").join(said.withColumnRenamed("id", "source_id"), "source_id").join(said.withColumnRenamed("id", "target_id"), ["target_id", "paper_id"])
    n = pairs.groupBy(*key).agg(F.count("*").alias("_n"))
    shared = F.when(F.col("relationship_type") == "CO_OCCURS_WITH", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)))
    return kept.join(n, key, "left").select(*key, "weight", shared.alias("shared_papers"))
