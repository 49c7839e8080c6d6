"""Aggregations over papers, edges and telemetry."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import spread


def pairs_per_paper(mentions: DataFrame, member: str) -> DataFrame:
    """Unordered pairs of members of each paper: (paper_id, a, b)."""
    dealt = spread(mentions.select("paper_id", member), "paper_id")
    a, b = dealt.select("paper_id", F.col(member).alias("a")), dealt.select("paper_id", F.col(member).alias("b"))
    return a.join(b, "paper_id").filter("a < b")


def cooccurrence(mentions: DataFrame, member: str, least: int = 2, scale: float = 10.0, papers: int = 10) -> DataFrame:
    """Pairs that occur together in at least ``least`` papers, with confidence min(1, n / scale) and the first papers."""
    rows = pairs_per_paper(mentions, member).groupBy("a", "b").agg(F.count("*").alias("n_papers"), F.slice(F.sort_array(F.collect_list("paper_id")), 1, papers).alias("papers")).filter(F.col("n_papers") >= least)
    return rows.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n_papers") / scale), 6))


def cross_relationships(left: DataFrame, right: DataFrame, least: int, scale: float, kind: str) -> DataFrame:
    """(source, target) pairs met in at least ``least`` papers; inputs hold (paper_id, source_id) and (paper_id, target_id)."""
    rows = spread(left, "paper_id").join(spread(right, "paper_id"), "paper_id").groupBy("source_id", "target_id").agg(F.count("*").alias("n_papers")).filter(F.col("n_papers") >= least)
    return rows.select("source_id", "target_id", F.lit(kind).alias("relationship_type"), F.round(F.least(F.lit(1.0), F.col("n_papers") / scale), 6).alias("confidence"))


def cooccurrence_jaccard(mentions: DataFrame, member: str, least: int) -> DataFrame:
    n = mentions.groupBy(member).agg(F.count("*").alias("n"))
    shared = pairs_per_paper(mentions, member).groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    rows = shared.join(n.select(F.col(member).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(member).alias("b"), F.col("n").alias("nb")), "b")
    return rows.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def latency_summary(usage: DataFrame, keys: list[str], cells: int = 1024) -> DataFrame:
    """Count, mean, p95 (the value at sorted place floor(0.95 n)) and greatest latency by key; rows without latency are left out.

    Latencies are counted in ``cells`` equal steps from the least to the greatest of a key;
    only those of the step that holds the place are ranked, so no task sorts a whole key.
    """
    v = F.col("response_time_ms")
    rows = usage.select(*keys, v, "id").filter(v.isNotNull())
    same = lambda a, b, more="": reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] + ([F.col(f"{a}.{more}") == F.col(f"{b}.{more}")] if more else []), F.lit(True))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))
    cell = F.when(F.col("s.most") == F.col("s.least"), 0).otherwise(F.least(F.lit(cells - 1), F.floor((v - F.col("s.least")) / (F.col("s.most") - F.col("s.least")) * cells))).cast("int")
    placed = rows.alias("r").join(stats.alias("s"), same("r", "s")).select(*(F.col(f"r.{k}").alias(k) for k in keys), v, "id", F.col("s.n").alias("n"), cell.alias("cell"))
    counts = placed.groupBy(*keys, "cell").agg(F.count("*").alias("held"), F.first("n").alias("n"))
    upto = F.sum("held").over(Window.partitionBy(*keys).orderBy("cell"))  # at most as many rows as cells
    place = F.floor(F.col("n") * F.lit("0.95").cast("decimal(3,2)")) + 1
    at = counts.withColumn("before", upto - F.col("held")).withColumn("place", place - F.col("before")).filter((F.col("place") >= 1) & (F.col("place") <= F.col("held")))
    near = placed.alias("p").join(at.alias("a"), same("p", "a", "cell")).select(*(F.col(f"p.{k}").alias(k) for k in keys), v, "id", F.col("a.place").alias("place"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(v, "id"))).filter("rank = place")
    out = stats.alias("s").join(ranked.alias("k"), same("s", "k"), "left")
    return out.select(*(F.col(f"s.{k}").alias(k) for k in keys), F.col("s.n").alias("n"), F.round("s.mean", 6).alias("mean_ms"), F.round("k.response_time_ms", 6).alias("p95_ms"), F.round("s.most", 6).alias("max_ms"))


def usage_daily(usage: DataFrame, since: str) -> DataFrame:
    day = F.to_date("ts")
    rows = usage.filter(day >= F.lit(since).cast("date")).groupBy("user_id", "api_type", day.alias("day"))
    return rows.agg(F.sum("call_count").alias("calls"), F.count("*").alias("requests"), F.round(F.avg("response_time_ms"), 6).alias("mean_ms"), F.count_if(F.col("response_status") >= 400).alias("errors"))


def temporal_timeline(entities: DataFrame, year: str = "year", top: int = 5) -> DataFrame:
    """Per year: new entities, running total and the first names. One row per year enters the running sum."""
    per = entities.filter(F.col(year).isNotNull())
    names = per.withColumn("_r", F.row_number().over(Window.partitionBy(year).orderBy("name", "id"))).filter(F.col("_r") <= top)
    names = names.groupBy(year).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda s: s["name"]), "|").alias("top_names"))
    counts = per.groupBy(year).agg(F.count("*").alias("new_count"))
    return counts.withColumn("cumulative", F.sum("new_count").over(Window.orderBy(year))).join(names, year)


def temporal_trends(first_last: DataFrame) -> DataFrame:
    """emerging, declining or stable entities of (id, first, last, papers); others are left out."""
    latest = first_last.agg(F.max("last").alias("latest"))  # one row
    kind = F.when((F.col("first") >= F.col("latest") - 2) & (F.col("papers") >= 2), "emerging").when(F.col("last") <= F.col("latest") - 3, "declining").when(F.col("papers") >= 3, "stable")
    return first_last.crossJoin(F.broadcast(latest)).withColumn("trend", kind).filter("trend is not null").drop("latest")


def prisma_flow(papers: DataFrame) -> DataFrame:
    """Counts of a review's flow; a paper is a duplicate if an earlier one has its doi or its title."""
    earlier = lambda key: (F.col(key).isNotNull()) & (F.min("n").over(Window.partitionBy(key)) < F.col("n"))
    rows = papers.withColumn("_dup", earlier("doi") | earlier("title"))
    return rows.agg(F.count("*").alias("identified"), F.count_if("_dup").alias("duplicates"), F.count_if(~F.col("_dup")).alias("screened"))


def classification_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def classification_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class, from the confusion counts."""
    counts = classification_counts(rows)
    classes = counts.select(F.col("truth").alias("label")).union(counts.select("predicted")).distinct()
    hit = counts.filter("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    said = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    real = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("real"))
    t = classes.join(hit, "label", "left").join(said, "label", "left").join(real, "label", "left").na.fill(0)
    p, r = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), F.when(F.col("real") > 0, F.col("tp") / F.col("real")).otherwise(0.0)
    t = t.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))
