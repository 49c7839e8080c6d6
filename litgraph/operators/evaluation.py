"""Evaluation of searches, tasks and answers: test queries from a graph, and what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregates import classification_metrics
from .graph import durable, vector_topk_blocks
from .relational import incident_edges

KS = (1, 3, 5, 10)


def mean(value: Column, name: str) -> Column:
    """Mean to six digits; 0 over no rows."""
    return F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias(name)


def words_of(text: Column) -> Column:
    """Words of a text between white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def ground_truth(entities: DataFrame, edges: DataFrame, most: int = 20, candidates: int = 100, pool: int = 200) -> DataFrame:
    """At most ``most`` test queries with what they should find: (query_no from 1, query, query_type, relevant ids).

    First come questions about the ``most // 2`` entities (id, name, entity_type) with the most
    edges, at most ``candidates``; names under three characters give none. The others ask for
    the ends of the ``pool`` heaviest edges between named entities, one for each pair of names
    whatever its direction. Ties go by id. Only these few rows are ordered in one task.
    """
    named = entities.select("id", "name", "entity_type").filter("name is not null")
    degree = incident_edges(edges).groupBy("id").agg(F.count("*").alias("_d"))
    best = named.join(degree, "id", "left").withColumn("_d", F.coalesce("_d", F.lit(0))).orderBy(F.desc("_d"), "id").limit(min(candidates, most // 2))
    kind, name = F.col("entity_type"), F.col("name")
    asked = F.when(kind == "Method", F.concat(F.lit("How is "), name, F.lit(" used in this research?")))
    asked = asked.when(kind == "Finding", F.concat(F.lit("What are the findings related to "), name, F.lit("?")))
    asked = asked.otherwise(F.concat(F.lit("What is "), name, F.lit(" and how is it discussed?")))
    place = F.row_number().over(Window.orderBy(F.desc("_d"), "id"))
    type_ = F.when(kind == "Method", "method_inquiry").otherwise("concept_search")
    about = best.filter(F.length("name") >= 3).select(F.lit(0).alias("part"), place.alias("place"), asked.alias("query"), type_.alias("query_type"), F.array("id").alias("relevant"))

    filled = named.filter("name <> ''")
    end = lambda e, n: filled.select(F.col("id").alias(e), F.col("name").alias(n))
    order = [F.desc("weight"), F.col("source_id"), F.col("target_id"), F.col("relationship_type")]
    top = edges.join(end("source_id", "_s"), "source_id").join(end("target_id", "_t"), "target_id").orderBy(*order).limit(pool)
    once = top.withColumn("_r", F.row_number().over(Window.partitionBy(F.least("_s", "_t"), F.greatest("_s", "_t")).orderBy(*order))).filter("_r = 1")
    question = F.concat(F.lit("What is the relationship between "), F.col("_s"), F.lit(" and "), F.col("_t"), F.lit("?"))
    between = once.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(*order)).alias("place"), question.alias("query"), F.lit("relationship_query").alias("query_type"), F.array("source_id", "target_id").alias("relevant"))
    number = F.row_number().over(Window.orderBy("part", "place"))
    return about.union(between).withColumn("query_no", number).filter(F.col("query_no") <= most).select("query_no", "query", "query_type", "relevant")


def retrieval_report(truth: DataFrame, found: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Precision and recall at each k, mean reciprocal rank and hit rate at the greatest k, over all queries and by type: one row for each scope.

    ``truth`` is (query_no, query_type, relevant), ``found`` (query_no, id, place from 1, each
    id once). Queries that found nothing, or have nothing to find, count as 0.
    """
    relevant = F.array_distinct("relevant")
    wanted = truth.select("query_no", F.explode(relevant).alias("id"))
    hit = lambda k: F.count_if(F.col("place") <= k).alias(f"hit{k}")
    hits = found.join(wanted, ["query_no", "id"]).groupBy("query_no").agg(F.min("place").alias("first"), *(hit(k) for k in ks))
    rows = truth.select("query_no", "query_type", F.size(relevant).alias("wanted")).join(hits, "query_no", "left")
    rows = rows.select("*", F.explode(F.array(F.lit("all"), "query_type")).alias("scope"))
    got = lambda k: F.coalesce(f"hit{k}", F.lit(0))
    at = [m for k in ks for m in (mean(got(k) / k, f"precision_{k}"), mean(F.coalesce(F.try_divide(got(k), F.col("wanted")), F.lit(0.0)), f"recall_{k}"))]
    first = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return rows.groupBy("scope").agg(F.count("*").alias("n_queries"), *at, mean(first, "mrr"), mean((got(max(ks)) > 0).cast("double"), "hit_rate"))


def evaluate_retrieval(entities: DataFrame, edges: DataFrame, most: int = 20, ks: tuple[int, ...] = KS) -> DataFrame:
    """How well search by vector finds what test queries made from the graph ask for.

    ``entities`` is (id, name, entity_type, embedding). The first entity of a query lends it
    its vector, all entities with a vector are searched; without one the query finds nothing.
    """
    truth = durable(ground_truth(entities, edges, most))
    asked = truth.select("query_no", F.element_at("relevant", 1).alias("id")).join(entities.select("id", "embedding"), "id")
    queries = asked.select(F.col("query_no").alias("query_id"), F.col("embedding").alias("q"))
    found = vector_topk_blocks(entities.select("id", "embedding"), queries, max(ks)).withColumnRenamed("query_id", "query_no")
    return retrieval_report(truth, found, ks)


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """Over (truth, predicted): one row (n, correct, accuracy, macro_f1); classes that only one side names count too, null reads as empty."""
    filled = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("truth", "predicted")))
    right = F.col("truth") == F.col("predicted")
    n = filled.agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), mean(right.cast("double"), "accuracy"))
    return n.crossJoin(classification_metrics(filled).agg(mean(F.col("f1"), "macro_f1")))  # one row each


def outcome_rates() -> list[Column]:
    """Aggregates over (success, partial, time_ms): partial counts where success does not hold, times of 0 and null are no times."""
    done = F.coalesce("success", F.lit(False))
    partly = F.coalesce("partial", F.lit(False)) & ~done
    one = lambda c, name: mean(c.cast("double"), name)
    return [one(done, "success_rate"), one(partly, "partial_rate"), one(~done & ~partly, "failure_rate"), mean(F.when(F.col("time_ms") != 0, F.col("time_ms")), "mean_ms")]


def task_outcomes(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(n, successful, success_rate, partial_rate, failure_rate, mean_ms) by ``keys`` of tasks (success, partial, time_ms)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("success").alias("successful"), *outcome_rates())


def error_types(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How often each type of error occurred, by ``keys``; over (error, error_type), where a missing type is unknown."""
    failed = rows.filter("error is not null and error <> ''")
    return failed.groupBy(*keys, F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n"))


def task_types(rows: DataFrame) -> DataFrame:
    """(expected_intent, n, accuracy, success_rate, mean_ms) of tasks (expected_intent, predicted_intent, success, time_ms); null predictions are wrong."""
    right = F.coalesce(F.col("expected_intent") == F.col("predicted_intent"), F.lit(False)).cast("double")
    done = F.coalesce("success", F.lit(False)).cast("double")
    return rows.filter("expected_intent is not null").groupBy("expected_intent").agg(F.count("*").alias("n"), mean(right, "accuracy"), mean(done, "success_rate"), mean(F.coalesce("time_ms", F.lit(0.0)), "mean_ms"))


def keyword_share(response: Column, keywords: Column) -> Column:
    """Share of the keywords that a text holds in any case; 0 without keywords."""
    text = F.lower(F.coalesce(response, F.lit("")))
    held = F.size(F.filter(keywords, lambda k: F.contains(text, F.lower(k))))
    return F.when(F.size(keywords) > 0, held / F.size(keywords)).otherwise(0.0)


def citation_share(cited: Column, expected: Column) -> Column:
    """Distinct expected citations that are cited, over the expected ones; 0 where none is expected."""
    both = F.size(F.array_intersect(F.coalesce(cited, F.array().cast("array<string>")), expected))
    return F.when(F.size(expected) > 0, both / F.size(expected)).otherwise(0.0)


def answer_quality(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(n, keyword_coverage, mean_words, citation_accuracy) by ``keys`` of answers (response, keywords, cited, expected)."""
    size = F.size(words_of(F.col("response"))).cast("double")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), mean(keyword_share(F.col("response"), F.col("keywords")), "keyword_coverage"), mean(size, "mean_words"), mean(citation_share(F.col("cited"), F.col("expected")), "citation_accuracy"))


def end_to_end_metrics(results: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row over whole runs: joint success, latency, classification, execution, retrieval and answers.

    ``results`` is (predicted_intent, expected_intent, success, partial, time_ms, latency_ms,
    retrieved, relevant, response, keywords), the lists as arrays. A run succeeds if its intent
    is right and it was carried out. Everything but the F1 of classes comes from one pass;
    an empty table gives one row of zeros.
    """
    none = F.array().cast("array<string>")
    texts = results.select("*", *(F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("predicted_intent", "expected_intent")), *(F.coalesce(c, none).alias(f"_{c}") for c in ("retrieved", "relevant")))
    right = F.col("_predicted_intent") == F.col("_expected_intent")
    wanted = F.size(F.array_distinct("_relevant"))
    hits = lambda k: F.size(F.array_intersect(F.slice("_retrieved", 1, k), F.col("_relevant")))
    places = F.filter(F.transform("_relevant", lambda r: F.array_position("_retrieved", r)), lambda p: p > 0)
    at = [m for k in ks for m in (mean(hits(k) / k, f"precision_{k}"), mean(F.when(wanted > 0, hits(k) / wanted).otherwise(0.0), f"recall_{k}"))]
    row = texts.agg(
        F.count("*").alias("n"),
        mean((right & F.coalesce("success", F.lit(False))).cast("double"), "overall_success_rate"),
        mean(F.when(F.col("latency_ms") != 0, F.col("latency_ms")), "mean_latency_ms"),
        mean(right.cast("double"), "accuracy"),
        *outcome_rates(),
        *at,
        mean(F.coalesce(1 / F.array_min(places), F.lit(0.0)), "mrr"),
        mean((hits(max(ks)) > 0).cast("double"), "hit_rate"),
        mean(keyword_share(F.col("response"), F.col("keywords")), "keyword_coverage"),
        mean(F.size(words_of(F.col("response"))).cast("double"), "mean_words"),
    )
    classes = classification_metrics(texts.select(F.col("_expected_intent").alias("truth"), F.col("_predicted_intent").alias("predicted")))
    return row.crossJoin(classes.agg(mean(F.col("f1"), "macro_f1")))  # one row each
