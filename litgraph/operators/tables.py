"""Results in tables of papers: headers are classified, score cells become edges from a model to a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of headers (fixed values): parts of the header line that make a table's type,
TABLE_MODEL = ("model", "method", "approach", "system", "architecture")
TABLE_METRIC = ("accuracy", "f1", "bleu", "rouge", "precision", "recall", "score", "performance", "result", "error", "loss", "auc")
TABLE_DATASET = ("dataset", "benchmark", "corpus", "task")
#: and whole words that make a column's type.
MODEL = ("model", "method", "approach", "system", "architecture", "algorithm")
DATASET = ("dataset", "benchmark", "corpus", "task", "data")
METRIC = ("metric", "measure")
SCORE = ("accuracy", "f1", "bleu", "rouge", "precision", "recall", "score", "performance", "error", "loss", "auc", "map", "ndcg", "perplexity", "wer", "cer", "meteor")
#: Datasets that a caption may name, the first of them counts.
KNOWN_DATASETS = ("squad", "glue", "superglue", "imagenet", "coco", "cifar", "mnli", "sst", "qqp", "mrpc", "rte", "wnli")


def table_type(headers: Column) -> Column:
    """sota_comparison, dataset_summary, results or other."""
    line = F.lower(F.array_join(headers, " "))
    some = lambda words: line.rlike("|".join(words))
    return F.when(some(TABLE_MODEL) & some(TABLE_METRIC), "sota_comparison").when(some(TABLE_DATASET), "dataset_summary").when(some(TABLE_METRIC), "results").otherwise("other")


def column_type(header: Column) -> Column:
    """model, dataset, metric, score or other."""
    h = F.lower(F.trim(header))
    between = r"[\s_\-/]"
    holds = lambda words: h.rlike(rf"(?:^|{between})(?:{'|'.join(words)})(?:\z|{between})")
    return F.when(holds(MODEL), "model").when(holds(DATASET), "dataset").when(holds(METRIC), "metric").when(holds(SCORE) | h.rlike(r"^[a-z]+[-@\d]"), "score").otherwise("other")


def parse_score(text: Column) -> Column:
    """The number of a cell such as ``91.5``, ``0.856`` or ``91.5%``, without signs and footnote marks; else null."""
    clean = F.trim(F.regexp_replace(text, "[+*†‡§¶±-]", ""))
    return F.regexp_extract(clean, r"^(\d+\.?\d*)\s*%?$", 1).try_cast("double")


def caption_dataset(caption: Column) -> Column:
    lower = F.lower(caption)
    return F.coalesce(*(F.when(F.contains(lower, F.lit(d)), d) for d in KNOWN_DATASETS))


def table_results(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """EVALUATED_ON edges of tables (table_id, caption, headers array) and their rows (table_id, row_no, cells array).

    (table_id, row_no, score_col, source_name, target_name, metric_name, metric_value,
    raw_score). Only tables of results and comparisons with a column of models count; the
    first such column names the model (two characters or more, lower case). Every cell of a
    score column that is a number is an edge to the dataset in the row's first filled column
    of datasets, else to one that the caption names, else to ``unknown_dataset``.
    """
    # generators, so that filters on what they give are not computed again for each row below
    types = F.struct(F.transform("headers", column_type).alias("types"), table_type(F.col("headers")).alias("kind"))
    typed = tables.select("table_id", "headers", "caption", F.explode(F.array(types)).alias("t")).filter("t.kind in ('sota_comparison', 'results')")
    places = lambda kind: F.filter(F.transform("t.types", lambda t, i: F.when(t == kind, i)), lambda i: i.isNotNull())
    model = F.array_position("t.types", "model").cast("int") - 1
    typed = typed.select("table_id", "headers", caption_dataset(F.col("caption")).alias("named"), model.alias("model"), places("dataset").alias("datasets"), places("score").alias("scores")).filter("model >= 0")
    cell = lambda i: F.trim(F.get("cells", i))
    read = rows.join(typed, "table_id").withColumn("source_name", F.lower(cell(F.col("model")))).filter(F.length("source_name") >= 2)
    dataset = F.get(F.filter(F.transform("datasets", lambda i: F.lower(cell(i))), lambda d: d.isNotNull() & (d != "")), F.lit(0))
    scores = F.transform("scores", lambda i: F.struct(i.alias("score_col"), cell(i).alias("raw_score"), parse_score(cell(i)).alias("metric_value")))
    read = read.withColumn("target_name", F.coalesce(dataset, "named", F.lit("unknown_dataset"))).withColumn("s", F.explode(scores)).filter("s.metric_value is not null")
    return read.select("table_id", "row_no", "s.score_col", "source_name", "target_name", F.get("headers", F.col("s.score_col")).alias("metric_name"), "s.metric_value", "s.raw_score")


def table_entities(results: DataFrame) -> DataFrame:
    """(table_id, name, entity_type) of what edges of ``table_results`` name; a name has the type of its first use: model, dataset, then metric of a cell."""
    used = F.array(
        F.struct(F.lit(0).alias("o"), F.col("source_name").alias("name"), F.lit("Method").alias("entity_type")),
        F.struct(F.lit(1).alias("o"), F.nullif("target_name", F.lit("unknown_dataset")).alias("name"), F.lit("Dataset").alias("entity_type")),
        F.struct(F.lit(2).alias("o"), F.lower(F.trim("metric_name")).alias("name"), F.lit("Metric").alias("entity_type")),
    )
    each = results.select("table_id", "row_no", "score_col", F.explode(used).alias("u")).filter("u.name is not null and u.name <> ''")
    # a row's model comes before its scores
    order = F.struct("row_no", F.when(F.col("u.o") == 0, -1).otherwise(F.col("score_col")), "u.o")
    return each.groupBy("table_id", F.col("u.name").alias("name")).agg(F.min_by("u.entity_type", order).alias("entity_type"))
