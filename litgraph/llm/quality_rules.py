"""Quality classifier: a sparse ensemble of rules compiled into Spark column expressions.

Shallow boosted trees over text statistics propose rules (every path from a root), lasso
logistic regression keeps few of them with weights, and the kept rules become one Spark
expression, so scoring runs without Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classifier is fitted on at most this many labelled documents, the first by a hash of their id.
TRAINING_DOCS = 12_000
TREES, DEPTH, LASSO = 12, 3, 0.0015
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, in JVM functions; all are 0 for empty text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / chars
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    n_words, n_lines = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "upper": share(r"[^\p{Lu}]+"),
        "shouts": share("[^!]+"),
        "digits": share("[^0-9]+"),
        "symbols": share(r"[^#$%&*+/<=>@\\^_`|~{}\[\]]+"),
        "stops": share("[^.?,;:]+"),
        "letters": share(r"\P{L}+"),
        "word_size": F.length(F.regexp_replace(t, r"\s+", "")) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": n_words / n_lines,
        "repeated_words": F.size(F.filter(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"])) / n_words,
    }


#: The statistics, in the order of the feature vectors.
NAMES = ["log_chars", "upper", "shouts", "digits", "symbols", "stops", "letters", "word_size", "distinct_words", "distinct_lines", "line_words", "repeated_words"]


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions (statistic, whether above, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s) > F.lit(v) if above else F.col(s) <= F.lit(v) for s, above, v in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>' if above else '<='} {v:.4g}" for s, above, v in self.conditions)


def paths(node, names: list[str], so_far: tuple = ()) -> list[Rule]:
    """The conjunction at every node below the root of a fitted tree."""
    own = [Rule(so_far)] if so_far else []
    if node.numDescendants() == 0:
        return own
    split = node.split()
    name, value = names[split.featureIndex()], float(split.threshold())
    return own + paths(node.leftChild(), names, (*so_far, (name, False, value))) + paths(node.rightChild(), names, (*so_far, (name, True, value)))


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1, as an expression over the statistics' columns."""
        total = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumns({k: v.cast("double") for k, v in statistics(F.col(text_col)).items()})


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = TRAINING_DOCS, seed: int = 5) -> RuleEnsemble:
    """Fits the ensemble on at most ``max_docs`` labelled documents among those that ``usable``, a condition on ``id_col``, lets in.

    Rows with a null label or id teach nothing; labels that contradict one another count by
    their mean. Without labels, or with one class only, no rule is learned and the score is
    the share of label 1 (a half without labels). Only trees and weights reach the driver.
    """
    label = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"), usable.alias("usable")).filter("usable and id is not null and label is not null")
    label = label.groupBy("id").agg(F.when(F.avg("label") >= 0.5, 1.0).otherwise(0.0).alias("label"))
    # max_docs rows of an id and a number
    sample = F.broadcast(label.orderBy(F.xxhash64("id"), "id").limit(max_docs))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    rows = with_statistics(rows, "text").select("label", array_to_vector(F.array(*NAMES)).alias("features"), *NAMES).persist()
    try:
        share = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        n = sum(share.values())
        if len(share) < 2:
            p = min(max(share.get(1.0, 0) / n if n else 0.5, 0.001), 0.999)
            from math import log

            return RuleEnsemble(log(p / (1 - p)), [])
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=seed).fit(rows.select("label", "features"))
        rules = [*dict.fromkeys(r for t in trees.trees for r in paths(t._call_java("rootNode"), NAMES))]
        held = rows.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=True, maxIter=100).fit(held)
        return RuleEnsemble(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w != 0])
    finally:
        rows.unpersist()


def score_quality(docs: DataFrame, ensemble: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores every whole text: (id, the columns of ``keep``, score 0 to 1, predicted 1 if score >= threshold, else 0).

    Null texts score like empty ones. Repeated rows give repeated results, an empty table
    none; other columns are not read. A projection: no shuffle and no Python.
    """
    carried = {f"_{i}": c for i, c in enumerate((id_col, *keep))}
    rows = docs.select(*(F.col(c).alias(k) for k, c in carried.items()), F.col(text_col).alias("_text"))
    scored = with_statistics(rows, "_text").withColumn("_score", ensemble.score())
    predicted = F.when(F.col("_score") >= threshold, 1).otherwise(0)
    return scored.select(*(F.col(k).alias(c) for k, c in carried.items()), F.col("_score").alias("score"), predicted.alias("predicted"))
