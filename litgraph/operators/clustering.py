"""How many clusters vectors have."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import durable


def silhouettes(rows: DataFrame, ks: list[int]) -> DataFrame:
    """(k, n, silhouette) for clusterings in columns k<k> of ``rows`` (features vector): mean silhouettes by squared distance.

    Exact without pairs: the mean squared distance from x to a cluster of n vectors with sum
    S and squared norms Q in all is |x|^2 - 2 x S / n + Q / n. One aggregation gives these for
    all clusterings at once (at most the sum of the ks rows), one more pass all silhouettes.
    A cluster of one counts as 0.
    """
    of = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("c")) for k in ks))).alias("of")
    long = rows.select("features", of).select("of.k", "of.c", "features")
    square = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x * x)
    found = long.groupBy("k", "c").agg(Summarizer.sum(F.col("features")).alias("S"), F.count("*").alias("n"), F.sum(square).alias("Q"))
    stats = sorted(found.select("k", "c", vector_to_array("S").alias("S"), "n", "Q").collect(), key=lambda r: (r["k"], r["c"]))
    sums, n, q = np.array([r["S"] for r in stats]), np.array([r["n"] for r in stats], float), np.array([r["Q"] for r in stats])
    at = {(r["k"], r["c"]): i for i, r in enumerate(stats)}
    own_rows = {k: np.array([at.get((k, c), -1) for c in range(max(ks) + 1)]) for k in ks}

    def rate(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            norm = (x * x).sum(axis=1)[:, None]
            distance = norm - 2 * (x @ sums.T) / n + q / n
            for k in ks:
                own = own_rows[k][batch.column(f"k{k}").to_numpy()]
                others = np.array([i for (kk, _), i in at.items() if kk == k])
                d = distance[:, others]
                is_own = others[None, :] == own[:, None]
                a = distance[np.arange(len(own)), own] * n[own] / np.maximum(n[own] - 1, 1)
                b = np.where(is_own, np.inf, d).min(axis=1)
                most = np.maximum(a, b)
                fine = (n[own] > 1) & np.isfinite(b) & (most > 0)
                s = np.where(fine, (b - a) / np.where(fine, most, 1), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(s)], pa.int64()), pa.array([float(s.sum())])], ["k", "n", "s"])

    parts = rows.select(vector_to_array("features").alias("x"), *(F.col(f"k{k}") for k in ks)).mapInArrow(rate, "k int, n long, s double")
    return parts.groupBy("k").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("silhouette"))


def optimal_k_silhouette(vectors: DataFrame, least: int = 2, most: int = 10, seed: int = 42) -> DataFrame:
    """Mean silhouettes of k-means for each k from ``least`` to ``most``, and which is best: (size, k, n, silhouette, best).

    ``vectors`` is (id, embedding). Vectors of different lengths are clustered apart (size);
    null vectors and those with null or non-finite components are left out, and lengths with
    fewer than ``least`` + 1 vectors. k is at most one less than the vectors. Distances are squared
    Euclidean; ties go to the smaller k. Each k is one fit; what it assigns and how good that
    is comes from common passes.
    """
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = durable(vectors.filter(fine).select(F.size("embedding").alias("size"), array_to_vector(F.transform("embedding", lambda e: e.cast("double"))).alias("features")))
    sizes = rows.groupBy("size").agg(F.count("*").alias("n")).collect()  # lengths of vectors, one or a few
    found = []
    for size in sorted(r["size"] for r in sizes if r["n"] > least and r["size"]):
        own = rows.filter(F.col("size") == size).select("features")
        ks = list(range(least, min(most, next(r["n"] for r in sizes if r["size"] == size) - 1) + 1))
        for k in ks:
            own = KMeans(k=k, seed=seed, predictionCol=f"k{k}").fit(own.select("features")).transform(own)
        found.append(silhouettes(own, ks).withColumn("size", F.lit(size)))
    if not found:
        return vectors.sparkSession.createDataFrame([], "size int, k int, n long, silhouette double, best boolean")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    top = out.groupBy("size").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("top"))
    return out.join(top, "size").select("size", "k", "n", "silhouette", (F.col("k") == F.col("top")).alias("best"))
