"""Sharding by a hypergeometric communication matrix, in DataFrame operations only.

How many rows each source partition sends to each shard is drawn exactly: the matrix has
the distribution of a uniform shuffle into shards of given sizes. Each source partition
permutes its rows and cuts them by its row of the matrix; the rows are exchanged, and each
shard permutes what it has received.
"""

from __future__ import annotations

import random
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: Source partitions are cut so that one permutes about this many rows, and shards into parts of as many.
SOURCE_ROWS = 1 << 18
#: Tables of at most this many rows, one for each source or part, are broadcast; larger ones are joined by shuffling them.
BROADCAST_ROWS = 20_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones come with ``draws`` draws without replacement: inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = comb(good, mode) * comb(bad, draws - mode) / comb(good + bad, draws) if good + bad < 2000 else _density(good, bad, draws, mode)
    u, up, down, p_up, p_down = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if (u := u - p_up) <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if (u := u - p_down) <= 0:
                return down
    return mode


def _density(good: int, bad: int, draws: int, k: int) -> float:
    from math import exp, lgamma

    log = lambda n, m: lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1)
    return exp(log(good, k) + log(bad, draws - k) - log(good + bad, draws))


def communication_matrix(sources: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows that source i sends to shard j; columns sum to shard sizes at most one apart."""
    rng, total = random.Random(seed), sum(sources)
    room = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = []
    for n in sources:
        row, left, rest = [], n, sum(room)
        for j in range(n_shards):
            rest -= room[j]
            row.append(hypergeometric(rng, room[j], rest, left))
            left -= row[-1]
        room = [r - x for r, x in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(rows: DataFrame, n_shards: int, seed: int, order: list[str]) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1, sizes at most one apart) and ``slot`` (gapless from 0 in a shard).

    ``rows`` should be narrow: it is written once, so that source partitions stay what they
    are if executors are lost. ``order`` names the columns that tell rows apart; rows equal
    in all of them are interchangeable. An empty table gives an empty result. The driver
    holds one count per source partition and shard.
    """
    kept = durable(rows.withColumn("_source", F.spark_partition_id()))
    random_of = lambda n: F.xxhash64(*order, F.lit(seed + n))
    counted = lambda df: {r["_source"]: r["n"] for r in df.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    counts = counted(kept)
    pieces = -(-max(counts.values(), default=0) // SOURCE_ROWS)
    if pieces > 1:  # large source partitions count as several, cut at random
        cut = F.pmod(F.xxhash64(*order, F.monotonically_increasing_id(), F.lit(seed + 3)), F.lit(pieces)).cast("int")
        kept = durable(kept.withColumn("_source", F.col("_source") * pieces + cut))
        counts = counted(kept)
    sources = sorted(counts)
    # parts of a shard are ranked apart, so that a slot needs no task with a whole shard
    parts = max(1, -(-sum(counts.values()) // (n_shards * SOURCE_ROWS)))
    spread = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    ends = []
    for row in communication_matrix([counts[s] for s in sources], n_shards, seed):
        ends.append([sum(row[: j + 1]) for j in range(n_shards)])
    spark = rows.sparkSession
    matrix = spark.createDataFrame(list(zip(sources, ends, strict=True)), "_source int, _ends array<long>")
    local = kept.withColumn("_place", F.row_number().over(Window.partitionBy("_source").orderBy(random_of(0), *order)))
    sent = local.join(spread(matrix, len(sources)), "_source").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_place"))).cast("int"))
    sent = sent.withColumn("_part", F.pmod(F.xxhash64(*order, "_source", "_place", F.lit(seed + 1)), F.lit(parts)).cast("int")).drop("_ends")
    sizes = sent.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    # n_shards x parts rows
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).drop("_n")
    ranked = sent.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_part").orderBy(random_of(2), *order, "_source", "_place")))
    out = ranked.join(spread(starts, n_shards * parts), ["shard", "_part"]).withColumn("slot", F.col("_start") + F.col("_rank") - 1)
    return out.drop("_source", "_place", "_part", "_rank", "_start")


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A uniform shuffle of all documents into shards whose row counts are at most one apart (law ``rows``).

    Returns (id, size, text_crc32, law, shard, slot, grown_shard). Null texts count as empty:
    size 1, crc 0. Null ids and repeated rows are placed like any others. Texts are read
    once and not shuffled; only their size and crc are. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size: Column = F.octet_length(text).cast("long") + 1
    narrow = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffle_into_shards(narrow, n_shards, seed, ["doc_id", "text_crc32", "size"])
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
