"""Embedding near-duplicates by spherical-cap filters.

Filter directions form structured product codes: for each code a vector is rotated at
random and cut into two blocks, each block has its own random unit codewords, and every pair
of codewords is a direction. Because a direction's score is the sum of two codeword scores,
only codewords that reach the height together with the best of the other block are paired
when the list of all directions that a vector exceeds is decoded. The directions of one code
depend on each other, so several codes are rotated independently, as many as it takes until
pairs right at the threshold are rarely missed. Vectors are joined on the directions they
share and verified by exact cosines, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, cos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable

SIMILAR = 0.9
#: Vectors that a direction is meant to hold; the cap's height follows from it and the number of vectors.
LOAD = 256
#: Share of the pairs right at the threshold that may be missed; codes are added until PAIRS random ones are missed no more often.
MISSED = 0.01
PAIRS = 4000
#: Directions that such a pair would share on average in CODES codes; they set the number of codewords, the miss rate does not rest on them.
SHARED = 4.5
CODES = 32
#: Vectors of one direction that meet in one task.
BLOCK = 1024


def caps(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles up to a right one, and the share of the sphere in ``size`` dimensions within each of a point."""
    angle = np.linspace(0, pi / 2, 200_001)
    density = np.sin(angle) ** (size - 2)
    share = np.concatenate([[0], np.cumsum(density[1:] + density[:-1])])
    return angle, share / (2 * share[-1])


class CapFilters:
    """The product codes for ``n`` vectors of ``size`` components."""

    def __init__(self, n: int, size: int, similar: float, seed: int):
        rng, space = np.random.default_rng(seed), max(size, 2)
        angle, share = caps(space)
        # a cap much smaller than the angle of a pair would hold next to no pair
        at = max(np.interp(min(0.02, LOAD / max(n, 1)), share, angle), min(acos(similar), pi / 2))
        held, self.height = np.interp(at, angle, share), cos(at)
        # with one vector on the cap's rim, the other must lie so near to it in the space across
        across = self.height * sqrt((1 - similar) / ((1 + similar) * (1 - self.height**2)))
        both = np.interp(acos(min(across, 1)), *caps(space - 1)) if space > 2 else 0.5
        self.words = max(2, ceil(sqrt(SHARED / (held * max(both, 0.01) * CODES))))
        self.size, self.cut, self.codes = size, space // 2, []
        turn = lambda: np.linalg.qr(rng.standard_normal((space, space)))
        unit = lambda m, k: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((m, k)))
        x, y = unit(PAIRS, space), rng.standard_normal((PAIRS, space))
        y -= (x * y).sum(1, keepdims=True) * x
        y = similar * x + sqrt(1 - similar * similar) * y / np.linalg.norm(y, axis=1, keepdims=True)
        while len(x) > MISSED * PAIRS:
            q, r = turn()
            code = (q * np.sign(np.diag(r)), unit(self.words, self.cut), unit(self.words, space - self.cut))
            self.codes.append(code)
            keys = [row * self.words**2 + direction for row, direction in (self.exceeded(code, z) for z in (x, y))]
            apart = np.setdiff1d(np.arange(len(x)), np.intersect1d(*keys) // self.words**2)
            x, y = x[apart], y[apart]

    def exceeded(self, code: tuple[np.ndarray, np.ndarray, np.ndarray], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The directions of a code whose score with each unit vector is at least the height, as (row, direction) in order."""
        turned = unit @ code[0][: unit.shape[1]]
        a, b, least = turned[:, : self.cut] @ code[1].T, turned[:, self.cut :] @ code[2].T, self.height * sqrt(2)
        row, i = np.nonzero(a >= least - b.max(axis=1, keepdims=True))
        rows, found = [row[:0]], [i[:0]]
        step = max(1, (1 << 21) // self.words)
        for start in range(0, len(row), step):
            r, w = row[start : start + step], i[start : start + step]
            k, j = np.nonzero(b[r] >= (least - a[r, w])[:, None])
            rows.append(r[k])
            found.append(w[k] * self.words + j)
        return np.concatenate(rows), np.concatenate(found)

    def decode(self, unit: np.ndarray) -> pa.ListArray:
        """The directions of all codes whose score with each unit vector is at least the height, in order."""
        found = [self.exceeded(code, unit) for code in self.codes]
        rows = np.concatenate([row for row, _ in found])
        directions = np.concatenate([k * self.words**2 + direction for k, (_, direction) in enumerate(found)])
        ends = np.cumsum(np.bincount(rows, minlength=len(unit)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(directions[np.argsort(rows, kind="stable")], pa.int32()))


def unit_vectors(arrays: pa.Array) -> np.ndarray:
    x = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arrays), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shared_before(lists: list[np.ndarray], others: list[np.ndarray], direction: int) -> np.ndarray:
    """Whether a vector of either side shares a direction below this one."""
    known = np.unique(np.concatenate([*lists, *others]))
    known = known[known < direction]

    def table(rows):
        t = np.zeros((len(rows), len(known)), np.float32)
        for i, own in enumerate(rows):
            t[i, np.searchsorted(known, own[own < direction])] = 1
        return t

    return table(lists) @ table(others).T > 0


def compare(key: tuple, group: pa.Table, similar: float) -> pa.Table:
    """Links of one block pair of a direction: counts by vector and a spanning forest of the links.

    A pair counts only at the first direction that it shares, so counts add up over directions.
    """
    direction, i, j = (k.as_py() for k in key)
    ids, weight, side = group.column("rep").to_numpy(), group.column("weight").to_numpy(), group.column("block").to_numpy()
    x = unit_vectors(group.column("embedding").combine_chunks())
    held = group.column("directions").combine_chunks()
    lists = np.split(held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())[:-1])
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    near = x[left] @ x[right].T >= similar
    if i == j:
        np.fill_diagonal(near, False)
    rows, columns = near.any(1), near.any(0)
    left, right, near = left[rows], right[columns], near[rows][:, columns]
    out = {"id": [np.zeros(0, np.int64)], "other": [np.zeros(0, np.int64)], "n": [np.zeros(0, np.int64)]}
    if near.size:
        first = near & ~shared_before([lists[k] for k in left], [lists[k] for k in right], direction)
        for own, total in ((left, first @ weight[right]), *([(right, weight[left] @ first)] if i != j else [])):
            out["id"].append(ids[own])
            out["other"].append(ids[own])
            out["n"].append(total.astype(np.int64))
        root = {k: k for k in {*left.tolist(), *right.tolist()}}

        def find(k):
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for a, b in zip(*np.nonzero(near), strict=True):
            p, q = find(int(left[a])), find(int(right[b]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out["id"].append(ids[[left[a]]])
                out["other"].append(ids[[right[b]]])
                out["n"].append(np.zeros(1, np.int64))
    return pa.table({k: np.concatenate(v).astype(np.int64) for k, v in out.items()})


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similar: float = SIMILAR, seed: int = 11) -> DataFrame:
    """Links between vectors of cosine ``similar`` or more: (id, n_links long, component_id long, kept boolean).

    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest id
    reachable by links, itself included, ``kept`` says whether it is the vector's own.
    Only vectors of the same length are compared, by codes of their own. Vectors that are null,
    empty, zero or that hold null or non-finite components link with nothing. Ids are
    integers; rows with a null id count as links of others and connect them, their component
    is the smallest id reachable, null if there is none. Rows with equal vectors are linked
    without being compared. Repeated rows are vectors of their own; an empty table gives an
    empty result; other columns are not read. No pair below the threshold is returned; of
    those right at it 1 - MISSED are expected, and more of those above, at any number and
    length of vectors. The driver holds the number of vectors and the codes of each length.
    Large groups are cut into blocks that meet in pairs, and links are counted where they are
    found, never emitted.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.withColumn("embedding", F.when(fine, F.transform(v, lambda e: e + F.lit(0.0))))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(seed), "embedding"), "size": F.when(v.isNotNull(), F.size(v))})
    # vectors that are equal become one, with its number of rows as weight; a class of null ids has a node too
    classes = rows.filter("size is not null").groupBy("size", "h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = durable(classes.withColumn("rep", F.monotonically_increasing_id()))
    # a direction is meant to hold LOAD vectors: no more of a length than that need a single one
    numbers = {r["size"]: r["count"] for r in classes.groupBy("size").count().filter("count > 1").collect()}
    shared = spark.sparkContext.broadcast({size: CapFilters(n, size, similar, seed) if n > LOAD else None for size, n in numbers.items()})

    def listed(part: pa.RecordBatch, code: CapFilters | None) -> pa.RecordBatch:
        n = part.num_rows
        lists = code.decode(unit_vectors(part.column("embedding"))) if code else pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(np.zeros(n), pa.int32()))
        return pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "directions"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in shared.value:
                    continue
                own = batch.filter(pa.array(sizes == size))
                for start in range(0, own.num_rows, 2048):
                    yield listed(own.slice(start, 2048), shared.value[size])

    compared = classes.select("size", "rep", "weight", "embedding")
    filtered = durable(compared.mapInArrow(decoded, "size int, rep long, weight long, embedding array<double>, directions array<int>").withColumn("direction", F.explode("directions")))
    # as many small rows as there are directions
    loads = filtered.groupBy("size", "direction").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"), F.count("*").alias("load")).filter("load > 1").drop("load")
    dealt = filtered.join(loads, ["size", "direction"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = dealt.withColumn("meet", F.explode(meets)).select("size", "direction", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "block", "rep", "weight", "embedding", "directions")
    links = durable(dealt.groupBy("size", "direction", "i", "j").applyInArrow(lambda key, group: compare(key[1:], group, similar), "id long, other long, n long"))
    counts = links.filter("id = other").groupBy("id").agg(F.sum("n").alias("n"))
    found = components(links.filter("id <> other").select(F.col("id").alias("u"), F.col("other").alias("v")))
    named = classes.select("size", "h1", "h2", "least", "rep", "weight").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    named = durable(named.select("size", "h1", "h2", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component")))
    # components are named by nodes so far; the least id of each is the answer
    roots = named.groupBy("component").agg(F.min("least").alias("root"))
    named = named.join(roots, "component").select("size", "h1", "h2", "n", "root")
    out = rows.select("id", "h1", "h2", "size").join(named, ["size", "h1", "h2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
