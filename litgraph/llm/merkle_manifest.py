"""Merkle manifest of a dataset, its trees kept in van Emde Boas order.

A tree of 16 children a node is cut at half its height, again and again, until a subtree
has at most BLOCK levels of edges. Such an aligned subtree is one row of the manifest; in
it the cutting goes on down to single levels and gives each node its address, so a path
from a leaf touches few neighbouring stretches whatever the size of a cache line or page.
Construction and the search for siblings use the same address arithmetic, and go on over
the roots of the blocks as the leaves of the next tier. There is a tree for each source and
one over the roots of the sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: Children of a node as a power of two, and the most levels of edges in a block (4,096 leaves).
BITS, BLOCK = 4, 3
FAN = 1 << BITS
#: Heights of trees that a 64-bit count of leaves can have.
HEIGHTS = 16
DIGEST = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def tiers(height: int) -> list[int]:
    """Heights of the blocks of a tree from its leaves up: halved until a half fits into a block."""
    if height <= BLOCK:
        return [height]
    lower = (height + 1) // 2
    return tiers(lower) + tiers(height - lower)


def nodes_in(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of a depth (the root has 0) in a tree of this many levels of nodes: the upper half first, then each lower subtree."""
    if levels == 1:
        return np.zeros(len(index), np.int64)
    upper = levels // 2
    if depth < upper:
        return addresses(upper, depth, index)
    shift = BITS * (depth - upper)
    subtree, inner = index >> shift, index & ((1 << shift) - 1)
    return nodes_in(upper) + subtree * nodes_in(levels - upper) + addresses(levels - upper, depth - upper, inner)


def build_block(leaves: list[bytes], height: int) -> bytes:
    """Digests of a subtree in van Emde Boas order, up to the last that there is; the root comes first."""
    level, placed = leaves, []
    for depth in range(height, -1, -1):
        placed.append((addresses(height + 1, depth, np.arange(len(level))), level))
        if depth:
            level = [hashlib.sha256(b"".join(level[i : i + FAN]).hex().encode()).digest() for i in range(0, len(level), FAN)]
    nodes = np.zeros((max(int(at[-1]) for at, _ in placed) + 1, DIGEST), np.uint8)
    for at, digests in placed:
        nodes[at] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)
    return nodes.tobytes()


def levels_of(nodes: bytes, height: int, n_leaves: int) -> list[list[str]]:
    """Digests of a block as hex text, level by level from the leaves up."""
    flat = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    found, n = [], n_leaves
    for depth in range(height, -1, -1):
        whole = flat[addresses(height + 1, depth, np.arange(n))].tobytes().hex()
        found.append([whole[i : i + 2 * DIGEST] for i in range(0, len(whole), 2 * DIGEST)])
        n = -(-n // FAN)
    return found


def siblings(levels: list[list[str]], leaf: int) -> list[str]:
    """What stands left and right of the path of a leaf, level by level: [left, right, left, right, ...]."""
    found = []
    for level in levels[:-1]:
        start = leaf - leaf % FAN
        found += ["".join(level[start:leaf]), "".join(level[leaf + 1 : start + FAN])]
        leaf //= FAN
    return found


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for i in range(0, len(path), 2):
        digest = hashlib.sha256((path[i] + digest + path[i + 1]).encode()).hexdigest()
    return digest


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of values, each as ``-`` if null, else as its bytes in UTF-8, ``:`` and itself."""
    coded = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*coded), 256))


def height_of(n: Column) -> Column:
    return sum(((n > FAN**k).cast("int") for k in range(1, HEIGHTS - 1)), (n > 1).cast("int"))


def block_height(height: Column, tier: int) -> Column:
    """The height of a tree's blocks in a tier, null above its root."""
    table = F.array(*[F.lit(t[tier] if tier < len(t) else None).cast("int") for t in map(tiers, range(HEIGHTS))])
    return F.get(table, height)


def number(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of each row in its tree, and ``n``, the tree's rows.

    Rows are sorted over the whole cluster by ranges, so that a tree of any size is dealt over
    many tasks; only one count for each tree and range is put in order afterwards.
    """
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    ranged = durable(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    counts = ranged.groupBy(tree, "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(tree, "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return ranged.join(starts, [tree, "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


@dataclass(frozen=True)
class Tree:
    """Blocks of many trees, tier by tier from the leaves: (tree, n, height, block, leaves, root, nodes, and in the first tier what came with the leaves)."""

    blocks: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, root binary) of every tree."""
        last = [b.filter(F.col("tiers") == i + 1).select("tree", "root") for i, b in enumerate(self.blocks)]
        found = last[0]
        for more in last[1:]:
            found = found.unionAll(more)
        return found

    def paths(self, above: DataFrame) -> DataFrame:
        """The first tier's blocks with ``path``, the siblings from the block's root up; ``above`` has the trees' own (tree, path, and more)."""
        known: DataFrame | None = None
        for i in range(len(self.blocks) - 1, -1, -1):
            blocks = self.blocks[i]
            begun = blocks.filter(F.col("tiers") == i + 1).join(above, "tree")
            known = begun if known is None else begun.unionByName(blocks.filter(F.col("tiers") > i + 1).join(known, ["tree", "block"]))
            if i:
                known = durable(child_paths(known, [c for c in above.columns if c not in ("tree", "path")]))
        return known


def child_paths(blocks: DataFrame, more: list[str]) -> DataFrame:
    """(tree, block, path, more columns) of the blocks whose roots are the leaves of these."""
    fields = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["leaves"]
                levels = levels_of(r["nodes"], r["height"], n)
                paths = [siblings(levels, i) + r["path"] for i in range(n)]
                first = r["block"] << (BITS * r["height"])
                columns = [pa.array([r["tree"]] * n, pa.string()), pa.array(np.arange(first, first + n)), pa.array(paths, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[c]] * n, batch.schema.field(c).type) for c in more)], ["tree", "block", "path", *more])

    rows = blocks.select("tree", "block", "height", "leaves", "nodes", "path", *more)
    return rows.mapInArrow(run, "tree string, block long, path array<string>" + "".join(f", {c} {fields[c]}" for c in more))


def build(numbered: DataFrame, most: int, extra: list[str] = ()) -> Tree:
    """Trees over rows (tree, n, pos, digest, ``extra`` columns to keep with the leaves); no tree has more than ``most`` leaves."""
    height = 0
    while FAN**height < most:
        height += 1
    last = max(len(tiers(h)) for h in range(height + 1))
    rows, found = numbered.select("tree", "n", "pos", "digest", *extra), []
    for tier in range(last):
        own = list(extra) if tier == 0 else []
        fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        whole = height_of(F.col("n"))
        rows = rows.withColumn("height", block_height(whole, tier)).withColumn("block", F.expr(f"shiftright(pos, height * {BITS})"))

        def gather(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            leaves, level = table["digest"].to_pylist(), table["height"][0].as_py()
            nodes = build_block(leaves, level)
            head = [table[c][:1] for c in ("tree", "n", "height", "block")]
            lists = [pa.array([table[c].to_pylist()], pa.list_(table.schema.field(c).type)) for c in own]
            return pa.table([*head, pa.array([len(leaves)], pa.int64()), pa.array([nodes[:DIGEST]]), pa.array([nodes]), *lists], ["tree", "n", "height", "block", "leaves", "root", "nodes", *own])

        schema = "tree string, n long, height int, block long, leaves long, root binary, nodes binary" + "".join(f", {c} array<{fields[c]}>" for c in own)
        blocks = rows.groupBy("tree", "block").applyInArrow(gather, schema)
        n_tiers = F.get(F.array(*[F.lit(len(tiers(h))) for h in range(HEIGHTS)]), height_of(F.col("n")))
        found.append(durable(blocks.withColumn("tiers", n_tiers)))
        rows = found[-1].filter(F.col("tiers") > tier + 1).select("tree", "n", F.col("block").alias("pos"), F.col("root").alias("digest"))
    return Tree(found)


@dataclass(frozen=True)
class Manifest:
    """Trees of all sources with their documents' leaves, the tree over their roots, and its root as hex text (None without documents)."""

    documents: Tree
    sources: Tree
    root: str | None

    def blocks(self) -> DataFrame:
        """The manifest as one table: (level, tree, tier, block, height, leaves, root, nodes)."""
        parts = [
            b.select(F.lit(level).alias("level"), "tree", F.lit(i).alias("tier"), "block", "height", "leaves", "root", "nodes")
            for level, t in (("documents", self.documents), ("sources", self.sources))
            for i, b in enumerate(t.blocks)
        ]
        found = parts[0]
        for more in parts[1:]:
            found = found.unionAll(more)
        return found


def manifest(docs: DataFrame, received: Column | None = None) -> Manifest:
    """Builds the manifest of documents (doc_id, source, lang, n_chars, text).

    Leaves of a source ascend by doc_id, null ids first, equal ids by leaf. ``received`` is
    the text of a copy to check: its leaf is kept beside the document's where it differs.
    """
    leaf = leaf_digest(*(F.col(c) for c in COLUMNS))
    other = F.lit(None).cast("binary")
    if received is not None:
        other = F.when(~received.eqNullSafe(F.col("text")), leaf_digest(*(F.col(c) for c in COLUMNS[:-1]), received))
    # null comes before every source, as 0 before 1
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    rows = docs.select("doc_id", tree.alias("tree"), leaf.alias("digest"), other.alias("received"))
    numbered = number(rows, "tree", ["doc_id", "digest"])
    documents = build(numbered, numbered.agg(F.max("n")).first()[0] or 0, ["doc_id", "received"])
    roots = documents.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source_key"), F.col("root").alias("digest"))
    numbered = number(roots, "tree", ["source_key"])
    sources = build(numbered, numbered.agg(F.max("n")).first()[0] or 0, ["source_key"])
    top = sources.roots().first()
    return Manifest(documents, sources, top["root"].hex() if top else None)


def prove(found: Manifest) -> DataFrame:
    """A row for each document: (doc_id, leaf, subroot, proof_sha256, folded_root), digests as hex text.

    Siblings are read from the blocks by address, tier by tier from the top down; the digest
    of a proof covers them from the leaf up. ``folded_root`` is what the received leaf, else
    the document's own, gives with the original siblings.
    """
    start = found.sources.roots().select("tree", F.array().cast("array<string>").alias("path"))
    tops = found.sources.paths(start)
    above = source_paths(tops)
    blocks = found.documents.paths(durable(above))
    id_type = blocks.schema["doc_id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for k, r in enumerate(batch.drop_columns(["doc_id"]).to_pylist()):
                levels = levels_of(r["nodes"], r["height"], r["leaves"])
                proofs, folded = [], []
                for i, (leaf, other) in enumerate(zip(levels[0], r["received"], strict=True)):
                    path = siblings(levels, i) + r["path"]
                    proofs.append(hashlib.sha256("".join(path).encode()).hexdigest())
                    folded.append(fold(other.hex() if other is not None else leaf, path))
                yield pa.RecordBatch.from_arrays(
                    [ids[k].values, pa.array(levels[0], pa.string()), pa.array([r["subroot"]] * len(proofs), pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
                    ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"],
                )

    rows = blocks.select("doc_id", "received", "height", "leaves", "nodes", "path", "subroot")
    return rows.mapInArrow(run, f"doc_id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string")


def source_paths(tops: DataFrame) -> DataFrame:
    """(tree, path, subroot) of every source from the blocks over their roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels = levels_of(r["nodes"], r["height"], r["leaves"])
                paths = [siblings(levels, i) + r["path"] for i in range(r["leaves"])]
                yield pa.RecordBatch.from_arrays([pa.array(r["source_key"], pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(levels[0], pa.string())], ["tree", "path", "subroot"])

    return tops.select("source_key", "height", "leaves", "nodes", "path").mapInArrow(run, "tree string, path array<string>, subroot string")


def verify(docs: DataFrame, received: Column) -> DataFrame:
    """Checks received texts against the manifest of ``docs``.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root string, verified boolean), a row
    for each row of ``docs``. Null columns are part of a leaf as ``-``; null sources are a
    source of their own and come first, null ids come first in a source. Repeated rows are
    leaves of their own with equal digests; an empty table gives none; other columns are not
    read. A source may have any size: it is dealt over blocks of at most 4,096 leaves.
    """
    found = manifest(docs, received)
    root = F.lit(found.root).cast("string")
    return prove(found).select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
