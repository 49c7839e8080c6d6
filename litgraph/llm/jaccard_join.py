"""N-gram Jaccard join with PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity 0.8 or more differ in at most
(a + b) / 9 elements. Sets are put into bands of sizes; within a band at most k elements
differ, so if the domain is split into parts, at most k parts of the two sets disagree,
and a set with more than k non-empty parts shares one of them whole with every set that it
is similar to. Each non-empty part of a set is one signature. A set with too few non-empty
parts also gets signatures of further splits, and in the end those of its empty parts.

Signatures are joined by grouping. A set that has more than k signatures outside the large
groups needs no large group at all. In each group every member is first compared with the
group's smallest one; pairs that are still unconnected after that are compared too, so no
link between different components is lost, while copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BYTE, blocks, components, durable, key_map, text_bytes, word_hashes

SHINGLE = 5
#: Similarity in hundredths.
SIMILAR = 80
#: Sizes in a band go up to this many times its smallest.
BAND = 2.0
#: Signatures beyond those needed, in hundredths of the band's largest need: a set can leave out as many hot ones.
EXTRA = 10
#: Splits that are tried before a set's empty parts count.
SPLITS = 4
#: Counts in a sketch of a set, by which dissimilar pairs of small sets are ruled out before sets are compared.
SKETCH = 64
#: Groups with more members are large.
LARGE = 24
#: Members of a large group that meet in one task.
MEET = 1024
#: Bytes of text whose sets are found at a time.
TEXT_BYTES = 1 << 20

SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: A random value for each byte, A-Z like a-z.
LETTER = BYTE[[c + 32 if 65 <= c <= 90 else c for c in range(256)]]
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd factors by place of a word in its shingle.
PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    parts: int
    extra: int

    def need(self, size: int, similar: int) -> int:
        """One more than a set of this size can differ from its partners in the band by, in elements and so in parts."""
        return (size + min(self.high, 100 * size // similar)) * (100 - similar) // (100 + similar) + 1


@lru_cache(maxsize=4096)
def band(number: int, similar: int = SIMILAR) -> Band:
    """The band of a number: sizes low to high; members of the band below are its partners if near enough."""
    low = 1
    for _ in range(number):
        low = int(low * BAND) + 1
    high = int(low * BAND)
    most = 2 * high * (100 - similar) // (100 + similar) + 1
    extra = -(-most * EXTRA // 100)
    parts, smallest = most, max(1, -(-low * similar // 100))
    few = lambda n: parts * (1 - exp(-n / parts)) < 1.03 * (plain.need(n, similar) + extra) + 0.5
    plain = Band(number, low, high, parts, extra)
    while most > 1 and parts < 4 * smallest + 4 and (few(smallest) or few(low) or few(high)):
        parts += 1
    return Band(number, low, high, parts, extra)


@lru_cache(maxsize=65536)
def bands_of(size: int, similar: int = SIMILAR) -> tuple[Band, ...]:
    """The bands in which a set of this size has signatures: its own, and the next if it can have partners there."""
    n = 0
    while band(n, similar).high < size:
        n += 1
    own, above = band(n, similar), band(n + 1, similar)
    return (own, above) if 100 * size >= similar * above.low else (own,)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(elements, sizes): the distinct shingles of each text as sorted 64-bit hashes, text after text, and how many each has."""
    if texts.null_count:
        texts = texts.fill_null("")
    data, at, length = text_bytes(texts)
    low = int(at[0]) if len(at) else 0
    at = at - low
    start, end, word = word_hashes(data[low : low + int(length.sum())], np.unique(at), SPACE, LETTER)
    word = mix(word + (end - start).astype(np.uint64))
    from_ = np.searchsorted(start, at)
    count = np.searchsorted(start, at + length) - from_
    hashed = np.zeros(len(word), np.uint64)
    for i in range(min(n, len(word))):
        hashed[: len(word) - i] += word[i:] * PLACES[i]
    kept = np.ones(len(word), bool)
    for i in range(1, n):
        kept[(from_ + count - i)[count >= i]] = False
    short = np.flatnonzero((count > 0) & (count < n))
    for k in short:  # fewer words: the whole sequence
        own = word[from_[k] : from_[k] + count[k]]
        hashed[from_[k]] = np.sum(own * PLACES[: len(own)] + MIX1, dtype=np.uint64)
        kept[from_[k]] = True
    elements = mix(hashed[kept])
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        elements[a:b].sort()
    new = np.ones(len(elements), bool)
    new[1:] = elements[1:] != elements[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    return elements[new], upto[ends] - upto[ends - sizes]


def sums_of(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def digests(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    one = mix(sums_of(mix(elements + np.uint64(1)), sizes) + sizes.astype(np.uint64))
    return one.view(np.int64), mix(sums_of(mix(elements ^ MIX2), sizes)).view(np.int64)


def sketches(elements: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """How many elements of each set fall into each of SKETCH parts, 255 at most."""
    slot = np.repeat(np.arange(len(sizes)) * SKETCH, sizes) + (elements % np.uint64(SKETCH)).astype(np.int64)
    counts = np.minimum(np.bincount(slot, minlength=len(sizes) * SKETCH), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((np.arange(len(sizes) + 1) * SKETCH).astype(np.int32)), pa.py_buffer(counts)])


def signatures(elements: np.ndarray, sizes: np.ndarray, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, split, spare) of all signatures of sets: ``spare`` says how many more than needed a set has in that split.

    A set emits its first non-empty parts, in an order of parts that all sets share: as many
    as it needs and the band's extra ones. Of two similar sets, look at the one that stops
    earlier: up to there the other emits all that it has, and of the first one's parts no
    more differ than it needs less one, so 1 + extra parts are shared. A set with too few
    non-empty parts emits all of them, then tries further splits, and in the last one emits
    its empty parts too; two such sets agree in one of all parts.
    """
    size, begin = sizes.tolist(), np.cumsum(sizes) - sizes
    todo = [(k, b, b.need(n, similar)) for k, n in enumerate(size) if n for b in bands_of(n, similar)]
    owner = np.array([k for k, _, _ in todo], np.int64)
    number, parts, extra = (np.array([getattr(b, f) for _, b, _ in todo], np.int64) for f in ("number", "parts", "extra"))
    need = np.array([n for _, _, n in todo], np.int64)
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for split in range(SPLITS):
        if not len(owner):
            break
        n, code = sizes[owner], number * SPLITS + split
        salt = mix((code + 1).astype(np.uint64))
        ends = np.cumsum(n)
        x = mix(elements[np.repeat(begin[owner] - ends + n, n) + np.arange(ends[-1])] + np.repeat(salt, n))
        first = np.cumsum(parts) - parts
        slot = np.repeat(first, n) + (((x >> np.uint64(32)) * np.repeat(parts.astype(np.uint64), n)) >> np.uint64(32)).astype(np.int64)
        total = int(parts.sum())
        # sums of halves are exact in doubles
        low, high = (np.bincount(slot, weights=half, minlength=total).astype(np.uint64) for half in (x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)))
        full = np.bincount(slot, minlength=total) > 0
        entry, part = np.repeat(np.arange(len(owner)), parts), np.arange(total) - np.repeat(first, parts)
        place = np.cumsum(full) - 1
        upto = np.concatenate([[0], np.cumsum(full)])
        have = upto[first + parts] - upto[first]
        spare = np.minimum(have, need + extra) - need
        emit = full & (place - upto[first][entry] < (need + extra)[entry])
        label = mix(part.astype(np.uint64) + salt[entry])
        own = mix(low[emit] + (high[emit] << np.uint64(32)) + label[emit])
        out.append((owner[entry[emit]], own, code[entry[emit]], spare[entry[emit]]))
        if split == SPLITS - 1:
            empty = ~full & (spare < 0)[entry]
            out.append((owner[entry[empty]], mix(label[empty] ^ MIX2), code[entry[empty]], spare[entry[empty]]))
        again = spare < 0
        owner, number, parts, extra, need = (c[again] for c in (owner, number, parts, extra, need))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))


def texts_once(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[pa.RecordBatch]:
    """Blocks of texts, without those that this task has met before (by hash) and those that are not wanted."""
    seen: set[int] = set()
    for batch in batches:
        keys = batch.column("t").to_numpy()
        new = np.zeros(len(keys), bool)
        new[np.unique(keys, return_index=True)[1]] = True
        if wanted is not None:
            new &= wanted(keys)
        at = np.flatnonzero(new)
        at = at[[k not in seen for k in keys[at].tolist()]] if len(at) else at
        if len(seen) < 1_000_000:
            seen.update(keys[at].tolist())
        yield from blocks([batch.take(pa.array(at))], "text", TEXT_BYTES)


def document_sets(rows: DataFrame, id_type: str) -> DataFrame:
    """(id, t, n, h1, h2, sketch) of each document: hash of its text, size and digest of its set, and counts of its elements by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", TEXT_BYTES):
            elements, sizes = shingle_sets(batch.column("text"))
            columns = [pa.array(sizes), *map(pa.array, digests(elements, sizes)), sketches(elements, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), *columns], ["id", "t", "n", "h1", "h2", "sketch"])

    return rows.mapInArrow(run, f"id {id_type}, t long, n long, h1 long, h2 long, sketch binary")


def document_signatures(rows: DataFrame, similar: int) -> DataFrame:
    """(sig, h, split, spare) of each distinct text; a text that a task meets again gives no rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_once(batches):
            elements, sizes = shingle_sets(batch.column("text"))
            owner, sig, split, spare = signatures(elements, sizes, similar)
            columns = [sig.view(np.int64), digests(elements, sizes)[0][owner], split.astype(np.int32), spare.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "h", "split", "spare"])

    return rows.select("text", "t").mapInArrow(run, "sig long, h long, split int, spare int")


def wanted_sets(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, elements) of the sets of the texts whose hash ``t`` is in ``texts``, and of a few more."""
    wanted = key_map(texts, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_once(batches, wanted.has):
            elements, sizes = shingle_sets(batch.column("text"))
            some = sizes > 0
            one, two = digests(elements, sizes)
            ends = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(one[some]), pa.array(two[some]), pa.ListArray.from_arrays(pa.array(ends), pa.array(elements.view(np.int64)))], ["h", "h2", "elements"])

    sets = rows.select("text", "t").mapInArrow(run, "h long, h2 long, elements array<long>")
    return sets.dropDuplicates(["h", "h2"]).select("h", "elements")


def possible(pairs: DataFrame, info: DataFrame, similar: int) -> DataFrame:
    """Those of ``pairs`` whose sizes and sketches allow that they are similar: sketches differ at most as much as sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.array([np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()], np.int64).reshape(-1, SKETCH) for c in ("sa", "sb"))
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            near = (100 + similar) * np.abs(sa - sb).sum(1) <= (100 - similar) * (na + nb)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    side = lambda x: info.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(na, nb) >= {similar} * greatest(na, nb)")
    return near.mapInArrow(run, "a long, b long")


def near_sketches(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray, similar: int) -> np.ndarray:
    """For all pairs of two sides, whether sizes and sketches allow that they are similar."""
    out = np.zeros((len(na), len(nb)), bool)
    for i in range(len(na)):
        size = na[i] + nb
        apart = np.abs(sb - sa[i]).sum(1, dtype=np.int64)
        out[i] = ((100 + similar) * apart <= (100 - similar) * size) & (100 * np.minimum(na[i], nb) >= similar * np.maximum(na[i], nb))
    return out


def meet(members: DataFrame, info: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of large groups' members of different components that may be similar.

    A group is cut into blocks that meet in pairs, one task's work each; pairs are compared
    by their sketches inside the task, and only those that may be similar come out, from the
    first large group that both are in.
    """
    own = members.groupBy("h").agg(F.sort_array(F.collect_set("sig")).alias("sigs"))  # at most as many as a set has parts
    blocks_ = F.greatest(F.ceil(F.col("members") / MEET), F.lit(1)).cast("int")
    dealt = members.select("sig", "h", "c", blocks_.alias("n_blocks"), F.pmod(F.xxhash64("h"), blocks_).cast("int").alias("block"))
    against = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = dealt.withColumn("m", F.explode(against)).select("sig", "h", "c", "block", F.col("m.i").alias("i"), F.col("m.j").alias("j"))
    dealt = dealt.join(own.join(info, "h"), "h")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sig, i, j = (k.as_py() for k in key)
        h, c, n, block = (group.column(k).to_numpy() for k in ("h", "c", "n", "block"))
        sketch = np.array([np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist()], np.int16)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = near_sketches(sketch[left], n[left], sketch[right], n[right], similar) & (c[left][:, None] != c[right][None, :])
        x, y = np.nonzero(near)
        use = h[left[x]] < h[right[y]] if i == j else np.ones(len(x), bool)
        a, b = left[x[use]], right[y[use]]
        lists = group.column("sigs").to_pylist()
        earlier = {k: {s for s in lists[k] if s < sig} for k in {*a.tolist(), *b.tolist()}}
        first = np.fromiter((earlier[p].isdisjoint(earlier[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        a, b = h[a[first]], h[b[first]]
        return pa.table({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})

    return dealt.groupBy("sig", "i", "j").applyInArrow(run, "a long, b long")


def verify(pairs: DataFrame, rows: DataFrame, info: DataFrame, similar: int) -> DataFrame:
    """Those of ``pairs`` (a, b: digests) whose sets are similar, by their exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            sides = [np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1]) for c in (batch.column("ea"), batch.column("eb"))]
            for x, y in zip(*sides, strict=True):
                i = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * i >= similar * (len(x) + len(y) - i))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    ids = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    sets = durable(wanted_sets(rows, info.join(ids, "h", "left_semi").select("t")))
    both = pairs.join(sets.select(F.col("h").alias("b"), F.col("elements").alias("eb")), "b").join(sets.select(F.col("h").alias("a"), F.col("elements").alias("ea")), "a")
    return both.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """Components of documents linked by Jaccard similarity of word shingles: (id, n_shingles long, component_id).

    ``component_id`` is the smallest id reachable by links, itself included. Documents
    without text or words have an empty set, are linked with nothing and are their own
    component; equal sets are linked. Rows with a null id have a null component unless they
    are linked. Repeated rows give repeated results, an empty table none; other columns are
    not read. Exact but for collisions of 64-bit shingle hashes.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col)
    sets = durable(document_sets(rows, id_type))
    classes = sets.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.min("t").alias("t"), F.first("sketch").alias("sketch"))
    info = durable(classes.groupBy(F.col("h1").alias("h")).agg(F.first("n").alias("n"), F.min("t").alias("t"), F.first("sketch").alias("sketch")))

    # groups of two or more different sets; all steps keep the partitioning by signature
    by_sig = Window.partitionBy("sig")
    signed = document_signatures(rows, similar).withColumn("first", F.min("h").over(by_sig)).withColumn("last", F.max("h").over(by_sig)).filter("first <> last")
    signed = signed.groupBy("sig", "h").agg(F.min("split").alias("split"), F.min("spare").alias("spare"))
    signed = durable(signed.withColumn("members", F.count("*").over(by_sig)))

    # 1. every member against one hub of its groups, the one with which it shares most. The
    # hub of a group is the member that shares most signatures with all others: among near
    # copies, the text that the others were made from.
    ties = signed.groupBy("h").agg(F.sum("members").alias("ties"))
    hubs = signed.join(ties, "h").withColumn("hub", F.max(F.struct("ties", "h")).over(by_sig)["h"])
    stars = hubs.filter("h <> hub").groupBy(F.col("hub").alias("a"), F.col("h").alias("b")).agg(F.count("*").alias("shared"), F.min("spare").alias("spare"))
    best = stars.filter("2 * shared > spare").groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    best = durable(possible(best, info, similar))
    edges = durable(verify(best, rows, info, similar))
    found = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # 2. all members of a group that are still apart. A set with enough signatures outside
    # large groups is found there by all that are similar to it, so in a large group only
    # those meet that have too few. Similar sets differ in k parts at most, so they share
    # all but k of their signatures; only such pairs go on.
    large = signed.filter(F.col("members") > LARGE).groupBy("h", "split").agg(F.count("*").cast("int").alias("n_large"))
    still = signed.join(large, ["h", "split"], "left").withColumn("n_large", F.coalesce("n_large", F.lit(0)))
    # of these it needs all but as many of its largest as it has to spare, in an order all sets agree on
    largest = F.row_number().over(Window.partitionBy("h", "split").orderBy(F.desc("members"), F.desc("sig")))
    spared = still.filter((F.col("members") > LARGE) & (F.col("n_large") > F.col("spare"))).withColumn("place", largest).filter("place > spare").drop("place")
    still = still.filter(F.col("members") <= LARGE).unionByName(spared)
    still = still.join(found.select(F.col("id").alias("h"), F.col("component").alias("c")), "h", "left")
    still = still.withColumn("c", F.coalesce("c", "h")).repartition("sig")
    still = durable(still.withColumn("c1", F.min("c").over(by_sig)).withColumn("c2", F.max("c").over(by_sig)).filter("c1 <> c2").drop("c1", "c2"))
    few = still.filter(F.col("members") <= LARGE)
    side = lambda x: few.select("sig", *(F.col(k).alias(f"{k}_{x}") for k in ("h", "split", "spare", "n_large", "c")))
    pairs = side("a").join(side("b"), "sig").filter("h_a < h_b and c_a <> c_b and split_a = split_b")
    pairs = pairs.groupBy("h_a", "h_b", "split_a").agg(F.count("*").alias("shared"), *(F.max(f"{k}_{x}").alias(f"{k}_{x}") for k in ("spare", "n_large") for x in "ab"))
    pairs = pairs.filter("shared > greatest(spare_a, spare_b) - least(n_large_a, n_large_b)").select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))
    pairs = possible(pairs.distinct(), info, similar).union(meet(still.filter(F.col("members") > LARGE), info, similar)).distinct()
    pairs = pairs.join(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = verify(durable(pairs), rows, info, similar)
    edges = edges.select("a", "b").union(more)

    # classes to documents: components take the smallest id of all classes in them
    joined = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = durable(classes.select("h1", "h2", "rep").join(joined.select(F.col("id").alias("h1"), "component"), "h1", "left"))
    smallest = named.filter("component is not null").groupBy("component").agg(F.min("rep").alias("of_component"))
    named = named.join(smallest, "component", "left").select("h1", "h2", F.coalesce("of_component", "rep").alias("root"))
    whole = sets.select("id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
