"""Alignment of two tokenizers: one-to-one groups go through an array from A ids to B ids, only other pairs are shuffled.

Byte offsets where tokens of both vocabularies end cut a text into groups. Where a group
is one token of each, the B token has the same bytes as the A token, so an array over the
vocabulary (A id to the B id of the same bytes) names the pair, and how many documents
hold it is counted in vectors as long as the vocabulary. Only pairs of tokens of different
bytes are counted by a shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import blocks, durable, without_cycles
from .sentence_pieces import SPACE

#: Stretches of text over whose borders no token of either vocabulary goes: white space and letters, or white
#: space, other characters and the letters that follow; a space or a line end after such a character parts two.
STRETCH = r"(?V1)\p{White_Space}*(?:\p{L}+|[^\p{L}\p{White_Space}]+(?:[\p{White_Space}--[ \n]]\p{White_Space}*[^\p{L}\p{White_Space}]*)*\p{L}*)|\p{White_Space}+"
#: Distinct stretches that a Python worker remembers before it drops those met in one block only.
MEMO = 200_000
#: Pairs whose counts are broadcast at most (16 bytes each); rarer ones are joined.
COMMON_PAIRS = 1 << 20


@dataclass
class Stretches:
    """What is known of distinct stretches, as flat arrays with an end for each of them."""

    text: list[str]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    whole: np.ndarray
    pairs: np.ndarray
    ends: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, special = byte_letters(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a: list[bytes] = [b""] * self.size_a
        for piece, i in self.a.get_vocab().items():
            self.bytes_a[i] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
        self.bytes_b = [self._bytes_b(i) for i in range(self.size_b)]
        plain = [i for i in range(self.size_b) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        if any(regex.search(r"[^\p{White_Space}▁][▁\n]|\p{L}\P{L}", self.b.id_to_piece(i)) for i in plain if not self.b.is_byte(i)) or any(regex.search(r"[^\p{White_Space}][ \n]", t.decode("utf-8", "replace")) for t in self.bytes_a):
            raise ValueError("tokens go over borders of stretches")
        if self.b.encode("\na", out_type=str)[:2] != [SPACE, "<0x0A>"]:
            raise ValueError(f"{path_b}: the vocabulary does not keep line ends apart")
        #: The B id of the same bytes for each A id, -1 if there is none; pieces come before single bytes.
        same = {self.bytes_b[i]: i for i in sorted(plain, key=lambda i: not self.b.is_byte(i))}
        self.same = np.array([same.get(t, -1) for t in self.bytes_a], np.int64)
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.signed_a, self.signed_b = (np.array([[f"{i},", f"{i}{end}"] for i in range(n)], object) for n, end in ((self.size_a, "|"), (self.size_b, ";")))
        self.stretch = regex.compile(STRETCH)
        self.forget()

    def _bytes_b(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return self.b.id_to_piece(i).encode()
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def forget(self, with_text: bool = True) -> None:
        """Starts afresh; groups are only written out as text if ``with_text``."""
        self.with_text = with_text
        self.place: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        self.known = Stretches([], none, none, none, np.zeros(0, bool), none, none)
        #: In how many blocks each stretch was met.
        self.met = np.zeros(0, np.int32)

    def shrink(self) -> None:
        """Keeps the stretches met in several blocks, which spares learning them again; starts afresh if they are too many."""
        keep, k = self.met > 1, self.known
        if 4 * np.count_nonzero(keep) > 3 * MEMO:
            self.forget(self.with_text)
            return
        length = np.diff(k.ends, prepend=0)
        self.place = {w: i for i, w in enumerate(compress(self.place, keep))}  # in the order of places
        self.known = Stretches(list(compress(k.text, keep)), *(x[keep] for x in (k.n_a, k.n_b, k.n_groups, k.whole)), k.pairs[np.repeat(keep, length)], np.cumsum(length[keep]))
        self.met = np.ones(len(self.place), np.int32)

    def learn(self, new: list[str]) -> None:
        """Aligns new distinct stretches, all of them at once: their tokens are laid end to end."""
        in_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]  # without offsets
        in_b = [ids[2:] for ids in self.b.encode(["\n" + w for w in new], num_threads=1)]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(new)) for x in (in_a, in_b))
        whole = self.given_back([w.encode() for w in new], in_a, in_b, n_a, n_b)
        a, b = (np.fromiter(chain.from_iterable(x if ok else () for x, ok in zip(ids, whole, strict=True)), np.int64) for ids in (in_a, in_b))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        # groups end where tokens of both end, and so do stretches
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last_a, last_b = np.searchsorted(group_a, np.arange(len(cuts)), "right"), np.searchsorted(group_b, np.arange(len(cuts)), "right")
        size_b = np.diff(last_b, prepend=0)
        # every A token meets the B tokens of its group
        times = size_b[group_a]
        before = np.cumsum(times) - times
        partner = np.arange(int(times.sum())) - np.repeat(before - (last_b - size_b)[group_a], times)
        pairs = np.repeat(a, times) * self.size_b + b[partner]
        stops_a, stops_b = np.cumsum(n_a * whole), np.cumsum(n_b * whole)
        ends = np.concatenate([[0], before + times])[stops_a]
        n_groups = np.diff(np.concatenate([[0], last_a.searchsorted(stops_a, "right")]))
        text: list[str] = []
        if self.with_text:
            # each token's number and the sign after it, in the order of groups, A before B
            named = np.empty(len(a) + len(b), object)
            named[np.arange(len(a)) + (last_b - size_b)[group_a]] = self.signed_a[a, (np.arange(1, len(a) + 1) == last_a[group_a]).astype(int)]
            named[np.arange(len(b)) + last_a[group_b]] = self.signed_b[b, (np.arange(1, len(b) + 1) == last_b[group_b]).astype(int)]
            signs, stops = named.tolist(), [0, *(stops_a + stops_b).tolist()]
            text = ["".join(signs[i:j]) for i, j in pairwise(stops)]
        k, first = self.known, len(self.place)
        self.place.update(zip(new, range(first, first + len(new)), strict=True))
        k.text += text
        k.n_a, k.n_b, k.n_groups, k.whole = (np.concatenate([x, y]) for x, y in ((k.n_a, n_a), (k.n_b, n_b), (k.n_groups, n_groups), (k.whole, whole)))
        k.ends, k.pairs = np.concatenate([k.ends, ends + len(k.pairs)]), np.concatenate([k.pairs, pairs])

    def given_back(self, raw: list[bytes], in_a: list[list[int]], in_b: list[list[int]], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether the tokens of both vocabularies give back the bytes of each stretch: all are compared at once where lengths agree, one by one only if some differ."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.ones(len(raw), bool)
        for ids, n, length in ((in_a, n_a, self.length_a), (in_b, n_b, self.length_b)):
            sums = np.concatenate([[0], np.cumsum(length[np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))])])
            whole &= np.diff(sums[np.concatenate([[0], np.cumsum(n)])]) == size
        for ids, of in ((in_a, self.bytes_a), (in_b, self.bytes_b)):
            some = list(compress(ids, whole))
            if b"".join(map(of.__getitem__, chain.from_iterable(some))) != b"".join(compress(raw, whole)):
                whole[whole] = [b"".join(map(of.__getitem__, x)) == w for x, w in zip(some, compress(raw, whole), strict=True)]
        return whole

    def block(self, texts: list[str | None]) -> list[np.ndarray]:
        """Places of each text's stretches; texts that one side doesn't give back have none."""
        if len(self.place) > MEMO:
            self.shrink()
        # a space stands before every text; B puts it there itself
        cut = [self.stretch.findall(" " + t) if t else [] for t in texts]
        new = {w for words in cut for w in words} - self.place.keys()
        if new:
            with without_cycles():
                self.learn(list(new))
        get = self.place.__getitem__
        found = [np.fromiter(map(get, words), np.int64, len(words)) for words in cut]
        here = np.zeros(len(self.place), bool)
        for at in found:
            here[at] = True
        self.met = np.concatenate([self.met, np.zeros(len(here) - len(self.met), np.int32)]) + here
        return [at if self.known.whole[at].all() else at[:0] for at in found]

    def occurrences(self, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, pair, how often) of each distinct pair of tokens in each text, sorted; a pair is A id * size of B + B id."""
        sizes = np.array([len(x) for x in at], np.int64)
        flat = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(at)), sizes)
        begin = np.concatenate([[0], self.known.ends[:-1]]).astype(np.int64) if len(self.known.ends) else self.known.ends
        start, stop = begin[flat], self.known.ends[flat]
        length = stop - start
        index = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        base = np.int64(self.size_a * self.size_b)
        key, times = np.unique(np.repeat(owner, length) * base + self.known.pairs[index], return_counts=True)
        return key // base, key % base, times


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def count_pairs(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """In how many documents each pair of tokens is linked: (a int, b int, n long).

    Pairs of the same bytes are counted by a vector as long as the vocabulary in each task,
    which gives one row for each id that is not zero; the others are counted by block. The
    rows are summed by a shuffle that combines before it sends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = aligner(path_a, path_b)
        if c.with_text:
            c.forget(with_text=False)  # else the stretches of the task before are known
        same = np.zeros(c.size_a, np.int64)
        for batch in blocks(batches, "text"):
            _, pair, _ = c.occurrences(c.block(batch.column("text").to_pylist()))
            a, b = pair // c.size_b, pair % c.size_b
            alike = c.same[a] == b
            same += np.bincount(a[alike], minlength=c.size_a)
            other, n = np.unique(pair[~alike], return_counts=True)
            yield rows(other // c.size_b, other % c.size_b, n)
        seen = np.flatnonzero(same)
        yield rows(seen, c.same[seen], same[seen])

    def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class PairCounts:
    """Counts of common pairs as sorted arrays, and the highest count of each A id."""

    pair: np.ndarray
    n: np.ndarray
    best: np.ndarray

    def find(self, pair: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 if it is not a common one."""
        if not len(self.pair):
            return np.zeros(len(pair), np.int64)
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, self.n[at], 0)


def common_counts(counts: DataFrame, size_a: int, size_b: int, most: int = COMMON_PAIRS) -> tuple[PairCounts, int]:
    """(counts of the pairs above a threshold, that threshold): the lowest power of two that at most ``most`` pairs reach."""
    best = np.zeros(size_a, np.int64)
    top = counts.groupBy("a").agg(F.max("n").alias("n")).toArrow()  # a row for each A id at most
    best[top["a"].to_numpy()] = top["n"].to_numpy()
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("pairs")).collect()
    threshold, held = 1 << 62, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["pairs"]
        if held > most:
            break
        threshold = 1 << r["level"]
    found = counts.filter(F.col("n") >= threshold).select((F.col("a").cast("long") * size_b + F.col("b")).alias("pair"), "n").toArrow()
    pair, n = found["pair"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(pair)
    return PairCounts(pair[order], n[order], best), threshold


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, most_common: int = COMMON_PAIRS) -> DataFrame:
    """Aligns the tokens of two vocabularies in whole texts; one row for each row of ``docs``.

    (id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups string): tokens of a
    space and the text by A, of the text by B (which puts that space before it), groups and
    linked pairs of token occurrences; links whose pair is linked in as many documents as any
    of its A id; the sum of these numbers over the links; groups as ``a1,a2|b1;a3|b2``,
    or with ``digest`` the SHA-256 of that text as ``groups_sha256``, empty without tokens.
    A is a byte-level BPE file, B a sentencepiece model with byte fallback, both readable by
    every worker. Null and empty texts, and texts that either side doesn't give back byte for
    byte, have no tokens: zeros and an empty string. Repeated rows are documents of their
    own, null ids stay null, an empty table gives none, other columns are not read.

    Texts are tokenized twice rather than kept. The counts of at most ``most_common`` pairs,
    16 bytes each, and one number for each A id are broadcast; rarer pairs are joined.
    """
    a, b = aligner(path_a, path_b).size_a, aligner(path_a, path_b).size_b
    counts = durable(count_pairs(docs, path_a, path_b, text_col))
    common, threshold = common_counts(counts, a, b, most_common)
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(common)
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, given = aligner(path_a, path_b), shared.value
        if not c.with_text:
            c.forget()
        for batch in blocks(batches, "text"):
            at = c.block(batch.column("text").to_pylist())
            row, pair, times = c.occurrences(at)
            n = given.find(pair)
            best = given.best[pair // c.size_b]
            totals = lambda x: np.bincount(row, x, len(at)).astype(np.int64)
            k = c.known
            sums = [np.array([int(x[i].sum()) for i in at], np.int64) for x in (k.n_a, k.n_b, k.n_groups)]
            sums += [totals(times), totals(times * (n == best)), exact(row, n * times, len(at))]
            groups = ["".join(map(k.text.__getitem__, i.tolist()))[:-1] for i in at]
            rare = n == 0
            sizes = np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=len(at)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(x[rare].astype(t))) for x, t in ((pair, np.int64), (times, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, sums), pa.array(groups, pa.string()), *lists], ["id", *columns, "groups", "rare", "times"])

    def exact(row: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        ends = np.searchsorted(row, np.arange(size + 1))
        return sums[ends[1:]] - sums[ends[:-1]]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"{x} long" for x in columns)
    aligned = rows.mapInArrow(run, f"id {id_type}, {fields}, groups string, rare array<long>, times array<long>").withColumnRenamed("id", id_col)
    if digest:
        aligned = aligned.withColumn("groups", F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))).withColumnRenamed("groups", "groups_sha256")
    rare = counts.filter(F.col("n") < threshold)
    return aligned.drop("rare", "times") if rare.isEmpty() else with_rare(aligned, rare, counts, b)


def with_rare(aligned: DataFrame, rare: DataFrame, counts: DataFrame, size_b: int) -> DataFrame:
    """Adds the links of pairs that were not broadcast to ``n_best`` and ``count_sum``."""
    aligned = durable(aligned.withColumn("row", F.monotonically_increasing_id()))
    top = counts.groupBy("a").agg(F.max("n").alias("most"))
    named = rare.join(top, "a").select((F.col("a").cast("long") * size_b + F.col("b")).alias("pair"), "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    links = aligned.select("row", F.explode(F.arrays_zip("rare", "times")).alias("link")).select("row", F.col("link.rare").alias("pair"), F.col("link.times").alias("times"))
    sums = links.join(named, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_count"))
    more = aligned.drop("rare", "times").join(sums, "row", "left")
    for column, extra in (("n_best", "more_best"), ("count_sum", "more_count")):
        more = more.withColumn(column, F.col(column) + F.coalesce(extra, F.lit(0)))
    return more.drop("row", "more_best", "more_count")
