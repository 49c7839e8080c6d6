"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of documents inside one Spark partition. Its words become symbols: the
place of the word in the benchmark's vocabulary, or a gap for any other word, which no
test phrase can hold. Over that sequence the task builds a suffix array, the
Burrows-Wheeler transform and a wavelet matrix, searches all test phrases backwards by
rank queries, locates their occurrences by walking to sampled suffix positions, and
merges them into spans to remove.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, blocks, text_bytes, word_hashes

WINDOW = 10
#: Bytes of text in an indexed shard.
SHARD_BYTES = 8 << 20
#: Bytes of benchmark text that is broadcast at once; more takes further passes.
PHRASE_BYTES = 8 << 20
SAMPLE = 8

#: Lower case for A-Z; 0 for what parts words.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
GAP, VALUE = LOWER == 0, BYTE[LOWER]


class Words:
    """Words of adjacent texts, found and hashed without Python objects."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: np.ndarray):
        low = int(at.min()) if len(at) else 0
        self.raw = data[low : int((at + length).max()) if len(at) else 0]
        self.start, self.end, self.hash = word_hashes(self.raw, np.unique(at[length > 0] - low), GAP, VALUE)
        #: first word of each text, and how many it has
        self.first = np.searchsorted(self.start, at - low)
        self.count = np.where(length > 0, np.searchsorted(self.start, at - low + length) - self.first, 0)

    def text(self, i: int) -> bytes:
        return LOWER[self.raw[self.start[i] : self.end[i]]].tobytes()


class Phrases:
    """Distinct test phrases as symbols, and the items that hold each."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        words = Words(*text_bytes(pa.array([t for _, t in items], pa.string())))
        self.vocabulary, first, symbol = np.unique(words.hash, return_index=True, return_inverse=True)
        self.spelling = [words.text(i) for i in first.tolist()]
        if len({*self.spelling}) != len({words.text(i) for i in range(len(words.start))}):
            raise ValueError("two words of the benchmark have one hash")
        found: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for k, (a, n) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=True)):
            own = (symbol[a : a + n] + 1).tolist()
            for i in range(max(1, n - window + 1) if n else 0):
                found[tuple(own[i : i + window])].add(k)
        self.ids = [i for i, _ in items]
        self.size = np.array([len(p) for p in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for i, p in enumerate(found):
            self.symbols[i, : len(p)] = p
        self.items = [sorted(k) for k in found.values()]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; equal suffixes do not occur, as their lengths differ."""
    n = len(symbols)
    rank, k = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - k if k < n else 0] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if n == 0 or steps[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for bit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            ones = (symbols >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((bit, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for bit, before, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            low = np.where(one, zeros + before[low], low - before[low])
            high = np.where(one, zeros + before[high], high - before[high])
        return high - low


class FmIndex:
    """Index of a sequence of symbols from 0 to n_symbols - 1; inside they count from 1 and 0 ends the sequence."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        symbols, n_symbols = np.concatenate([symbols + 1, [0]]), n_symbols + 1
        self.n = len(symbols)
        order = suffix_array(symbols)
        self.last = symbols[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.tree = WaveletMatrix(self.last, n_symbols)
        self.sampled = order % SAMPLE == 0
        self.sample_of = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase."""
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.n)
        for step in range(phrases.shape[1]):
            on = np.flatnonzero((size > step) & (low < high))
            symbol = phrases[on, size[on] - 1 - step] + 1
            low[on] = self.before[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.before[symbol] + self.tree.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin."""
        at, rows, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        on = np.arange(len(rows))
        while on.size:
            hit = self.sampled[rows[on]]
            done = on[hit]
            at[done] = self.samples[self.sample_of[rows[done]]] + steps[done]
            on = on[~hit]
            symbol = self.last[rows[on]]
            rows[on] = self.before[symbol] + self.tree.rank(symbol, rows[on])
            steps[on] += 1
        return at


def expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range the values in it, and which range they come from."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count), owner


def search_shard(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
    """Per text: words, merged spans of words [first, end), and items found."""
    words = Words(*text_bytes(texts))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    items: list[set[int]] = [set() for _ in range(len(texts))]
    if not len(phrases.size) or not len(words.start):
        return words.count, spans, items
    place = np.minimum(np.searchsorted(phrases.vocabulary, words.hash), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[place] == words.hash, place + 1, 0)
    # A run of benchmark words shorter than every phrase cannot hold one: it becomes a gap, and gaps count once.
    known = symbol > 0
    breaks = ~known
    breaks[words.first[(words.count > 0)]] = True
    run_of = np.cumsum(breaks)
    kept = known & (np.bincount(run_of[known], minlength=int(run_of[-1]) + 1)[run_of] >= phrases.size.min())
    source = np.flatnonzero(kept)
    if not source.size:
        return words.count, spans, items
    new_run = np.concatenate([[True], (np.diff(source) > 1) | (np.diff(run_of[source]) > 0)])
    target = np.arange(len(source)) + np.cumsum(new_run)
    sequence = np.zeros(int(target[-1]) + 2, np.int64)
    sequence[target] = symbol[source]
    origin = np.zeros(len(sequence), np.int64)
    origin[target] = source
    index = FmIndex(sequence, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.symbols, phrases.size)
    rows, phrase = expand(low, np.maximum(high - low, 0))
    begin = origin[index.locate(rows)]
    spelt = {i: words.text(i) == phrases.spelling[symbol[i] - 1] for i in np.unique(expand(begin, phrases.size[phrase])[0]).tolist()}
    owner = np.searchsorted(words.first, begin, side="right") - 1
    while (empty := words.count[owner] <= begin - words.first[owner]).any():
        owner = owner - empty
    for i in np.lexsort((begin, owner)).tolist():
        a, p, k = int(begin[i]), int(phrase[i]), int(owner[i])
        if not all(spelt[j] for j in range(a, a + int(phrases.size[p]))):
            continue  # another word with the same hash
        items[k].update(phrases.items[p])
        a -= int(words.first[k])
        b = a + int(phrases.size[p])
        if spans[k] and a <= spans[k][-1][1]:
            spans[k][-1] = (spans[k][-1][0], max(b, spans[k][-1][1]))
        else:
            spans[k].append((a, b))
    return words.count, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Passages of ``benchmark`` in every whole text: (id, the columns of ``keep``, n_words long, spans, items).

    ``spans`` are the merged stretches of words to remove, as structs (first, end) that count
    words from 0 with ``end`` outside; ``items`` the distinct ids of the items found. A test
    phrase is ``window`` words in a row, or a whole shorter item. Null and empty texts have no
    words, null and empty items no phrases; an item without id adds spans but no id. Repeated
    rows give repeated results, an empty table none; an empty benchmark finds nothing. Other
    columns are not read. No shuffle: the benchmark is broadcast in blocks of at most
    PHRASE_BYTES of text, one pass over the documents for each block.
    """
    item_type = benchmark.schema[item_col].dataType.simpleString()
    carried = {f"_{i}": c for i, c in enumerate((id_col, *keep))}
    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in carried.items())
    schema += f", text string, n_words long, spans array<struct<first:long,end:long>>, items array<{item_type}>"
    rows = docs.select(*(F.col(c).alias(k) for k, c in carried.items()), F.col(text_col).cast("string").alias("text"))
    rows = rows.selectExpr("*", "0L AS n_words", "CAST(array() AS array<struct<first:long,end:long>>) AS spans", f"CAST(array() AS array<{item_type}>) AS items")
    test = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    total = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // (PHRASE_BYTES // 2)))
    spark = docs.sparkSession
    for k in range(passes):
        block = test.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).distinct().collect()
        shared = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in block], window))
        rows = rows.mapInArrow(_searcher(shared, [*carried], last=k == passes - 1), schema)
    return rows.select(*(F.col(k).alias(c) for k, c in carried.items()), "n_words", "spans", "items")


def _searcher(shared, carried: list[str], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in blocks(batches, "text", SHARD_BYTES):
            n_words, spans, items = search_shard(batch.column("text"), phrases)
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            spans = [merged([(s["first"], s["end"]) for s in o] + n) if o else n for o, n in zip(old_spans, spans, strict=True)]
            found = [[*{*o, *(phrases.ids[i] for i in n)} - {None}] for o, n in zip(old_items, items, strict=True)]
            texts = pa.nulls(len(spans), pa.string()) if last else batch.column("text")
            columns = [*(batch.column(c) for c in carried), texts, pa.array(n_words, pa.int64()), pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], batch.schema.field("spans").type), pa.array(found, batch.schema.field("items").type)]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "text", "n_words", "spans", "items"])

    return run


def summary(leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of what ``find_leaks`` returned, one row per document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return leaks.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)
