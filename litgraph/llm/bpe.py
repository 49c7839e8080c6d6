"""BPE encoding and decoding: speculate by longest match, verify every adjacent pair, merge only what fails.

Greedy longest match proposes the tokens of each distinct pre-token. A sequence of tokens
is the one that merging would give exactly when every adjacent pair is, so all pairs of a
block of pre-tokens are tested together in numpy; the pre-tokens with a failing pair go
through exact merging.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, release

#: Pre-tokens of byte-level BPE (fixed value of the vocabulary's format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct pre-tokens that a Python worker remembers before it starts afresh.
MEMO = 300_000
#: Bytes of text whose pre-tokens are Python objects at a time.
BLOCK_BYTES = 1 << 20
NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A byte-level BPE vocabulary. Inside, bytes are 0 to 255 and the token of merge i is 256 + i."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        letters, vocab = byte_letters(), model["vocab"]
        plain = lambda piece: bytes(letters[c] for c in piece)
        n = 256 + len(model["merges"])
        self.n, self.left, self.right, self.vocab_id = n, np.arange(n), np.arange(n), np.zeros(n, np.uint32)
        self.tokens: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        for c, b in letters.items():
            self.vocab_id[b] = vocab[c]
        self.merged: dict[tuple[int, int], int] = {}
        for i, pair in enumerate(model["merges"], 256):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = self.tokens[plain(a)], self.tokens[plain(b)]
            self.merged[x, y], self.left[i], self.right[i], self.vocab_id[i] = i, x, y, vocab[a + b]
            self.tokens[plain(a + b)] = i
        keys = np.array([x * n + y for x, y in self.merged], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(self.merged.values()), np.int64)[order]
        #: A token counts as a proposal only if merging gives it back from its own bytes.
        own = self.compatible(self.left[256:], self.right[256:], np.arange(256, n))
        self.tokens = {t: i for t, i in self.tokens.items() if i < 256 or own[i - 256]}
        self.longest: dict[bytes, int] = {}
        for t in self.tokens:
            self.longest[t[:2]] = max(len(t), self.longest.get(t[:2], 1))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: plain(p) for p, i in vocab.items() if i not in self.special.values()} | {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pre = regex.compile(PRE_TOKEN)
        self.memo: dict[str, bytes] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of a + b gives [a, b], for many pairs at once.

        Undoes merges on both sides of the boundary from the latest to the earliest; the pair
        fails if some merge across the boundary would have come before one of those undone.
        """
        ok, rows = np.ones(len(a), bool), np.arange(len(a))
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        limit = np.full(len(a), NONE) if limit is None else np.asarray(limit, np.int64)
        while rows.size:
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = np.where(self.keys[at] == key, self.to[at], NONE) < limit
            ok[rows[bad]] = False
            at_bytes = (a < 256) & (b < 256)
            go = ~bad & ~at_bytes
            rows, a, b = rows[go], a[go], b[go]
            undo_a = a > b
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def propose(self, word: bytes) -> list[int]:
        found, i, n, get = [], 0, len(word), self.tokens.get
        while i < n:
            j = min(n, i + self.longest.get(word[i : i + 2], 1))
            while (t := get(word[i:j])) is None:
                j -= 1
            found.append(t)
            i = j
        return found

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest merge first and leftmost among equals, in n log n."""
        tok, n, get = list(word), len(word), self.merged.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i, tok[i], tok[i + 1]) for i in range(n - 1) if (m := get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, x, y = heapq.heappop(heap)
            j = after[i]
            if tok[i] != x or j < 0 or tok[j] != y:
                continue
            tok[i], tok[j], after[i] = m, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (k := get((m, tok[after[i]]))) is not None:
                    heapq.heappush(heap, (k, i, m, tok[after[i]]))
            if (p := before[i]) >= 0 and (k := get((tok[p], m))) is not None:
                heapq.heappush(heap, (k, p, tok[p], m))
        return [t for t in tok if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of new distinct pre-tokens into the memo."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False
        first = np.flatnonzero(inner)
        pairs, back = np.unique(flat[first] * self.n + flat[first + 1], return_inverse=True)
        failing = ~self.compatible(pairs // self.n, pairs % self.n)[back]
        owner = np.repeat(np.arange(len(words)), sizes)[first[failing]]
        again = set(owner.tolist())
        ids = self.vocab_id[flat].astype("<u4").tobytes()
        start = 0
        for i, (w, end) in enumerate(zip(words, (ends * 4).tolist(), strict=True)):
            self.memo[w] = self.vocab_id[self.merge(raw[i])].astype("<u4").tobytes() if i in again else ids[start:end]
            start = end

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = []
        for text in texts:
            if self.cut and any(t in text for t in self.special):
                words: list = []
                for i, part in enumerate(self.cut.split(text)):
                    words += [self.special[part]] if i % 2 else self.pre.findall(part)
            else:
                words = self.pre.findall(text)
            parts.append(words)
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = {w for words in parts for w in words if type(w) is str} - self.memo.keys()
        if new:
            self.learn(list(new))
        memo = self.memo
        fixed = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        return [b"".join([memo[w] if type(w) is str else fixed[w] for w in words]) for words in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and decodes the ids again: (id, ids_le binary, n_tokens long, decoded string).

    ``ids_le`` holds the ids as little-endian unsigned 32-bit integers. Strings of added
    tokens inside a text become those tokens. Null texts count as empty and have no ids;
    repeated rows give repeated results; an empty table gives none; other columns are not
    read. ``vocabulary`` is the path of a byte-level BPE file that every worker can open.
    No shuffle: a task keeps one block of texts and a bounded memo of pre-tokens.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            ids = c.encode_block([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([c.decode(i) for i in ids], pa.string())],
                ["id", "ids_le", "n_tokens", "decoded"],
            )
        c.memo.clear()  # the worker goes on to other work
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids_le binary, n_tokens long, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
