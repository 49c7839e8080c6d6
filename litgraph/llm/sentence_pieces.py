"""SentencePiece BPE by backtracking: longest matches, checks of adjacent tokens, a bit field of failed positions.

An Aho-Corasick automaton over the reversed pieces gives the longest piece that starts at
each position. Tokens are put down left to right; a token may follow another only if
merging their joined text again gives exactly these two, and then the whole sequence is
the one that merging would give. Where no token fits, the position is marked as failed in
a bit field and the token before it is shortened, so no position is tried twice.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, without_cycles

SPACE = "▁"
#: No piece goes over the borders of these words (checked when a model is read).
WORD = regex.compile(rf"{SPACE}*(?:\p{{L}}+|[^\p{{L}}{SPACE}\n]+\p{{L}}*)|{SPACE}+|\n")
#: Distinct words, and pairs of tokens, that a Python worker remembers before it starts afresh.
MEMO, PAIRS = 300_000, 2_000_000


class PieceCodec:
    """A sentencepiece BPE model with byte fallback and without normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.name = [model.id_to_piece(i) for i in ids]
        control = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        self.byte_id = {int(self.name[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.end_id = model.eos_id()
        pieces = {self.name[i]: i for i in ids if i not in control and not model.is_byte(i)}
        probe = "Ａ​  x "  # a model that normalises texts would change these
        if len(self.byte_id) != 256 or any(regex.search(rf"[^{SPACE}]{SPACE}|\n|\p{{L}}\P{{L}}", p) for p in pieces) or b"".join(self.raw(model, i) for i in model.encode(probe)).decode() != " " + probe:
            raise ValueError(f"{path}: not a plain BPE model with byte fallback, or pieces cross borders of words")
        #: Merging takes the pair whose joined piece has the best score, the leftmost among equals.
        score = {p: model.get_score(i) for p, i in pieces.items()}
        tied = Counter(score[p] for p in pieces if len(p) > 1)
        if any(tied[score[p]] > 1 and len(set(p)) > 1 for p in pieces if len(p) > 1):
            raise ValueError(f"{path}: pieces of equal score that are not runs of one character")
        self.rank = {p: -s for p, s in score.items()}
        self.letters = {p for p in pieces if len(p) == 1}
        #: A piece is only proposed if merging its own characters gives it back.
        self.id_of = {p: i for p, i in pieces.items() if len(p) == 1 or self.merge(p) == [p]}
        self.ahead = ahocorasick.Automaton()
        for p in self.id_of:
            self.ahead.add_word(p[::-1], p)
        self.ahead.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), None) for p in self.id_of}
        self.bytes_of = [self.raw(model, i) for i in ids]
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def raw(self, model, i: int) -> bytes:
        """The bytes that a token stands for."""
        if model.is_control(i):
            return b""
        return bytes([int(self.name[i][3:5], 16)]) if model.is_byte(i) else self.name[i].replace(SPACE, " ").encode()

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by merging: best score first, leftmost among equals, in n log n."""
        piece, n, rank = list(text), len(text), self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := piece[i] + piece[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not piece[i] or piece[i] + piece[j] != joined or len(piece[i]) == len(joined):
                continue
            piece[i], piece[j], after[i] = joined, "", after[j]
            if (k := after[i]) >= 0:
                before[k] = i
                if (p := joined + piece[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (k := before[i]) >= 0 and (p := piece[k] + joined) in rank:
                heapq.heappush(heap, (rank[p], k, p))
        return [p for p in piece if p]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the text of ``a`` and ``b`` again gives these two; remembered for later."""
        fit = self.fits[a, b] = self.merge(a + b) == [a, b]
        return fit

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all pieces."""
        if text in self.id_of:
            return [text]
        # matches come by their ends, the longest first; in the reversed text an end is a start
        found = list(self.ahead.iter(text[::-1]))
        found.reverse()
        longest, n, fits, shorter = dict(found), len(text), self.fits, self.shorter
        failed = bytearray((n >> 3) + 1)
        done: list[str] = []
        at, token, last = 0, longest[n - 1], None
        while True:
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last is None:
                        break
                    fit = fits.get((last, token))
                    if fit if fit is not None else self.compatible(last, token):
                        break
                token = shorter[token]
            if token is None:
                failed[at >> 3] |= 1 << (at & 7)
                token = shorter[last]
                done.pop()
                at -= len(last)
                last = done[-1] if done else None
                continue
            done.append(token)
            if end == n:
                return done
            at, last = end, token
            token = longest[n - 1 - at]

    def word(self, word: str) -> list[int]:
        """The ids of a word; characters that are no piece become their bytes."""
        if self.letters.issuperset(word):
            return [self.id_of[p] for p in self.backtrack(word)]
        found: list[int] = []
        start = 0
        for i, c in enumerate(word):
            if c not in self.letters:
                if start < i:
                    found += [self.id_of[p] for p in self.backtrack(word[start:i])]
                found += [self.byte_id[b] for b in c.encode()]
                start = i + 1
        if start < len(word):
            found += [self.id_of[p] for p in self.backtrack(word[start:])]
        return found

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text ends in them), the end id last in each text."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(self.fits) > PAIRS:
            self.fits.clear()
        memo, ids, ends = self.memo, [], []
        for text in texts:
            for w in WORD.findall(SPACE + text.replace(" ", SPACE)) if text else ():
                known = memo.get(w)
                if known is None:
                    known = memo[w] = tuple(self.word(w))
                ids += known
            ids.append(self.end_id)
            ends.append(len(ids))
        return np.array(ids, np.int32), np.array(ends, np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control tokens have none, and the space put before every text goes."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, an end id last, and decodes the ids again: (id, ids array<int>, n_tokens long, decoded string).

    ``model`` is the path of a sentencepiece BPE model with byte fallback that every worker
    can open. Special strings in a text are ordinary text; U+2581 in a text counts as a space
    and is decoded as one. Null and empty texts have the end id only. Repeated rows give
    repeated results, null ids stay null, an empty table gives none; other columns are not
    read. No shuffle: a task holds one block of texts, a worker a bounded memo of words and pairs.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = piece_codec(model)
        for batch in blocks(batches, "text"):
            with without_cycles():
                ids, ends = c.encode_block([t or "" for t in batch.column("text").to_pylist()])
            starts = np.concatenate([[0], ends[:-1]])
            flat = ids.tolist()
            decoded = [c.decode(flat[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(ends - starts), pa.array(decoded, pa.string())], ["id", "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>, n_tokens long, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests: ids as decimal numbers joined by one space, decoded texts as UTF-8."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(id_col, "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
