"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-tokens.

A pre-token is a stretch of text that no piece of the vocabulary crosses, so counts add
up. Within a block the documents' pre-tokens are coded by their place among the distinct
ones; the join is an index lookup and the sum a segmented one. No ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_bytes

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}*\\w+|{SPACE}*[^\\w{SPACE}]+|{SPACE}+")
#: Distinct pre-tokens whose counts a Python worker remembers before it starts afresh.
MEMO = 500_000
#: A byte-fallback character that no piece holds: what follows it is encoded on its own.
GUARD = "\n"


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        if any(GUARD in p for p in pieces) or len(self.model.encode(f"{GUARD}a", out_type=str)) != 3:
            raise ValueError(f"{path}: the vocabulary does not keep line ends apart")
        #: Texts with one of these pieces, which cross a boundary of pre-tokens, are counted whole.
        self.crossing = [p for p in pieces if len(PRE_TOKEN.findall(p)) > 1]
        self.memo: dict[str, int] = {}

    def block(self, texts: list[str]) -> np.ndarray:
        """Pieces of each text."""
        total = np.zeros(len(texts), np.int64)
        words, owner = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            marked = SPACE + text.replace(" ", SPACE)
            if any(p in marked for p in self.crossing):
                total[i] = len(self.model.encode(text))
                continue
            found = PRE_TOKEN.findall(marked)
            words += found
            owner.append((i, len(found)))
        if not owner:
            return total
        if len(self.memo) > MEMO:
            self.memo.clear()
        if new := list(set(words) - self.memo.keys()):
            for w, ids in zip(new, self.model.encode([GUARD + w for w in new], num_threads=1), strict=True):
                self.memo[w] = len(ids) - 2
        counts = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        rows, sizes = np.array(owner).T
        total[rows] = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UTF-8 bytes and tokens of every whole text: (id, n_bytes long, n_tokens long).

    ``model`` is the path of a sentencepiece model that every worker can open; begin and end
    tokens are not counted, and special strings in a text are ordinary text. Null texts count
    as empty: no bytes, no tokens. Repeated rows give repeated results, an empty table none;
    other columns are not read. No shuffle, and memory is bounded by a block and the memo.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in blocks(batches, "text"):
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(text_bytes(texts)[2], pa.int64()), pa.array(c.block(texts.to_pylist()), pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )
        c.memo.clear()  # the worker goes on to other work

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
