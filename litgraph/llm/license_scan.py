"""License scans: fuzzy search for short notices with exact seeds and bounded-error matching.

A notice that may hold k errors is split into k + 1 pieces, of which one at least stands
unchanged in any match (pigeonhole). The pieces are looked up exactly; around each place
found, the regex library's error-bounded matching verifies the notice and gives its span.
Words that tell licenses apart, such as names and versions, must stand unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: Notices whose exact places are the base result (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices searched with errors: label, words (* before those that take none), most edits (fixed values).
FUZZY = [
    ("mit", "under the *mit license", 2),
    ("apache-2", "*apache license version *2", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("gpl", "*gnu *general public license", 3),
    ("lgpl", "*gnu *lesser general public license", 3),
    ("mpl-2", "*mozilla public license version *2", 3),
    ("cc-by-nc", "creative commons *attribution *noncommercial", 3),
    ("cc-by", "creative commons *attribution *4 *0 international", 3),
]
#: Lower case for A-Z; what parts words becomes a space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> bytes:
    """The words of a text, each followed and the first preceded by one space."""
    found = text.encode().translate(TO_WORDS).split()
    return b" " + b" ".join(found) + b" " if found else b" "


class Words:
    """The words of a text, each followed and the first preceded by one space, and their numbers."""

    def __init__(self, text: str | None):
        self.bytes = words_of(text or "")
        self.count = self.bytes.count(b" ") - 1

    @cached_property
    def spaces(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.bytes, np.uint8) == 32)

    def number(self, at: int) -> int:
        """How many words begin before a place."""
        return int(np.searchsorted(self.spaces, at))


@dataclass
class Notice:
    label: str
    words: str
    edits: int
    phrase: str = field(init=False)
    seeds: list[tuple[bytes, int]] = field(init=False)
    pattern: regex.Pattern = field(init=False)

    def __post_init__(self):
        self.phrase = self.words.replace("*", "")
        raw, n = self.phrase.encode(), self.edits + 1
        cuts = [len(raw) * i // n for i in range(n + 1)]
        self.seeds = [(raw[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        # stretches of words with errors between words without any
        parts, loose = [], ""
        for k, word in enumerate(self.words.split()):
            if word[0] == "*":
                parts += [self._loose(loose), f"(?<![^ ]){regex.escape(word[1:])}(?![^ ])"]
                loose = ""
            else:
                loose += word
            if k < self.words.count(" "):
                loose += " "
        self.pattern = regex.compile(f"(?b)(?<![^ ]){''.join(parts)}{self._loose(loose)}(?![^ ])".encode())

    def _loose(self, text: str) -> str:
        return text if not text.strip() else f"(?:{regex.escape(text)}){{e<={self.edits}}}"

    def spans(self, words: bytes) -> list[tuple[int, int, int]]:
        """Byte spans and edits of all matches, apart from one another."""
        windows, size, slack = [], len(self.phrase.encode()), 2 * self.edits + 1
        for seed, offset in self.seeds:
            at = words.find(seed)
            while at >= 0:
                windows.append((max(0, at - offset - slack), at - offset + size + slack))
                at = words.find(seed, at + 1)
        found, end = [], 0
        for a, b in sorted(windows):
            a = max(a, end)
            while a < b and (m := self.pattern.search(words, a, min(b, len(words)))):
                if sum(m.fuzzy_counts) > self.edits:  # each stretch has kept to the bound, all together have not
                    a = m.start() + 1
                    continue
                found.append((*m.span(), sum(m.fuzzy_counts)))
                a = end = m.end()
        return found


def scan_text(text: str | None, base: dict[str, str], notices: list[Notice]) -> dict:
    words = Words(text)
    places, base_labels = [], set()
    for phrase, label in base.items():
        key = b" " + phrase.encode() + b" "
        at = words.bytes.find(key)
        while at >= 0:
            places.append(words.number(at))
            base_labels.add(label)
            at = words.bytes.find(key, at + 1)
    labels, spans, score = set(base_labels), [], 1.0 if places else 0.0
    for notice in notices:
        for a, b, edits in notice.spans(words.bytes):
            labels.add(notice.label)
            score = max(score, 1 - edits / len(notice.phrase))
            first = words.number(a) - 1
            spans.append({"label": notice.label, "first_word": first, "n_words": words.number(b) - first, "edits": edits})
    return {
        "n_words": words.count, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": score, "spans": spans,
    }


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, fuzzy: list[tuple[str, str, int]] = FUZZY) -> DataFrame:
    """License notices of every whole text, with their word spans.

    Returns (id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans):
    base columns for exact places of ``base`` phrases, ``labels`` with those of the fuzzy
    notices too, ``score`` the best 1 - edits / length, ``spans`` every fuzzy match. Null
    texts count as empty: no words, no places (null first and last word), empty labels,
    score 0. Repeated rows give repeated results, an empty table none; other columns are
    not read. No shuffle; memory is one block of texts.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())]))
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = [Notice(*n) for n in fuzzy]
        for batch in blocks(batches, "text"):
            rows = [scan_text(t, base, notices) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in rows], t) for k, t in types.items())], ["id", *types])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,edits:int>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
