"""Language identification by rank-order profiles and the out-of-place distance.

A profile is the most frequent letter n-grams (one to three letters, with word edges) in
order of frequency, in any script. A document goes to the language whose profile its own ranking is
least out of place with; n-grams that a profile lacks count as out of place by its size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import durable
from .common import blocks

PROFILE = 300
#: The classifier is fitted on at most this many labelled documents of a language, the first by a hash.
TRAINING_DOCS = 1000
#: Up to so many languages are broadcast with their number of rows.
BROADCAST_LANGUAGES = 65_536
#: Stands for what is no letter: one more than the last code point.
EDGE = sys.maxunicode + 1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(text: str) -> np.ndarray:
    """Lower-case code points; one EDGE stands for each stretch of what is no letter, and at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, points, EDGE)[keep].astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in order, how often each occurs): one to three code points of 21 bits each, of any script."""
    p = code_points(text)
    if len(p) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (p[:-1] << 21) | p[1:]
    return np.unique(np.concatenate([(two[:-1] << 21) | p[2:], two, p[p != EDGE]]), return_counts=True)


def ranking(codes: np.ndarray, n: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if len(codes) > size:
        keep = n >= np.partition(n, len(n) - size)[len(n) - size]
        codes, n = codes[keep], n[keep]
    return codes[np.argsort(-n, kind="stable")][:size]


@dataclass
class Profiles:
    languages: list[str]
    codes: np.ndarray  # all n-grams of the profiles, in order
    ranks: np.ndarray  # by language and code; PROFILE where the profile lacks it, as in the last column

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, n = gram_counts(text or "")
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranking(codes, n)
        at = np.searchsorted(self.codes, own)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == own
        lacking = self.ranks[:, np.where(known, at, len(self.codes))]
        distance = np.where(lacking < PROFILE, np.abs(lacking - np.arange(len(own))), PROFILE).sum(1)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(own)))


def profiles_of(ranked: list[tuple[str, int, int]]) -> Profiles:
    """Profiles from (language, n-gram, rank)."""
    languages, codes = sorted({r[0] for r in ranked}), np.unique(np.array([r[1] for r in ranked], np.int64))
    ranks = np.full((len(languages), len(codes) + 1), PROFILE, np.int32)
    if ranked:
        place = {name: k for k, name in enumerate(languages)}
        ranks[[place[r[0]] for r in ranked], np.searchsorted(codes, [r[1] for r in ranked])] = [r[2] for r in ranked]
    return Profiles(languages, codes, ranks)


def train(docs: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAINING_DOCS) -> Profiles:
    """Profiles of the languages in ``lang_col``, from at most ``max_docs`` rows of each that ``usable`` (a condition) lets in.

    Every language is learned. A rare one has all its rows in the sample; rows equal in id and text count once. The
    driver gets PROFILE codes of each language, not texts. Rows without text or language
    teach nothing; with no rows at all every prediction is ``und``.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), text).alias("h"), usable.alias("usable"))
    rows = rows.filter("usable and lang is not null and text is not null")
    # a share of each language a little over what is wanted, of which the first by hash stay
    # texts are only joined by language, which may be a hot key, where the languages are too many to broadcast
    sizes = durable(rows.groupBy("lang").agg(F.count("*").alias("rows")))
    some = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes, "lang").filter(F.pmod("h", F.lit(1 << 30)) * F.col("rows") < F.lit(1.3 * max_docs * (1 << 30)))
    once = some.groupBy("lang", "h").agg(F.first("text").alias("text"))
    sample = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).filter(F.col("place") <= max_docs)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted({*langs.tolist()}):
                found = [gram_counts(t) for t in batch.column("text").filter(pa.array(langs == lang)).to_pylist()]
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    grams = sample.repartition("lang", "h").select("lang", "text").mapInArrow(counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = grams.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < PROFILE).collect()
    return profiles_of([(r["lang"], r["code"], r["rank"]) for r in ranked])


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: (id, the columns of ``keep``, lang_pred, score 0 to 1, higher the better in place).

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows give
    repeated results, an empty table none; other columns are not read. No shuffle; the
    profiles that are broadcast have a fixed size for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            found = [shared.value.predict(t) for part in blocks([pa.RecordBatch.from_arrays([array], ["text"])], "text") for t in part.column("text").to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    found = F.arrow_udf(predict, "struct<lang_pred:string,score:double>")(F.col(text_col).cast("string"))
    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate((id_col, *keep))), found.alias("_found"))
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate((id_col, *keep))), F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))
