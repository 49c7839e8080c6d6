"""Scalar functions over names, identifiers, vectors and texts. Null in, null out unless stated."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Legacy names of relationship types (fixed values).
LEGACY_TYPES = {"USES_METHODOLOGY": "USES_METHOD", "ADDRESSES_PROBLEM": "ADDRESSES"}


def normalize_surface(name: Column) -> Column:
    """Lower case; separators and parentheses become spaces, dots go, runs of space shrink."""
    plain = F.regexp_replace(F.translate(F.lower(name), "_-/().", "     "), r"\s+", " ")
    return F.regexp_replace(F.trim(plain), "finetuning", "fine tuning")


def acronym_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def normalize_string(text: Column) -> Column:
    squeezed = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(squeezed, r"(?U)[^\w\s-]", ""), "-+", "-")


def normalize_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def normalize_relationship_type(kind: Column) -> Column:
    """Upper case, legacy names replaced; null reads as RELATED_TO."""
    out = F.upper(F.trim(F.coalesce(kind, F.lit("RELATED_TO"))))
    for old, new in LEGACY_TYPES.items():
        out = F.when(out == old, new).otherwise(out)
    return out


def title_case(name: Column) -> Column:
    """Every letter after one that is none in upper case, the others in lower case."""
    parts = F.split(name, r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def token_set(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(token_set(a), token_set(b))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of alphanumeric words padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def chunk_id(section: Column, level: Column, order: Column, text: Column) -> Column:
    return F.concat_ws("_", section, level.cast("string"), order.cast("string"), F.substring(F.md5(F.substring(text, 1, 100)), 1, 8))


def quality_band(value: Column) -> Column:
    return F.when(value >= 0.5, "Strong").when(value >= 0.3, "Moderate").otherwise("Weak")


def ascii_boundaries(pattern: Column) -> Column:
    """The regular expression with ``\\b`` and ``\\B`` written out for ASCII words; Java's own count letters of every script."""
    w = "[0-9A-Za-z_]"
    for mark, means in (("b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"), ("B", f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))")):
        pattern = F.regexp_replace(pattern, rf"(?<!\\)((?:\\\\)*)\\{mark}", f"$1{means}")
    return pattern


def split_authors(authors: Column) -> Column:
    """By semicolons, else by commas if there is no digit, else one author; empty names go."""
    parts = F.when(F.contains(authors, F.lit(";")), F.split(authors, ";")).when(F.contains(authors, F.lit(",")) & ~authors.rlike("[0-9]"), F.split(authors, ",")).otherwise(F.array(authors))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def embedding_text(kind: Column, name: Column, definition: Column) -> Column:
    return F.concat_ws(" - ", F.concat(kind, F.lit(": "), name), definition)


@F.arrow_udf(DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Matching-blocks ratio of two strings; use it after blocking only."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in pairs], pa.float64())


def name_similarity(a: Column, b: Column) -> Column:
    """0.55 ratio + 0.45 token Jaccard, 0.1 more if one key begins with the other, at most 1."""
    ka, kb = acronym_key(a), acronym_key(b)
    bonus = F.when((ka != "") & (kb != "") & (ka.startswith(kb) | kb.startswith(ka)), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), 0.55 * sequence_ratio(a, b) + 0.45 * token_jaccard(a, b) + bonus)
