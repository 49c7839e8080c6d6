"""Similarity joins of names and vectors that compare only what can be similar enough, and lose no pair.

Names are sets of tokens: words, or characters with their number of occurrence. Two sets
that must share enough tokens share one among the rarest few of both (the prefix filter),
where how many these are follows from both sizes. Vectors are dealt to the nearest of a
few pivots; the triangle inequality of angles says which other pivots' vectors can be near.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .graph import durable

#: Rows of one key that meet in a task at most; a key with more is dealt over blocks.
KEY_BLOCK = 4_096
#: Pivots that vectors are dealt to, and vectors of a block.
PIVOTS, VECTOR_BLOCK = 64, 2_048
#: Blocks of vectors of a group where all are compared, unless a block would pass so many vectors.
BLOCKS, MOST_BLOCK = 12, 65_536
#: Least cosine for which pivots may keep vectors apart: twice its angle is a right angle and a third.
WIDE = 0.5


def word_tokens(name: Column) -> Column:
    """Distinct words."""
    return F.array_distinct(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))


def character_tokens(name: Column) -> Column:
    """Characters, each with how many equal ones stand before it, so that a multiset becomes a set."""
    characters = F.filter(F.split(name, ""), lambda c: c != "")
    return F.transform(characters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(characters, 1, i), lambda d: d == c)).cast("string")))


def by_rarity(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (id, grp, tokens) with the tokens sorted from the rarest to the most common by ``known`` (token, n), ties by token."""
    tokens = rows.select("id", "grp", F.explode("tokens").alias("token")).join(known, "token")
    ranked = tokens.groupBy("id", "grp").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))  # one row's own tokens
    return ranked.select("id", "grp", F.transform("t", lambda x: x["token"]).alias("tokens"))


def with_prefixes(rows: DataFrame, share: float, larger: bool | None) -> DataFrame:
    """A row for each size that a partner can have and each token of the prefix for it: (id, grp, own, other, token).

    Sets of sizes a and b match if they share at least ``share`` * (a + b) tokens. So b lies
    between a * share / (1 - share) and its inverse, and a pair shares a token among the
    first a - ceil(share * (a + b)) + 1 of the one and of the other alike. ``larger`` keeps
    partners of at least (True) or at most (False) the own size, None keeps all.
    """
    a, ratio, eps = F.size("tokens"), share / (1 - share), 1e-9
    least = F.lit(1) if larger is None else a
    low = F.greatest(F.lit(1), F.ceil(a * ratio - eps).cast("int")) if larger is not True else least
    high = F.floor(a / ratio + eps).cast("int") if larger is not False else a
    sized = rows.select("*", a.alias("own"), F.explode(F.sequence(low, F.greatest(low, high))).alias("other"))
    length = F.col("own") - F.ceil(share * (F.col("own") + F.col("other")) - eps).cast("int") + 1
    return sized.withColumn("length", length).filter("length > 0").select("id", "grp", "own", "other", F.explode(F.slice("tokens", 1, F.col("length"))).alias("token"))


def overlap_pairs(left: DataFrame, right: DataFrame | None, share: float) -> DataFrame:
    """All pairs (id1, id2) of one group whose token sets share at least ``share`` * (both sizes): from ``left`` and ``right`` (id, grp, tokens), or within ``left`` with id1 < id2.

    ``share`` is j / (1 + j) for a Jaccard similarity of j, and d / 2 for a Dice similarity
    of d. Only pairs that share a token of both prefixes are made; a token of more than
    KEY_BLOCK rows is dealt over blocks of both sides, each pair of blocks a key of its own.
    Rows without tokens match nothing.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    sides = [df.filter(F.size("tokens") > 0).select("id", "grp", "tokens") for df in (left, right) if df is not None]
    tokens = [df.select(F.explode("tokens").alias("token")) for df in sides]
    known = durable((tokens[0] if right is None else tokens[0].union(tokens[1])).groupBy("token").agg(F.count("*").alias("n")))
    sides = [durable(by_rarity(df, known)) for df in sides]
    one, two = sides[0], sides[-1]
    l, r = with_prefixes(one, share, True if right is None else None), with_prefixes(two, share, False if right is None else None)
    keys = ["grp", "token", "n1", "n2"]
    l = l.select(F.col("id").alias("id1"), "grp", "token", F.col("own").alias("n1"), F.col("other").alias("n2"))
    r = r.select(F.col("id").alias("id2"), "grp", "token", F.col("other").alias("n1"), F.col("own").alias("n2"))
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / KEY_BLOCK).cast("int").alias(name))
    dealt = blocks(l, "b1").join(blocks(r, "b2"), keys)  # a key for each token and pair of sizes
    deal = lambda df, id_, own, n, other, m: df.join(dealt, keys).withColumn(own, F.pmod(F.xxhash64(id_), F.col(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    l = deal(l, "id1", "i", "b1", "j", "b2").select("id1", *keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    r = deal(r, "id2", "j", "b2", "i", "b1").select("id2", *keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    # so many tasks whatever the bytes: few tokens give many pairs
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = l.repartition(parts, *keys, "i", "j").join(r.repartition(parts, *keys, "i", "j"), [*keys, "i", "j"])
    if right is None:
        met = met.filter("id1 <> id2 and (n1 < n2 or id1 < id2)").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
    pairs = met.select("id1", "id2").distinct().repartition(parts)
    side = lambda df, c, t: df.select(F.col("id").alias(c), F.col("tokens").alias(t))
    both = pairs.join(side(one, "id1", "t1"), "id1").join(side(two, "id2", "t2"), "id2")
    shared = F.size(F.array_intersect("t1", "t2"))
    return both.filter(shared >= share * (F.size("t1") + F.size("t2")) - 1e-9).select("id1", "id2")


def name_classes(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Membership of rows that agree in ``keys``: (id, rep), rep the smallest id."""
    reps = rows.groupBy(*keys).agg(F.min(id_col).alias("rep"))
    on = [rows[k].eqNullSafe(reps[k]) for k in keys]
    return rows.join(reps, on).select(rows[id_col].alias(id_col), "rep")


def string_candidate_pairs(names: DataFrame, least: float = 0.82, most_apart: int = 20) -> DataFrame:
    """Pairs of canonical names of one type and bucket that may be one entity: (entity_type, bucket, name1, name2, score), name1 < name2.

    ``names`` has entity_type, bucket and name; repeated names count once. The score is 0.55
    of the matching-blocks ratio and 0.45 of the Jaccard similarity of words, 0.1 more if one
    key begins with the other, at most 1; lengths are at most ``most_apart`` apart. As the
    ratio is at most 1, names must share words: Jaccard (least - 0.65) / 0.45 or more, which
    the join on rare words finds; the ratio itself is only computed where an upper bound from
    the characters that both have leaves room for it.
    """
    jaccard = (least - 0.65) / 0.45
    if jaccard <= 0:
        raise ValueError("least must be over 0.65: below it names without a common word could match")
    reps = names.filter("name is not null").groupBy("entity_type", "bucket", "name").agg(F.lit(1).alias("one"))
    reps = reps.select(F.struct("entity_type", "bucket", "name").alias("id"), F.struct("entity_type", "bucket").alias("grp"), word_tokens(F.col("name")).alias("tokens"))
    pairs = overlap_pairs(reps, None, jaccard / (1 + jaccard))
    near = pairs.select(F.col("id1.entity_type").alias("entity_type"), F.col("id1.bucket").alias("bucket"), F.col("id1.name").alias("name1"), F.col("id2.name").alias("name2"))
    a, b = F.col("name1"), F.col("name2")
    words = S.jaccard(word_tokens(a), word_tokens(b))
    near = near.filter(F.abs(F.length(a) - F.length(b)) <= most_apart).withColumn("rest", 0.45 * words + prefix_bonus(a, b))
    near = near.filter(0.55 * ratio_bound(a, b) + F.col("rest") >= least - 1e-9)
    scored = near.withColumn("score", F.least(F.lit(1.0), 0.55 * S.sequence_ratio(a, b) + F.col("rest")))
    return scored.filter(F.col("score") >= least).select("entity_type", "bucket", "name1", "name2", "score")


def prefix_bonus(a: Column, b: Column) -> Column:
    """0.1 if the key of one name begins with that of the other."""
    ka, kb = S.acronym_key(a), S.acronym_key(b)
    return F.when((ka != "") & (kb != "") & (ka.startswith(kb) | kb.startswith(ka)), 0.1).otherwise(0.0)


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the matching-blocks ratio: twice the characters that both have, over both lengths."""
    common = F.size(F.array_intersect(character_tokens(a), character_tokens(b)))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2 * common / (F.length(a) + F.length(b)))


def similar_names(names: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs (id1, id2, similarity) of ``names`` (id, name) whose matching-blocks ratio is at least ``least``, id1 < id2.

    The ratio counts common characters in order, so it is at most the Dice similarity of the
    two multisets of characters, which the join on rare characters bounds exactly.
    """
    rows = names.select("id", F.lit("").alias("grp"), character_tokens(F.col("name")).alias("tokens"))
    pairs = overlap_pairs(rows, None, least / 2)
    called = lambda c, n: names.select(F.col("id").alias(c), F.col("name").alias(n))
    both = pairs.join(called("id1", "a"), "id1").join(called("id2", "b"), "id2")
    return both.withColumn("similarity", S.sequence_ratio(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least).select("id1", "id2", "similarity")


def find_duplicate_concepts(concepts: DataFrame, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership) of likely duplicates among concepts (id, name, canonical_id) that no merge has a canonical id for.

    Concepts whose normalised names are equal form a class, named by its smallest id:
    membership is (id, rep). Pairs (id1, id2, similarity) are between the classes, the ratio
    taken from the smaller id to the larger; copies are not expanded into pairs.
    """
    named = concepts.filter("canonical_id is null and name is not null").select("id", S.normalize_string(F.col("name")).alias("name"))
    reps = named.groupBy("name").agg(F.min("id").alias("id")).select("id", "name")
    return similar_names(durable(reps), least), name_classes(named, ["name"])


def normalize_concepts(names: DataFrame, aliases: DataFrame, stored_aliases: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """The canonical form of each row of ``names`` (id, name): (id, name, canonical_name, confidence, match_type).

    The first that holds of: an alias (alias, canonical) with confidence 1; a stored alias
    with 0.95; the known concept (place, name) whose normalised name is most like it, by a
    matching-blocks ratio of at least ``least``, ties to the smallest place; else the name
    itself in title case, with confidence 1. The match types are alias, db_alias, fuzzy and
    new. Aliases and names are compared in normalised form; of several canonical names of one
    alias the greatest counts. Each distinct name is looked up once.
    """
    key = S.normalize_string(F.col("name"))
    own = names.select("id", "name", key.alias("key"))
    keys = own.filter("key is not null").select("key").distinct()
    table = lambda df, c: df.select(S.normalize_string(F.col("alias")).alias("key"), "canonical").groupBy("key").agg(F.max("canonical").alias(c))
    marked = durable(keys.join(table(aliases, "first"), "key", "left").join(table(stored_aliases, "second"), "key", "left"))
    open_ = marked.filter("first is null and second is null")
    forms = known.select("place", "name", key.alias("form")).filter("form is not null")
    forms = forms.groupBy("form").agg(F.min_by(F.struct("place", "name"), "place").alias("of"))
    sets = lambda df, c: df.select(F.col(c).alias("id"), F.lit("").alias("grp"), character_tokens(F.col(c)).alias("tokens"))
    pairs = overlap_pairs(sets(open_, "key"), sets(forms, "form"), least / 2).withColumn("ratio", S.sequence_ratio(F.col("id1"), F.col("id2"))).filter(F.col("ratio") >= least)
    best = pairs.join(forms, F.col("id2") == F.col("form")).groupBy(F.col("id1").alias("key")).agg(F.max_by(F.struct("of.name", "ratio"), F.struct("ratio", -F.col("of.place"))).alias("best"))
    found = marked.join(best, "key", "left")
    kind = F.when(F.col("first").isNotNull(), "alias").when(F.col("second").isNotNull(), "db_alias").when(F.col("best").isNotNull(), "fuzzy").otherwise("new")
    confidence = F.when(F.col("kind") == "db_alias", 0.95).when(F.col("kind") == "fuzzy", F.col("best.ratio")).otherwise(1.0)
    found = found.withColumn("kind", kind).select("key", F.coalesce("first", "second", "best.name").alias("canonical"), confidence.alias("confidence"), "kind")
    rows = own.join(found, "key", "left")
    return rows.select("id", "name", F.coalesce("canonical", S.title_case(F.trim("name"))).alias("canonical_name"), "confidence", F.col("kind").alias("match_type"))


def match_files(files: DataFrame, items: DataFrame, least: float = 0.6) -> DataFrame:
    """The paper of each stored file: (file_id, path, item_key, matched_by).

    ``files`` has file_id, directory and stem, ``items`` item_key, title and place. A file
    goes to the item whose key is its directory, else to the first item (by place) whose
    title has a Jaccard similarity of words of at least ``least`` with the stem (lower case,
    ``_`` and ``-`` as spaces), else its directory stands for a key. Stems and titles of
    equal words are compared once.
    """
    stem = F.lower(F.translate("stem", "_-", "  "))
    words = lambda name: F.array_sort(word_tokens(name))
    by_key = items.select(F.col("item_key").alias("directory"), F.lit(True).alias("known")).distinct()
    marked = files.join(by_key, "directory", "left")
    marked = marked.withColumn("words", F.when(F.col("known").isNull(), words(stem)))
    titles = items.filter("title is not null").groupBy(words(F.lower("title")).alias("words")).agg(F.min(F.struct("place", "item_key")).alias("item"))
    side = lambda df: df.select(F.col("words").alias("id"), F.lit("").alias("grp"), F.col("words").alias("tokens"))
    pairs = overlap_pairs(side(marked.filter("words is not null").select("words").distinct()), side(titles), least / (1 + least)).withColumnRenamed("id1", "stem_words")
    first = pairs.join(titles, F.col("id2") == F.col("words")).groupBy(F.col("stem_words").alias("words")).agg(F.min("item").alias("item"))
    rows = marked.join(first, "words", "left").withColumn("like", F.col("item.item_key"))
    how = F.when(F.col("known"), "directory").when(F.col("like").isNotNull(), "title").otherwise("none")
    return rows.select("file_id", "directory", F.when(F.col("known"), F.col("directory")).otherwise(F.coalesce("like", "directory")).alias("item_key"), how.alias("matched_by"))


def unit_vectors(vectors: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """(id, keys, size, unit) of vectors at length 1; null and zero vectors and those with null or non-finite components are left out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.filter(fine).select(F.col(id_col).alias("id"), *keys, v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("norm > 0")
    return rows.select("id", *keys, F.size("v").alias("size"), F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def cosine_pairs(vectors: DataFrame, least: float, keys: list[str] = (), id_col: str = "id", pivots: int = PIVOTS, block: int = VECTOR_BLOCK) -> DataFrame:
    """All pairs (id1, id2, similarity) of vectors (id, embedding) of equal length and equal ``keys`` whose cosine is at least ``least``, id1 < id2.

    Equal vectors count once, under their smallest id (``vector_classes`` gives the others).
    Each vector belongs to the nearest of at most ``pivots`` pivots, which are vectors too. If
    two are at most t apart and belong to p and q, the first is at most 2 t farther from q
    than from p: it visits all such pivots before its own, and meets their vectors there in
    blocks. How many are visited follows from the data; no pair is missed whatever they are.
    Under WIDE all would be visited, so vectors meet in blocks without pivots.
    """
    keys, angle = list(keys), math.acos(max(-1.0, min(1.0, least)))
    units = unit_vectors(vectors, keys, id_col)
    one = units.groupBy(*keys, "size", "unit").agg(F.min("id").alias("id"))
    one = durable(one)
    if least < WIDE:
        return unit_pairs_in_blocks(one.select("id", *keys, "size", "unit"), least, keys)
    heads = {}
    for r in one.select("size").distinct().collect():  # lengths of vectors, one or a few
        some = one.filter(F.col("size") == r["size"]).orderBy(F.xxhash64("id"), "id").limit(pivots)
        heads[r["size"]] = np.array([p["unit"] for p in some.select("unit").collect()])
    names = {f.name: f.dataType.simpleString() for f in one.schema.fields}

    def deal(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == size))
                u = rows.column("unit").flatten().to_numpy().reshape(rows.num_rows, size)
                away = np.arccos(np.clip(u @ heads[size].T, -1, 1))
                home = away.argmin(axis=1)
                visits = (away <= away.min(axis=1)[:, None] + 2 * angle + 1e-9) & (np.arange(away.shape[1]) <= home[:, None])
                visits[np.arange(len(home)), home] = True
                row, pivot = np.nonzero(visits)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(at) for c in ("id", *keys, "size", "unit")), pa.array(pivot.astype(np.int32)), pa.array(pivot == home[row])], ["id", *keys, "size", "unit", "pivot", "own"])

    schema = ", ".join(f"{c} {names[c]}" for c in ("id", *keys, "size", "unit")) + ", pivot int, own boolean"
    dealt = durable(one.select("id", *keys, "size", "unit").mapInArrow(deal, schema))
    group = [*keys, "size", "pivot"]
    counts = dealt.groupBy(*group).agg(F.ceil(F.count_if("own") / block).cast("int").alias("n_own"), F.ceil(F.count("*") / block).cast("int").alias("n_all")).filter("n_own > 0")
    dealt = dealt.alias("d").join(counts.alias("c"), [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in group]).select("d.*", "n_own", "n_all")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = dealt.filter("own").withColumn("i", place("n_own")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)))
    right = dealt.withColumn("j", place("n_all")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_own") - 1)))
    right = right.toDF(*right.columns)  # columns of its own beside those of the left
    kind = names["id"]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = [t.column("id").combine_chunks() for t in (a, b)]
        found = np.zeros((0, 2), np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            x, y = (t.column("unit").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (a, b))
            near = x @ y.T
            found = np.argwhere(near >= least), near[near >= least]
        first, second = (i.take(pa.array(found[0][:, k])) for k, i in enumerate(ids))
        return pa.table([first, second, pa.array(found[1]), b.column("own").combine_chunks().take(pa.array(found[0][:, 1]))], ["a", "b", "similarity", "own"])

    meet = [*group, "i", "j"]
    pairs = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInArrow(compare, f"a {kind}, b {kind}, similarity double, own boolean")
    return pairs.filter("a <> b and (not own or a < b)").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), F.least(F.lit(1.0), "similarity").alias("similarity"))


def cosine_pairs_in_blocks(vectors: DataFrame, least: float, keys: list[str] = (), id_col: str = "id") -> DataFrame:
    """All pairs (id1, id2, similarity) of vectors (id, embedding) of equal length and equal ``keys`` whose cosine is at least ``least``, id1 < id2, copies among them.

    For thresholds at which pivots keep nothing apart. Each vector meets those of its own
    block and of every other one; a group has at most BLOCKS blocks until these would pass
    MOST_BLOCK vectors, so what is shuffled grows with the vectors. Null keys are equal.
    """
    keys = list(keys)
    return unit_pairs_in_blocks(unit_vectors(vectors, keys, id_col), least, keys)


def unit_pairs_in_blocks(units: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """``cosine_pairs_in_blocks`` of ``unit_vectors``."""
    group = [*keys, "size"]
    blocks = F.greatest(F.ceil(F.count("*") / MOST_BLOCK), F.least(F.lit(BLOCKS), F.ceil(F.count("*") / VECTOR_BLOCK))).cast("int")
    counts = units.groupBy(*group).agg(blocks.alias("blocks"))
    dealt = units.alias("u").join(counts.alias("c"), [F.col(f"u.{c}").eqNullSafe(F.col(f"c.{c}")) for c in group]).select("u.*", "blocks").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*group, "id", "unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    id_type = dealt.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        own, i, j = t.column("own").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        unit = np.concatenate([np.asarray(c.flatten()) for c in t.column("unit").chunks]).reshape(t.num_rows, -1)
        a, b, ids = np.flatnonzero(own == i), np.flatnonzero(own == j), t.column("id").combine_chunks()
        for x in range(0, len(a), VECTOR_BLOCK):
            for y in range(x if i == j else 0, len(b), VECTOR_BLOCK):
                left, right = a[x : x + VECTOR_BLOCK], b[y : y + VECTOR_BLOCK]
                near = unit[left] @ unit[right].T
                if i == j and x == y:
                    near[np.tril_indices(len(left))] = -2
                p, q = np.nonzero(near >= least)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left[p])), ids.take(pa.array(right[q])), pa.array(near[p, q])], ["a", "b", "similarity"])

    pairs = dealt.groupBy(*group, "i", "j").applyInArrow(compare, f"a {id_type}, b {id_type}, similarity double")
    return pairs.filter("a <> b").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), F.least(F.lit(1.0), "similarity").alias("similarity"))


def vector_classes(vectors: DataFrame, keys: list[str] = (), id_col: str = "id") -> DataFrame:
    """Membership of vectors of one direction: (id, rep), rep the smallest id of those with equal unit vectors and ``keys``."""
    units = unit_vectors(vectors, list(keys), id_col)
    reps = units.groupBy(*keys, "size", "unit").agg(F.min("id").alias("rep"))
    return units.alias("u").join(reps.alias("r"), [F.col(f"u.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "size", "unit")]).select(F.col("u.id").alias("id"), "rep")
