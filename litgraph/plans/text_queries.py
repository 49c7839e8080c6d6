"""Registered queries of texts and keyword rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import texts as T
from .registry import query

#: Headers that the documents get, one before each line (fixed values).
HEADS = ["Introduction", "2. Background", "Methods", "Table 1.", "", "Results and Discussion", "References"]
WHITE = r"'^\s+|\s+$', '', 'g'"
LINES_SQL = f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: list_extract([{', '.join(repr(h) for h in HEADS)}], (i - 1) % 7 + 1) || chr(10) || l), chr(10)) AS text FROM documents"
KIND_SQL = "CASE WHEN length(bare) < 3 OR length(bare) > 100 THEN NULL " + " ".join(f"WHEN regexp_matches(bare, '(?i){'|'.join(p)}') THEN '{k}'" for k, p in T.SECTION_HEADERS.items()) + " END"
SECTIONS_SQL = f"""
WITH t AS ({LINES_SQL}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM t WHERE text IS NOT NULL),
b AS (SELECT *, regexp_replace(line, {WHITE}) AS bare FROM l), k AS (SELECT *, {KIND_SQL} AS kind FROM b),
s AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY i) AS section, max(i) OVER (PARTITION BY doc_id) AS last FROM k)
SELECT doc_id, CAST(section - 1 AS INT) AS place, max(kind) AS section_type, max(bare) FILTER (kind IS NOT NULL) AS title, coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (kind IS NULL), {WHITE}), '') AS content,
CAST(min(i) AS INT) AS start_line, CAST(max(i) AS INT) AS end_line FROM s WHERE section > 0 GROUP BY doc_id, section HAVING min(i) < max(last)
"""


def headed(g):
    """Documents with a header before each of their lines."""
    heads = F.array(*map(F.lit, HEADS))
    lines = T.once(heads, lambda h: F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.get(h, i % len(HEADS)), F.lit("\n"), line)))
    return g.table("documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query(SECTIONS_SQL, views=False)
def m1_split_sections(g):
    return T.split_sections(headed(g))


@query()
def m2_hierarchical_chunks(g):
    return T.hierarchical_chunks(T.split_sections(headed(g)), 60, 20, 10)


@query()
def m3_overlapping_segments(g):
    return g.table("documents").select("doc_id", F.posexplode(T.overlapping_segments(F.col("text"), 600, 50)).alias("place", "segment"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM ({LINES_SQL})), b AS (SELECT doc_id, regexp_replace(line, {WHITE}) AS bare FROM l), k AS (SELECT {KIND_SQL} AS kind FROM b) SELECT kind, count(*) AS n FROM k GROUP BY 1", views=False)
def s17_section_type(g):
    return headed(g).select(F.explode(F.split("text", "\n")).alias("line")).groupBy(T.section_type(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


#: How questions begin (fixed values).
OPENINGS = ["Compare ", "What is ", "Method of ", "Which limitation has ", "Gap and context of ", "Hello", "Patents, impact, "]
ASKED_SQL = f"SELECT conv_id, turn, list_extract([{', '.join(repr(o) for o in OPENINGS)}], CAST(turn % 7 + 1 AS INT)) || CASE WHEN turn % 7 = 5 THEN '' ELSE text END AS question FROM conversations"


def asked(g):
    opening = F.get(F.array(*map(F.lit, OPENINGS)), (F.col("turn") % len(OPENINGS)).cast("int"))
    return g.table("conversations").select("conv_id", "turn", F.concat(opening, F.when(F.col("turn") % len(OPENINGS) == 5, "").otherwise(F.col("text"))).alias("question"))


def words_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


ASKED_SECTIONS_SQL = ", ".join(f"CASE WHEN {words_sql('lower(question)', words)} THEN '{name}' END" for name, words in T.SECTION_WORDS.items())
INTENT_SQL = "CASE WHEN length(q) < 3 OR q IN ({}) THEN 'conversational' ".format(", ".join("'" + w.replace("'", "''") + "'" for w in T.GREETINGS)) + " ".join(f"WHEN {words_sql('q', words)} THEN '{name}'" for name, words in T.INTENT_WORDS.items()) + " ELSE 'search' END"


@query(f"WITH a AS ({ASKED_SQL}), s AS (SELECT conv_id, turn, concat_ws(',', {ASKED_SECTIONS_SQL}) AS s FROM a) SELECT conv_id, turn, CASE WHEN s = '' THEN '{','.join(T.ALL_SECTIONS)}' ELSE s END AS sections FROM s", views=False)
def s20_suggest_sections(g):
    return asked(g).select("conv_id", "turn", F.array_join(T.suggest_sections(F.col("question")), ",").alias("sections"))


@query(f"WITH a AS (SELECT conv_id, turn, trim(lower(question)) AS q FROM ({ASKED_SQL})), i AS (SELECT conv_id, turn, {INTENT_SQL} AS intent FROM a) SELECT *, CASE intent WHEN 'conversational' THEN 0.95 WHEN 'search' THEN 0.6 ELSE 0.75 END::DOUBLE AS confidence FROM i", views=False)
def s21_keyword_intent(g):
    return asked(g).select("conv_id", "turn", T.keyword_intent(F.col("question")).alias("a")).select("conv_id", "turn", "a.*")


#: A homonym and words beside it for each type of part (fixed values).
BESIDE = {"ECONOMY": ("sat", "a solver with each clause"), "PROMO": ("sat", "the exam of a college student"), "LARGE": ("transformer", "voltage of the coil"), "MEDIUM": ("transformer", "encoder, token"), "SMALL": ("sat", "nothing")}


@query("WITH b(t, name, words) AS (VALUES {}) SELECT p_partkey, CASE b.name || ':' || b.words {} END AS bucket FROM part LEFT JOIN b ON t = p_type".format(
    ", ".join(f"('{t}', '{n}', '{w}')" for t, (n, w) in BESIDE.items()),
    " ".join(f"WHEN '{BESIDE[t][0]}:{BESIDE[t][1]}' THEN '{s}'" for t, s in (("ECONOMY", "logic"), ("PROMO", "education"), ("LARGE", "electrical"), ("MEDIUM", "deep_learning"), ("SMALL", "generic")))), views=False)
def s13_context_bucket(g):
    pick = lambda i: F.coalesce(*(F.when(F.col("p_type") == t, F.lit(v[i])) for t, v in BESIDE.items()))
    return g.table("part").select("p_partkey", T.context_bucket(F.coalesce(pick(0), F.lit("graph")), F.concat_ws(" ", "p_name", pick(1))).alias("bucket"))


@query("WITH r AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '0123abcd-0123-4000' END AS bridge, CASE WHEN p_size % 2 = 0 THEN p_type END AS a, p_brand AS b FROM part) SELECT p_partkey, CASE WHEN bridge IS NOT NULL AND bridge NOT LIKE '0123%' THEN bridge WHEN a IS NOT NULL THEN a || ' ' || b ELSE b END AS search FROM r", views=False)
def s22_recommendation_query(g):
    bridge = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.lit("0123abcd-0123-4000"))
    a = F.when(F.col("p_size") % 2 == 0, F.array("p_type", F.lit(" ")))
    return g.table("part").select("p_partkey", T.recommendation_query(F.array_compact(F.array(bridge)), a, F.array("p_brand")).alias("search"))
