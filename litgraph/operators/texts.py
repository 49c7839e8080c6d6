"""Texts to sections, chunks and segments, and keyword rules over names and questions.

Texts stay in their row: nothing here shuffles, and a text is never gathered from parts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First lines of sections, tried in this order without regard to case (fixed values).
SECTION_HEADERS = {
    "abstract": [r"^abstract\s*$", r"^summary\s*$"],
    "introduction": [r"^1\.?\s*introduction", r"^introduction\s*$", r"^i\.?\s*introduction"],
    "background": [r"^2\.?\s*background", r"^background\s*$", r"^theoretical\s+background", r"^related\s+work"],
    "literature_review": [r"^literature\s+review", r"^review\s+of\s+literature", r"^prior\s+work"],
    "methodology": [r"^\d+\.?\s*method", r"^method(s|ology)?\s*$", r"^research\s+method", r"^materials?\s+and\s+methods?", r"^experimental\s+(design|setup|method)", r"^\d+\.?\s*materials?\s+and\s+method"],
    "results": [r"^\d+\.?\s*results?", r"^results?\s*$", r"^findings?\s*$", r"^results?\s+and\s+discussion"],
    "discussion": [r"^\d+\.?\s*discussion", r"^discussion\s*$", r"^analysis\s*$", r"^general\s+discussion"],
    "conclusion": [r"^\d+\.?\s*conclusion", r"^conclusion(s)?\s*$", r"^concluding\s+remarks", r"^summary\s+and\s+conclusion", r"^summary\s*$"],
    "references": [r"^references?\s*$", r"^bibliography\s*$", r"^works?\s+cited"],
    "appendix": [r"^appendix", r"^appendices", r"^supplementary"],
    "acknowledgments": [r"^acknowledgment", r"^acknowledgement"],
    "table": [r"^table\s+\d+[.:]", r"^table\s+\d+\s*$"],
}
#: Words of a question that ask for a section, in the order of the answer (fixed values).
SECTION_WORDS = {
    "methodology": ["method", "approach", "technique", "how did", "procedure", "data collection", "sample", "participants", "instrument"],
    "results": ["finding", "result", "outcome", "effect", "impact", "significant", "correlation", "difference", "showed"],
    "discussion": ["implication", "limitation", "future", "suggest", "conclude", "recommendation", "contribution"],
    "introduction": ["background", "context", "purpose", "objective", "research question", "gap", "motivation"],
}
#: Sections of a question that names none (fixed values).
ALL_SECTIONS = ["introduction", "methodology", "results", "discussion"]
#: Questions that are greetings (fixed values).
GREETINGS = ["hello", "hi", "hey", "good morning", "good afternoon", "good evening", "thanks", "thank you", "bye", "goodbye", "how are you", "what's up", "nice to meet"]
#: Words of each intent, tried in this order (fixed values).
INTENT_WORDS = {
    "patent_search": ["patent", "patents", "filing", "prior art", "claims"],
    "inventor_lookup": ["inventor", "invented", "who created", "who developed"],
    "technology_trend": ["technology trend", "tech area", "most patented", "technology distribution"],
    "license_status": ["license", "licensed", "licensing", "commercialize"],
    "compare": ["compare", "versus", "vs", "difference"],
    "explain": ["explain", "what is", "define", "meaning"],
    "identify_gaps": ["gap", "missing", "underresearched"],
    "summarize": ["summarize", "summary", "overview"],
    "explore": ["show", "connected", "related", "relationship"],
}
#: Words around a homonym that tell its senses apart (fixed values).
HOMONYMS = {
    "sat": {
        "logic": ["boolean", "satisfiability", "cnf", "solver", "constraint", "propositional", "clause"],
        "education": ["scholastic", "aptitude", "student", "exam", "test score", "college", "assessment"],
        "attention": ["self attention", "attention mechanism", "transformer", "token", "sequence model"],
    },
    "transformer": {
        "deep_learning": ["neural", "language model", "self attention", "token", "encoder", "decoder", "vision transformer", "embedding"],
        "electrical": ["voltage", "current", "power grid", "electrical", "winding", "coil"],
    },
}
#: Start of a generated id (fixed value).
GENERATED_ID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def any_of(text: Column, words: list[str]) -> Column:
    """Whether ``text`` holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def section_type(line: Column) -> Column:
    """The section that a line of 3 to 100 characters opens, or null."""
    bare = strip(line)
    kind = F.lit(None).cast("string")
    for name, patterns in reversed(SECTION_HEADERS.items()):
        kind = F.when(bare.rlike("(?i)" + "|".join(patterns)), name).otherwise(kind)
    return F.when(F.length(bare).between(3, 100), kind)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often and in whatever loop it is used: the optimizer would write it out in each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each section: (id, place from 0, section_type, title, content, start_line, end_line).

    What stands before the first header goes, and so does a header in the last line. A text
    without sections is one section ``unknown``; a blank or null text has none.
    """

    def between(lines: Column, kinds: Column, heads: Column) -> Column:
        def section(head: Column, i: Column) -> Column:
            after = F.coalesce(F.get(heads, i + 1), F.size(lines))
            body = F.array_join(F.slice(lines, head + 2, after - head - 1), "\n")
            return F.struct(F.get(kinds, head).alias("section_type"), strip(F.get(lines, head)).alias("title"), strip(body).alias("content"), head.alias("start_line"), (after - 1).alias("end_line"))

        return F.transform(F.filter(heads, lambda h: h < F.size(lines) - 1), section)

    def sections(lines: Column) -> Column:
        heads = lambda kinds: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(kinds, i).isNotNull())
        found = once(F.transform(lines, section_type), lambda kinds: once(heads(kinds), lambda h: between(lines, kinds, h)))
        bare = strip(F.array_join(lines, "\n"))
        whole = F.struct(F.lit("unknown").alias("section_type"), F.lit("").alias("title"), bare.alias("content"), F.lit(0).alias("start_line"), (F.size(lines) - 1).alias("end_line"))
        return once(found, lambda f: F.when(F.size(f) > 0, f).when(bare != "", F.array(whole)))

    texts = docs.filter(F.col(text_col).isNotNull())
    return texts.select(id_col, F.posexplode(once(F.split(text_col, "\n"), sections)).alias("place", "_s")).select(id_col, "place", "_s.*")


def packed(tokens: Column, target: int, overlap: int, least: int) -> Column:
    """Runs of paragraphs, from their token counts: a run ends before it would pass ``target``.

    The next run repeats the last paragraph if that has at most ``overlap`` tokens; a last
    run under ``least`` goes. Only counts go to Python, texts stay in the JVM.
    """

    @F.arrow_udf("array<struct<first:int,last:int,tokens:bigint>>")
    def runs(counts: pa.Array) -> pa.Array:
        out = []
        for row in counts.to_pylist():
            found, first, held = [], 0, 0
            for i, n in enumerate(row or ()):
                if first < i and held + n > target:
                    found.append((first, i - 1, held))
                    first, held = (i - 1, row[i - 1]) if row[i - 1] <= overlap else (i, 0)
                held += n
            if row and held >= least:
                found.append((first, len(row) - 1, held))
            out.append([dict(zip(("first", "last", "tokens"), f, strict=True)) for f in found])
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("tokens", pa.int64())])))

    return runs(tokens)


def hierarchical_chunks(sections: DataFrame, target: int = 400, overlap: int = 50, least: int = 100, text_col: str = "content") -> DataFrame:
    """Each section as a parent (level 0) and as runs of its paragraphs (level 1), in order: adds level, sequence_order, chunk, tokens.

    A token is four characters. Blank lines part paragraphs.
    """
    tokens = lambda text: F.floor(F.length(text) / 4)
    paragraphs = F.filter(F.transform(F.split(text_col, r"\n\s*\n"), strip), lambda p: p != "")
    rows = sections.withColumn("_p", paragraphs).withColumn("_runs", packed(F.transform("_p", tokens), target, overlap, least))
    chunk = lambda level, text, n: F.struct(F.lit(level).alias("level"), text.alias("chunk"), n.cast("long").alias("tokens"))
    joined = lambda p, r: F.array_join(F.slice(p, r["first"] + 1, r["last"] - r["first"] + 1), "\n\n")
    children = once(F.col("_p"), lambda p: F.transform("_runs", lambda r: chunk(1, joined(p, r), r["tokens"])))
    every = F.concat(F.array(chunk(0, F.col(text_col), tokens(F.col(text_col)))), children)
    return rows.select(*sections.columns, F.posexplode(every).alias("sequence_order", "_c")).select(*sections.columns, "sequence_order", "_c.*")


def overlapping_segments(text: Column, size: int = 4000, overlap: int = 200) -> Column:
    """Segments of at most ``size`` characters that share ``overlap`` with the next; a segment ends after a sentence that ends in its last 200."""
    reach = 200
    if size <= overlap + reach:
        raise ValueError(f"segments of {size} characters are too short for an overlap of {overlap}")

    @F.arrow_udf("array<string>")
    def segments(texts: pa.Array) -> pa.Array:
        def cut(t: str) -> list[str]:
            out, start = [], 0
            while True:
                end = min(start + size, len(t))
                if end < len(t):
                    stop = max(t.rfind(mark, end - reach, end) for mark in (". ", "? ", "! "))
                    end = stop + 2 if stop > end - reach else end
                out.append(t[start:end])
                if end - overlap >= len(t) - overlap or len(t) <= size:
                    return out
                start = end - overlap

        return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return segments(text)


def suggest_sections(question: Column) -> Column:
    """Sections that the words of a question ask for, else the four main ones."""
    q = F.lower(question)
    asked = F.array_compact(F.array(*(F.when(any_of(q, words), name) for name, words in SECTION_WORDS.items())))
    return F.when(F.size(asked) > 0, asked).otherwise(F.array(*map(F.lit, ALL_SECTIONS)))


def keyword_intent(question: Column) -> Column:
    """(intent, confidence) of a question: greetings and questions of under three characters first, then the first list with a word in it."""
    q = F.trim(F.lower(question))
    answer = lambda name, sure: F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"))
    out = F.when((F.length(q) < 3) | q.isin(*GREETINGS), answer("conversational", 0.95))
    for name, words in INTENT_WORDS.items():
        out = out.when(any_of(q, words), answer(name, 0.75))
    return out.otherwise(answer("search", 0.6))


def context_bucket(name: Column, text: Column, rules: dict[str, dict[str, list[str]]] = HOMONYMS) -> Column:
    """The sense of a homonym with most of its words in ``text`` (the first of several), ``generic`` without any; null for other names."""
    q, out = F.lower(text), F.lit(None).cast("string")
    for homonym, senses in rules.items():
        best, most = F.lit("generic"), F.lit(0)
        for sense, words in senses.items():
            votes = sum((F.contains(q, F.lit(w)).cast("int") for w in words), F.lit(0))
            best, most = F.when(votes > most, sense).otherwise(best), F.greatest(votes, most)
        out = F.when(name == homonym, best).otherwise(out)
    return out


def recommendation_query(bridges: Column, names_a: Column, names_b: Column) -> Column:
    """Search words for a gap: the real names among the first three bridges, else one name of each side, else what one side has, else nothing."""
    named = lambda names, k: F.filter(F.transform(F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, k), lambda n: F.trim(n)), lambda n: n != "")
    known = F.filter(named(bridges, 3), lambda n: ~n.rlike(GENERATED_ID))
    a, b = named(names_a, 2), named(names_b, 2)
    pair = F.concat_ws(" ", F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    return F.when(F.size(known) > 0, F.array_join(known, " ")).when((F.size(a) > 0) & (F.size(b) > 0), pair).otherwise(F.array_join(F.concat(a, b), " "))
