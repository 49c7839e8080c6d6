"""Bibliographies exported as RDF/XML: items and their attachments, cut out of each document in one pass and read by Spark's XML functions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: Element names of bibliographic items (fixed values).
ITEM_TYPES = ("Article", "Book", "BookSection", "ConferencePaper", "JournalArticle", "Report", "Thesis", "Document")
PERSONS = "struct<`rdf:Seq`: struct<`rdf:li`: array<struct<`foaf:Person`: struct<`foaf:surname`: string, `foaf:givenName`: string>>>>>"
RESOURCE = "struct<`_rdf:resource`: string>"
ITEM = f"""`_rdf:about` string, `dc:title` string, `dcterms:abstract` string, `bib:authors` {PERSONS}, `bib:editors` {PERSONS}, `dc:date` string,
    `dc:identifier` string, `dcterms:identifier` array<string>, `dcterms:isPartOf` struct<`bib:Journal`: struct<`dc:title`: string>>, `prism:volume` string,
    `prism:number` string, `bib:pages` string, `dc:subject` array<string>, `link:link` array<{RESOURCE}>"""
ATTACHMENT = f"`_rdf:about` string, `rdf:resource` {RESOURCE}"
#: Bytes of a document that a task holds whole; longer ones are streamed by Spark's XML source, once for each element name.
LARGEST = 64 << 20
DOI = r"10\.\d{4,}/[^\s]+"


def tag(name: str) -> Column:
    return F.col(f"`{name}`")


def of_key(about: Column) -> Column:
    """What stands after the last ``#``."""
    return F.substring_index(about, "#", -1)


def names(persons: Column) -> Column:
    """``Surname, Given`` of persons with a surname; the given name may be missing."""
    listed = F.filter(persons["rdf:Seq"]["rdf:li"], lambda p: p["foaf:Person"]["foaf:surname"].isNotNull())
    return F.coalesce(F.transform(listed, lambda p: F.concat_ws(", ", p["foaf:Person"]["foaf:surname"], F.nullif(p["foaf:Person"]["foaf:givenName"], F.lit("")))), F.array().cast("array<string>"))


def found(text: Column, pattern: str) -> Column:
    """The first match of a pattern, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def read_tag(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", name).option("recursiveFileLookup", "true").schema(schema).load(path)


def cut_items(document: bytes) -> list[tuple[str, str, list[str]]]:
    """(item type, its XML, PDFs of the attachments that its links name) of every item with content, at any depth but not inside one of its own type.

    What stands before an error of the document counts.
    """
    from xml.parsers import expat

    tags, within = {f"bib:{t}": t for t in ITEM_TYPES} | {"z:Attachment": ""}, {"link:link", "rdf:resource"}
    text = document.decode("utf-8", "replace").removeprefix("\ufeff").encode()
    parser, stack, depth, items, files = expat.ParserCreate("utf-8"), [], 0, [], {}

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth
        depth += 1
        if name in tags:
            if all(name != s[0] for s in stack):
                stack.append((name, depth, parser.CurrentByteIndex, attributes.get("rdf:about"), []))
        elif name in within and stack and depth == stack[-1][1] + 1 and (name == "rdf:resource") == (stack[-1][0] == "z:Attachment"):
            stack[-1][4].append(attributes.get("rdf:resource"))

    def end(name: str) -> None:
        nonlocal depth
        if name in tags and stack and depth == stack[-1][1]:
            _, _, first, about, named = stack.pop()
            if tags[name]:
                last = parser.CurrentByteIndex  # of the closing tag; of the whole tag if nothing is in it
                if last > first:
                    items.append((tags[name], first, text.index(b">", last) + 1, named))
            elif about is not None and named and ".pdf" in (named[-1] or "").lower():
                files.setdefault(about, []).append(named[-1])
        depth -= 1

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(text, True)
    except expat.ExpatError:
        pass
    return [(kind, text[first:last].decode(), sorted({f for link in named for f in files.get(link, ())})) for kind, first, last, named in items]


def cut_documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of documents (content), at most a document's in a batch."""
    import pyarrow as pa

    schema = pa.schema([("item_type", pa.string()), ("item", pa.string()), ("held", pa.list_(pa.string()))])
    for batch in batches:
        for content in batch.column("content"):
            found = cut_items(content.as_py())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), schema.types, strict=True)], schema=schema)


def short_documents(files: DataFrame) -> DataFrame:
    """Items of documents (content) as columns of their elements, with item_type and held."""
    rows = files.select("content").mapInArrow(cut_documents, "item_type string, item string, held array<string>")
    # a generator, so that no item is parsed again for a filter or a column
    return rows.select("item_type", "held", F.explode(F.array(F.from_xml("item", ITEM))).alias("x")).select("item_type", "held", "x.*")


def read_bibliography(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """A row for each item with a title in the RDF/XML files of ``path`` and the folders in it; each file is one document.

    (item_key, item_type, title, abstract, authors array, year int, doi, url, journal,
    volume, issue, pages, tags array, pdf_paths array). The key is what stands after ``#`` in
    ``rdf:about``; an item without one gets the first eight hexadecimal digits of a digest of
    its type, title, identifier and date, so that reading again gives it again. Authors go before
    editors. PDFs are the links that name one, and the files of attachments that links refer
    to: the one is in the item, the other found by the attachment's name in the same document.
    Documents of more than ``largest`` bytes are not held whole but streamed, with the same rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    items = columns(short_documents(files.filter(f"_metadata.file_size <= {largest}")), "held")
    if not files.filter(f"_metadata.file_size > {largest}").select("length").isEmpty():
        items = items.unionByName(long_documents(spark, path, largest))
    none = F.array().cast("array<string>")
    return items.withColumn("pdf_paths", F.array_distinct(F.concat("own", F.coalesce("held", none)))).drop("own", "held")


def long_documents(spark: SparkSession, path: str, largest: int) -> DataFrame:
    """``columns`` of the items of documents of more than ``largest`` bytes, with own and held."""
    streamed = lambda name, schema: read_tag(spark, path, name, schema).withColumn("_file", F.col("_metadata.file_path")).filter(f"_metadata.file_size > {largest}")
    kinds = [streamed(f"bib:{t}", ITEM).withColumn("item_type", F.lit(t)) for t in ITEM_TYPES]
    items = columns(reduce(DataFrame.unionAll, kinds), "_file", "links")
    files = streamed("z:Attachment", ATTACHMENT).select("_file", tag("_rdf:about").alias("link"), tag("rdf:resource")["_rdf:resource"].alias("path")).filter("link is not null and lower(path) like '%.pdf%'")
    # items of equal keys differ in their links, so each set of links has its files
    keys = ["_file", "links"]
    held = items.select(*keys).distinct().withColumn("link", F.explode(F.array_distinct("links"))).join(files, ["_file", "link"]).groupBy(*keys).agg(F.array_sort(F.collect_set("path")).alias("held"))
    return items.join(held, keys, "left").drop(*keys)


def columns(rows: DataFrame, *beside: str) -> DataFrame:
    """The columns of ``read_bibliography`` but pdf_paths, with the item's own PDFs (own) and those ``beside``, from items as columns of their elements; those without a title go."""
    rows = rows.filter("`dc:title` is not null and `dc:title` <> ''")
    about, ident = tag("_rdf:about"), tag("dc:identifier")
    digest = F.substring(F.sha2(F.concat_ws("|", "item_type", tag("dc:title"), ident, tag("dc:date")), 256), 1, 8)
    more = F.array_compact(F.transform(F.filter(tag("dcterms:identifier"), lambda i: F.contains(i, F.lit("10."))), lambda i: found(i, DOI)))
    first_doi = F.when(F.contains(F.lower(ident), F.lit("doi")), found(ident, DOI))
    links = F.coalesce(F.transform("`link:link`", lambda l: l["_rdf:resource"]), F.array().cast("array<string>"))
    return rows.withColumn("links", links).select(
        F.when(F.contains(about, F.lit("#")), of_key(about)).otherwise(digest).alias("item_key"),
        "item_type",
        F.trim(tag("dc:title")).alias("title"),
        F.trim(tag("dcterms:abstract")).alias("abstract"),
        F.concat(names(tag("bib:authors")), names(tag("bib:editors"))).alias("authors"),
        found(tag("dc:date"), r"\d{4}").cast("int").alias("year"),
        F.coalesce(F.get(more, F.lit(0)), first_doi).alias("doi"),
        F.when(ident.startswith("http"), ident).alias("url"),
        tag("dcterms:isPartOf")["bib:Journal"]["dc:title"].alias("journal"),
        tag("prism:volume").alias("volume"), tag("prism:number").alias("issue"), tag("bib:pages").alias("pages"),
        F.coalesce(F.transform("`dc:subject`", lambda s: F.trim(s)), F.array().cast("array<string>")).alias("tags"),
        F.filter("links", lambda l: F.contains(F.lower(l), F.lit(".pdf"))).alias("own"),
        *beside,
    )
