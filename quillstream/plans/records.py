"""Queries over citation records in XML, and over files, with their SQL where there is one.

The records are written as XML from the rows of refs and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import xml as X
from quillstream.plans.sql import CUR, LAST, words
from quillstream.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _escape(c):
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _el(tag: str, c, attributes: str = ""):
    return F.concat(F.lit(f"<{tag}{attributes}>"), _escape(c), F.lit(f"</{tag}>"))


def _each(array, make):
    return F.array_join(F.transform(F.coalesce(array, F.array().cast("array<string>")), make), "")


def xml_of(refs: DataFrame) -> DataFrame:
    """ref_id and a citation record in XML, with a document type, inline markup, a collective author and nested references."""
    last = lambda a: F.when(a["author"].rlike("^.+ [^ ]+$"), F.regexp_extract(a["author"], "^(.+) ([^ ]+)$", 1)).otherwise(a["author"])
    first = lambda a: F.when(a["author"].rlike("^.+ [^ ]+$"), F.regexp_extract(a["author"], "^(.+) ([^ ]+)$", 2)).otherwise("")
    units = lambda a: _each(a["affiliation"], lambda t: F.concat(F.lit("<AffiliationInfo>"), _el("Affiliation", t), F.lit("</AffiliationInfo>")))
    people = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<struct<author:string,affiliation:array<string>>>")), lambda a: F.concat(F.lit("<Author>"), _el("LastName", last(a)), _el("Initials", first(a)), units(a), F.lit("</Author>"))), "")
    raw_doi = F.regexp_replace(F.coalesce("doi", F.lit("")), "^https://doi.org/", "")
    by_list = F.col("ref_id") % 3 == 0
    body = F.concat(
        F.lit('<?xml version="1.0"?><!DOCTYPE PubmedArticleSet PUBLIC "x" "https://example.org/none.dtd"><PubmedArticleSet><PubmedArticle><MedlineCitation>'),
        _el("PMID", F.concat(F.lit("0"), F.coalesce("pmid", F.lit("")))),
        F.lit("<Article><Journal>"), _el("ISOAbbreviation", F.col("journal")), F.lit("<JournalIssue>"), _el("Volume", F.col("volume")), _el("Issue", F.col("issue")),
        F.lit("<PubDate>"), _el("Year", F.col("year")), F.lit("</PubDate></JournalIssue></Journal>"),
        F.lit("<ArticleTitle>"), F.regexp_replace(_escape(F.col("title")), "^([A-Za-z]+) ", "<i>$1</i> "), F.lit("</ArticleTitle>"),
        F.lit("<Pagination>"), _el("MedlinePgn", F.col("pages")), F.lit("</Pagination>"),
        F.when(~by_list, F.concat(_el("ELocationID", F.lit("10.0/first"), ' EIdType="doi"'), _el("ELocationID", raw_doi, ' EIdType="doi"'))).otherwise(""),
        F.lit("<Abstract>"), _el("AbstractText", F.col("abstract"), ' Label="AIM"'), _el("AbstractText", F.lit("End.")), F.lit("</Abstract>"),
        F.lit("<AuthorList>"), people, F.lit("<Author><CollectiveName>The group</CollectiveName></Author></AuthorList>"),
        F.lit("<PublicationTypeList>"), _each("publication_types", lambda t: _el("PublicationType", t)), F.lit("</PublicationTypeList></Article>"),
        F.lit("<KeywordList>"), _each("keywords", lambda k: _el("Keyword", k)), F.lit("</KeywordList><KeywordList><Keyword>second list</Keyword></KeywordList></MedlineCitation><PubmedData>"),
        F.lit("<ArticleIdList>"), _el("ArticleId", F.col("pmid"), ' IdType="pubmed"'), F.when(by_list, _el("ArticleId", raw_doi, ' IdType="doi"')).otherwise(""), F.lit("</ArticleIdList><ReferenceList><ReferenceList>"),
        _each("reference_pmids", lambda p: F.concat(F.lit("<Reference><ArticleIdList>"), _el("ArticleId", p, ' IdType="pubmed"'), _el("ArticleId", p, ' IdType="pubmed"'), F.lit("</ArticleIdList></Reference>"))),
        F.lit("</ReferenceList></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>"),
    )
    return refs.select("ref_id", body.alias("xml"))


def _projected(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return X.project(xml_of(table(spark, d, "refs")), "ref_id", fields=fields)


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("SELECT ref_id, true AS valid FROM refs UNION ALL SELECT -1 - ref_id, false FROM refs")
def src_xml_records(spark, d):
    """Which texts are citation records: every record, and every record broken off before its end."""
    whole = xml_of(table(spark, d, "refs"))
    broken = whole.select((-1 - F.col("ref_id")).alias("ref_id"), F.left("xml", F.length("xml") - 30).alias("xml"))
    return X.project(whole.unionAll(broken), "ref_id", fields=()).select("ref_id", "valid")


@query(f"""SELECT ref_id, coalesce(pmid, '') AS pmid, coalesce(journal, '') AS journal, coalesce(year, '') AS year, coalesce(volume, '') AS volume, coalesce(issue, '') AS issue, coalesce(pages, '') AS pages FROM refs WHERE pmid <> ''""")
def xml_project(spark, d):
    """Scalar fields of valid records."""
    return _projected(spark, d, "pmid", "journal", "year", "volume", "issue", "pages").where("valid and pmid <> '0'").select("ref_id", "pmid", "journal", "year", "volume", "issue", "pages")


@query(f"SELECT ref_id, {_TRIM.format('coalesce(title, ' + chr(39) * 2 + ')')} AS title FROM refs")
def xml_mixed_text(spark, d):
    """Titles with markup flattened."""
    return _projected(spark, d, "title").where("valid").select("ref_id", "title")


@query(f"SELECT ref_id, CASE WHEN coalesce(doi, '') = '' THEN '' ELSE 'https://doi.org/' || regexp_replace(doi, '^https://doi.org/', '') END AS doi FROM refs")
def doi_fallback(spark, d):
    """The last doi of the article, or of the id list."""
    return _projected(spark, d, "doi").where("valid").select("ref_id", "doi")


@query(f"""WITH a AS (SELECT ref_id, list_filter(coalesce(authors, []), lambda a: coalesce(a.author, '') <> '') AS l FROM refs)
SELECT ref_id, CAST(len(l) AS BIGINT) AS n, coalesce(array_to_string(list_transform(l, lambda a: trim(a.author) || '=' || coalesce(array_to_string(list_filter(a.affiliation, lambda f: coalesce(f, '') <> ''), ';'), '')), '|'), '') AS authors FROM a""")
def xml_authors(spark, d):
    """Authors with their affiliations; collective names are dropped."""
    rows = _projected(spark, d, "authors").where("valid")
    one = F.transform("authors", lambda a: F.concat(a["author"], F.lit("="), F.array_join(a["affiliation"], ";")))
    return rows.select("ref_id", F.size("authors").cast("long").alias("n"), F.array_join(one, "|").alias("authors"))


@query(f"SELECT ref_id, 'AIM: ' || {_TRIM.format('coalesce(abstract, ' + chr(39) * 2 + ')')} || ' End.' AS abstract FROM refs")
def xml_abstract(spark, d):
    """Labelled parts of the abstract."""
    return _projected(spark, d, "abstract").where("valid").select("ref_id", "abstract")


@query(f"SELECT ref_id, coalesce(array_to_string(list_transform(list_filter(keywords, lambda k: coalesce(k, '') <> ''), lambda k: {_TRIM.format('k')}), '|'), '') AS keywords FROM refs")
def xml_keywords(spark, d):
    """Keywords of the first list."""
    return _projected(spark, d, "keywords").where("valid").select("ref_id", F.array_join("keywords", "|").alias("keywords"))


@query(f"""WITH e AS (SELECT ref_id, generate_subscripts(reference_pmids, 1) AS i, unnest(reference_pmids) AS p FROM refs), f AS (SELECT ref_id, p, min(i) AS i FROM e WHERE p <> '' GROUP BY ref_id, p)
SELECT r.ref_id, coalesce(string_agg(f.p, '|' ORDER BY f.i), '') AS refs FROM (SELECT ref_id FROM refs) r LEFT JOIN f ON r.ref_id = f.ref_id GROUP BY r.ref_id""")
def refs_distinct(spark, d):
    """Reference ids, each once, in order."""
    return _projected(spark, d, "reference_pmids").where("valid").select("ref_id", F.array_join("reference_pmids", "|").alias("refs"))


@query(f"SELECT ref_id, coalesce(array_to_string(list_filter(publication_types, lambda t: coalesce(t, '') <> ''), '|'), '') AS types, coalesce(list_contains(publication_types, 'Journal Article') AND NOT list_contains(publication_types, 'Retracted Publication'), false) AS kept FROM refs")
def xml_valid_types(spark, d):
    """Publication types and whether the record is kept."""
    return _projected(spark, d, "publication_types").where("valid").select("ref_id", F.array_join("publication_types", "|").alias("types"), X.is_kept(F.col("publication_types")).alias("kept"))


@query("SELECT '/papers/' || paper_id || '.pdf' AS path, full_text AS text, CAST(NULL AS VARCHAR) AS error FROM papers WHERE full_text IS NOT NULL")
def pdf_text(spark, d):
    """The texts of all papers read back from PDF files made of them."""
    from quillstream.sources.files import convert_pdfs
    from quillstream.sources.pdf import plain_pdf_text

    shown = F.transform(F.split("full_text", "\n"), lambda x: F.concat(F.lit("<FEFF"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T*")))
    content = F.encode(F.concat(F.lit("%PDF-1.4\n<< >>\nstream\nBT 12 TL\n"), F.array_join(shown, "\n"), F.lit("\nET\nendstream\n")), "UTF-8")
    papers = table(spark, d, "papers").where("full_text is not null")
    return convert_pdfs(papers.select(F.concat(F.lit("/papers/"), "paper_id", F.lit(".pdf")).alias("path"), content.alias("content")), plain_pdf_text)


@query("SELECT path, true AS missing FROM (SELECT DISTINCT '/nowhere/' || ext || '.pdf' AS path FROM papers WHERE ext IS NOT NULL)")
def pdf_scan(spark, d):
    """PDF files that are named but don't exist: reported, and not read."""
    from quillstream.sources.files import missing, read_pdfs

    named = [f"/nowhere/{r.ext}.pdf" for r in table(spark, d, "papers").where("ext is not null").select("ext").distinct().collect()]
    lost = spark.createDataFrame([(p, True) for p in missing(spark, named)], "path string, missing boolean")
    return lost.join(read_pdfs(spark, named).select("path"), "path", "left_anti")


#: Chunks ``c`` (chunk_id, chunk) to the embeddings of the built-in encoder, a row for each dimension that isn't 0.
HASHED = """t AS (SELECT chunk_id, CAST('0x' || left(md5(x), 8) AS BIGINT) AS h FROM (SELECT chunk_id, unnest(string_split(lower(chunk), ' ')) AS x FROM c)),
v AS (SELECT chunk_id, h % 64 AS dim, sum(CASE WHEN (h // 65536) % 2 = 1 THEN 1 ELSE -1 END) AS s FROM t GROUP BY ALL), n AS (SELECT chunk_id, sqrt(sum(s * s)) AS n FROM v GROUP BY 1)
SELECT chunk_id, CAST(dim AS INTEGER) AS dim, round(CAST(CAST(s / n AS FLOAT) AS DOUBLE), 6) AS value FROM v JOIN n USING (chunk_id) WHERE s <> 0"""


def dimensions(rows: DataFrame) -> DataFrame:
    """chunk_id, dim, value of embeddings, as ``HASHED`` has them."""
    each = rows.select("chunk_id", F.posexplode("embedding").alias("dim", "v")).where("v <> 0")
    return each.select("chunk_id", "dim", F.round(F.col("v").cast("double"), 6).alias("value"))


@query(f"""WITH w AS (SELECT doc_id, {words('text')} AS ws FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, s, array_to_string(list_slice(ws, s + 1, s + 400), ' ') AS chunk FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 320)) AS s FROM w)),
c AS (SELECT doc_id || '::chunk' || (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1) AS chunk_id, chunk FROM p WHERE length(chunk) > 60), {HASHED}""")
def embed_chunks(spark, d):
    """Embeddings of document chunks from the built-in encoder."""
    from quillstream.operators.vector import chunk_rows, encode, hashed_encoder

    texts = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("pmid"), "text")
    return dimensions(encode(chunk_rows(texts), "chunk", hashed_encoder))


@query(f"""WITH {CUR} SELECT pmid, ref_id AS ord, coalesce(citation_in_text, '') AS citation_in_text, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract, authors IS NULL AS no_authors,
 coalesce(array_to_string(list_transform(authors, lambda a: coalesce(a.author, '') || '=' || coalesce(array_to_string(list_transform(a.affiliation, lambda f: coalesce(f, '')), ';'), '')), '|'), '') AS authors,
 coalesce(array_to_string(list_transform(keywords, lambda k: coalesce(k, '')), '|'), '') AS keywords, coalesce(array_to_string(list_transform(reference_pmids, lambda k: coalesce(k, '')), '|'), '') AS refs FROM cur""")
def refs_export_json(spark, d):
    """The store written as its file and read back."""
    from quillstream.operators.store import current
    from quillstream.session import scratch
    from quillstream.sources.files import SCALARS, read_store, write_store

    r = current(table(spark, d, "refs")).withColumnRenamed("reference_pmids", "references")
    path = scratch(spark, "refs.json")
    write_store(r.select("pmid", F.col("ref_id").alias("ord"), *[F.coalesce(c, F.lit("")).alias(c) for c in SCALARS], "authors", "publication_types", "keywords", "references"), path)
    ids = current(table(spark, d, "refs").select("pmid", "ref_id", "loaded_at", "citation_in_text", "journal")).select("pmid", "ref_id")
    back = read_store(spark, path).join(ids, "pmid")
    text = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: F.coalesce(x, F.lit(""))), "|"), F.lit(""))
    who = F.transform("authors", lambda a: F.concat(F.coalesce(a["author"], F.lit("")), F.lit("="), F.coalesce(F.array_join(F.transform(a["affiliation"], lambda f: F.coalesce(f, F.lit(""))), ";"), F.lit(""))))
    return back.select("pmid", F.col("ref_id").alias("ord"), "citation_in_text", "title", "abstract", F.col("authors").isNull().alias("no_authors"), F.coalesce(F.array_join(who, "|"), F.lit("")).alias("authors"), text(F.col("keywords")).alias("keywords"), text(F.col("references")).alias("refs"))


@query(f"WITH {LAST} SELECT nlmid, CAST(to_json(struct_pack(JournalTitle := journaltitle, MedAbbr := medabbr)) AS VARCHAR) AS json FROM cat")
def journal_export(spark, d):
    """Each journal as the JSON of its file entry."""
    from quillstream.operators.journals import catalogue

    c = catalogue(table(spark, d, "journals"))
    return c.select("nlmid", F.to_json(F.struct(F.col("journaltitle").alias("JournalTitle"), F.col("medabbr").alias("MedAbbr"))).alias("json"))
