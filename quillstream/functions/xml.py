"""Citation records in XML projected to the columns of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INLINE = r"(?i)</?(?:i|b|u|em|strong|sup|sub|span|a)(?:\s[^>]*)?/?>"
_TEXT = "struct<_VALUE:string>"
#: The parts of a record that are read in one pass; titles and nested references, which need paths, are not among them.
RECORD = (
    f"MedlineCitation struct<PMID:{_TEXT},"
    "Article:struct<Journal:struct<ISOAbbreviation:string,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string>>>,Pagination:struct<MedlinePgn:string>,"
    "ELocationID:array<struct<_EIdType:string,_VALUE:string>>,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,Initials:string,AffiliationInfo:array<struct<Affiliation:string>>>>>,"
    f"PublicationTypeList:struct<PublicationType:array<{_TEXT}>>>,KeywordList:array<struct<Keyword:array<{_TEXT}>>>>,"
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)


def clean(xml: Column) -> Column:
    """Without document type, which the path functions would try to fetch."""
    return F.regexp_replace(xml, r"(?s)<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>", "")


def is_record(xml: Column) -> Column:
    """True if the text is well-formed XML with a citation in it; paths may be taken of no other text."""
    return _is_record(clean(xml))


def _is_record(cleaned: Column) -> Column:
    probe = F.from_xml(cleaned, "PubmedArticle struct<MedlineCitation:struct<PMID:string,Article:string>>")
    return F.coalesce(probe["PubmedArticle"]["MedlineCitation"].isNotNull(), F.lit(False))


def read(xml: Column) -> Column:
    """The record (``RECORD``) of a cleaned text; markup inside texts is dropped."""
    one = F.regexp_extract(F.regexp_replace(xml, _INLINE, ""), r"(?s)(<PubmedArticle[ >].*?</PubmedArticle>)", 1)
    return F.from_xml(one, RECORD, {"ignoreSurroundingSpaces": "false"})


def _flat(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _texts(array: Column) -> Column:
    """The texts of elements that have one."""
    return F.coalesce(F.filter(F.transform(array, lambda e: e["_VALUE"]), lambda t: _text(t) != ""), F.array().cast("array<string>"))


def _last(array: Column, attribute: str, value: str) -> Column:
    """The text of the last element with this attribute; empty if it has none or there is no such element."""
    return _text(F.try_element_at(F.filter(array, lambda e: e[attribute] == value), F.lit(-1))["_VALUE"])


def scalars(r: Column) -> dict[str, Column]:
    """Journal, year, volume, issue and pages; missing ones are empty."""
    a = r["MedlineCitation"]["Article"]
    issue = a["Journal"]["JournalIssue"]
    return {
        "journal": _text(a["Journal"]["ISOAbbreviation"]),
        "year": _text(issue["PubDate"]["Year"]),
        "volume": _text(issue["Volume"]),
        "issue": _text(issue["Issue"]),
        "pages": _text(a["Pagination"]["MedlinePgn"]),
    }


def title(xml: Column) -> Column:
    """The title with all nested text, by path."""
    return _flat(_text(F.xpath_string(xml, F.lit("//PubmedArticle/MedlineCitation/Article/ArticleTitle"))))


def references(xml: Column) -> Column:
    """The pmids of all nested references, each once, in order, by path."""
    found = F.xpath(xml, F.lit('//PubmedData//Reference//ArticleId[@IdType="pubmed"]/text()'))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def doi(r: Column) -> Column:
    """The link of the last doi of the article, else of the last one in the id list, else empty; a last one without text counts as none there."""
    a = _last(r["MedlineCitation"]["Article"]["ELocationID"], "_EIdType", "doi")
    b = _last(r["PubmedData"]["ArticleIdList"]["ArticleId"], "_IdType", "doi")
    raw = F.when(a != "", a).otherwise(b)
    return F.when(raw != "", F.concat(F.lit("https://doi.org/"), raw)).otherwise("")


def pmid(r: Column) -> Column:
    """The last id of type pubmed, else the citation's own."""
    listed = _last(r["PubmedData"]["ArticleIdList"]["ArticleId"], "_IdType", "pubmed")
    return F.when(listed != "", listed).otherwise(_text(r["MedlineCitation"]["PMID"]["_VALUE"]))


def _named(r: Column) -> Column:
    """The authors with a last name; collective names are dropped."""
    return F.filter(r["MedlineCitation"]["Article"]["AuthorList"]["Author"], lambda a: _text(a["LastName"]) != "")


def authors(r: Column) -> Column:
    """array<struct<author, affiliation>> of the named authors."""
    none = F.array().cast("array<string>")
    made = F.transform(
        _named(r),
        lambda a: F.struct(
            F.trim(F.concat_ws(" ", a["LastName"], _text(a["Initials"]))).alias("author"),
            F.filter(F.coalesce(F.transform(a["AffiliationInfo"], lambda i: i["Affiliation"]), none), lambda t: _text(t) != "").alias("affiliation"),
        ),
    )
    return F.coalesce(made, F.array().cast("array<struct<author:string,affiliation:array<string>>>"))


def last_names(r: Column) -> Column:
    """Last names in order."""
    return F.coalesce(F.transform(_named(r), lambda a: a["LastName"]), F.array().cast("array<string>"))


def abstract(r: Column) -> Column:
    """The parts of the abstract joined by spaces, labelled ones with their label."""
    text = lambda a: _flat(_text(a["_VALUE"]))
    lines = F.transform(r["MedlineCitation"]["Article"]["Abstract"]["AbstractText"], lambda a: F.when(_text(a["_Label"]) != "", F.concat(a["_Label"], F.lit(": "), text(a))).otherwise(text(a)))
    return _text(F.array_join(lines, " "))


def keywords(r: Column) -> Column:
    """The keywords of the first list only."""
    first = F.try_element_at(r["MedlineCitation"]["KeywordList"], F.lit(1))
    return F.transform(_texts(first["Keyword"]), _flat)


def publication_types(r: Column) -> Column:
    return _texts(r["MedlineCitation"]["Article"]["PublicationTypeList"]["PublicationType"])


def is_kept(types: Column) -> Column:
    """Journal articles that aren't retracted."""
    return F.array_contains(types, "Journal Article") & ~F.array_contains(types, "Retracted Publication")


def project(records: DataFrame, key: str, xml: str = "xml", fields: tuple[str, ...] | None = None) -> DataFrame:
    """Every record with the columns of the store and ``valid``; of texts that are no record only ``key`` and ``valid`` = false.

    ``fields`` names the columns that are wanted, by default all. Each text is parsed once to tell whether it is a record and once
    for its fields: the row comes out of a generator, below which the optimiser moves no filter. Titles and nested references
    are read by path, and only if they are wanted. Null text isn't valid. Repeated records are projected alike.
    """
    from quillstream.functions.text import citation_key, short_authors

    def made(x: Column, r: Column) -> dict[str, Column]:
        s = scalars(r)
        cited = F.concat(short_authors(last_names(r)), F.lit(" "), s["year"])
        return {
            "pmid": pmid(r), **s, "title": title(x), "doi": doi(r), "abstract": abstract(r), "authors": authors(r), "publication_types": publication_types(r), "keywords": keywords(r),
            "reference_pmids": references(x), "citation_in_text": cited, "citation_short": citation_key(cited, s["journal"], pmid(r)),
        }

    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    names = tuple(made(F.lit(""), F.lit(None))) if fields is None else fields
    row = lambda x, r: F.struct(r.isNotNull().alias("valid"), *[F.when(r.isNotNull(), made(x, r)[n]).alias(n) for n in names])
    whole = once(clean(F.col(xml)), lambda x: once(F.when(_is_record(x), read(x)), lambda r: row(x, r)))
    return records.select(key, F.inline(F.array(whole)))
