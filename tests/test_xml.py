from quillstream.functions import xml as X

GOOD = """<?xml version="1.0"?><!DOCTYPE PubmedArticleSet PUBLIC "a" "https://example.org/x.dtd">
<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Journal><ISOAbbreviation>J X</ISOAbbreviation><JournalIssue><Volume>2</Volume>
<PubDate><Year>1999</Year></PubDate></JournalIssue></Journal><ArticleTitle> On <i>E. coli</i> &amp; more </ArticleTitle>
<ELocationID EIdType="doi">10.1/a</ELocationID><ELocationID EIdType="doi"></ELocationID>
<Abstract><AbstractText Label="AIM">To <b>see</b>.</AbstractText><AbstractText>End.</AbstractText></Abstract>
<AuthorList><Author><LastName>Smith</LastName><Initials>AB</Initials><AffiliationInfo><Affiliation>U1</Affiliation></AffiliationInfo><AffiliationInfo><Affiliation>U2</Affiliation></AffiliationInfo></Author>
<Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Jones</LastName></Author></AuthorList>
<PublicationTypeList><PublicationType>Journal Article</PublicationType></PublicationTypeList></Article>
<KeywordList><Keyword> a </Keyword></KeywordList><KeywordList><Keyword>b</Keyword></KeywordList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">11</ArticleId><ArticleId IdType="doi">10.1/b</ArticleId></ArticleIdList>
<ReferenceList><Reference><ArticleIdList><ArticleId IdType="pubmed">5</ArticleId></ArticleIdList></Reference><ReferenceList><Reference><ArticleIdList><ArticleId IdType="pubmed">5</ArticleId><ArticleId IdType="pubmed">6</ArticleId></ArticleIdList></Reference></ReferenceList></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>"""


def test_project(spark):
    df = spark.createDataFrame([(1, GOOD), (2, GOOD[:-40]), (3, None), (4, "plain"), (5, ""), (6, "<a/>")], "k long, xml string")
    got = {r.k: r for r in X.project(df, "k").collect()}
    r = got[1]
    assert r.valid and r.pmid == "11" and r.journal == "J X" and r.volume == "2" and r.issue == "" and r.year == "1999"
    assert r.title == "On E. coli & more"
    assert r.doi == "https://doi.org/10.1/b"
    assert r.abstract == "AIM: To see. End."
    assert [(a.author, a.affiliation) for a in r.authors] == [("Smith AB", ["U1", "U2"]), ("Jones", [])]
    assert r.keywords == ["a"] and r.reference_pmids == ["5", "6"] and r.publication_types == ["Journal Article"]
    assert r.citation_in_text == "Smith & Jones 1999" and r.citation_short == "Smith & Jones 1999 J X 11"
    assert all(not got[k].valid and got[k].pmid is None for k in (2, 3, 4, 5, 6))
