"""Queries over the reference store with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import journals as J
from quillstream.operators import store as S
from quillstream.operators import vector as V
from quillstream.plans.records import HASHED, dimensions
from quillstream.plans.sql import CUR, FIRST_TEXT, LAST, PATHS, SPACE, STEM, words
from quillstream.session import cut, scratch, table

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


def store_of(spark: SparkSession, d: str) -> DataFrame:
    return S.current(table(spark, d, "refs"))


@query(f"WITH {CUR} SELECT pmid, ref_id, stem, journal, year FROM cur")
def refs_scan(spark, d):
    """The store: the last loaded row of each pmid."""
    return store_of(spark, d).select("pmid", "ref_id", "stem", "journal", "year")


@query(f"""WITH {LAST} SELECT nlmid, journaltitle, medabbr, first_ord FROM cat""")
def journal_scan(spark, d):
    """The journal catalogue by id."""
    return J.catalogue(table(spark, d, "journals"))


@query("SELECT k AS name, arg_max(v, ord) AS abbr, min(ord) AS first_ord FROM (SELECT lower(trim(coalesce(journaltitle,''))) AS k, trim(medabbr) AS v, ord FROM journals WHERE trim(coalesce(medabbr,'')) <> '') WHERE k <> '' GROUP BY k")
def last_wins_dedupe(spark, d):
    """Abbreviations by title in lower case; the last row of a title counts, in the place of the first."""
    rows = table(spark, d, "journals").where("trim(medabbr) <> ''").select(F.lower(F.trim(F.coalesce("journaltitle", F.lit("")))).alias("name"), F.trim("medabbr").alias("abbr"), "ord")
    return S.last_wins(rows.where("name <> ''"), ["name"], "ord").select("name", "abbr", "first_ord")


@query(f"""
WITH {CUR}, own AS (SELECT paper_id AS cite_id, regexp_extract(stem, '(\\d+)$', 1) AS pmid FROM papers), batch AS (SELECT cite_id, pmid FROM own UNION ALL SELECT cite_id, '9' || pmid FROM own)
SELECT pmid, min(cite_id) AS cite_id FROM batch WHERE pmid NOT IN (SELECT pmid FROM cur) GROUP BY pmid""")
def dedupe_anti_join(spark, d):
    """Ids of a batch that the store doesn't have, each once: the batch has the id of each paper, and one that no record has."""
    id_ = F.regexp_extract("stem", r"(\d+)$", 1)
    batch = table(spark, d, "papers").select(F.col("paper_id").alias("cite_id"), F.explode(F.array(id_, F.concat(F.lit("9"), id_))).alias("pmid"))
    return S.new_ids(batch, store_of(spark, d), "pmid", "cite_id")


@query(f"""
WITH {CUR}, batch AS (SELECT paper_id, pmid, row_number() OVER (PARTITION BY pmid ORDER BY paper_id) AS n FROM papers WHERE pmid IS NOT NULL)
SELECT paper_id, pmid, CASE WHEN n > 1 OR pmid IN (SELECT pmid FROM cur) THEN 'duplicate' ELSE 'new' END AS status FROM batch""")
def batch_status(spark, d):
    """Every id of a batch as duplicate or new, repeats within the batch being duplicates."""
    batch = table(spark, d, "papers").where("pmid is not null").select("paper_id", "pmid")
    return S.duplicate_events(batch, store_of(spark, d), "pmid", "paper_id")


@query("""
WITH base AS (SELECT pmid, arg_max(title, ref_id) AS title FROM refs WHERE pmid <> '' AND ref_id % 3 > 0 GROUP BY pmid),
     new AS (SELECT pmid, arg_max(upper(title), ref_id) AS title FROM refs WHERE pmid <> '' AND ref_id % 3 = 0 GROUP BY pmid)
SELECT pmid, title FROM new UNION ALL SELECT pmid, title FROM base WHERE pmid NOT IN (SELECT pmid FROM new)""")
def upsert_refs(spark, d):
    """One part of the rows put into a store of the others."""
    rows = table(spark, d, "refs").where("pmid <> ''")
    last = lambda part, value: rows.where(part).groupBy("pmid").agg(F.max_by(F.expr(value), F.col("ref_id")).alias("title"))
    return S.upsert(last("ref_id % 3 > 0", "title"), last("ref_id % 3 = 0", "upper(title)"), "pmid")


@query("SELECT ref_id AS id, 'refs' AS origin FROM refs UNION ALL SELECT paper_id, 'papers' FROM papers UNION ALL SELECT paper_id, 'papers' FROM papers WHERE ext = 'md'")
def union_append(spark, d):
    """Rows appended to rows, repeats kept."""
    papers = table(spark, d, "papers")
    a = table(spark, d, "refs").select(F.col("ref_id").alias("id"), F.lit("refs").alias("origin"))
    b = papers.select(F.col("paper_id").alias("id"), F.lit("papers").alias("origin"))
    return a.unionByName(b).unionByName(papers.where("ext = 'md'").select(F.col("paper_id").alias("id"), F.lit("papers").alias("origin")))


@query(f"""
WITH {CUR} SELECT pmid, needs_aff, needs_ref FROM (
  SELECT pmid, len(list_filter(coalesce(authors, []), lambda a: coalesce(len(a.affiliation), 0) = 0)) > 0 AS needs_aff, coalesce(len(reference_pmids), 0) = 0 AS needs_ref FROM cur)
WHERE needs_aff OR needs_ref""")
def needs_fill_filter(spark, d):
    """Records without an affiliation or without references."""
    return S.incomplete(store_of(spark, d)).select("pmid", "needs_aff", "needs_ref")


def _extract(spark, d):
    """What an extract of the papers would hold: the authors of all rows of a record, by its stem."""
    rows = table(spark, d, "refs").where("pmid <> ''").select("pmid", "authors", "ref_id")
    return rows.join(store_of(spark, d).select("pmid", "stem"), "pmid").groupBy("stem").agg(F.max_by("authors", "ref_id").alias("authors"), F.count(F.lit(1)).alias("n"))


_FILL = f"""
WITH {CUR}, ext AS (SELECT c.stem, arg_max_null(r.authors, r.ref_id) AS authors FROM refs r JOIN cur c ON r.pmid = c.pmid GROUP BY c.stem),
own AS (SELECT ref_id, stem, generate_subscripts(authors, 1) - 1 AS pos, unnest(authors) AS a FROM cur),
given AS (SELECT stem, author, arg_max_null(aff, p) AS aff FROM (SELECT stem, a.author AS author, a.affiliation AS aff, p FROM (SELECT stem, generate_subscripts(authors, 1) AS p, unnest(authors) AS a FROM ext)) GROUP BY stem, author),
filled AS (
  SELECT o.ref_id, o.pos, o.a.author AS author,
         CASE WHEN coalesce(len(o.a.affiliation), 0) = 0 AND coalesce(len(g.aff), 0) > 0 THEN g.aff ELSE o.a.affiliation END AS aff,
         coalesce(len(o.a.affiliation), 0) = 0 AND coalesce(len(g.aff), 0) > 0 AS filled,
         coalesce(len(o.a.affiliation), 0) = 0 AND coalesce(len(g.aff), 0) = 0 AS missing
  FROM own o LEFT JOIN given g ON o.stem = g.stem AND o.a.author = g.author)
"""


@query(_FILL + "SELECT ref_id, CAST(pos AS INTEGER) AS pos, author, coalesce(array_to_string(aff, ' | '), '') AS affiliation, filled, missing FROM filled")
def fill_affiliation_left_join(spark, d):
    """Authors with their affiliations, empty ones filled from the extracts by name."""
    f = S.fill_affiliations(store_of(spark, d), _extract(spark, d))
    joined = F.coalesce(F.array_join("affiliation", " | "), F.lit(""))
    return f.select("ref_id", "pos", "author", joined.alias("affiliation"), "filled", "missing")


@query(_FILL + "SELECT ref_id, CAST(count(*) FILTER (WHERE filled) AS BIGINT) AS affiliations_filled, coalesce(string_agg(CASE WHEN missing THEN coalesce(author, 'None') END, '|' ORDER BY pos), '') AS affiliations_missing FROM filled GROUP BY ref_id")
def fill_counters(spark, d):
    """Authors filled and still missing, for each record."""
    return S.fill_counters(S.fill_affiliations(store_of(spark, d), _extract(spark, d)))


@query(f"""WITH {CUR} SELECT c.pmid, c.stem, p.paper_id, CASE WHEN p.paper_id IS NULL THEN 'file not found: papers/' || c.stem || '.json' END AS error
FROM cur c LEFT JOIN (SELECT stem, min(paper_id) AS paper_id FROM papers GROUP BY stem) p ON c.stem = p.stem""")
def paper_extract_join(spark, d):
    """Records with the extract of their stem, or an error where there is none."""
    files = table(spark, d, "papers").groupBy("stem").agg(F.min("paper_id").alias("paper_id"))
    both = store_of(spark, d).select("pmid", "stem").join(files, "stem", "left")
    missing = F.concat(F.lit("file not found: papers/"), "stem", F.lit(".json"))
    return both.select("pmid", "stem", "paper_id", F.when(F.col("paper_id").isNull(), missing).alias("error"))


@query(f"WITH {CUR} SELECT stem || chr(10) || coalesce(doi,'') || chr(10) || chr(10) AS line FROM cur WHERE stem NOT IN (SELECT stem FROM papers WHERE stem IS NOT NULL)")
def missing_pdf_anti(spark, d):
    """The list of records without a file."""
    there = table(spark, d, "papers").where("stem is not null").select("stem").distinct()
    rows = store_of(spark, d).join(there, "stem", "left_anti")
    return rows.select(F.concat("stem", F.lit("\n"), F.coalesce("doi", F.lit("")), F.lit("\n\n")).alias("line"))


@query(f"WITH {CUR} SELECT paper_id, stem FROM papers WHERE stem IN (SELECT stem FROM cur)")
def existing_semi(spark, d):
    """Files that belong to a record."""
    return table(spark, d, "papers").select("paper_id", "stem").join(store_of(spark, d).select("stem"), "stem", "left_semi")


@query(f"WITH {FIRST_TEXT} SELECT stem, ext, full_text FROM ft")
def fulltext_coalesce(spark, d):
    """The text of each stem: Markdown before plain."""
    return S.first_text(table(spark, d, "papers"))


_INDEX = f"""{CUR}, {FIRST_TEXT}, it AS (
  SELECT c.pmid, coalesce(f.full_text, '') <> '' AS is_full, CASE WHEN coalesce(f.full_text, '') <> '' THEN f.full_text ELSE
    concat_ws(' ', coalesce(c.title, ''), nullif(c.abstract, ''), nullif(array_to_string(list_filter(c.keywords, lambda k: k IS NOT NULL), ' '), '')) END AS text
  FROM cur c LEFT JOIN ft f ON c.stem = f.stem)"""


def _texts(spark, d):
    return S.index_text(store_of(spark, d), S.first_text(table(spark, d, "papers")))


@query(f"WITH {_INDEX} SELECT pmid, is_full, text FROM it")
def index_text(spark, d):
    """What is indexed of each record."""
    return _texts(spark, d)


@query(f"WITH {_INDEX} SELECT is_full, count(*) AS papers FROM it GROUP BY is_full")
def index_counts(spark, d):
    """Records by full text or abstract only."""
    return _texts(spark, d).groupBy("is_full").agg(F.count(F.lit(1)).alias("papers"))


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, s, array_to_string(list_slice(ws, s + 1, s + 400), ' ') AS chunk FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 320)) AS s FROM w))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, md5(chunk) AS digest FROM c WHERE length(chunk) > 60""")
def chunk_sliding(spark, d):
    """Windows of 400 words with an overlap of 80, short ones dropped, counted from 0."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_index", "chunk"))
    return rows.select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


_USABLE = "len(embeddings) = 64 AND list_sum(list_transform(embeddings, lambda x: abs(x))) > 0"


@query(f"""
WITH v AS (SELECT vec_id, pmid, CAST(embeddings AS DOUBLE[64]) AS e FROM chroma_db WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, v.pmid, v.vec_id, array_cosine_similarity(v.e, q.e) AS c FROM v, v AS q WHERE q.vec_id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS n FROM s),
p AS (SELECT query_id, pmid, max(round(c, 4)) AS score, max(c) AS m FROM t WHERE n <= 30 GROUP BY query_id, pmid),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m DESC, pmid) AS rank FROM p)
SELECT query_id, rank, pmid, score FROM r WHERE rank <= 10 AND score > 0""")
def vector_topk(spark, d):
    """The papers closest to every vector whose id 100 divides, against all vectors."""
    vectors = table(spark, d, "chroma_db").select("vec_id", "pmid", "embeddings")
    usable = (F.size("embeddings") == 64) & F.exists("embeddings", lambda x: x != 0)
    queries = vectors.where(usable & (F.col("vec_id") % 100 == 0)).select(F.col("vec_id").alias("query_id"), "embeddings")
    return V.nearest_to_each(vectors, queries)


@query(f"WITH {CUR} SELECT pmid, status FROM (SELECT pmid, 'retracted' AS status FROM cur WHERE list_contains(publication_types, 'Retracted Publication') UNION ALL SELECT pmid, 'preprint' FROM cur WHERE list_contains(publication_types, 'Preprint'))")
def validate_status(spark, d):
    """Retracted records and preprints of the store."""
    return S.validate(store_of(spark, d))


@query(f"""WITH {CUR} SELECT pmid, 'skipped' AS status, 'PMID ' || pmid || ': ' || CASE WHEN list_contains(publication_types, 'Retracted Publication') THEN 'Retracted Publication' ELSE 'not a Journal Article' END
 || '. PublicationTypes: [' || array_to_string(list_transform(list_filter(publication_types, lambda x: x IS NOT NULL), lambda t: '''' || t || ''''), ', ') || ']' AS message
FROM cur WHERE publication_types IS NOT NULL AND (list_contains(publication_types, 'Retracted Publication') OR NOT list_contains(publication_types, 'Journal Article'))""")
def ingest_status_events(spark, d):
    """Why fetched records are skipped."""
    rows = store_of(spark, d).where("publication_types is not null").withColumn("types", F.filter("publication_types", lambda t: t.isNotNull()))
    return rows.select("pmid", S.ingest_status(F.col("types"), F.col("pmid")).alias("e")).where("e.status is not null").select("pmid", "e.status", "e.message")


@query("SELECT ref_id, CAST(len(k) AS BIGINT) AS kept, array_to_string(k, '|') AS types, list_contains(k, 'Journal Article') AND NOT list_contains(k, 'Retracted Publication') AS valid FROM (SELECT ref_id, list_filter(publication_types, lambda t: t IS NOT NULL AND NOT starts_with(t, 'Research Support')) AS k FROM refs WHERE publication_types IS NOT NULL)")
def pubtype_filter(spark, d):
    """Publication types without funding, and whether they make a valid record."""
    kept = F.filter("publication_types", lambda t: t.isNotNull() & ~F.startswith(t, F.lit("Research Support")))
    rows = table(spark, d, "refs").where("publication_types is not null").select("ref_id", kept.alias("k"))
    from quillstream.functions.xml import is_kept

    return rows.select("ref_id", F.size("k").cast("long").alias("kept"), F.array_join("k", "|").alias("types"), is_kept(F.col("k")).alias("valid"))


@query("SELECT ref_id, t AS type FROM (SELECT ref_id, unnest(publication_types) AS t FROM refs) WHERE NOT starts_with(t, 'Research Support')")
def array_prefix_filter(spark, d):
    """Publication types that don't begin with a prefix, one row each."""
    kept = F.filter("publication_types", lambda t: ~F.startswith(t, F.lit("Research Support")))
    return table(spark, d, "refs").select("ref_id", F.explode(kept).alias("type"))


@query(f"SELECT ref_id, {STEM} AS stem FROM refs")
def citation_stem(spark, d):
    """The file stem of each row."""
    return table(spark, d, "refs").select("ref_id", T.citation_key(F.col("citation_in_text"), F.col("journal"), F.col("pmid")).alias("stem"))


@query("""
WITH n AS (SELECT ref_id, list_filter(list_transform(coalesce(authors, []), lambda a: split_part(a.author, ' ', 1)), lambda x: coalesce(x, '') <> '') AS l, coalesce(year, '') AS y FROM refs)
SELECT ref_id, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) = 2 THEN l[1] || ' & ' || l[2] ELSE coalesce(l[1], '') || ' et al.' END || ' ' || y AS citation FROM n""")
def citation_key(spark, d):
    """The citation in text: one author, two, or the first of more."""
    names = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<struct<author:string,affiliation:array<string>>>")), lambda a: F.split_part(a["author"], F.lit(" "), F.lit(1))), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = table(spark, d, "refs").select("ref_id", "year", names.alias("l"))
    return rows.select("ref_id", F.concat(T.short_authors(F.col("l")), F.lit(" "), F.coalesce("year", F.lit(""))).alias("citation"))


@query(f"""
WITH {CUR}, hits AS (SELECT DISTINCT p.pmid, r.reference AS hit, r.ord FROM (SELECT pmid FROM cur WHERE list_contains(publication_types, 'Preprint')) p JOIN (SELECT pmid, unnest(reference_pmids) AS reference, generate_subscripts(reference_pmids, 1) AS ord FROM cur) r ON p.pmid = r.pmid),
asked AS (SELECT pmid, hit, ord FROM hits UNION ALL SELECT pmid, '9' || hit, ord FROM hits)
SELECT pmid, CAST(ord - 1 AS INTEGER) AS ord, hit FROM asked WHERE hit IS NOT NULL AND hit <> pmid AND hit NOT IN (SELECT pmid FROM cur)""")
def preprint_candidates(spark, d):
    """Ids found for preprints (here: their references, and for each an id that no record has) that the store lacks."""
    store = store_of(spark, d)
    hits = store.where(F.array_contains("publication_types", "Preprint")).select("pmid", F.posexplode("reference_pmids").alias("ord", "hit"))
    hits = hits.select("pmid", "ord", F.explode(F.array("hit", F.concat(F.lit("9"), "hit"))).alias("hit"))
    return S.preprint_candidates(hits, store)


@query("SELECT paper_id, length(regexp_replace(full_text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(full_text, '[^\\p{L}]', '', 'g')) < 2000 AS fallback FROM papers WHERE full_text IS NOT NULL")
def alpha_count_filter(spark, d):
    """Letters of each text, and whether they are too few to trust the extraction."""
    n = T.n_letters(F.col("full_text"))
    return table(spark, d, "papers").where("full_text is not null").select("paper_id", n.alias("letters"), (n < 2000).alias("fallback"))


@query(f"""WITH {CUR}, r AS (SELECT pmid, generate_subscripts(reference_pmids, 1) AS i, unnest(reference_pmids) AS p FROM cur), w AS (SELECT r.pmid, r.p, r.i FROM r JOIN cur c ON r.p = c.pmid)
SELECT pmid, count(*) AS resolved, string_agg(p, '|' ORDER BY i) AS found FROM w GROUP BY pmid""")
def resolved_refs_collect(spark, d):
    """References that lead to a record, in order and with repeats."""
    store = store_of(spark, d)
    each = store.select("pmid", F.posexplode("reference_pmids").alias("i", "p"))
    kept = each.join(store.select(F.col("pmid").alias("p")), "p", "left_semi").groupBy("pmid").agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("l"))
    return kept.select("pmid", F.size("l").cast("long").alias("resolved"), F.array_join(F.transform("l", lambda x: x["p"]), "|").alias("found"))


@query(f"""WITH {CUR}, o AS (SELECT pmid, unnest(reference_pmids) AS target FROM cur), e AS (SELECT pmid, target FROM o UNION ALL SELECT pmid, '9' || target FROM o)
SELECT pmid, 'papers/' || pmid || '.json' AS file, count(*) AS n_warnings, min(left('not resolved: ' || target, 120)) AS first_warning FROM e WHERE target NOT IN (SELECT pmid FROM cur) GROUP BY pmid""")
def merge_log(spark, d):
    """A log row for each record with references that the store lacks; each reference is also asked for under an id that no record has."""
    store = store_of(spark, d)
    asked = store.select("pmid", F.explode("reference_pmids").alias("t")).select("pmid", F.explode(F.array("t", F.concat(F.lit("9"), "t"))).alias("target"))
    lost = asked.where("target is not null").join(store.select(F.col("pmid").alias("target")), "target", "left_anti")
    said = F.left(F.concat(F.lit("not resolved: "), "target"), F.lit(120))
    return lost.groupBy("pmid").agg(F.count(F.lit(1)).alias("n_warnings"), F.min(said).alias("first_warning")).withColumn("file", F.concat(F.lit("papers/"), "pmid", F.lit(".json")))


@query(f"SELECT paper_id, {PATHS['stem']} AS stem FROM (SELECT paper_id, '/data/papers/' || coalesce(stem, 'none') || '.' || ext AS path FROM papers)")
def path_stem(spark, d):
    """File names without folder and extension."""
    path = F.concat(F.lit("/data/papers/"), F.coalesce("stem", F.lit("none")), F.lit("."), "ext")
    return table(spark, d, "papers").select("paper_id", T.path_stem(path).alias("stem"))


@query("SELECT ref_id, pmid AS id FROM refs WHERE regexp_full_match(pmid, '\\d+') UNION ALL SELECT ref_id, 'x' || pmid FROM refs WHERE regexp_full_match(pmid, '\\d+')")
def id_normalize(spark, d):
    """Ids from URLs; what isn't one stays as it is."""
    rows = table(spark, d, "refs").where(F.col("pmid").rlike(r"^\d+$"))
    url = F.concat(F.lit("  https://example.org/articles/"), "pmid", F.when(F.col("ref_id") % 2 == 0, "//").otherwise(" "))
    a = rows.select("ref_id", T.normalise_id(url).alias("id"))
    return a.unionByName(rows.select("ref_id", T.normalise_id(F.concat(F.lit("x"), "pmid")).alias("id")))


@query("SELECT ref_id, replace(url_encode(title), '%2F', '/') AS quoted FROM refs WHERE title IS NOT NULL")
def url_quote(spark, d):
    """Titles percent-encoded for a query."""
    return table(spark, d, "refs").where("title is not null").select("ref_id", T.url_quote(F.col("title")).alias("quoted"))


@query(f"""WITH {_INDEX}, w AS (SELECT pmid, {words('text')} AS ws FROM it),
p AS (SELECT pmid, s, array_to_string(list_slice(ws, s + 1, s + 400), ' ') AS chunk FROM (SELECT pmid, ws, unnest(range(0, len(ws), 320)) AS s FROM w)),
c AS (SELECT pmid || '::chunk' || (row_number() OVER (PARTITION BY pmid ORDER BY s) - 1) AS chunk_id, chunk FROM p WHERE length(chunk) > 60), {HASHED}""")
def index_build(spark, d):
    """The vector index of the store's texts, written over an older one and read back."""
    from quillstream.plans.pipelines import write_index

    path = scratch(spark, "index")
    texts = cut(_texts(spark, d))
    write_index(texts.where("is_full"), path)
    write_index(texts, path)
    return dimensions(spark.read.parquet(path))


@query(f"""WITH {_INDEX}, w AS (SELECT pmid, {words('text')} AS ws FROM it),
c AS (SELECT pmid, s, array_to_string(list_slice(ws, s + 1, s + 400), ' ') AS chunk FROM (SELECT pmid, ws, unnest(range(0, len(ws), 320)) AS s FROM w))
SELECT pmid || '::chunk' || (row_number() OVER (PARTITION BY pmid ORDER BY s) - 1) AS chunk_id, pmid, md5(chunk) AS digest FROM c WHERE length(chunk) > 60""")
def index_chunks(spark, d):
    """Chunk ids and chunks of the index."""
    return V.chunk_rows(_texts(spark, d)).select("chunk_id", "pmid", F.md5("chunk").alias("digest"))


