"""Whole pipelines over a collection: ingest, validation, merging of extracts, indexing, search.

A collection is a folder: ``refs`` (the store in buckets of Parquet files), ``papers`` (files by stem), ``index`` (chunk
vectors in Parquet). Status events come back as DataFrames; nothing is printed here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import xml as X
from quillstream.operators import journals as J
from quillstream.operators import search as S
from quillstream.operators import store as R
from quillstream.operators import vector as V
from quillstream.operators.citations import parse
from quillstream.session import cut
from quillstream.sources import files
from quillstream.streaming.ingest import put, read_store, replace

STORE = "pmid string, citation_in_text string, journal string, volume string, issue string, year string, title string, pages string, doi string, abstract string, authors array<struct<author:string,affiliation:array<string>>>, publication_types array<string>, keywords array<string>, reference_pmids array<string>, ord long"


def store(spark: SparkSession, root: str) -> DataFrame:
    """The store of a collection; empty before the first ingest."""
    df = read_store(spark, f"{root}/refs")
    return spark.createDataFrame([], STORE) if df is None else df


def publish(df: DataFrame, root: str) -> None:
    """Make ``df`` the store."""
    replace(df, f"{root}/refs")


def fetch(ids: DataFrame, transport: str | None = None, spacing: float = 0.4, partitions: int = 1) -> DataFrame:
    """id, xml, error of the ids of a DataFrame, from the service."""
    from quillstream.sources.remote import fetch_records

    return fetch_records(ids, transport, spacing, partitions=partitions)


def ask_service(queries: DataFrame, transport: str | None = None, spacing: float = 0.4, partitions: int = 1) -> DataFrame:
    """query, hits, pmid (of a single hit), error from the service's search: an ``ask`` for ``merge``."""
    from quillstream.sources.remote import search_all

    found = search_all(queries, 2, transport, spacing, partitions=partitions)
    return found.select("query", "hits", F.when(F.col("hits") == 1, F.get("ids", F.lit(0))).alias("pmid"), "error")


def ingest(spark: SparkSession, root: str, ids: list[str], get: Callable[[DataFrame], DataFrame] = fetch) -> DataFrame:
    """Fetch records and put them into the store; returns the events (ord, id, status, message).

    Ids may be URLs. Ids in the store and repeats in the batch are duplicates; records that can't be read are
    errors; retracted records and other than journal articles are skipped. Records without a file in ``papers`` are
    appended to ``temp_refs``.
    """
    asked = spark.createDataFrame(list(enumerate(ids)), "ord long, id string").withColumn("id", T.normalise_id(F.col("id")))
    old = cut(store(spark, root))
    marked = cut(R.duplicate_events(asked, old.select(F.col("pmid").alias("id")), "id", "ord"))
    new = marked.where("status = 'new'").drop("status")
    got = cut(get(new.select("id")))
    read = X.project(got.where("error is null"), "id").join(got.select("id", "error"), "id")
    read = cut(new.join(read, "id").withColumn("e", R.ingest_status(F.col("publication_types"), F.col("id"))))
    kept = read.where("valid and e.status is null")
    first = old.agg(F.max("ord")).first()[0] or 0
    rows = kept.select(*[c for c in old.columns if c not in ("ord", "publication_types")], F.filter("publication_types", lambda t: ~F.startswith(t, F.lit("Research Support"))).alias("publication_types"), (F.col("ord") + first + 1).alias("ord"))
    bare = rows.withColumn("authors", F.transform("authors", lambda a: F.struct(a["author"].alias("author"), F.array().cast("array<string>").alias("affiliation"))))
    bare = cut(R.last_wins(bare, ["pmid"], "ord").drop("first_ord").select(*old.columns))
    if not bare.isEmpty():
        put(bare, f"{root}/refs")
        stems = _stems(spark, root, "pdf")
        lost = bare.withColumn("stem", T.citation_key(F.col("citation_in_text"), F.col("journal"), F.col("pmid"))).join(stems, "stem", "left_anti")
        lost.select(F.concat("stem", F.lit("\n"), "doi", F.lit("\n")).alias("value")).write.mode("append").text(f"{root}/temp_refs")
    duplicate = marked.where("status = 'duplicate'").select("ord", "id", "status", F.concat(F.lit("PMID "), "id", F.lit(" already exists in the store")).alias("message"))
    failed = new.join(got.where("error is not null"), "id").select("ord", "id", F.lit("error").alias("status"), F.col("error").alias("message"))
    broken = read.where("not valid").select("ord", "id", F.lit("error").alias("status"), F.lit("no citation record").alias("message"))
    skipped = read.where("valid and e.status is not null").select("ord", "id", "e.status", "e.message")
    stored = kept.select("ord", "id", F.lit("stored").alias("status"), F.col("citation_short").alias("message"))
    return duplicate.unionByName(failed).unionByName(broken).unionByName(skipped).unionByName(stored)


def _stems(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """Stems of the files of one kind in ``papers``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/papers")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return spark.createDataFrame([(n[: -len(ext) - 1],) for n in names if n.endswith(f".{ext}")], "stem string")


def validate(spark: SparkSession, root: str, get: Callable[[DataFrame], DataFrame] = fetch, search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Events of a check of the whole store: id, status (``error``, ``retracted``, ``preprint``), title, candidates.

    ``search`` answers queries with (query, ids); a preprint's candidates are the hits for its title that are
    neither itself nor in the store.
    """
    old = store(spark, root)
    got = cut(get(old.select(F.col("pmid").alias("id"))))
    read = cut(X.project(got.where("error is null"), "id"))
    none = F.array().cast("array<string>")
    events = got.where("error is not null").select("id", F.lit("error").alias("status"), F.lit("").alias("title"), none.alias("candidates"))
    marked = R.validate(read.where("valid").select(F.col("id").alias("pmid"), "publication_types")).join(read.select(F.col("id").alias("pmid"), "title"), "pmid")
    events = events.unionByName(marked.where("status = 'retracted'").select(F.col("pmid").alias("id"), "status", "title", none.alias("candidates")))
    pre = marked.where("status = 'preprint'").withColumn("query", F.concat("title", F.lit(" NOT preprint[pt]")))
    if search is None:
        return events.unionByName(pre.select(F.col("pmid").alias("id"), "status", "title", none.alias("candidates")))
    hits = pre.join(search(pre.select("query").distinct()), "query").select("pmid", F.posexplode("ids").alias("ord", "hit"))
    kept = R.preprint_candidates(hits, old).groupBy("pmid").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "hit"))), lambda h: h["hit"]).alias("candidates"))
    both = pre.join(kept, "pmid", "left")
    return events.unionByName(both.select(F.col("pmid").alias("id"), "status", "title", F.coalesce("candidates", none).alias("candidates")))


def merge(spark: SparkSession, root: str, journals: DataFrame, ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fill affiliations and references of the store from the extracts in ``papers``; returns a row of counters for each incomplete record.

    Citations are parsed and resolved through the ladder; ``ask`` answers queries with (query, hits, pmid), by default
    from the store itself. References are replaced only where at least one was resolved. Records with warnings are appended to
    ``merge_log``, a line of JSON each.
    """
    old = cut(store(spark, root).withColumn("stem", T.citation_key(F.col("citation_in_text"), F.col("journal"), F.col("pmid"))))
    todo = cut(R.incomplete(old))
    extracts = cut(files.read_extracts(spark, f"{root}/papers"))
    filled = cut(R.fill_affiliations(todo.where("needs_aff").select("pmid", "stem", "authors"), extracts, "pmid"))
    authors = filled.groupBy("pmid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "author", "affiliation"))), lambda a: F.struct(a["author"].alias("author"), a["affiliation"].alias("affiliation"))).alias("_authors"))
    cites = todo.where("needs_ref").select("pmid", "stem").join(extracts.select("stem", F.posexplode("references").alias("i", "citation")), "stem")
    cites = cut(cites.withColumn("key", F.concat_ws("#", "pmid", "i")))
    parsed = cut(parse(cites, "key", "citation", cut(J.index(journals))))
    if ask is None:
        index = cut(S.postings(old))
        ask = lambda q: S.unique_hits(q, index)
    found = cut(S.climb(parsed.where("groups is not null").join(cites.select("key", "citation"), "key"), ask, "key", "groups", "citation"))
    per = cut(_resolved(cites, found))
    new = old.join(authors, "pmid", "left").join(per, "pmid", "left")
    new = new.withColumn("authors", F.coalesce("_authors", "authors")).withColumn("reference_pmids", F.when(F.size("_refs") > 0, F.col("_refs")).otherwise(F.col("reference_pmids")))
    changed = new.where(F.col("_authors").isNotNull() | (F.size("_refs") > 0)).select(*[c for c in old.columns if c != "stem"])
    put(cut(changed), f"{root}/refs")
    counted = R.fill_counters(filled, "pmid")
    there = extracts.select("stem", F.lit(True).alias("has_file")).distinct()
    report = todo.select("pmid", "stem").join(there, "stem", "left").join(counted, "pmid", "left").join(per, "pmid", "left")
    error = F.when(F.col("has_file").isNull(), F.concat(F.lit("file not found: papers/"), "stem", F.lit(".json")))
    warned = cut(report.where(F.size("warnings") > 0).select("pmid", F.concat(F.lit("papers/"), "stem", F.lit(".json")).alias("file"), "warnings"))
    if not warned.isEmpty():
        files.append_lines(warned, f"{root}/merge_log")
    return report.select("pmid", error.alias("error"), "affiliations_filled", "affiliations_missing", F.coalesce(F.size("_refs"), F.lit(0)).alias("references_resolved"), "references_total", "warnings")


def _resolved(cites: DataFrame, found: DataFrame) -> DataFrame:
    """For each record the resolved references in order, with repeats, their number before, and the warnings."""
    both = cites.join(found.select("key", F.col("pmid").alias("_hit"), "warning"), "key", "left")
    said = F.when(F.col("_hit").isNull(), F.concat(F.coalesce("warning", F.lit("journal parsing failed")), F.lit(": "), F.left("citation", F.lit(120))))
    inner = F.sort_array(F.collect_list(F.struct("i", "_hit", said.alias("said"))))
    per = both.groupBy("pmid").agg(inner.alias("l"), F.count(F.lit(1)).alias("references_total"))
    pick = lambda c: F.filter(F.transform("l", lambda x: x[c]), lambda v: v.isNotNull())
    return per.select("pmid", pick("_hit").alias("_refs"), "references_total", pick("said").alias("warnings"))


def write_index(texts: DataFrame, path: str, make: Callable = V.hashed_encoder) -> None:
    """Encode the chunks of ``texts`` (pmid, text) and write them as the index, in place of an older one."""
    V.encode(V.chunk_rows(texts), "chunk", make).select("chunk_id", "pmid", "chunk_index", "embedding").write.mode("overwrite").parquet(path)


def build_index(spark: SparkSession, root: str, make: Callable = V.hashed_encoder) -> DataFrame:
    """Index the texts of the collection; returns papers by full text or abstract only."""
    refs = cut(store(spark, root).withColumn("stem", T.citation_key(F.col("citation_in_text"), F.col("journal"), F.col("pmid"))))
    if refs.isEmpty():
        raise ValueError("no papers in the store")
    papers = files.read_texts(spark, f"{root}/papers").withColumn("paper_id", F.lit(0))
    texts = cut(R.index_text(refs, R.first_text(papers)))
    write_index(texts, f"{root}/index", make)
    return texts.groupBy("is_full").agg(F.count(F.lit(1)).alias("papers"))


def query_index(spark: SparkSession, root: str, words: str, make: Callable = V.hashed_encoder) -> DataFrame:
    """pmid and score of the papers closest to a query; an error if there is no index."""
    if not files._exists(spark, f"{root}/index"):
        raise FileNotFoundError("no index; build it first")
    vectors = spark.read.parquet(f"{root}/index").select("pmid", F.xxhash64("chunk_id").alias("vec_id"), F.col("embedding").alias("embeddings"))
    return V.nearest_papers(vectors, make()([words])[0])
