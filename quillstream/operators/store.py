"""The reference store: duplicates, upserts, filling from paper extracts, status events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the row with the highest ``order`` (its values) and the lowest (``first_ord``, its place).

    Partial aggregates keep a hot key to one row for each task. Null keys are a key of their own; ties in
    ``order`` keep one of the tied rows.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v"), F.min(order).alias("first_ord"))
    return best.select(*keys, "_v.*", "first_ord")


def new_ids(batch: DataFrame, store: DataFrame, id_: str, order: str) -> DataFrame:
    """The rows of a batch whose id isn't in the store, each id once (its first row)."""
    first = batch.groupBy(id_).agg(F.min(order).alias(order))
    return first.join(store.select(id_), id_, "left_anti")


def duplicate_events(batch: DataFrame, store: DataFrame, id_: str, order: str) -> DataFrame:
    """Every row of a batch with its status: ``duplicate`` if the id is in the store or came before in the batch, else ``new``."""
    place = F.row_number().over(Window.partitionBy(id_).orderBy(order))
    known = store.select(F.col(id_).alias("_k"), F.lit(True).alias("_in")).distinct()
    rows = batch.withColumn("_n", place).join(known, F.col(id_) == F.col("_k"), "left")
    return rows.withColumn("status", F.when(F.coalesce("_in", F.lit(False)) | (F.col("_n") > 1), "duplicate").otherwise("new")).drop("_n", "_k", "_in")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those with the same key; both have one row for each key."""
    return base.join(new.select(key), key, "left_anti").unionByName(new.select(*base.columns))


def lacks_affiliation(authors: Column) -> Column:
    """True if any author has no affiliation; false without authors."""
    return F.coalesce(F.exists(authors, lambda a: F.coalesce(F.size(a["affiliation"]), F.lit(0)) == 0), F.lit(False))


def lacks_references(references: Column) -> Column:
    return F.coalesce(F.size(references), F.lit(0)) == 0


def incomplete(store: DataFrame) -> DataFrame:
    """Records that lack an affiliation or references, with ``needs_aff`` and ``needs_ref``."""
    flagged = store.withColumns({"needs_aff": lacks_affiliation(F.col("authors")), "needs_ref": lacks_references(F.col("reference_pmids"))})
    return flagged.where("needs_aff or needs_ref")


def fill_affiliations(store: DataFrame, extract: DataFrame, key: str = "ref_id", stem: str = "stem") -> DataFrame:
    """One row for each author of records in ``store``: key, pos, author, affiliation, filled, missing.

    An empty affiliation is filled from the extract of the record's stem, by the exact name; of several authors
    of one name there the last counts. Existing affiliations stay; empty ones fill nothing.
    """
    who = store.select(key, stem, F.posexplode("authors").alias("pos", "a")).select(key, stem, "pos", "a.author", "a.affiliation")
    given = extract.select(F.col(stem).alias("_stem"), F.posexplode("authors").alias("_p", "a")).select("_stem", "_p", F.col("a.author").alias("_author"), F.col("a.affiliation").alias("_given"))
    given = last_wins(given, ["_stem", "_author"], "_p").select("_stem", "_author", "_given")
    both = who.join(given, (F.col(stem) == F.col("_stem")) & (F.col("author") == F.col("_author")), "left")
    empty = F.coalesce(F.size("affiliation"), F.lit(0)) == 0
    has = F.coalesce(F.size("_given"), F.lit(0)) > 0
    return both.select(key, "pos", "author", F.when(empty & has, F.col("_given")).otherwise(F.col("affiliation")).alias("affiliation"), (empty & has).alias("filled"), (empty & ~has).alias("missing"))


def fill_counters(filled: DataFrame, key: str = "ref_id") -> DataFrame:
    """Authors filled and the names still missing, for each record."""
    missing = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("missing"), F.struct("pos", "author")))), lambda x: F.coalesce(x["author"], F.lit("None"))), "|")
    return filled.groupBy(key).agg(F.count_if("filled").alias("affiliations_filled"), missing.alias("affiliations_missing"))


def ingest_status(types: Column, id_: Column) -> Column:
    """struct(status, message) of a fetched record; status is null for a record that is kept."""
    retracted = F.array_contains(types, "Retracted Publication")
    reason = F.when(retracted, "Retracted Publication").when(~F.array_contains(types, "Journal Article"), "not a Journal Article")
    listed = F.concat(F.lit("["), F.array_join(F.transform(types, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    return F.struct(F.when(reason.isNotNull(), "skipped").alias("status"), F.when(reason.isNotNull(), F.concat(F.lit("PMID "), id_, F.lit(": "), reason, F.lit(". PublicationTypes: "), listed)).alias("message"))


def validate(store: DataFrame) -> DataFrame:
    """pmid and status (``retracted``, ``preprint``; a record may have both), one row each."""
    kinds = F.filter(F.array(F.when(F.array_contains("publication_types", "Retracted Publication"), "retracted"), F.when(F.array_contains("publication_types", "Preprint"), "preprint")), lambda x: x.isNotNull())
    return store.select("pmid", F.explode(kinds).alias("status"))


def preprint_candidates(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Search hits (pmid, ord, hit) that are neither the preprint itself nor in the store."""
    return hits.where(F.col("hit") != F.col("pmid")).join(store.select(F.col("pmid").alias("hit")).distinct(), "hit", "left_anti").select("pmid", "ord", "hit")


def first_text(papers: DataFrame, priority: tuple[str, ...] = ("md", "txt"), order: str = "paper_id") -> DataFrame:
    """For each stem the text of the first extension that exists, even if it is empty; of several files the lowest ``order``."""
    rank = F.array_position(F.lit(list(priority)), F.col("ext"))
    best = papers.where(rank > 0).groupBy("stem").agg(F.min_by(F.struct("ext", F.coalesce("full_text", F.lit("")).alias("full_text")), F.struct(rank, F.col(order))).alias("b"))
    return best.select("stem", "b.ext", "b.full_text")


def index_text(store: DataFrame, texts: DataFrame) -> DataFrame:
    """pmid, is_full and the text to index: the paper's own, or title, abstract and keywords where that is empty or missing."""
    both = store.join(texts.select("stem", "full_text"), "stem", "left")
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    kept = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull())
    made = F.concat_ws(" ", F.coalesce("title", F.lit("")), some(F.col("abstract")), some(F.array_join(kept, " ")))
    full = F.coalesce(F.col("full_text"), F.lit("")) != ""
    return both.select("pmid", full.alias("is_full"), F.when(full, F.col("full_text")).otherwise(made).alias("text"))


def latest(refs: DataFrame, columns: list[str]) -> DataFrame:
    """pmid and ``columns`` of the row loaded last for each pmid (of equal times, the highest ref_id)."""
    kept = refs.where(F.coalesce("pmid", F.lit("")) != "").groupBy("pmid")
    return kept.agg(F.max_by(F.struct(*columns), F.struct("loaded_at", "ref_id")).alias("r")).select("pmid", "r.*")


def current(refs: DataFrame) -> DataFrame:
    """The store's view of refs: the ``latest`` row of each pmid, with its ``stem``."""
    from quillstream.functions.text import citation_key

    return latest(refs, [c for c in refs.columns if c != "pmid"]).withColumn("stem", citation_key(F.col("citation_in_text"), F.col("journal"), F.col("pmid")))
