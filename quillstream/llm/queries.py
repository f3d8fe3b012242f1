"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import canonical, linkage, mixing, names, packing, scans, split, truncation, vectors
from quillstream.session import cut, table


def p1_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every row of refs with the list entry that its journal means, and how it was found."""
    return canonical.journals_of(table(spark, d, "refs"), table(spark, d, "journals"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose journal isn't in the list as typed but means an entry."""
    return p1_mapped(spark, d).where("status = 'mapped'").select("ref_id", "nlmid").distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that mean no entry, with their rows."""
    return canonical.unmatched(table(spark, d, "refs"), table(spark, d, "journals"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every paper and abstract."""
    return split.corpus_pieces(table(spark, d, "papers"), table(spark, d, "refs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that came out in several pieces."""
    return p3_pieces(spark, d).where((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select("origin", "item_id")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar vectors of each vector, one row each."""
    near = vectors.neighbours(table(spark, d, "chroma_db"))
    return near.select("vec_id", F.posexplode("near").alias("rank", "n")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("near_id"), "n.cosine")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbours with a cosine of at least 0.9."""
    return vectors.pairs(vectors.neighbours(table(spark, d, "chroma_db")))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """The recall of the index against brute force."""
    all_ = table(spark, d, "chroma_db")
    return vectors.recall(all_, vectors.neighbours(all_))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Flawed lines of scanned papers."""
    return scans.flaws(table(spark, d, "papers"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every paper as continuous paragraphs."""
    return scans.repaired(table(spark, d, "papers"))


def p6_linked(spark: SparkSession, d: str) -> DataFrame:
    """Cited works with the record that is the same publication, and the confidence."""
    return linkage.link(table(spark, d, "cited_works"), table(spark, d, "refs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The same without confidence."""
    return p6_linked(spark, d).select("pmid", "cite_id").distinct()


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """The recall of the candidates against brute force."""
    return linkage.recall(table(spark, d, "cited_works"), table(spark, d, "refs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one author or one organisational unit."""
    return names.variant_pairs(table(spark, d, "refs")).distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its container."""
    return packing.pack_documents(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p8_packed(spark, d))


def p9_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The texts drawn and how often each is used."""
    targets = table(spark, d, "mix_targets")
    return mixing.draw(mixing.texts_of(table(spark, d, "documents"), targets), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    targets = table(spark, d, "mix_targets")
    texts = cut(mixing.texts_of(table(spark, d, "documents"), targets))
    return mixing.shares(mixing.draw(texts, targets), texts, targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.detect(table(spark, d, "documents")).where("truncated").select("doc_id").distinct()


def p10_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.by_source(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_mapped": p1_mapped, "p1_unmatched": p1_unmatched, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p6_linked": p6_linked, "p6_recall": p6_recall, "p7_found": p7_found, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_drawn": p9_drawn, "p9_shares": p9_shares, "p10_found": p10_found, "p10_by_source": p10_by_source, "p3_found": p3_found, "p3_pieces": p3_pieces}

_ITEMS = "SELECT 'papers' AS origin, paper_id AS item_id, full_text AS t FROM papers UNION ALL SELECT 'refs', ref_id, abstract FROM refs"
ORACLES = {"p3_found": rf"SELECT origin, item_id FROM ({_ITEMS}) WHERE len(regexp_extract_all(t, '[^ \t\n\r\f]+')) > 400"}
