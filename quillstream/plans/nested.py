"""Queries of problem 2 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import nested
from quillstream.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each child of refs and raw_records."""
    return nested.children(table(spark, d, "refs"), table(spark, d, "raw_records")).select("origin", "rec_id", "kind", "parent_pos", "pos")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The same children with their values."""
    return nested.children(table(spark, d, "refs"), table(spark, d, "raw_records"))


def p2_orphans(spark: SparkSession, d: str) -> DataFrame:
    """For each origin, the affiliations and how many of them don't lead to an author (none may)."""
    t = nested.child_tables(table(spark, d, "refs"), table(spark, d, "raw_records"))
    units, names = t["authors.affiliation"], t["authors"]
    both = units.join(names, ["origin", "rec_id", "authors_pos"], "left")
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("affiliations"), F.count_if(F.col("author").isNull()).alias("orphans"))


_LIST = "CASE WHEN {v} IS NULL OR json_type({v}) = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({v}) = 'ARRAY' THEN CAST({v} AS JSON[]) ELSE [{v}] END"
_STR = "CASE WHEN json_type({v}) = 'VARCHAR' THEN json_extract_string({v}, '$') END"
_BLANK = r"({v} IS NULL OR regexp_full_match({v}, '[\s\x0b\p{{Z}}]*'))"


def _sql(pick: str) -> str:
    items = lambda v: _LIST.format(v=v)
    text = lambda v: _STR.format(v=v)
    full = lambda v: "NOT " + _BLANK.format(v=v)
    return f"""
WITH parsed AS (
  SELECT rec_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM raw_records
), rec AS (
  SELECT rec_id, CASE WHEN list_has_any(json_keys(j), ['authors','publication_types','keywords','title','pmid','journal','year']) THEN j
                      WHEN json_type(json_extract(j, '$.record')) = 'OBJECT' THEN json_extract(j, '$.record')
                      ELSE json_extract(j, '$."' || json_keys(j)[1] || '"') END AS r
  FROM parsed WHERE json_type(j) = 'OBJECT'
), ra AS (
  SELECT rec_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS v FROM (SELECT rec_id, {items("json_extract(r, '$.authors')")} AS l FROM rec)
), rn AS (
  SELECT 'raw_records' AS origin, rec_id, i, {text("json_extract(v, '$.author')")} AS name,
         list_transform({items("json_extract(v, '$.affiliation')")}, lambda f: COALESCE({text("f")}, {text("json_extract(f, '$.name')")})) AS units FROM ra
), fa AS (
  SELECT 'refs' AS origin, ref_id AS rec_id, unnest(range(1, len(authors) + 1)) AS i, unnest(authors) AS v FROM refs
), names AS (
  SELECT origin, rec_id, name, units, row_number() OVER (PARTITION BY origin, rec_id ORDER BY i) AS pos
  FROM (SELECT * FROM rn UNION ALL SELECT origin, rec_id, i, v.author, v.affiliation FROM fa) WHERE {full("name")}
), rk AS (
  SELECT rec_id, flatten(list_transform({items("json_extract(r, '$.keywords')")}, lambda k: CASE WHEN json_type(k) = 'OBJECT' THEN {items("json_extract(k, '$.terms')")} ELSE {items("k")} END)) AS l FROM rec
), lists AS (
  SELECT 'raw_records' AS origin, rec_id, 'keyword' AS kind, list_transform(l, lambda x: {text("x")}) AS l FROM rk
  UNION ALL SELECT 'raw_records', rec_id, 'publication_type', list_transform({items("json_extract(r, '$.publication_types')")}, lambda x: {text("x")}) FROM rec
  UNION ALL SELECT 'refs', ref_id, 'keyword', keywords FROM refs
  UNION ALL SELECT 'refs', ref_id, 'publication_type', publication_types FROM refs
  UNION ALL SELECT origin || ':' || pos, rec_id, 'affiliation', units FROM names
), kept AS (
  SELECT origin, rec_id, kind, list_filter(l, lambda x: {full("x")}) AS l FROM lists
), below AS (
  SELECT origin, rec_id, kind, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS value FROM kept
), children AS (
  SELECT origin, rec_id, 'author' AS kind, 0 AS parent_pos, CAST(pos AS INTEGER) AS pos, name AS value FROM names
  UNION ALL
  SELECT split_part(origin, ':', 1), rec_id, kind, CASE WHEN kind = 'affiliation' THEN CAST(split_part(origin, ':', 2) AS INTEGER) ELSE 0 END, CAST(pos AS INTEGER), value FROM below
)
{pick}"""


QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p2_orphans": p2_orphans}
ORACLES = {
    "p2_found": _sql("SELECT origin, rec_id, kind, parent_pos, pos FROM children"),
    "p2_values": _sql("SELECT origin, rec_id, kind, parent_pos, pos, value FROM children"),
    "p2_orphans": _sql("SELECT origin, count(*) AS affiliations, CAST(0 AS BIGINT) AS orphans FROM children WHERE kind = 'affiliation' GROUP BY origin"),
}
