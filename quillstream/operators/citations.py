"""Whole citations parsed to query groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import citation as C
from quillstream.operators.journals import match
from quillstream.session import cut


def parse(citations: DataFrame, key: str, text: str, idx: DataFrame) -> DataFrame:
    """key, groups: the query groups of each citation, null where no journal is found in it.

    Authors and the year behind them are split off, noise and links dropped, and the journal is looked for in the rest;
    where it could only match with words that the authors took, the whole citation is tried, and the year is
    read anew. Citations that are null have null groups; ``key`` must be unique.
    """
    read = citations.select(F.col(key), F.col(text).alias("_c")).withColumn("_a", C.authors_of(F.col("_c")))
    split = read.withColumn("_y", C.year_after_authors(C.strip_noise(F.col("_a.rest"))))
    rows = cut(split.select(key, "_c", F.col("_a.query_names").alias("_names"), F.col("_y.year").alias("_year"), C.strip_links(F.col("_y.rest")).alias("_rest")))
    first = cut(match(rows, key, "_rest", idx))
    again = rows.join(first.where("partial").select(key), key, "left_semi").withColumn("_whole", C.strip_noise(C.strip_links(F.col("_c"))))
    second = match(again, key, "_whole", idx).where("journal is not null").select(key, "title", "journal", "numbers", F.lit(True).alias("_again"))
    found = first.where("journal is not null").select(key, "title", "journal", "numbers", F.lit(False).alias("_again")).unionByName(second)
    both = rows.join(found, key, "left")
    groups = C.query_groups(F.col("_names"), F.when(~F.col("_again"), F.col("_year")), F.col("journal"), F.col("title"), F.col("numbers"))
    return both.select(key, F.when(F.col("journal").isNotNull(), groups).alias("groups"))
