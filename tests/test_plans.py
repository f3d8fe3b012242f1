"""What the plans must look like at any size."""

from pyspark.sql import functions as F

from quillstream.operators import journals as J
from quillstream.operators import nested
from quillstream.operators import search as X
from quillstream.operators import store as S

REFS = "ref_id long, authors array<struct<author:string,affiliation:array<string>>>, publication_types array<string>, keywords array<string>, abstract string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_children_need_no_shuffle_and_read_only_their_columns(spark, tmp_path):
    spark.createDataFrame([(1, [("A", ["u"])], ["t"], ["k"], "long text")], REFS).write.parquet(str(tmp_path / "refs"))
    spark.createDataFrame([(1, '{"title": "x"}', "other")], "rec_id long, payload string, note string").write.parquet(str(tmp_path / "raw"))
    p = plan(nested.children(spark.read.parquet(str(tmp_path / "refs")), spark.read.parquet(str(tmp_path / "raw"))))
    assert "Exchange" not in p and "abstract" not in p and "note" not in p


def test_filters_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "md", "text", 5)], "paper_id long, stem string, ext string, full_text string, n_pages int")
    rows.write.parquet(str(tmp_path / "papers"))
    p = plan(S.first_text(spark.read.parquet(str(tmp_path / "papers")).where("ext = 'md'")))
    assert "PushedFilters: [IsNotNull(ext), EqualTo(ext,md)]" in p and "n_pages" not in p


def test_journal_match_is_a_hash_join(spark):
    js = spark.createDataFrame([("1", "Journal of X", "J X", 1)], "nlmid string, journaltitle string, medabbr string, ord int")
    p = plan(J.match(spark.createDataFrame([(1, "A. J X. 1:2")], "k long, t string"), "k", "t", J.index(js)))
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "WindowGroupLimit" in p


def test_search_divides_without_cross_joins(spark):
    q, index = spark.createDataFrame([("a AND b",)], "query string"), spark.createDataFrame([("a", "1")], "term string, pmid string")
    p = plan(X.unique_hits(q, index))
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_last_wins_combines_before_it_shuffles(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("ord"))
    p = plan(S.last_wins(df, ["k"], "ord"))
    assert p.count("partial_max_by") == 1 and p.count("Exchange hashpartitioning") == 1
