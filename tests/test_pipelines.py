import json

import pytest
from pyspark.sql import functions as F

from quillstream.plans import pipelines as P
from tests.test_xml import GOOD

JOURNALS = "nlmid string, journaltitle string, medabbr string, ord int"


def service(n_of):
    """Records of ids: 1 and 2 are articles, 3 is retracted, 4 can't be fetched, 5 is broken."""

    def get(ids):
        n_of.extend(r.id for r in ids.collect())
        xml = F.when(F.col("id") == "5", "junk").otherwise(F.replace(F.replace(F.lit(GOOD), F.lit('"pubmed">11<'), F.concat(F.lit('"pubmed">'), "id", F.lit("<"))), F.lit("<PublicationType>Journal Article"), F.when(F.col("id") == "3", "<PublicationType>Retracted Publication</PublicationType><PublicationType>Journal Article").otherwise("<PublicationType>Journal Article")))
        return ids.select("id", F.when(F.col("id") != "4", xml).alias("xml"), F.when(F.col("id") == "4", "OSError: down").alias("error"))

    return get


def test_collection(spark, tmp_path):
    root, asked = str(tmp_path), []
    (tmp_path / "papers").mkdir()
    (tmp_path / "papers" / "Smith & Jones 1999 J X 1.pdf").write_bytes(b"%PDF")
    events = P.ingest(spark, root, ["https://x.org/1/", "2", "3", "4", "5", "2"], service(asked)).collect()
    assert sorted((r.id, r.status) for r in events) == [("1", "stored"), ("2", "duplicate"), ("2", "stored"), ("3", "skipped"), ("4", "error"), ("5", "error")]
    assert sorted(asked) == ["1", "2", "3", "4", "5"]
    s = {r.pmid: r for r in P.store(spark, root).collect()}
    assert set(s) == {"1", "2"} and [a.affiliation for a in s["1"].authors] == [[], []] and s["1"].ord < s["2"].ord
    assert "Smith & Jones 1999 J X 2" in "".join(r.value for r in spark.read.text(f"{root}/temp_refs").collect())
    assert [r.status for r in P.ingest(spark, root, ["1"], service(asked)).collect()] == ["duplicate"]

    kinds = {(r.id, r.status) for r in P.validate(spark, root, service(asked)).collect()}
    assert kinds == set()

    (tmp_path / "papers" / "Smith & Jones 1999 J X 1.json").write_text(json.dumps({"authors": [{"author": "Smith AB", "affiliation": ["U1"]}], "references": ["Smith AB. (1999). On E coli more. J X. 2:5."]}))
    js = spark.createDataFrame([("1", "Journal of X", "J X", 1)], JOURNALS)
    base = P.store(spark, root)
    P.publish(base.withColumn("reference_pmids", F.array().cast("array<string>")), root)
    answers = lambda q: q.select("query", F.lit(1).cast("long").alias("hits"), F.lit("77").alias("pmid"))
    report = {r.pmid: r for r in P.merge(spark, root, js, answers).collect()}
    assert report["1"].affiliations_filled == 1 and report["1"].affiliations_missing == "Jones" and report["1"].references_resolved == 1
    assert report["2"].error == "file not found: papers/Smith & Jones 1999 J X 2.json"
    s = {r.pmid: r for r in P.store(spark, root).collect()}
    assert s["1"].reference_pmids == ["77"] and s["1"].authors[0].affiliation == ["U1"] and s["2"].reference_pmids == []

    assert not (tmp_path / "merge_log").exists()
    P.publish(P.store(spark, root).withColumn("reference_pmids", F.array().cast("array<string>")), root)
    nothing = lambda q: q.select("query", F.lit(0).cast("long").alias("hits"), F.lit(None).cast("string").alias("pmid"))
    P.merge(spark, root, js, nothing)
    log = [json.loads(r.value) for r in spark.read.text(f"{root}/merge_log").collect()]
    assert [(x["pmid"], x["file"]) for x in log] == [("1", "papers/Smith & Jones 1999 J X 1.json")] and "step 2" in log[0]["warnings"][0]

    with pytest.raises(FileNotFoundError):
        P.query_index(spark, root, "mice")
    (tmp_path / "papers" / "Smith & Jones 1999 J X 2.md").write_text("mice and men " * 30)
    (tmp_path / "papers" / "Smith & Jones 1999 J X 1.txt").write_text("other words of a paper " * 30)
    assert {(r.is_full, r.papers) for r in P.build_index(spark, root).collect()} == {(True, 2)}
    assert [r.pmid for r in P.query_index(spark, root, "mice men").collect()][0] == "2"


def test_empty_collection(spark, tmp_path):
    assert P.store(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        P.build_index(spark, str(tmp_path))
    from quillstream.cli import main

    assert main([str(tmp_path), "search", "x"]) == 1
