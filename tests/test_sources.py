import json

from pyspark.sql import functions as F

from quillstream.sources import files, pdf
from quillstream.sources.remote import RecordSource, SearchSource


def fake(url: str) -> str:
    if "id=2&" in url:
        raise OSError("down")
    if "esearch" in url:
        return "<r><Count>2</Count><IdList><Id>7</Id><Id>8</Id></IdList></r>"
    return f"<x>{url.rpartition('id=')[2].split('&')[0]}</x>"


def test_remote(spark):
    spark.dataSource.register(RecordSource)
    spark.dataSource.register(SearchSource)
    opts = {"transport": "tests.test_sources:fake", "spacing": "0"}
    got = {r.id: (r.xml, r.error) for r in spark.read.format("citation_records").options(ids="1, 2,3", partitions="2", **opts).load().collect()}
    assert got == {"1": ("<x>1</x>", None), "2": (None, "OSError: down"), "3": ("<x>3</x>", None)}
    s = spark.read.format("citation_search").options(queries="a b\n\nc", **opts).load().collect()
    assert {(r["query"], r.hits, tuple(r.ids)) for r in s} == {("a b", 2, ("7", "8")), ("c", 2, ("7", "8"))}
    assert spark.read.format("citation_records").options(ids="", **opts).load().count() == 0


def test_journal_text(spark):
    text = "----\nJrId: 1\nJournalTitle: A: B\nMedAbbr: A B\nNlmId: 7\n  ---\nMedAbbr: \nNlmId: 8\nNlmId: 9\n"
    got = [tuple(r)[:3] for r in files.parse_journals(spark.createDataFrame([(text,)], "value string")).orderBy("ord").collect()]
    assert got == [("7", "A: B", "A B"), ("9", "", "")]
    assert files.parse_journals(spark.createDataFrame([("",)], "value string")).count() == 0


def test_store_round_trip(spark, tmp_path):
    rec = {"title": "é \"q\"", "journal": "J", "authors": [{"author": "A", "affiliation": ["u", "v"]}], "publication_types": ["x", "y, z"], "keywords": [], "references": ["1"]}
    src = tmp_path / "refs.json"
    src.write_text(json.dumps({"10": rec, "2": rec}))
    df = files.read_store(spark, str(src))
    assert [r.pmid for r in df.orderBy("ord").collect()] == ["10", "2"]
    out = tmp_path / "out.json"
    files.write_store(df, str(out))
    text = out.read_text()
    assert '"publication_types": [ "x", "y, z" ]' in text and '"references": [ "1" ]' in text and "é" in text and text.endswith("}\n")
    back = json.loads(text)
    assert list(back) == ["10", "2"] and back["10"]["authors"] == rec["authors"] and back["10"]["publication_types"] == rec["publication_types"]
    assert files.read_store(spark, str(tmp_path / "none.json")).count() == 0
    files.write_store(df.where("false"), str(out))
    assert json.loads(out.read_text()) == {}


def test_a_written_store_is_read_record_by_record(spark, tmp_path):
    """Records with all that could look like the end of one; several tasks read the file, and none gets it as one row."""
    odd = ["\n  },\n", "{", '}\\"', "\r é\u2028", ""]
    rec = lambda i: {"title": odd[i % 5] * (i % 3) + str(i), "authors": [{"author": odd[i % 5], "affiliation": []}] * (i % 3), "keywords": odd[: i % 6]}
    src, out = tmp_path / "src.json", str(tmp_path / "out.json")
    want = {f'{i}"{odd[i % 5]}': rec(i) for i in range(200)}
    src.write_text(json.dumps(want))
    files.write_store(files.read_store(spark, str(src)), out)
    wide = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        back = files.read_store(spark, out)
        got = back.orderBy("ord").collect()
        assert [r.pmid for r in got] == list(want)
        assert all(r.asDict(recursive=True)[k] == v for r, w in zip(got, want.values()) for k, v in w.items())
        assert back.rdd.getNumPartitions() > 3 and "wholetext" not in back._jdf.queryExecution().toString()
        each = spark.read.text(out, lineSep=files._RECORD_END)
        assert each.count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", wide)
    nested = tmp_path / "hand.json"
    nested.write_text('{\n  "1": {"title": "a"}, "2": {\n    "title": "b"\n  }\n}\n')
    assert [(r.pmid, r.title) for r in files.read_store(spark, str(nested)).orderBy("ord").collect()] == [("1", "a"), ("2", "b")]


def test_texts_extracts_journals(spark, tmp_path):
    (tmp_path / "A et al. 1999 J 1.md").write_text("# T\n")
    (tmp_path / "B 2000 J+K 2.txt").write_text("")
    (tmp_path / "A et al. 1999 J 1.json").write_text(json.dumps({"authors": [{"author": "A", "affiliation": ["u"]}], "references": ["r"]}))
    assert {(r.stem, r.ext, r.full_text) for r in files.read_texts(spark, str(tmp_path)).collect()} == {("A et al. 1999 J 1", "md", "# T\n"), ("B 2000 J+K 2", "txt", "")}
    assert [(r.stem, r.references) for r in files.read_extracts(spark, str(tmp_path)).collect()] == [("A et al. 1999 J 1", ["r"])]
    (tmp_path / "j.list").write_text(json.dumps({"7": {"JournalTitle": "T", "MedAbbr": "M"}}))
    assert [tuple(r) for r in files.read_journals(spark, str(tmp_path / "j.list")).collect()] == [("7", "T", "M", 0)]


def test_pdfs(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\nBT (Hello \\(x\\)) Tj ET")
    (tmp_path / "b.pdf").write_bytes(b"junk")
    pdfs = files.read_pdfs(spark, [str(tmp_path / "a.pdf"), str(tmp_path / "b.pdf"), str(tmp_path / "missing.pdf")])
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.convert_pdfs(pdfs, pdf.plain_pdf_text).collect()}
    assert got == {"a.pdf": ("Hello (x)", None), "b.pdf": (None, "ValueError: no PDF")}
    got = files.convert_pdfs(pdfs.where(F.col("path").endswith("a.pdf")), pdf.plain_pdf_text, lambda b: "other").first()
    assert got.text == "other"
    assert files.read_pdfs(spark, ["/nowhere.pdf"]).count() == 0


def test_stream_into_store(spark, tmp_path):
    from quillstream.streaming.ingest import into_store, read_store

    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "pmid string, loaded_at timestamp, title string"
    assert read_store(spark, store) is None
    put = lambda rows: spark.createDataFrame(rows, "pmid string, loaded_at string, title string").withColumn("loaded_at", F.to_timestamp("loaded_at")).coalesce(1).write.mode("append").parquet(src)
    for rows in ([("1", "2020-01-02", "b"), ("2", "2020-01-01", "x"), ("1", "2020-01-01", "a")], [("1", "2019-01-01", "late"), ("3", "2020-01-01", "new"), ("2", "2021-01-01", "y")]):
        put(rows)
        into_store(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "ck")).awaitTermination()
    assert {(r.pmid, r.title) for r in read_store(spark, store).collect()} == {("1", "b"), ("2", "y"), ("3", "new")}


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    import pytest

    from quillstream.streaming import ingest as I

    store = str(tmp_path / "store")
    rows = lambda xs: spark.createDataFrame(xs, "pmid string, title string")
    assert I.read_store(spark, store) is None
    I.put(rows([(str(i), "a") for i in range(50)]), store, buckets=8)
    first = I.manifest(spark, store)
    I.put(rows([("7", "b"), ("new", "c")]), store, buckets=8)
    second = I.manifest(spark, store)
    assert second["version"] == 2 and 1 <= sum(second["buckets"][b] == 2 for b in second["buckets"]) <= 2 and second["of"] == first["of"] == 8
    got = {r.pmid: r.title for r in I.read_store(spark, store).collect()}
    assert len(got) == 51 and got["7"] == "b" and got["new"] == "c" and got["8"] == "a"
    # a writer that fails before its manifest leaves the store as it was; the next one takes its place
    (tmp_path / "store" / "data" / "v=3").mkdir()
    assert {r.pmid: r.title for r in I.read_store(spark, store).collect()} == got
    I.put(rows([]), store)
    assert I.manifest(spark, store) == second
    with pytest.raises(FileExistsError):
        I._publish(spark, store, second)
    for k in range(4):
        I.put(rows([("7", f"x{k}")]), store)
    assert len(I._versions(spark, store)) == I.KEPT and {r.pmid: r.title for r in I.read_store(spark, store).collect()} == got | {"7": "x3"}
    I.replace(rows([]), store)
    assert I.read_store(spark, store).columns == ["pmid", "title"] and I.read_store(spark, store).count() == 0


def test_pdf_extractor():
    import zlib

    page = b"BT /F1 20 Tf 72 700 Td (A Title) Tj /F1 10 Tf 0 -30 Td [(Wo) -20 (rds) -300 (of)] TJ 0 -12 Td (the first \\(para\\)graph.) Tj 0 -40 Td <FEFF00E900740065> Tj ET"
    packed = zlib.compress(page)
    content = b"%%PDF-1.5\n1 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream endobj\n2 0 obj << >> stream\nq 1 0 0 1 0 0 cm Q\nendstream"
    assert pdf.plain_pdf_text(content) == "A Title\nWords of\nthe first (para)graph.\n\u00e9te"
    assert pdf.pdf_markdown(content) == "# A Title\n\nWords of the first (para)graph.\n\n\u00e9te\n"
    assert pdf.pdf_markdown(b"%PDF-1.4\n") == "" == pdf.plain_pdf_text(b"%PDF-1.4\n")


def test_markdown_beside_the_file_and_the_command(spark, tmp_path, capsys):
    from quillstream.cli import main

    line = b"(Hello of some words that are many) Tj T*\n"
    (tmp_path / "a b.pdf").write_bytes(b"%PDF-1.4\n<< >>\nstream\nBT 12 TL\n" + line * 200 + b"ET\nendstream")
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    assert main([str(tmp_path), "convert", str(tmp_path / "a b.pdf"), str(tmp_path / "bad.pdf"), str(tmp_path / "none.pdf")]) == 0
    said = capsys.readouterr()
    assert "File not found:" in said.err and "none.pdf" in said.err and "ValueError: no PDF" in said.out
    assert (tmp_path / "a b.md").read_text().count("Hello") == 200 and not (tmp_path / "bad.md").exists()


def test_distributed_requests(spark):
    from quillstream.sources.remote import fetch_records, search_all

    ids = spark.createDataFrame([(str(i),) for i in (1, 2, 3)], "id string")
    got = {r.id: (r.xml, r.error) for r in fetch_records(ids, "tests.test_sources:fake", 0.0, partitions=2).collect()}
    assert got == {"1": ("<x>1</x>", None), "2": (None, "OSError: down"), "3": ("<x>3</x>", None)}
    s = search_all(spark.createDataFrame([("a b",)], "query string"), 2, "tests.test_sources:fake", 0.0).first()
    assert (s["query"], s.hits, s.ids, s.error) == ("a b", 2, ["7", "8"], None)


def test_encoder_gets_batches(spark):
    from quillstream.operators import vector as V

    def make():
        return lambda texts: [[float(len(texts))]] * len(texts)

    rows = spark.createDataFrame([(i, "t") for i in range(10)], "k long, t string").coalesce(1)
    assert sorted(r.embedding[0] for r in V.encode(rows, "t", make, 4).collect()) == [2.0] * 2 + [4.0] * 8
    assert V.best_device() in ("cpu", "cuda", "mps")
