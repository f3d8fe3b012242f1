from quillstream.operators import store as S


def test_last_wins_keeps_first_place(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), (None, 4, "n")], "k string, ord int, v string")
    got = {r.k: (r.v, r.first_ord) for r in S.last_wins(df, ["k"], "ord").collect()}
    assert got == {"a": ("z", 1), "b": ("y", 2), None: ("n", 4)}


def test_duplicates(spark):
    batch = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p"), (4, "s")], "ord int, id string")
    store = spark.createDataFrame([("s",), ("s",)], "id string")
    assert {(r.id, r.ord) for r in S.new_ids(batch, store, "id", "ord").collect()} == {("p", 1), ("q", 2)}
    assert {r.ord: r.status for r in S.duplicate_events(batch, store, "id", "ord").collect()} == {1: "new", 2: "new", 3: "duplicate", 4: "duplicate"}


def test_upsert(spark):
    a = spark.createDataFrame([("1", "old"), ("2", "kept")], "k string, v string")
    b = spark.createDataFrame([("1", "new"), ("3", "added")], "k string, v string")
    assert {tuple(r) for r in S.upsert(a, b, "k").collect()} == {("1", "new"), ("2", "kept"), ("3", "added")}
    assert S.upsert(a, b.where("false"), "k").count() == 2


AUTHORS = "array<struct<author:string,affiliation:array<string>>>"


def test_fill(spark):
    store = spark.createDataFrame([(1, "s", [("A", []), ("B", ["own"]), ("C", None), ("A", None)])], f"ref_id long, stem string, authors {AUTHORS}")
    extract = spark.createDataFrame([("s", [("A", ["first"]), ("A", ["last"]), ("B", ["other"]), ("C", [])])], f"stem string, authors {AUTHORS}")
    f = S.fill_affiliations(store, extract)
    assert {(r.pos, tuple(r.affiliation or ())) for r in f.collect()} == {(0, ("last",)), (1, ("own",)), (2, ()), (3, ("last",))}
    c = S.fill_counters(f).first()
    assert (c.affiliations_filled, c.affiliations_missing) == (2, "C")


def test_first_text_prefers_markdown_even_empty(spark):
    rows = [(1, "s", "txt", "plain"), (2, "s", "md", ""), (3, "t", "txt", "only"), (4, "u", "pdf", "no"), (5, "t", "txt", "later")]
    t = S.first_text(spark.createDataFrame(rows, "paper_id long, stem string, ext string, full_text string"))
    assert {r.stem: (r.ext, r.full_text) for r in t.collect()} == {"s": ("md", ""), "t": ("txt", "only")}
    store = spark.createDataFrame([("1", "s", "T", "A", ["k", None]), ("2", "t", "T", None, None), ("3", "none", "T", "", [])], "pmid string, stem string, title string, abstract string, keywords array<string>")
    got = {r.pmid: (r.is_full, r.text) for r in S.index_text(store, t).collect()}
    assert got == {"1": (False, "T A k"), "2": (True, "only"), "3": (False, "T")}


def test_status(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("1", ["Journal Article"]), ("2", ["Journal Article", "Retracted Publication"]), ("3", ["Letter"])], "id string, t array<string>")
    got = {r.id: r.s for r in df.select("id", S.ingest_status(F.col("t"), F.col("id")).alias("s")).collect()}
    assert got["1"].status is None
    assert got["2"].message == "PMID 2: Retracted Publication. PublicationTypes: ['Journal Article', 'Retracted Publication']"
    assert got["3"].message == "PMID 3: not a Journal Article. PublicationTypes: ['Letter']"
