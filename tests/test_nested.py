import json

from pyspark.sql import functions as F

from quillstream.operators import nested

REFS = "ref_id long, authors array<struct<author:string,affiliation:array<string>>>, publication_types array<string>, keywords array<string>, title string"
RAW = "rec_id long, payload string"


def rows(df):
    return sorted(tuple(r) for r in df.select("origin", "rec_id", "kind", "parent_pos", "pos", "value").collect())


def test_refs_blanks_nulls_and_order(spark):
    refs = spark.createDataFrame(
        [
            (1, [("A B", ["x", "", None, "y"]), ("  ", ["lost"]), (None, ["lost"]), ("C D", None)], ["t1", None, "t1"], ["k", " "], "t"),
            (2, None, None, None, None),
            (3, [], [], [], ""),
        ],
        REFS,
    )
    got = rows(nested.children(refs, spark.createDataFrame([], RAW)))
    assert got == sorted(
        [
            ("refs", 1, "author", 0, 1, "A B"),
            ("refs", 1, "author", 0, 2, "C D"),
            ("refs", 1, "affiliation", 1, 1, "x"),
            ("refs", 1, "affiliation", 1, 2, "y"),
            ("refs", 1, "publication_type", 0, 1, "t1"),
            ("refs", 1, "publication_type", 0, 2, "t1"),
            ("refs", 1, "keyword", 0, 1, "k"),
        ]
    )


def test_payload_shapes(spark):
    rec = {"title": "t", "authors": {"author": "Solo", "affiliation": "u"}, "keywords": [["a"], ["b", " "], {"list": "own", "terms": ["c"]}, "d"], "publication_types": "One"}
    payloads = [
        (1, json.dumps(rec)),
        (2, json.dumps({"123": rec})),
        (3, json.dumps({"record": rec, "meta": {"batch": 1}})),
        (4, '{"broken": '),
        (5, None),
        (6, "[1, 2]"),
        (7, json.dumps({"authors": [{"author": "X", "affiliation": [{"name": "n", "ids": []}, {"ids": []}, "m", None]}, {"affiliation": ["lost"]}, "Y"], "keywords": None})),
        (8, "{}"),
        (9, ""),
        (10, '{"authors": [{"author": "Z"}]} trailing'),
    ]
    got = rows(nested.children(spark.createDataFrame([], REFS), spark.createDataFrame(payloads, RAW)))
    for i in (1, 2, 3):
        own = [r[2:] for r in got if r[1] == i]
        assert own == sorted([("author", 0, 1, "Solo"), ("affiliation", 1, 1, "u"), ("publication_type", 0, 1, "One"), *[("keyword", 0, n + 1, k) for n, k in enumerate("abcd")]])
    assert [r[2:] for r in got if r[1] == 7] == sorted([("author", 0, 1, "X"), ("author", 0, 2, "Y"), ("affiliation", 1, 1, "n"), ("affiliation", 1, 2, "m")])
    assert {r[1] for r in got} == {1, 2, 3, 7}


def test_flatten_keeps_links(spark):
    df = spark.createDataFrame([(7, [([("p", [1, 2])], "o1"), (None, "o2")])], "id long, a array<struct<b:array<struct<n:string,c:array<int>>>,o:string>>")
    t = nested.flatten(df, "id")
    assert set(t) == {"a", "a.b", "a.b.c"}
    assert [tuple(r) for r in t["a"].drop("row_id", "parent_id").orderBy("a_pos").collect()] == [(7, 1, "o1"), (7, 2, "o2")]
    assert [tuple(r) for r in t["a.b.c"].drop("row_id", "parent_id").orderBy("a_b_c_pos").collect()] == [(7, 1, 1, 1, 1), (7, 1, 1, 2, 2)]


def test_surrogate_keys_lead_to_parents(spark):
    df = spark.createDataFrame([(7, [([("p", [1, 2])], "o1"), ([("q", [3])], "o2")]), (8, [([("p", [])], "o1")])], "id long, a array<struct<b:array<struct<n:string,c:array<int>>>,o:string>>")
    t = nested.flatten(df, "id")
    ids = {n: [r.row_id for r in x.collect()] for n, x in t.items()}
    assert all(len(set(v)) == len(v) for v in ids.values()) and len({x for v in ids.values() for x in v}) == 3 + 3 + 3
    assert {r.parent_id for r in t["a.b.c"].collect()} <= set(ids["a.b"]) and {r.parent_id for r in t["a.b"].collect()} == set(ids["a"])
    assert {r.parent_id for r in t["a"].collect()} == {"7", "8"}


def test_merged_schema(spark):
    df = spark.createDataFrame([(1, '{"1": {"title": "a", "authors": [{"author": "x"}]}}'), (2, '{"title": "3", "authors": {"author": "x", "affiliation": ["u", {"name": "n"}]}}'), (3, "no"), (4, '{"title": "b", "authors": null, "keywords": [["a"], "b"]}')], RAW)
    got = nested.merged_schema(df, "payload")
    assert got.simpleString() == "struct<title:string,authors:array<struct<author:string,affiliation:array<struct<name:string,value:string>>>>,keywords:array<struct<value:string,items:array<string>>>>"
    assert nested.infer(df.where("rec_id = 3"), "payload") == {} == nested.infer(df.where("false"), "payload")


def test_fields_nobody_knew_are_kept(spark):
    """A new nested field, at two depths and with one element in place of a list, becomes a table that leads to its author."""
    rec = {"title": "t", "authors": [{"author": " "}, {"author": "A", "grants": [{"agency": "X", "years": [1, "2001"]}, {"agency": "Y", "years": "2002"}]}, {"author": "B", "grants": {"agency": "Z"}, "orcid": "0-1"}]}
    refs = spark.createDataFrame([(5, [("C", ["u"])], [], [], "t")], REFS)
    t = nested.child_tables(refs, spark.createDataFrame([(1, json.dumps(rec)), (2, "{")], RAW))
    assert {"authors", "authors.affiliation", "authors.grants", "authors.grants.years", "keywords", "publication_types"} <= set(t)
    assert sorted((r.rec_id, r.authors_pos, r.authors_grants_pos, r.agency) for r in t["authors.grants"].collect()) == [(1, 1, 1, "X"), (1, 1, 2, "Y"), (1, 2, 1, "Z")]
    assert sorted((r.authors_grants_pos, r.value) for r in t["authors.grants.years"].where("value is not null").collect()) == [(1, "2001"), (2, "2002")]
    assert sorted((r.origin, r.author, r.orcid) for r in t["authors"].collect()) == [("raw_records", "A", None), ("raw_records", "B", "0-1"), ("refs", "C", None)]
    up = t["authors"].select(F.col("row_id").alias("parent_id"))
    assert t["authors.grants"].join(up, "parent_id", "left_anti").count() == 0


def test_tables_and_single_pass_agree(spark):
    """``children`` in one pass has the rows of the tables of ``flatten``."""
    rec = {"authors": [{"author": "A", "affiliation": ["x", {"name": "y"}, " "]}, "B"], "keywords": [["a", "b"], {"terms": ["c"]}, "d"], "publication_types": "P"}
    refs = spark.createDataFrame([(1, [("C", ["u", None]), (None, ["lost"])], ["T"], ["k"], "t")], REFS)
    raw = spark.createDataFrame([(1, json.dumps(rec)), (1, json.dumps(rec)), (2, json.dumps({"9": rec}))], RAW)
    t = nested.child_tables(refs, raw)
    value = {"authors": "author", "authors.affiliation": "name"}
    tables = sorted((r.origin, r.rec_id, k, r.authors_pos if n == "authors.affiliation" else 0, r[n.replace(".", "_") + "_pos"], r[value.get(n, "value")]) for n, k in nested.KINDS.items() for r in t[n].collect())
    assert tables == rows(nested.children(refs, raw)) and len(tables) == 4 + 3 * 9


def test_blank_matches_white_space(spark):
    got = spark.createDataFrame([(" \t ",), ("",), (None,), ("a",)], "x string").select(nested.blank(F.col("x"))).collect()
    assert [r[0] for r in got] == [True, True, True, False]
