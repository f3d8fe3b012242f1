import random

from quillstream.llm import names as N
from quillstream.llm.triejoin import Trie, bases, neighbours


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def strings(n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices("abc", k=rng.randint(2, 8))) for _ in range(n)})


def test_trie():
    ws = strings(150, 1)
    t = Trie(ws)
    for q in strings(40, 2):
        for most in (0, 1, 2):
            assert sorted(t.near(q, most)) == sorted((w, osa(q, w)) for w in ws if osa(q, w) <= most)
    long = "x" * 20_000
    assert Trie([long, long + "y"]).near(long) == [(long, 0), (long + "y", 1)] or len(Trie([long, long + "y"]).near(long)) == 2


def test_join_is_complete(spark):
    ws = strings(260, 3)
    df = spark.createDataFrame([("k", w) for w in ws] + [("k", None), ("other", ws[0]), ("k", ws[1])], "kind string, t string")
    got = {(r.a, r.b) for r in neighbours(df, "kind", "t").collect()}
    assert got == {(a, b) for a in ws for b in ws if a != b and min(len(a), len(b)) >= 2 and osa(a, b) == 1}
    assert neighbours(df.where("false"), "kind", "t").count() == 0


def test_bases(spark):
    short = spark.createDataFrame([("k", "chen", 50), ("k", "chne", 2), ("k", "chan", 40)], "kind string, t string, n long")
    assert [tuple(r) for r in bases(short, "kind", "t", "n").collect()] == [("k", "chne", "chen")]
    df = spark.createDataFrame([("k", "meyerson", 9), ("k", "meyersen", 2), ("k", "maierson", 4), ("j", "meyersn", 1)], "kind string, t string, n long")
    assert [tuple(r) for r in bases(df, "kind", "t", "n").collect()] == [("k", "meyersen", "meyerson")]


def test_read_name():
    known = Trie(sorted(N._FORMAL))
    want = ("smithson", ["W"], "", ["william"])
    for t in ("William Smithson", "Smithson, Bill", "Smithson, Will", "Dr William Smithson", "Willima Smithson", "SMITHSON, WILLIAM", "William Smithson PhD"):
        assert N.read_name(t, known)[:4] == want, t
    for t in ("Smithson WB", "W. B. Smithson", "Smithson, W. B.", "Smithson W.B.", "SMITHSON WB", "Smithson WB Jr", "Smithson WB MD", "Smíthson WB"):
        assert N.read_name(t, known) == ("smithson", ["W"], "B", [], True), t
    assert N.read_name("William B. Smithson", known) == ("smithson", ["W"], "B", ["william"], False)
    assert N.read_name("Smithson William", known, True)[:4] == want and N.read_name("Smithson, William", known, True) is None is N.read_name("Smithson W", known, True)
    assert N.read_name("Smith-Jones A", known)[0] == "smith-jones"
    for t, first, middle in (("SMITHSON MS", "M", "S"), ("Smithson JR", "J", "R"), ("Smithson DR MD", "D", "R"), ("Dr M Smithson", "M", ""), ("Smithson M Jr", "M", "")):
        assert N.read_name(t, known)[:3] == ("smithson", [first], middle), t
    assert N.read_name("Ted Smithson", known)[1] == ["E", "T"]
    for t in ("Smithson", "", "12", "-"):
        assert N.read_name(t, known) is None or N.read_name(t, known)[0]


def test_people(spark):
    rows = ["Smithson WB", "Smithson W", "Bill Smithson", "Walter Smithson", "Smithson, W. C.", "Smihtson WB", "Jonesson A", "Smithson WB", "Smithson WB", None, " ", "Smithson"]
    got = {(r.name_a, r.name_b) for r in N.person_pairs(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert ("Smihtson WB", "Smithson WB") in got and ("Bill Smithson", "Smithson WB") in got and ("Smithson W", "Smithson WB") in got
    assert ("Smithson WB", "Smithson, W. C.") not in got and ("Bill Smithson", "Walter Smithson") not in got
    assert all(a < b for a, b in got) and not any("Jonesson A" in p for p in got)
    assert N.person_pairs(spark.createDataFrame([], "name string")).count() == 0
    long = [("x" * 50_000 + " AB",), ("x" * 50_000 + " A",), ("A" * 50_000,), ("Smith " * 9_000,)]
    assert {(len(r.name_a), len(r.name_b)) for r in N.person_pairs(spark.createDataFrame(long, "name string")).collect()} == {(50_002, 50_003)}


def test_order_follows_from_names_whose_order_is_plain(spark):
    rows = ["Smithson WB"] * 3 + ["Smithson William", "William Smithson", "Smithson, William", "Taylor Jordanson", "Jordanson Taylor"]
    got = {(r.name_a, r.name_b) for r in N.person_pairs(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    own = ["Smithson WB", "Smithson William", "William Smithson", "Smithson, William"]
    assert got == {(a, b) for a in own for b in own if a < b}


def test_links_are_counted_by_classes(spark):
    rows = ["Smithson WB", "Smithson, W. B.", "Smithson W", "Smithson WC", "Jonesson A"]
    members, links = N.person_classes(spark.createDataFrame([(r,) for r in rows], "name string"))
    n = {r.name: r.links for r in N.linked(members, links).collect()}
    assert n == {"Smithson WB": 2, "Smithson, W. B.": 2, "Smithson W": 3, "Smithson WC": 1, "Jonesson A": 0}


def test_units(spark):
    same = [
        "Department of Cell Imaging, Foobarton General Hospital, Foobarton, Norvania.", "Dept. of Cell Imaging, Foobarton Gen Hosp, Foobarton, Norvania", "Cell Imaging, General Hospital of Foobarton",
        "Norvania, Foobarton: Foobarton General Hospital (Cell Imaging)", "DEPARTMENT OF CELL IMAGING, FOOBARTON GENERAL HOSPITAL, FOOBARTON, NORVANIA.", "1 Department of Cell Imagign, Foobarton General Hospital, 12345 Foobarton, Norvania.",
        "Foobarton General Hospital, Department of Cell Imaging, Foobarton, Norvania", "From the Department of Cell Imaging, Foobarton General Hospital, Foobarton.",
    ]
    other = ["Department of Cell Imaging, University of Foobarton, Foobarton, Norvania.", "Department of Cell Biology, Foobarton General Hospital, Foobarton, Norvania.", "Department of Cell Imaging, Bazquxville General Hospital, Bazquxville, Norvania."]
    rows = [same[0]] * 5 + same + [o for o in other for _ in range(4)] + ["", None, "nothing"]
    got = {(r.name_a, r.name_b) for r in N.unit_pairs(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert got == {(a, b) for a in same for b in same if a < b}
