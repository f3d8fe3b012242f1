from quillstream.llm import scans as S

PAGE = """Smith et al. 1999   11
Effect of things on other things in mice

Patients were measured with a new instrument which was a com-
plete success in all of the hospital departments that took
Reproduced by the library copy service
Smith et al. 1999   12
part in the study. The rneasured values were small and the
long-
term follow up of the patients was good in every hospital.
847   363
251
Another paragraph was written by the hospital which follows
the first one and has m0nths of small values to be measured
Reproduced by the library copy service
Smith et al. 1999   13
by the patients of the complete study."""


def corpus(spark):
    plain = "Patients were measured in the complete study. The small values of the hospital were measured over months. Long-term study of months. "
    rows = [(1, "Smith et al. 1999 J Things 5", PAGE), (2, "x 2000 J 6", "# Title\n\n" + plain * 20), (3, None, plain * 30), (4, "y", None), (5, "z", "")]
    return spark.createDataFrame(rows, "paper_id long, stem string, full_text string")


def test_flaws(spark):
    got = {(r.paper_id, r.line_no, r.kind) for r in S.flaws(corpus(spark)).collect()}
    assert got == {
        (1, 1, "header"), (1, 4, "hyphen"), (1, 6, "header"), (1, 7, "header"), (1, 8, "ocr"), (1, 14, "ocr"), (1, 15, "header"), (1, 16, "header"),
    }


def test_repaired(spark):
    got = {r.paper_id: r.text for r in S.repaired(corpus(spark)).collect()}
    assert got[1].split("\n\n")[0] == "Effect of things on other things in mice"
    assert "a complete success" in got[1] and "that took part in the study. The measured values" in got[1] and "long-term follow" in got[1] and "has months of" in got[1]
    assert "library" not in got[1] and "Smith" not in got[1] and "847   363" in got[1]
    assert got[2].startswith("# Title") and got[4] is None and got[5] == ""


def test_no_texts(spark):
    none = corpus(spark).where("full_text is null")
    assert S.flaws(none).count() == 0 and S.repaired(none).first().text is None
    assert S.flaws(none.where("false")).count() == 0


def test_long_words_and_lines(spark):
    text = "\n".join(["A line of some words that is cut off before its end by", "the edge of the page " + "x" * 90] * 400) + "\n" + "y" * 139
    df = spark.createDataFrame([(1, None, text), (2, "s", "z" * 200_000), (3, "s", ("w" * 60 + "\n") * 2000)], "paper_id long, stem string, full_text string")
    assert {r.kind for r in S.flaws(df).collect()} <= {"header"}


def test_page_numbers():
    body = ["The text of a page goes on for some more lines here and", "then it ends with a last line which has some words that", "go on over to the page behind it, as they always would,", "until the sentence ends."] * 4
    text = "\n".join(["Title of the paper that is long enough", "", *body, "Page 2 of 3", *body, "[3]", *body, "— 4 —", *body, "12", "345   67", "88", *body])
    kinds = S.classify(text, "A 1999 J 1")
    lines = text.split("\n")
    assert {x: k for x, k in zip(lines, kinds) if k in ("pageno", "cells")} == {"Page 2 of 3": "pageno", "[3]": "pageno", "— 4 —": "pageno", "12": "cells", "345   67": "cells", "88": "cells"}


def test_scanned():
    assert S.is_scanned(PAGE)
    assert not S.is_scanned("# T\n\n" + "word " * 300) and not S.is_scanned("") and not S.is_scanned("one line")


def test_cost():
    assert S.cost("srnall", "small") == S.cost("weighf", "weight") == S.cost("m0nths", "months") == 0.3
    assert S.cost("whích", "which") == 0.2 and S.cost("same", "same") == 0
    assert S.cost("house", "mouse") >= 1


def test_corrections_of_every_pair_within_the_cost(spark):
    pairs = {"intemal": "internal", "undear": "unclear", "musde": "muscle", "westem": "western", "govemrnent": "government", "hosqitol": None, "rnodem": "modern", "rneasvrernent": None, "rneasurernent": "measurement", "hespitol": "hospital", "whích": "which", "ínternai": "internal", "rnúscle": "muscle"}
    known = {"internal", "unclear", "muscle", "western", "government", "modern", "which", "hospital", "measurement"}
    counts = spark.createDataFrame([(w, 400) for w in known] + [(w, 1) for w in pairs], "word string, n long")
    got = {r.word: r.meant for r in S.corrections(counts, spark.createDataFrame([(i, None, w, None) for i, w in enumerate(pairs)], "place int, before string, word string, after string")).collect()}
    assert got == {w: m for w, m in pairs.items() if m}
    assert all((S.cost(w, m) <= S.COST_MOST) == (pairs[w] == m) for w in pairs for m in known)
    assert all(set(S.read_forms(w)) & set(S.meant_forms(m)) for w, m in pairs.items() if m)


def test_each_place_is_judged_by_its_neighbours(spark):
    """One misreading means two words, and is a word itself in one place; short words need a neighbour that speaks for the repair."""
    tokens = [(i, "his", "head", "of") for i in range(40)] + [(100 + i, "glass", "bead", "necklace") for i in range(40)] + [(200, "his", "hcad", "of"), (201, "glass", "hcad", "necklace")]
    tokens += [(300 + i, "to", "clear", "the") for i in range(300)] + [(900 + i, "mister", "dear", "friend") for i in range(3)] + [(990, "to", "dear", "the")]
    tokens += [(1000 + i, "it", "the", "house") for i in range(200)] + [(1300, "it", "tbe", "house"), (1301, "xq", "tbe", "zq")]
    rows = spark.createDataFrame(tokens, "place int, before string, word string, after string")
    counts = rows.groupBy("word").count().withColumnRenamed("count", "n")
    got = {r.place: r.meant for r in S.corrections(counts, rows).collect()}
    assert got == {200: "head", 201: "bead", 990: "clear", 1300: "the"}


def test_repair_at_its_place_only(spark):
    page = [{"kind": "text", "body": "The rneasure and the rneasure's RNEASURE ", "cut_a": "m0", "cut_b": "nths", "divided": True, "fixes": [{"at": 1, "word": "rneasure", "meant": "measure"}, {"at": 5, "word": "rneasure", "meant": "measure"}, {"at": -1, "word": "m0nths", "meant": "months"}]}]
    assert S._paragraphs(page) == "The measure and the rneasure's MEASURE months"


def test_one_long_line_is_no_veto(spark):
    assert S.is_scanned(PAGE + "\n" + PAGE + "\n" + "word " * 40)
    assert not S.is_scanned("\n".join(["word " * 60] * 10))


def test_notices_in_few_of_many_papers(spark):
    """A notice that three papers have is found, whatever the number of papers."""
    body = "The patients of the {0} were seen in the\nCopy of the {1} desk\nhospital of the town and all of the values\nwere measured by a {0} nurse in the same\nroom as the last time that they had come."
    rows = [(i, None, body.format(f"group{i}", "library" if i < 3 else f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 7)}qz")) for i in range(120)]
    df = spark.createDataFrame(rows, "paper_id long, stem string, full_text string")
    got = {(r.paper_id, r.line_no) for r in S.flaws(df).where("kind = 'header'").collect()}
    assert {(0, 2), (1, 2), (2, 2)} <= got and len(got) < 10


def test_blocks_never_reject_what_is_alike():
    import random

    rng = random.Random(4)
    for _ in range(2000):
        a = "".join(rng.choices("abc ", k=rng.randint(4, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = rng.choices("abc ", k=rng.randint(0, 1))
            b = b or ["a"]
        b = "".join(b)
        n = len(a)
        most = 1 if n < 10 else 2 if n < 24 else 3
        far = abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4
        assert S._alike(a, b) == (a == b or not far and S.distance(a, b) <= most)
