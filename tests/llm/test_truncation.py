from quillstream.llm import truncation as T


def test_ending():
    kind = lambda t: T.ending(t)["kind"]
    assert kind("A sentence. Another one.") == "closed"
    assert kind("A sentence. “Quoted.”") == "closed"
    assert kind("A sentence. (n = 5)") == "group"
    assert kind("A sentence. And then...") == "mark" == kind("cut he…")
    assert kind("Text.\nKeywords: a; b") == "list" and kind("Text.\nTable 3. 12  34  56") == "table"
    assert kind("A title. J X. 1999;12(3):45-67") == "cited"
    assert kind("was 3.2 (95% inter") == "dangling" and T.ending("value (P < 0.")["open"] == "bracket" and kind("a well-") == "dangling" and kind("first, then,") == "dangling"
    assert kind("text &am") == "broken" == kind("text <b") == kind("text \\u00e")
    assert kind("text (P < 0.001).") == "closed" and T.ending("text (P < 0.001).")["open"] is None
    assert kind("") == kind(" \n ") == "empty" and kind("no end here") == "plain"
    assert T.ending("A headline without end")["single"] and not T.ending("One. Two goes")["single"]


def test_automaton():
    unclosed = {
        "The quote “was fine.": "quote", 'She said "it was fine.': "quote", "‘quote it.": "quote", "„a b.": "quote", "«a b.": "quote", "<b>text.": "element", "a <div class='x'>b <i>c</i>.": "element",
        "```\ncode (\n": "fence", "~~~~\ncode\n~~~\n": "fence", "was [3, 4": "bracket", "a “b (c.": "bracket",
    }
    assert {t: T.opened(t) for t in unclosed} == unclosed
    closed = ['He said "x" and 5" wide.', "don’t ‘quote’ it.", "„a“ b.", "»a« b.", "“a”.", "<p>text.", "a<br>b <img src='x' />.", "<b>a</b>.", "```\ncode (\n```\nEnd.", "“one.\n\n“two.”", "a) b.", "(a\nb", "</b> c.", "x < y and y > z."]
    assert [t for t in closed if T.opened(t)] == []
    broken = ["text <b", 'text <a href="x', "text <a href='" + "x" * 500, "caf&eacut", "text &CounterClockwiseContourInt", "text &#82", "text <!-- note", "text \\u00e", "text \ufffd"]
    assert [t for t in broken if T.ending(t)["kind"] != "broken"] == []
    assert T.ending("Notes on R&D")["kind"] == T.ending("if x <y then z and so on")["kind"] == "plain"
    assert T.opened("(" * 50_000) == "bracket" and T.opened('"a ' * 30_000) in ("quote", None) and T.opened("<b>" * 20_000) == "element"


def test_open_delimiters_and_habits_of_a_source(spark):
    """A quote left open is the end of a text, unless its source leaves them open as a habit; a missing terminator tells nothing where they are rare."""
    rows = [(i, "a", None, f"The clinic was seen in {i} cases. All was good in the end. It was good.") for i in range(40)] + [(100, "a", None, "It was seen. He said “all was good."), (101, "a", None, "It was <b>good.")]
    rows += [(200 + i, "quoted", None, f"The clinic was seen. He said “all {i} was good.") for i in range(40)]
    rows += [(300 + i, "feed", None, f"The clinic was seen.{' Good.' * i} All was good in {i} cases in the end") for i in range(40)] + [(400, "feed", None, "The clinic was seen. All was good in the")]
    got = {r.doc_id: r.truncated for r in T.detect(spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string")).collect()}
    assert {i for i, t in got.items() if t} == {100, 101, 400}


def test_shares_mean_the_same_at_any_size(spark):
    rows = [(i, "a", None, f"The clinic {i} was seen in the hazard of the end. Good.") for i in range(60)] + [(1000 + i, "b", None, (f"The clinic {i:02} was seen. The results of the gro")[:40]) for i in range(6)] + [(2000, "a", None, "The clinic was seen. Notably, the haz")]
    cols = "doc_id long, source string, n_chars long, text string"
    few = {r.doc_id for r in T.detect(spark.createDataFrame(rows, cols)).where("truncated").collect()}
    more = [(i + 10_000 * k, s, n, t.replace("clinic", f"clinic{'abcdefghij'[k]}")) for i, s, n, t in rows for k in range(10)]
    many = {r.doc_id for r in T.detect(spark.createDataFrame(more, cols)).where("truncated").collect()}
    assert few == {*range(1000, 1006), 2000} and {i % 10_000 for i in many} == few and len(many) == 10 * len(few)


def test_detect(spark):
    base = [f"The patients of group {i} were seen in the clinic. The results were good in the end." for i in range(60)]
    rows = [(i, "a", None, t) for i, t in enumerate(base)]
    rows += [(100 + i, "b", None, t) for i, t in enumerate([("The patients of clinic number %02d were seen. The results of the gro" % i)[:60] for i in range(20)])]
    rows += [(200, "a", None, "The patients were seen. The resul"), (201, "a", None, None), (202, "a", None, ""), (203, "a", None, "Results of the clinic"), (204, "a", None, "Good patients of the"), (205, None, 500, "The clinic was good. Seen (in the"), (206, "a", None, "The end.\nThe editors")]
    rows += [(300 + i, "c", None, f"The clinic {i} was seen.\nThe editors") for i in range(6)] + [(400, "a", None, "Seen in the cli..."), (401, "a", None, "x" * 100_000), (200, "a", None, "The patients were seen. The resul")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, n_chars long, text string, reason string")
    got = {r.doc_id: (r.truncated, r.reason) for r in T.detect(df).collect()}
    assert not any(got[i][0] for i in range(60))
    assert all(got[100 + i][0] for i in range(20))
    assert got[200][0] and got[201] == got[202] == (False, "empty") and got[204][0] and got[205][0] and got[400][0]
    assert not got[203][0] and not got[206][0] and not any(got[300 + i][0] for i in range(6))
    per = {r.source: (r.texts, r.truncated) for r in T.by_source(df).collect()}
    assert per["b"] == (20, 20) and per[None] == (1, 1)
    assert T.detect(df.where("false")).count() == 0


def test_repeated_cut_ends_are_no_formulas(spark):
    full = "The clinic {0} was seen in the hazard of the end. Notably, the hazard of the end was good. In {0} cases the dose was good."
    rows = [(i, "a", None, full.format(i)) for i in range(100)]
    # short ends that repeat because there are many texts, with a formula beside them
    rows += [(1000 + i, "a", None, f"The clinic {i:05} was seen.\n" + "so " * (i % 37) + "on.\nThe editors") for i in range(300)]
    rows += [(2000 + i, "a", None, f"The clinic {i} was seen.{' Good.' * i}\nNotably, the hazard") for i in range(12)]
    rows += [(3000 + i, "a", None, f"The clinic {i} was seen.{' Good.' * i}\nIn a sensitiv") for i in range(5)]
    # the same of ends with a mark
    rows += [(4000 + i, "b", None, f"The clinic {i} was seen.{' Good.' * i}\nAnd so the question stays open...") for i in range(300)]
    rows += [(5000 + i, "b", None, f"The clinic {i} was seen.{' Good.' * i} The ...") for i in range(5)] + [(6000 + i, "b", None, f"The clinic {i} was seen.{' Good.' * i} ...") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string")
    found = {r.doc_id for r in T.detect(df).where("truncated").collect()}
    assert found == {*range(2000, 2012), *range(3000, 3005), *range(5000, 5005), *range(6000, 6005)}
