import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import canonical as C
from quillstream.llm.edit import BKTree, Texts, distance, fold, levenshtein


def plain(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 4))
def test_levenshtein(a, b, most):
    assert levenshtein(a, b) == plain(a, b)
    assert min(levenshtein(a, b, most), most + 1) == min(plain(a, b), most + 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", max_size=80), min_size=9, max_size=14), st.text("abcé", max_size=70))
def test_bit_vectors(texts, word):
    assert [distance(word, t) for t in texts] == [plain(word, t) for t in texts]
    assert list(Texts(texts).distances(word, np.arange(len(texts)))) == [plain(word, t) for t in texts]


def test_tree_finds_all():
    rng = random.Random(1)
    words = {"".join(rng.choices("abcd", k=rng.randint(1, 8))) for _ in range(400)}
    tree = BKTree(words)
    for _ in range(60):
        q, r = "".join(rng.choices("abcd", k=rng.randint(0, 8))), rng.randint(0, 3)
        assert tree.within(q, r) == sorted((plain(q, w), w) for w in words if plain(q, w) <= r)
    radius = {"".join(rng.choices("abcd", k=rng.randint(0, 8))): rng.randint(0, 3) for _ in range(60)}
    assert sorted(tree.within_many(radius)) == sorted((q, w, plain(q, w)) for q, r in radius.items() for w in words if plain(q, w) <= r)
    assert BKTree().within("x", 3) == [] and BKTree().within_many({"x": 3}) == [] and tree.within_many({}) == []
    assert fold("Ínstitut ﬁn Ünıversität ß") == "Institut fin Unıversitat ss"


LIST = [
    ("1", "Proceedings in Alpha Physiology", "Proc Alpha Physiol", 1),
    ("2", "Northern Journal of Betic Surgery", "North J Betic Surg", 2),
    ("3", "Annals of Gamma Physiology and Surgery", "Ann Gamm Physiol Surg", 3),
    ("4", "Annals of Delta Physiology", "Ann Delta Physiol", 4),
    ("5", "Proceedings in Epsil Surgery", "Proc Epsil Surg", 5),
    ("2", "NORTHERN JOURNAL OF BETIC SURGERY", "North J Betic Surg", 6),
    ("6", None, "J Zeta Surg", 7),
    (None, "No id", "No Id", 8),
    ("", "Empty id", "", 9),
    ("7", "Northern Journal of Etaic Physiology", "North J Etaic Physiol", 10),
    ("8", "Annals of Thetal Surgery", "Ann Thetal Surg", 11),
]


def test_match(spark):
    entries = spark.createDataFrame(LIST, "nlmid string, title string, abbr string, ord int")
    means = {
        "proc. alpha physiol.": "1", "ProcAlphaPhysiol": "1", "The Proceedings of Alpha Physiology": "1", "Alpha Physiology, Proceedings in": "1", "Proceedings in Álpha Physiology (Online)": "1",
        "Proceedings in Alpha Physiology : official organ": "1", "Proc Alpha Physiol, vol 48": "1", "  Proc  Alpha Physiol 2002 ": "1", "Proceedings in Alpa Physiology": "1", "NorthJBeticSurg": "2",
        "Annals of Gamma Physiology and": "3", "AGPS": "3", "Ann Gamm Physiol & Surg": "3", "Annals of Gamma Physiology &amp; Surgery": "3", "J. Zeta. Surg.": "6",
    }
    lost = ["In preparation", "Proc Omega Physiol", "n/a", "", "-", "No Id", "Acta Alpha Surg", "Proc Alpha Physiol " * 20_000]
    values = spark.createDataFrame([(v,) for v in [*means, *lost, None, *list(means)[:2]]], "j string")
    for rows in (10_000, 3):  # one tree, and shards
        got = {r.value: r.entry for r in C.match(values, "j", entries, "nlmid", "title", "abbr", rows).collect()}
        assert {v: got[v] for v in lost} == dict.fromkeys(lost), rows
        if rows > 3:
            assert {v: got[v] for v in means} == means
        assert None not in got
    assert all(r.entry is None for r in C.match(values, "j", entries.where("false"), "nlmid", "title", "abbr").collect())
    assert C.match(values.where("false"), "j", entries, "nlmid", "title", "abbr").count() == 0


def test_shards_give_the_same_answers(spark):
    """Ties, beginnings and initials are settled over all shards, whatever the shards are."""
    heads, fields = ["Proceedings in", "Annals of", "Letters in"], ["Physiology", "Surgery", "Toxicology"]
    rng = random.Random(3)
    names = [f"{h} {''.join(rng.choices('bcdfgaeiou', k=6)).title()} {f}" for h in heads for f in fields for _ in range(6)]
    entries = spark.createDataFrame([(str(i), n, None) for i, n in enumerate(names)], "i string, t string, a string")
    typed = [n[:-3] for n in names] + [n.replace("i", "", 1) for n in names] + ["".join(w[0] for w in n.split() if w not in ("in", "of")).upper() for n in names] + ["Annals of", "Proceedings"]
    values = spark.createDataFrame([(v,) for v in typed], "j string")
    one, many = ({(r.value, r.entry, r.distance) for r in C.match(values, "j", entries, "i", "t", "a", n).collect()} for n in (20_000, 7))
    assert one == many and sum(e is not None for _, e, _ in one) >= 2 * len(names)


def test_ties_are_unmatched(spark):
    entries = spark.createDataFrame([("1", "Acta Abcdefgha", None), ("2", "Acta Abcdefghc", None)], "i string, t string, a string")
    got = C.match(spark.createDataFrame([("Acta Abcdefghb",), ("Acta Abcdefgha",)], "j string"), "j", entries, "i", "t", "a")
    assert {r.value: r.entry for r in got.collect()} == {"Acta Abcdefghb": None, "Acta Abcdefgha": "1"}


def test_report(spark):
    js = spark.createDataFrame([("1", "Proceedings in Alpha Physiology", "Proc Alpha Physiol", 1)], "nlmid string, journaltitle string, medabbr string, ord int")
    refs = spark.createDataFrame([(1, "Proc Alpha Physiol"), (2, "proc alpha physiol"), (3, "thesis"), (4, None), (5, " "), (6, "thesis")], "ref_id long, journal string")
    assert {r.ref_id: (r.nlmid, r.status) for r in C.journals_of(refs, js).collect()} == {1: ("1", "listed"), 2: ("1", "mapped"), 3: (None, "unmatched"), 4: (None, "missing"), 5: (None, "missing"), 6: (None, "unmatched")}
    assert [tuple(r) for r in C.unmatched(refs, js).collect()] == [("thesis", 2)]
