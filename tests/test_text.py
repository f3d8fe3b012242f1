import re

from pyspark.sql import functions as F

from quillstream.functions import text as T


def one(spark, column, *values):
    names = "abcdef"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first()[0]


def test_words_and_chunks(spark):
    assert one(spark, T.words, " a b\n\tc ") == ["a", "b", "c"]
    assert one(spark, T.words, "  ") == []
    assert one(spark, T.words, None) is None
    text = " ".join(f"w{i:04d}" for i in range(1000))
    got = one(spark, T.chunks, text)
    assert [g.split()[0] for g in got] == ["w0000", "w0320", "w0640", "w0960"]
    assert [len(g.split()) for g in got] == [400, 400, 360, 40]
    assert one(spark, T.chunks, "short text") == []


def test_title_chunks(spark):
    assert one(spark, T.title_chunks, "The role of X-B (in) mice: a study!") == ["role X B", "mice study"]
    assert one(spark, T.title_chunks, "of the") == []


def test_ids_paths_urls(spark):
    assert one(spark, T.normalise_id, " https://x.org/12345// ") == "12345"
    assert one(spark, T.normalise_id, "abc") == "abc"
    assert one(spark, T.path_stem, "/a/b.c/d.e.pdf") == "d.e"
    assert one(spark, T.path_stem, ".hidden") == ".hidden"
    assert one(spark, T.url_quote, "a b/c~d*e&f") == "a%20b/c~d%2Ae%26f"


def test_capitals_and_initials(spark):
    df = spark.createDataFrame([(["Proc", "U", "S", "A", "x", "B"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.collapse_capitals(F.col("t"))).collect()] == [["Proc", "USA", "x", "B"], []]
    for w, plain, loose in (("AB", True, False), ("A.B.", True, False), ("ABCD", False, True), ("JdA", False, True), ("Smith", False, False), ("1", False, False)):
        assert one(spark, T.is_initial, w) is plain, w
        assert one(spark, T.is_loose_initial, w) is loose, w


def test_short_authors(spark):
    df = spark.createDataFrame([([],), (["A"],), (["A", "B"],), (["A", "B", "C"],)], "n array<string>")
    assert [r[0] for r in df.select(T.short_authors(F.col("n"))).collect()] == [" et al.", "A", "A & B", "A et al."]


def test_letters(spark):
    assert one(spark, T.n_letters, "aé 1ß中") == sum(c.isalpha() for c in "aé 1ß中")
    assert re.compile(T.SPACE).match(" ")
