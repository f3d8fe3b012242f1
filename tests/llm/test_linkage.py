import numpy as np
import pandas as pd

from quillstream.llm import linkage as L

CITED = "cite_id long, title string, year string, volume string, pages string"
REFS = "ref_id long, pmid string, title string, year string, volume string, pages string"

TITLES = [
    "Effect of alphazine on grip strength in older adults with chronic beta fever", "Role of GENE7 in acute gamma anaemia of the liver", "Long-term sleep latency after delta arthritis of the spleen in 212 outpatients",
    "Does epsilol prevent zeta neuropathy in male rats carrying XYZ4 variants?", "Prevalence of eta dermatitis among dairy workers studied by flow cytometry", "Transcriptional control of QRS9 by thetamab in the kidney of aged mice",
]


def refs(spark):
    rows = [(i, f"p{i}", t, str(1990 + i), str(10 + i), f"{100 + 7 * i}-{110 + 7 * i}") for i, t in enumerate(TITLES)]
    rows += [(10, "p10", "Oral iotamide in laying hens with kappa fever (Part 1)", "2001", "5", "200-210"), (11, "p11", "Oral iotamide in laying hens with kappa fever (Part 2)", "2001", "5", "211-220")]
    rows += [(12, "p12", "Book review", "2005", "31", "700-701"), (13, "p13", "Book review", "2006", "32", "800-801"), (14, "p0", TITLES[0], None, "", "100-110"), (15, None, TITLES[1], "1991", "11", "107-117"), (16, "p16", None, None, None, None)]
    return spark.createDataFrame(rows, REFS)


def test_link(spark):
    cited = [
        (1, TITLES[0], "1990", "10", "100-10"), (2, TITLES[0].upper(), "1990b", "Vol. 10", "pp. 100–110"), (3, "Effect alphazine grip strength older adults chronic beta fever", "1991", "10(4)", "100"),
        (4, "Role of GENE7 in acute gamma an", "1991", "11", "107-117"), (5, "Comment on: " + TITLES[1], "1992", "12", "4001"), (6, None, "1992", "12", "114-124"), (7, TITLES[3].replace("epsilol", "epsliol"), "in press", "13", None),
        (8, "Oral iotamide in laying hens with kappa fever (Part 2)", "2001", "5", "211-220"), (9, "Book review", "2005", "31", "700-701"), (10, "Book review", "1999", "3", "900-901"),
        (11, "Effect of omegazine on grip strength in older adults with chronic beta fever", "2010", "55", "900-910"), (12, None, None, None, None), (13, "", "", "", ""), (1, TITLES[0], "1990", "10", "100-10"), (14, "Erratum: " + TITLES[4], "1994", "14", "128-138"),
    ]
    got = {(r.cite_id, r.pmid) for r in L.link(spark.createDataFrame(cited, CITED), refs(spark)).collect()}
    assert got == {(1, "p0"), (2, "p0"), (3, "p0"), (4, "p1"), (6, "p2"), (7, "p3"), (8, "p11"), (9, "p12")}


def test_confidence_and_empty(spark):
    one = spark.createDataFrame([(1, TITLES[0], "1990", "10", "100-110"), (2, TITLES[0], "1991", "10", None)], CITED)
    r = {x.cite_id: x.confidence for x in L.link(one, refs(spark)).collect()}
    assert 0.5 <= r[2] < r[1] <= 1
    assert L.link(one.where("false"), refs(spark)).count() == 0
    assert L.link(one, refs(spark).where("false")).count() == 0


def test_very_long_titles(spark):
    long = " ".join(f"word{i}" for i in range(3_000))
    cited = spark.createDataFrame([(1, long, "1999", "1", "1-2"), (2, "x" * 30_000, "1990", "10", "100-110")], CITED)
    got = L.link(cited, spark.createDataFrame([(1, "p", long, "1999", "1", "1-2"), (2, "q", "y" * 30_000, "1990", "10", "100-110")], REFS)).collect()
    assert [(r.cite_id, r.pmid) for r in got] == [(1, "p")]


def rules(block, v):
    return sum((w * (np.maximum(level - v, 0) if good else np.maximum(v - level, 0)) ** 2).sum() for level, w, good in L._rules(block))


def block_of(rows):
    b = pd.DataFrame(rows, columns=["c", "r", "title", "numbers", "weight", "strange"]).assign(told=1.0, z=0.0, u=0.0)
    return b.astype({"title": float, "numbers": float})


def test_works_step_finds_the_optimum_within_the_constraint():
    b = block_of([(1, 1, 1.0, 1.0, 3.8, 0), (1, 2, 1.0, 0.8, 3.8, 0), (2, 3, 0.9, 1.0, 3.8, 0), (3, 4, None, 1.0, 3.8, 0), (4, 5, 1.0, 1.0, 3.8, 1)])
    v = L._works_step(b, 0.0)
    assert v[0] + v[1] <= 1 + 1e-6 and v[0] > v[1]
    grid = [(x, y) for x in np.linspace(0, 1, 201) for y in np.linspace(0, 1, 201) if x + y <= 1]
    best = min(grid, key=lambda m: rules(b[:2], np.array(m)))
    assert abs(v[0] - best[0]) < 0.02 and abs(v[1] - best[1]) < 0.02
    for i in (2, 3, 4):
        assert abs(v[i] - min(np.linspace(0, 1, 1001), key=lambda x: rules(b[i : i + 1], np.array([x])))) < 2e-3
    assert v[4] < v[2]  # a strange word speaks against the match


def test_rules_pull_one_way_only():
    b = block_of([(1, 1, 0.5, None, 0.0, 0)])
    good = [(level, w) for level, w, up in L._rules(b) if up and w[0] > 0]
    assert len(good) == 1 and good[0][0][0] == 0.5
    assert rules(b, np.array([0.5])) == L.PRIOR * 0.25


def test_transitivity_supports_a_weak_line_and_converges(spark):
    """Two lines that say the same: the weaker one is lifted to the optimum of the whole, found here on a grid."""
    cols = "c long, r long, title double, told double, numbers double, weight double, strange int, chain int, pos int, near double"
    rows = [(1, 7, 1.0, 1.0, 1.0, 3.8, 0, 0, 0, 1.0), (2, 7, 0.5, 1.0, 0.4, 2.2, 0, 0, 1, None), (3, 8, 0.5, 1.0, 0.4, 2.2, 0, 0, 0, None)]
    got = {r.c: r.value for r in L.solve(spark.createDataFrame(rows, cols)).collect()}
    b = pd.DataFrame([(r[0], r[1], r[2], r[4], r[5], r[6]) for r in rows[:2]], columns=["c", "r", "title", "numbers", "weight", "strange"]).assign(told=1.0)
    best = min(((x, y) for x in np.linspace(0, 1, 201) for y in np.linspace(0, 1, 201)), key=lambda m: rules(b, np.array(m)) + L.SAME * (m[0] - m[1]) ** 2)
    assert abs(got[1] - best[0]) < 0.02 and abs(got[2] - best[1]) < 0.02
    assert got[2] > got[3] + 0.1 and got[1] > got[2]


def test_every_title_keeps_its_keys_as_the_table_grows(spark):
    """Keys take more tokens when more records must be told apart, and a misspelt, shortened reference is still found."""
    cited = [(1, "Effect alphazne grip strength older adults chronic beta", None, "10", None), (2, TITLES[2][:44], "1992", None, None), (3, "Book review", "2005", "31", "700")]
    _, works, papers, rare, least = L.sides(spark.createDataFrame(cited, CITED), refs(spark))
    works.count()
    for more in (0.0, 3.0, 6.0):
        a, b = (L._keys(x, i, rare, least + more) for x, i in ((works, "c"), (papers, "r")))
        assert a.select("c").distinct().count() == 3 and b.select("r").distinct().count() == papers.where("size(words) > 0 or first <> ''").count()
        pairs = L.candidates(works, papers, rare, least + more).join(papers.select("r", "pmid"), "r").join(works.select("c", "words"), "c").collect()
        assert {("p0", "alphazne"), ("p2", "long"), ("p12", "book")} <= {(p.pmid, next((w for w in p.words if w in ("alphazne", "long", "book")), "")) for p in pairs}


def test_smallest_sets_against_all_sets():
    """A pair is found exactly if the rarest tokens it shares have the information, whatever each side skips within its share."""
    rng = np.random.default_rng(5)
    info = np.sort(rng.uniform(1, 6, 9))[::-1]
    for _ in range(40):
        shared = np.sort(rng.choice(9, rng.integers(2, 9), replace=False))
        key = lambda own: {int(k) for k in L._sets(own[None, :].astype(np.int64) + 1, info[own][None, :], np.full((1, len(own)), -1), info[own][None, :], 9.0)[1]}
        whole, part = key(np.arange(9)), key(shared)
        taken, have = [], 0.0
        for i in shared:
            taken.append(i)
            have += info[i]
            if have >= 9.0:
                break
        skipped = info[: taken[-1] + 1].sum() - have
        if have >= 9.0 and skipped <= L.SKIP * info.sum():
            assert whole & part


def test_recall(spark):
    cited = spark.createDataFrame([(100 * i, t, str(1990 + i), str(10 + i), None) for i, t in enumerate(TITLES)], CITED)
    r = L.recall(cited, refs(spark)).first()
    assert r.works == len(TITLES) and r.recall == 1.0
    assert L.recall(cited.where("false"), refs(spark)).first().pairs == 0
