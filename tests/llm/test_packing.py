import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import mixing as M
from quillstream.llm import packing as P
from quillstream.llm import tokens as K


def held(plan):
    room = [0] * plan.n
    seen = {}
    for size, a, b, first, each in plan.places:
        for i in range(a, b + 1):
            assert (size, i) not in seen
            seen[size, i] = first + (i - a) // each
            room[first + (i - a) // each] += size
    return room, seen


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=25))
def test_plan_places_all_within_capacity(counts):
    plan = P.make_plan(counts, 100)
    room, seen = held(plan)
    assert all(0 < r <= 100 for r in room)
    assert set(seen) == {(s, i) for s, n in counts.items() for i in range(n)}
    total = sum(s * n for s, n in counts.items())
    assert plan.n <= 1.5 * total / 100 + 30


def test_plan_is_tight():
    import random

    rng = random.Random(2)
    counts = {}
    for _ in range(20_000):
        s = min(2048, int(rng.lognormvariate(5, 1)) + 1)
        counts[s] = counts.get(s, 0) + 1
    plan = P.make_plan(counts)
    room, _ = held(plan)
    least = -(-sum(room) // 2048)
    assert plan.n <= 1.005 * least + 1


def test_pack(spark):
    df = spark.createDataFrame([(1, 30), (2, 70), (3, 100), (4, 250), (5, 0), (6, None), (7, 50), (7, 50)], "id long, tokens long")
    got = P.pack(df, "id", "tokens", 100).collect()
    assert len(got) == 10
    room = {}
    for r in got:
        if r.container is None:
            assert r.tokens == 0
        else:
            room[r.container] = room.get(r.container, 0) + r.tokens
    assert all(v <= 100 for v in room.values()) and sum(room.values()) == 550 and len(room) == 6
    assert sorted((r.part, r.tokens) for r in got if r.id == 4) == [(0, 100), (1, 100), (2, 50)]
    assert P.pack(df.where("false"), "id", "tokens", 100).count() == 0
    assert P.fill(P.pack(df.where("false"), "id", "tokens", 100), 100).first().containers == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 400))
def test_fit_is_the_best_sum(counts, budget):
    take = M.fit(counts, budget)
    assert all(0 < k <= counts[n] for n, k in take.items())
    reach = {0}
    for n, k in counts.items():
        reach = {r + n * i for r in reach for i in range(k + 1) if r + n * i <= budget}
    assert sum(n * k for n, k in take.items()) == max(reach)


def test_fit_of_a_large_budget():
    counts = {n: 500 for n in range(50, 400, 7)}
    budget = 1_234_567
    assert sum(n * k for n, k in M.fit(counts, budget).items()) == budget


def test_budgets():
    t = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 2)}
    b = M.budgets({"a": 1000, "b": 100, "x": 5}, t)
    assert b == {"a": 500, "b": 300}
    assert M.budgets({}, t) == {}
    assert M.budgets({"a": 1000, "b": 1000, "c": 1000}, t, 100) == {"a": 50, "b": 30, "c": 20}


def test_draw(spark):
    rows = [(i, "a", 10 + i % 5) for i in range(200)] + [(1000 + i, "b", 7) for i in range(10)] + [(2000, "none", 5)]
    texts = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 4), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = M.draw(texts, targets).collect()
    per = {s: sum(r.tokens * r.uses for r in got if r.source == s) for s in ("a", "b")}
    assert per == {"a": 980, "b": 280} and max(r.uses for r in got if r.source == "a") == 1 and max(r.uses for r in got) == 4
    again = M.draw(texts.repartition(7), targets).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    rep = {r.source: r for r in M.shares(M.draw(texts, targets), texts, targets).collect()}
    assert rep["c"].tokens == 0 and abs(rep["a"].reached_share - 980 / 1260) < 1e-9
    assert M.draw(texts.where("false"), targets).count() == 0


@pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary file")
def test_tokens_and_texts(spark):
    df = spark.createDataFrame([(1, "a", "Hello world"), (2, "a", ""), (3, "a", None), (4, "a", "Hello world"), (5, None, "x"), (6, "a", "<|endoftext|>"), (7, "z", "y")], "doc_id long, source string, text string")
    n = {r.doc_id: r.tokens for r in K.counted(df, "text", ["doc_id"]).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[6] > 1
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert sorted(r.doc_id for r in M.texts_of(df, targets).collect()) == [1, 6]
    e = K.encoder()
    long = "some words here " * 20_000
    assert abs(K._long(e, long) - len(e.encode_ordinary(long))) <= 4


@pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary file")
def test_runs_count_as_the_whole(monkeypatch):
    import random

    e, rng = K.encoder(), random.Random(2)
    monkeypatch.setattr(K, "RUN", 200)
    for _ in range(40):
        text = "".join(rng.choice(["word", "Wort", "12", " ", " ", "  ", "\n", ", ", "don't", "é", "…", "   x"]) for _ in range(800))
        assert K._long(e, text) == len(e.encode_ordinary(text))
    with pytest.raises(FileNotFoundError):
        K.encoder("/nowhere.tiktoken")
