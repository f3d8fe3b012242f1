import tracemalloc

import numpy as np

from quillstream.llm import vectors as V


def table(spark, x, ids=None):
    ids = range(1, len(x) + 1) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)], "vec_id long, embeddings array<float>")


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    return centres[rng.integers(0, 12, n)] + 0.7 * rng.normal(size=(n, 64))


def brute(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_recall_and_found(spark):
    x = clustered(3000)
    df = table(spark, x).repartition(4)
    near = V.neighbours(df).cache()
    got = {r.vec_id: [n.id - 1 for n in r.near] for r in near.collect()}
    truth, s = brute(x)
    assert len(got) == 3000 and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(truth[i]) & set(got[i + 1])) / 5 for i in range(3000)]) >= 0.9
    r = V.recall(df, near).first()
    assert r.queries == 30 and r.neighbours == 150 and r.recall >= 0.85
    for r in near.limit(20).collect():
        assert all(abs(n.cosine - s[r.vec_id - 1, n.id - 1]) < 1e-4 for n in r.near)
        assert [n.cosine for n in r.near] == sorted((n.cosine for n in r.near), reverse=True)


def test_bad_vectors_scale_and_copies(spark):
    x = clustered(40, 3)
    rows = [*x, 7 * x[0], None, np.zeros(64), x[1][:10], np.full(64, np.nan)]
    near = {r.vec_id: [n.id for n in r.near] for r in V.neighbours(table(spark, rows)).collect()}
    assert set(near) == set(range(1, 42))
    assert near[1][0] == 41 and near[41][0] == 1
    assert {(r.vec_a, r.vec_b) for r in V.pairs(V.neighbours(table(spark, rows))).collect()} == {(1, 41)}


def test_many_copies(spark):
    x = [*clustered(30, 5), *[np.ones(64)] * 50]
    near = {r.vec_id: [n.id for n in r.near] for r in V.neighbours(table(spark, x)).collect()}
    assert len(near) == 80
    heads = list(range(31, 37))
    for i in range(31, 81):
        assert set(near[i]) <= set(heads) - {i} and len(near[i]) == 5


def test_small_and_empty(spark):
    x = clustered(3, 1)
    near = {r.vec_id: [n.id for n in r.near] for r in V.neighbours(table(spark, x)).collect()}
    assert {k: set(v) for k, v in near.items()} == {1: {2, 3}, 2: {1, 3}, 3: {1, 2}}
    assert V.neighbours(table(spark, x[:1])).collect() == [] or V.neighbours(table(spark, x[:1])).first().near == []
    assert V.neighbours(table(spark, [None])).count() == 0


def small_tree(n, leaf, branch, seed=2):
    x = clustered(n, seed)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    old, V.BRANCH = V.BRANCH, branch
    try:
        return x, V.Tree(x, n, leaf=leaf)
    finally:
        V.BRANCH = old


def test_blocks_visit_what_a_queue_visits():
    for branch, leaf in ((8, 40), (3, 25), (96, 100)):
        x, t = small_tree(2000, leaf, branch)
        assert len(t.paths) > 15
        for wanted in (1, 8, len(t.paths)):
            got = t.reach(x[:40], wanted)
            assert all(len(set(r)) == wanted for r in got)
            for q, r in zip(x[:40], got):
                nodes = t.nodes @ q
                least = np.array([min(nodes[n] for n in p) for p in t.paths])
                for order in (r, t.visit(q, wanted)):
                    assert np.allclose(np.sort(least[order]), np.sort(least)[-wanted:], atol=1e-5)
        assert (t.home(x[:50]) == t.reach(x[:50], 1)[:, 0]).mean() > 0.7


def test_home_needs_no_memory_for_all_leaves():
    """8,192 vectors go down a tree of as many leaves as a sample of 60,000 can tell apart, in a few dozen MB."""
    x, t = small_tree(60_000, 8, 96)
    assert len(t.paths) > 4_000
    block = x[: V.ROUTED]
    tracemalloc.start()
    got = t.home(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    s, alive = block[:200] @ t.nodes.T, np.ones((200, len(t.paths)), bool)
    for d in range(t.lines.shape[1]):
        level = np.where(alive, s[:, t.lines[:, d]], -9.0)
        alive &= level >= level.max(axis=1, keepdims=True)
    assert (got[:200] == alive.argmax(axis=1)).mean() > 0.99


def test_slots_divide_those_who_ask(monkeypatch):
    """A bin that most vectors ask for gets several slots, and tasks are of similar work."""
    x, t = small_tree(4000, 40, 8)
    t.sample = np.concatenate([x[:400], np.repeat(x[:1], 1600, axis=0)])
    monkeypatch.setattr(V, "BIN", 300)
    monkeypatch.setattr(V, "ASKS", 200)
    slots = V.Slots(t, 4, 4000, 4)
    hot = slots.bins[slots.first[t.reach(x[:1], 1)[0, 0]]]
    assert slots.salts[hot] >= 10 and slots.tasks >= 8
    assert len(slots.task) == slots.salts.sum() and set(slots.task) == set(range(slots.tasks))


def test_hot_bins_keep_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(V, "ASKS", 150)
    monkeypatch.setattr(V, "BIN", 400)
    x = np.concatenate([clustered(600, 4), np.random.default_rng(9).normal(size=(1, 64)) + 0.2 * np.random.default_rng(8).normal(size=(600, 64))])
    near = V.neighbours(table(spark, x))
    assert near.count() == 1200
    assert V.recall(table(spark, x), near, every=3).first().recall >= 0.9
