"""Texts put into containers of fixed capacity (problem 8).

Method: linear grouping scheme. The plan is made from the counts of texts by size, of which there are at most as
many as the capacity. Large sizes are rounded up within groups of equal cardinality, the few sizes that result are
combined by a configuration program (column generation over a knapsack), the actual texts take the places of
their group, and the small ones go, largest first, into the container that they fill best. The plan says which
ranks of a size go where, so that texts find their container by their rank among those of equal size.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.tokens import VOCABULARY, counted
from quillstream.session import BROADCAST_ROWS, cut, salted_rank

CAPACITY = 2048
#: Sizes over this share of the capacity are large, and are rounded to so many sizes.
LARGE, GROUPS = 1 / 8, 28


def _pattern(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of ``sizes`` within ``capacity`` (unbounded knapsack)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(min(sizes), capacity + 1):
        fits = [(best[c - s] + v, k) for k, (s, v) in enumerate(zip(sizes, values)) if s <= c]
        top, k = max(fits)
        if top > best[c - 1] + 1e-12:
            best[c], choice[c] = top, k
        else:
            best[c], choice[c] = best[c - 1], -2
    out, c = [0] * len(sizes), capacity
    while c > 0 and choice[c] != -1:
        if choice[c] == -2:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(containers, copies of each size) that hold the demand: the linear program over configurations, rounded down, with the rest packed first-fit decreasing."""
    k = len(sizes)
    columns = [[capacity // s if i == j else 0 for i in range(k)] for j, s in enumerate(sizes)]
    d = np.array(demand, dtype=float)
    for _ in range(60 * k):
        basis = np.array(columns, dtype=float).T
        x = np.linalg.solve(basis, d)
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, new = _pattern(prices, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, np.array(new, dtype=float))
        ratios = [(x[i] / step[i], i) for i in range(k) if step[i] > 1e-9]
        if not ratios:
            break
        columns[min(ratios)[1]] = new
    x = np.linalg.solve(np.array(columns, dtype=float).T, d)
    left, plan = list(demand), []
    for n, col in zip(x, columns):
        times = int(n + 1e-6)
        if times > 0:
            times = min([times, *[left[i] // c for i, c in enumerate(col) if c]])
        if times > 0:
            plan.append((times, col))
            left = [a - times * c for a, c in zip(left, col)]
    while any(left):
        col, room = [0] * k, capacity
        for i in sorted(range(k), key=lambda i: -sizes[i]):
            col[i] = min(left[i], room // sizes[i])
            room -= col[i] * sizes[i]
        times = min(left[i] // c for i, c in enumerate(col) if c)
        plan.append((times, col))
        left = [a - times * c for a, c in zip(left, col)]
    return plan


class Plan:
    """Containers as runs of equal free room; places as (size, first rank, last rank, first container, items in each container)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n = capacity, 0
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.places: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = defaultdict(int)

    def place(self, size: int, items: int, container: int, each: int) -> None:
        first = self.used[size]
        self.used[size] += items
        self.places.append((size, first, first + items - 1, container, each))

    def open(self, containers: int) -> int:
        self.n += containers
        return self.n - containers


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where the texts of each size go; ``counts`` has the number of texts by size, from 1 to ``capacity``."""
    plan = Plan(capacity)
    large = sorted((s for s in counts if s > capacity * LARGE), reverse=True)
    total = sum(counts[s] for s in large)
    if total:
        # groups of equal cardinality, from the largest down, as runs of (size, items)
        per, groups, room = -(-total // GROUPS), [[]], -(-total // GROUPS)
        for s in large:
            n = counts[s]
            while n:
                take = min(n, room)
                groups[-1].append([s, take])
                n, room = n - take, room - take
                if not room:
                    groups.append([])
                    room = per
        groups = [g for g in groups if g]
        merged: dict[int, list] = {}
        for g in groups:
            merged.setdefault(g[0][0], []).extend(g)
        rounded = sorted(merged, reverse=True)
        queue = [merged[s] for s in rounded]
        for times, col in configurations(rounded, [sum(n for _, n in q) for q in queue], capacity):
            first = plan.open(times)
            room_at = [(0, times, capacity)]
            for i, copies in enumerate(col):
                for _ in range(copies):
                    at, todo = 0, times
                    while todo:
                        s, n = queue[i][0]
                        take = min(n, todo)
                        plan.place(s, take, first + at, 1)
                        room_at = _reduce(room_at, at, at + take, s)
                        queue[i][0][1] -= take
                        if not queue[i][0][1]:
                            queue[i].pop(0)
                        at, todo = at + take, todo - take
            for a, b, room_ in room_at:
                plan.free[room_].append((first + a, b - a))
    for s in sorted((s for s in counts if s <= capacity * LARGE), reverse=True):
        left = counts[s]
        while left:
            room = min((r for r, runs in plan.free.items() if r >= s and runs), default=None)
            if room is None:
                new = -(-left // (capacity // s))
                plan.free[capacity].append((plan.open(new), new))
                room = capacity
            first, n = plan.free[room].pop()
            each = room // s
            whole = min(n, left // each)
            if whole:
                plan.place(s, whole * each, first, each)
                plan.free[room - each * s].append((first, whole))
                left -= whole * each
            if whole < n:
                if left and not whole:
                    plan.place(s, left, first, left)
                    plan.free[room - left * s].append((first, 1))
                    left, whole = 0, 1
                if whole < n:
                    plan.free[room].append((first + whole, n - whole))
    return plan


def _reduce(runs: list[tuple[int, int, int]], a: int, b: int, size: int) -> list[tuple[int, int, int]]:
    """``runs`` of (from, to, room) with ``size`` less room from ``a`` to ``b``."""
    out = []
    for x, y, room in runs:
        for p, q, less in ((x, min(y, a), 0), (max(x, a), min(y, b), size), (max(x, b), y, 0)):
            if p < q:
                out.append((p, q, room - less))
    return out


PLACES = T.StructType([T.StructField(n, T.LongType()) for n in ("p_size", "rank_from", "rank_to", "container_from", "each")])


def pack(sizes: DataFrame, key: str, tokens: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """``key``, part, tokens (of the part), container (from 0).

    A text within the capacity is one part. A larger one is cut into parts of ``capacity`` tokens, each alone in
    a container, and a last one that is packed like other texts; part n begins at token n * capacity. Texts without tokens need
    no room: part 0, container null. Rows with a repeated key are texts of their own.
    """
    spark = sizes.sparkSession
    rows = sizes.select(F.col(key), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("_t"))
    empty = rows.where("_t <= 0").select(key, F.lit(0).alias("part"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("container"))
    parts = F.sequence(F.lit(0), ((F.col("_t") - 1) / capacity).cast("int"))
    items = rows.where("_t > 0").select(key, "_t", F.explode(parts).alias("part"))
    items = items.select(key, "part", F.least(F.col("_t") - F.col("part").cast("long") * capacity, F.lit(capacity)).alias("tokens"))
    items = cut(items)
    counts = {r.tokens: r.n for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(counts, capacity)
    places = spark.createDataFrame(plan.places, PLACES)
    if len(plan.places) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    ranked = salted_rank(items, ["tokens"], [F.col(key), F.col("part")], "_rank")
    found = ranked.join(places, (F.col("tokens") == F.col("p_size")) & F.col("_rank").between(F.col("rank_from"), F.col("rank_to")))
    container = F.col("container_from") + F.floor((F.col("_rank") - F.col("rank_from")) / F.col("each"))
    return found.select(key, "part", "tokens", container.alias("container")).unionByName(empty)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text of documents in containers: doc_id, part, tokens, container."""
    return pack(counted(documents, "text", ["doc_id"], vocabulary), "doc_id", "tokens", capacity)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least containers that could hold them, and the share of the room that is used."""
    held = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("t"))
    total = held.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"))
    return total.select("*", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0))).alias("filled"))
