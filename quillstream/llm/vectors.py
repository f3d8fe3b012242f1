"""The most similar vectors of every vector, within a calibrated loss (problem 4).

Method: hierarchical k-means tree with best-bin-first search. The tree is fitted on a bounded sample; every vector
is indexed in the leaf it falls into and searched in the leaves that a priority queue visits first. How many
leaves that takes is calibrated: a sample of vectors is compared with all others, and the visits are widened until
the wanted share of true neighbours lies in the visited leaves. Leaves are stored in bins of neighbouring leaves,
so that a vector travels to the few bins that hold its leaves, and once to each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.session import BROADCAST_ROWS, cut

K, DIMENSIONS = 5, 64
#: The tree is fitted on at most SAMPLE vectors and splits a node into at most BRANCH; a leaf should hold LEAF vectors. A wide top
#: follows the clusters of the data; a narrow one cuts through them, and its borders cost many visits.
SAMPLE, BRANCH, LEAF = 60_000, 96, 800
#: Share of true neighbours that must lie in the visited leaves, measured with so many vectors against all.
RECALL, PROBES = 0.93, 400
#: Vectors in a bin; a leaf with more is divided by a hash of the vector's id.
BIN = 12_000
#: A class of exact copies with more members than K + 1 is searched through its first K + 1.
COPIES = K + 1
#: Vectors that go down the tree together, and vectors of the sample with which the work of bins is estimated.
ROUTED, PLANNED = 8_192, 8_192
#: Vectors that ask in one slot, and MB that a task reads.
ASKS, TASK_MB = 48_000, 48
#: Similarities that a Python worker holds at once (with their order that is 16 bytes each), visits to leaves that it takes apart at
#: once, and rows that it sends at once.
CELLS, VISITED, SENT = 4_000_000, 250_000, 25_000
_SCALE = 32_000.0


def valid(v: Column) -> Column:
    """True for a vector of ``DIMENSIONS`` finite components that aren't all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == DIMENSIONS) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(batch: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow list column as rows of norm 1."""
    if isinstance(batch, pa.ChunkedArray):
        batch = batch.combine_chunks()
    x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), DIMENSIONS).astype(np.float32)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """A k-means tree: node centroids, and for each leaf its path of nodes from the top."""

    def __init__(self, sample: np.ndarray, rows: int, leaf: int = LEAF, seed: int = 11) -> None:
        rng, each = np.random.default_rng(seed), rows / max(1, len(sample))
        self.centres: list[np.ndarray] = []
        self.paths: list[list[int]] = []
        self.sizes: list[float] = []
        todo = [(sample, [])]
        while todo:
            x, path = todo.pop()
            k = min(BRANCH, math.ceil(len(x) * each / leaf), len(x) // 8)
            if k < 2:
                self.paths.append(path)
                self.sizes.append(len(x) * each)
                continue
            c, own = _kmeans(x, k, rng)
            kept = [j for j in range(len(c)) if (own == j).any()]
            if len(kept) < 2:
                self.paths.append(path)
                self.sizes.append(len(x) * each)
                continue
            for j in kept:
                self.centres.append(c[j])
                todo.append((x[own == j], [*path, len(self.centres) - 1]))
        if not self.centres:  # one leaf: a node that all vectors reach
            self.centres, self.paths = [np.zeros(DIMENSIONS, np.float32)], [[0]]
        self.nodes = np.array(self.centres, np.float32)
        deep = max(map(len, self.paths))
        self.lines = np.array([[*p, *[p[-1]] * (deep - len(p))] for p in self.paths])
        self.tops = sorted({p[0] for p in self.paths})
        #: For each branch at the top its nodes, the ways of its leaves in them, and the leaves.
        self.below = []
        for top in self.tops:
            own = np.array([i for i, p in enumerate(self.paths) if p[0] == top])
            nodes, lines = np.unique(self.lines[own], return_inverse=True)
            self.below.append((nodes, lines.reshape(len(own), -1), own.astype(np.int32)))

    def reach(self, q: np.ndarray, leaves: int) -> np.ndarray:
        """For each query the leaves that best-bin-first visits, in the order of the visits.

        The queue of a query holds the branches at the top by similarity and the leaves found below the branches opened so far by the
        least similarity on their way. It opens its next branch as long as that could hold a leaf better than the last
        one wanted; the branches behind it are never compared. Queries that open the same branch are compared with its nodes together.
        """
        leaves = min(leaves, len(self.paths))
        best, names = np.full((len(q), leaves), -9.0, np.float32), np.zeros((len(q), leaves), np.int32)
        s = q @ self.nodes[self.tops].T
        turn = np.argsort(-s, axis=1, kind="stable")
        live = np.arange(len(q))
        for r in range(len(self.tops)):
            branch = turn[live, r]
            sim = s[live, branch]
            open_ = sim + 1e-5 > best[live, -1]
            live, branch, sim = live[open_], branch[open_], sim[open_]
            if not len(live):
                break
            by = np.argsort(branch, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(branch[by])) + 1):
                top, rows = branch[part[0]], live[part]
                under, lines, own = self.below[top]
                inner = q[rows] @ self.nodes[under].T
                way = np.repeat(sim[part][:, None], len(own), axis=1)
                for d in range(lines.shape[1]):
                    np.minimum(way, inner[:, lines[:, d]], out=way)
                way += 1e-5 * inner[:, lines[:, -1]]  # leaves behind one node: the closest first
                all_p, all_n = np.concatenate([best[rows], way], 1), np.concatenate([names[rows], np.broadcast_to(own, way.shape)], 1)
                first = np.argsort(-all_p, axis=1, kind="stable")[:, :leaves]
                best[rows], names[rows] = np.take_along_axis(all_p, first, 1), np.take_along_axis(all_n, first, 1)
        return names

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first leaves of one query by a heap over all nodes, against which ``reach`` is tested."""
        under: dict[int, set[int]] = {}
        ends: dict[int, int] = {}
        for i, p in enumerate(self.paths):
            for a, b in zip(p, p[1:]):
                under.setdefault(a, set()).add(b)
            ends[p[-1]] = i
        s = self.nodes @ q
        queue, out = [(-s[n], n) for n in self.tops], []
        heapq.heapify(queue)
        while queue and len(out) < leaves:
            _, n = heapq.heappop(queue)
            if n in ends:
                out.append(ends[n])
            for m in under.get(n, ()):
                heapq.heappush(queue, (-s[m], m))
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree, the closest child at each level.

        Vectors below one branch at the top are compared with its nodes only, so that neither the work nor the memory for a vector
        grows with all leaves.
        """
        out = np.zeros(len(x), np.int64)
        top = (x @ self.nodes[self.tops].T).argmax(axis=1)
        by = np.argsort(top, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(top[by])) + 1) if len(x) else ():
            under, lines, own = self.below[top[part[0]]]
            step = max(1, CELLS // len(under))
            for rows in (part[i : i + step] for i in range(0, len(part), step)):
                s = x[rows] @ self.nodes[under].T
                alive = np.ones((len(rows), len(own)), bool)
                for d in range(1, lines.shape[1]):
                    level = np.where(alive, s[:, lines[:, d]], -9.0)
                    alive &= level >= level.max(axis=1, keepdims=True)
                out[rows] = own[alive.argmax(axis=1)]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros((k, x.shape[1]), np.float32)
        np.add.at(total, own, x)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        lost = n[:, 0] < 1e-6
        c = np.where(n > 1e-6, total / np.maximum(n, 1e-6), c)
        if lost.any():
            c[lost] = x[rng.choice(len(x), int(lost.sum()))]
    return c, np.argmax(x @ c.T, axis=1)


def _blocks(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block of each leaf, blocks of each leaf, bin of each block); leaves of similar branches share bins."""
    parts = np.array([max(1, math.ceil(s / BIN)) for s in tree.sizes])
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    under: dict[int, list[int]] = {}
    for leaf, path in enumerate(tree.paths):
        under.setdefault(path[0], []).append(leaf)
    left, order = sorted(under), []
    mean = np.zeros(DIMENSIONS, np.float32)
    while left:  # the branch most similar to those before it comes next
        near = tree.nodes[left] @ mean
        top = left.pop(int(np.argmax(near)))
        order += under[top]
        mean = 0.7 * mean + tree.nodes[top]
    bins, room, b = np.zeros(parts.sum(), int), 0.0, 0
    for leaf in order:
        for i in range(parts[leaf]):
            size = tree.sizes[leaf] / parts[leaf]
            if room and room + size > BIN:
                b, room = b + 1, 0.0
            bins[first[leaf] + i] = b
            room += size
    return first, parts, bins


def _top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, s.shape[1])
    at = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(s), 1))
    return at, np.take_along_axis(s, at, 1)


def exact(vectors: DataFrame, id_: str, vector: str, queries: tuple[np.ndarray, np.ndarray], k: int = K, tree: Tree | None = None) -> DataFrame:
    """(q, id, cosine, leaf) of the true neighbours of a block of queries (ids, unit vectors), compared with all vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast((*queries, tree))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, t = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, own = unit(b.column(1)), b.column(0).to_numpy()
            step = max(1, CELLS // len(x))
            for i in range(0, len(q), step):
                s = q[i : i + step] @ x.T
                s[ids[i : i + step, None] == own[None, :]] = -9.0
                at, best = _top(s, k)
                flat = at.ravel()
                leaf = t.home(x[flat]) if t is not None else np.zeros(len(flat), int)
                yield pa.record_batch([pa.array(np.repeat(ids[i : i + step], at.shape[1])), pa.array(own[flat]), pa.array(best.ravel().astype(np.float32)), pa.array(leaf.astype(np.int32))], names=["q", "id", "cosine", "leaf"])

    rows = vectors.select(id_, vector).where(valid(F.col(vector)))
    near = rows.mapInArrow(compare, "q long, id long, cosine float, leaf int").where("cosine > -5")
    best = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", (-F.col("id")).alias("id"), "leaf")), asc=False), 1, k).alias("n"))
    return best.select("q", F.explode("n").alias("n")).select("q", (-F.col("n.id")).alias("id"), "n.cosine", "n.leaf")


def fit(vectors: DataFrame, id_: str, vector: str, recall: float = RECALL) -> tuple[Tree, int, float] | None:
    """(tree, leaves to visit, recall measured on the probes); None without valid vectors.

    The sample is the vectors with the lowest hashes of their ids, about ``SAMPLE`` of them.
    """
    rows = vectors.count()
    share = F.pmod(F.xxhash64(F.lit(5), F.col(id_)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, rows)))
    got = vectors.select(id_, vector).where(share & valid(F.col(vector))).limit(2 * SAMPLE).toArrow()
    if not got.num_rows:
        return None
    ids, x = got.column(0).to_numpy(), unit(got.column(1))
    first = np.argsort(ids)
    ids, x = ids[first], x[first]
    # the probes take no part in fitting the tree, so that what is measured with them holds for other vectors
    pick = np.linspace(0, len(x) - 1, min(PROBES, len(x) // 2)).astype(int) if len(x) > 1 else np.zeros(1, int)
    rest = np.delete(x, pick, axis=0)
    tree = Tree(rest if len(rest) else x, max(rows, len(x)))
    truth = exact(vectors, id_, vector, (ids[pick], x[pick]), K, tree).select("q", "leaf").toPandas()
    rank = np.argsort(tree.reach(x[pick], len(tree.paths)), axis=1)
    at = {int(i): n for n, i in enumerate(ids[pick])}
    ranks = np.array([rank[at[q], leaf] for q, leaf in zip(truth["q"], truth["leaf"])]) if len(truth) else np.array([0])
    visits = next((v for v in range(1, len(tree.paths) + 1) if (ranks < v).mean() >= recall), len(tree.paths))
    tree.sample = rest[:: max(1, len(rest) // PLANNED)] if len(rest) else x
    return tree, visits, float((ranks < visits).mean())


class Slots:
    """Where the blocks of leaves and the vectors that ask for them meet.

    A block lies in a bin of at most about BIN members. The vectors that ask for a bin are divided into as many slots as their
    number, estimated from the sample, requires, each with a copy of the members; slots are dealt to tasks of equal work.
    """

    def __init__(self, tree: Tree, visits: int, rows: int, parallel: int) -> None:
        self.first, self.parts, self.bins = _blocks(tree)
        n_bins = int(self.bins.max()) + 1
        each = rows / max(1, len(tree.sample))
        asks, members = np.zeros(n_bins), np.zeros(n_bins)
        block, step = max(1, CELLS // visits), max(1, VISITED // visits)
        visited = (tree.reach(tree.sample[i : i + block], visits) for i in range(0, len(tree.sample), block))
        for seen in (some[i : i + step] for some in visited for i in range(0, len(some), step)):
            many = self.parts[seen.ravel()]
            leaf = np.repeat(seen.ravel(), many)
            nth = np.arange(len(leaf)) - np.repeat(np.cumsum(many) - many, many)
            who = np.repeat(np.repeat(np.arange(len(seen)), seen.shape[1]), many)
            pairs = np.unique(who * n_bins + self.bins[self.first[leaf] + nth])
            asks += each * np.bincount(pairs % n_bins, minlength=n_bins)
        np.add.at(members, self.bins, np.repeat(np.array(tree.sizes) / self.parts, self.parts))
        self.salts = np.maximum(1, np.ceil(asks / ASKS)).astype(int)
        self.start = np.concatenate([[0], np.cumsum(self.salts)[:-1]])
        bin_ = np.repeat(np.arange(n_bins), self.salts)
        load = asks[bin_] / self.salts[bin_]
        work = load * (500 + members[bin_]) + 500 * members[bin_]
        size = (load + members[bin_]) * 300 / 1e6
        self.tasks = int(min(len(work), max(2 * parallel, math.ceil(size.sum() / TASK_MB))))
        self.task = np.zeros(len(work), np.int32)
        heap = [(0.0, t) for t in range(self.tasks)]
        for slot in np.argsort(-work):
            done, t = heapq.heappop(heap)
            self.task[slot] = t
            heapq.heappush(heap, (done + work[slot], t))


def neighbours(vectors: DataFrame, id_: str = "vec_id", vector: str = "embeddings", k: int = K, recall: float = RECALL) -> DataFrame:
    """The ``k`` most similar other vectors of each valid vector: vec_id, near (array of id and cosine, most similar first).

    Vectors that are null, all zero, of another length or not finite have no row and are no neighbours; equal
    similarities are ordered by id. A vector among few others has fewer neighbours. Of more than ``COPIES`` exact
    copies those with the lowest ids stand for all: the others have them as their neighbours. Ids must be unique.
    """
    rows = vectors.select(F.col(id_).alias("vec_id"), F.col(vector).alias("v"))
    spark = rows.sparkSession
    found = fit(rows, "vec_id", "v", recall)
    if found is None:
        return spark.createDataFrame([], "vec_id long, near array<struct<id:long,cosine:float>>")
    tree, visits, _ = found
    keys = [F.xxhash64(F.lit(i), "v") for i in (1, 2)]
    sizes = rows.where(valid(F.col("v"))).groupBy(*[x.alias(f"h{i}") for i, x in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > COPIES).select("h0", "h1"))
    copies = None
    if (n := large.count()) > 0:
        side = F.broadcast(large) if n <= BROADCAST_ROWS else large
        members = rows.where(valid(F.col("v"))).select("vec_id", *[x.alias(f"h{i}") for i, x in enumerate(keys)]).join(side, ["h0", "h1"], "left_semi")
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("h0", "h1").orderBy("vec_id"))
        heads = cut(members.withColumn("_r", rank).where(F.col("_r") <= COPIES).groupBy("h0", "h1").agg(F.sort_array(F.collect_list("vec_id")).alias("heads")))
        side = F.broadcast(heads) if n <= BROADCAST_ROWS else heads
        copies = members.join(side, ["h0", "h1"]).where(~F.array_contains("heads", F.col("vec_id")))
        near = F.transform(F.slice("heads", 1, k), lambda i: F.struct(i.alias("id"), F.lit(1.0).cast("float").alias("cosine")))
        copies = cut(copies.select("vec_id", near.alias("near")))
        rows = rows.join(F.broadcast(copies.select("vec_id")) if copies.count() <= BROADCAST_ROWS else copies.select("vec_id"), "vec_id", "left_anti")
    slots = Slots(tree, visits, max(1, rows.count()), spark.sparkContext.defaultParallelism)
    tree.sample = None
    sent = spark.sparkContext.broadcast((tree, visits, slots))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, n_visits, at = sent.value
        block_of = max(1, min(ROUTED, CELLS // n_visits))
        for b in (c for whole in batches for c in (whole.slice(i, block_of) for i in range(0, whole.num_rows, block_of))):
            ids, x = b.column(0).to_numpy(), unit(b.column(1))
            home, seen = t.home(x), t.reach(x, n_visits)
            step = max(1, VISITED // (seen.shape[1] + int(at.salts.max())))
            for i in range(0, len(x), step):
                yield from send(ids[i : i + step], x[i : i + step], home[i : i + step], seen[i : i + step], at)

    def send(ids: np.ndarray, x: np.ndarray, home: np.ndarray, seen: np.ndarray, at: Slots) -> Iterator[pa.RecordBatch]:
        f, p, to = at.first, at.parts, at.bins
        block = f[home] + np.abs(ids) % p[home]
        # all blocks of the visited leaves, and the bins that hold them
        who, leaf = np.repeat(np.arange(len(x)), seen.shape[1]), seen.ravel()
        many = p[leaf]
        who, leaf = np.repeat(who, many), np.repeat(leaf, many)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        blocks_ = f[leaf] + nth
        order = np.lexsort((blocks_, to[blocks_], who))
        who, blocks_ = who[order], blocks_[order]
        bin_ = to[blocks_]
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (bin_[1:] != bin_[:-1])])
        start = np.flatnonzero(new)
        # a member goes to every slot of its bin, a vector that asks to one of them
        copies = at.salts[to[block]]
        member = np.repeat(np.arange(len(x)), copies)
        nth = np.arange(len(member)) - np.repeat(np.cumsum(copies) - copies, copies)
        held = at.start[to[block[member]]] + nth
        asking = who[start]
        asked = at.start[bin_[start]] + (np.abs(ids[asking]) // 7) % at.salts[bin_[start]]
        code = np.round(x * _SCALE).astype(np.int16)
        rows_at = np.concatenate([member, asking])
        offsets = np.concatenate([np.arange(len(member)), len(member) + start, [len(member) + len(blocks_)]]).astype(np.int32)
        flat = np.concatenate([block[member], blocks_]).astype(np.int32)
        role = np.concatenate([np.zeros(len(member), bool), np.ones(len(start), bool)])
        slot = np.concatenate([held, asked]).astype(np.int32)
        for i in range(0, len(slot), SENT):
            part, ends = rows_at[i : i + SENT], offsets[i : i + SENT + 1]
            lists = pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(flat[ends[0] : ends[-1]]))
            raw = pa.Array.from_buffers(pa.binary(2 * DIMENSIONS), len(part), [None, pa.py_buffer(np.ascontiguousarray(code[part]))]).cast(pa.binary())
            to_ = slot[i : i + SENT]
            yield pa.record_batch([pa.array(at.task[to_]), pa.array(to_), pa.array(role[i : i + SENT]), pa.array(ids[part]), lists, raw], names=["task", "slot", "asks", "vec_id", "blocks", "code"])

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        code = table.column("code").combine_chunks()
        lists = table.column("blocks").combine_chunks()
        data = np.frombuffer(code.buffers()[2], np.int16)[code.offset * DIMENSIONS :][: len(code) * DIMENSIONS] if len(code) else np.zeros(0, np.int16)
        x = data.reshape(len(code), DIMENSIONS).astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        offsets, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
        flat = flat[: len(owner)]
        q_rows = np.flatnonzero(asks)
        slot = np.full(len(asks), -1)
        slot[q_rows] = np.arange(len(q_rows))
        best = np.full((len(q_rows), k), -9.0, np.float32)
        names = np.full((len(q_rows), k), -1, np.int64)
        by = np.argsort(flat, kind="stable")
        marks = np.flatnonzero(np.diff(flat[by], prepend=-1))
        for a, z in zip(marks, [*marks[1:], len(by)]):
            here = owner[by[a:z]]
            m, q = here[~asks[here]], here[asks[here]]
            if not len(m) or not len(q):
                continue
            step = max(1, min(2048, CELLS // len(m)))
            for c in range(0, len(q), step):
                part = q[c : c + step]
                s = x[part] @ x[m].T
                s[ids[part][:, None] == ids[m][None, :]] = -9.0
                at, top = _top(s, k)
                i = slot[part]
                all_s, all_n = np.concatenate([best[i], top], 1), np.concatenate([names[i], ids[m][at]], 1)
                keep = np.lexsort((all_n, -all_s), axis=1)[:, :k]
                best[i], names[i] = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_n, keep, 1)
        good = best > -5
        rows_ = good.sum(1)
        near = pa.StructArray.from_arrays([pa.array(names[good]), pa.array(np.minimum(best[good], 1.0))], ["id", "cosine"])
        ends = np.concatenate([[0], np.cumsum(rows_)]).astype(np.int32)
        return pa.table({"vec_id": pa.array(ids[q_rows]), "near": pa.ListArray.from_arrays(pa.array(ends), near)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            slot = table.column("slot").to_numpy()
            by = np.argsort(slot, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(slot[by])) + 1):
                yield from search(table.take(pa.array(part)).combine_chunks()).to_batches()

    out = "vec_id long, near array<struct<id:long,cosine:float>>"
    routed = rows.where(valid(F.col("v"))).mapInArrow(route, "task int, slot int, asks boolean, vec_id long, blocks array<int>, code binary")
    parts_ = routed.repartitionById(slots.tasks, F.col("task")).mapInArrow(work, out)
    together = F.flatten(F.collect_list("near"))
    ranked = F.slice(F.sort_array(F.transform(together, lambda n: F.struct(n["cosine"].alias("cosine"), (-n["id"]).alias("id"))), asc=False), 1, k)
    near = F.transform(ranked, lambda n: F.struct((-n["id"]).alias("id"), n["cosine"].alias("cosine")))
    result = parts_.groupBy("vec_id").agg(near.alias("near"))
    return result if copies is None else result.unionByName(copies)


def pairs(near: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, of vectors of which one is among the neighbours of the other with at least this cosine."""
    n = near.select("vec_id", F.explode(F.filter("near", lambda x: x["cosine"] >= F.lit(least).cast("float"))).alias("n"))
    return n.select(F.least("vec_id", "n.id").alias("vec_a"), F.greatest("vec_id", "n.id").alias("vec_b")).distinct()


def recall(vectors: DataFrame, near: DataFrame, id_: str = "vec_id", vector: str = "embeddings", every: int = 100, block: int = 4096) -> DataFrame:
    """One row: queries, true neighbours, those found, recall; for the vectors whose id ``every`` divides, against all vectors, in blocks."""
    asked = cut(vectors.where((F.col(id_) % every == 0) & valid(F.col(vector))).select(F.col(id_).alias("vec_id"), F.col(vector).alias("v")))
    n = asked.count()
    rounds = max(1, math.ceil(n / block))
    truth = None
    for i in range(rounds):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == i).toArrow()
        if got.num_rows:
            part = exact(vectors, id_, vector, (got.column(0).to_numpy(), unit(got.column(1)))).select("q", "id", "cosine")
            truth = part if truth is None else truth.unionAll(part)
    if truth is None:
        return vectors.sparkSession.createDataFrame([(0, 0, 0, None)], "queries long, neighbours long, found long, recall double")
    mine = near.select(F.col("vec_id").alias("q"), F.explode("near").alias("n")).select("q", F.col("n.id").alias("id"), F.lit(1).alias("hit"))
    both = truth.join(mine, ["q", "id"], "left")
    total = both.agg(F.countDistinct("q").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))
    return total.withColumn("recall", F.col("found") / F.col("neighbours"))
