"""Strings within one edit of each other, by tries and Levenshtein automata.

Strings are sharded by an intact part: one edit (an insertion, deletion, substitution or a swap of neighbours)
leaves the beginning or the end of a string as it was, up to one short of the middle. Each shard builds a trie
and walks it with the automaton of each of its strings, whose state is the band of the edit matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.session import cut

#: Strings shorter than this have a neighbour's sense only by many more rows: one edit makes another word of most of them.
SHORT, SHORT_TIMES = 5, 20.0
#: A shard with more strings is walked by several tasks.
PER_TASK = 4_000
#: A trie holds about so many strings at most; a larger shard has several.
PER_TRIE = 100_000


class Trie:
    """A trie of strings; ``near`` enumerates those within a distance of one string."""

    def __init__(self, words) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, most: int = 1) -> list[tuple[str, int]]:
        """(string, distance) of all strings within ``most`` edits, a swap of neighbours being one edit.

        The automaton's state after i letters is the edits to the beginnings of ``word`` of i - ``most`` to i + ``most`` letters: of the
        edit matrix only this band can stay within the bound, so a step costs the same for a word of any length.
        """
        out: list[tuple[str, int]] = []
        n, width, far = len(word), 2 * most + 1, most + 1
        first = [far] * most + [min(j, far) for j in range(most + 1)]
        todo = [(self.root, 0, "", first, None)]
        while todo:
            node, i, last, row, before = todo.pop()
            end = n - i + most
            if "" in node and 0 <= end < width and row[end] <= most:
                out.append((node[""], row[end]))
            for c, child in node.items():
                if c == "":
                    continue
                now = [far] * width
                for k in range(width):  # the beginning of j letters
                    j = i + 1 - most + k
                    if not 0 <= j <= n:
                        continue
                    d = row[k + 1] + 1 if k + 1 < width else far
                    if j > 0:
                        d = min(d, row[k] + (word[j - 1] != c), now[k - 1] + 1 if k else far)
                        if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                            d = min(d, before[k] + 1)
                    now[k] = min(d, far)
                if min(now) <= most or most and min(row) < most:
                    todo.append((child, i + 1, c, now, row))
        return out


def _parts(text: Column) -> Column:
    """The shard keys of a string: its beginnings and ends of the lengths that a neighbour can share."""
    n = F.length(text)
    size = lambda x: F.greatest(F.floor(x / 2) - 1, F.when(x < SHORT, 1).otherwise(2)).cast("int")
    sizes = F.array_distinct(F.array(size(n - 1), size(n), size(n + 1)))
    starts = F.transform(sizes, lambda k: F.concat(F.lit("<"), F.substring(text, F.lit(1), k), F.lit(":"), k))
    ends = F.transform(sizes, lambda k: F.concat(F.lit(">"), F.right(text, k), F.lit(":"), k))
    # a swap leaves nothing of two letters
    return F.concat(starts, ends, F.when(n <= 3, F.array(F.lit("two"))).otherwise(F.array().cast("array<string>")))


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for a stage in Python over ``df``: one for each ``rows`` rows, but as many as run at once as far as there are rows for them.

    Adaptive execution goes by bytes, which says little about the work in Python.
    """
    n, at_once = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // rows), min(2 * at_once, n // 200))


def neighbours(strings: DataFrame, kind: str, text: str) -> DataFrame:
    """Pairs (kind, a, b), both ways, of different strings of one ``kind`` that are one edit apart.

    Null strings and single letters have no neighbours; repeated strings count once. A shard
    of n strings is walked by about n / ``PER_TASK`` tasks over tries of about ``PER_TRIE`` strings, so a hot
    beginning takes more tasks and not a longer one.
    """
    rows = strings.select(F.col(kind).alias("kind"), F.col(text).alias("a")).where(F.length("a") >= 2).distinct()
    keyed = rows.select("kind", "a", F.explode(_parts(F.col("a"))).alias("part"))
    sizes = keyed.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = cut(keyed.join(sizes, ["kind", "part"]))
    tasks, tries = (F.ceil(F.col("n") / x).cast("int") for x in (PER_TASK, PER_TRIE))
    place = lambda n: F.pmod(F.xxhash64("a"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = keyed.select("kind", "part", "a", place(tasks).alias("task"), every(tries).alias("trie"))
    shard = keyed.select("kind", "part", "a", place(tries).alias("trie"), tasks.alias("_t")).select("kind", "part", "a", "trie", every(F.col("_t")).alias("task"))
    by = ["kind", "part", "task", "trie"]
    n_tasks = tasks_for(keyed, PER_TASK)

    def walk(batches):
        import pyarrow as pa

        for b in batches:
            kinds, ask, words = b["kind"].to_pylist(), b["ask"].to_pylist(), b["words"].to_pylist()
            found = [(k, x, y) for k, xs, ws in zip(kinds, ask, words) for t in (Trie(ws),) for x in xs for y, d in t.near(x) if d]
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in found] for i, c in enumerate(("kind", "a", "b"))}, schema=pa.schema([(c, pa.string()) for c in ("kind", "a", "b")]))

    asked, shard = (x.repartition(n_tasks, *by) for x in (asked, shard))
    lists = asked.groupBy(*by).agg(F.collect_list("a").alias("ask")).join(shard.groupBy(*by).agg(F.collect_list("a").alias("words")), by)
    return cut(lists.mapInArrow(walk, "kind string, a string, b string").distinct())


def bases(strings: DataFrame, kind: str, text: str, rows: str, times: float = 2.0) -> DataFrame:
    """Each string that is a misspelling with the string it stands for: kind, text, base.

    The base is the neighbour with the most rows, if that has more than ``times`` as many (``SHORT_TIMES`` for strings of under ``SHORT``
    letters). Strings without such a neighbour aren't returned.
    """
    s = strings.select(F.col(kind).alias("kind"), F.col(text).alias("t"), F.col(rows).alias("n"))
    pairs = neighbours(strings, kind, text)
    own = pairs.join(s.withColumnsRenamed({"t": "a", "n": "n_a"}), ["kind", "a"])
    both = own.join(s.withColumnsRenamed({"t": "b", "n": "n_b"}), ["kind", "b"]).where(F.col("n_b") > F.col("n_a") * F.when(F.least(F.length("a"), F.length("b")) < SHORT, SHORT_TIMES).otherwise(times))
    return both.groupBy("kind", "a").agg(F.max_by("b", F.struct("n_b", "b")).alias("base")).withColumnRenamed("a", "text")
