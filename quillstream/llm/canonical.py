"""Freely typed values mapped to the entry of a reference list that they mean (problem 1).

Method: the names of each entry give keys, and a BK-tree over all keys returns every key within a radius under the
Levenshtein distance; a block of typed values goes down the tree together. Radius 0 is tried first, then the radius
that the length of a key allows. A list of up to ``SHARD_ROWS`` entries is one index, built once and broadcast; a
longer one is sharded, each shard has its tree, and the winners of the shards are merged, with the same answers.

Keys are the letters of a name without the words that abbreviations drop, once as written and once with general words
(those of many entries) written out, as the list itself abbreviates them; beside these the initials of a name and its
beginnings, in trees of their own. A typed value is cleaned of what belongs to no name (brackets, years, volume
numbers, article, subtitle, diacritics) and turned round at a comma before its keys are made in the same way.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.edit import BKTree, fold
from quillstream.session import BROADCAST_ROWS, cut

#: Words that titles keep and abbreviations drop.
STOP = frozenset("a an and at by de del der des die for from in la le les of on the to und with & et".split())
#: Share of the entries in which a general word occurs, and the least number of them. No list has more than (words of an entry) / COMMON of them.
COMMON, COMMON_LEAST = 0.004, 3
#: Entries of an index, and values that one task looks up in a shard.
SHARD_ROWS, VALUES = 20_000, 20_000
#: Radius of the search, for keys of at least so many letters.
RADIUS = ((10, 2), (6, 1))
#: First letters by which a general word is known, and letters of a beginning that tells a name.
STEM, BEGUN = 4, 12

_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_TAIL = re.compile(r"(?:[,;.]?\s*\b(?:vol(?:ume)?|no|issue|suppl|pt|part|ser(?:ies)?)\b\.?\s*\w*|[,;]?\s*\b(?:1[89]|20)\d\d\b|[,;:]?\s*\d+)+\s*$", re.I)
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def clean(value: str) -> str:
    """``value`` without markup, brackets, a trailing year or volume, a subtitle and diacritics."""
    text = fold(html.unescape(value))
    text = _BRACKETS.sub(" ", text).replace("_", " ")
    head, colon, _ = text.partition(":")
    if colon and len(_TOKEN.findall(head)) > 1:
        text = head
    text = _TAIL.sub("", text).strip(" \t\r\n.,;:/-'\"*")
    head, comma, rest = text.partition(",")
    if comma and head.strip() and rest.strip() and "," not in rest:
        text = f"{rest.strip()} {head.strip()}"
    if " " not in text and len(_HUMP.findall(text)) > 0:
        text = _HUMP.sub(" ", text)
    return text


def tokens(text: str) -> list[str]:
    """The words of a cleaned text in lower case, without those that abbreviations drop (a last ``the`` may be the beginning of a word)."""
    words = [t.lower() for t in _TOKEN.findall(text)]
    return [w for i, w in enumerate(words) if w not in STOP or w == "the" and 0 < i == len(words) - 1]


class Vocabulary:
    """The general words of a list, with the abbreviations that the list has for them."""

    def __init__(self, words: list[str], short: list[tuple[str, str]]) -> None:
        self.full = sorted(set(words))
        to: dict[str, set[str]] = defaultdict(set)
        for w, y in short:
            to[y].add(w)
        self.known = {y: next(iter(ws)) for y, ws in to.items() if len(ws) == 1} | {w: w for w in self.full}
        self.memo: dict[str, str] = {}

    def complete(self, word: str) -> str:
        """The general word that ``word`` is, abbreviates or begins like; otherwise ``word``."""
        if word not in self.memo:
            self.memo[word] = self._complete(word)
        return self.memo[word]

    def _begin(self, start: str) -> list[str]:
        at = bisect_left(self.full, start)
        return self.full[at : bisect_left(self.full, start + chr(0x10FFFF), at)]

    def _complete(self, word: str) -> str:
        for w in (word, word[:-1] if word.endswith("s") else word):
            if w in self.known:
                return self.known[w]
            if len(w) >= 2 and len(begun := self._begin(w)) == 1:
                return begun[0]
        if len(word) >= 3 and not self._begin(word):  # a contraction: the letters of one general word, without some between its first and last
            span = self.full[bisect_left(self.full, word[0]) : bisect_left(self.full, word[0] + chr(0x10FFFF))]
            if len(inner := [w for w in span if w[-1] == word[-1] and _within(word, w)]) == 1:
                return inner[0]
        if len(word) >= STEM and len(alike := self._begin(word[:STEM])) == 1 and len(word) <= len(alike[0]) + 2:
            return alike[0]
        return word


def _within(part: str, word: str) -> bool:
    """True if the letters of ``part`` occur in ``word`` in this order."""
    it = iter(word)
    return all(c in it for c in part)


def _aligned(title: str | None, abbr: str | None) -> Iterator[tuple[str, str | None]]:
    """(word, None) of the words of an entry and (word of its title, its abbreviation) where both names have as many words."""
    t, a = tokens(clean(title or "")), tokens(clean(abbr or ""))
    yield from ((w, None) for w in t)
    if len(t) == len(a):
        yield from ((x, y) for x, y in zip(t, a) if x[0] == y[0])


def vocabulary(listed: DataFrame, rows: int) -> Vocabulary:
    """The vocabulary of all entries (title, abbr), counted where they are; only general words come to the driver."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([p for t, a in zip(b["title"], b["abbr"]) for p in _aligned(t, a)], columns=["word", "short"])

    counted = cut(listed.select("title", "abbr").mapInPandas(pairs, "word string, short string").groupBy("word", "short").agg(F.count(F.lit(1)).alias("n")))
    common = counted.where(F.col("short").isNull() & (F.col("n") >= max(COMMON_LEAST, COMMON * rows))).select("word")
    short = counted.where(F.col("short").isNotNull()).join(F.broadcast(common), "word").select("word", "short")
    # of the abbreviations of one word only those that a share of its entries has are more than slips
    most = short.join(counted.select("word", "short", "n"), ["word", "short"]).where(F.col("n") >= max(1.0, COMMON * rows / 10))
    return Vocabulary([r.word for r in common.collect()], [(r.word, r.short) for r in most.collect()])


class Index:
    """The BK-trees of a list of (id, title, abbreviation): whole keys, initials and beginnings."""

    def __init__(self, entries: list[tuple[str, str | None, str | None]], vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.written, self.full, self.initials, self.begun = (defaultdict(set) for _ in range(4))
        for id_, title, abbr in entries:
            for name in (title, abbr):
                words = tokens(clean(name or ""))
                if not words:
                    continue
                done = [*map(vocabulary.complete, words)]
                self.written["".join(words)].add(id_)
                self.full["".join(done)].add(id_)
                self.initials["".join(w[0] for w in words)].add(id_)
                if len(words) > 2:  # the first two words run together as their initials
                    self.full[words[0][0] + words[1][0] + "".join(done[2:])].add(id_)
                for n in range(1, len(done)):
                    for last in {done[n], *(done[n][:k] for k in range(2, STEM + 1))}:
                        self.begun["".join(done[:n]) + last].add(id_)
        self.whole = BKTree(sorted({*self.written, *self.full}))
        self.trees = {"initials": BKTree(sorted(self.initials)), "begun": BKTree(sorted(k for k in self.begun if len(k) >= BEGUN))}

    def search(self, values: list[str]) -> list[tuple[str, int, int, str]]:
        """(value, rank, distance, id) of the entries nearest to each value; several if they tie.

        The rank puts keys as written before completed ones, and beginnings, which only an exact search reaches, last.
        """
        asked: dict[str, list[tuple[str, int]]] = defaultdict(list)
        out: list[tuple[str, int, int, str]] = []
        cut_: list[tuple[str, str]] = []
        short: list[tuple[str, str]] = []
        for v in values:
            bare = v.strip().strip(".").replace(".", "")
            words = tokens(clean(v))
            done = [*map(self.vocabulary.complete, words)]
            if bare.isascii() and bare.isalpha() and bare.isupper() and 3 <= len(bare) <= 7:
                short.append((v, bare.lower()))
            for rank, key in ((0, "".join(words)), (1, "".join(done))):
                if key:
                    asked[key].append((v, rank))
            if len(words) > 1 and sum(map(len, done)) >= BEGUN:
                cut_.extend((v, "".join(done[:-1]) + w) for w in {done[-1], done[-1][:STEM]} if w)
        by = (self.written, self.full)
        out += [(v, 0, 0, i) for v, k, d, w in self._near(self.trees["initials"], short, 0) for i in self.initials[w]]
        left = {v for vs in asked.values() for v, _ in vs} - {v for v, *_ in out}
        for exact in (True, False):
            todo = {k: [x for x in vs if x[0] in left] for k, vs in asked.items()}
            radius = {k: 0 if exact else next((r for n, r in RADIUS if len(k) >= n), 0) for k, vs in todo.items() if vs}
            for key, word, d in self.whole.within_many(radius):
                for v, rank in todo[key]:
                    out += [(v, rank, d, i) for i in by[rank].get(word, ())]
            left -= {v for v, *_ in out}
        rest = [x for x in cut_ if x[0] in left]
        return out + [(v, 2, len(k), i) for v, k, d, w in self._near(self.trees["begun"], rest, 0) for i in self.begun[w]]

    @staticmethod
    def _near(tree: BKTree, asked: list[tuple[str, str]], radius: int) -> Iterator[tuple[str, str, int, str]]:
        by: dict[str, list[str]] = defaultdict(list)
        for v, k in asked:
            by[k].append(v)
        for key, word, d in tree.within_many(dict.fromkeys(by, radius)):
            yield from ((v, key, d, word) for v in by[key])


FOUND = "value string, rank int, distance int, entry string"


def _answers(values: pd.Series, index: Index) -> pd.DataFrame:
    return pd.DataFrame(index.search(list(values)), columns=["value", "rank", "distance", "entry"])


def match(values: DataFrame, value: str, entries: DataFrame, entry: str, title: str, abbr: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each distinct non-null value with the one entry it means: value, entry, distance.

    ``entry`` is null, and ``distance`` too, where no entry is within the radius or several entries tie. Entries with a null or blank
    id take no part; an entry may occur in several rows. An empty list matches nothing. Values differ if they
    differ in any character. Of other columns nothing is read. ``shard_rows`` doesn't change the answers.
    """
    spark = values.sparkSession
    typed = values.select(F.col(value).alias("value")).where(F.col("value").isNotNull()).distinct()
    listed = cut(entries.select(F.col(entry).alias("entry"), F.col(title).alias("title"), F.col(abbr).alias("abbr")).where("trim(entry) <> ''").distinct())
    n = listed.count()
    words = vocabulary(listed, n)
    if n <= shard_rows:
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in listed.collect()], words))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield _answers(b["value"], index.value)

        found = typed.repartition(spark.sparkContext.defaultParallelism, "value").mapInPandas(search, FOUND)
    else:
        found = _sharded(cut(typed), listed, -(-n // shard_rows), words)
    best = found.groupBy("value", "entry").agg(F.min(F.struct("distance", "rank")).alias("b"))
    # a shard doesn't know whether another has the value exactly: beginnings count only where no shard has a whole key
    order = lambda b: F.struct((b["rank"] == 2).alias("begun"), b["distance"].alias("distance"), b["rank"].alias("rank"))
    nearest = best.select("value", "entry", order(F.col("b")).alias("b")).groupBy("value").agg(F.min_by("entry", "b").alias("entry"), F.min("b").alias("b"), F.collect_list("b").alias("all"))
    alone = F.when(F.col("b.begun"), F.size("all") == 1).otherwise(F.size(F.filter("all", lambda x: x == F.col("b"))) == 1)
    return typed.join(nearest.where(alone).select("value", "entry", "b.distance"), "value", "left")


def _sharded(typed: DataFrame, listed: DataFrame, shards: int, words: Vocabulary) -> DataFrame:
    """The search over hash shards of the list: every value visits every shard, in as many tasks as there are ``VALUES`` values."""
    salts = max(1, -(-typed.count() // VALUES))
    sent = typed.sparkSession.sparkContext.broadcast(words)
    left = typed.select("value", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int").alias("salt"))
    right = listed.select("*", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _answers(a["value"], Index(list(b[["entry", "title", "abbr"]].itertuples(index=False, name=None)), sent.value))

    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(search, FOUND)


def journals_of(refs: DataFrame, journals: DataFrame) -> DataFrame:
    """Every row of refs: ref_id, journal, nlmid, status (``listed``, ``mapped``, ``unmatched`` or ``missing``).

    ``listed`` values are character for character a title or abbreviation of the list; their nlmid is that of
    the row with the highest ``ord`` (null if that row has none). ``unmatched`` values mean no entry or can't be
    told; ``missing`` ones are null or blank.
    """
    names = journals.select("nlmid", "ord", F.explode(F.array("medabbr", "journaltitle")).alias("name")).where("trim(name) <> ''")
    exact = names.groupBy("name").agg(F.max_by("nlmid", "ord").alias("nlmid"))
    typed = refs.select("journal").where("trim(journal) <> ''").distinct().join(F.broadcast(exact) if exact.count() <= BROADCAST_ROWS else exact, F.col("journal") == F.col("name"), "left")
    rest = match(typed.where(F.col("name").isNull()), "journal", journals, "nlmid", "journaltitle", "medabbr")
    status = F.when(F.col("entry").isNotNull(), "mapped").otherwise("unmatched")
    answers = typed.where(F.col("name").isNotNull()).select("journal", F.nullif("nlmid", F.lit("")).alias("nlmid"), F.lit("listed").alias("status")).unionByName(
        rest.select(F.col("value").alias("journal"), F.col("entry").alias("nlmid"), status.alias("status"))
    )
    answers = cut(answers)
    if answers.count() <= BROADCAST_ROWS:
        answers = F.broadcast(answers)
    return refs.select("ref_id", "journal").join(answers, "journal", "left").select("ref_id", "journal", "nlmid", F.coalesce("status", F.lit("missing")).alias("status"))


def unmatched(refs: DataFrame, journals: DataFrame) -> DataFrame:
    """The report of values that mean no entry: journal, n_rows."""
    return journals_of(refs, journals).where("status = 'unmatched'").groupBy("journal").agg(F.count(F.lit(1)).alias("n_rows"))
