"""Edit distances, a BK-tree and small text foldings shared by the matching operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import numpy as np


def fold(text: str) -> str:
    """``text`` without diacritics, in compatibility form (ligatures and full-width letters resolved)."""
    if text.isascii():
        return text
    plain = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("æ", "ae").replace("Æ", "AE").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))


def levenshtein(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, a true metric; ``most`` + 1 as soon as it must exceed ``most``."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if most is not None and len(a) - len(b) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        least = i
        for j, y in enumerate(b, 1):
            now = last if x == y else 1 + min(last, row[j], row[j - 1])
            last, row[j] = row[j], now
            if now < least:
                least = now
        if most is not None and least > most:
            return most + 1
    return row[-1]


def _masks(word: str) -> dict[str, int]:
    """For each character of ``word`` the bits of its places."""
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        at[c] = at.get(c, 0) | 1 << i
    return at


def distance(word: str, other: str) -> int:
    """Levenshtein distance by bit vectors: a column of the edit matrix is two integers, whatever its length."""
    if not word or not other:
        return len(word) + len(other)
    at, last, all_ = _masks(word), 1 << len(word) - 1, (1 << len(word)) - 1
    up, down, d = all_, 0, len(word)
    for c in other:
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up) & all_, up & x
        d += (plus & last > 0) - (minus & last > 0)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~((eq | down) | plus)) & all_, plus & (eq | down) & all_
    return d


class Texts:
    """Strings as a matrix of character codes, for distances of one word to all of them at once."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int32)
        self.code: dict[str, int] = {}
        self.matrix = np.zeros((len(texts), int(self.size.max(initial=0))), np.int32)
        for i, t in enumerate(texts):
            self.matrix[i, : len(t)] = [self.code.setdefault(c, len(self.code) + 1) for c in t]

    def distances(self, word: str, rows: np.ndarray) -> np.ndarray:
        """``distance`` of ``word`` to the strings of ``rows``: the same bit vectors for a whole column of strings."""
        if not 0 < len(word) <= 64 or len(rows) < 8:
            return np.array([distance(word, self.texts[i]) for i in rows], np.int32)
        one, full = np.uint64(1), np.uint64((1 << len(word)) - 1)
        peq = np.zeros(len(self.code) + 1, np.uint64)
        for c, bits in _masks(word).items():
            if c in self.code:
                peq[self.code[c]] = bits
        top = np.uint64(len(word) - 1)
        size = self.size[rows]
        up, down = np.full(len(rows), full), np.zeros(len(rows), np.uint64)
        d = np.full(len(rows), len(word), np.int32)
        out = d.copy()
        chars = self.matrix[rows, : size.max(initial=0)]
        for j in range(chars.shape[1]):
            eq = peq[chars[:, j]]
            seen = eq | down
            x = (((eq & up) + up) ^ up) | seen
            plus, minus = down | ~(x | up), up & x
            d += ((plus >> top) & one).astype(np.int32) - ((minus >> top) & one).astype(np.int32)
            plus, minus = (plus << one) | one, minus << one
            up, down = minus | ~(seen | plus), plus & seen
            np.copyto(out, d, where=size == j + 1)
        return out


class BKTree:
    """Burkhard-Keller tree: strings under a metric, with all entries within a radius found by pruning.

    A child hangs under the distance to its parent; by the triangle inequality only children whose distance
    differs from that of the query by at most the radius can hold a match. Repeated strings are kept once.
    """

    def __init__(self, entries: Iterable[str] = (), metric: Callable[[str, str], int] = distance) -> None:
        self.metric, self.words, self.children = metric, [], []
        for e in entries:
            self.add(e)

    def add(self, word: str) -> None:
        if not self.words:
            self.words.append(word)
            self.children.append({})
            return
        at = 0
        while True:
            d = self.metric(word, self.words[at])
            if d == 0:
                return
            if d not in self.children[at]:
                break
            at = self.children[at][d]
        self.children[at][d] = len(self.words)
        self.words.append(word)
        self.children.append({})

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        """Every entry at a distance of at most ``radius``, as (distance, entry), nearest first."""
        found, todo = [], [0] if self.words else []
        while todo:
            at = todo.pop()
            d = self.metric(word, self.words[at])
            if d <= radius:
                found.append((d, self.words[at]))
            todo.extend(c for k, c in self.children[at].items() if d - radius <= k <= d + radius)
        return sorted(found)

    def within_many(self, radius: dict[str, int]) -> list[tuple[str, str, int]]:
        """(query, entry, distance) of every entry within its own radius of each query.

        The queries go down the tree together: at each node one column of distances decides which of them follow which child.
        A query that is longer than any entry by more than its radius can't match and isn't sent.
        """
        longest = max(map(len, self.words), default=0)
        radius = {q: r for q, r in radius.items() if len(q) <= longest + r}
        texts = Texts([*radius])
        most = np.array([*radius.values()], np.int32)
        found: list[tuple[str, str, int]] = []
        todo = [(0, np.arange(len(most)))] if self.words and len(most) else []
        while todo:
            at, rows = todo.pop()
            d = texts.distances(self.words[at], rows)
            hit = d <= most[rows]
            found += [(texts.texts[i], self.words[at], int(x)) for i, x in zip(rows[hit], d[hit])]
            for k, child in self.children[at].items():
                follow = rows[np.abs(d - k) <= most[rows]]
                if len(follow):
                    todo.append((child, follow))
        return found
