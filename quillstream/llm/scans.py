"""Text of scanned pages repaired into continuous paragraphs (problem 5).

Method: the lines of a page are told apart from what belongs to the page only (running headers and footers, page
numbers). A lexicon of word frequencies over all texts is indexed by symmetric deletes and by confusions; a rare word that an edit
with confused characters turns into a frequent one may be a misreading. Each place where it stands is judged by itself: of the
repairs, and the word as it is, the one wins that fits the words before and behind it. The lexicon also decides whether a hyphen at a line end divides a word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.edit import distance, fold
from quillstream.session import BROADCAST_ROWS, cut

#: What scanners confuse, as (read, meant).
CONFUSED = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("nn", "m"), ("in", "m"), ("ni", "m"), ("tl", "d"), ("ll", "u"), ("lc", "k"), ("fi", "h"),
    ("0", "o"), ("o", "0"), ("1", "l"), ("l", "1"), ("1", "i"), ("i", "1"), ("5", "s"), ("s", "5"), ("8", "b"), ("b", "8"), ("6", "g"), ("9", "g"), ("2", "z"), ("z", "2"), ("3", "e"), ("4", "a"), ("7", "t"), ("@", "a"), ("$", "s"), ("€", "e"), ("!", "l"), ("|", "l"), ("!", "i"), ("|", "i"), ("¢", "c"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"), ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("e", "o"), ("o", "e"), ("n", "ri"), ("u", "ii"), ("h", "li"), ("w", "vv"), ("q", "g"), ("g", "q"), ("i", "j"), ("j", "i"), ("f", "l"), ("r", "t"), ("rn", "nn"), ("x", "z"),
)
#: What a confusion, a lost diacritic and any other edit cost, and what a misreading costs at most: two confusions, one and one diacritic, or three diacritics.
CONFUSION, DIACRITIC, EDIT, COST_MOST = 0.3, 0.2, 1.0, 0.65
#: A misreading has at most SLACK rows and one for each SHARE rows of the word meant, and that word TIMES as many.
SLACK, SHARE, TIMES = 2, 60, 4
#: Lines longer than this aren't lines of a page; the share of such lines that a scanned text may have.
WIDEST, WIDE = 140, 0.05
#: A line of the page only stands in so many papers or in so many places at least, and interrupts a sentence in such a share of them.
PAPERS, PLACES, INTRUDES = 3, 4, 0.4
#: Words of fewer letters are misread only where the words around them say so.
SURE = 4
#: A line of the page only that is found by repetition is shorter than so much of the median line.
SHORT = 0.8

_HYPHENS = "-­‐¬"
_CUT = re.compile(rf"([^\W\d_][\w'’]*|[A-Za-z]*\d*[A-Za-z]+)([{_HYPHENS}])[ \t]*$")
_NUM = r"[0-9lIOoSBZ|]{1,5}"
_PAGE = re.compile(rf"^(?:\[\s*{_NUM}\s*\]|[-–—]\s*{_NUM}\s*[-–—]|(?:Page|page|Paqe|Pagc|Seite)\s+{_NUM}(?:\s+(?:of|0f|ot)\s+{_NUM})?|[Pp][.,]\s*{_NUM}|{_NUM}\s*/\s*{_NUM}|\(\s*{_NUM}\s*\))$")
_BARE = re.compile(rf"^{_NUM}$")
_CELLS = re.compile(r"^[\s\d.,%|±–-]+$")
_ENDED = re.compile(r"[.!?:][\"'”’)\]]*$")
_EDGE = re.compile(rf"^{_NUM}\s{{2,}}|(?:,\s*p[.,]\s*|\s{{2,}}|\s·\s){_NUM}$|[\s,]+p[.,]\s*{_NUM}$")
_HEAD = re.compile(r"^(?:#{1,6} .*|[A-Z][A-Za-z]+(?: [a-z&]+){0,3}|[A-Z][A-Z &]+)$")

_OCR_FOLD = str.maketrans("0153@|", "olsea" + "l")


def signature(line: str) -> str:
    """A line without digits and spacing, with confused characters made equal."""
    s = re.sub(r"[0-9]+", "#", fold(line).lower())
    return re.sub(r"[^a-z#]+", " ", s.translate(_OCR_FOLD)).strip()


def _alike(a: str, b: str) -> bool:
    """True if two strings differ in few places of the same length, or in one confusion that changes the length."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4:
        return False
    most = 1 if len(a) < 10 else 2 if len(a) < 24 else 3
    # of one part more than there may be edits, one is left as it was
    step = max(1, len(b) // (most + 1))
    if not any(b[i * step : (i + 1) * step] in a for i in range(most + 1)):
        return False
    return distance(a, b) <= most


def _number(text: str) -> int | None:
    digits = re.findall(r"[0-9lIOoSBZ|]+", text)
    if not digits:
        return None
    value = digits[0].translate(str.maketrans("lIOoSBZ|", "11005821"))
    return int(value) if value.isdigit() else None


def is_scanned(text: str) -> bool:
    """True if the text has the short lines of pages: several lines, most of them full, few very long, no Markdown."""
    lines = [x.rstrip() for x in re.split(r"[\n\f]", text) if x.strip()]
    if len(lines) < 3 or sum(len(x) > WIDEST for x in lines) > WIDE * len(lines):
        return False
    if any(re.match(r"#{1,6} |\|.*\|$", x) for x in lines):
        return False
    unfinished = sum(1 for x in lines if len(x) > 25 and not _ENDED.search(x))
    return unfinished >= 0.2 * len(lines)


def classify(text: str, stem: str | None, boiler: frozenset[str] = frozenset()) -> list[str]:
    """The kind of each line: ``header``, ``pageno``, ``blank``, ``cells``, ``heading`` or ``text``.

    A header repeats the beginning of the title, the citation or the journal of the paper (both stand in its
    ``stem``), stands in several papers (``boiler``), or repeats itself across pages. A bare number is a page
    number if it stands at an edge of a page and continues the numbers of other pages.
    """
    raw = text.split("\n")
    lines = [x.replace("\f", "").strip() for x in raw]
    kinds = ["blank" if not x else "text" for x in lines]
    full = [i for i, x in enumerate(lines) if x]
    if not full:
        return kinds
    sig = [signature(_EDGE.sub("", x)) for x in lines]
    parts = re.match(r"^(.*?\b(?:1[89]|20)\d\d)\s+(.*?)(?:\s+\d+)?$", stem or "")
    cited, journal = (signature(parts.group(1)), signature(parts.group(2))) if parts else ("", "")
    cited = cited.replace("#", "").strip()
    title_at, candidate = None, None
    for i in full[:4]:
        bare = _EDGE.sub("", lines[i])
        if _PAGE.match(lines[i]) or _BARE.match(lines[i]) or sig[i] in boiler or bare != lines[i] or lines[i].isupper() and i + 1 < len(lines):
            continue
        plain = sig[i].replace("#", "").strip()
        if cited and _alike(plain, cited) or journal and (_alike(plain, journal) or plain.startswith(journal) and len(plain) < len(journal) + 4):
            continue
        title_at = i
        break
    title = sig[title_at] if title_at is not None else ""
    bare_of = lambda x: " ".join(x.replace("#", " ").split())
    named, printed = bare_of(cited), bare_of(journal)

    def names_page(i: int) -> bool:
        s = sig[i]
        plain = bare_of(s)
        numbered = _EDGE.search(lines[i]) is not None
        if len(plain) < 4:
            return False
        if s in boiler or plain.endswith("all rights reserved"):
            return True
        if cited and len(lines[i]) < 70 and _alike(plain, named):
            return True
        if journal:
            j = printed
            tail = plain[len(j) :].strip() if plain.startswith(j) else None
            if _alike(plain, j) or tail is not None and len(tail) <= 2 or numbered and len(j) > 5 and _alike(plain[: len(j)], j):
                return True
        if title_at is not None and i != title_at and len(s.split()) >= 2 and len(s) < len(title) + 3:
            meant = (numbered or lines[i].isupper() and not title.isupper() or len(s.split()) >= 3) and not _ENDED.search(lines[i])
            if meant and (title.startswith(s) or len(s) >= 10 and _alike(title[: len(s)], s)):
                return True
        if numbered and re.search(r"\bp[.,]\s*[\dlIOo]+$", lines[i]) and len(lines[i]) < 90 and not _PAGE.match(lines[i]):
            return True
        return False

    for i in full:
        if _PAGE.match(lines[i]):
            kinds[i] = "pageno"
        elif names_page(i):
            kinds[i] = "header"
        elif _CELLS.match(lines[i]) or _BARE.match(lines[i]):
            kinds[i] = "cells"
    # what repeats itself between pages and interrupts sentences
    text_at = [i for i in full if kinds[i] == "text"]
    width = sorted(len(lines[i]) for i in text_at)[len(text_at) // 2] if text_at else 0
    seen = Counter(sig[i] for i in text_at if len(sig[i].split()) > 1 and len(lines[i]) < SHORT * width)
    before = {b: a for a, b in zip(text_at, text_at[1:])}
    for s, n in seen.items():
        if n < 2:
            continue
        at = [i for i in text_at if sig[i] == s and i != title_at]
        breaks = sum(1 for i in at if i in before and not _ENDED.search(lines[before[i]]) and lines[before[i]][-1] not in _HYPHENS and lines[i][:1].isupper() and not _ENDED.search(lines[i]))
        if len(at) >= 2 and breaks >= 2 and breaks * 3 >= len(at) * 2 and not re.search(r"[a-z] (?:the|of|in|and|with|for|a|an|to|by|was|were|not)$", lines[at[0]]):
            for i in at:
                kinds[i] = "header"
    # bare numbers: at the edge of a page, in sequence with other pages
    edge = {i for i in full if kinds[i] in ("header", "pageno") or "\f" in raw[i]}
    bare = [(i, _number(lines[i])) for i in full if kinds[i] == "cells" and _BARE.match(lines[i])]
    rank = {i: k for k, i in enumerate(full)}
    values = {}
    for i, v in bare:
        if v is None:
            continue
        around = [full[k] for k in (rank[i] - 1, rank[i] + 1) if 0 <= k < len(full)]
        at_edge = len(around) < 2 or any(a in edge for a in around) or "\f" in raw[i] or "\f" in (raw[i + 1] if i + 1 < len(raw) else "")
        lonely = not any(kinds[a] == "cells" for a in around)
        values[i] = (v, at_edge, lonely)
    for i, (v, at_edge, lonely) in values.items():
        steps = [j for j, (w, e, lone) in values.items() if j != i and (e or lone) and w - v == (1 if j > i else -1) and abs(rank[j] - rank[i]) >= 8]
        if (at_edge or lonely) and steps or at_edge and lonely and (len(values) <= 3 or i in (full[0], full[-1])):
            kinds[i] = "pageno"
    for i in full:
        if kinds[i] == "text" and len(lines[i]) < 60 and _HEAD.match(lines[i]) and not _ENDED.search(lines[i]):
            j = rank[i]
            if j == 0 or _ENDED.search(lines[full[j - 1]]) or kinds[full[j - 1]] != "text":
                kinds[i] = "heading"
    return kinds


def _cut_end(line: str) -> re.Match | None:
    """The divided word at the end of a line, if a hyphen ends it."""
    end = line.rstrip(" \t")
    return _CUT.search(line, end.rfind(" ") + 1) if end and end[-1] in _HYPHENS else None


LINES = "paper_id long, line_no int, kind string, body string, cut_a string, cut_b string, mark string, loose boolean, marks string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of scanned papers (paper_id, stem, full_text, boiler); ``body`` is the text of the words that begin in the line, ``cut_a`` and ``cut_b`` the parts of its last word where a hyphen ends it."""
    for b in batches:
        rows = []
        for pid, stem, text, boiler in zip(b["paper_id"], b["stem"], b["full_text"], b["boiler"]):
            lines = text.split("\n")
            kinds = classify(text, stem, frozenset(boiler if boiler is not None else ()))
            at = [i for i, k in enumerate(kinds) if k == "text"]
            bare = [x.replace("\f", "") for x in lines]
            ends = {i: m for i in at if (m := _cut_end(bare[i]))}
            marks = "".join(sorted({m.group(2) for m in ends.values() if m.group(2) != "-"}))
            follow = dict(zip(at, at[1:]))
            taken: dict[int, int] = {}
            parts = {}
            for i, m in ends.items():
                j = follow.get(i)
                if j is not None:
                    nxt = re.match(r"[ \t\f]*([^\W_](?:[\w@$€]*[^\W_])?)", lines[j])
                    if nxt and not nxt.group(1)[0].isupper():
                        parts[i] = (m.group(1), nxt.group(1), m.group(2), bare[i][-1:] in " \t")
                        taken[j] = nxt.end()
            for i, k in enumerate(kinds):
                body = None
                if k == "cells":
                    body = bare[i]
                if k in ("text", "heading"):
                    body = lines[i][taken[i] :] if i in taken else bare[i]
                    if i in parts and (m := _cut_end(body)):
                        body = body[: m.start()]
                x, y, mark, loose = parts.get(i, (None, None, None, None))
                rows.append((pid, i + 1, k, body, x, y, mark, loose, marks))
        yield pd.DataFrame(rows, columns=["paper_id", "line_no", "kind", "body", "cut_a", "cut_b", "mark", "loose", "marks"]).astype({"loose": object})


_OPEN_END = re.compile(r" (?:the|of|in|and|with|for|a|an|to|by|was|were|not|at|on|from|is|are)$")


def _repeatable(text: str) -> list[dict]:
    """The short lines of a page that may be notices, with their signature and whether they interrupt a sentence."""
    out = []
    lines = [x.replace("\f", "").strip() for x in text.split("\n") if x.strip()]
    width = sorted(map(len, lines))[len(lines) // 2]
    for k, x in enumerate(lines):
        if len(x) > SHORT * width or _ENDED.search(x) or _CELLS.match(x):
            continue
        s = signature(x)
        if len(s) < 8 or " " not in s or _OPEN_END.search(s):
            continue
        was = lines[k - 1] if k else "."
        breaks = not _ENDED.search(was) and x[:1].isupper() and was[-1] not in _HYPHENS and not _PAGE.match(was)
        out.append({"s": s, "breaks": int(breaks)})
    return out


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = [(True, _repeatable(t)) if is_scanned(t) else (False, []) for t in texts]
    return pd.DataFrame(rows, columns=["scanned", "short"])


def scanned(papers: DataFrame) -> DataFrame:
    """paper_id, stem, full_text of every paper with a text, ``scanned`` and ``boiler``: the signatures of its lines that stand in several papers and interrupt sentences, as notices of libraries and archives do.

    Every text is looked at once for both; the lines are counted where they are, over all papers.
    """
    rows = papers.select("paper_id", "stem", "full_text").where("full_text is not null")
    rows = cut(rows.withColumn("_p", F.pandas_udf(_scan, "struct<scanned:boolean,short:array<struct<s:string,breaks:int>>>")("full_text")).select("paper_id", "stem", "full_text", "_p.*", F.monotonically_increasing_id().alias("_row")))
    each = rows.select("_row", F.inline("short"))
    many = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("breaks").alias("b"), F.count_distinct("_row").alias("papers"))
    found = cut(many.where(((F.col("papers") >= PAPERS) | (F.col("n") >= PLACES)) & (F.col("b") >= INTRUDES * F.col("n"))).select("s"))
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    own = each.select("_row", "s").join(found, "s").groupBy("_row").agg(F.collect_set("s").alias("boiler"))
    return rows.drop("short").join(own, "_row", "left").drop("_row")


def lines_of(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, texts that don't come from pages): every line of every scanned paper (``LINES``), with what the page adds told apart. Written to the shared folder."""
    rows = scanned(papers)
    return cut(rows.where("scanned").select("paper_id", "stem", "full_text", "boiler").mapInPandas(_read, LINES)), rows.where("not scanned").select("paper_id", "full_text")


_WORDS = re.compile(r"[^\W_](?:[^\W_@$€!|¢]*(?:[@$€!|¢]+[^\W_@$€!|¢]+)*)?(?:['’][^\W_]+)?")


def _words(text: Column) -> Column:
    """The words of a text in lower case, in order, as an array (``_WORDS`` is the same pattern)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}](?:[\p{L}\p{N}@$€!|¢]*[\p{L}\p{N}])?(?:['’][\p{L}\p{N}]+)?"), F.lit(0))


def _join_words(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Hyphens at line ends with the decision: paper_id, line_no, word (both parts together), divided."""
    c = lines.where("cut_a is not null").select("paper_id", "line_no", "mark", "loose", "marks", F.lower("cut_a").alias("a"), F.lower("cut_b").alias("b"))
    c = c.withColumn("word", F.concat("a", "b"))
    pair = counts.where(F.col("word").contains("-"))
    n = lambda name: counts.select(F.col("word").alias(f"_{name}"), F.col("n").alias(f"n_{name}"))
    c = c.withColumn("kept", F.concat("a", F.lit("-"), "b"))
    c = c.join(n("word"), F.col("word") == F.col("_word"), "left").join(n("a"), F.col("a") == F.col("_a"), "left").join(n("b"), F.col("b") == F.col("_b"), "left")
    c = c.join(pair.select(F.col("word").alias("_k"), F.col("n").alias("n_kept")), F.col("kept") == F.col("_k"), "left")
    z = lambda x: F.coalesce(x, F.lit(0))
    known = (z("n_a") > 3 * z("n_word")) & (z("n_b") > 3 * z("n_word")) & (F.length("a") > 2) & (F.length("b") > 2)
    divided = (
        F.when(F.col("mark") != "-", True)
        .when(F.col("marks") != "", False)
        .when(F.col("loose"), True)
        .when(z("n_word") > z("n_kept"), True)
        .when(z("n_kept") > 0, False)
        .otherwise(~known & (F.length("a") > 1))
    )
    return c.select("paper_id", "line_no", "word", "kept", divided.alias("divided"))


def cost(read: str, meant: str) -> float:
    """Weighted edit distance: a confusion costs 0.3, a lost diacritic 0.2, any other edit 1."""
    if read == meant:
        return 0.0
    pairs = _pairs()
    big = 9.0
    n, m = len(read), len(meant)
    best = [[big] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            d = best[i][j]
            if d >= 2.0:
                continue
            if i < n and j < m:
                c = 0.0 if read[i] == meant[j] else DIACRITIC if fold(read[i]) == meant[j] else EDIT
                best[i + 1][j + 1] = min(best[i + 1][j + 1], d + c)
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], d + EDIT)
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], d + EDIT)
            for a, b in pairs.get(read[i], ()) if i < n else ():
                if read.startswith(a, i) and meant.startswith(b, j):
                    x, y = i + len(a), j + len(b)
                    best[x][y] = min(best[x][y], d + CONFUSION)
    return best[n][m]


_TABLE: dict[bool, dict[str, list[tuple[str, str]]]] = {}


def _pairs(back: bool = False) -> dict[str, list[tuple[str, str]]]:
    """The confusions by the first character of what is read (``back``: of what is meant)."""
    if back not in _TABLE:
        table: dict[str, list[tuple[str, str]]] = {}
        for a, b in CONFUSED:
            a, b = (b, a) if back else (a, b)
            table.setdefault(a[0], []).append((a, b))
        _TABLE[back] = table
    return _TABLE[back]


def _deletes(word: Column, most: int) -> Column:
    """The word without up to ``most`` of its characters, without repeats."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = once(word)
    out = F.concat(F.array(word), one)
    if most > 1:
        out = F.concat(out, F.flatten(F.transform(one, once)))
    return F.array_distinct(out)


def read_forms(word: str) -> list[str]:
    """What is meant if ``word`` has one confusion or up to three diacritics too many, and the word itself."""
    out = {word} | _confused(word, _pairs())
    bare = {i: c for i, x in enumerate(word) if len(c := fold(x)) == 1 and c != x}
    for n in (1, 2, 3):
        for at in combinations(bare, n):
            out.add("".join(bare[i] if i in at else x for i, x in enumerate(word)))
    return sorted(out)


def meant_forms(word: str) -> list[str]:
    """How ``word`` is read with one confusion, and the word itself.

    The edits of a pair don't overlap, so each pair within ``COST_MOST`` has one of these in common with ``read_forms``:
    the first confusion, or the diacritics, is undone there and the other confusion made here.
    """
    return sorted({word} | _confused(word, _pairs(back=True)))


def _confused(word: str, pairs: dict[str, list[tuple[str, str]]]) -> set[str]:
    return {word[:i] + b + word[i + len(a) :] for i, x in enumerate(word) for a, b in pairs.get(x, ()) if word.startswith(a, i)}


def _only(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The rows whose ``word`` is in ``words``."""
    return rows.join(F.broadcast(words) if words.count() <= BROADCAST_ROWS else words, "word", "left_semi")


def misreadings(counts: DataFrame) -> DataFrame:
    """(word, meant, n, n_meant, cost): rare words with the frequent words they may stand for, from the index.

    ``counts`` (word, n) is over all texts. Words as frequent as a misreading can't be are left alone, so on the
    rare side only those stay that are rare beside the most frequent word of about their length.
    """
    words = counts.where((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}") & ~F.col("word").contains("-"))
    forms = lambda f: F.pandas_udf(lambda w: w.map(f), "array<string>")("word")
    # deletes alone miss pairs of confusions, and those with a longer word meant
    meant_keys, read_keys = (F.array_distinct(F.concat(_deletes(F.col("word"), 1), forms(f))) for f in (meant_forms, read_forms))
    frequent = words.where(F.col("n") >= TIMES).select(F.col("word").alias("meant"), F.col("n").alias("n_meant"), F.explode(meant_keys).alias("key"))
    most = words.groupBy(F.length("word").alias("_size")).agg(F.max("n").alias("top"))
    most = cut(most.select(F.explode(F.array(*[F.col("_size") + i for i in range(-2, 3)])).alias("_size"), "top").groupBy("_size").agg(F.max("top").alias("top")))
    most = F.broadcast(most) if most.count() <= BROADCAST_ROWS else most
    odd = F.col("word").rlike(r"[\p{L}][0-9@$€!|¢]+\p{Ll}|^[0-9@$€!|¢]\p{Ll}{2}|[^\x00-\x7f]")
    rare = words.join(most, F.length("word") == F.col("_size")).where((F.col("n") * TIMES <= F.col("top")) & ((F.col("n") <= SLACK + F.col("top") / SHARE) | odd)).select("word", "n")
    rare = rare.select("word", "n", F.explode(read_keys).alias("key"))
    near = rare.join(frequent, "key").where((F.col("word") != F.col("meant")) & (F.abs(F.length("word") - F.length("meant")) <= 2))
    near = near.where((F.col("n_meant") >= TIMES * F.col("n")) & ((F.col("n") <= SLACK + F.col("n_meant") / SHARE) | odd & (F.col("n") <= SLACK + F.col("n_meant") / 4)))
    near = near.select("word", "meant", "n", "n_meant").distinct()
    weigh = F.pandas_udf(lambda a, b: pd.Series([cost(x, y) for x, y in zip(a, b)], dtype="float64"), "double")
    near = cut(cut(near).withColumn("cost", weigh("word", "meant")).where(F.col("cost") <= COST_MOST))
    # a misreading of a misreading stands for neither
    return near.join(near.select(F.col("word").alias("meant")).distinct(), "meant", "left_anti")


def corrections(counts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Misread words at their places: place, word, meant.

    ``counts`` (word, n) and ``tokens`` (place, before, word, after) are over all texts. At each place of a word that may be a
    misreading the repairs are weighed by how often they stand after the word before and before the word behind, by their
    frequency and by their cost. The word stays where it stands with these neighbours in other places more often than any repair does;
    a word of under ``SURE`` letters is repaired only if a repair has stood beside one of the neighbours.
    """
    near = cut(misreadings(counts))
    asked = near.select("word").distinct()
    at = cut(_only(tokens, asked))
    options = near.select("word", F.col("meant").alias("as"), "n_meant", "cost").unionByName(asked.join(counts, "word").select("word", F.col("word").alias("as"), F.col("n").alias("n_meant"), F.lit(0.0).alias("cost")))
    places = at.join(F.broadcast(options) if options.count() <= BROADCAST_ROWS else options, "word")

    def seen(side: str) -> DataFrame:
        """How often the pairs of a neighbour and an option that are asked for occur in all texts."""
        wanted = cut(places.select(side, "as").where(F.col(side).isNotNull()).distinct())
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        pairs = tokens.select(side, F.col("word").alias("as")).join(wanted, [side, "as"], "left_semi")
        return pairs.groupBy(side, "as").agg(F.count(F.lit(1)).alias(f"n_{side}"))

    for side in ("before", "after"):
        n = seen(side).withColumnsRenamed({side: "_side", "as": "_as"})
        places = places.join(n, (F.col(side) == F.col("_side")) & (F.col("as") == F.col("_as")), "left").drop("_side", "_as")
    own = (F.col("as") == F.col("word")).cast("int")
    # the place itself is no evidence for the word that stands there
    left, right = (F.greatest(F.coalesce(f"n_{x}", F.lit(0)) - own, F.lit(0)) for x in ("before", "after"))
    fit = F.log1p(left) + F.log1p(right)
    judged = places.select("place", "word", "as", fit.alias("fit"), (fit + F.log1p("n_meant") - 8 * F.col("cost")).alias("score"))
    repair = F.col("as") != F.col("word")
    best = judged.groupBy("place", "word").agg(
        F.max_by(F.when(repair, F.col("as")), F.when(repair, F.struct("score", "as"))).alias("meant"),
        F.max(F.when(repair, F.col("fit"))).alias("fit"),
        F.max(F.when(~repair, F.col("fit"))).alias("own"),
    )
    return best.where((F.col("own") <= F.col("fit")) & ((F.length("word") >= SURE) | (F.col("fit") > 0))).select("place", "word", "meant")


def analyse(papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, hyphens, misread words): ``lines_of``; paper_id, line_no, word, kept, divided; paper_id, line_no, word, meant."""
    lines, born = lines_of(papers)
    compounds = lines.where("body is not null and kind <> 'cells'").select(F.explode(F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}\p{N}]+-[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    plain = born.select(F.explode(_words(F.col("full_text"))).alias("word"))
    own = cut(lines.where("body is not null and kind <> 'cells'").select("paper_id", "line_no", _words(F.col("body")).alias("words")).where(F.size("words") > 0))
    single = own.select(F.explode("words").alias("word"))
    counts = cut(single.unionAll(plain).unionAll(compounds).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    hyphens = cut(_join_words(lines, counts))
    edge = F.array(F.lit(None).cast("string"))
    before, after = F.concat(edge, F.slice("words", 1, F.size("words") - 1)), F.concat(F.slice("words", 2, F.size("words")), edge)
    around = own.select("paper_id", "line_no", F.posexplode(F.arrays_zip(before.alias("before"), F.col("words").alias("word"), after.alias("after"))).alias("at", "t"))
    inside = around.select("paper_id", "line_no", "at", "t.*")
    joined = hyphens.select("paper_id", "line_no", F.posexplode(F.when(F.col("divided"), F.array("word")).otherwise(F.split("kept", "-"))).alias("at", "word"))
    none = F.lit(None).cast("string")
    tokens = inside.unionByName(joined.select("paper_id", "line_no", (-1 - F.col("at")).alias("at"), none.alias("before"), "word", none.alias("after")))
    more = joined.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    every = counts.unionAll(more).groupBy("word").agg(F.sum("n").alias("n"))
    found = cut(corrections(every, tokens.select(F.struct("paper_id", "line_no", "at").alias("place"), "before", "word", "after")))
    return lines, hyphens, found.select("place.paper_id", "place.line_no", "place.at", "word", "meant")


def flaws(papers: DataFrame) -> DataFrame:
    """Flawed lines of scanned papers: paper_id, line_no, kind (header, pageno, hyphen, ocr).

    Null and empty texts, and texts that don't come from pages, have none; repeated papers are judged alike.
    """
    lines, hyphens, misread = analyse(papers)
    page = lines.where(F.col("kind").isin("header", "pageno")).select("paper_id", "line_no", "kind")
    split = hyphens.where("divided").select("paper_id", "line_no", F.lit("hyphen").alias("kind"))
    ocr = misread.select("paper_id", "line_no", F.lit("ocr").alias("kind"))
    return page.unionAll(split).unionAll(ocr).distinct()


def repaired(papers: DataFrame) -> DataFrame:
    """paper_id and the repaired text: paragraphs on one line each, separated by a blank line.

    Texts that don't come from pages are returned as they are.
    """
    lines, hyphens, misread = analyse(papers)
    fix = misread.groupBy("paper_id", "line_no").agg(F.collect_set(F.struct("at", "word", "meant")).alias("fixes"))
    rows = lines.join(hyphens.select("paper_id", "line_no", "divided"), ["paper_id", "line_no"], "left").join(fix, ["paper_id", "line_no"], "left")
    page = rows.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "kind", "body", "cut_a", "cut_b", "divided", "fixes"))).alias("page"))
    whole = F.pandas_udf(lambda pages: pd.Series([_paragraphs(p) for p in pages], dtype=object), "string")
    done = page.select("paper_id", whole("page").alias("repaired"))
    return papers.select("paper_id", "full_text").join(done, "paper_id", "left").select("paper_id", F.coalesce("repaired", "full_text").alias("text"))


def _cased(word: str, like: str) -> str:
    """``word`` with the capitals of the word that it replaces."""
    return word.upper() if len(like) > 1 and like.isupper() else word.capitalize() if like[:1].isupper() else word


def _paragraphs(page) -> str:
    """The paragraphs of classified lines: headers and page numbers dropped, words joined and corrected."""
    out: list[str] = [""]
    last = ""
    for r in page:
        kind, body = r["kind"], r["body"]
        if kind in ("header", "pageno"):
            continue
        if kind in ("blank", "heading", "cells"):
            title = len(out) == 1 and last == "text" and len(out[0]) < 2 * WIDEST
            if out[-1] and (kind != "blank" or _ENDED.search(out[-1]) or title):
                out.append("")
            if kind == "heading":
                out[-1] = body.strip()
                out.append("")
            elif kind == "cells":
                out[-1] = (body or "").strip()
                out.append("")
            last = kind
            continue
        text, fixes = body or "", {f["at"]: (f["word"], f["meant"]) for f in (r["fixes"] if r["fixes"] is not None else ())}
        for at, m in reversed([*enumerate(_WORDS.finditer(text))]):
            if at in fixes and m.group().lower() == fixes[at][0]:
                text = text[: m.start()] + _cased(fixes[at][1], m.group()) + text[m.end() :]
        if r["cut_a"] is not None:
            halves = [r["cut_a"] + r["cut_b"]] if r["divided"] else [r["cut_a"], r["cut_b"]]
            text += "-".join(_cased(fixes[-1 - k][1], h) if -1 - k in fixes else h for k, h in enumerate(halves))
        glue = "" if not out[-1] or not text[:1].strip() or text[:1] in ".,;:)?!%" else " "
        out[-1] = out[-1] + glue + text.rstrip() if out[-1] else text.strip()
        last = kind
    return "\n\n".join(p for p in out if p)
