"""Texts that lost their end, and how often each source truncates (problem 10).

Method: a stack automaton reads the delimiters of each text (brackets, quotes, markup elements, code fences) and classifies how it ends: terminated, inside an
open delimiter, markup or escape, with a mark of omission, or with an unterminated last segment that may be
a headline, a list, a table row, a reference or a signature. What structure alone leaves open is settled with
baselines from all texts: how often texts of this form end with a terminator in this source and how often it leaves
delimiters open, how many unterminated texts of a source have exactly this length (a field limit), how
often the last line closes other texts, and how often the last word ends a sentence or another headline. All
baselines are shares, so that they mean the same in a table of any size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html.entities import html5

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.session import BROADCAST_ROWS, cut

#: A limit is a length at which a source has so many times as many unterminated texts as at lengths nearby, with such evidence (log-likelihood) against chance.
LIMIT_TIMES, LIMIT_EVIDENCE, NEAR = 6.0, 6.0, 12
#: A short last line is a formula if it closes such a share of the texts that end as it does (the second where its last word is known and doesn't end sentences); so many texts stand for those not seen.
FORMULA_SHARE, FORMULA_SURE, FORMULA_WORDS, UNSEEN = 0.02, 0.2, 4, 150
#: A word which ends a sentence at least so often can end a headline or a formula; one which does so more often than the second can end a text where terminators are rare.
END_RATE, ENDS = 0.01, 0.2
#: Letters of the longest word.
WORD = 60
#: A word is a fragment if a word that begins with it is so many times as frequent.
FRAGMENT = 2_000
#: Share of texts with a terminator in a source below which a missing one tells nothing, and share of texts with open delimiters above which one more tells nothing.
TERMINATED, HABIT = 0.5, 0.2

_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“„”", "“": "„", "»": "«", "«": "»", "’": "‘"}
_NAMES = {"(": "bracket", "[": "bracket", "{": "bracket", "`": "fence", "~": "fence", "<": "element"}
#: Elements without an end tag, and those whose end tag may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL = frozenset("p li dt dd td th tr thead tbody tfoot option body html head colgroup".split())
_ENTITIES = sorted({k.rstrip(";") for k in html5})
_DELIM = re.compile(r"""(?m)^[ \t]*(?P<fence>`{3,}|~{3,})|(?P<para>\n[ \t]*(?=\n))|(?P<line>\n)|(?P<tag></?[A-Za-z][\w:.-]*(?:\s[^<>]*)?>)|(?P<mark>[()\[\]{}“”„«»‘’"])""")
_BROKEN = re.compile(r"""(?:<(?:/?[A-Za-z][\w:.-]*+(?:\s++[\w:.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))*+(?:\s+[\w:.-]*(?:\s*=\s*(?:"[^"<>]*|'[^'<>]*)?)?)?|!--(?:(?!-->).)*|/)|&(?P<entity>[A-Za-z][A-Za-z0-9]*|\#\d*|\#[xX][0-9a-fA-F]*)?|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?|U[0-9a-fA-F]{0,7})?)$""", re.S)
_STOP = re.compile(r"(?:[.!?。！？]|\.\.\.|…)[\"'”’»)\]]*(?=\s|$)")
_CLOSED = re.compile(r"[.!?。！？][\"'”’»)\]]*$")
_MARK = re.compile(r"(?:\.\.\.|…|\[\.\.\.\]|\[…\]|[\[(](?:truncated|continued|more|cut|abridged|abstract truncated[^\])]*)[\])])[\"'”’]?$", re.I)
_LIST = re.compile(r"^(?:key ?words?|mots[- ]cl[ée]s|palabras clave|schl[üu]sselw[öo]rter|schlagw[öo]rter|mesh(?: terms)?|index terms|tags|topics)\s*[:：]", re.I)
_TABLE = re.compile(r"^(?:(?:table|tab\.|tabelle|tableau|tabla)\s*\d+\.?|\|)?[\s\d.,;|%±–-]*[\d|%]$", re.I)
_CITED = re.compile(r"(?:\d{4};\s*\d+(?:\([\w-]+\))?:\s*[A-Za-z]?\d+(?:[-–][A-Za-z]?\d+)?|\bdoi:?\s*\S+|https?://\S+|\b\d{1,4}[-–]\d{1,4})$")
_BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s")
_GROUP = re.compile(r"^[(\[].*[)\]]$")

ENDING = "struct<kind:string,last_word:string,line_hash:long,line_words:int,single:boolean,open:string>"


def opened(text: str) -> str | None:
    """The delimiter that is open at the end of ``text``: bracket, quote, element or fence; None if all are closed.

    Brackets count within their line and quotes within their paragraph (a quotation of several paragraphs opens each of them anew);
    elements and fences reach over the whole text, and nothing within a fence counts. An ASCII quote opens where a
    word begins and closes where one is open; an apostrophe is no quote. Closing delimiters that nothing opened are ignored.
    """
    stack: list[tuple[str, str]] = []
    for m in _DELIM.finditer(text):
        kind, c = m.lastgroup, m.group(m.lastgroup)
        if stack and stack[-1][0] == "fence":
            if kind == "fence" and c[0] == stack[-1][1][0] and len(c) >= len(stack[-1][1]):
                stack.pop()
            continue
        if kind == "fence":
            stack.append(("fence", c))
        elif kind == "para":
            stack = [x for x in stack if x[0] in ("fence", "element")]
        elif kind == "line":
            stack = [x for x in stack if x[0] != "bracket"]
        elif kind == "tag":
            name = re.match(r"</?([^\s>]*)", c).group(1).lower().rstrip("/")
            if c[1] == "/":
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == ("element", name)), None)
                if at is not None:
                    del stack[at:]
            elif not c.endswith("/>") and name not in VOID and name not in OPTIONAL:
                stack.append(("element", name))
        elif c == '"':
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == ("quote", c)), None)
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if at is not None:
                del stack[at:]
            elif (not before or before.isspace() or before in "([{“«—–-") and after and not after.isspace():
                stack.append(("quote", c))
        else:
            at = None
            if c in _PAIRS and not (c == "’" and text[m.end() : m.end() + 1].isalnum()):
                want = _PAIRS[c]
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][1] in want and stack[i][0] in ("bracket", "quote")), None)
            if at is not None:
                del stack[at:]
            elif c in "([{":
                stack.append(("bracket", c))
            elif c in "“„«‘" or c == "»" and text[m.end() : m.end() + 1].isalpha() and not text[m.start() - 1 : m.start()].isalnum():
                stack.append(("quote", c))
    return stack[-1][0] if stack else None


def _broken(text: str) -> bool:
    """True if ``text`` ends within a tag, a comment, an entity, an escape or a multibyte sequence."""
    if text[-1] == "\ufffd":
        return True
    at = max(text.rfind(c) for c in "<&\\")
    comment = text.rfind("<!--")
    if comment >= 0 and text.find("-->", comment) < 0:
        return True
    m = _BROKEN.match(text, at) if at >= 0 else None
    if m is None or text[at] != "&":
        return m is not None
    name = m.group("entity") or ""
    if name.startswith("#"):
        return True
    # a beginning of the name of an entity; one letter (R&D) is none
    i = bisect_left(_ENTITIES, name)
    return len(name) > 1 and i < len(_ENTITIES) and _ENTITIES[i].startswith(name)


def ending(text: str) -> dict:
    """How ``text`` ends.

    ``kind``: empty, broken (inside markup, an entity, an escape or a multibyte sequence), mark, closed, group (a
    bracketed remark of its own), list, table, cited, dangling (a hyphen, comma or opening delimiter) or plain.
    ``single``: the last segment is the whole last paragraph that begins the text. ``open``: ``opened``. ``line_hash`` and ``line_words``
    are those of the last line, or of the segment with a mark of omission.
    """
    t = text.rstrip(" \t\r\n\f")
    if not t:
        return {"kind": "empty", "last_word": None, "line_hash": None, "line_words": 0, "single": True, "open": None}
    line = t[t.rfind("\n") + 1 :].strip()
    start = 0
    for m in _STOP.finditer(line):
        if m.end() < len(line):
            start = m.end()
    segment = line[start:].strip()
    open_ = opened(t)
    words = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", segment)
    last = words[-1].lower() if words else None
    single = segment == t or segment == line and (_LIST.match(line) is not None)
    if _broken(t):
        kind = "broken"
    elif _MARK.search(t):
        kind = "mark"
    elif _CLOSED.search(t):
        kind = "closed"
    elif open_ == "bracket" or t[-1] in "-–,;:([{“„«/=<&" or text[-1] in " \t" and segment != line:
        kind = "dangling"
    elif _GROUP.match(segment):
        kind = "group"
    elif _LIST.match(line):
        kind = "list"
    elif _TABLE.match(line):
        kind = "table"
    elif _CITED.search(line):
        kind = "cited"
    else:
        kind = "plain"
    said = segment if kind == "mark" else line
    return {"kind": kind, "last_word": last, "line_hash": xxhash.xxh64_intdigest(said) - (1 << 63), "line_words": len(said.split(" ")), "single": single or _BULLET.match(line) is not None, "open": open_}


def _endings(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ending(t) for t in texts], columns=["kind", "last_word", "line_hash", "line_words", "single", "open"]).astype({"line_hash": "Int64"})


def _limits(rows: DataFrame, by: str) -> DataFrame:
    """(source, length) at which a field limit shows: unterminated texts of one length, with different last lines, far above the lengths nearby."""
    n = rows.where(~F.col("kind").isin("closed", "empty") | F.col("open").isNotNull()).groupBy("source", by).agg(F.count_distinct("line_hash").alias("n"))
    near = Window.partitionBy("source").orderBy(by).rangeBetween(-NEAR, NEAR)
    around = n.withColumn("around", (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * NEAR) + 0.3)
    evidence = F.col("n") * F.log(F.col("n") / F.col("around")) - (F.col("n") - F.col("around"))
    return around.where((F.col("n") >= LIMIT_TIMES * F.col("around")) & (evidence >= LIMIT_EVIDENCE)).select(F.col("source").alias("_src"), F.col(by).alias("_len"), F.lit(True).alias(f"at_{by}"))


def _formulas(rows: DataFrame, mark: Column) -> DataFrame:
    """(_line, _mark, formula): the last lines that close many of the texts which end with a mark, or of those with a short open last line, and their share.

    Cut ends repeat too when there are many texts, but no one of them is a large share of all ends. Texts at a field
    limit prove nothing, and copies of one text count once.
    """
    short = ~F.col("single") & (F.col("line_words") <= FORMULA_WORDS)
    ends = rows.where((mark | short) & F.col("last_word").isNotNull()).select(F.col("line_hash").alias("_line"), mark.alias("_mark"), "h").distinct()
    n = cut(ends.groupBy("_mark", "_line").agg(F.count(F.lit(1)).alias("n")))
    every = n.groupBy("_mark").agg(F.sum("n").alias("every"))
    return n.join(F.broadcast(every), "_mark").select("_line", "_mark", (F.col("n") / (F.col("every") + UNSEEN)).alias("formula")).where(F.col("formula") >= FORMULA_SHARE)


def _habits(rows: DataFrame) -> DataFrame:
    """(_src, _single, terminated, habit): the share of the texts of a source, headlines apart, that end with a terminator or in a form that needs none, and of those that leave a delimiter open though they do."""
    full = rows.where("kind <> 'empty'").groupBy(F.col("source").alias("_src"), F.col("single").alias("_single"))
    closed = F.col("kind").isin("closed", "mark", "group", "list", "table", "cited")
    n = F.count(F.lit(1))
    return full.agg((F.count_if(closed) / n).alias("terminated"), (F.count_if(closed & F.col("open").isNotNull()) / (n + 20)).alias("habit"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if its rows, which are counted, are few."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _longer(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(_begin, longer): for each asked beginning the count of the most frequent longer word that begins with it; runs of over ``WORD`` letters are no beginnings of words."""
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("_word") - 1, F.lit(WORD))), lambda i: F.substring(F.col("_word"), F.lit(1), i))
    every = words.where(F.length("_word") > 1).select(F.explode(starts).alias("_begin"), "n_word")
    return every.join(asked, "_begin", "left_semi").groupBy("_begin").agg(F.max("n_word").alias("longer"))


def _word_ends(docs: DataFrame) -> DataFrame:
    """For each word of all texts: how often it stands before the end of a sentence or line, and in all.

    The last word of a text isn't counted, as it may be the one that was cut.
    """
    parts = F.split(F.rtrim("text"), r"[^\S\n]+|(?<=\n)")
    # counted as they are written, so that only different tokens are taken apart
    token = docs.select(F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    bare = F.lower(F.regexp_extract("t", r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*)[^\p{L}\p{N}]*$", 1))
    ends = F.col("t").rlike(r"[.!?;][\"'”’»)\]]*\s*$|\n$")
    return token.select(bare.alias("_word"), ends.alias("e"), "n").where("_word <> ''").groupBy("_word").agg(F.sum("n").alias("n_word"), F.sum(F.when(F.col("e"), F.col("n")).otherwise(0)).alias("n_ends"))


def detect(documents: DataFrame) -> DataFrame:
    """``documents`` as doc_id, source, truncated, reason.

    Null and empty texts are not truncated (reason ``empty``). A null source is a source of its own. Repeated rows are
    judged alike; other columns aren't read. ``n_chars`` is used only where structure leaves the case open, as
    it is often wrong.
    """
    docs = documents.select("doc_id", "source", "n_chars", "text")
    read = docs.withColumn("_e", F.pandas_udf(_endings, ENDING)(F.coalesce("text", F.lit(""))))
    rows = cut(read.select("doc_id", "source", "n_chars", "_e.*", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("text").alias("h")))
    open_case = F.col("kind").isin("plain", "list", "table", "cited", "mark", "group")
    headline = rows.where(F.col("single") & (F.col("kind") == "plain")).groupBy(F.col("last_word").alias("_head")).agg(F.count(F.lit(1)).alias("n_head"))
    asked = rows.where(open_case & F.col("last_word").isNotNull()).select(F.col("last_word").alias("_word")).distinct()
    every = cut(_word_ends(docs))
    words = asked.join(every, "_word", "left").join(_longer(every, asked.select(F.col("_word").alias("_begin"))), F.col("_word") == F.col("_begin"), "left").drop("_begin")
    rows = rows.join(_small(_habits(rows)), F.col("source").eqNullSafe(F.col("_src")) & (F.col("single") == F.col("_single")), "left").drop("_src", "_single")
    for by in ("chars", "bytes"):
        at = _limits(rows, by)
        rows = rows.join(at, F.col("source").eqNullSafe(at["_src"]) & (F.col(by) == at["_len"]), "left").drop("_src", "_len")
    limit = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    mark = F.col("kind") == "mark"
    lines = _formulas(rows.where(open_case & ~limit), mark)
    rows = rows.join(F.broadcast(lines), (F.when(open_case, F.col("line_hash")) == F.col("_line")) & (mark == F.col("_mark")), "left").join(words, F.when(open_case, F.col("last_word")) == F.col("_word"), "left")
    rows = rows.join(headline, F.when(open_case, F.col("last_word")) == F.col("_head"), "left")
    heads = F.greatest(F.coalesce("n_head", F.lit(0)) - 1, F.lit(0))
    fragment = F.coalesce("n_word", F.lit(0)) * FRAGMENT < F.coalesce("longer", F.lit(0))
    known, rate = F.when(fragment, 0).otherwise(F.coalesce("n_word", F.lit(0))), F.coalesce((F.col("n_ends") + heads) / (F.col("n_word") + heads), F.lit(0.0))
    goes_on = ~mark & (known > 0) & (rate < END_RATE)
    formula = F.coalesce("formula", F.lit(0.0)) >= F.when(goes_on, FORMULA_SURE).otherwise(FORMULA_SHARE)
    short = F.coalesce(F.col("n_chars") > F.col("chars") * 1.5, F.lit(False))
    number = F.col("last_word").rlike(r"^\d")
    reason = (
        F.when(F.col("kind") == "empty", "empty")
        .when(F.col("kind") == "broken", "broken sequence")
        .when(F.col("open").isNotNull() & (F.coalesce("habit", F.lit(0.0)) <= HABIT), F.concat(F.lit("open "), "open"))
        .when(F.col("kind") == "dangling", "open phrase")
        .when(mark & ~formula & (limit | (known == 0) | (rate < END_RATE)), "mark of omission")
        .when(F.col("kind").isin("closed", "mark", "group"), "complete")
        .when(formula & ~F.col("single"), "complete")
        .when(limit, "field limit")
        .when(F.col("kind").isin("table", "cited"), "complete")
        .when((known == 0) & ~number, "unknown last word")
        .when((F.col("kind") == "list") | F.col("single"), F.when(rate < END_RATE, "open phrase").when(short & (F.col("kind") == "plain") & (rate < 0.2), "short of its length").otherwise("complete"))
        .when((F.coalesce("terminated", F.lit(1.0)) < TERMINATED) & (rate >= ENDS), "complete")
        .otherwise("open sentence")
    )
    done = rows.withColumn("reason", reason)
    return done.select("doc_id", "source", (~F.col("reason").isin("empty", "complete")).alias("truncated"), "reason")


def by_source(documents: DataFrame) -> DataFrame:
    """For each source: texts, truncated texts and their share."""
    found = detect(documents).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated"))
    return found.withColumn("share", F.col("truncated") / F.col("texts"))
