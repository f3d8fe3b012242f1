"""Records of two sources that are the same publication, matched without a common key (problem 6).

Method: soft-logic linkage. Every candidate pair is a variable between 0 and 1, the confidence that both are the same
publication. Weighted rules become squared hinge losses, each pulling one way only: similar titles and agreeing numbers
speak for a match, a match speaks for similar titles and agreeing numbers, a word that only one title has and a prior
speak against it. Exclusivity lets a cited work be one publication at most. Transitivity makes lines that say the
same share their match. The whole is convex and is solved by alternating directions: the blocks of cited works, with
their rules and exclusivity, and the rules between lines have copies of the variables of their own, which duals
bring to agree; rounds go on until primal and dual residuals are below ``RESIDUAL``.

Candidates: a reference is a set of tokens (words of its title, year, volume, first page) with the information that
each has among all records. Two references are compared if what they share tells them from chance: some smallest set
of shared tokens, taken from the rarest on, has the information ``log(records) + MARGIN``. All such sets of a reference that skip
at most the share ``SKIP`` of its information are keys. As the tables grow keys take more tokens, but no reference
loses them; one that has too little information altogether has the set of all its tokens as its key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.session import cut

#: Weights of the rules: similar titles and agreeing numbers for a match, a match for both, strange words and the prior against it, lines that say the same.
FOR_TITLE, FOR_NUMBERS, TITLE_VETO, NUMBERS_VETO, STRANGE, PRIOR, SAME = 3.0, 3.0, 3.0, 3.0, 9.0, 0.35, 2.0
#: How much more numbers must agree under a title that tells nothing.
VAGUE = 2.0
#: Weight of year, volume and page together, all of which must be known to speak for a match without a title.
ALL_NUMBERS = 3.8
#: What a pair may still be with one word that only one title has, and what each further one takes off.
ONE_STRANGE, MORE_STRANGE = 0.35, 0.15
#: A pair is a match from this confidence on.
ACCEPT = 0.5
#: Share of edits in the letters of titles from which they aren't similar at all, and the most edits that are counted.
APART, EDITS = 0.26, 1_000
#: Penalty of disagreement between copies, the residual at which they agree, and rounds at most.
RHO, RESIDUAL, ROUNDS = 8.0, 5e-3, 30
#: Pairs of a block, and lines of one record that form a chain.
BLOCK = 20_000
#: Information beyond that which tells one record of all, and the share of its information that a reference may lack.
MARGIN, SKIP = 3.0, 0.45
#: Tokens of a reference that are combined at once; of longer ones the tokens are divided by their hashes.
TOKENS = 16
#: Words that references drop.
STOP = "a an and as at by de der des die in of on the to for from with during through under vs versus und la le los las el en y et du der dans chez".split()
#: What a title begins with that is about another publication.
ABOUT = r"^\W*(comment(?:ary)? on|comments? to|erratum(?: to| for)?|corrigendum(?: to)?|correction(?: to)?|corrected|retraction(?: of| note)?|retracted|reply to|response to|re|authors? reply|letter regarding|addendum(?: to)?|expression of concern)\s*[:–—-]\s*"
_PART = r"(?i)(?:\bpart\s+|\()(\d+|i{1,3}|iv|v)\b\)?\W*$|(?i)[.:]\s*(i{1,3}|iv|v|\d)\.\s"


def _plain(text: Column) -> Column:
    """Lower case without diacritics; anything but letters and digits becomes one space."""
    low = F.lower(F.regexp_replace(text, r"\p{M}", ""))
    return F.trim(F.regexp_replace(F.translate(low, "áàâäãåéèêëíìîïóòôöõøúùûüñçý", "aaaaaaeeeeiiiioooooouuuuncy"), r"[^a-z0-9]+", " "))


def _fields(df: DataFrame, title: str, year: str, volume: str, pages: str, keep: list[str]) -> DataFrame:
    """The comparable parts of a reference."""
    t = F.coalesce(F.col(title), F.lit(""))
    about = F.regexp_extract(F.lower(t), ABOUT, 1)
    part = F.upper(F.coalesce(F.nullif(F.regexp_extract(t, _PART, 1), F.lit("")), F.nullif(F.regexp_extract(t, _PART, 2), F.lit(""))))
    roman = F.when(part == "I", "1").when(part == "II", "2").when(part == "III", "3").when(part == "IV", "4").when(part == "V", "5").otherwise(part)
    words = F.filter(F.split(_plain(F.regexp_replace(t, f"(?i){ABOUT}", "")), " "), lambda w: (w != "") & ~F.array_contains(F.lit(STOP), w))
    pg = F.lower(F.regexp_replace(F.coalesce(F.col(pages), F.lit("")), r"(?i)^\s*pp?\.?\s*|\s", ""))
    first = F.regexp_extract(pg, r"^([a-z]?\d+)", 1)
    last = F.regexp_extract(pg, r"[-–—]([a-z]?\d+)", 1)
    last = F.when((F.length(last) < F.length(first)) & (last != ""), F.concat(F.substring(first, F.lit(1), F.length(first) - F.length(last)), last)).otherwise(last)
    return df.select(
        *keep,
        F.when(about.isin("re"), "reply").otherwise(F.regexp_extract(about, r"^([a-z]{2,6})", 1)).alias("about"),
        F.coalesce(roman, F.lit("")).alias("part"),
        words.alias("words"),
        F.regexp_extract(F.coalesce(F.col(year), F.lit("")), r"((?:1[89]|20)\d\d)", 1).alias("year"),
        F.regexp_extract(F.coalesce(F.col(volume), F.lit("")), r"(\d+)", 1).alias("volume"),
        first.alias("first"),
        last.alias("last"),
    )


def _tokens(df: DataFrame, id_: str) -> DataFrame:
    """(id, token, before): the different tokens of each reference; of a word the word before it."""
    tag = lambda c, t: F.when(F.col(c) != "", F.struct(F.concat(F.lit(t), F.col(c)).alias("token"), F.lit("").alias("before")))
    spoken = F.transform("words", lambda w, i: F.struct(w.alias("token"), F.when(i > 0, F.get("words", i - 1)).otherwise("").alias("before")))
    every = F.concat(F.filter(F.array(tag("year", "y:"), tag("volume", "v:"), tag("first", "p:")), lambda x: x.isNotNull()), spoken)
    return df.select(id_, F.inline(every)).groupBy(id_, "token").agg(F.min("before").alias("before"))


def rarity(papers: DataFrame, rows: int) -> DataFrame:
    """(token, info, lead, given): the information of each token of the records, the word that most often stands before it, and the information it has beside that word.

    A word that nearly always follows one and the same word (as ``mortality`` follows ``all-cause``) tells little beside it. A word
    of so few records that any set with it is small anyway (e^MARGIN) is taken by itself.
    """
    n = cut(_tokens(papers, "r").groupBy("before", "token").agg(F.count(F.lit(1)).alias("n")))
    words = n.groupBy("token").agg(F.sum("n").alias("n"), F.max_by("before", F.struct("n", "before")).alias("lead"), F.max("n").alias("most"))
    led = words.join(words.select(F.col("token").alias("_lead"), F.col("n").alias("n_lead")), F.col("lead") == F.col("_lead"), "left")
    info = F.log(F.lit(float(rows)) / F.col("n"))
    given = F.when(F.col("n_lead").isNotNull() & (F.col("n") > math.exp(MARGIN)), F.least(info, F.log(F.greatest(F.col("n_lead") / F.col("most"), F.lit(1.0))))).otherwise(info)
    return cut(led.select("token", info.alias("info"), "lead", given.alias("given")))


def _sets(hashes: np.ndarray, info: np.ndarray, lead: np.ndarray, given: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the smallest sets of tokens, taken from the rarest on, that have the information ``least``.

    A row of the matrices has its tokens rarest first (information 0 where there is none); ``lead`` is the place of the word that
    usually stands before a token, or -1. The sets grow token by token for all rows at once.
    """
    width, total = info.shape[1], info.sum(axis=1)
    there = info > 0
    out_row, out_key = [], []

    def grow(rows: np.ndarray, taken: tuple[int, ...], key: np.ndarray, have: np.ndarray, skipped: np.ndarray, at: int) -> None:
        for j in range(at, width):
            ok = there[rows, j]
            if not ok.all():
                rows, key, have, skipped = rows[ok], key[ok], have[ok], skipped[ok]
            if not len(rows):
                return
            more = np.where(np.isin(lead[rows, j], taken) if taken else False, given[rows, j], info[rows, j])
            for i in taken:  # a token that usually stands before one of the set
                more = np.where(lead[rows, i] == j, np.maximum(info[rows, j] + given[rows, i] - info[rows, i], 0), more)
            now, k = have + more, key + hashes[rows, j]
            full = now >= least
            out_row.append(rows[full])
            out_key.append(k[full])
            if not full.all():
                grow(rows[~full], (*taken, j), k[~full], now[~full], skipped[~full], j + 1)
            skipped = skipped + info[rows, j]
            going = skipped <= SKIP * total[rows]
            if not going.all():
                rows, key, have, skipped = rows[going], key[going], have[going], skipped[going]
            if not len(rows):
                return

    n = len(info)
    grow(np.arange(n), (), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), 0)
    row, key = np.concatenate([np.zeros(0, int), *out_row]), np.concatenate([np.zeros(0, np.int64), *out_key])
    none = np.setdiff1d(np.flatnonzero(there[:, 0]) if width else np.zeros(0, int), row)
    return np.concatenate([row, none]), np.concatenate([key, hashes[none].sum(axis=1)])


def _keys(df: DataFrame, id_: str, rare: DataFrame, least: float) -> DataFrame:
    """(id, key): the keys of each reference (see the module's docstring). Tokens that no record has are no tokens."""
    has = _tokens(df, id_).join(rare, "token").where("info > 0")
    item = F.struct((-F.col("info")).alias("rare"), F.xxhash64("token").alias("h"), F.xxhash64("lead").alias("l"), "given")
    listed = has.groupBy(id_).agg(F.sort_array(F.collect_list(item)).alias("t"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1)
            flat = t.flatten()
            size = np.diff(t.offsets.to_numpy())
            owner = np.repeat(np.arange(len(size)), size)
            rare_, h, led, given = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            # long references in parts: by the parts that their own length asks for, and by twice as many
            parts = 1 << np.ceil(np.log2(np.maximum(size / TOKENS, 1))).astype(int)
            number = None
            for times in (1, 2):
                mine = parts[owner] * times
                use = np.ones(len(owner), bool) if times == 1 else size[owner] > TOKENS // 2
                if not use.any():
                    continue
                # stable: the tokens of a part stay rarest first
                part = np.where(mine > 1, (h.astype(np.uint64) >> np.uint64(7)) % np.maximum(mine, 1).astype(np.uint64), 0).astype(int)
                order = np.lexsort((part, owner))
                order = order[use[order]]
                o, q = owner[order], part[order]
                new = np.concatenate([[True], (o[1:] != o[:-1]) | (q[1:] != q[:-1])])
                group = np.cumsum(new) - 1
                start = np.flatnonzero(new)
                col = np.arange(len(order)) - start[group]
                width = int(col.max()) + 1
                shape = (len(start), width)
                hs, info, gv, ld = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape), np.full(shape, -1)
                hs[group, col], info[group, col], gv[group, col] = h[order], -rare_[order], given[order]
                leads = np.zeros(shape, np.int64)
                leads[group, col] = led[order]
                for j in range(width):
                    same = hs == leads[:, j : j + 1]
                    same &= info > 0
                    found = same.any(axis=1)
                    ld[found, j] = same[found].argmax(axis=1)
                row, key = _sets(hs, info, ld, gv, least)
                ids = b.column(0).to_numpy()[o[start][row]]
                number = (ids, key) if number is None else (np.concatenate([number[0], ids]), np.concatenate([number[1], key]))
            if number is not None:
                yield pa.record_batch([pa.array(number[0]), pa.array(number[1])], names=[id_, "key"])

    return listed.mapInArrow(make, f"{id_} long, key long")


def candidates(works: DataFrame, papers: DataFrame, rare: DataFrame, least: float) -> DataFrame:
    """(c, r): pairs that share a key.

    Both sides hold distinct references, so a popular publication is one row and not its many copies.
    """
    a, b = (_keys(x, i, rare, least) for x, i in ((works, "c"), (papers, "r")))
    return a.join(b, "key").select("c", "r").distinct()


def _told(papers: DataFrame, rare: DataFrame, least: float) -> DataFrame:
    """``papers`` with ``told``: how surely the title alone tells the publication, 0 to 1.

    That is the share of the information ``least`` that its words have, divided by the publications with the same title.
    """
    title = F.xxhash64("words", "about", "part")
    alike = papers.groupBy(title.alias("_t")).agg(F.countDistinct("pmid").alias("_n")).where("_n > 1")
    words = papers.select("r", F.explode(F.array_distinct("words")).alias("token")).join(rare, "token")
    told = words.groupBy(F.col("r").alias("_r")).agg(F.least(F.lit(1.0), F.sum("info") / least).alias("told"))
    both = papers.join(told, F.col("r") == F.col("_r"), "left").join(alike, title == F.col("_t"), "left")
    return both.withColumn("told", F.coalesce("told", F.lit(0.0)) / F.coalesce("_n", F.lit(1))).drop("_r", "_t", "_n")


def features(pairs: DataFrame, works: DataFrame, papers: DataFrame) -> DataFrame:
    """c, r, title (similarity 0 to 1, null without a title), told (how much the title tells), numbers (agreement 0 to 1, null without any), weight (of the numbers known) and strange (words that only one title has).

    Pairs that contradict each other (a comment on a publication, another part of a series) are left out, and so are those
    whose rules can't reach ``ACCEPT`` whatever the letters of their titles: words shared and numbers bound it from above. The cheap
    comparisons come first; their survivors are written down before edit distances are taken.
    """
    left = works.select("c", *[F.col(x).alias(f"c_{x}") for x in ("about", "part", "words", "year", "volume", "first", "last")])
    right = papers.select("r", *[F.col(x).alias(f"r_{x}") for x in ("about", "part", "words", "year", "volume", "first", "last")], "told")
    p = pairs.join(left, "c").join(right, "r")
    same = lambda x: F.col(f"c_{x}") == F.col(f"r_{x}")
    known = lambda x: (F.col(f"c_{x}") != "") & (F.col(f"r_{x}") != "")
    p = p.where(same("about") & ~(known("part") & ~same("part")))
    letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    digits = lambda x: letters(F.ltrim(x, F.lit("0")))
    year_near = F.abs(F.try_to_number(F.col("c_year"), F.lit("9999")) - F.try_to_number(F.col("r_year"), F.lit("9999"))) <= 1
    pages_near = (F.levenshtein("c_first", "r_first") <= 1) & (F.length("c_first") > 2)
    last_open = (F.col("c_last") == "") | (F.col("r_last") == "") | same("last")
    page = F.when(same("first"), F.when(last_open, 1.0).otherwise(0.8)).when((F.col("c_last") != "") & same("last"), 0.7).when(pages_near, 0.3).otherwise(0.0)
    parts = [
        (known("year"), F.when(same("year"), 1.0).when(year_near, 0.5).otherwise(0.0), 1.0),
        (known("volume"), F.when(same("volume"), 1.0).when(digits(F.col("c_volume")) == digits(F.col("r_volume")), 0.6).otherwise(0.0), 1.2),
        (known("first"), page, 1.6),
    ]
    value = sum((F.when(k, v * w).otherwise(0.0) for k, v, w in parts), F.lit(0.0))
    weight = sum((F.when(k, w).otherwise(0.0) for k, _, w in parts), F.lit(0.0))
    shared = F.size(F.array_intersect("c_words", "r_words")) / F.nullif(F.least(F.size("c_words"), F.size("r_words")), F.lit(0))
    p = p.select("c", "r", "told", "c_words", "r_words", value.alias("value"), weight.alias("weight"), shared.alias("shared"))
    p = p.withColumn("numbers", F.col("value") / F.nullif("weight", F.lit(0.0))).drop("value")
    # with less than half of the words in common letters give half a title at most
    most = F.when(F.col("shared").isNull(), F.lit(None).cast("double")).when(F.col("shared") < 0.3, 0.0).when(F.col("shared") < 0.6, 0.5).otherwise(1.0)
    p = cut(p.where(_bound(most) >= ACCEPT))
    whole = {x: F.array_join(f"{x}_words", " ") for x in "cr"}
    n_c, n_r = F.length(whole["c"]), F.length(whole["r"])
    short = F.least(n_c, n_r)
    edits = lambda a, b: F.call_function("levenshtein", a, b, F.lit(EDITS))
    share = lambda d, n: F.when(d < 0, 1.0).otherwise(d / F.greatest(n, F.lit(1)))
    apart = share(edits(whole["c"], whole["r"]), F.greatest(n_c, n_r))
    apart_cut = F.when(short >= 15, share(edits(F.left(whole["c"], short), F.left(whole["r"], short)), short) + 0.04).otherwise(F.lit(1.0))
    p = p.withColumn("apart", F.least(apart, apart_cut))
    # a word of one title without a counterpart in the other (but for a last word that may be cut) means another subject
    within = lambda x, y, k: F.call_function("levenshtein", x, y, F.lit(2)).between(0, k)
    like = lambda x, y: within(x, y, F.when(x.rlike(r"\d"), 0).when(F.length(x) >= 6, 2).when(F.length(x) >= 4, 1).otherwise(0))
    last = lambda x, a: x == F.element_at(f"{a}_words", -1)
    begins_stop = lambda x: F.exists(F.lit(STOP), lambda y: F.startswith(y, x))
    alone = lambda a, b: F.size(F.filter(F.array_except(f"{a}_words", f"{b}_words"), lambda x: ~F.exists(F.col(f"{b}_words"), lambda y: like(x, y) | (F.length(x) >= 4) & (F.length(x) == F.length(y)) & (letters(x) == letters(y)) | F.startswith(y, x) & last(x, a)) & ~(last(x, a) & ((F.length(x) <= 3) | begins_stop(x)))))
    strange = F.when(F.col("apart") < APART, F.least(alone("c", "r"), alone("r", "c"))).otherwise(0)
    p = cut(p.select("c", "r", "told", "numbers", "weight", "shared", "apart", strange.alias("strange")))
    title = F.when(F.col("shared").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("apart") / APART))
    return p.select("c", "r", title.alias("title"), "told", "numbers", "weight", "strange")


def _bound(title: Column) -> Column:
    """The value that the rules of a pair alone can reach at most, with at most this similarity of titles."""
    t = F.when(title.isNotNull(), FOR_TITLE * F.col("told")).otherwise(0.0)
    n = F.when(F.col("numbers").isNotNull() & (title.isNotNull() | (F.col("weight") >= ALL_NUMBERS)), FOR_NUMBERS * _trust(F.col("weight"))).otherwise(0.0)
    # vetoes bind only above their level, so the better of both speaks for the match and the other against it
    up = t * F.coalesce(title, F.lit(0.0)) + n * F.coalesce("numbers", F.lit(0.0))
    return F.greatest(up / (t + n + PRIOR), F.lit(0.0))


def _trust(weight):
    """The weight of numbers, which grows with how many are known."""
    return F.least(F.lit(1.0), 0.4 + weight / 4) if isinstance(weight, Column) else np.minimum(1.0, 0.4 + weight / 4)


def _rules(block: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(level, weight, for) of each rule for all pairs: weight x max(0, level - v)^2 if it speaks for a match, else weight x max(0, v - level)^2."""
    t, n = block["title"].to_numpy(float), block["numbers"].to_numpy(float)
    told, strange = block["told"].to_numpy(float), block["strange"].to_numpy(float)
    has_t, trust = (~np.isnan(t)).astype(float), np.where(np.isnan(n), 0.0, _trust(block["weight"].to_numpy(float)))
    t, n = np.nan_to_num(t), np.nan_to_num(n)
    told, alone = told * has_t, np.where((has_t == 0) & (block["weight"].to_numpy(float) < ALL_NUMBERS), 0.0, 1.0)
    odd = np.maximum(0.0, ONE_STRANGE - MORE_STRANGE * (strange - 1))
    return [(t, FOR_TITLE * told * has_t, True), (n, FOR_NUMBERS * trust * alone, True), (t, TITLE_VETO * has_t, False), (n, NUMBERS_VETO * (1 + VAGUE * (1 - told)) * trust, False), (odd, STRANGE * (strange > 0), False), (np.zeros(len(t)), np.full(len(t), PRIOR), False)]


def _least(rules: list, pull: np.ndarray, rho: float, price: np.ndarray) -> np.ndarray:
    """The value of each pair that minimises its rules, rho/2 (v - pull)^2 and price x v: the zero of an increasing slope, by halving."""
    lo, hi = np.zeros(len(pull)), np.ones(len(pull))
    for _ in range(30):
        v = (lo + hi) / 2
        slope = rho * (v - pull) + price
        for level, weight, good in rules:
            slope = slope - 2 * weight * np.maximum(level - v, 0) if good else slope + 2 * weight * np.maximum(v - level, 0)
        up = slope < 0
        lo, hi = np.where(up, v, lo), np.where(up, hi, v)
    return (lo + hi) / 2


def _works_step(block: pd.DataFrame, rho: float) -> np.ndarray:
    """The copies of a block of cited works: rules, agreement with the consensus, and a sum of at most 1 for each work.

    The constraint has a price for each work, found by halving.
    """
    rules = _rules(block)
    pull = (block["z"] - block["u"]).to_numpy(float)
    groups, at = np.unique(block["c"].to_numpy(), return_inverse=True)
    v = _least(rules, pull, rho, np.zeros(len(block)))
    over = np.bincount(at, weights=v, minlength=len(groups)) > 1 + 1e-9
    if not over.any():
        return v
    rows = np.flatnonzero(over[at])
    names, own = np.unique(at[rows], return_inverse=True)
    part = [(a[rows], w[rows], g) for a, w, g in rules]
    lo, hi = np.zeros(len(names)), np.full(len(names), 2 * (FOR_TITLE + FOR_NUMBERS) + rho + 1)
    for _ in range(30):
        price = (lo + hi) / 2
        x = _least(part, pull[rows], rho, price[own])
        high = np.bincount(own, weights=x, minlength=len(names)) > 1
        lo, hi = np.where(high, price, lo), np.where(high, hi, price)
    v[rows] = _least(part, pull[rows], rho, hi[own])
    return v


def _lines_step(block: pd.DataFrame, rho: float) -> pd.DataFrame:
    """The copies of the rules between lines of one record, the new consensus, the duals and the residuals.

    Lines stand in chains; ``near`` is how much a line says the same as the next one. The rule of two lines is
    SAME x max(0, |v_i - v_j| - (1 - near))^2, whose minimum beside the consensus is in closed form.
    """
    b = block.sort_values(["r", "chain", "pos"], kind="stable").reset_index(drop=True)
    z, near = b["z"].to_numpy(float), b["near"].to_numpy(float)
    i = np.flatnonzero(~np.isnan(near[:-1]) & (b["r"].to_numpy()[1:] == b["r"].to_numpy()[:-1]) & (b["chain"].to_numpy()[1:] == b["chain"].to_numpy()[:-1])) if len(b) > 1 else np.zeros(0, int)
    after, before = b["after"].to_numpy(float).copy(), b["before"].to_numpy(float).copy()
    a, c = z[i] - after[i], z[i + 1] - before[i + 1]
    gap = a - c
    off = np.maximum(np.abs(gap) - (1 - near[i]), 0)
    move = np.sign(gap) * off * 2 * SAME / (rho + 4 * SAME)
    a, c = a - move, c + move
    total, n = b["x"].to_numpy(float) + b["u"].to_numpy(float), np.ones(len(b))
    np.add.at(total, i, a + after[i])
    np.add.at(total, i + 1, c + before[i + 1])
    np.add.at(n, i, 1)
    np.add.at(n, i + 1, 1)
    new = np.clip(total / n, 0, 1)
    u = b["u"].to_numpy(float) + b["x"].to_numpy(float) - new
    res = np.maximum(np.abs(b["x"].to_numpy(float) - new), rho * np.abs(new - z))
    np.maximum.at(res, i, np.abs(a - new[i]))
    np.maximum.at(res, i + 1, np.abs(c - new[i + 1]))
    after[i] += a - new[i]
    before[i + 1] += c - new[i + 1]
    return b.assign(z=new, u=u, after=after, before=before, residual=res)


STATE = "c long, r long, title double, told double, numbers double, weight double, strange int, chain int, pos int, near double, z double, u double, after double, before double"


def solve(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pairs`` (c, r, title, told, numbers, weight, strange, chain, pos, near) with ``value``, the confidence of each pair.

    The first step leaves the rules between lines out; where they hold already that is the optimum, and the residuals
    are 0.
    """
    blocks = max(1, math.ceil(pairs.count() / BLOCK))
    block = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks))
    names = STATE.replace(",", " ").split()[::2]
    start = pairs.select("*", *[F.lit(0.0).alias(x) for x in ("z", "u", "after", "before")]).select(*names)
    step = lambda df, rho: df.groupBy(block("c")).applyInPandas(lambda b: b.assign(x=_works_step(b, rho)), STATE + ", x double")
    state = cut(step(start, 0.0).withColumn("z", F.col("x")).withColumn("residual", F.lit(1.0)).drop("x"))
    for _ in range(rounds):
        moved = step(state.drop("residual"), RHO).groupBy(block("r")).applyInPandas(lambda b: _lines_step(b, RHO)[[*names, "residual"]], STATE + ", residual double")
        state = cut(moved)
        if (state.agg(F.max("residual")).first()[0] or 0.0) <= RESIDUAL:
            break
    return state.withColumn("value", F.col("z"))


def chains(pairs: DataFrame, works: DataFrame) -> DataFrame:
    """``pairs`` with ``chain``, ``pos`` and ``near``: the lines that may be one record, in the order of their words, each compared with the next.

    Chains give every line a neighbour without all pairs of lines; the lines of a record that has more than ``BLOCK`` are
    divided into several chains by their first word.
    """
    n = pairs.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    words = works.select("c", F.array_join("words", " ").alias("said"), "year", "volume", "first", "words")
    rows = pairs.join(n, "r").join(words, "c").withColumn("chain", F.pmod(F.xxhash64(F.get("words", F.lit(0))), F.col("parts")).cast("int"))
    w = Window.partitionBy("r", "chain").orderBy("said", "c")
    nxt = lambda c: F.lead(c).over(w)
    rows = rows.select(*pairs.columns, "chain", (F.row_number().over(w) - 1).alias("pos"), "words", "year", "volume", "first", *[nxt(c).alias(f"n_{c}") for c in ("words", "year", "volume", "first")])
    least = F.least(F.size("words"), F.size("n_words"))
    title = F.when(least > 0, F.size(F.array_intersect("words", "n_words")) / least).otherwise(0.0)
    both = lambda c: (F.col(c) != "") & (F.col(f"n_{c}") != "")
    clash = sum((F.when(both(c) & (F.col(c) != F.col(f"n_{c}")), 1).otherwise(0) for c in ("year", "volume", "first")), F.lit(0))
    agree = sum((F.when(both(c) & (F.col(c) == F.col(f"n_{c}")), 1).otherwise(0) for c in ("year", "volume", "first")), F.lit(0))
    near = F.when(F.col("n_words").isNotNull(), F.greatest(F.lit(0.0), F.when(least > 0, title).otherwise(agree / 3.0) - 0.3 * clash))
    return rows.select(*pairs.columns, "chain", "pos", near.cast("double").alias("near"))


def sides(cited: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, float]:
    """(rows, works, papers, rare, least): cited rows with the work ``c`` they stand for, the distinct works, the distinct records ``r`` with their pmid, ``rarity`` and the information of a key."""
    fields = ("title", "year", "volume", "pages")
    h = F.xxhash64(*[F.coalesce(F.col(x), F.lit("")) for x in fields])
    rows = cited.select("cite_id", *fields, h.alias("c"))
    works = cut(_fields(rows.dropDuplicates(["c"]), *fields, ["c"]))
    known = refs.where("trim(pmid) <> ''").select("pmid", *fields, F.xxhash64(F.col("pmid"), h).alias("r"))
    papers = cut(_fields(known.dropDuplicates(["r"]), *fields, ["r", "pmid"]))
    n = max(1, papers.count())
    rare, least = rarity(papers, n), math.log(n) + MARGIN
    return rows, works, cut(_told(papers, rare, least)), rare, least


def link(cited: DataFrame, refs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """pmid, cite_id, confidence of every cited work and the record that is the same publication.

    All rows of cited works with the same fields share their match, and so do all rows of refs with one pmid. Null or
    empty fields neither support a match nor contradict it; a work without title matches only if year, volume
    and pages agree. Rows of refs without pmid take no part. Empty tables give no pairs.
    """
    rows, works, papers, rare, least = sides(cited, refs)
    pairs = cut(features(cut(candidates(works, papers, rare, least)), works, papers))
    # several rows of one record are one alternative: the best of them
    best = pairs.join(papers.select("r", "pmid"), "r").groupBy("c", "pmid").agg(F.max_by(F.struct("r", "title", "told", "numbers", "weight", "strange"), F.coalesce("title", F.lit(0.5)) + F.coalesce("numbers", F.lit(0.5)) - F.col("strange")).alias("b"))
    best = cut(best.select("c", "b.*", "pmid").withColumn("r", F.xxhash64("pmid")))
    values = solve(cut(chains(best.drop("pmid"), works))).where(F.col("value") >= accept)
    named = values.join(best.select("c", "r", "pmid"), ["c", "r"]).select("c", "pmid", F.col("value").alias("confidence"))
    return rows.select("cite_id", "c").join(named, "c").select("pmid", "cite_id", F.round("confidence", 4).alias("confidence"))


def recall(cited: DataFrame, refs: DataFrame, every: int = 100, block: int = 1_000) -> DataFrame:
    """One row: works, pairs, those among the candidates, recall.

    The cited works whose id ``every`` divides are compared with all records, in blocks; pairs count whose rules alone reach ``ACCEPT``.
    """
    rows, works, papers, rare, least = sides(cited, refs)
    asked = cut(works.join(rows.where(F.col("cite_id") % every == 0).select("c").distinct(), "c", "left_semi"))
    n = asked.count()
    truth = None
    for i in range(-(-n // block)):
        part = asked.where(F.pmod(F.xxhash64("c"), F.lit(-(-n // block))) == i).select("c")
        pairs = features(papers.select("r").crossJoin(F.broadcast(part)).select("c", "r"), works, papers)
        truth = pairs if truth is None else truth.unionAll(pairs)
    if truth is None:
        return works.sparkSession.createDataFrame([(0, 0, 0, None)], "works long, pairs long, found long, recall double")

    def alone(t: pd.Series, k: pd.Series, n: pd.Series, w: pd.Series, s: pd.Series) -> pd.Series:
        b = pd.DataFrame({"title": t, "told": k, "numbers": n, "weight": w, "strange": s})
        return pd.Series(_least(_rules(b), np.zeros(len(b)), 0.0, np.zeros(len(b))))

    sure = truth.where(F.pandas_udf(alone, "double")("title", "told", "numbers", "weight", "strange") >= ACCEPT).select("c", "r")
    both = sure.join(candidates(works, papers, rare, least).withColumn("hit", F.lit(1)), ["c", "r"], "left")
    total = both.agg(F.countDistinct("c").alias("works"), F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found"))
    return total.withColumn("recall", F.col("found") / F.col("pairs"))
