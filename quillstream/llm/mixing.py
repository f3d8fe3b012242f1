"""Texts drawn from several sources so that each has its share of all tokens (problem 9).

Method: subset-sum budget fitting. Texts are counted by source and exact token length. A source's budget is met
by whole passes over its texts and, for what remains, by a number of texts of each length: most of it in
proportion, the last part by bounded-knapsack dynamic programming, which hits the budget to the token where any
choice does. Which texts of a length are drawn is decided by a seeded hash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.tokens import VOCABULARY, counted
from quillstream.session import BROADCAST_ROWS, cut, salted_rank

SEED = 7
#: The part of a budget, in tokens, that the dynamic program fits.
LAST = 16_384


def budgets(held: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to draw from each source: its share of the largest total that all sources with texts can bear (or of ``total``, if that is less).

    Sources without texts can't contribute; the others keep their shares of the total, so what is missing makes
    every reached share larger in proportion.
    """
    able = {s: (share, cap) for s, (share, cap) in targets.items() if held.get(s, 0) > 0 and share > 0 and cap > 0}
    if not able:
        return {}
    most = min(held[s] * cap / share for s, (share, cap) in able.items())
    if total is not None:
        most = min(most, total)
    return {s: min(int(share * most + 1e-6), held[s] * cap) for s, (share, cap) in able.items()}


def fit(counts: dict[int, int], budget: int, last: int = LAST) -> dict[int, int]:
    """How many texts of each length to take so that their lengths sum to ``budget``, or as little less as possible within the part that is fitted.

    ``counts`` has the number of texts by length. All but about ``last`` tokens is taken in proportion to the
    counts; the rest is a subset sum over what is left, by bounded knapsack on a bit set.
    """
    total = sum(n * k for n, k in counts.items())
    if budget >= total:
        return dict(counts)
    take = {n: math.floor(k * max(0.0, budget - last) / total) for n, k in counts.items()}
    left = budget - sum(n * k for n, k in take.items())
    for n in sorted(counts, reverse=True):
        more = min(counts[n] - take[n], max(0, (left - last) // n))
        take[n] += more
        left -= n * more
    # bounded knapsack: chunks of 1, 2, 4 ... texts of a length; bit t of a state says that t tokens can be reached
    chunks, states, mask = [], [1], (1 << (left + 1)) - 1
    for n in sorted(counts, reverse=True):
        k, size = min(counts[n] - take[n], left // n), 1
        while k > 0:
            size = min(size, k)
            state = states[-1] | states[-1] << n * size & mask
            if state != states[-1]:
                chunks.append((n, size))
                states.append(state)
            k -= size
            size *= 2
        if states[-1] >> left & 1:
            break
    at = states[-1].bit_length() - 1
    for (n, size), before in zip(reversed(chunks), reversed(states[:-1])):
        if not before >> at & 1:
            take[n] += size
            at -= n * size
    return {n: k for n, k in take.items() if k}


def texts_of(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of each distinct text of the sources with a target.

    A text that occurs in several rows is one text, of the row with the lowest doc_id. Texts that are null or
    have no tokens, and sources that are null or have no target, take no part.
    """
    named = targets.select(F.col("source").alias("_s")).where("_s is not null").distinct()
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    rows = documents.select("doc_id", "source", "text").where("text <> ''").join(named, F.col("source") == F.col("_s"), "left_semi")
    one = rows.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.reverse("text")).alias("g"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id"))
    firsts = rows.join(one.select("doc_id"), "doc_id", "left_semi")
    return counted(firsts, "text", ["doc_id", "source"], vocabulary).where("tokens > 0")


def draw(texts: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The texts drawn: doc_id, source, tokens, uses (1 to the source's ``max_repeats``).

    ``texts`` has doc_id, source and tokens. The counts by source and length go to the driver: a row for each
    different length of a source, however many texts there are. An equal seed draws equal texts.
    """
    spark = texts.sparkSession
    texts = cut(texts.select("doc_id", "source", "tokens"))
    goal = {r.source: (r.target_share, r.max_repeats) for r in targets.where("source is not null").groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats")).collect()}
    counts: dict[str, dict[int, int]] = {}
    for r in texts.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.source, {})[r.tokens] = r.n
    held = {s: sum(n * k for n, k in c.items()) for s, c in counts.items()}
    plan = []
    for s, budget in budgets(held, goal, total).items():
        passes = budget // held[s]
        more = fit(counts[s], budget - passes * held[s]) if budget > passes * held[s] else {}
        plan += [(s, n, passes, more.get(n, 0)) for n in counts[s] if passes or more.get(n)]
    schema = T.StructType([T.StructField("p_source", T.StringType()), *[T.StructField(x, T.LongType()) for x in ("p_tokens", "passes", "more")]])
    chosen = spark.createDataFrame(plan, schema)
    if len(plan) <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    ranked = salted_rank(texts, ["source", "tokens"], [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")], "_rank")
    found = ranked.join(chosen, (F.col("source") == F.col("p_source")) & (F.col("tokens") == F.col("p_tokens")))
    uses = F.col("passes") + F.when(F.col("_rank") < F.col("more"), 1).otherwise(0)
    return found.select("doc_id", "source", "tokens", uses.alias("uses")).where("uses > 0")


def shares(drawn: DataFrame, texts: DataFrame, targets: DataFrame) -> DataFrame:
    """The report, one row for each target: source, target_share, reached_share, tokens, texts_available, texts_used, most_uses."""
    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("texts_used"), F.max("uses").alias("most_uses"))
    there = texts.groupBy("source").agg(F.count(F.lit(1)).alias("texts_available"))
    total = used.agg(F.sum("tokens").alias("_all"))
    rows = targets.select("source", "target_share").join(used, "source", "left").join(there, "source", "left").join(F.broadcast(total), how="cross")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"), *[zero(c) for c in ("tokens", "texts_available", "texts_used", "most_uses")])
