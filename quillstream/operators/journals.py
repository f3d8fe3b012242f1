"""The journal list and the match of a journal name inside a citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import collapse_capitals
from quillstream.session import BROADCAST_ROWS

_TOKEN = r"\([^)]*\)|[^,.;:?! ()]+"


def catalogue(journals: DataFrame) -> DataFrame:
    """nlmid, journaltitle, medabbr, first_ord of entries with an id and an abbreviation; of repeated ids the last row counts, in the place of the first."""
    from quillstream.operators.store import last_wins

    t = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    rows = journals.select(t("nlmid"), t("journaltitle"), t("medabbr"), "ord").where("nlmid <> '' and medabbr <> ''")
    return last_wins(rows, ["nlmid"], "ord").select("nlmid", "journaltitle", "medabbr", "first_ord")


def key_tokens(name: Column) -> Column:
    """Tokens of an index key: full stops dropped, cut at punctuation and spaces, single capitals joined."""
    return collapse_capitals(F.filter(F.split(F.translate(name, ".", ""), "[,;:?! ]+"), lambda t: t != ""))


def index(journals: DataFrame) -> DataFrame:
    """last_token, tokens, abbr, kind, ord: abbreviations, and titles in lower case; a name that several entries share stands for the last of them."""
    from quillstream.operators.store import last_wins

    c = catalogue(journals)
    bare = lambda x: F.trim(F.translate(x, ".", ""))
    short = last_wins(c.select(bare("medabbr").alias("name"), F.col("medabbr").alias("abbr"), F.col("first_ord").alias("ord")), ["name"], "ord").withColumn("kind", F.lit("abbr"))
    titles = last_wins(c.where("journaltitle <> ''").select(F.lower(bare("journaltitle")).alias("name"), F.col("medabbr").alias("abbr"), F.col("first_ord").alias("ord")), ["name"], "ord").withColumn("kind", F.lit("title"))
    both = short.unionByName(titles).withColumn("tokens", key_tokens(F.col("name"))).where(F.size("tokens") > 0)
    return both.select(F.element_at("tokens", -1).alias("last_token"), "tokens", "abbr", "kind", F.col("first_ord").alias("ord"))


def token_spans(text: Column) -> Column:
    """array<struct<tok,start,stop>> of a citation: groups in parentheses are one token, runs of single capitals are joined; spans count from 0."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)[,.;:?! ()]*?(?:{_TOKEN})"), F.lit(0))
    empty = F.struct(F.array().cast("array<struct<tok:string,start:int,stop:int,one:boolean>>").alias("a"), F.lit(0).alias("at"))

    # each value is made once for a token: an expression in a lambda is evaluated anew wherever it stands
    read = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, rf"(?s)({_TOKEN})$", 1).alias("raw"), F.length(p).alias("n")))
    bare = F.transform(read, lambda r: F.struct(F.translate(r["raw"], ".", "").alias("tok"), F.length(r["raw"]).alias("w"), r["n"].alias("n")))
    items = F.transform(bare, lambda r: F.struct(r["tok"].alias("tok"), r["w"].alias("w"), r["n"].alias("n"), r["tok"].rlike(r"^\p{Lu}$").alias("one")))

    def step(acc: Column, x: Column) -> Column:
        tok, one, stop = x["tok"], x["one"], acc["at"] + x["n"]
        last = F.try_element_at(acc["a"], F.lit(-1))
        joins = one & F.coalesce(last["one"], F.lit(False))
        item = F.struct(F.when(joins, F.concat(last["tok"], tok)).otherwise(tok).alias("tok"), F.when(joins, last["start"]).otherwise(stop - x["w"]).alias("start"), stop.alias("stop"), one.alias("one"))
        kept = F.when(joins, F.slice(acc["a"], 1, F.greatest(F.size(acc["a"]) - 1, F.lit(0)))).otherwise(acc["a"])
        return F.struct(F.when(tok == "", acc["a"]).otherwise(F.concat(kept, F.array(item))).alias("a"), stop.alias("at"))

    return F.transform(F.aggregate(items, empty, step)["a"], lambda t: F.struct(t["tok"].alias("tok"), t["start"].alias("start"), t["stop"].alias("stop")))


def match(citations: DataFrame, key: str, text: str, idx: DataFrame) -> DataFrame:
    """key, title, journal, numbers, partial: the journal named in each citation, what stands before and what after it.

    The rightmost name that is followed by a number, a parenthesis or nothing wins, then the longest, then the
    one listed first; the last token of a text can't end a name. Abbreviations are matched as they are, titles
    only where no abbreviation fits and in any case. ``partial``: nothing fits, but a name could if the text
    began earlier. Citations without a match have a null journal.
    """
    name, key = key, "_id"
    rows = citations.select(F.col(name).alias(key), F.col(text).alias("_t")).withColumn("_s", token_spans(F.col("_t")))
    idx = F.broadcast(idx) if idx.count() <= BROADCAST_ROWS else idx
    at = rows.select(key, "_t", "_s", F.posexplode("_s").alias("_i", "_x")).where(F.col("_i") < F.size("_s") - 1)
    low = lambda a: F.transform(a, F.lower)
    toks = F.transform("_s", lambda s: s["tok"])
    kinds = F.explode(F.array(F.struct(F.lit("abbr").alias("k"), F.col("_x.tok").alias("w")), F.struct(F.lit("title").alias("k"), F.lower("_x.tok").alias("w")))).alias("_k")
    probe = at.select(key, "_t", "_s", "_i", kinds).select("*", "_k.k", "_k.w")
    hit = probe.join(idx, (F.col("w") == F.col("last_token")) & (F.col("k") == F.col("kind"))).withColumn("_toks", toks)
    n = F.size("tokens")
    have = F.when(F.col("k") == "title", low("_toks")).otherwise(F.col("_toks"))
    first = F.col("_i") - n + 1
    whole = (first >= 0) & (F.slice(have, F.greatest(first, F.lit(0)) + 1, n) == F.col("tokens"))
    cut_off = (first < 0) & (F.slice(have, 1, F.col("_i") + 1) == F.slice("tokens", F.greatest(-first, F.lit(0)) + 1, F.col("_i") + 1))
    edge = r"[ .,;:]"
    title = F.when(first > 0, F.regexp_replace(F.substring("_t", F.lit(1), F.get(F.transform("_s", lambda s: s["start"]), first)), f"{edge}+$", "")).otherwise("")
    numbers = F.regexp_replace(F.substring(F.col("_t"), F.get(F.transform("_s", lambda s: s["stop"]), F.col("_i")) + 1, F.length("_t")), f"^{edge}+", "")
    found = hit.where(whole | cut_off).select(key, "k", "_i", n.alias("n"), "ord", "abbr", whole.alias("whole"), F.when(whole, title).alias("title"), F.when(whole, numbers).alias("numbers"))
    # of names that end at one token the longest counts, whether or not what follows it is a number
    longest = F.row_number().over(Window.partitionBy(key, "k", "_i").orderBy(F.desc("n"), "ord"))
    fits = found.where("whole").withColumn("_r", longest).where("_r = 1").where((F.col("numbers") == "") | F.col("numbers").rlike(r"^\s*[\d(]"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.col("k"), F.desc("_i")))
    one = fits.withColumn("_r", best).where("_r = 1").select(F.col(key).alias("_key"), "title", F.col("abbr").alias("journal"), "numbers")
    part = found.where(~F.col("whole")).select(F.col(key).alias("_pkey")).distinct().withColumn("_part", F.lit(True))
    out = rows.select(key).join(one, F.col(key) == F.col("_key"), "left").join(part, F.col(key) == F.col("_pkey"), "left")
    return out.select(F.col(key).alias(name), "title", "journal", "numbers", (F.col("journal").isNull() & F.coalesce("_part", F.lit(False))).alias("partial"))
