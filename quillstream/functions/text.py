"""String and array expressions of the reference store and of citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular expression: what separates words anywhere in this library.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"

# Words that don't take part in title queries.
STOP_WORDS = (
    "a", "an", "the", "in", "on", "at", "to", "for", "of", "by", "with", "from", "into", "through", "during", "before", "after",
    "above", "below", "between", "under", "over", "and", "but", "or", "nor", "as", "is", "are", "was", "were",
)


def words(text: Column) -> Column:
    """The words of a text; null gives null, blank text an empty array."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def strip(text: Column, more: str = "") -> Column:
    """``text`` without white space (and the characters ``more``) at its ends."""
    inside = f"(?:{SPACE}|[{more}])" if more else SPACE
    return F.regexp_replace(text, f"^{inside}+|{inside}+$", "")


def windows(items: Column, size: int, step: int) -> Column:
    """Arrays of ``size`` items beginning at every ``step``-th item; the last ones may be shorter. Empty for no items."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(items, s + 1, size))


def chunks(text: Column, size: int = 400, overlap: int = 80, least: int = 60) -> Column:
    """Windows of ``size`` words with ``overlap`` words in common, joined by spaces; those of at most ``least`` characters are dropped."""
    joined = F.transform(windows(words(text), size, size - overlap), lambda w: F.array_join(w, " "))
    return F.filter(joined, lambda c: F.length(c) > least)


def title_chunks(title: Column, size: int = 3) -> Column:
    """Title words without punctuation and stop words, in groups of ``size``."""
    plain = F.regexp_replace(title, r"[,.;:?!()\[\]+\-]", " ")
    kept = F.filter(words(plain), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return F.transform(windows(kept, size, size), lambda w: F.array_join(w, " "))


def normalise_id(text: Column) -> Column:
    """The digits at the end of a URL; anything else as it is, without white space and closing slashes."""
    bare = F.regexp_replace(strip(text), "/+$", "")
    return F.regexp_replace(bare, r"^.*/(\d+)$", "$1")


def path_stem(path: Column) -> Column:
    """The file name of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")


def url_quote(text: Column) -> Column:
    """Percent-encoding that keeps letters, digits, ``_.-~`` and ``/``."""
    coded = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def n_letters(text: Column) -> Column:
    """Number of letters of any script."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")).cast("long")


def collapse_capitals(tokens: Column) -> Column:
    """Runs of single capital letters joined into one token."""
    single = lambda t: t.rlike(r"^\p{Lu}$")
    empty = F.array().cast("array<struct<t:string,s:boolean>>")

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = single(t) & F.coalesce(last["s"], F.lit(False))
        item = F.struct(F.when(joins, F.concat(last["t"], t)).otherwise(t).alias("t"), single(t).alias("s"))
        kept = F.when(joins, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.concat(kept, F.array(item))

    return F.transform(F.aggregate(tokens, empty, step), lambda x: x["t"])


# The letters of initials as people write them, and of unusual ones.
INITIAL = "[A-Z]{1,3}"
LOOSE_INITIAL = "[A-Z]{4,}|(?=.*[a-z])(?:[a-z]{0,2}[A-Z]){2,}[a-z]{0,2}"


def _letters(word: Column) -> Column:
    return F.regexp_replace(word, "[^A-Za-z]", "")


def is_initial(word: Column) -> Column:
    """One to three capitals and no other letter."""
    return _letters(word).rlike(f"^(?:{INITIAL})$")


def is_loose_initial(word: Column) -> Column:
    """Four or more capitals, or two or more with at most two small letters around each."""
    return _letters(word).rlike(f"^(?:{LOOSE_INITIAL})$")


def short_authors(names: Column) -> Column:
    """``A``, ``A & B`` or ``A et al.`` of last names; without names `` et al.``."""
    first = F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))
    return F.when(F.size(names) == 1, first).when(F.size(names) == 2, F.concat(first, F.lit(" & "), F.element_at(names, 2))).otherwise(F.concat(first, F.lit(" et al.")))


def citation_key(in_text: Column, journal: Column, pmid: Column) -> Column:
    """The stem of a record's files: citation, journal and pmid, missing parts being empty."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(blank(in_text), F.lit(" "), blank(journal), F.lit(" "), blank(pmid))
