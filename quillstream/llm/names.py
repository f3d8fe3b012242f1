"""Spellings of one person or one organisational unit, linked (problem 7).

Method: trie join. Surnames, departments and places are sharded into tries, which Levenshtein automata walk for
all neighbours within one edit; a neighbour with many more rows is what a misspelling stands for. Token order is
undone by checking permutations: a name of full words is read with its first and with its last word as the surname, and a reading
counts if names whose order is plain (before a comma, beside initials) have that surname more often; an address is department,
institution and place in any order. Spellings whose parts are the same form a class; two classes of one
surname and initial are linked if their parts agree, and pairs of spellings follow from the links of their classes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.edit import fold
from quillstream.llm.triejoin import Trie, bases, tasks_for
from quillstream.session import cut

#: Short and foreign forms of given names, by the full form.
NICKNAMES = {
    "alexander": "alex sandy sasha xander", "alfred": "al alf fred", "andrew": "andy drew", "anthony": "tony", "antonia": "toni tonia", "barbara": "barb babs", "benjamin": "ben benny",
    "catherine": "cathy cat kitty", "charles": "charlie chuck chas", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted",
    "elizabeth": "beth betty bess eliza lisa liz lizzie", "francisco": "paco pancho curro", "frederick": "fred freddy", "friedrich": "fritz fred", "giovanni": "gianni nanni", "gregory": "greg", "henry": "hank harry hal",
    "isabella": "bella isa izzy", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans jan johann", "john": "jack johnny", "joseph": "joe joey", "katherine": "kate kathy katie kat kitty",
    "laurence": "larry laurie", "leonard": "len lenny leo", "margaret": "maggie meg peggy greta", "matthew": "matt", "michael": "mike mick mickey", "nicholas": "nick nicky", "olivia": "liv livvy", "patricia": "pat patty tricia trish",
    "peter": "pete", "philip": "phil pip", "rebecca": "becky", "richard": "dick rick ricky rich", "robert": "bob bobby rob robbie", "ronald": "ron ronnie", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie suzy",
    "theodore": "ted teddy theo", "thomas": "tom tommy", "ulrich": "uli ulli", "victoria": "vicky vic tori", "walter": "walt wally", "william": "bill billy will willy liam", "yolanda": "yoli yola", "zacharias": "zach zack",
}
#: Titles, degrees and suffixes.
TITLES = frozenset("dr prof professor mr mrs ms miss sir mag dipl ing".split())
SUFFIXES = frozenset("jr sr junior senior md phd msc bsc ba ma mph rn frcp dphil dsc mbbs esq".split())
#: Words of institutions, those that name one first, and words of units. Abbreviations and misspellings follow from them by rule.
HEADS = ("university", "hospital", "college", "institute", "centre", "school", "academy", "foundation", "polytechnic", "clinic")
ORG = (*HEADS, "general", "veterinary", "research", "technology", "technological", "technical", "medical", "national", "state", "teaching")
FOREIGN = {"universitat": "university", "universite": "university", "universidad": "university", "universita": "university"}
UNIT = ("department", "departement", "division", "section", "unit", "laboratory")
#: Words that are one word here.
_SAME = {"technological": "technology", "technical": "technology"}
#: Names and addresses that one task reads.
READ = 4_000
_SMALL = frozenset("of and for the in at de des du la le der die das und von a an".split())

_FORMAL = {n: {full} for full in NICKNAMES for n in [full]}
for _full, _short in NICKNAMES.items():
    for _n in _short.split():
        _FORMAL.setdefault(_n, set()).add(_full)
_WORD = re.compile(r"[A-Za-z]+(?:['’][A-Za-z]+)*")


def formal(given: str, known: Trie) -> list[str]:
    """The full forms that a given name in lower case may stand for; a misspelling counts as what it misspells."""
    if given not in _FORMAL and len(given) >= 4:
        near = sorted({w for w, d in known.near(given) if d == 1})
        if near:
            return sorted(set().union(*[_FORMAL[w] for w in near]))
    return sorted(_FORMAL.get(given, {given}))


def read_name(text: str, known: Trie, turned: bool = False) -> tuple[str, list[str], str, list[str], bool] | None:
    """(surname, possible first initials, middle initials, full forms of the given name, plain) of a typed name; None if it has no surname or no given name.

    ``plain``: the order of the name is beyond doubt. ``turned`` reads a name whose order isn't plain the other way round, and gives None for any other.

    A nickname of several names (Ted) has the initials of all of them.

    Understands ``Surname AB``, ``Surname, Given M.``, ``Given M. Surname`` and ``A. B. Surname``, with titles,
    degrees and suffixes anywhere and in any case.
    """
    plain = fold(text).replace("’", "'").strip()
    head, comma, tail = plain.partition(",")
    words = lambda s: [w for w in re.split(r"[\s.]+|(?<=\.)", s.replace(".", ". ")) if w.strip(".'-,;")]

    def useful(ws: list[str]) -> list[str]:
        kept = [w.strip(",;'") for w in ws]
        # a title stands first and isn't all there is; capitals such as MS or JR behind a surname are initials
        while len(kept) > 1 and kept[0].lower() in TITLES and (len(kept) > 2 or not kept[0].isupper()):
            kept = kept[1:]
        while len(kept) > 2 and kept[-1].lower() in SUFFIXES or len(kept) == 2 and kept[-1] in ("Jr", "Sr"):
            kept = kept[:-1]
        return kept

    upper = plain.isupper()
    short = lambda w: len(w) == 1 or len(w) <= 3 and w.isupper() and "-" not in w
    plain_order = True
    if comma and tail.strip() and tail.strip().rstrip(".").lower() not in SUFFIXES:
        family, given = useful(words(head)), useful([*words(tail.partition(",")[0]), "x", "x"])[:-2]
    else:
        ws = useful(words(head))
        if len(ws) < 2:
            return None
        if short(ws[-1]) and (len(ws[-1]) < len(ws[0]) or not short(ws[0])):
            at = len(ws)
            while at > 1 and short(ws[at - 1]):
                at -= 1
            family, given = ws[:at], ws[at:]
        else:
            at = 1
            while at < len(ws) - 1 and (short(ws[at]) and len(ws[at]) == 1):
                at += 1
            family, given = ws[at:], ws[:at]
            plain_order = len(given[0]) == 1
            if turned and not plain_order:
                family, given = ws[:1], ws[1:]
    if turned and plain_order:
        return None
    surname = " ".join(w.lower() for w in family).replace("ph", "f").strip()
    letters = [w for w in given if w.strip("-")]
    if not surname or not letters:
        return None
    first, rest = letters[0], letters[1:]
    if short(first) and not (len(first) > 1 and first.lower() in _FORMAL and not upper):
        initials = "".join(x for w in letters for x in (w.upper() if short(w) else w[0].upper()))
        return surname, [initials[0]], initials[1:], [], plain_order
    full = formal(first.lower(), known)
    return surname, sorted({f[0].upper() for f in full}), "".join(w.upper() if short(w) else w[0].upper() for w in rest), full, plain_order


class Words:
    """Words of a list with their abbreviations (beginnings of three letters or more, contractions) and misspellings (one edit)."""

    def __init__(self, words: tuple[str, ...], also: dict[str, str] | None = None) -> None:
        self.words, self.trie, self.memo = words, Trie(sorted(words)), dict(also or {})

    def find(self, word: str) -> str | None:
        if word not in self.memo:
            self.memo[word] = self._find(word)
        return self.memo[word]

    def _find(self, word: str) -> str | None:
        if word in self.words:
            return word
        if len(word) >= 3:
            bare = word[:-1] if word.endswith("s") else word
            begun = [w for w in self.words if w.startswith(word) or len(bare) >= 4 and w.startswith(bare)]
            if begun:
                return begun[0]
            inner = [w for w in self.words if len(word) <= len(w) // 2 and w[0] == word[0] and w[-1] == word[-1] and _inside(word, w)]
            if inner:
                return min(inner, key=len)
        if len(word) >= 6 and (near := sorted(w for w, _ in self.trie.near(word))):
            return near[0]
        return None


def _inside(part: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in part)


def read_unit(text: str, orgs: Words, units: Words) -> dict:
    """Parts of a typed affiliation: department phrase (marked or not), institution words, candidates for the place."""
    plain = fold(text).lower().replace("&", " and ")
    plain = re.sub(r"^\s*(?:\(?[a-z0-9]{1,2}\)|[*†‡§¶#]+|\d{1,3})\s*", "", plain)
    dept, marked, inst, spots = [], False, None, []
    loose: list[str] = []
    for seg in re.split(r"[,:;()\[\]]+", plain):
        words = _WORD.findall(seg)
        if not words:
            continue
        if any(units.find(w) for w in words[:3]):
            dept, marked = [w.replace("ph", "f") for w in words if not units.find(w) and w not in _SMALL and w != "from"], True
            continue
        read = [_SAME.get(o, o) for o in map(orgs.find, words)]
        if any(o in HEADS for o in read) and inst is None:
            inst = sorted({o for o in read if o})
            spots.append(" ".join(w for w, o in zip(words, read) if o is None and w not in _SMALL).replace("ph", "f"))
        else:
            loose.append(" ".join(w for w in words if w not in _SMALL).replace("ph", "f"))
    return {"dept": " ".join(dept), "marked": marked, "inst": " ".join(inst or []), "spots": [s for s in spots if s], "loose": [s for s in loose if s]}


NAME = "array<struct<surname:string,initials:array<string>,middle:string,given:array<string>,plain:boolean,turned:boolean>>"
UNIT_PARTS = "struct<dept:string,marked:boolean,inst:string,spots:array<string>,loose:array<string>>"


def _read_names(texts: pd.Series) -> pd.Series:
    known = Trie(sorted(_FORMAL))
    keys = ("surname", "initials", "middle", "given", "plain")
    both = lambda t: [dict(zip(keys, r)) | {"turned": way} for way in (False, True) if (r := read_name(t, known, way))]
    return pd.Series([both(t) for t in texts], dtype=object)


def _read_units(texts: pd.Series) -> pd.DataFrame:
    orgs, units = Words(ORG, FOREIGN), Words(UNIT)
    return pd.DataFrame([read_unit(t, orgs, units) for t in texts], columns=["dept", "marked", "inst", "spots", "loose"])


def _counted(texts: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank strings with their rows, written down so that no filter moves a parser before the count, and dealt to tasks by their number."""
    rows = cut(texts.select(F.col(column).alias("name")).where(F.trim("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("rows")))
    return rows.repartition(tasks_for(rows, READ), "name")


def person_classes(names: DataFrame, column: str = "name") -> tuple[DataFrame, DataFrame]:
    """(members, links): name and class of every readable name; class, other and whether they are the same, for classes whose names mean one person.

    A class has the spellings with the same surname (misspellings undone), first initial, middle initials and full given name. Classes are
    linked if middle initials and full given names don't contradict each other (nicknames count as the name). A name with a
    nickname of several names, or of doubtful order, is a member of several classes.
    """
    read = cut(_counted(names, column).select("name", "rows", F.inline(F.pandas_udf(_read_names, NAME)("name"))))
    # of the two orders of a name without a sign the turned one counts if more names have its surname beyond doubt
    sure = read.where("plain").groupBy(F.col("surname").alias("_s")).agg(F.sum("rows").alias("sure"))
    read = read.join(sure, F.col("surname") == F.col("_s"), "left").withColumn("sure", F.coalesce("sure", F.lit(0))).drop("_s")
    straight = read.where("not turned and not plain").select(F.col("name").alias("_n"), F.col("sure").alias("_other"))
    turned = read.where("turned").join(straight, F.col("name") == F.col("_n")).where("sure > _other")
    read = read.where("not turned").join(turned.select(F.col("name").alias("_n")), F.col("name") == F.col("_n"), "left_anti").unionByName(turned.drop("_n", "_other"))
    read = cut(read.withColumn("initial", F.explode("initials")).drop("initials"))
    parts = cut(read.groupBy("initial", "surname").agg(F.sum("rows").alias("rows")))
    wrong = bases(parts, "initial", "surname", "rows", 1.0).select(F.col("kind").alias("initial"), F.col("text").alias("surname"), "base")
    base = read.join(wrong, ["initial", "surname"], "left").withColumn("base", F.coalesce("base", "surname"))
    told = ["initial", "base", "middle", "given"]
    members = cut(base.select("name", F.xxhash64(*told).alias("class"), *told))
    classes = members.select("class", *told).distinct()
    a, b = (classes.select("initial", "base", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "middle", "given")]) for x in "ab")
    empty = lambda c: F.size(c) == 0
    agree = (
        (F.col("class_a") <= F.col("class_b"))
        & ((F.col("middle_a") == "") | (F.col("middle_b") == "") | F.startswith("middle_a", "middle_b") | F.startswith("middle_b", "middle_a"))
        & (empty("given_a") | empty("given_b") | F.arrays_overlap("given_a", "given_b"))
    )
    links = a.join(b, ["initial", "base"]).where(agree).select(F.col("class_a").alias("class"), F.col("class_b").alias("other"))
    return members.select("name", "class").distinct(), cut(links.distinct())


def _pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(name_a, name_b) of the members of linked classes."""
    a, b = members.select("class", F.col("name").alias("_a")), members.select(F.col("class").alias("other"), F.col("name").alias("_b"))
    both = links.join(a, "class").join(b, "other").where("_a <> _b")
    return both.select(F.least("_a", "_b").alias("name_a"), F.greatest("_a", "_b").alias("name_b")).distinct()


def linked(members: DataFrame, links: DataFrame) -> DataFrame:
    """name, class, links: every name with its class and the number of names of linked classes, counted by classes and not by pairs."""
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    both = links.unionAll(links.where("class <> other").select(F.col("other").alias("class"), F.col("class").alias("other")))
    around = both.join(size.withColumnRenamed("class", "other"), "other").groupBy("class").agg((F.sum("n") - 1).alias("links"))
    return members.join(around, "class").select("name", "class", "links")


def person_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """Pairs (name_a, name_b), name_a < name_b, of different spellings of one person: the members of linked ``person_classes``.

    Null, blank and unreadable names (no surname, or no given name) have no pair; repeated names count once;
    names that agree with several persons are linked with each.
    """
    return _pairs(*person_classes(names, column))


def unit_classes(units: DataFrame, column: str = "name") -> DataFrame:
    """name and class of spellings of departments of institutions.

    Units are equal if department, kind of institution and place are, after abbreviations are completed with the
    departments of the table and misspellings undone. Country, postal code and footnote marks don't count. Null
    and blank values and those without institution or department have no class; repeated values count once.
    """
    read = cut(_counted(units, column).select("name", "rows", F.pandas_udf(_read_units, UNIT_PARTS)("name").alias("p")).select("name", "rows", "p.*").where("inst <> ''"))
    listed = read.where("marked and dept <> ''").groupBy(F.col("dept").alias("phrase")).agg(F.sum("rows").alias("n"))
    spots = read.select("rows", F.explode(F.concat("spots", "loose")).alias("spot")).groupBy("spot").agg(F.sum("rows").alias("n"))
    words = cut(listed.select(F.lit("dept").alias("kind"), F.col("phrase").alias("t"), "n").unionByName(spots.select(F.lit("spot").alias("kind"), F.col("spot").alias("t"), "n")))
    fixed = bases(words, "kind", "t", "n", 2.0)
    dept_fix, spot_fix = (fixed.where(F.col("kind") == k).select(F.col("text").alias(f"{k}_was"), F.col("base").alias(f"{k}_is")) for k in ("dept", "spot"))
    # an abbreviated phrase stands for the one listed phrase with the same first letters of its words
    stems = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.left(w, F.lit(3))), " ")
    sure = listed.join(dept_fix, F.col("phrase") == F.col("dept_was"), "left_anti")
    full = sure.groupBy(stems("phrase").alias("stem")).agg(F.max_by("phrase", F.struct("n", "phrase")).alias("full"))
    # the department: marked, or the first loose segment that is a listed phrase
    own = read.select("name", "inst", "spots", "loose", F.posexplode(F.when(F.col("marked"), F.array("dept")).otherwise(F.col("loose"))).alias("at", "dept"), "marked")
    own = own.join(dept_fix, F.col("dept") == F.col("dept_was"), "left").withColumn("dept", F.coalesce("dept_is", "dept"))
    own = own.join(full, stems("dept") == F.col("stem"), "left").withColumn("dept", F.coalesce("full", F.when(F.col("marked"), F.col("dept")))).where("dept <> ''")
    own = own.groupBy("name").agg(F.min_by(F.struct("inst", "spots", "loose", "dept"), "at").alias("u")).select("name", "u.*")
    # the place: the segment of the institution, else the first loose one; of several spellings the most frequent
    usable = F.when(F.size("spots") > 0, F.col("spots")).otherwise(F.filter("loose", lambda s: stems(s) != stems(F.col("dept"))))
    place = own.select("name", "inst", "dept", F.get(usable, F.lit(0)).alias("spot")).where("spot <> ''")
    place = place.join(spot_fix, F.col("spot") == F.col("spot_was"), "left").withColumn("spot", F.coalesce("spot_is", "spot"))
    return cut(place.select("name", F.xxhash64("inst", "dept", "spot").alias("class")).distinct())


def unit_pairs(units: DataFrame, column: str = "name") -> DataFrame:
    """Pairs (name_a, name_b), name_a < name_b, of different spellings of one department of one institution: the members of one of ``unit_classes``."""
    members = unit_classes(units, column)
    return _pairs(members, members.select("class", F.col("class").alias("other")).distinct())


def variant_pairs(refs: DataFrame) -> DataFrame:
    """kind (author or affiliation), name_a, name_b over the authors of refs."""
    who = refs.select(F.explode("authors").alias("a")).select("a.author", "a.affiliation")
    people = person_pairs(who.select(F.col("author").alias("name"))).select(F.lit("author").alias("kind"), "name_a", "name_b")
    units = unit_pairs(who.select(F.explode("affiliation").alias("name"))).select(F.lit("affiliation").alias("kind"), "name_a", "name_b")
    return people.unionByName(units)
