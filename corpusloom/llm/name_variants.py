"""Variant spellings of names typed by people: metric-space partitioning.

Each spelling is read into its kind, its metric key (a surname, or an organisation's words with abbreviations written out) and
its given name. Keys are assigned to the nearest of some pivots; a key near a cell's border also goes to the cells that the
triangle inequality can't rule out, so every two keys within the radius meet in a cell. Inside a cell the radius join under
Levenshtein's metric is an equality join on pieces: of radius + 1 pieces of a key one at least is left whole by so many edits.
Given names and initials then decide which of the near spellings are one person.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Short forms of given names, words that name organisations, their abbreviations, and words that may be left out.
NICKNAMES = {
    "al": "albert alan alfred", "andy": "andrew", "art": "arthur", "barb": "barbara", "ben": "benjamin", "bert": "albert herbert robert",
    "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert",
    "cathy": "catherine katherine", "charlie": "charles", "chris": "christopher christine", "chuck": "charles", "cindy": "cynthia",
    "dan": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "don": "donald", "donny": "donald", "dot": "dorothy", "doug": "douglas",
    "ed": "edward edmund edwin", "eddie": "edward", "ernie": "ernest", "frank": "francis franklin", "fred": "frederick alfred", "fritz": "frederick friedrich",
    "gene": "eugene", "gerry": "gerald gerard", "ginny": "virginia", "greg": "gregory", "gus": "augustus gustav", "hal": "harold henry",
    "hank": "henry", "harry": "harold henry harrison", "jack": "john jackson", "jerry": "gerald jerome jeremiah", "jeff": "jeffrey", "jenny": "jennifer",
    "jim": "james", "jimmy": "james", "joe": "joseph", "johnny": "john", "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth",
    "larry": "lawrence", "len": "leonard", "liz": "elizabeth", "lou": "louis louise", "maggie": "margaret", "marty": "martin", "matt": "matthew",
    "meg": "margaret", "mick": "michael", "mike": "michael", "nacho": "ignacio", "nancy": "anne", "nick": "nicholas", "ollie": "oliver",
    "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", "polly": "mary", "ray": "raymond",
    "rick": "richard", "rob": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander sandra", "steve": "steven stephen",
    "sue": "susan", "susie": "susan", "ted": "edward theodore", "terry": "terence theresa", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
    "trudy": "gertrude", "uli": "ulrich", "val": "valerie valentine", "vic": "victor victoria", "vicky": "victoria", "vince": "vincent", "wally": "walter",
    "walt": "walter", "will": "william", "yvie": "yvonne", "zach": "zachary", "zack": "zachary",
}
ABBREVIATIONS = {
    "acad": "academy", "adv": "advertising", "agcy": "agency", "assn": "association", "assoc": "associates", "assocs": "associates", "attys": "attorneys",
    "bcasting": "broadcasting", "bd": "board", "bk": "bank", "bros": "brothers", "broadcstg": "broadcasting", "chem": "chemistry", "cig": "cigarette", "cncl": "council", "co": "company", "coll": "college", "comm": "committee", "conslt": "consulting", "consult": "consulting", "corp": "corporation",
    "ctr": "center", "dept": "department", "dist": "distribution", "distrib": "distribution", "div": "division", "grp": "group", "hosp": "hospital",
    "inc": "incorporated", "ind": "industries", "inds": "industries", "inst": "institute", "intl": "international", "lab": "laboratories", "labs": "laboratories",
    "ltd": "limited", "mach": "machine", "mfg": "manufacturing", "mkt": "marketing", "mktg": "marketing", "natl": "national", "org": "organization", "pkg": "packaging", "res": "research",
    "soc": "society", "svy": "survey", "tob": "tobacco", "univ": "university", "wks": "works",
}
ORGANISATION = set(ABBREVIATIONS) | set(ABBREVIATIONS.values()) | {"bank", "growers", "works", "firm", "council", "survey", "trust", "union", "ministry", "office", "bureau"}
LEFT_OUT = {"the", "of", "for", "and", "a"}
_STRAIGHT = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "’": "'", "‘": "'", "&": " and ", "+": " and "})
_TITLE = re.compile(r"^(?:(?:dr|mr|mrs|ms|prof|miss|sir)\b\.?\s+)+", re.I)
_SUFFIX = re.compile(r",?\s+(?:jr|sr|ii|iii|iv|m\.d\.|ph\.?d|esq)\.?$", re.I)


def plain(name: str) -> str:
    """Without accents, with single blanks and straight marks; letter case is kept."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", name.translate(_STRAIGHT)) if not unicodedata.combining(c))
    return " ".join(bare.split())


def one_edit(a: str, b: str) -> bool:
    """Whether at most one letter is added, dropped, changed or swapped with the next."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def read_name(name: str) -> tuple[str, str, list[str], list[str], str | None]:
    """(kind, key, first initials, given names, middle initial) of a spelling; kind is ``person`` or ``organisation``."""
    text = plain(name)
    words = re.findall(r"[a-z0-9']+", text.lower())
    long = [w for w in words if len(w) > 5]
    if any(w in ORGANISATION or w in ("and", "of", "the", "for") for w in words) or len([w for w in words if len(w) > 2]) > 3 or any(one_edit(w, o) for w in long for o in ORGANISATION if len(o) > 5):
        front = text.lower().split(",")
        if len(front) > 1:  # parts in another order: what follows the last comma came first, unless the comma is one of a list
            lead = front[-1].split()
            before = re.findall(r"[a-z0-9']+", front[-2])
            if " and " not in front[-1] or before and before[-1] in ORGANISATION:
                words = re.findall(r"[a-z0-9']+", " ".join([*lead, *front[:-1]]))
        return "organisation", " ".join(ABBREVIATIONS.get(w, w) for w in words if w not in LEFT_OUT), [], [], None
    text = _TITLE.sub("", text)
    bare = _SUFFIX.sub("", text)
    if len(bare.replace(",", " ").split()) > 1:  # else what looks like a suffix are initials
        text = bare
    if m := re.match(r"^([^,]+?)\s*,\s*(.+)$", text):
        last, rest = m[1], m[2]
    elif ((m := re.match(r"^(\S+)\s*-\s*([^\W\d_]{1,3})$", text)) or (m := re.match(r"^(\S{3,}) ([^\W\d_]{1,3})$", text))) and m[2].isupper():
        last, rest = m[1], m[2]
    else:
        rest, _, last = text.rpartition(" ")
    parts = re.findall(r"(?:[^\W\d_]|')+\.?", rest)
    if len(parts) == 1 and len(parts[0]) < 4 and parts[0].isalpha() and parts[0].isupper():
        parts = list(parts[0])
    first = parts[0].lower() if parts else ""
    middle = parts[1][0].lower() if len(parts) > 1 else None
    key = re.sub(r"[^\w']|[\d_]", "", last.lower())
    if not first:
        return "person", key, [], [], None
    bare = first.rstrip(".")
    if len(bare) == 1 or first.endswith("."):
        return "person", key, [bare[0]], [], middle
    given = NICKNAMES.get(bare, "").split() or [bare]
    return "person", key, sorted({g[0] for g in given}), given, middle


def pieces(size: int, n: int) -> list[tuple[int, int]]:
    """(start, length) of n even pieces of a word."""
    cuts = [size * k // n for k in range(n + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]


def probes(word: str, radius: int) -> Iterator[tuple[int, int, str]]:
    """(length, piece, text): where a key of this length or up to ``radius`` shorter within the radius of the word must hold one of its
    pieces. A piece moves no further than the edits before it or behind it allow."""
    for size in range(max(len(word) - radius, 0), len(word) + 1):
        shift = len(word) - size
        for i, (start, length) in enumerate(pieces(size, radius + 1)):
            low = max(0, start - i, start + shift - (radius - i))
            high = min(len(word) - length, start + i, start + shift + (radius - i))
            for at in range(low, high + 1):
                yield size, i, word[at : at + length]


def near_keys(keys: DataFrame, radius: int = 2, pivots: int = 4) -> DataFrame:
    """(kind, key, other, d) for every two keys of a kind within the radius of each other, both ways, and each with itself.

    Pivots are a bounded sample of the keys, taken by hash; which and how many they are changes the work, never the result. A key
    gives radius + 1 rows to its own cell and its probes to each of at most ``pivots`` cells, so rows grow in proportion to the keys;
    no cell compares all its keys with each other, whatever its size.
    """
    distinct = durable(keys.select("kind", "key").distinct())
    chosen = [r[0] for r in distinct.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(pivots).collect()] or [""]
    placed = distinct.withColumn("ds", F.transform(F.array(*map(F.lit, chosen)), lambda p: F.levenshtein(F.col("key"), p))).withColumn("least", F.array_min("ds"))
    home = placed.select("kind", "key", (F.array_position("ds", F.col("least")) - 1).cast("int").alias("cell"))
    near = F.filter(F.transform("ds", lambda d, i: F.when(d <= F.col("least") + 2 * radius, i)), lambda i: i.isNotNull())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(kind, c, len(k), i, k[x : x + n], k) for kind, k, c in zip(b["kind"], b["key"], b["cell"], strict=True) for i, (x, n) in enumerate(pieces(len(k), radius + 1))]
            yield pd.DataFrame(rows, columns=["kind", "cell", "size", "i", "piece", "key"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(kind, c, *p, k) for kind, k, cs in zip(b["kind"], b["key"], b["cells"], strict=True) for p in set(probes(k, radius)) for c in cs]
            yield pd.DataFrame(rows, columns=["kind", "cell", "size", "i", "piece", "other"])

    index = home.mapInPandas(cut, "kind string, cell int, size int, i int, piece string, key string")
    asked = placed.select("kind", "key", near.cast("array<int>").alias("cells")).mapInPandas(look, "kind string, cell int, size int, i int, piece string, other string")
    met = index.join(asked, ["kind", "cell", "size", "i", "piece"]).select("kind", "key", "other").distinct()
    close = durable(met.withColumn("d", F.levenshtein("key", "other", radius)).where("d >= 0"))
    back = close.where("key <> other").select("kind", F.col("other").alias("key"), F.col("key").alias("other"), "d")
    return close.unionByName(back).distinct()


def given_parts(given: list[list[str]]) -> list[int]:
    """The part of each list of given names: lists that share a name, or names one edit apart, are of one person; 0 is the first by
    order. An empty list (initials only) is of the only part, or of none (-1) where there are several."""
    lists = sorted({tuple(g) for g in given if len(g)})
    owner = list(range(len(lists)))

    def top(i: int) -> int:
        while owner[i] != i:
            i = owner[i]
        return i

    for i, x in enumerate(lists):
        for j in range(i):
            if any(a == b or min(len(a), len(b)) > 3 and one_edit(a, b) or a.startswith(b) or b.startswith(a) for a in x for b in lists[j]):
                owner[max(top(i), top(j))] = min(top(i), top(j))
    roots = sorted({top(i) for i in range(len(lists))})
    place = {g: roots.index(top(i)) for i, g in enumerate(lists)}
    return [place[tuple(g)] if len(g) else 0 if len(roots) < 2 else -1 for g in given]


def _parted(people: DataFrame) -> DataFrame:
    """Adds ``part`` to spellings (key, i, middle, given): those of one surname and initials whose given names agree. What is gathered
    for a group are its different lists of given names."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, i, middle, lists in zip(b["key"], b["i"], b["middle"], b["lists"], strict=True):
                lists = [list(x) for x in lists]
                rows += [(key, i, middle, x, part) for x, part in zip(lists, given_parts(lists), strict=True)]
            yield pd.DataFrame(rows, columns=["key", "i", "middle", "given", "part"])

    lists = people.groupBy("key", "i", "middle").agg(F.sort_array(F.collect_set("given")).alias("lists"))
    numbered = lists.mapInPandas(number, "key string, i string, middle string, given array<string>, part int")
    return people.join(numbered, ["key", "i", "middle", "given"])


def _heads(groups: DataFrame, ties: DataFrame, times: float) -> DataFrame:
    """(key, i, middle, part, head) of groups (key, i, middle, part, spellings, n, known): the group that a slip is a slip of, or itself.

    A group is a slip of a near one if that has, with one more than was seen, ``times`` its spellings or ``times`` squared its rows, and
    their given names don't contradict; of several the strongest. Slips of slips are followed to the end: heads only grow stronger, so no chain closes.
    """
    name = F.concat_ws("|", "key", "i", "middle", F.col("part").cast("string"))
    own = durable(groups.withColumn("g", name))
    mates = ties.where("d > 0").join(own.select(F.col("key").alias("other"), "i", "middle", F.col("g").alias("to"), F.col("spellings").alias("s2"), F.col("n").alias("n2"), F.col("known").alias("k2")), "other")
    met = own.join(mates, ["key", "i", "middle"])
    agree = (F.size("known") == 0) | (F.size("k2") == 0) | F.arrays_overlap("known", "k2")
    stronger = (F.struct("s2", "n2", "to") > F.struct("spellings", "n", "g")) & ((F.col("s2") + 1 >= F.col("spellings") * times) | (F.col("n2") + 1 >= F.col("n") * times * times))
    best = met.where(agree & stronger).groupBy("g").agg(F.max(F.struct("s2", "n2", "to")).alias("b")).select("g", F.col("b.to").alias("head"))
    links = durable(best)
    while True:
        onward = links.join(links.select(F.col("g").alias("head"), F.col("head").alias("next")), "head", "left")
        links = durable(onward.select("g", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("moved")))
        moved = not links.where("moved").isEmpty()
        links = links.drop("moved")
        if not moved:
            break
    return own.join(links, "g", "left").select("key", "i", "middle", "part", F.coalesce("head", "g").alias("head"))


def _groups(people: DataFrame) -> DataFrame:
    return people.groupBy("key", "i", "middle", "part").agg(F.count("*").alias("spellings"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("given"))).alias("known"))


def entities(names: DataFrame, radius: int = 2, times: float = 2.0) -> DataFrame:
    """(name, entity) of every distinct non-blank spelling in ``names.name``; spellings of one entity have an equal ``entity``.

    Organisations are one if their keys are within the radius (one edit for short keys), each linked to the strongest near key and so
    on to the end. Persons are one if their initials agree, their given names don't contradict, and their surnames are equal or one edit apart with the
    other ``times`` as strong, as a slip has it. A spelling without a middle initial goes to the only such person;
    the surname's closeness and then the given name decide between several, and where they can't it stays with its likes: the
    spellings of its surname and initial, slips included. Repeated rows count once; null and blank names give no row; other columns aren't read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_name(n) for n in b["name"]]
            yield pd.DataFrame({"name": b["name"], "n": b["n"], "kind": [g[0] for g in got], "key": [g[1] for g in got], "first": [g[2] for g in got], "given": [g[3] for g in got], "middle": [g[4] for g in got]})

    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spelled = names.where("trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n")).repartition(parts, "name")
    parsed = durable(spelled.mapInPandas(read, "name string, n bigint, kind string, key string, first array<string>, given array<string>, middle string"))
    near = near_keys(parsed, radius)
    swapped = F.expr("d = 2 and length(key) = length(other) and array_sort(split(key, '')) = array_sort(split(other, ''))")
    typo = durable(near.where((F.col("d") <= 1) & (F.length("key") > 3) | swapped | (F.col("d") == 0) | (F.col("kind") == "organisation") & (F.length("key") > 12)))

    ties = typo.where("kind = 'person'").select("key", "other", "d")
    orgs = parsed.where("kind = 'organisation'")
    size = durable(orgs.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("n").alias("n")))
    near_orgs = typo.where("kind = 'organisation'").join(size.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.max(F.struct("spellings", "n", "other")).alias("b"))
    heads = durable(near_orgs.select("key", F.col("b.other").alias("head")))
    while True:
        onward = heads.join(heads.select(F.col("key").alias("head"), F.col("head").alias("next")), "head", "left")
        heads = durable(onward.select("key", F.coalesce("next", "head").alias("head"), (F.coalesce("next", "head") != F.col("head")).alias("moved")))
        moved = not heads.where("moved").isEmpty()
        heads = heads.drop("moved")
        if not moved:
            break
    of_orgs = orgs.join(heads, "key").select("name", F.concat(F.lit("o:"), "head").alias("entity"))

    people = parsed.where("kind = 'person'").withColumn("i", F.when(F.size("first") == 1, F.get("first", F.lit(0))))
    full = durable(_parted(people.where("middle is not null and i is not null").select("name", "n", "key", "i", "middle", "given")))
    sure = durable(_groups(full))
    person = durable(_heads(sure, ties, times).withColumn("entity", F.concat(F.lit("p:"), "head")))
    of_full = full.join(person, ["key", "i", "middle", "part"]).select("name", "entity")

    rest = people.where("middle is null or i is null").select("name", "n", "key", "first", "given", "middle")
    options = rest.select("name", "key", F.explode_outer("first").alias("i"), "given", F.col("middle").alias("mine"))
    known = sure.join(person, ["key", "i", "middle", "part"]).select(F.col("key").alias("other"), "i", "middle", "known", "entity")
    fits = options.join(ties, "key").join(known, ["other", "i"]).where("mine is null or mine = middle")
    rank = F.struct("d", F.when(F.arrays_overlap("given", "known"), 0).when((F.size("given") == 0) | (F.size("known") == 0), 1).otherwise(2).alias("g"))
    ranked = fits.withColumn("r", rank).groupBy("name", "entity").agg(F.min("r").alias("r"))
    best = ranked.groupBy("name").agg(F.min("r").alias("best"))
    only = ranked.join(best, "name").where("r = best").groupBy("name").agg(F.count("*").alias("k"), F.min("entity").alias("entity")).where("k = 1").select("name", "entity")
    only = durable(only)

    alone = rest.join(only, "name", "left_anti").withColumn("middle", F.coalesce("middle", F.lit("")))
    each = durable(_parted(alone.select("name", "n", "key", F.explode_outer("first").alias("i"), "middle", "given").withColumn("i", F.coalesce("i", F.lit("")))))
    groups = durable(_groups(each))
    likes = _heads(groups, ties, times)
    # a short form of several names goes where most spellings of one of them are
    strength = each.join(groups.select("key", "i", "middle", "part", "spellings", F.col("n").alias("rows")), ["key", "i", "middle", "part"]).join(likes, ["key", "i", "middle", "part"])
    pick = strength.groupBy("name").agg(F.max(F.struct("spellings", "rows", "head")).alias("b"))
    of_alone = pick.select("name", F.concat(F.lit("q:"), "b.head").alias("entity"))
    return of_orgs.unionByName(of_full).unionByName(only).unionByName(of_alone)


def variant_pairs(names: DataFrame, radius: int = 2) -> DataFrame:
    """(name_a, name_b), a < b by code point: every two different spellings of one entity."""
    found = durable(entities(names, radius))
    a, b = found.select("entity", F.col("name").alias("name_a")), found.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
