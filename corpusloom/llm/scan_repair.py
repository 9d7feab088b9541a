"""Noise in text from scanned pages: continuous readable paragraphs from raw pages.

Lines that only furnish the page (running heads and feet, page numbers, stamps) are told from body lines. The body lines of a
page, with the word that runs over to the next page, form one stream of characters without line ends. A lattice over that
stream has an arc for every word as it stands, every word behind confused characters, every two words that ran together
(each perhaps confused too), every word that stray blanks or a line-end hyphen cut, and every two words that stand beside
each other; frequencies of words and of neighbours in the corpus weigh them, and a Viterbi search decides them together.
Damaged lines are read off the best path. Paragraphs are the partition of a page's lines of least cost, by dynamic programming.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..operators.corpus import numbered
from ..session import durable

#: What a character or pair is misread as by scanners.
CONFUSIONS = {
    "a": ["o", "e", "@"], "b": ["h", "8", "6"], "c": ["e", "o"], "d": ["cl"], "e": ["c", "o"], "f": ["t"], "g": ["q", "9"], "h": ["b", "li"], "i": ["1", "l", "|", "j"],
    "l": ["1", "i", "|", "I"], "m": ["rn", "nn"], "n": ["ri"], "o": ["0", "c"], "q": ["g"], "r": ["i"], "s": ["5", "8"], "t": ["f"], "u": ["ii", "v"], "v": ["y"], "w": ["vv"],
    "y": ["v"], "z": ["2"], "rn": ["m"], "cl": ["d"], "ri": ["n"], "ii": ["u"], "ll": ["u"], "vv": ["w"], "nn": ["m"],
}
HYPHENS = "-¬­‐"
#: The classes of all confusions closed under each other; "d" is one of the first class and a stroke, as "cl" is.
_CLASSES = {"c": "aeo0@", "i": "l1|jrnmuvywbh86s5", "g": "q9", "t": "f", "z": "2"}
_CLOSED = str.maketrans({**{c: k for k, cs in _CLASSES.items() for c in cs}, "d": "ci"})
_STROKES = re.compile("i+")
_COUNT = r"(?:(?:page|pg|p)\.?\s*)?\d{1,5}(?:\s*(?:/|of)\s*\d{1,5})?|[ivxlc]{1,8}"
_NUMBER = re.compile(rf"^(?:{_COUNT}|-+\s*(?:{_COUNT})\s*-+|[—–]\s*(?:{_COUNT})\s*[—–]|\[\s*(?:{_COUNT})\s*\]|\(\s*(?:{_COUNT})\s*\)|\d{{6,10}})$", re.IGNORECASE)
_STAMP = re.compile(r"^[A-Z]{1,5}[ -]?\d{5,12}$")
_WORD = re.compile(r"\|?[^\W_]+(?:[|'’]+[^\W_]+)*")
_COMPOUNDS = re.compile(rf"{_WORD.pattern}(?:-{_WORD.pattern})*")
_LINE_END = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][^\S\n]*\n[^\S\n]*(?=[^\W_])")
_ENDS = re.compile(rf"([^\W\d_])[{HYPHENS}]\s*$")
_CUT, _OPEN = re.compile(rf"[{HYPHENS}][^\S\n]*(?:\n\s*)+"), re.compile(rf"[{HYPHENS}]\s*$")
_BLANK = (" ", "\n")
_FIGURE_AMONG = re.compile(r"[\d|]")
_CODE = re.compile(r"\d+(?:st|nd|rd|th|s|mm|cm|kg|g|m|x)|[a-z]\d+")
_STOP = re.compile(r"[.!?][\"')]*$")
#: Log-odds of the noisy channel: a word with one confusion and each further one, a confusion that leads one way only, words
#: that ran together, a stray blank, a compound that breaks at its own hyphen without being known, a hyphen that is a dash.
_CONFUSED, _FURTHER, _ONE_WAY, _MERGED, _TORN, _COMPOUND, _DASH = -math.log(4), -0.2, math.log(2), -math.log(10), -math.log(10), -3.0, -14.0


def skeleton(word: str) -> str:
    """Equal for words that confusions can turn into each other, in one step or many: each letter as its class, and a run of what is
    made of strokes as one stroke, since m, nn, rn, h, li, u, ii and v lead to each other whatever their number."""
    return _STROKES.sub("i", word.lower().translate(_CLOSED))


def prefix_skeletons(word: str) -> tuple[list[str], list[str]]:
    """The skeletons of ``word[:k]`` and of ``word[k:]`` for every k."""
    classes = [c.translate(_CLOSED) for c in word.lower()]
    heads, tails = [""], [""]
    for c in classes:
        heads.append(heads[-1] + (c[0] if c[0] != "i" or heads[-1][-1:] != "i" else "") + c[1:])
    for c in reversed(classes):
        tails.append(c[:-1] + (c[-1] if c[-1] != "i" or tails[-1][:1] != "i" else "") + tails[-1])
    return heads, tails[::-1]


_ALONE, _FIGURE = re.compile(r"(?<![^\W_]|\|)[\d|]+(?![^\W_]|\|)"), re.compile(r"[\d|]")
#: Marks and blanks of ASCII go; letters and figures become their classes, "d" a mark of its own until it is written out.
_KEY = str.maketrans({**{chr(k): None for k in range(128) if not chr(k).isalnum() and chr(k) not in "|@"}, **{c.upper(): k for k, cs in _CLASSES.items() for c in cs}, **{c: k for k, cs in _CLASSES.items() for c in cs},
                      **{c.upper(): c for c in "cikpxgtz"}, "d": "D"})


def line_key(line: str) -> int:
    """A fingerprint of a line's skeleton, 0 without letters; figures that stand on their own are left out, as page numbers change."""
    if _FIGURE.search(line):
        line = _ALONE.sub("", line)
    if not line.isascii():
        line = re.sub(r"\W", "", line).lower()
    bare = _STROKES.sub("i", line.translate(_KEY).replace("D", "ci"))
    return int.from_bytes(hashlib.blake2b(bare.encode(), digest_size=8).digest(), "big", signed=True) if bare else 0


#: What the first and the last character of a word can be read as.
_FIRST = {c: {c} | {w[0] for k, ws in CONFUSIONS.items() if k[0] == c for w in ws} for c in {k[0] for k in CONFUSIONS}}
_LAST = {c: {c} | {w[-1] for k, ws in CONFUSIONS.items() if k[-1] == c for w in ws} for c in {k[-1] for k in CONFUSIONS}}


def confused(true: str, seen: str) -> int | None:
    """The least number of confusions that turn ``true`` into ``seen``; None if none do."""
    if not true or not seen:
        return 0 if true == seen else None
    if seen[0] not in _FIRST.get(true[0], true[0]) or seen[-1] not in _LAST.get(true[-1], true[-1]):
        return None
    now: dict[int, int] = {0: 0}
    ahead: dict[int, int] = {}
    for i, c in enumerate(true):
        later: dict[int, int] = {}
        single, double = CONFUSIONS.get(c, ()), CONFUSIONS.get(true[i : i + 2], ())
        for j, cost in now.items():
            if seen.startswith(c, j):
                ahead[j + 1] = min(ahead.get(j + 1, 99), cost)
            for wrong in single:
                if seen.startswith(wrong, j):
                    k = j + len(wrong)
                    ahead[k] = min(ahead.get(k, 99), cost + 1)
            for wrong in double if i + 1 < len(true) else ():
                if seen.startswith(wrong, j):
                    k = j + len(wrong)
                    later[k] = min(later.get(k, 99), cost + 1)
        now, ahead = ahead, later
        if not now and not ahead:
            return None
    return now.get(len(seen))


def lines_of(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


def is_number(line: str) -> bool:
    text = line.strip()
    return bool(text) and bool(_NUMBER.match(text) or _STAMP.match(text))


def mixed_figures(word: str) -> bool:
    """Figures or bars among small letters, which no word or code has."""
    return bool(_FIGURE_AMONG.search(word)) and word.upper() != word and not _CODE.fullmatch(word.lower())


def kinds_of(lines: list[str], recurring: set[int]) -> list[str]:
    """``header``, ``number``, ``body`` or empty for each line. ``recurring`` are the numbers of lines (from 1) that recur on pages
    of the document; they are furniture if nothing but furniture lies between them and the page's edge, however many they are.
    A page of nothing else keeps those that end a sentence as its body."""
    kinds = ["" if not x.strip() else "number" if is_number(x) else "body" for x in lines]
    for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        for k in order:
            if kinds[k] == "body":
                if k + 1 not in recurring:
                    break
                kinds[k] = "header"
    if "body" not in kinds:
        kinds = ["body" if kind == "header" and _STOP.search(x.rstrip()) else kind for kind, x in zip(kinds, lines, strict=True)]
    return kinds


class Stream:
    """The runs of word characters of a page's body in order: ``texts``, the ``lines`` they stand on (0 for what stands on the next
    page), the ``gaps`` before each and behind the last (line ends as such), and ``cut``, those that a line-end hyphen joins to the one before."""

    __slots__ = ("cut", "gaps", "lines", "texts")

    def __init__(self, body: str, numbers: list[int], following: str | None = None, runs_on: bool = False):
        """A line that ends in a letter and a hyphen runs on in the next line of body. With ``runs_on`` the last one does in
        ``following``, the first run of the next page, or in nothing if that is unknown."""
        self.texts, self.gaps = _WORD.findall(body), _WORD.split(body)
        self.lines, self.cut = [], set()
        at = 0
        for k in [k for k, gap in enumerate(self.gaps) if "\n" in gap]:
            gap = self.gaps[k]
            self.lines += [numbers[at]] * (k - len(self.lines))
            at += gap.count("\n")
            if k and gap[0] in HYPHENS and k < len(self.texts) and _CUT.fullmatch(gap) and self.texts[k - 1][-1].isalpha():
                self.cut.add(k)
        self.lines += [numbers[at]] * (len(self.texts) - len(self.lines)) if self.texts else []
        if runs_on and self.texts and _OPEN.match(self.gaps[-1]):
            self.cut.add(len(self.texts))
            self.texts.append(following or "")
            self.lines.append(0)
            self.gaps.append("")


class Lexicon:
    """Counts of words and of neighbours, and the best reading of any form by itself, found once and kept."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], total: float, rare: float):
        self.words, self.pairs, self.total = words, pairs, max(total, 1.0)
        self.least = max(rare / 2, 0.5)
        self.groups: dict[str, list[tuple[int, str]]] = {}
        for w, n in words.items():
            if not (mixed_figures(w) or w.isdigit() or "-" in w):
                self.groups.setdefault(skeleton(w), []).append((n, w))
        for g in self.groups.values():
            g.sort(key=lambda x: (-x[0], x[1]))
        self.known: dict[str, tuple[float, tuple[str, ...], bool]] = {}
        self.plain: set[str] = set()

    def stands(self, form: str) -> float:
        """Log-probability of a form as a word of its own."""
        return math.log(self.words.get(form, self.least) / self.total)

    def beside(self, a: str, b: str) -> float:
        """Log-probability of two words beside each other: by their own count, or by chance if that is more."""
        chance = self.words.get(a, self.least) * self.words.get(b, self.least) / self.total
        return math.log(max(self.pairs.get((a, b), 0), chance) / self.total)

    def single(self, form: str, least: float = -math.inf) -> tuple[float, str]:
        """(score, word) of the best word behind a form's confused characters, if it scores more than ``least``."""
        best = (least, form)
        if len(form) < 2 or form.isdigit():
            return best
        figures = mixed_figures(form)
        for n, w in self.groups.get(skeleton(form), ()):
            top = math.log(n / self.total) + _CONFUSED + _ONE_WAY
            if top <= best[0]:
                break
            if w != form and (steps := confused(w, form)) is not None:
                score = top + _FURTHER * (steps - 1) - (0.0 if figures or confused(form, w) is None else _ONE_WAY)
                if score > best[0]:
                    best = (score, w)
        return best

    def read(self, form: str) -> tuple[float, tuple[str, ...], bool]:
        """(score, words, misread) of the best path through a form's own lattice: as it stands, confused, or run together."""
        got = self.known.get(form)
        if got is None:
            got = self.known[form] = self._read(form)
        return got

    def stands_alone(self, form: str) -> bool:
        """Whether a form is a known word that nothing else explains better, and holds no figures among its letters."""
        score, words, misread = self.read(form)
        sure = form in self.words and not misread and words == (form,) and (form.isdigit() or not _FIGURE_AMONG.search(form) or bool(_CODE.fullmatch(form)))
        if sure:
            self.plain.add(form)
        return sure

    def _read(self, form: str) -> tuple[float, tuple[str, ...], bool]:
        best = (self.stands(form), (form,), False)
        score, word = self.single(form, best[0])
        if score > best[0]:
            best = (score, (word,), True)
        if not 5 <= len(form) <= 80 or "'" in form or form.isdigit():
            return best
        heads, tails = prefix_skeletons(form)
        for k in range(2, len(form) - 1):
            a, b = form[:k], form[k:]
            if a in self.words and b in self.words:
                score = self.beside(a, b) + _MERGED
                if (a, b) in self.pairs or not (_FIGURE_AMONG.search(a) or _FIGURE_AMONG.search(b)):
                    joint = f"{a}-{b}"
                    if self.words.get(joint, 0) and self.stands(joint) + _MERGED > max(score, best[0]):
                        best = (self.stands(joint) + _MERGED, (joint,), False)
                    elif score > best[0]:
                        best = (score, (a, b), False)
                continue
            tops = [self.groups.get(heads[k]), self.groups.get(tails[k])]
            if None in tops or sum(math.log(t[0][0] / self.total) for t in tops) + _MERGED + _CONFUSED <= best[0]:
                continue
            parts = [(self.stands(x), x) if x in self.words else self.single(x) for x in (a, b)]
            score = sum(p[0] for p in parts) + _MERGED
            if score > best[0]:
                best = (score, (parts[0][1], parts[1][1]), True)
        return best


#: An arc of the best path: (first atom, number of atoms, words, misread, kind), kind being word, cut, compound, torn or apart.
#: An atom is a run of word characters of the stream.
Arc = tuple[int, int, tuple[str, ...], bool, str]


def decode(run: Stream, lexicon: Lexicon) -> list[Arc]:
    """The arcs of the best path through the stream, but those of single atoms that stand as they are.

    Word, confusion and merge arcs lie over one atom, those of blanks and hyphens over two or three. Atoms that nothing but their
    own word arc touches are on every path, so the search runs through the stretches between them.
    """
    gaps, cut, plain, words = run.gaps, run.cut, lexicon.plain, lexicon.words
    forms = [t.lower() for t in run.texts]
    n = len(forms)
    odd = {i for i, f in enumerate(forms) if f not in plain and not lexicon.stands_alone(f)}
    spans = {i - 1 for i in cut} | {i for i, ab in enumerate(map(str.__add__, forms, forms[1:])) if ab in words and gaps[i + 1] in _BLANK}
    spans |= {k for i in odd for k in (i - 1, i) if 0 <= k < n - 1 and gaps[k + 1] in _BLANK}
    stretch = sorted(odd | {k for i in spans for k in (i, i + 1, i + 2) if k < n})
    path: list[Arc] = []
    at = 0
    while at < len(stretch):
        end = at + 1
        while end < len(stretch) and stretch[end] == stretch[end - 1] + 1:
            end += 1
        first, last = stretch[at], stretch[end - 1] + 1
        at = end
        best: list[float] = [0.0] + [-math.inf] * (last - first)
        back: list[Arc | None] = [None] * (last - first + 1)
        for i in range(first, last):
            score, reading, misread = lexicon.read(forms[i])
            text = run.texts[i]
            if not misread and i in odd and _FIGURE_AMONG.search(text) and mixed_figures(text):
                misread = True  # no word or code stands like this, whatever it should be
            arcs = [(1, score + (_DASH if i in cut else 0.0), reading, misread, "word")]
            if i in spans:
                arcs += _arcs(i, last, forms, gaps, cut, odd, lexicon)
            for size, gain, *rest in arcs:
                if best[i - first] + gain > best[i - first + size]:
                    best[i - first + size], back[i - first + size] = best[i - first] + gain, (i, size, *rest)
        part, k = [], last - first
        while k:
            arc = back[k]
            if arc[1] > 1 or arc[3] or arc[2] != (forms[arc[0]],):
                part.append(arc)
            k -= arc[1]
        path.extend(reversed(part))
    return path


def _arcs(i: int, last: int, forms: list[str], gaps: list[str], cut: set[int], odd: set[int], lexicon: Lexicon) -> list[tuple]:
    """(atoms, score, words, misread, kind) of the arcs over two or three atoms from atom ``i``, before atom ``last``."""
    out = []
    joined, any_odd, torn = forms[i], i in odd, 0.0
    for j in (i + 1, i + 2):
        if j >= last or not (j in cut or gaps[j] in _BLANK and not forms[j].isdigit() and not forms[j - 1].isdigit()):
            break
        joined += forms[j]
        any_odd = any_odd or j in odd
        torn += 0.0 if j in cut else _TORN
        hyphen = any(k in cut for k in range(i + 1, j + 1))
        if torn == 0.0:  # hyphens only
            out.append((j - i + 1, *lexicon.read(joined), "cut"))
        else:
            apart = sum(lexicon.read(f)[0] for f in forms[i : j + 1]) - torn
            known = lexicon.stands(joined) if joined in lexicon.words else -math.inf
            score, word = lexicon.single(joined, max(known, apart)) if any_odd else (known, joined)
            if word != joined:
                out.append((j - i + 1, score + torn, (word,), True, "cut" if hyphen else "torn"))
            elif known > -math.inf:
                out.append((j - i + 1, known + torn, (joined,), False, "cut" if hyphen else "torn"))
        if j == i + 1 and hyphen:
            compound = f"{forms[i]}-{forms[j]}"
            if compound in lexicon.words:
                out.append((2, lexicon.stands(compound), (compound,), False, "compound"))
            else:
                a, b = lexicon.read(forms[i]), lexicon.read(forms[j])
                out.append((2, a[0] + b[0] + _COMPOUND, ("-".join(a[1] + b[1]),), a[2] or b[2], "compound"))
        elif j == i + 1 and (forms[i], forms[j]) in lexicon.pairs:
            out.append((2, lexicon.beside(forms[i], forms[j]), (forms[i], forms[j]), False, "apart"))
    return out


def misread_atoms(run: Stream, arc: Arc) -> list[int]:
    """The atoms of a misread arc that differ from its true words."""
    i, size, words, *_ = arc
    if size == 1:
        return [i]
    true = "".join(words).replace("-", "")
    part = [t.lower() for t in run.texts[i : i + size]]
    wrong = [not true.startswith(part[0]), *(x not in true for x in part[1:-1]), not true.endswith(part[-1])]
    return [i + k for k, w in enumerate(wrong) if w] or [i]


def like_case(word: str, model: str) -> str:
    letters = [c for c in model if c.isalpha()]
    if len(letters) > 1 and sum(c.isupper() for c in letters) > len(letters) / 2:
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() or model[:1] == "|" else word


def shown(run: Stream, arc: Arc) -> str:
    """An arc's words as they should be printed."""
    i, size, words, _, kind = arc
    part = run.texts[i : i + size]
    raw = "".join(part)
    if kind == "apart":
        return " ".join(part)
    if words == (raw.lower(),):
        return raw
    out, at = [], 0
    for w in words:  # each word after the case of the stretch it stands for
        out.append(like_case(w, raw[at : at + len(w)] or raw))
        at += len(w)
    return " ".join(out)


def paragraphs(lines: list[str]) -> list[tuple[int, int]]:
    """[first, last) of every paragraph over the non-blank lines of ``lines``, counted in lines that aren't blank.

    The partition of least cost. A paragraph pays for starting (less behind a blank line or at an indent, more within a sentence
    or a cut word), for blank lines within it, and for every line but its last that falls short of the paragraph's own measure, its
    longest line; so whether a line ends a paragraph depends on all the lines that it would share one with.
    """
    full = [k for k, x in enumerate(lines) if x.strip()]
    n = len(full)
    if not n:
        return []
    text = [lines[k].rstrip() for k in full]
    lead = np.array([len(x) - len(x.lstrip()) for x in text])
    width = np.array([len(x) for x in text], float)
    blank = np.array([0.0] + [float(b - a > 1) for a, b in zip(full, full[1:], strict=False)])
    stop = [bool(_STOP.search(x)) for x in text]
    start = np.zeros(n)
    for k in range(1, n):
        word = text[k].lstrip()[:1]
        within = -0.5 if stop[k - 1] else 3.0
        indent = lead[k] - lead[k - 1] >= 2
        start[k] = 2.0 + within + 2.0 * (not (word.isupper() or not word.isalpha())) - 2.0 * indent + 6.0 * bool(_ENDS.search(text[k - 1]))
    inner = np.concatenate([[0.0], np.cumsum(4.0 * blank)])  # blank lines before line k
    weight = np.where(stop, 16.0, 6.0)  # a short line that ends a sentence says more than one that doesn't
    ones, sums, squares = (np.concatenate([[0.0], np.cumsum(weight * x)]) for x in (1.0, width, width * width))
    back, base, measure = [0] * (n + 1), np.zeros(n), np.zeros(n)
    base[0] = -inner[1]
    for j in range(1, n + 1):
        measure[:j] = np.maximum(measure[:j], width[j - 1])
        w = measure[:j]
        # the squared shortfalls of lines i to j - 2 against w, by running sums
        total = base[:j] - ones[:j] + ((squares[j - 1] - squares[:j]) / w - 2 * (sums[j - 1] - sums[:j])) / w
        back[j] = k = int(np.argmin(total))
        if j < n:
            base[j] = total[k] + ones[j - 1] + inner[j] + start[j] - inner[j + 1]
    cuts, j = [], n
    while j:
        cuts.append((back[j], j))
        j = back[j]
    return cuts[::-1]


def page_bodies(pages: DataFrame, min_pages: int = 2, min_share: float = 1 / 3, stop_pages: float = 1.5) -> DataFrame:
    """(tid, page_no, body, lines, marks, open, next_head, next_line, carried) of every page with a text, furniture told from body.

    ``body`` are those of a page's ``lines`` that aren't furniture, ``marks`` the numbers of the others with the first letter of their kind. A line is a
    running head or foot if its letters, up to confusions, recur on at least ``min_pages`` pages and ``min_share`` of the tid's
    pages, and only furniture lies between it and the page's edge; a full stop at its end speaks against it as much as
    ``stop_pages`` further pages speak for it. Lines are counted by (tid, key) before anything is gathered and meet their
    counts by equality, so a tid with a third of all pages is no hot group.
    """
    texts = pages.select("tid", "page_no", "text").where("text is not null and tid is not null and page_no is not null").groupBy("tid", "page_no").agg(F.min("text").alias("text"))
    texts = durable(texts)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[line_key(x) for x in text.split("\n")] for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("tid"), b.column("page_no"), pa.array(found, pa.list_(pa.int64()))], ["tid", "page_no", "keys"])

    each = texts.mapInArrow(keys, "tid string, page_no int, keys array<bigint>").select("tid", "page_no", F.posexplode("keys").alias("line_no", "key"))
    line = durable(each.where("key <> 0").withColumn("line_no", F.col("line_no") + 1))
    total = texts.groupBy("tid").agg(F.count("*").alias("of"))
    recur = line.select("tid", "key", "page_no").distinct().groupBy("tid", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    heads = recur.join(total, "tid").where(F.col("pages") >= F.col("of") * min_share).select("tid", "key", (F.col("pages") - 1 > stop_pages).alias("sure"))
    met = line.join(heads, ["tid", "key"])
    found = met.groupBy("tid", "page_no").agg(F.collect_set(F.when(F.col("sure"), F.col("line_no")).otherwise(-F.col("line_no"))).alias("recurring"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, found in zip(b.column("text").to_pylist(), b.column("recurring").to_pylist(), strict=True):
                lines = lines_of(x)
                kinds = kinds_of(lines, {abs(k) for k in found or () if k > 0 or not _STOP.search(lines[-k - 1].rstrip())})
                keep = [x for x, kind in zip(lines, kinds, strict=True) if kind in ("", "body")]
                marks = " ".join(f"{k}{kind[0]}" for k, kind in enumerate(kinds, 1) if kind in ("header", "number"))
                first = kinds.index("body") if "body" in kinds else None
                head = None if first is None else _WORD.match(lines[first].lstrip())
                last = next((x for x in reversed(keep) if x.strip()), "")
                out.append(("\n".join(keep), len(lines), marks, head.group() if head else None, None if first is None else first + 1, bool(_ENDS.search(last))))
            columns = [b.column("tid"), b.column("page_no"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, ["tid", "page_no", "body", "lines", "marks", "head", "first", "open"])

    kind = "tid string, page_no int, body string, lines int, marks string, head string, first int, open boolean"
    bodies = durable(texts.join(found, ["tid", "page_no"], "left").select("tid", "page_no", "text", "recurring").mapInArrow(tell, kind))
    none = F.lit(None)
    ahead = bodies.where("head is not null").select("tid", (F.col("page_no") - 1).alias("page_no"), "head", "first", F.lit(False).alias("carried"))
    behind = bodies.where("open").select("tid", (F.col("page_no") + 1).alias("page_no"), none.cast("string").alias("head"), none.cast("int").alias("first"), F.lit(True).alias("carried"))
    around = ahead.unionByName(behind).groupBy("tid", "page_no").agg(F.max("head").alias("next_head"), F.max("first").alias("next_line"), F.max("carried").alias("carried"))
    return bodies.drop("head", "first").join(around, ["tid", "page_no"], "left")


def corpus_lexicon(bodies: DataFrame, least_share: float = 1e-6) -> tuple[list[tuple[str, int]], list[tuple[str, str, int]], float, float]:
    """(words, pairs, total, rare): the counts of all forms, and of all neighbours that would be a form as one word, whose share of
    the corpus is at least ``least_share``, so there are at most 1 / ``least_share`` of each, however large the corpus.

    Words cut by a line-end hyphen count as one; compounds count as themselves and as their parts. Every page counts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter[str] = Counter()
            for body in b["body"]:
                found.update(_COMPOUNDS.findall(_LINE_END.sub("", body.lower())))
            yield pd.DataFrame({"w": list(found), "n": list(found.values())})

    joined = durable(bodies.select("body").mapInPandas(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    parts = F.when(F.col("w").contains("-"), F.array_append(F.split("w", "-"), F.col("w"))).otherwise(F.array("w"))
    words = joined.select(F.explode(parts).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    total = float(words.agg(F.sum("n")).first()[0] or 0)
    rare = total * least_share
    kept = [tuple(r) for r in words.where(F.col("n") >= rare).collect()]
    listed = bodies.sparkSession.sparkContext.broadcast(frozenset(w for w, _ in kept))

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = listed.value
        for b in batches:
            found: Counter[tuple[str, str]] = Counter()
            for body in b["body"]:
                run = _LINE_END.sub("", body.lower())
                forms = _WORD.findall(run)
                if at := [k for k, ab in enumerate(map(str.__add__, forms, forms[1:])) if ab in known]:
                    gaps = _WORD.split(run)
                    found.update((forms[k], forms[k + 1]) for k in at if gaps[k + 1] in _BLANK)
            yield pd.DataFrame([(*ab, n) for ab, n in found.items()], columns=["a", "b", "n"])

    beside = bodies.select("body").mapInPandas(neighbours, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= rare)
    return kept, [tuple(r) for r in beside.collect()], total, rare


#: The lexicon that this worker has built, by the corpus it is of.
_BUILT: dict[int, Lexicon] = {}


def _lexicon(shared) -> Lexicon:
    if shared.value[0] not in _BUILT:
        _BUILT.clear()
        key, words, pairs, total, rare = shared.value
        _BUILT[key] = Lexicon(dict(words), {(a, b): n for a, b, n in pairs}, total, rare)
    return _BUILT[shared.value[0]]


class Page:
    """A row of ``page_bodies``, with the numbers of its body's lines and the marks as (line_no, kind)."""

    FIELDS = ("tid", "page_no", "body", "lines", "marks", "open", "next_head", "next_line", "carried")
    __slots__ = (*FIELDS, "numbers")

    def __init__(self, *values):
        for name, v in zip(self.FIELDS, values, strict=True):
            setattr(self, name, v)
        self.marks = [(int(m[:-1]), "header" if m[-1] == "h" else "number") for m in self.marks.split()]
        taken = {k for k, _ in self.marks}
        self.numbers = [k for k in range(1, self.lines + 1) if k not in taken]


def _decoded(pages: DataFrame, write, schema: str) -> DataFrame:
    """``write(row, stream, path)`` of every page, its rows as ``schema`` says."""
    bodies = page_bodies(pages)
    words, pairs, total, rare = corpus_lexicon(bodies)
    context = bodies.sparkSession.sparkContext
    shared = context.broadcast((hash((len(words), len(pairs), total, context.applicationId, id(bodies))), words, pairs, total, rare))
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared)
        for b in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = Page(*values)
                atoms = Stream(row.body, row.numbers, row.next_head, row.open)
                out += write(row, atoms, decode(atoms, lexicon))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], to_arrow_type(f.dataType)) for k, f in enumerate(kind)], [f.name for f in kind])

    return bodies.select(*Page.FIELDS).mapInArrow(run, schema)


def damaged_lines(pages: DataFrame) -> DataFrame:
    """(tid, page_no, line_no, kind) of every damaged line: ``header``, ``number``, ``hyphen`` or ``misread``.

    Repeated rows count once (of several texts of one page the smallest), null texts and empty ones give no row, an empty table
    none; other columns aren't read. ``line_no`` counts from 1 over all lines between line feeds.
    """

    def write(row, run: Stream, path: list[Arc]) -> list[tuple]:
        found = {(row.page_no, *m) for m in row.marks}
        for arc in path:
            i, size, _, misread, _ = arc
            if size > 1:
                found |= {(row.page_no, run.lines[k - 1], "hyphen") for k in range(i + 1, i + size) if k in run.cut}
            if misread and not (i == 0 and size == 1 and row.carried):
                for k in misread_atoms(run, arc):
                    if run.lines[k]:
                        found.add((row.page_no, run.lines[k], "misread"))
                    elif row.next_line is not None:
                        found.add((row.page_no + 1, row.next_line, "misread"))
        return [(row.tid, *f) for f in sorted(found)]

    return _decoded(pages, write, "tid string, page_no int, line_no int, kind string").distinct()


def repaired_paragraphs(pages: DataFrame) -> DataFrame:
    """(tid, page_no, para_no, text) of the paragraphs of every tid, words whole and corrected, furniture left out.

    ``page_no`` is where a paragraph begins, ``para_no`` its place on that page from 1. A paragraph that a page's end interrupts
    (without a full stop, or within a word) goes on with the first of the next page of the tid that has a body. Pages without
    body give no row. What is gathered for a row is that one paragraph.
    """

    def write(row, run: Stream, path: list[Arc]) -> list[tuple]:
        lines = row.body.split("\n") if len(row.numbers) else []
        groups = paragraphs(lines)
        full = [n for n, x in zip(row.numbers, lines, strict=True) if x.strip()]
        of_line = {full[k]: g for g, (a, b) in enumerate(groups) for k in range(a, b)}
        texts, last = [""] * len(groups), 0
        arcs, i = {arc[0]: arc for arc in path}, 0
        while i < len(run.texts):
            g, gap = of_line.get(run.lines[i], last), run.gaps[i]
            if g != last and "\n" in gap:
                close, _, gap = gap.rpartition("\n")
                texts[last] += close
            word = shown(run, arcs[i]) if i in arcs else run.texts[i]
            texts[g] += gap if i == 0 and row.carried else gap + word
            i += arcs[i][1] if i in arcs else 1
            last = g
        if groups and not row.open:
            texts[last] += run.gaps[-1]
        neat = [re.sub(r"\s+", " ", x).strip() for x in texts]
        kept = [x for k, x in enumerate(neat) if x or k == 0 and row.carried]
        return [(row.tid, row.page_no, k + 1, x, k + 1 == len(kept) and (row.open or not _STOP.search(x))) for k, x in enumerate(kept)]

    parts = _decoded(pages, write, "tid string, page_no int, para_no int, text string, goes_on boolean")
    parts = durable(parts)
    follows = parts.where("goes_on").select("tid", F.col("page_no").alias("_page"))
    starts = parts.where("para_no = 1").select("tid", "page_no", "text")
    nexts = starts.select("tid", "page_no").join(follows.select("tid", (F.col("_page") + 1).alias("page_no")), ["tid", "page_no"]).withColumn("_on", F.lit(1)).withColumn("para_no", F.lit(1))
    marked = parts.join(nexts, ["tid", "page_no", "para_no"], "left").withColumn("_begins", F.when(F.col("_on").isNull(), 1).otherwise(0))
    run = numbered(marked, ["tid", "page_no", "para_no"], "_before", F.col("_begins")).withColumn("_run", F.col("_before") + F.col("_begins"))
    put = F.sort_array(F.collect_list(F.struct("page_no", "para_no", "text")))
    whole = run.groupBy("tid", "_run").agg(put.alias("p"))
    text = F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda x: x != ""), " ")
    return whole.select("tid", F.col("p")[0]["page_no"].alias("page_no"), F.col("p")[0]["para_no"].alias("para_no"), text.alias("text")).where("text <> ''")
