"""Column builders for text: tokens, n-grams, sections, contractions, hits and passages. All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, figures and underscore of any script; the same runs in Spark, DuckDB and Python.
WORD = r"[\p{L}\p{N}_]+"

#: Fixed values, in the order in which they are replaced: earlier ones also change parts of later ones.
CONTRACTIONS = {
    "aren't": "are not",
    "can't": "cannot",
    "could've": "could have",
    "couldn't": "could not",
    "didn't": "did not",
    "doesn't": "does not",
    "don't": "do not",
    "hadn't": "had not",
    "hasn't": "has not",
    "haven't": "have not",
    "he'd": "he had / he would",
    "he'll": "he will",
    "he's": "he is",
    "i'd": "I had / I would",
    "i'll": "I shall / I will",
    "i'm": "I am",
    "i've": "I have",
    "isn't": "is not",
    "it'd": "it would",
    "it'll": "it shall / it will",
    "it's": "it has / it is",
    "let's": "let us",
    "ma'am": "madam",
    "might've": "might have",
    "must've": "must have",
    "mustn't": "must not",
    "needn't": "need not",
    "shan't": "shall not",
    "she'd": "she would",
    "she'll": "she shall / she will",
    "she's": "she is",
    "should've": "should have",
    "shouldn't": "should not",
    "that'd": "that would",
    "that's": "that has / that is",
    "there's": "there is",
    "they'd": "they would",
    "they'll": "they will",
    "they're": "they are",
    "they've": "they have",
    "wasn't": "was not",
    "we'd": "we would",
    "we'll": "we will",
    "we're": "we are",
    "we've": "we have",
    "weren't": "were not",
    "what's": "what is",
    "where's": "where is",
    "who'll": "who will",
    "who's": "who is",
    "won't": "will not",
    "wouldn't": "would not",
    "you'd": "you would",
    "you'll": "you shall / you will",
    "you're": "you are",
    "you've": "you have",
}


def tokens(text: Column) -> Column:
    """The lower-cased tokens of a text as an array; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: Catalyst would copy its expression to every place, even into a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n successive tokens, joined by blanks; empty if there are fewer."""
    if n == 1:
        return words

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return _once(words, runs)


def sections(words: Column, length: int) -> Column:
    """Arrays of ``length`` successive tokens, the last one shorter; none for a text without tokens."""

    def parts(w: Column) -> Column:
        count = F.ceil(F.size(w) / F.lit(length)).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(w, i * length + 1, length))).otherwise(F.array().cast("array<array<string>>"))

    return _once(words, parts)


def expand_contractions(text: Column) -> Column:
    """Contractions written out by plain substring replacement in their fixed order, lower-cased at the end."""
    return F.lower(reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), CONTRACTIONS.items(), text))


def search_regex(term: str) -> str:
    """The regular expression of a search term: whole words, ``*`` at an end opens that end, within it stands for one character."""
    start, end = term.startswith("*"), term.endswith("*")
    core = ".".join(re.escape(p) for p in term.strip("*").split("*"))
    return ("" if start else r"\b") + core + ("" if end else r"\b")


def unicode_regex(term: str) -> str:
    """The same with word borders of all scripts, as Java needs it said."""
    return "(?U)" + search_regex(term)


def hit_offsets(text: Column, term: str) -> Column:
    """Offsets from 0 of all non-overlapping occurrences of a substring, left to right."""
    size = len(term)
    pieces = F.split(text, r"\Q" + term + r"\E", -1)
    ends = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) + size)
    sums = F.aggregate(ends, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, x + F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(0)))
    return F.when(F.size(pieces) > 1, F.transform(sums, lambda e: e - size)).otherwise(F.array().cast("array<int>"))


def window(text: Column, hit: Column, length: int) -> Column:
    """The text around a hit, from half the length before to half behind, cut to whole words; empty if it holds none."""
    start = F.greatest(F.lit(0), hit - length // 2)
    part = F.substring(text, start + 1, hit + length // 2 - start)
    return F.trim(F.regexp_extract(part, r"(?s)\s.+\s", 0))


def highlight(passage: Column, term: str) -> Column:
    return F.replace(passage, F.lit(term), F.lit(f"<b>{term}</b>"))


def shorten(text: Column, length: int = 50) -> Column:
    """At most ``length`` characters, with dots where it was cut; null becomes empty."""
    return F.coalesce(F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text), F.lit(""))
