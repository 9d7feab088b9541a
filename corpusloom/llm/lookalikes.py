"""Visually identical text with different characters: script-aware repair to one form.

Marks that print alike are unified in every text: composed accents (NFC), full-width forms, ligatures, blanks of other
widths, hyphens that print as hyphens, line ends; what prints nothing is taken out. Letters of another script that look like
the token's dominant script are substituted only if the result is a word of the corpus. Characters that merely resemble
each other for a machine (superscripts, fractions, signs) stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Pairs of a Cyrillic, Greek or other letter and the Latin letter that prints alike.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ѵ": "v", "ё": "ë", "ї": "ï",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "α": "a", "υ": "u",
}
LATIN = {"ɑ": "a", "ɡ": "g", "ı": "i"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
BLANKS = "               　"
NOTHING = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"
HYPHENS = "‐‑"

TO_LATIN = CYRILLIC | GREEK | LATIN
_FROM_LATIN = {"CYRILLIC": {v: k for k, v in CYRILLIC.items() if v.isascii()}, "GREEK": {v: k for k, v in GREEK.items()}}
_PRINT = {
    **{ord(c): " " for c in BLANKS}, **dict.fromkeys(map(ord, NOTHING)), **{ord(c): "-" for c in HYPHENS},
    **{ord(k): v for k, v in LIGATURES.items()}, **{k: k - 0xFEE0 for k in range(0xFF01, 0xFF5F)},
}
_TOKEN = re.compile(r"\w+")
#: Letters from here on are of other scripts than Latin.
_BEYOND = "Ͱ"
_FOREIGN = re.compile("[" + "".join(TO_LATIN) + "]")
#: Texts of other characters than these hold nothing that can change; they never leave the JVM.
CHANGES = r"[^\x00-\x0c\x0e-\x9f¡-¬®-ÿ]"


def printed(text: str) -> str:
    """The text with marks that print alike unified; letters of other scripts stay."""
    text = text.translate(_PRINT)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0] if c.isalpha() else ""


def repairs(text: str) -> dict[str, str]:
    """The tokens of a printed text that mix scripts, each with its form in its dominant script.

    A token whose letters all have counterparts in the dominant script of the text counts as mixed with its surroundings.
    On a tie within a token the dominant script of the text decides. Tokens with a letter that has no counterpart have none.
    """
    found: dict[str, str] = {}
    tokens = [t for t in _TOKEN.findall(text) if _FOREIGN.search(t) or max(t) >= _BEYOND and len({_script(c) for c in t if c.isalpha()}) > 1]
    if not tokens:
        return found
    around = [_script(c) for c in text if c.isalpha()]
    main = max(sorted(set(around)), key=around.count)
    for t in set(tokens):
        scripts = [_script(c) for c in t if c.isalpha()]
        top = max(set(scripts), key=lambda s: (scripts.count(s), s == main, s))
        for goal in dict.fromkeys((main, top)):
            if goal == "LATIN":
                new = "".join(TO_LATIN.get(c, c) for c in t)
            else:
                table = _FROM_LATIN.get(goal, {})
                new = "".join(c if _script(c) in (goal, "") else table.get(TO_LATIN.get(c, c), c) for c in t)
            if new != t and all(_script(c) in (goal, "") for c in new):
                found[t] = new
                break
    return found


def one_form(documents: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """(key, print, form) of every row of ``documents`` with a non-null text: ``print`` is the text's SHA-256, ``form`` the text
    in its one form, equal for texts that print alike.

    Texts are whole, repeated rows stay, an empty text is its own form, null texts give no row, other columns aren't read.
    A substitution is made if its result is a token (of letters, digits and underscore, case kept) of the corpus; every
    document's tokens count. Only rows with a character that can change go through Python, once, and are written to the
    shared checkpoint folder; only tokens that mix scripts are gathered as candidates and checked against the tokens of the
    corpus. They are broadcast if counted to be at most ``broadcast_rows``, else joined by shuffle; the rows are the same.
    """
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    changes = F.col("t").rlike(CHANGES)
    plain = rows.where(~changes).select("k", F.sha2("t", 256).alias("print"), F.when(F.col("t").contains("\r"), F.regexp_replace("t", "\r\n?", "\n")).otherwise(F.col("t")).alias("form"))

    def print_form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = [printed(t) for t in b["t"]]
            mixed = [repairs(f) for f in forms]
            yield pd.DataFrame({"k": b["k"], "print": b["print"], "p": forms, "old": [list(m) for m in mixed], "new": [list(m.values()) for m in mixed]})

    kind = rows.schema["k"].dataType.simpleString()
    read = rows.where(changes).select("k", "t", F.sha2("t", 256).alias("print"))
    changed = durable(read.mapInPandas(print_form, f"k {kind}, print string, p string, old array<string>, new array<string>"))
    done = changed.where(F.size("new") == 0).select("k", "print", F.col("p").alias("form"))
    mixed = changed.where(F.size("new") > 0)
    wanted = durable(mixed.select(F.explode("new").alias("w")).distinct())
    few = wanted.count() <= broadcast_rows
    coarse = rows.select(F.explode(F.split("t", r"[\x00-/:-@\[-^`{-\x7f]+")).alias("w"))
    ascii_words = coarse.where(F.octet_length("w") == F.length("w"))
    other_words = coarse.where(F.octet_length("w") != F.length("w")).distinct().select(F.explode(F.regexp_extract_all("w", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    held = (w.join(F.broadcast(wanted) if few else wanted, "w", "left_semi").distinct() for w in (ascii_words, other_words))
    real = durable(next(held).unionByName(next(held)).distinct())
    pairs = mixed.select("k", "print", F.explode(F.arrays_zip("old", "new")).alias("z")).select("k", "print", F.col("z.old").alias("old"), F.col("z.new").alias("w"))
    accepted = pairs.join(real, "w").groupBy("k", "print").agg(F.map_from_entries(F.collect_set(F.struct("old", "w"))).alias("swap"))
    joined = mixed.select("k", "print", "p").join(accepted, ["k", "print"], "left")

    def substitute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = []
            for p, swap in zip(b["p"], b["swap"], strict=True):
                swap = dict(swap) if swap is not None else {}
                forms.append(_TOKEN.sub(lambda m, s=swap: s.get(m.group(), m.group()), p) if swap else p)
            yield pd.DataFrame({"k": b["k"], "print": b["print"], "form": forms})

    repaired = joined.mapInPandas(substitute, f"k {kind}, print string, form string")
    return plain.unionByName(done).unionByName(repaired).withColumnRenamed("k", key)


def alike_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: every two documents whose non-empty texts print alike but differ as strings.

    Repeated rows count once; null and empty texts are in no pair. Forms held by one text only, however often, end at a map-side
    aggregate of fingerprints (SHA-256). Of the others, distinct prints of a form are paired first and opened to their documents
    afterwards, so exact copies never meet each other: a print with a third of all rows costs what it has to return.
    """
    texts = documents.where(F.col("text") != "")
    forms = durable(one_form(texts).select("doc_id", F.unhex("print").alias("s"), F.unhex(F.sha2("form", 256)).alias("f")))
    mixed = forms.groupBy("f").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("f")
    held = durable(forms.join(mixed, "f", "left_semi").distinct())
    prints = held.select("f", "s").distinct()
    alike = prints.select("f", F.col("s").alias("s_a")).join(prints.select("f", F.col("s").alias("s_b")), "f").where("s_a <> s_b").select("s_a", "s_b")
    a = held.select(F.col("doc_id").alias("doc_id_a"), F.col("s").alias("s_a"))
    b = held.select(F.col("doc_id").alias("doc_id_b"), F.col("s").alias("s_b"))
    return alike.join(a, "s_a").join(b, "s_b").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()
