"""Garbled text from wrong character encodings: noisy-channel decoding over byte lattices.

A value is a row of spans (runs of ASCII letters, figures and any other characters). Under each channel, a pair of the encoding
a text was read with and the one it was written in, a span is a lattice of bytes: a character that the channel can have made is
its byte, a lost one (U+FFFD) a wildcard that any byte beyond ASCII fits. The characters that the bytes spell in the written
encoding, wildcards filled by spans of the corpus that fit the lattice, are the channel's readings of the span. A Viterbi search
through the readings of all spans, scored by corpus frequencies and by how well letters go together in a word, finds the likeliest
original; a value whose best path leaves the clean state is damaged.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

LOST = "�"
#: Encodings that texts are read with by mistake, and those that they were written in.
READ_AS = ["cp1252", "latin-1", "cp437", "mac_roman", "cp850", "cp1250", "cp1251", "cp1253"]
WRITTEN_IN = ["utf-8", "cp1252", "cp1251", "cp1253", "mac_roman", "cp437"]
CHANNELS = [(r, w, n) for w in WRITTEN_IN for r in READ_AS if r != w for n in ((1, 2) if w == "utf-8" else (1,))]

#: A blank behind one of these can be a no-break blank that was replaced, so the span goes on.
_LEADS = "ÂÃÅ"
_SPAN = re.compile(rf"[A-Za-z0-9\x80-\U0010ffff]+(?:(?<=[{_LEADS}]) [A-Za-z0-9\x80-\U0010ffff]+)*(?:(?<=[{_LEADS}]) (?=[,.;:)]|$))?")
_WORD = re.compile(r"\w+(?:[’']\w+)*")
#: Log-odds of the noisy channel: scripts mixed in a word, marks between letters, letter case, bytes that happen to be valid
#: UTF-8, leaving a state, and characters that archives of letters don't have.
_MIXED, _INSIDE, _CASE, _VALID, _SWITCH, _CONTROL, _STRANGE = -15.0, -12.0, -8.0, -12.0, -2.0, -40.0, -12.0
_OPENING, _CLOSING, _APART = "«“„‘¿¡", "»”", "±×÷¬¦¤¯¶§†‡•"
#: The states of the search: clean, every channel, and bytes lost from a text that was read rightly.
_CLEAN, _LOSS = -1, len(CHANNELS)


@cache
def _bytes_of(encoding: str) -> dict[str, bytes]:
    """Byte of each character of a one-byte encoding; undefined bytes read as the control of that number, as browsers do."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = bytes([b])
    return out


def reread(text: str, read: str, written: str, times: int = 1) -> str | None:
    """The text as it was before being read with the wrong encoding; None if it can't have come about that way."""
    for _ in range(times):
        table = _bytes_of(read)
        try:
            text = b"".join([table[c] for c in text]).decode(written)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def _sound(text: str) -> bool:
    return text == text.strip() and not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") for c in text)


@lru_cache(50_000)
def readings(span: str) -> dict[int, str]:
    """Other readings of a span without lost bytes by channel number, but those that hold controls or private characters."""
    out = {}
    text = span.replace(" ", "\xa0")
    lattices = {}
    for read in READ_AS:
        table = _bytes_of(read)
        try:
            lattices[read] = b"".join([table[c] for c in text])
        except KeyError:
            continue
    for k, (read, written, times) in enumerate(CHANNELS):
        if read not in lattices:
            continue
        try:
            new = lattices[read].decode(written)
        except UnicodeDecodeError:
            continue
        new = new if times == 1 else reread(new, read, written, times - 1)
        if new is not None and new != span and _sound(new):
            out[k] = new
    return out


class Gap:
    """What a span with lost bytes can have been: a text that begins with ``prefix``, ends with ``suffix``, has ``least`` to
    ``most`` characters between them, and whose bytes fit the lattice."""

    __slots__ = ("least", "most", "pattern", "prefix", "suffix", "written")

    def __init__(self, prefix: str, suffix: str, least: int, most: int, pattern: re.Pattern, written: str | None):
        self.prefix, self.suffix, self.least, self.most, self.pattern, self.written = prefix, suffix, least, most, pattern, written

    def fits(self, text: str) -> bool:
        if self.written is None:
            return bool(self.pattern.fullmatch(text))
        try:
            return bool(self.pattern.fullmatch(text.encode(self.written)))
        except UnicodeEncodeError:
            return False

    def keys(self) -> list[str]:
        """Under what it meets spans of the corpus; none if neither its first nor its last character is left."""
        return [f"{g}|{self.prefix}|{self.suffix}" for g in range(self.least, self.most + 1)] if self.prefix or self.suffix else []


def _edge(known: bytes, written: str, head: bool) -> str | None:
    """The characters of the known bytes before the first wildcard, or behind the last, without one that the wildcard cuts."""
    if written == "utf-8":
        if head:
            cut = next((k for k in range(1, min(4, len(known) + 1)) if known[-k] >= 0xC0), 0)
            lead = known[-cut] if cut else 0
            known = known[:-cut] if cut and cut < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else known
        else:
            known = known[next((k for k, x in enumerate(known) if not 0x80 <= x < 0xC0), len(known)) :]
    try:
        return known.decode(written)
    except UnicodeDecodeError:
        return None


@lru_cache(50_000)
def gaps(span: str) -> dict[int, Gap]:
    """The lattices of a span with lost bytes by state: as bytes lost from a text read rightly, and under each channel that can
    have made its other characters. A channel that made none of them says nothing of its own and is left out."""
    parts = re.split(f"({LOST}+)", span)
    literal = "".join(f"[^\x00-\x7f]{{1,{len(p)}}}" if p.startswith(LOST) else re.escape(p) for p in parts if p)
    inner = len(span) - len(parts[0]) - len(parts[-1])
    known = sum(len(p) for p in parts[1:-1] if not p.startswith(LOST))
    runs = sum(p.startswith(LOST) for p in parts)
    out = {_LOSS: Gap(parts[0], parts[-1], known + runs, inner, re.compile(literal), None)}
    if all(c.isascii() for p in parts if not p.startswith(LOST) for c in p):
        return out
    for k, (read, written, times) in enumerate(CHANNELS):
        table = _bytes_of(read)
        if times > 1 or any(c not in table for c in span if c != LOST):
            continue
        lattice = [None if c == LOST else table[c] for c in span]
        first = lattice.index(None)
        last = len(lattice) - 1 - lattice[::-1].index(None)
        prefix, suffix = _edge(b"".join(lattice[:first]), written, True), _edge(b"".join(lattice[last + 1 :]), written, False)
        if prefix is None or suffix is None:
            continue
        pattern = b"".join(b"[\x80-\xff]" if x is None else re.escape(x) for x in lattice)
        left = len(lattice) - len(prefix.encode(written)) - len(suffix.encode(written))
        least = left if written != "utf-8" else -(-left // 4)
        out[k] = Gap(prefix, suffix, max(least, 1), left, re.compile(pattern, re.DOTALL), written)
    return out


def fillings(span: str) -> list[str]:
    """The keys that ``Gap.keys`` of a damaged form of this span can have: every stretch between two characters beyond ASCII lost."""
    odd = [k for k, c in enumerate(span) if not c.isascii()]
    return [f"{j - i + 1}|{span[:i]}|{span[j + 1 :]}" for n, i in enumerate(odd) for j in odd[n:] if i or j + 1 < len(span)]


@cache
def _kind(c: str) -> str:
    name = unicodedata.name(c, "")
    if c.isalpha() and unicodedata.category(c)[0] == "L" and not name.startswith(("SUPERSCRIPT", "MODIFIER", "FEMININE", "MASCULINE")):
        return name.partition(" ")[0]
    return "figure" if c.isdigit() else "mark"


@lru_cache(100_000)
def fit(span: str) -> float:
    """How well the characters of a span go together, 0 at best: one script a word, no marks between letters but
    apostrophes, no letter of the other case inside a word, no signs that letters don't hold."""
    score = 0.0
    scripts = {k for k in map(_kind, span) if k not in ("mark", "figure")}
    if len(scripts) > 1:
        score += _MIXED
    padded = f" {span} "
    small = any(c.islower() and c.isascii() for c in span)
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        if b.isascii():
            continue
        if _kind(b) == "mark":
            if a.isalpha() and c.isalpha() and b not in "’":
                score += _INSIDE
            if b in _OPENING and a.isalnum() or b in _CLOSING and c.isalnum() or b in _APART and (a.isalpha() or c.isalpha()):
                score += _INSIDE
            if 0x2200 <= ord(b) < 0x2700 or unicodedata.category(b) in ("Lm", "No", "Sk"):
                score += _STRANGE
        elif 0x17F < ord(b) < 0x370 or 0x1D00 <= ord(b) < 0x1E00:
            score += _STRANGE
        elif b.islower() and c.isupper() and not small or b.isupper() and a.isalpha() and small:
            score += _CASE
    if any(unicodedata.category(c) in ("Cc", "Cn", "Co") for c in span):
        score += _CONTROL
    return score


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def damaged_spans(value: str) -> list[str]:
    return [s for s in _SPAN.findall(value) if not s.isascii()]


def decode(value: str, counts: dict[str, int], total: int, found: dict[str, list[tuple[str, int]]]) -> tuple[bool, str | None]:
    """Whether the value is damaged, and its original, None where a lost byte stays unknown.

    ``counts`` are corpus frequencies of lower-cased words, ``found`` the corpus spans, with their frequencies, that meet the gaps of
    each span with lost bytes. Every span, with lost bytes or without, goes through the one search.
    """

    def likely(span: str) -> float:
        return sum(math.log((counts.get(w, 0) + 0.05) / (total + 1.0)) for w in words_of(span)) + fit(span)

    spans = damaged_spans(value)
    if not spans:
        return False, value
    states = range(_CLEAN, _LOSS + 1)
    path = {s: (0.0 if s == _CLEAN else _SWITCH, ()) for s in states}
    for span in spans:
        if LOST in span:
            unknown = math.log(0.05 / (total + 1.0))
            emit = {_CLEAN: (unknown + _CONTROL * span.count(LOST), span)}
            for k, gap in gaps(span).items():
                fits = [(math.log((c + 0.05) / (total + 1.0)) + fit(x), x) for x, c in found.get(span, ()) if gap.fits(x)]
                best = max(fits, key=lambda f: (f[0], f[1]), default=(unknown, None))
                # what no known character speaks for is a loss, not a channel's doing
                emit[k] = best if best[0] > unknown else (unknown - 0.5 * (k != _LOSS), None)
        else:
            other = readings(span)
            clean = likely(span) + (_VALID if any(CHANNELS[k][1] == "utf-8" and fit(new) > _MIXED for k, new in other.items()) else 0.0)
            emit = {_CLEAN: (clean, span), _LOSS: (clean, span), **{k: (likely(new), new) for k, new in other.items()}}
        top = max(path.values(), key=lambda p: p[0])
        stay = {s: path[s] if s in path and path[s][0] >= top[0] + _SWITCH else (top[0] + _SWITCH, top[1]) for s in emit}
        path = {s: (stay[s][0] + e, (*stay[s][1], new)) for s, (e, new) in emit.items()}
    best = max((path[s] for s in states if s in path), key=lambda p: p[0])[1]  # on a tie the clean state, then the channel named first
    damaged = any(k != v for k, v in zip(spans, best, strict=True))
    if None in best:
        return True, None
    new = dict(zip(spans, best, strict=True))
    return damaged, _SPAN.sub(lambda m: new.get(m.group(), m.group()), value) if damaged else value


def decode_values(values: DataFrame) -> DataFrame:
    """(field, doc_id, value, damaged, original) for the rows (field, doc_id, value) of ``values``.

    Repeated rows count once; null values give no row; blank and ASCII values are not damaged; ``original`` is null only where
    bytes are lost for good. Word frequencies are counted over all distinct rows. Only distinct values with a character
    outside ASCII go through Python; a frequent value is handled once, and what is gathered for a value are the frequencies
    of its own readings' words, so no group grows with the corpus.
    """
    rows = values.select("field", "doc_id", "value").where("value is not null").distinct()
    each = rows.groupBy("value").agg(F.count("*").alias("n"))
    word = F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}\p{N}_]+(?:[’'][\p{L}\p{N}_]+)*"), F.lit(0))
    frequency = each.select(F.explode(word).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("c"))
    frequency = durable(frequency)
    total = frequency.agg(F.sum("c")).first()[0] or 0
    odd = each.where(F.col("value").rlike(r"[^\x00-\x7f]")).select("value")

    def needs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, lost = [], []
            for v in b["value"]:
                spans = damaged_spans(v)
                words.append(sorted({w for s in spans if LOST not in s for form in (s, *readings(s).values()) for w in words_of(form)}))
                lost.append([s for s in dict.fromkeys(spans) if LOST in s])
            yield pd.DataFrame({"value": b["value"], "words": words, "lost": lost})

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by another hash than the aggregate's, which would leave the few bytes of these costly rows in one task
    asked = durable(odd.repartition(parts, F.xxhash64("value")).mapInPandas(needs, "value string, words array<string>, lost array<string>"))
    known = asked.select("value", F.explode("words").alias("w")).join(frequency, "w").groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("counts"))

    def sought(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, key) for s in b["span"] for key in {key for g in gaps(s).values() for key in g.keys()}]
            yield pd.DataFrame(rows, columns=["span", "key"])

    def offered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, c, key) for s, c in zip(b["s"], b["c"], strict=True) for key in fillings(s)]
            yield pd.DataFrame(rows, columns=["s", "c", "key"])

    def fitting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(span, k, math.log(c) + fit(s), s, c) for span, s, c in zip(b["span"], b["s"], b["c"], strict=True) for k, g in gaps(span).items() if g.fits(s)]
            yield pd.DataFrame(rows, columns=["span", "state", "score", "s", "c"])

    lost = asked.select(F.explode("lost").alias("span")).distinct().mapInPandas(sought, "span string, key string")
    spans = each.select(F.explode(F.regexp_extract_all("value", F.lit(r"[A-Za-z0-9\x{80}-\x{10ffff}]+"), F.lit(0))).alias("s"), "n").where(F.col("s").rlike(r"[^\x00-\x7f]") & ~F.col("s").contains(LOST))
    corpus = spans.groupBy("s").agg(F.sum("n").alias("c")).mapInPandas(offered, "s string, c bigint, key string")
    met = lost.join(corpus, "key").select("span", "s", "c").distinct().mapInPandas(fitting, "span string, state int, score double, s string, c bigint")
    # the search asks for the likeliest span of a state only, so one a state is gathered
    likeliest = met.groupBy("span", "state").agg(F.max(F.struct("score", "s", "c")).alias("b")).select("span", "b.s", "b.c").distinct()
    filled = likeliest.groupBy("span").agg(F.collect_list(F.struct("s", "c")).alias("s"))
    fills = asked.select("value", F.explode("lost").alias("span")).join(filled, "span").groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("span", "s"))).alias("found"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for v, c, f in zip(b["value"], b["counts"], b["found"], strict=True):
                table = {} if f is None else {span: [(x["s"], x["c"]) for x in xs] for span, xs in dict(f).items()}
                got.append(decode(v, dict(c) if c is not None else {}, total, table))
            yield pd.DataFrame({"value": b["value"], "damaged": [d for d, _ in got], "original": [o for _, o in got]})

    joined = asked.select("value").join(known, "value", "left").join(fills, "value", "left")
    decoded = joined.repartition(parts, F.xxhash64("value")).mapInPandas(search, "value string, damaged boolean, original string")
    out = rows.join(decoded, "value", "left")
    return out.select("field", "doc_id", "value", F.coalesce("damaged", F.lit(False)).alias("damaged"), F.when(F.col("damaged").isNull(), F.col("value")).otherwise(F.col("original")).alias("original"))


def archive_values(docs: DataFrame, authors: DataFrame, recipients: DataFrame) -> DataFrame:
    """(field, doc_id, value) of titles and names."""
    parts = ((docs, "docs.title", "id", "title"), (authors, "authors.author", "doc_id", "author"), (recipients, "recipients.recipient", "doc_id", "recipient"))
    a, b, c = (t.select(F.lit(f).alias("field"), F.col(k).alias("doc_id"), F.col(v).alias("value")) for t, f, k, v in parts)
    return a.unionByName(b).unionByName(c)
