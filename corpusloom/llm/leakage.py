"""Evaluation texts leaking into training text: pigeonhole edit matching.

Both sides become streams of folded letters and digits: case, accents, look-alike letters, punctuation, blanks and line breaks
are set aside, and characters that scanning confuses fall into one class. A passage is ``words`` successive words of an item.
It may differ by ``errors`` further edits, so one of its errors + 1 pieces must occur letter by letter. Those hits are
found by rolling hashes of all windows of a document against the sorted hashes of the pieces, a few bytes a piece, and each is verified
with Myers' bit-parallel distance, the width of a passage at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look Latin, and groups of characters that scanning confuses.
ALIKE = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονριαυɑɡı",
    "ABESIJKMHOPCTYXaeopcyxsijhdqwlABEZHIKMNOPTYXovpiauagi",
)
#: A small letter goes where its capital goes, so that case is set aside in other scripts too; small Greek nu and upsilon look like
#: v and u, their capitals like N and Y, so Greek words are lowered first.
ALIKE |= {ord(chr(k).lower()): v + 32 if isinstance(v, int) else v.lower() for k, v in list(ALIKE.items()) if ord(chr(k).lower()) not in ALIKE}
_GREEK = re.compile("[\u0370-\u03ff\u1f00-\u1fff][\u0300-\u036f\u0370-\u03ff\u1f00-\u1fff]+")
CONFUSED = ["aceo0", "bh", "ft", "il1|", "5s"]
SPLIT = {"m": "rn", "w": "vv", "u": "ii", "d": "cl"}

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789|"
_DROP = bytes(i for i in range(256) if i not in _KEPT)
_CLASS = bytes.maketrans(*(x.encode() for x in ("".join(CONFUSED), "".join(g[0] * len(g) for g in CONFUSED))))
_SPLIT = [(k.encode(), "".join(v).encode().translate(_CLASS)) for k, v in SPLIT.items()]


_STR_CLASS = {ord(c): g[0] for g in CONFUSED for c in g} | {ord(k): "".join(v) for k, v in ((k.decode(), v.decode()) for k, v in _SPLIT)}
_STR_DROP = re.compile(r"[^\w|]|_")
#: Scripts written without blanks: each of their characters is a word.
_UNSPACED = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED_JAVA = _UNSPACED
_WORDS = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")


def folded(text: str) -> str:
    """The stream of a text: letters and digits of every script, each as its class."""
    if text.isascii():
        raw = text.lower().encode().translate(_CLASS, _DROP)
        for k, v in _SPLIT:
            raw = raw.replace(k, v)
        return raw.decode()
    text = _GREEK.sub(lambda m: m.group().lower() if any(ord(c) not in ALIKE for c in m.group()) else m.group(), unicodedata.normalize("NFKD", text))
    text = unicodedata.normalize("NFKD", text.translate(ALIKE).casefold())
    return _STR_DROP.sub("", text).translate(_STR_CLASS)


def words_of(text: str) -> list[str]:
    """The folded words of an item; what folds to nothing is no word."""
    return [x for x in map(folded, _WORDS.findall(text)) if x]


def myers(pattern: str, text: str) -> list[int]:
    """For each end in ``text`` the least edit distance of ``pattern`` to a stretch that ends there."""
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    pv, mv, score, out = full, 0, len(pattern), []
    for c in text:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


def _words_hold(pattern_words: list[str], stretch: str) -> bool:
    """Whether an alignment of the words with the stretch leaves no word with more edits than a third of its length."""
    pattern = "".join(pattern_words)
    n, m = len(pattern), len(stretch)
    rows = [list(range(m + 1))]
    for i in range(1, n + 1):
        prev, row, p = rows[-1], [i], pattern[i - 1]
        for j in range(1, m + 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (p != stretch[j - 1])))
        rows.append(row)
    edits, i, j = [0] * (n + 1), n, m
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (pattern[i - 1] != stretch[j - 1]):
            edits[i] += pattern[i - 1] != stretch[j - 1]
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            edits[i] += 1
            i -= 1
        else:
            edits[max(i, 1)] += 1
            j -= 1
    at = 0
    for w in pattern_words:
        if sum(edits[at + 1 : at + len(w) + 1]) > len(w) // 3:
            return False
        at += len(w)
    return True


#: Lengths of the windows that are hashed: a piece is looked up by as long a prefix of these as it has.
_LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
_SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _codes(stream: str) -> np.ndarray:
    return np.frombuffer(stream.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Passages:
    """The passages of some items, ready to be looked for in documents: for each piece its hash, item and place."""

    def __init__(self, items: list[tuple[int, str]], words: int = 20, errors: int = 2):
        self.span, self.errors = words, errors
        cuts = np.array([words * k // (errors + 1) for k in range(errors + 2)])
        self.words, self.ids, self.offsets = [], [], []
        hashes, places, sizes = [], [], []
        for item_id, text in items:
            w = words_of(text or "")
            starts = len(w) - words + 1
            if starts < 1:
                continue
            offs = np.concatenate([[0], np.cumsum([len(x) for x in w])])
            first = (np.arange(starts)[:, None] + cuts[None, :-1]).ravel()
            size = offs[(np.arange(starts)[:, None] + cuts[None, 1:]).ravel()] - offs[first]
            length = np.array(_LENGTHS)[np.searchsorted(_LENGTHS, size, "right") - 1]
            codes = _codes("".join(w))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, len(codes)))])
            at = offs[first]
            hashes.append((total[at + length] - total[at]) * _powers(_INVERSE, int(at.max()) + 1)[at])
            sizes.append(length)
            place = np.empty((len(first), 3), np.int32)
            place[:, 0], place[:, 1], place[:, 2] = len(self.words), np.repeat(np.arange(starts), errors + 1), first
            places.append(place)
            self.words.append(w)
            self.ids.append(item_id)
            self.offsets.append(offs)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if hashes:
            h, length, place = np.concatenate(hashes), np.concatenate(sizes), np.concatenate(places)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                mine = mine[np.argsort(h[mine], kind="stable")]
                there = np.zeros(1 << 20, bool)
                there[h[mine] >> np.uint64(44)] = True
                self.tables[int(n)] = (h[mine], place[mine], there)
            self.up, self.down = _powers(_BASE, _SLICE + max(_LENGTHS)), _powers(_INVERSE, _SLICE + max(_LENGTHS))

    def hits(self, stream: str) -> Iterator[tuple[int, np.ndarray]]:
        """(position, places) of the windows of a stream whose hash is that of some pieces. Long streams go in slices that overlap."""
        codes = _codes(stream)
        for begin in range(0, len(codes), _SLICE):
            part = codes[begin : begin + _SLICE + max(_LENGTHS) - 1]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * self.up[: len(part)])])
            for n, (hashes, places, there) in self.tables.items():
                count = min(len(part) - n + 1, _SLICE)
                if count < 1:
                    continue
                h = (total[n : n + count] - total[:count]) * self.down[:count]
                at = np.flatnonzero(there[h >> np.uint64(44)])
                lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
                for k in np.flatnonzero(hi > lo):
                    yield begin + int(at[k]), places[lo[k] : hi[k]]

    def found(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(index of the text, item id) of the texts that hold a passage."""
        if not self.tables:
            return []
        out: set[tuple[int, int]] = set()
        chunk: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            if text:
                chunk.append((k, folded(text)))
                size += len(chunk[-1][1])
            if chunk and (size >= _SLICE or k + 1 == len(texts)):
                out |= self._search(chunk)
                chunk, size = [], 0
        return sorted(out) if not chunk else sorted(out | self._search(chunk))

    def _search(self, chunk: list[tuple[int, str]]) -> set[tuple[int, int]]:
        streams = [s for _, s in chunk]
        starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in streams])])
        found: set[tuple[int, int]] = set()
        tried: set[tuple[int, int, int, int]] = set()
        for position, places in self.hits("\0".join(streams)):
            d = int(np.searchsorted(starts, position, "right")) - 1
            begin = position - int(starts[d])
            for n, start, piece_word in places.tolist():
                if (d, n) in found:
                    continue
                offs = self.offsets[n]
                at = begin - int(offs[piece_word] - offs[start])
                if (d, n, start, at) in tried:
                    continue
                tried.add((d, n, start, at))
                if self._verify(streams[d], n, start, at):
                    found.add((d, n))
        return {(chunk[d][0], self.ids[n]) for d, n in found}

    def _verify(self, stream: str, n: int, start: int, at: int) -> bool:
        w = self.words[n][start : start + self.span]
        size = self.offsets[n][start + self.span] - self.offsets[n][start]
        pattern = "".join(w)
        if at >= 0 and stream.startswith(pattern, at):
            return True
        lo, hi = max(0, at - self.errors), at + size + self.errors
        region = stream[lo:hi]
        if len(region) < size - self.errors:
            return False
        missing = 0  # an edit spoils one pair of words at most, so more missing pairs than errors rule the passage out
        for k in range(0, self.span - 1, 2):
            missing += w[k] + w[k + 1] not in region
            if missing > self.errors:
                return False
        ends = myers(pattern, region)
        best = min(ends)
        if best > self.errors:
            return False
        end = ends.index(best) + 1
        back = myers(pattern[::-1], region[:end][::-1])
        return _words_hold(w, region[end - 1 - back.index(min(back)) : end])


#: The passages that this worker has built, by the set that they are of.
_BUILT: dict[tuple, Passages] = {}


def _passages(shared, words: int, errors: int) -> Passages:
    key, items = shared.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Passages(items, words, errors)
    return _BUILT[key]


def leaked_items(documents: DataFrame, items: DataFrame, words: int = 20, errors: int = 2, most_words: int = 500_000) -> DataFrame:
    """(doc_id, item_id): every document and item such that the text holds ``words`` successive words of the item.

    ``documents`` has doc_id and text, ``items`` item_id and text; other columns aren't read. Repeated rows of either count
    once; null and empty texts hold nothing, items of fewer words are held by nothing; empty tables give no rows. Letters of every
    script count; in scripts written without blanks each character is a word.

    The held-out items are the small side by their nature; their size is checked, and beyond ``most_words`` they are taken in as
    many sets, each set one pass over the documents, so no item is left out. What a worker holds is bounded by that: a word
    costs errors + 1 pieces of 20 bytes and itself. Documents are read whole, and nothing but hits is shuffled.
    """
    context = documents.sparkSession.sparkContext
    held = items.select("item_id", "text").where("text is not null").distinct()
    # characters bound the words, in scripts without blanks too
    size = held.agg(F.sum(F.greatest(F.octet_length("text") / 6, F.when(F.col("text").rlike(rf"[{_UNSPACED_JAVA}]"), F.length("text")).otherwise(0)))).first()[0] or 0
    sets = max(1, -(-int(size) // most_words))
    rows = documents.select("doc_id", "text").where("text is not null")
    out = None
    for k in range(sets):
        part = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == k).collect()
        items_of_set = context.broadcast(((context.applicationId, id(part), k, sets, len(part)), [(r[0], r[1]) for r in part]))

        def run(batches: Iterable[pa.RecordBatch], shared=items_of_set) -> Iterator[pa.RecordBatch]:
            passages = _passages(shared, words, errors)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = passages.found(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in found], batch.schema.field(0).type), pa.array([i for _, i in found], pa.int64())], ["doc_id", "item_id"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        hits = rows.mapInArrow(run, f"doc_id {kind}, item_id bigint")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()
