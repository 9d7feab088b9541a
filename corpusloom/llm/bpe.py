"""Encoding with a public byte-level BPE tokenizer: length-bucketed padded numpy matrices.

The distinct pieces of a batch of texts are the rows. Each round looks every neighbouring pair up in a hash table, finds each
row's leftmost pair of minimum rank, merges it, and closes the gap; rows without a pair are done and leave the matrix.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: how the tokenizer's documentation cuts a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int32(2**30)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PairTable:
    """Open-addressing hash table from a pair of ids to (rank, merged id), looked up for whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, _NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        rank = np.arange(len(keys), dtype=np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            s = slot[todo]
            free = self.keys[s] < 0
            _, first = np.unique(np.where(free, s, -1 - todo), return_index=True)
            placed = first[free[first]]
            at = s[placed]
            self.keys[at], self.rank[at], self.merged[at] = keys[todo[placed]], rank[todo[placed]], merged[todo[placed]]
            rest = np.ones(len(todo), bool)
            rest[placed] = False
            todo = todo[rest]
            slot[todo] = ((slot[todo].astype(np.uint64) + np.uint64(1)) & self.mask).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        rank = np.full(keys.shape, _NONE, np.int32)
        merged = np.zeros(keys.shape, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            s = slot.flat[todo]
            hit = self.keys[s] == keys.flat[todo]
            rank.flat[todo[hit]], merged.flat[todo[hit]] = self.rank[s[hit]], self.merged[s[hit]]
            go = ~hit & (self.keys[s] >= 0)
            todo = todo[go]
            if not len(todo):
                break
            slot.flat[todo] = ((s[go].astype(np.uint64) + np.uint64(1)) & self.mask).astype(np.int64)
        return rank, merged


#: Pieces of more bytes than this are merged one by one.
_LONG = 4096


class ByteBPE:
    """A byte-level BPE tokenizer read from a vocabulary file in JSON, with merges in order of rank."""

    def __init__(self, path: str, known: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int32)
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.table = PairTable(left, right, np.array([vocab[a + b] for a, b in pairs], np.int32))
        self.cut = regex.compile(PIECES).findall
        self.known, self.cache = known, {}
        self._pairs, self._listed = (left, right, np.array([vocab[a + b] for a, b in pairs], np.int64)), None

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; pieces go into matrices of like length (8, 16, 32, ... columns)."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > _LONG:
                out[i] = self._queue(p)
                continue
            buckets.setdefault(max(8, 1 << (len(p) - 1).bit_length()) if p else 0, []).append(i)
        for width, rows in buckets.items():
            if width:
                step = max(1, (1 << 20) // width)
                for k in range(0, len(rows), step):
                    self._matrix([pieces[i] for i in rows[k : k + step]], rows[k : k + step], width, out)
        return out

    def _queue(self, piece: bytes) -> list[int]:
        """Ids of a very long piece, merge by merge from a queue of its pairs by rank and place: a matrix takes a round of its whole width
        for each merge of its longest row, this the logarithm of its length."""
        if self._listed is None:
            left, right, new = (x.tolist() for x in self._pairs)
            self._listed = {(a, b): (k, c) for k, (a, b, c) in enumerate(zip(left, right, new, strict=True))}
        ids, n = self.first[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(got[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (got := self._listed.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = self._listed[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (got := self._listed.get((ids[x], ids[y]))):
                    heapq.heappush(queue, (got[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def _matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list[list[int]]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        length = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < length[:, None], self.first[raw], -1).astype(np.int32)
        where = np.array(rows)
        rank, merged = self.table.look_up(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(ids):
            at = rank.argmin(axis=1)
            r = np.arange(len(ids))
            live = rank[r, at] < _NONE
            for i, k in zip(np.flatnonzero(~live), length[~live], strict=True):
                out[where[i]] = ids[i, :k].tolist()
            if not live.all():
                ids, where, length, at, rank, merged = ids[live], where[live], length[live], at[live], rank[live], merged[live]
                r = np.arange(len(ids))
                if not len(ids):
                    break
            new = merged[r, at]
            moved = columns > at[:, None]
            take = np.minimum(columns + moved, ids.shape[1] - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[r, at] = new
            length = length - 1
            ids[r, length] = -1
            pair = np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), ids.shape[1] - 2)
            rank, merged = np.take_along_axis(rank, pair, 1), np.take_along_axis(merged, pair, 1)
            for d in (-1, 0):  # only the two pairs beside the merged id are new
                c = np.clip(at + d, 0, ids.shape[1] - 2)
                rank[r, c], merged[r, c] = self.table.look_up(ids[r, c], ids[r, c + 1])
            rank[r, -1] = np.where(length >= ids.shape[1], rank[r, -1], _NONE)
            top = int(length.max())
            if top * 2 <= ids.shape[1] and top >= 4:  # compaction of columns that no row uses any more
                ids, rank, merged, columns = ids[:, : top + 1], rank[:, :top], merged[:, :top], columns[: top + 1]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, as ordinary text throughout (no special tokens); empty and null texts have none."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.cache) > self.known:
            self.cache = {}
        fresh = list(set(chain.from_iterable(cut)).difference(self.cache))
        self.cache.update(zip(fresh, self.merge([p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True))
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cut]


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """(key, ids) for every row of ``documents``, in place: no shuffle, no dedupe of rows.

    Null and empty texts have an empty list; repeated rows stay; an empty table gives none; other columns aren't read.
    ``folder`` holds the vocabulary files (default: the environment's TOKENIZERS, else /opt/tokenizers) and must be the same
    on all executors. The pieces a worker has met are kept up to a fixed number, so memory doesn't grow with the corpus.
    """
    path = os.path.join(folder or os.environ.get("TOKENIZERS", "/opt/tokenizers"), vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                ids = bpe.encode(part.column(1).to_pylist())
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
