"""Several values packed in one field: one row per value, place kept.

A finite-state tokenizer reads each field once. Its state is the open quote, the nesting depth and whether the current
value has begun; a delimiter ends a value only outside quotes and outside brackets that opened inside a value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Delimiters, quotes with their closing mark, and brackets, in natural order.
DELIMITERS = "\t\n\r,/;|；，、"
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}


def split_packed(text: str | None, delimiters: str = DELIMITERS) -> list[str]:
    """The values of one field in order.

    * A quote opens only at the start of a value, so an apostrophe inside a word is a plain character; a doubled closing
      mark inside quotes, or one after a backslash, is given once.
    * A bracket at the start of a value that reaches to the end of the field (or of the enclosing list) only encloses:
      the values inside count on. A bracket opened inside a value belongs to it, and delimiters up to its end do too.
    * Blanks around values are dropped; empty places are not values. Null gives no value.
    * An unclosed quote or bracket is read as a plain character, so nothing after it is swallowed.
    """
    if not text:
        return []
    out: list[str] = []
    i, n = 0, len(text)
    enclosing: list[str] = []
    closing = _closings(text, delimiters) if any(c in text for c in BRACKETS) else {}
    while i < n:
        c = text[i]
        if c in delimiters or c.isspace():
            i += 1
        elif enclosing and c == enclosing[-1]:
            enclosing.pop()
            i += 1
        elif i in closing and _at_end(text, closing[i] + 1, delimiters):
            enclosing.append(BRACKETS[c])
            i += 1
        else:
            value, i = _value(text, i, delimiters, enclosing)
            if value:
                out.append(value)
    return out


def _quoted(text: str, i: int) -> tuple[str, int] | None:
    """The content of the quote that opens at i and the place behind it; None if it is never closed."""
    close, part, k, n = QUOTES[text[i]], [], i + 1, len(text)
    while k < n:
        c = text[k]
        if c == "\\" and k + 1 < n and text[k + 1] in (close, "\\"):
            part.append(text[k + 1])
            k += 2
        elif c == close:
            if k + 1 < n and text[k + 1] == close:
                part.append(close)
                k += 2
            else:
                return "".join(part), k + 1
        else:
            part.append(c)
            k += 1
    return None


def _at_end(text: str, k: int, delimiters: str) -> bool:
    """Whether a value may end at k: a delimiter, a closing bracket or the end follows, blanks aside."""
    while k < len(text) and text[k].isspace() and text[k] not in delimiters:
        k += 1
    return k >= len(text) or text[k] in delimiters or text[k] in BRACKETS.values()


def _closings(text: str, delimiters: str) -> dict[int, int]:
    """The place of the closing bracket of each opening one, quotes that begin a value skipped; one pass over the text."""
    pairs: dict[int, int] = {}
    open_at: list[int] = []
    k, fresh = 0, True
    while k < len(text):
        c = text[k]
        if fresh and c in QUOTES and (q := _quoted(text, k)):
            k, fresh = q[1], False
            continue
        if c in BRACKETS:
            open_at.append(k)
        elif open_at and c == BRACKETS[text[open_at[-1]]]:
            pairs[open_at.pop()] = k
        fresh = c in delimiters or c.isspace() or c in BRACKETS
        k += 1
    return pairs


def _value(text: str, i: int, delimiters: str, enclosing: list[str]) -> tuple[str, int]:
    if text[i] in QUOTES and (q := _quoted(text, i)) and _at_end(text, q[1], delimiters):
        return q[0].strip(), q[1]
    start, depth, n = i, [], len(text)
    while i < n:
        c = text[i]
        if depth and c == depth[-1]:
            depth.pop()
        elif not depth and (c in delimiters or enclosing and c == enclosing[-1]):
            break
        elif c in BRACKETS and text.find(BRACKETS[c], i) > 0:
            depth.append(BRACKETS[c])
        i += 1
    return text[start:i].strip(), i


def unpack_values(df: DataFrame, key: str, field: str, delimiters: str = DELIMITERS, position: str = "pos", value: str = "value") -> DataFrame:
    """One row (key, position, value) for each value of ``field``.

    Equal rows of (key, field) count once, rows with null fields and with fields of blanks and delimiters give nothing,
    an empty table gives an empty table, and further columns of ``df`` are not read, whatever their names. Only the
    distinct packed strings of a batch are tokenized, in Arrow batches; nothing is gathered by key, so a key or a string
    that holds a third of all rows stays spread over the tasks that read it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            values = [split_packed(s, delimiters) for s in coded.dictionary.to_pylist()]
            rows = [values[k] if k is not None else [] for k in coded.indices.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["k", "v"])

    kind = df.schema[key].dataType.simpleString()
    packed = df.select(F.col(key).alias("k"), F.col(field).alias("f")).where(F.col("f").isNotNull()).distinct()
    lists = packed.mapInArrow(run, f"k {kind}, v array<string>")
    return lists.select(F.col("k").alias(key), F.posexplode("v").alias("p", value)).select(key, (F.col("p") + 1).cast("int").alias(position), value)
