"""Fill-in-middle: texts cut in three at unit borders and put together in another order.

A unit is a run of ASCII letters or any other single character. Units are found without looking at characters one by one:
the UTF-8 bytes are viewed as 64-bit words, arithmetic on a word marks those of its eight bytes that end a unit, and the
marks of each word are counted. The k-th border is then found by a search in the running counts and, within the one word
that holds it, by taking off the lowest marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm import words as W

#: What stands before the prefix, suffix and middle in a text put together.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits that are worked on in one go.
BLOCK = 1 << 17

_ONE = 0x0101010101010101
_HIGH = np.uint64(0x80 * _ONE)
_LOW = np.uint64(0x7F * _ONE)
_CASE = np.uint64(0x20 * _ONE)
_FROM_A = np.uint64((0x80 - ord("a")) * _ONE)
_PAST_Z = np.uint64((0x80 - ord("z") - 1) * _ONE)


def letters(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is an ASCII letter. No sum leaves its byte, since both parts are below 0x80."""
    low = (x & _LOW) | _CASE
    return (low + _FROM_A) & ~(low + _PAST_Z) & ~x & _HIGH


def trailing(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte 10xxxxxx, which goes on with a character."""
    return x & ~(x << np.uint64(1)) & _HIGH


def following(marks: np.ndarray) -> np.ndarray:
    """For every byte the mark of the byte after it; the last byte of all has none after it."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def ends(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte with which a unit ends: the character is over, and no run of letters goes on."""
    letter = letters(x)
    return ~following(trailing(x)) & ~(letter & following(letter)) & _HIGH


def up_to(marks: np.ndarray, n_bytes: int) -> np.ndarray:
    """Marks of the first n_bytes bytes alone."""
    marks = marks[: -(-n_bytes // 8)]
    if n_bytes % 8:
        marks[-1] &= np.uint64((1 << 8 * (n_bytes % 8)) - 1)
    return marks


class Units:
    """Units of one UTF-8 text: how many, and where the k-th ends."""

    def __init__(self, text: bytes):
        self.n_bytes = len(text)
        self.x = np.frombuffer(text + bytes(-len(text) % 8 + 8), np.dtype("<u8"))  # ends with a word of zeros
        found = [np.bitwise_count(up_to(ends(self.x[a : a + BLOCK + 1])[:BLOCK], min(8 * BLOCK, self.n_bytes - 8 * a))) for a in range(0, -(-self.n_bytes // 8), BLOCK)]
        self.before = np.concatenate(([0], np.cumsum(np.concatenate(found), dtype=np.int64))) if found else np.zeros(1, np.int64)

    @property
    def n(self) -> int:
        return int(self.before[-1])

    def border(self, k: int) -> int:
        """Bytes of the first k units, 0 <= k <= n."""
        if not k:
            return 0
        word = int(np.searchsorted(self.before, k)) - 1
        marks = int(ends(self.x[word : word + 2])[0])
        for _ in range(k - int(self.before[word]) - 1):
            marks &= marks - 1
        return 8 * word + (marks & -marks).bit_length() // 8

    def characters(self, n_bytes: int) -> int:
        """Characters that begin in the first n_bytes bytes."""
        return sum(int(np.bitwise_count(up_to(~trailing(self.x[a : min(a + BLOCK, -(-n_bytes // 8))]) & _HIGH, min(8 * BLOCK, n_bytes - 8 * a))).sum()) for a in range(0, -(-n_bytes // 8), BLOCK))


@dataclass(frozen=True)
class Made:
    """One text's form (plain, psm or spm), its parts' sizes in characters and what came out, as UTF-8."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def arrange(text: bytes, doc_id: int | None, seed: int = 1, changed_percent: int = 90, suffix_first_percent: int = 20) -> Made:
    """The text as its id's hash decides: the digest's first four 32-bit numbers give two borders, whether the text is changed and its form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    units = Units(text)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or p in text or s in text or m in text or h3 % 100 >= changed_percent:
        return Made(units.n, "plain", None, None, text)
    i, j = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.border(i), units.border(j)
    if h4 % 100 < suffix_first_percent:
        form, output = "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    else:
        form, output = "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    prefix = units.characters(a)
    return Made(units.n, form, prefix, units.characters(b) - prefix, output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, changed_percent: int = 90, suffix_first_percent: int = 20) -> DataFrame:
    """Per row: id, n (units), form, prefix_chars, middle_chars (null where plain) and output, the text put together.

    A null text counts as empty. Empty texts and those that hold a mark stay plain. A null id is hashed as an empty string;
    repeated rows come out equal. Only the id and the text are read, whatever else the table holds, and an empty table
    gives an empty result. A row needs memory for a few copies of its own text.
    """
    kind = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column(1)):
                ids, cuts = batch.column(0).slice(a, b - a), offsets.tolist()
                made = [arrange(data[x:y].tobytes(), i, seed, changed_percent, suffix_first_percent) for i, x, y in zip(ids.to_pylist(), cuts, cuts[1:], strict=False)]
                columns = [pa.array([getattr(m, f.name) for m in made], f.type) for f in list(kind)[1:-1]]
                yield pa.RecordBatch.from_arrays([ids, *columns, pa.array([m.output for m in made], pa.binary()).cast(pa.string())], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(W.releasing(run), "id long, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The text from which transform() made an output; null where either is null. Changed texts hold every mark once, so the marks part them."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
