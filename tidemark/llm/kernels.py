"""Array kernels over the text column of an Arrow batch: code points, words, pre-tokens, hashes.

All work is on whole slices of a batch at once, so no Python code runs per character
or per word.  Nothing here depends on Spark.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Slice:
    """Consecutive rows of a batch as one string; row i is text[bounds[i]:bounds[i+1]]."""

    first: int
    text: str
    points: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, limit: int = 1 << 20, errors: str = "replace") -> Iterator[Slice]:
    """Cut a string column into runs of rows of about `limit` bytes; null counts as empty.

    A row longer than the limit is a slice of its own and is never split.  Bytes that aren't UTF-8 become replacement
    signs, or a code point of their own each with `errors` "surrogateescape", by which they can be had back.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = column.slice(first, last - first)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        raw = memoryview(part.buffers()[2] or b"")[offsets[0] : offsets[-1]]
        try:
            text = str(raw, "utf-8")
            lengths = pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
            if int(lengths.sum()) != len(text):
                raise UnicodeDecodeError("utf-8", b"", 0, 1, "lengths differ")
        except UnicodeDecodeError:  # Spark strings may hold bytes that aren't UTF-8
            offs = (offsets - offsets[0]).tolist()
            rows = [str(raw[a:b], "utf-8", errors) for a, b in zip(offs, offs[1:])]
            text, lengths = "".join(rows), np.array([len(x) for x in rows], np.int64)
        bounds = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        yield Slice(first, text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), bounds)
        first = last


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point, by the Unicode tables of the `regex` library."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{N}+", NUMBER), (r"\p{L}+", LETTER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if b - a + 1 != m.end() - m.start():  # the run steps over the surrogates
                found[a:0xD800] = kind
                a = 0xE000
            found[a : b + 1] = kind
    return found


@functools.cache
def lower_table() -> np.ndarray:
    """The lower case of each code point, where that is a single code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1E944):
        x = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
        if len(x) == 1:
            out[c] = ord(x)
    return out


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, p in ((0, _P), (1, _P_INV)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def span_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each points[start:end] that depends on its content alone."""
    power, inverse = _power_tables(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    values = (points.astype(np.uint64) + np.uint64(1)) * _M3
    values ^= values >> np.uint64(29)
    values *= power[: len(points)]
    np.cumsum(values, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def _previous(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.empty_like(mask)
    if len(mask):
        out[0] = False
        out[1:] = mask[:-1]
        at = bounds[:-1]
        out[at[at < len(mask)]] = False
    return out


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True within rows."""
    start = np.flatnonzero(mask & ~_previous(mask, bounds))
    following = np.zeros_like(mask)
    following[:-1] = mask[1:]
    at = bounds[1:]
    following[at[at > 0] - 1] = False
    return start, np.flatnonzero(mask & ~following) + 1


def words(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs of letters and numbers), and the row of each."""
    points = lower_table()[part.points]
    kind = classes()[points]
    start, end = runs((kind == LETTER) | (kind == NUMBER), part.bounds)
    return span_hashes(points, start, end), np.searchsorted(part.bounds, start, side="right") - 1


def pretoken_starts(part: Slice) -> np.ndarray:
    """Where the pre-tokens of the byte-level BPE pattern start, over the whole slice.

    The pattern takes contractions, then letters, numbers or other signs with one
    space before them, then white space up to, but not with, a last sign before text.
    """
    points, bounds = part.points, part.bounds
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    before_text = np.zeros(n, bool)  # a white-space sign directly before text of the same row
    before_text[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    at = np.flatnonzero(before_text)
    start[at] = True
    start[at[points[at] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        row_end = bounds[np.searchsorted(bounds, quote, side="right")]
        pad = np.concatenate([points, np.zeros(3, np.uint32)])
        a = np.where(quote + 1 < row_end, pad[quote + 1], 0)
        b = np.where(quote + 2 < row_end, pad[quote + 2], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, length in ((one, 2), (two, 3)):
            q, e = quote[hit], row_end[hit]
            start[q + 1] = False
            go_on = q + length < e
            start[q[go_on] + length] = True
    return np.flatnonzero(start)


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i]+lengths[i]-1 for all i, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(offsets - before, lengths) + np.arange(total)
