"""Words of UTF-8 text and hashes of words and word windows, in numpy.

Everything works on the bytes of an Arrow string column as they are. A word is a
maximal run of bytes of a class, so classes that treat all non-ASCII bytes alike
never cut a character. Arrays over bytes are made for ``SLICE`` bytes at a time.

Word and window hashes are polynomials modulo 2**64, taken from one running sum:
with an odd base every power has an inverse, so a range of the sum is one
difference and one product.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table over the 256 bytes, true inside the (inclusive) ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but space and the ASCII controls tab to carriage return.
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Digits, letters and every byte of a non-ASCII character.
ALPHANUMERIC = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


#: A-Z like a-z.
FOLD_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE[0x41:0x5B] += 32


class Words(NamedTuple):
    data: np.ndarray  # the bytes
    texts: np.ndarray  # byte offsets of the texts, one more than texts
    starts: np.ndarray  # byte offsets of the words
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than texts
    hashes: np.ndarray


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def pieces(batches, column: str = "text", limit: int = 2 * SLICE):
    """The batches cut to rows of about ``limit`` bytes of ``column``; a longer text is a piece of its own."""
    for batch in batches:
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    if column.null_count:
        column = pc.fill_null(column, empty)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    where = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[where[0] : where[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, where - where[0]


def words_of(column: pa.Array | pa.ChunkedArray, is_word: np.ndarray, fold: np.ndarray | None = None, hashes: bool = True) -> Words:
    """The words of a column's texts. ``fold``: what each byte hashes like."""
    data, texts = bytes_of(column)
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    filled = texts[:-1][texts[1:] > texts[:-1]]
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[filled[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, texts)
    return Words(data, texts, starts, ends, first, hash_ranges(data, starts, [ends], fold)[0] if hashes else np.zeros(0, np.uint64))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: list[np.ndarray], fold: np.ndarray | None = None) -> list[np.ndarray]:
    """64-bit hashes of the byte ranges from ``starts`` to each of ``ends``, none beyond ``ends[0]``; both ascend."""
    values = _VALUES if fold is None else _VALUES[fold]
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends[0], low + SLICE, "right")))
        high = ends[0][to - 1]
        up, down = _powers(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=total[1:])
        s = starts[at:to] - low
        for one, end in zip(out, ends, strict=True):
            one[at:to] = (total[end[at:to] - low] - total[s]) * down[s]
        at = to
    return [mix(one) for one in out]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words, whatever text they are of."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = SLICE
    for at in range(0, n, step):
        part = hashes[at : at + step + size - 1]
        up, down = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - size + 1
        out[at : at + m] = (total[size:] - total[:-size]) * down[:m]
    return mix(out)


def inside_texts(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the ``n`` word positions start a window of ``size`` words of one text."""
    lasts = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(len(lasts)) + size <= lasts


def join_words(words: Words, keep: np.ndarray) -> pa.Array:
    """One text for each text: its kept words, joined by one space."""
    n = len(words.first) - 1
    lengths = (words.ends - words.starts + 1)[keep]
    begun = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.concatenate([[0], np.cumsum(keep)])[words.first]
    data = np.empty(begun[-1], np.uint8)
    starts = words.starts[keep]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(begun, begun[at] + SLICE, "right")) - 1)
        low, high = begun[at], begun[to]
        source = np.repeat(starts[at:to] - begun[at:to], lengths[at:to]) + np.arange(low, high)
        data[low:high] = words.data[np.minimum(source, len(words.data) - 1)]
        at = to
    data[begun[1:] - 1] = 0x20
    # The space after a text's last word is left out.
    tails = counts[1:][counts[1:] > counts[:-1]]
    solid = np.ones(len(data), bool)
    solid[begun[tails] - 1] = False
    offsets = begun[counts] - np.concatenate([[0], np.cumsum(counts[1:] > counts[:-1])])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[solid]))).cast(pa.string())
