"""Vectorised byte-level text tools shared by the operators of this subpackage.

An Arrow string column is one run of UTF-8 bytes with offsets. Everything here works
on that run at once with numpy, so a batch of documents costs a handful of array
passes instead of Python work for every word. Every eight bytes go through a finaliser
before they are joined to others, so no regularity of the text cancels out, as it does in
polynomial hashes modulo 2**64 (Thue-Morse words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP, _SIZE, _OTHER = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0x5851F42D4C957F2D)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

#: Bytes at which words end: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads polynomial hashes over all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; past the end come zeros."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def slices(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, check) of each slice [start, end). The check is the slice itself where it has
    eight bytes at most, else a second hash; equal hash, check and size: equal slices."""
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, U64)
    size, eight = end - start, eights(raw)
    check = eight[start] & _MASK[np.minimum(size, 8)]
    total = mix(check + _STEP)
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) // 8  # further chunks of eight bytes
        first = np.cumsum(n) - n
        row = np.repeat(long, n)
        step = np.arange(len(row)) - np.repeat(first, n) + 1
        chunk = eight[start[row] + 8 * step] & _MASK[np.minimum(size[row] - 8 * step, 8)]
        place = (step + 1).astype(U64)
        total[long] += np.add.reduceat(mix(chunk + place * _STEP), first)
        check[long] = mix(check[long] + _OTHER) + np.add.reduceat(mix((chunk ^ _OTHER) - place * _SIZE), first)
    return mix(total + size.astype(U64) * _SIZE), check


def windows(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` (eight at least) bytes, by doubling: len(raw) - size + 1 values."""
    n, part = len(raw) - size + 1, 1 << 15  # parts that stay in the cache
    if n <= 0:
        return np.zeros(0, U64)
    if n > part:
        return np.concatenate([windows(raw[k : min(k + part, n) + size - 1], size) for k in range(0, n, part)])
    now, width = mix(eights(raw)[: len(raw) - 7] + _STEP), 8
    while width < size:
        step = min(width, size - width)  # the halves overlap where the size isn't a power of two
        now = mix(now[:-step] * _SIZE + now[step:])
        width += step
    return now


def runs(hashed: np.ndarray, start: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Hash of each run of ``length`` (``most`` at most) values that are hashes already."""
    out = length.astype(U64) * _SIZE
    full = bool(len(length)) and int(length.min()) == most
    for k in range(most):
        if full:
            out = out * _STEP + hashed[start + k]
        else:
            at = np.flatnonzero(length > k)
            out[at] = out[at] * _STEP + hashed[start[at] + k]
    return mix(out)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = pa.large_binary()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(kind)
    elif column.type != kind:
        column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = 2 << 20):
    """Slices of a batch whose texts have about ``limit`` bytes at most (a longer text stands alone)."""
    _, off = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, min(end, batch.num_rows) - at)
        at = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each document: ``start``/``end`` byte positions in
    ``raw``, ``first``: index of each document's first word (n + 1 values)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = True):
        self.raw = LOWER[raw] if lower else raw
        n = len(raw)
        solid = np.zeros(n + 1, bool)
        solid[:n] = ~SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True  # words never cross documents
        before = np.zeros(n + 1, bool)
        before[1:] = solid[:n]
        self.start = np.flatnonzero(solid & (~before | edge))
        self.end = np.flatnonzero(before & (~solid | edge))
        self.first = np.searchsorted(self.start, off)
        self.off = off

    def hashes(self) -> np.ndarray:
        return slices(self.raw, self.start, self.end)[0]


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of every run of ``size`` words; a document with fewer words
    gives its whole sequence, one without words nothing. Repeats are not removed."""
    hashed = words.hashes()
    n_words = np.diff(words.first)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n_words)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = words.first[:-1][doc] + within
    return doc, runs(hashed, start, np.minimum(n_words, size)[doc], size)


def unique_per_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value), sorted by document, then value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]
