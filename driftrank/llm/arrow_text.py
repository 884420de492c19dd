"""Arrow text columns as numpy byte buffers: batch slicing, words, shingle hashes.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``, so
multi-byte UTF-8 characters always stay whole.  All work is vectorised over
a slice of a batch; slices are bounded by bytes, one long text makes a slice
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LOW_BYTES = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [2**64 - 1], dtype=np.uint64)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_M3 = np.uint64(0x9E3779B97F4A7C15)
_S33, _S29 = np.uint64(33), np.uint64(29)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column as strings, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.string()), "")


def slices(batch: pa.RecordBatch, name: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``max_bytes`` of text (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
                     .to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls; offsets start at 0."""
    if len(col) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S29)
    x = x * _M2
    return x ^ (x >> _S33)


def word_spans(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per text the range of its words."""
    space = _SPACE[raw]
    n = len(raw)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(off), dtype=np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True                      # texts never run into each other
    starts = ~space
    starts[1:] &= space[:-1] | first[1:n]
    ends = ~space
    ends[:-1] &= space[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time."""
    n = ends - starts
    h = mix(n.astype(np.uint64) * _M3)
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    live, k = np.arange(len(n)), 0
    while len(live):
        block = eight[starts[live] + k] & _LOW_BYTES[np.minimum(n[live] - k, 8)]
        h[live] = mix((h[live] ^ block) * _M3)
        k += 8
        live = live[n[live] > k]
    return h


def shingle_sets(col: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A-Z count as a-z.  A text of fewer words, but not none, has its whole
    word sequence as the one shingle; without words the set is empty.
    """
    off, raw = utf8(col)
    raw = _LOWER[raw]
    starts, ends, at = word_spans(off, raw)
    h = word_hashes(raw, starts, ends)
    out: list[np.ndarray] = []
    if len(h) >= width:
        rolled = h[:len(h) - width + 1].copy()
        for k in range(1, width):
            rolled = mix(rolled * _M3 + h[k:len(h) - width + 1 + k])
    empty = np.zeros(0, dtype=np.uint64)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo:hi - width + 1]))
        elif hi > lo:
            x = h[lo:lo + 1].copy()
            for k in range(lo + 1, hi):
                x = mix(x * _M3 + h[k])
            out.append(mix(x + np.uint64(hi - lo)))
        else:
            out.append(empty)
    return out
