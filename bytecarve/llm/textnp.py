"""Vectorised text primitives on Arrow string columns: words, lines, span hashes, shingles.

Everything works on the UTF-8 bytes of a whole batch at once. A word is a maximal run of bytes
outside space and \\t..\\r, that is ``[^\\x20\\x09-\\x0D]+`` on code points as well, since those
separators are single bytes in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE_BYTES = 2 << 20
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_SEED = U64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * _M1
    h = h ^ (h >> U64(33))
    h = h * _M2
    return h ^ (h >> U64(33))


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, n+1 offsets and validity of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    valid = np.asarray(column.is_valid())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0], valid


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with about ``most`` bytes each (one longer document stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross a document: starts, ends, document."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    close = inside.copy()
    close[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(close) + 1, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _spans(~SPACE[buf], off)


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""The \n-split lines of every document, empty ones too: starts, ends (without \n), document."""
    cut = np.flatnonzero(buf == 10)
    owner = np.searchsorted(off, cut, side="right") - 1
    n = len(off) - 1
    starts = np.concatenate([off[:-1], cut + 1])
    ends = np.concatenate([off[1:], cut])
    doc = np.concatenate([np.arange(n), owner])
    order = np.lexsort((starts, doc))
    # a document's k-th line starts after its (k-1)-th cut and ends at its k-th cut or at its end
    ends_order = np.lexsort((ends, doc))
    return starts[order], ends[ends_order], doc[order]


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes of all spans per step."""
    lens = ends - starts
    h = lens.astype(U64) * _SEED
    if not len(starts):
        return h
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    window = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    at, left, where = starts, lens, None
    while True:
        w = window[at] & _MASK[np.minimum(left, 8)]
        if where is None:
            h = mix(h ^ w) * _SEED
        else:
            h[where] = mix(h[where] ^ w) * _SEED
        keep = np.flatnonzero(left > 8)
        if not len(keep):
            return mix(h)
        where = keep if where is None else where[keep]
        at, left = at[keep] + 8, left[keep] - 8


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside a document, and the index of each one's first word."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = h[:m].copy()
    for k in range(1, n):
        g *= _M2
        g += h[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(g[at]), at


def salted(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one document."""
    return mix(h ^ mix(doc.astype(U64) * _SEED + _SEED))


def repeated(h: np.ndarray) -> np.ndarray:
    """Flags the members of ``h`` that occur twice or more."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(h), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag
