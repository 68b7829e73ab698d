"""Bounded, cached random access to one byte source, as the format walkers see it."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

STRIDE = 1 << 20


class View:
    """Bytes [base, base + limit) of a source; reads past the end are short, numbers past the end are 0."""

    BLOCK, KEPT, LONG = 1 << 16, 64, 8

    def __init__(self, pread: Callable[[int, int], bytes], size: int, base: int, limit: int) -> None:
        self.pread, self.base = pread, base
        self.limit = max(0, min(limit, size - base))
        self.blocks: OrderedDict[int, bytes] = OrderedDict()

    def _block(self, k: int) -> bytes:
        got = self.blocks.get(k)
        if got is None:
            got = self.pread(self.base + k * self.BLOCK, min(self.BLOCK, self.limit - k * self.BLOCK))
            self.blocks[k] = got
            if len(self.blocks) > self.KEPT:
                self.blocks.popitem(last=False)
        return got

    def read(self, at: int, n: int) -> bytes:
        end = min(at + n, self.limit)
        if at < 0 or at >= end:
            return b""
        first, last = at // self.BLOCK, (end - 1) // self.BLOCK
        if first == last:
            return self._block(first)[at - first * self.BLOCK : end - first * self.BLOCK]
        if last - first >= self.LONG:  # long reads run through the source and are seldom read again
            return self.pread(self.base + at, end - at)
        return b"".join(self._block(k) for k in range(first, last + 1))[at - first * self.BLOCK : end - first * self.BLOCK]

    def byte(self, at: int) -> int:
        got = self.read(at, 1)
        return got[0] if got else -1

    def _number(self, at: int, n: int, order: str) -> int:
        got = self.read(at, n)
        return int.from_bytes(got, order) if len(got) == n else 0

    def le(self, at: int, n: int) -> int:
        return self._number(at, n, "little")

    def be(self, at: int, n: int) -> int:
        return self._number(at, n, "big")

    def find(self, needle: bytes, start: int, end: int | None = None) -> int:
        """First place of ``needle`` wholly inside [start, end), or -1."""
        end = self.limit if end is None else min(end, self.limit)
        step = self.BLOCK // 4  # most needles are near, so the search begins short
        while start + len(needle) <= end:
            got = self.read(start, min(max(step, len(needle)), end - start))
            step = min(4 * step, STRIDE)
            k = got.find(needle)
            if k >= 0:
                return start + k
            if len(got) < len(needle):
                return -1
            start += len(got) - len(needle) + 1
        return -1

    def rfind(self, needle: bytes, start: int, end: int | None = None) -> int:
        """Last place of ``needle`` wholly inside [start, end), or -1."""
        end = self.limit if end is None else min(end, self.limit)
        while start + len(needle) <= end:
            low = max(start, end - STRIDE)
            k = self.read(low, end - low).rfind(needle)
            if k >= 0:
                return low + k
            if low == start:
                return -1
            end = low + len(needle) - 1
        return -1
