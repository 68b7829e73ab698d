"""The scan kernel: multi-pattern match over chunks, prechecks, and structure walks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions.registry import SIGNATURES
from ..functions.view import View

MB = 1 << 20
CHUNK = 32 * MB


@dataclass(frozen=True)
class Options:
    """Knobs of a carve. ``parity`` reproduces quirks of the original behaviour (chunk-bound mp4 loss and the walkers')."""

    types: tuple[str, ...] = tuple(SIGNATURES)
    chunk_size: int = CHUNK
    align: int = 1
    skip_carved: bool = True
    min_size: int = 0
    max_size: int = 0
    start: int = 0
    length: int = 0
    dedup: bool = True
    skip_blank: bool = True
    parity: bool = False
    on_corrupt: str = "fail"  # an EWF chunk that does not decode: "fail", or "skip" (it reads as zeros and is counted)

    def end(self, size: int) -> int:
        return min(self.start + self.length, size) if self.length else size


_SIZE = re.compile(r"\s*(\d+)([KMGkmg]?)\s*")


def parse_size(text: str) -> int:
    """A size literal: digits and at most one of K, M, G (powers of 1024)."""
    m = _SIZE.fullmatch(text)
    if not m:
        raise ValueError(f"not a size: {text}")
    value = int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]
    if value >= 1 << 63:
        raise ValueError(f"not a size: {text} is too large")
    return value


class Matcher:
    """Leftmost-longest, non-overlapping matches of all selected magics in a buffer.

    Three byte translations leave the places whose first bytes may begin a magic (a bit for each group of
    magics); only those are tried.
    """

    STRIDE, GROUPS = 1 << 18, 8

    def __init__(self, types: tuple[str, ...]) -> None:
        self.owners: dict[bytes, list[str]] = {}
        for name in types:
            for magic in SIGNATURES[name].magics:
                self.owners.setdefault(magic, []).append(name)
        self.longest = max(map(len, self.owners))
        # alternatives in order of length: the first that matches is the longest
        self.pattern = re.compile(b"|".join(re.escape(m) for m in sorted(self.owners, key=len, reverse=True)), re.DOTALL)
        heads = sorted({m[:3] for m in self.owners})
        masks = np.zeros((3, 256), np.uint8)
        for k, head in enumerate(heads):
            for place in range(3):
                masks[place, head[place] if place < len(head) else slice(None)] |= 1 << k * self.GROUPS // len(heads)
        self.masks = [row.tobytes() for row in masks]

    def matches(self, buf: bytes) -> Iterator[tuple[int, bytes]]:
        after = 0
        for s in range(0, len(buf), self.STRIDE):
            part = buf[s : s + self.STRIDE + 2]
            n = min(self.STRIDE, len(part))
            if len(part) < n + 2:
                part += b"\0\0"
            hit, second, third = (np.frombuffer(part.translate(m), np.uint8)[k : k + n] for k, m in enumerate(self.masks))
            hit = np.append(hit & second & third, np.zeros(-n % 8, np.uint8))
            words = np.flatnonzero(hit.view(np.uint64))
            places = (8 * words[:, None] + np.arange(8)).ravel()
            for k in places[hit[places] > 0].tolist():
                m = self.pattern.match(buf, s + k) if s + k >= after else None
                if m:
                    after = m.end()
                    yield s + k, m[0]


@dataclass
class Candidate:
    """``size`` 0: a candidate that was tried and rejected. ``hidden``: the last magic that was put off behind this one
    (it starts inside this validated carve and comes after it), null if there is none."""

    ord: int  # place of the magic: the order of processing
    type: str
    offset: int
    size: int
    ext: str
    validated: bool
    hidden: int | None = None


@dataclass
class Tally:
    """What a scan passed over: bytes of blank chunks, and source chunks that could not be decoded."""

    blank_bytes: int = 0
    corrupt: int = 0


def scan_chunk(source, options: Options, matcher: Matcher, base: int, tally: Tally, outer: list[Candidate], after: int = -1, upto: int | None = None) -> Iterator[Candidate]:
    """Walked candidates whose magic lies in the chunk at ``base``. Chunks are disjoint, so each is found once.

    ``outer`` holds the last validated carve: candidates that start inside it are put off, not walked, and noted in its
    ``hidden``. Only magics behind ``after`` and up to ``upto`` count.
    """
    end = options.end(source.size)
    limit = min(options.chunk_size, end - base)
    back = 0 if options.parity else min(4, base)
    buf = source.pread(base - back, back + limit + matcher.longest - 1 + 4)
    if options.skip_blank and not buf[back : back + limit].strip(b"\0"):
        tally.blank_bytes += limit
        return
    look = buf[back:]
    for i, magic in matcher.matches(look):
        if i >= limit or (upto is not None and base + i > upto):
            break
        if base + i <= after:
            continue
        for name in matcher.owners[magic]:
            sig = SIGNATURES[name]
            start = base + i - sig.header_offset
            if start < options.start or (options.align > 1 and start % options.align):
                continue
            if sig.precheck and not sig.precheck(buf, i + back):
                continue
            if outer and start < outer[0].offset + outer[0].size:
                outer[0].hidden = base + i
                continue
            cap = min(sig.max_size, end - start, *([options.max_size] if options.max_size else []))
            found = sig.walk(View(source.pread, source.size, start, cap), options.parity) if cap > 0 else None
            size = min(found.size, source.size - start) if found else 0
            if start + size > end and not options.parity:  # past a range that ends before the source does
                size = 0 if found.validated else end - start
            if size < max(options.min_size, 1):
                yield Candidate(base + i, name, start, 0, "", False)
                continue
            now = Candidate(base + i, name, start, size, found.ext, found.validated)
            if options.skip_carved and found.validated:
                outer[:] = [now]
            yield now
            break


def _settled(found: Iterator[Candidate], outer: list[Candidate]) -> Iterator[Candidate]:
    """``found`` with each validated carve given out only when it is known what it hides."""
    held = None
    for c in found:
        if not (outer and outer[0] is c):
            yield c
            continue
        if held:
            yield held
        held = c
    if held:
        yield held


def scan(source, options: Options, first: int = 0, chunks: int | None = None, tally: Tally | None = None) -> Iterator[Candidate]:
    """The candidates of ``chunks`` chunks of the grid, from the ``first``-th on, rejected ones too.

    With ``skip_carved`` what starts inside an earlier validated carve of the range is not walked, so a file with many
    nested headers is walked once. The selection asks for it again (``rescan``) if the outer carve is itself dropped.
    """
    tally = tally if tally is not None else Tally()
    matcher, outer = Matcher(options.types), []
    end = options.end(source.size)
    low = options.start + first * options.chunk_size
    high = end if chunks is None else min(end, low + chunks * options.chunk_size)

    def every() -> Iterator[Candidate]:
        for base in range(low, high, options.chunk_size):
            yield from scan_chunk(source, options, matcher, base, tally, outer)

    yield from _settled(every(), outer)
    # each belongs to the task whose range it begins in
    tally.corrupt += sum(low <= k * source.chunk_size < high for k in getattr(source, "bad", ()))


def rescan(source, options: Options, after: int, upto: int, below: int) -> Iterator[Candidate]:
    """Candidates that a dropped carve hid: magics behind ``after``, up to ``upto``, that start below ``below``."""
    matcher, outer = Matcher(options.types), []

    def every() -> Iterator[Candidate]:
        base = options.start + (after - options.start) // options.chunk_size * options.chunk_size
        while base <= upto:
            for c in scan_chunk(source, options, matcher, base, Tally(), outer, after, upto):
                if c.offset < below:
                    yield c
            base += options.chunk_size

    yield from _settled(every(), outer)
