"""Token ids of whole texts by the public tokenizers, over a cache of text pieces.

The tokenizers' splitting never looks across certain ASCII white space, so a text's ids are those of its
pieces in a row. Pieces of a whole batch are cut and hashed in numpy; the tokenizers library encodes each
piece that is not in the worker's cache, many at a time. Texts with rarer white space or control
characters, on which pieces might depend on each other, are encoded whole.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np

from . import textnp as T

U64 = np.uint64
#: Pieces that a worker keeps; a fuller cache starts anew. Bounds memory, not results.
CACHE_PIECES = 1_000_000
#: Pieces longer than this are not cached one by one but encoded directly.
_SEPARATOR = "\x1d"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def _odd(buf: np.ndarray) -> np.ndarray:
    """Places of control characters 1C..1F and of white space outside ASCII."""
    lead = np.flatnonzero(((buf >= 0x1C) & (buf <= 0x1F)) | (buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
    if not len(lead):
        return lead
    pad = np.concatenate([buf, np.zeros(2, np.uint8)])
    a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
    odd = a < 0x20
    odd |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    odd |= (a == 0xE1) & ((b == 0x9A) | (b == 0xA0))
    odd |= (a == 0xE2) & ((b == 0x80) | (b == 0x81))
    odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return lead[odd]


@dataclass
class PieceEncoder:
    """``spaced``: pieces are " word"; they are cut before each space that a non-space follows (byte-level BPE).
    Otherwise pieces are the words between ASCII white space (word-end BPE that drops white space)."""

    path: str
    spaced: bool
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    length: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: list = field(default_factory=list)
    n_ids: int = 0

    def __post_init__(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.encode_special_tokens = True
        mark = self._whole([f"a {_SEPARATOR} a"])[0]
        a = self._whole([" a" if self.spaced else "a"])[0]
        head = self._whole(["a"])[0]
        self.mark = mark[len(head) : len(mark) - len(a)]
        self.pool = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(buf)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        # a run of letters ends before punctuation whatever stands around them
        inner = np.zeros(n, bool)
        inner[1:] = _LETTER[buf[:-1]] & _PUNCT[buf[1:]]
        if not self.spaced:
            starts, ends, _ = T.words(buf, off)
            begins = np.zeros(n, bool)
            begins[starts] = True
            inner &= ~begins
            more = np.flatnonzero(inner)
            starts, ends = np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))
        else:
            cut = np.zeros(n + 1, bool)
            cut[:-1] = buf == 32
            cut[: n - 1] &= ~_SPACE[buf[1:]]
            cut[n - 1] = False
            edge = np.zeros(n + 1, bool)
            edge[off] = True
            cut[:-1] &= ~edge[1:]
            cut[:-1] |= inner
            filled = off[:-1][off[1:] > off[:-1]]
            cut[filled] = True
            starts = np.flatnonzero(cut[:-1])
            ends = np.append(starts[1:], n)
        return starts, ends, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Encode the pieces behind ``keys`` and add them to the cache."""
        raw = buf.tobytes()
        texts = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())]
        got: list[np.ndarray | None] = [None] * len(texts)
        joined = [k for k, t in enumerate(texts) if not self.spaced or t[:1] == " "]
        alone = [k for k, t in enumerate(texts) if self.spaced and t[:1] != " "]
        glue = f" {_SEPARATOR}" if self.spaced else f" {_SEPARATOR} "
        groups = [joined[k : k + 500] for k in range(0, len(joined), 500)]
        mark, last = len(self.mark), self.mark[-1]
        lead = 1 if self.spaced else 0
        for group, ids in zip(groups, self._whole([("." if self.spaced else "") + glue.join(texts[k] for k in group) for group in groups])):
            a = np.array(ids, np.uint32)
            at = np.flatnonzero(a == last)
            begin = np.concatenate([[lead], at + 1])
            end = np.append(at - mark + 1, len(a))
            if len(begin) != len(group):
                raise ValueError("the separator is not a token of its own")
            for k, s, e in zip(group, begin, end):
                got[k] = a[s:e]
        for k, ids in zip(alone, self._whole([texts[k] for k in alone])):
            got[k] = np.array(ids, np.uint32)
        if len(self.keys) > CACHE_PIECES:
            self.keys, self.place, self.length, self.pool, self.n_ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0
        length = np.array([len(g) for g in got], np.int64)
        place = self.n_ids + np.cumsum(length) - length
        if self.n_ids + int(length.sum()) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.n_ids + int(length.sum()), 1 << 16), np.uint32)
            grown[: self.n_ids] = self.pool[: self.n_ids]
            self.pool = grown
        if got:
            self.pool[self.n_ids : self.n_ids + int(length.sum())] = np.concatenate(got)
        self.n_ids += int(length.sum())
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.place, self.length = np.concatenate([self.place, place])[order], np.concatenate([self.length, length])[order]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row (uint32), and the n+1 offsets of each one's."""
        n = len(off) - 1
        odd = np.unique(np.searchsorted(off, _odd(buf), side="right") - 1)
        starts, ends, doc = self._pieces(buf, off)
        plain = np.ones(n, bool)
        plain[odd] = False
        use = plain[doc]
        starts, ends, doc = starts[use], ends[use], doc[use]
        unique, first, back = np.unique(T.span_hash(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = (at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != unique) if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            if len(self.keys) > CACHE_PIECES:
                self.keys = np.zeros(0, U64)
                self.place = self.length = np.zeros(0, np.int64)
                self.n_ids = 0
                new = np.ones(len(unique), bool)
            self._learn(buf, starts[first[new]], ends[first[new]], unique[new])
            at = np.searchsorted(self.keys, unique)
        where, length = self.place[at][back], self.length[at][back]
        begin = np.cumsum(length) - length
        total = int(length.sum())
        ids = self.pool[np.arange(total) + np.repeat(where - begin, length)] if total else np.zeros(0, np.uint32)
        count = np.bincount(doc, weights=length, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        if len(odd):
            raw = buf.tobytes()
            whole = self._whole([raw[off[k] : off[k + 1]].decode() for k in odd])
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k, w in zip(odd, whole):
                parts[k], count[k] = np.array(w, np.uint32), len(w)
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(count)])


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """The worker's encoder of a tokenizer file; its cache lives as long as the worker."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = PieceEncoder(path, spaced)
    return _ENCODERS[path, spaced]


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine (looked up on the executor that uses it)."""
    import public_tokenizers

    return public_tokenizers.path(name)
