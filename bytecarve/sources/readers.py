"""Byte sources: raw files and devices, and segmented EWF sets, as read-only random access.

Paths are local to every executor (a shared mount), or URIs of a file system that pyarrow knows (hdfs://, s3://, file://).
"""

from __future__ import annotations

import os
import stat
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

# fixed values: containers that must not be carved as raw bytes
CONTAINER_MAGICS = ((b"EVF2\r\n\x81\x00", "Ex01"), (b"LVF\t\r\n\xff\x00", "L01"), (b"QFI\xfb", "QCOW2"), (b"KDMV", "VMDK"), (b"conectix", "VHD"), (b"vhdxfile", "VHDX"))
CONTAINER_SUFFIXES = {".ex01": "Ex01", ".l01": "L01", ".qcow2": "QCOW2", ".vmdk": "VMDK", ".vhd": "VHD", ".vhdx": "VHDX", ".aff": "AFF"}
EWF_MAGIC = b"EVF\x09\x0d\x0a\xff\x00"
EWF_SUFFIXES = (".e01", ".s01")


class SourceError(OSError):
    """A source that cannot be read."""


def container_kind(path: str, head: bytes) -> str | None:
    """Which unsupported container this is, by magic or else by extension."""
    for magic, kind in CONTAINER_MAGICS:
        if head.startswith(magic):
            return kind
    return CONTAINER_SUFFIXES.get(os.path.splitext(path)[1].lower())


def looks_like_ewf(path: str, head: bytes) -> bool:
    return head.startswith(EWF_MAGIC) or path.lower().endswith(EWF_SUFFIXES)


class LocalFile:
    """A file or a block device."""

    def __init__(self, path: str) -> None:
        self.fd = os.open(path, os.O_RDONLY)
        told = os.fstat(self.fd)
        self.device = not stat.S_ISREG(told.st_mode)
        self.size = os.lseek(self.fd, 0, os.SEEK_END) if self.device else told.st_size

    def pread(self, at: int, n: int) -> bytes:
        return os.pread(self.fd, n, at)

    def __del__(self) -> None:
        if getattr(self, "fd", -1) >= 0:
            os.close(self.fd)


class UriFile:
    """An object of a remote file system."""

    device = False

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.stream = system.open_input_file(path)
        self.size = self.stream.size()

    def pread(self, at: int, n: int) -> bytes:
        return self.stream.read_at(min(n, max(0, self.size - at)), at)


def plain(path: str) -> str:
    """A ``file:`` URI as a path."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def open_file(path: str) -> LocalFile | UriFile:
    path = plain(path)
    return UriFile(path) if "://" in path else LocalFile(path)


def exists(path: str) -> bool:
    path = plain(path)
    if "://" not in path:
        return os.path.exists(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


class RawSource:
    """A file, an object, or a block device."""

    segments = 1

    def __init__(self, path: str) -> None:
        self.path = path
        self.file = open_file(path)
        self.kind, self.size = "device" if self.file.device else "raw", self.file.size
        if not self.size:
            raise SourceError(f"{path}: cannot determine size")

    def pread(self, at: int, n: int) -> bytes:
        """At most ``n`` bytes; an I/O error reads short."""
        parts = []
        n = min(n, self.size - at)
        while n > 0:
            try:
                got = self.file.pread(at, n)
            except OSError:
                break
            if not got:
                break
            parts.append(got)
            at, n = at + len(got), n - len(got)
        return b"".join(parts)

    def describe(self) -> str:
        return " (device)" if self.kind == "device" else ""


def segment_names(kind: str) -> Iterator[str]:
    """Extensions of a set in order: E01..E99, EAA..EZZ, FAA..ZZZ, in the case of ``kind``."""
    for k in range(1, 100):
        yield f"{kind}{k:02d}"
    low = "a" if kind.islower() else "A"
    for a in range(ord(kind), ord(low) + 26):
        for b in range(26):
            for c in range(26):
                yield chr(a) + chr(ord(low) + b) + chr(ord(low) + c)


def segment_paths(path: str) -> list[str]:
    """All segments of the set that ``path`` begins; a path that begins none stands alone."""
    stem, ext = os.path.splitext(path)
    if len(ext) != 4 or ext[1].lower() not in "els" or ext[2:] != "01":
        return [path]
    out = []
    for name in segment_names(ext[1]):
        if not exists(f"{stem}.{name}"):
            break
        out.append(f"{stem}.{name}")
    return out or [path]


class EwfSource:
    """An EWF (Expert Witness) set: the chunk table of all segments (13 bytes a chunk), chunks inflated on demand."""

    kind = "ewf"
    #: Bytes of a run of chunks that are decoded together, and runs kept.
    RUN, KEPT = 1 << 16, 64

    def __init__(self, path: str, on_corrupt: str = "fail") -> None:
        self.path, self.on_corrupt, self.bad = path, on_corrupt, set()
        self.paths = segment_paths(path)
        self.segments = len(self.paths)
        self.files = [open_file(p) for p in self.paths]
        self.chunk_size = self.declared = self.sectors = self.sectors_32 = self.sector_size = 0
        tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k in range(self.segments):
            self._walk(k, tables)
        self.chunks = sum(len(t[1]) for t in tables)
        if not self.chunk_size or not self.chunks:
            raise SourceError(f"{path}: no EWF chunk table found")
        if self.chunks < self.declared:
            share = 100 * self.chunks / self.declared
            raise SourceError(f"{path}: incomplete EWF set, {self.chunks} of {self.declared} chunks ({share:.1f}%), last segment {os.path.basename(self.paths[-1])}")
        self.segment_of = np.repeat(np.array([t[0] for t in tables], np.int32), [len(t[1]) for t in tables])
        self.place = np.concatenate([t[1] for t in tables])
        self.packed = np.concatenate([t[2] for t in tables])
        bound = self.chunks * self.chunk_size
        self.size = next((n for n in (self.sectors * self.sector_size, self.sectors_32 * self.sector_size) if bound - self.chunk_size < n <= bound), bound)
        self.per_run = max(1, self.RUN // self.chunk_size)
        self.cache: OrderedDict[int, bytes | None] = OrderedDict()

    def _walk(self, segment: int, tables: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        file, at, seen = self.files[segment], 13, set()
        while at not in seen:
            seen.add(at)
            head = file.pread(at, 76)
            if len(head) < 76:
                break
            kind, following = head[:16].rstrip(b"\0"), struct.unpack_from("<Q", head, 16)[0]
            if kind in (b"volume", b"disk") and not self.chunk_size:
                body = file.pread(at + 76, 94)
                if len(body) >= 24:
                    self.declared, per_chunk, self.sector_size = struct.unpack_from("<III", body, 4)
                    self.sector_size = self.sector_size or 512
                    self.chunk_size = per_chunk * self.sector_size
                    self.sectors, self.sectors_32 = struct.unpack_from("<Q", body, 16)[0], struct.unpack_from("<I", body, 16)[0]
            elif kind == b"table":
                head = file.pread(at + 76, 24)
                n, base = struct.unpack_from("<I4xQ", head) if len(head) == 24 else (0, 0)
                if 0 < n <= 1 << 24 and base < 1 << 62:
                    raw = file.pread(at + 100, 4 * n)
                    entry = np.frombuffer(raw, "<u4", len(raw) // 4)
                    tables.append((segment, (entry & np.uint32(0x7FFFFFFF)).astype(np.int64) + base, entry >> np.uint32(31) > 0))
            if not following:
                break
            at = following

    def _extent(self, k: int) -> tuple[int, int, int]:
        """Segment, place and stored length (at most) of a chunk."""
        segment, at = int(self.segment_of[k]), int(self.place[k])
        end = self.files[segment].size
        if k + 1 < self.chunks and self.segment_of[k + 1] == segment and self.place[k + 1] > at:
            end = int(self.place[k + 1])
        return segment, at, max(0, min(end - at, 2 * self.chunk_size + 1024))

    def _decoded(self, k: int, raw: bytes | memoryview) -> bytes:
        try:
            return zlib.decompressobj().decompress(raw, self.chunk_size) if self.packed[k] else bytes(raw[: self.chunk_size])
        except zlib.error as e:
            if self.on_corrupt != "skip":
                raise SourceError(f"{self.path}: chunk {k} is corrupt: {e}") from None
            self.bad.add(k)
            return bytes(self.chunk_size)

    def chunk(self, k: int) -> bytes:
        """A decoded chunk. One that does not inflate is an error, or zeros and a note in ``bad``, never a silent end of the source."""
        segment, at, n = self._extent(k)
        return self._decoded(k, self.files[segment].pread(at, n))

    def _run(self, j: int) -> bytes | None:
        """The ``per_run`` chunks of a run in one piece, so that small chunks are read and inflated once for many
        reads; None where one is corrupt or short, whose chunks are read one by one."""
        if j not in self.cache:
            first = j * self.per_run
            places = [self._extent(k) for k in range(first, min(first + self.per_run, self.chunks))]
            try:
                if all(a[0] == b[0] and a[1] + a[2] == b[1] for a, b in zip(places, places[1:])):
                    segment, low, _ = places[0]
                    raw = memoryview(self.files[segment].pread(low, places[-1][1] + places[-1][2] - low))
                    parts = [self._decoded(first + i, raw[at - low : at - low + n]) for i, (_, at, n) in enumerate(places)]
                else:
                    parts = [self.chunk(first + i) for i in range(len(places))]
            except SourceError:
                parts = []
            self.cache[j] = b"".join(parts) if parts and all(len(p) == self.chunk_size for p in parts[:-1]) else None
            if len(self.cache) > self.KEPT:
                self.cache.popitem(last=False)
        self.cache.move_to_end(j)
        return self.cache[j]

    def pread(self, at: int, n: int) -> bytes:
        end, parts = min(at + n, self.size), []
        while at < end:
            k, inner = divmod(at, self.chunk_size)
            run = self._run(k // self.per_run)
            if run is None:
                got = self.chunk(k)[inner : inner + end - at]
            else:
                inner += k % self.per_run * self.chunk_size
                got = run[inner : inner + end - at]
            if not got:
                break
            parts.append(got)
            at += len(got)
        return b"".join(parts)

    def describe(self) -> str:
        return f" (EWF, {self.segments} segment{'s' if self.segments > 1 else ''})"


class BytesSource:
    """Bytes in memory, such as a value of a binary column."""

    kind, segments = "bytes", 1

    def __init__(self, data: bytes, path: str = "") -> None:
        self.data, self.path, self.size = data, path, len(data)

    def pread(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def describe(self) -> str:
        return ""


def open_source(path: str, on_corrupt: str = "fail") -> RawSource | EwfSource:
    """Open a path; refuses container formats that would only give fragments of themselves."""
    head = open_file(path).pread(0, 16)
    kind = container_kind(path, head)
    if kind:
        raise SourceError(f"{path}: cannot read {kind} containers")
    return EwfSource(path, on_corrupt) if looks_like_ewf(path, head) else RawSource(path)


_OPEN: OrderedDict[tuple[str, str], RawSource | EwfSource] = OrderedDict()


def opened(path: str, on_corrupt: str = "fail") -> RawSource | EwfSource:
    """The worker's open source of a path (a few are kept)."""
    key = (path, on_corrupt)
    if key not in _OPEN:
        _OPEN[key] = open_source(path, on_corrupt)
        if len(_OPEN) > 8:
            _OPEN.popitem(last=False)
    return _OPEN[key]
