"""One walker per format: from a header to the file's true end.

A walker gets a View that starts at the header and returns (size, ext, validated), or None to reject.
Validated means that the structure was followed to a definite end; checksums are not verified. With
``parity`` a few quirks of the original behaviour are reproduced (see each walker).
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np

from .view import View


class Found(NamedTuple):
    size: int
    ext: str
    validated: bool


MB = 1 << 20

# fixed values of the formats
DIB_SIZES = (12, 40, 52, 56, 64, 108, 124)
RIFF_FORMS = {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}
TIFF_SIZES = {1: 1, 2: 1, 6: 1, 7: 1, 3: 2, 8: 2, 4: 4, 9: 4, 11: 4, 13: 4, 5: 8, 10: 8, 12: 8, 16: 8, 17: 8, 18: 8}
OLE_HINTS = (("__substg1.0_", "msg"), ("__properties_version1.0", "msg"), ("VisioDocument", "vsd"), ("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt"))
OLE_CLASSES = {0x00020906: "doc", 0x00020900: "doc", 0x00020820: "xls", 0x00020810: "xls", 0x00021A13: "vsd", 0x00021A20: "vsd", 0x0002123D: "pub", 0x00020D0B: "msg", 0x000C1084: "msi", 0x000C1086: "msp", 0x000C1082: "mst"}
OLE_CLASS_TAIL = bytes.fromhex("00000000c000000000000046")
OLE_PPT = (bytes.fromhex("108d81649b4fcf1186ea00aa00b929e8"), bytes.fromhex("118d81649b4fcf1186ea00aa00b929e8"))
ZIP_HINTS = ((b"visio/", "vsdx"), (b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx"), (b"AndroidManifest.xml", "apk"), (b"META-INF/MANIFEST.MF", "jar"), (b"mimetypeapplication/epub+zip", "epub"), (b"mimetypeapplication/vnd.oasis.opendocument", "odf"))
MP4_BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"pnot", b"udta", b"uuid", b"moof", b"mfra", b"meta", b"styp", b"sidx", b"ssix", b"prft", b"pdin")
MP4_BRANDS = ((b"qt  ", "mov"), (b"heic", "heic"), (b"heix", "heic"), (b"heim", "heic"), (b"heis", "heic"), (b"hevc", "heic"), (b"mif1", "heic"), (b"msf1", "heic"), (b"avif", "avif"), (b"avis", "avif"), (b"3gp", "3gp"), (b"3g2", "3g2"), (b"M4A ", "m4a"), (b"M4V ", "m4v"), (b"f4v", "f4v"))
#: kbit/s by (MPEG-1 or not, layer), index 0..14
MP3_BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MP3_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def jpg(v: View, parity: bool = False) -> Found | None:
    at, standalone = 2, {0x01, 0xD8, *range(0xD0, 0xD8)}
    while at + 2 <= v.limit:
        if v.byte(at) != 0xFF:
            return None
        kind = v.byte(at + 1)
        if kind == 0xD9:
            return Found(at + 2, "jpg", True)
        if kind == 0xFF:
            at += 1
        elif kind in standalone:
            at += 2
        else:
            n = v.be(at + 2, 2)
            if n < 2:
                return None
            at += 2 + n
            if kind != 0xDA:
                continue
            while True:  # entropy-coded data: to the next marker that is neither stuffing nor a restart
                at = v.find(b"\xff", at)
                if at < 0 or at + 2 > v.limit:
                    return None
                kind = v.byte(at + 1)
                if kind == 0 or 0xD0 <= kind <= 0xD7:
                    at += 2
                else:
                    break
    return None


def png(v: View, parity: bool = False) -> Found | None:
    at = 8
    while True:
        head = v.read(at, 8)
        if len(head) < 8:
            return None
        n, kind = int.from_bytes(head[:4], "big"), head[4:]
        if n > 0x7FFFFFFF or not (kind.isalpha() and kind.isascii()):
            return None
        at += 12 + n
        if kind == b"IEND":
            return Found(at, "png", True)


def gif(v: View, parity: bool = False) -> Found | None:
    head = v.read(0, 13)
    if len(head) < 13:
        return None

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(at: int) -> int:
        while (n := v.byte(at)) > 0:
            at += 1 + n
        return at + 1 if n == 0 else -1

    at = 13 + table(head[10])
    while True:
        kind = v.byte(at)
        if kind == 0x3B:
            return Found(at + 1, "gif", True)
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C:
            flags = v.byte(at + 9)
            if flags < 0:
                return None
            at = blocks(at + 10 + table(flags) + 1)
        else:
            return None
        if at < 0:
            return None


def bmp(v: View, parity: bool = False) -> Found | None:
    if len(v.read(0, 26)) < 26:
        return None
    size, data = v.le(2, 4), v.le(10, 4)
    if 26 <= size <= v.limit and v.le(14, 4) in DIB_SIZES and 26 <= data <= size:
        return Found(size, "bmp", True)
    return None


def tif(v: View, parity: bool = False) -> Found | None:
    num = v.le if v.read(0, 2) == b"II" else v.be
    at, end, seen = num(4, 4), 8, set()
    while at and at not in seen:
        seen.add(at)
        n = num(at, 2)
        if not 1 <= n <= 4096 or len(v.read(at, 2 + 12 * n)) < 2 + 12 * n:
            return None
        end = max(end, at + 2 + 12 * n + 4)
        lists: dict[int, tuple[int, int, int]] = {}
        for k in range(n):
            e = at + 2 + 12 * k
            tag, kind, count = num(e, 2), num(e + 2, 2), num(e + 4, 4)
            width = TIFF_SIZES.get(kind)
            if not width:
                continue
            total = width * count
            place = e + 8 if total <= 4 else num(e + 8, 4)
            if total > 4:
                end = max(end, place + total)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                lists[tag] = (place, count, width)
        for a, b in ((273, 279), (324, 325)):
            if a in lists and b in lists:
                (pa, ca, wa), (pb, cb, wb) = lists[a], lists[b]
                if end > v.limit:
                    return None
                for k in range(min(ca, cb)):
                    end = max(end, num(pa + wa * k, wa) + num(pb + wb * k, wb))
        at = num(at + 2 + 12 * n, 4)
    return Found(end, "tif", True) if 8 < end <= v.limit else None


def pdf(v: View, parity: bool = False) -> Found | None:
    horizon = v.find(b"%PDF-", 5)
    at = v.rfind(b"%%EOF", 0, horizon if horizon >= 0 else v.limit)
    if at < 0:
        return None
    end = at + 5
    tail = v.read(end, 2)
    end += 2 if tail == b"\r\n" else 1 if tail[:1] in (b"\r", b"\n") else 0
    return Found(end, "pdf", True)


_RTF_MARK, _RTF_BIN = re.compile(rb"[{}\\]"), re.compile(rb"\\bin(\d+) ?")


def rtf(v: View, parity: bool = False) -> Found | None:
    """Brace depth. Strides begin at the file's start and anew after each ``\\bin``; ``parity`` loses an escape or a
    ``\\bin`` that the end of a stride cuts, as the original does, else it is looked at again with room around it."""
    stride, word = 1 << 16, 24
    at = depth = 0
    while at < v.limit:
        buf = v.read(at, stride)
        if not buf:
            return None
        i, after = 0, -1
        while after < 0 and (m := _RTF_MARK.search(buf, i)):
            i, mark = m.end(), m[0]
            if mark == b"{":
                depth += 1
            elif mark == b"}":
                depth -= 1
                if depth == 0:
                    return Found(at + i, "rtf", True)
                if depth < 0:
                    return None
            elif not parity and i > 1 and i - 1 + word > len(buf) and at + len(buf) < v.limit:
                after = at + i - 1
            else:
                raw = _RTF_BIN.match(buf, i - 1, i - 1 + word)
                if raw and int(raw[1]) < 1 << 64:
                    after = at + raw.end() + int(raw[1])
                i += 1
        at = after if after >= 0 else at + (len(buf) if parity else max(i, len(buf)))
    return None


def ole(v: View, parity: bool = False) -> Found | None:
    head = v.read(0, 512)
    if len(head) < 512:
        return None
    shift = v.le(30, 2)
    if shift not in (9, 12):
        return None
    sector = 1 << shift
    none, last = 0xFFFFFFFF, 0xFFFFFFFE
    loose = Found(min(v.limit, 8 * MB), "ole", False)

    def words(at: int) -> list[int] | None:
        raw = v.read(at, sector)
        return [int.from_bytes(raw[k : k + 4], "little") for k in range(0, sector, 4)] if len(raw) == sector else None

    fat = [s for s in (v.le(76 + 4 * k, 4) for k in range(109)) if s != none]
    chain, hops, seen = v.le(68, 4), v.le(72, 4), set()
    most = min(hops + 4, v.limit // sector + 1)
    while chain not in (none, last) and chain not in seen and len(seen) < most:
        seen.add(chain)
        entries = words((chain + 1) * sector)
        if entries is None:
            return loose
        fat += [s for s in entries[:-1] if s != none]
        chain = entries[-1]
    top = -1
    for k, s in enumerate(fat):
        entries = words((s + 1) * sector)
        if entries is None:
            return loose
        for j in range(len(entries) - 1, -1, -1):
            if entries[j] != none:
                top = max(top, k * len(entries) + j)
                break
    end = (top + 2) * sector
    if top < 0 or end > v.limit:
        return loose
    root = v.read((v.le(48, 4) + 1) * sector, 128)
    clsid = root[80:96]
    ext = "ppt" if clsid in OLE_PPT else OLE_CLASSES.get(int.from_bytes(clsid[:4], "little")) if clsid[4:] == OLE_CLASS_TAIL else None
    if ext is None:
        ext = next((e for name, e in OLE_HINTS if v.find(name.encode("utf-16-le"), 0, end) >= 0), "ole")
    return Found(end, ext, True)


def pst(v: View, parity: bool = False) -> Found | None:
    if len(v.read(0, 256)) < 256 or v.le(8, 2) != 0x4D53:
        return None
    kind = v.le(10, 2)
    if kind in (14, 15):
        size, floor = v.le(0xA8, 4), 0x1000
    elif kind in (23, 36, 37):
        size, floor = v.le(0xB8, 8), 0x4400
    else:
        return None
    return Found(size, "pst", True) if floor <= size <= v.limit else Found(min(v.limit, 2 << 30), "pst", False)


def zip_(v: View, parity: bool = False) -> Found | None:
    def named(end: int, sure: bool) -> Found:
        head = v.read(0, min(4096, end))
        return Found(end, next((e for h, e in ZIP_HINTS if h in head), "zip"), sure)

    at, intact = 0, True
    while v.read(at, 4) == b"PK\x03\x04":
        if len(v.read(at, 30)) < 30:
            intact = False
            break
        flags, size = v.le(at + 6, 2), v.le(at + 18, 4)
        if size == 0xFFFFFFFF or (flags & 8 and not size):
            intact = False
            break
        after = at + 30 + v.le(at + 26, 2) + v.le(at + 28, 2) + size
        if after > v.limit:
            intact = False
            break
        at = after
    if intact and v.read(at, 4) == b"PK\x01\x02":
        k = at
        while v.read(k, 4) == b"PK\x01\x02" and len(v.read(k, 46)) == 46:
            k += 46 + v.le(k + 28, 2) + v.le(k + 30, 2) + v.le(k + 32, 2)
            if k > v.limit:  # the directory runs off the end
                k = at
                break
        if v.read(k, 4) == b"PK\x06\x06":
            k += 12 + v.le(k + 4, 8)
            if v.read(k, 4) == b"PK\x06\x07":
                k += 20
        if v.read(k, 4) == b"PK\x05\x06" and len(v.read(k, 22)) == 22:
            end = k + 22 + v.le(k + 20, 2)
            if end <= v.limit:
                return named(end, True)
        at = min(max(at, k), v.limit)  # a directory without its end record: the carve ends behind it
    k = v.find(b"PK\x05\x06", 0)
    while k >= 0:
        if len(v.read(k, 22)) == 22 and v.le(k + 16, 4) + v.le(k + 12, 4) == k:
            end = k + 22 + v.le(k + 20, 2)
            if end <= v.limit:
                return named(end, True)
        k = v.find(b"PK\x05\x06", k + 4)
    return named(at, False) if at else None


def _gz_header(v: View, at: int) -> int:
    """Place after the member header at ``at``, or -1."""
    head = v.read(at, 10)
    if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
        return -1
    flags, k = head[3], at + 10
    if flags & 4:
        k += 2 + v.le(k, 2)
    for bit in (8, 16):
        if flags & bit:
            z = v.find(b"\0", k)
            if z < 0:
                return -1
            k = z + 1
    return k + 2 if flags & 2 else k


def gz(v: View, parity: bool = False) -> Found | None:
    at = end = 0
    while True:
        k = _gz_header(v, at)
        ok = k >= 0
        if ok:
            inflate = zlib.decompressobj(-15)
            try:
                while not inflate.eof:
                    part = v.read(k, 1 << 16)
                    if not part:
                        break
                    k += len(part)
                    inflate.decompress(part, 1 << 20)
                    while inflate.unconsumed_tail and not inflate.eof:
                        inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            except zlib.error:
                ok = False
            ok = ok and inflate.eof
            after = k - len(inflate.unused_data) + 8
            ok = ok and after <= v.limit
        if not ok:
            return Found(end, "gz", True) if end else None
        at = end = after
        if v.read(at, 3) != b"\x1f\x8b\x08":
            return Found(end, "gz", True)


def seven_zip(v: View, parity: bool = False) -> Found | None:
    if len(v.read(0, 32)) < 32:
        return None
    size = v.le(20, 8)
    end = 32 + v.le(12, 8) + size
    return Found(end, "7z", True) if size and end <= v.limit else None


def sqlite(v: View, parity: bool = False) -> Found | None:
    head = v.read(0, 100)
    if len(head) < 100:
        return None
    page = v.be(16, 2)
    page = 65536 if page == 1 else page
    if page < 512 or page & (page - 1) or head[18] not in (1, 2) or head[19] not in (1, 2):
        return None
    pages = v.be(28, 4)
    if not pages:
        return Found(v.limit, "sqlite", False)
    return Found(page * pages, "sqlite", True) if page * pages <= v.limit else None


def mp4(v: View, parity: bool = False) -> Found | None:
    """``parity``: three-byte brands never match four bytes, so 3gp, 3g2 and f4v files are named mp4."""
    at = boxes = 0
    while at + 8 <= v.limit:
        size, kind = v.be(at, 4), v.read(at + 4, 4)
        if kind not in MP4_BOXES:
            break
        if size == 1:
            size = v.be(at + 8, 8)
        elif size == 0:
            size = v.limit - at
        if size < 8 or at + size > v.limit:
            return None
        at += size
        boxes += 1
    if boxes < 2:
        return None
    brands = v.read(8, max(0, min(v.be(0, 4), 64) - 8))  # none if the first box gives its size elsewhere
    order = [brands[k : k + 4] for k in range(0, len(brands) - 3, 4)]
    for have in order:
        for brand, ext in MP4_BRANDS:
            if have == brand or (not parity and len(brand) == 3 and have[:3] == brand):
                return Found(at, ext, True)
    return Found(at, "mov" if brands[:2] == b"qt" else "mp4", True)


def riff(v: View, parity: bool = False) -> Found | None:
    ext = RIFF_FORMS.get(v.read(8, 4))
    size = v.le(4, 4) + 8
    return Found(size, ext, True) if ext and size <= v.limit else None


def _mp3_frame(v: View, at: int) -> tuple[int, tuple[int, int, int]] | None:
    """Length and (version, layer, rate index) of the frame at ``at``."""
    h = v.read(at, 4)
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer = (h[1] >> 3) & 3, 4 - ((h[1] >> 1) & 3)
    rate_at, bit_at, pad = (h[2] >> 2) & 3, h[2] >> 4, (h[2] >> 1) & 1
    if version == 1 or layer == 4 or rate_at == 3 or bit_at in (0, 15):
        return None
    bits, rate = MP3_BITRATES[version == 3, layer][bit_at] * 1000, MP3_RATES[version][rate_at]
    if layer == 1:
        n = (12 * bits // rate + pad) * 4
    else:
        n = (144 if layer == 2 or version == 3 else 72) * bits // rate + pad
    return (n, (version, layer, rate_at)) if n >= 4 else None


def mp3(v: View, parity: bool = False) -> Found | None:
    head = v.read(0, 10)
    if len(head) < 10:
        return None
    at = 10
    skip = 0
    for b in head[6:10]:
        skip = skip << 7 | (b & 0x7F)
    at += skip
    frames, profile = 0, None
    while (f := _mp3_frame(v, at)) and at + f[0] <= v.limit and profile in (None, f[1]):
        at, profile, frames = at + f[0], f[1], frames + 1
    if not frames:
        return None
    if v.read(at, 3) == b"TAG" and at + 128 <= v.limit:
        at += 128
    return Found(at, "mp3", frames > 10)


def elf(v: View, parity: bool = False) -> Found | None:
    head = v.read(0, 64)
    if len(head) < 52 or head[4] not in (1, 2) or head[5] not in (1, 2):
        return None
    num, wide = (v.le if head[5] == 1 else v.be), head[4] == 2
    phoff, shoff = (num(32, 8), num(40, 8)) if wide else (num(28, 4), num(32, 4))
    base = 54 if wide else 42
    phsize, phnum, shsize, shnum = (num(base + 2 * k, 2) for k in range(4))
    if shoff and shnum:
        end = shoff + shnum * shsize
    else:
        end = 0
        for k in range(phnum):
            p = phoff + k * phsize
            place, size = (num(p + 8, 8), num(p + 32, 8)) if wide else (num(p + 4, 4), num(p + 16, 4))
            end = max(end, place + size)
    return Found(end, "elf", True) if 52 < end <= v.limit else None


def ico(v: View, parity: bool = False) -> Found | None:
    kind, n = v.le(2, 2), v.le(4, 2)
    if kind not in (1, 2) or not 1 <= n <= 512 or len(v.read(0, 6 + 16 * n)) < 6 + 16 * n:
        return None
    end = 6 + 16 * n
    for k in range(n):
        size, place = v.le(6 + 16 * k + 8, 4), v.le(6 + 16 * k + 12, 4)
        if not size or place < end:
            return None
        end = place + size
        if end > v.limit:
            return None
    return Found(end, "ico" if kind == 1 else "cur", True)


def ogg(v: View, parity: bool = False) -> Found | None:
    at = 0
    for _ in range(1_000_001):
        head = v.read(at, 27)
        if len(head) < 27 or head[:4] != b"OggS":
            break
        table = v.read(at + 27, head[26])
        after = at + 27 + head[26] + sum(table)
        if len(table) < head[26] or after > v.limit:
            break
        at = after
        if head[5] & 4:
            break
    return Found(at, "ogg", True) if at else None


def _vint(v: View, at: int, parity: bool) -> tuple[int, int, bool] | None:
    """(value, width, whether all value bits are ones) of an EBML number."""
    first = v.byte(at)
    if first <= 0:
        return None
    width = 9 - first.bit_length()
    raw = v.read(at, width)
    if len(raw) < width:
        return None
    value = int.from_bytes(raw, "big")
    if not (parity and width == 8):
        value &= (1 << (7 * width)) - 1
    return value, width, value == (1 << (7 * width)) - 1


def mkv(v: View, parity: bool = False) -> Found | None:
    """``parity``: the marker bit of an eight-byte size stays in its value, as in the original."""
    head = _vint(v, 4, parity)
    if head is None or head[0] > MB:
        return None
    at = 4 + head[1] + head[0]
    if v.read(at, 4) != b"\x18\x53\x80\x67":
        return None
    ext = "webm" if b"webm" in v.read(0, 64) else "mkv"
    size = _vint(v, at + 4, parity)
    if size is None or size[2] or (parity and size[0] >= 1 << 56):
        return Found(min(v.limit, 256 * MB), ext, False)
    end = at + 4 + size[1] + size[0]
    return Found(end, ext, True) if end <= v.limit else None


def evtx(v: View, parity: bool = False) -> Found | None:
    n = v.le(40, 2)
    end = 4096 + 65536 * n
    return Found(end, "evtx", True) if n and end <= v.limit else None


def hive(v: View, parity: bool = False) -> Found | None:
    n = v.le(40, 4)
    end = 4096 + n
    return Found(end, "hive", True) if n and n <= v.limit and end <= v.limit else None


def plist(v: View, parity: bool = False) -> Found | None:
    horizon = v.find(b"bplist00", 8)
    horizon = v.limit if horizon < 0 else horizon
    low = max(40, horizon - MB)
    tail = v.read(low - 32, horizon - low + 32)
    a = np.frombuffer(tail, np.uint8)
    n = max(0, len(a) - 31)
    # trailers by the bytes that nearly all places fail on: integer width, high halves of object count and table start
    maybe = a[6 : 6 + n] - np.uint8(1) < 8
    for k in (8, 9, 10, 11, 24, 25, 26, 27):
        maybe &= a[k : k + n] == 0
    for k in reversed(np.flatnonzero(maybe).tolist()):
        t, end = tail[k : k + 32], low + k
        width, num, start = t[6], int.from_bytes(t[8:16], "big"), int.from_bytes(t[24:32], "big")
        if 0 < num and 8 <= start < end - 32 and start + num * width == end - 32:
            return Found(end, "plist", True)
    return None
