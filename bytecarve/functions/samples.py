"""Small well-formed files of every format, built from their specifications: for planted queries and tests."""

from __future__ import annotations

import gzip
import os
import struct
import zlib


def png() -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(range(14)))) + chunk(b"IEND", b"")


def jpg() -> bytes:
    app0 = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\0\0\1\0\1\0\0"
    frame = b"\xff\xc0" + struct.pack(">H", 11) + bytes((8, 0, 2, 0, 2, 1, 1, 0x11, 0))
    scan = b"\xff\xda" + struct.pack(">H", 8) + bytes((1, 1, 0, 0, 63, 0)) + b"\x12\xff\x00\x34\xff\xd0\x56"
    return b"\xff\xd8" + app0 + frame + scan + b"\xff\xd9"


def gif() -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04" + bytes(4) + b"\0" + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x51\0" + b"\x3b"


def bmp() -> bytes:
    return b"BM" + struct.pack("<IHHI", 70, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + bytes(range(16))


def tif() -> bytes:
    entries = [(256, 3, 1, 4), (257, 3, 1, 4), (273, 4, 1, 8 + 2 + 48 + 4), (279, 4, 1, 16)]
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 4) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0) + bytes(range(16))


def pdf() -> bytes:
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\ntrailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF\n"


def rtf() -> bytes:
    return rb"{\rtf1\ansi {\b bold \{ and \}} {\*\pict\bin6 }}}{{{} tail\par}"


def ole(stream: str = "WordDocument", clsid: bytes = bytes(16)) -> bytes:
    head = bytearray(512)
    head[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HHHHH", head, 24, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<III", head, 44, 1, 1, 0)
    struct.pack_into("<IIIII", head, 56, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)
    fat = struct.pack("<128I", 0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *[0xFFFFFFFF] * 125)

    def entry(name: str, kind: int, start: int, size: int, guid: bytes = bytes(16)) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + guid + bytes(20) + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0, clsid) + entry(stream, 2, 2, 512) + bytes(256)
    return bytes(head) + fat + directory + bytes(range(256)) * 2


def pst() -> bytes:
    head = bytearray(32768)
    head[:4] = b"!BDN"
    struct.pack_into("<HH", head, 8, 0x4D53, 23)
    struct.pack_into("<Q", head, 0xB8, len(head))
    return bytes(head)


def zip_(name: str = "hello.txt", body: bytes = b"stored, not packed") -> bytes:
    raw, crc = name.encode(), zlib.crc32(body)
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 0, crc, len(body), len(body), len(raw), 0) + raw + body
    central = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 20, 20, 0, 0, 0, 0, crc, len(body), len(body), len(raw), 0, 0, 0, 0, 0, 0) + raw
    return local + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)


def gz() -> bytes:
    return gzip.compress(b"two members, " * 40, 6, mtime=0) + gzip.compress(b"one after the other", 6, mtime=0)


def seven_zip() -> bytes:
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<IQQI", 0, 300, 40, 0) + bytes(340)


def sqlite() -> bytes:
    head = bytearray(12288)
    head[:16] = b"SQLite format 3\0"
    struct.pack_into(">HBB", head, 16, 4096, 1, 1)
    struct.pack_into(">I", head, 28, 3)
    return bytes(head)


def mp4(brand: bytes = b"isom") -> bytes:
    def box(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", 8 + len(body)) + kind + body

    return box(b"ftyp", brand + struct.pack(">I", 512) + b"isom") + box(b"free", b"") + box(b"mdat", bytes(64)) + box(b"moov", bytes(32))


def mp4_wide(brand: bytes) -> bytes:
    """The first box gives its size in 64 bits, so its brands are not where they are looked for."""
    first = struct.pack(">I", 1) + b"ftyp" + struct.pack(">Q", 28) + brand + struct.pack(">I", 512) + b"isom"
    return first + mp4()[20:]


def patched(data: bytes, at: int, new: bytes) -> bytes:
    return data[:at] + new + data[at + len(new) :]


def riff(form: bytes = b"WAVE") -> bytes:
    body = form + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 512) + bytes(k % 251 for k in range(512))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def mp3(frames: int = 12) -> bytes:
    return b"ID3\3\0\0" + bytes((0, 0, 0, 100)) + bytes(100) + (b"\xff\xfb\x90\0" + bytes(413)) * frames


def elf() -> bytes:
    head = b"\x7fELF\2\1\1" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 0, 128, 0, 64, 56, 0, 64, 2, 0)
    return head.ljust(256, b"\0")


def ico(kind: int = 1) -> bytes:
    return b"\0\0" + bytes((kind,)) + b"\0\1\0" + bytes((1, 1, 0, 0)) + struct.pack("<HHII", 1, 32, 56, 22) + bytes(k + 1 for k in range(56))


def ogg() -> bytes:
    def page(flags: int, serial: int, body: bytes) -> bytes:
        return b"OggS\0" + bytes((flags,)) + bytes(8) + struct.pack("<III", 1, serial, 0) + bytes((1, len(body))) + body

    return page(2, 0, bytes(14)) + page(4, 1, bytes(200))


def mkv(doctype: bytes = b"matroska") -> bytes:
    inner = b"\x42\x82" + bytes((0x80 | len(doctype),)) + doctype
    return b"\x1a\x45\xdf\xa3" + bytes((0x80 | len(inner),)) + inner + b"\x18\x53\x80\x67" + b"\x01" + (90).to_bytes(7, "big") + bytes(90)


def evtx() -> bytes:
    head = bytearray(4096 + 65536)
    head[:8] = b"ElfFile\0"
    struct.pack_into("<H", head, 40, 1)
    return bytes(head)


def hive() -> bytes:
    head = bytearray(4096 + 8192)
    head[:4] = b"regf"
    struct.pack_into("<I", head, 40, 8192)
    return bytes(head)


def plist() -> bytes:
    return b"bplist00" + b"\x09" + b"\x08" + bytes(6) + bytes((1, 1)) + struct.pack(">QQQ", 1, 0, 9)


def ewf_set(raw: str, path: str, segments: int = 1, **options) -> list[str]:
    """Write the file ``raw`` as an EWF set that begins at ``path`` (.E01); see ``ewf_segment``."""
    return [ewf_segment(raw, path, k, segments, **options) for k in range(segments)]


def ewf_segment(raw: str, path: str, k: int, segments: int = 1, per_chunk: int = 2, packed: bool = True, extra: int = 0) -> str:
    """Write the ``k``-th segment of the set, chunk by chunk; ``extra`` chunks are declared but missing."""
    chunk = 512 * per_chunk
    size = os.path.getsize(raw)
    n = -(-size // chunk)
    low, high = n * k // segments, n * (k + 1) // segments
    out = f"{path[:-2]}{k + 1:02d}"
    with open(raw, "rb") as data, open(out, "wb") as f:
        data.seek(low * chunk)
        f.write(b"EVF\x09\x0d\x0a\xff\x00\x01" + struct.pack("<HH", k + 1, 0))
        if k == 0:
            body = struct.pack("<IIIIQ", 1, n + extra, per_chunk, 512, -(-size // 512)).ljust(1052, b"\0")
            f.write(_section(b"volume", 13, len(body)) + body)
        begin, offsets = f.tell(), []
        f.write(bytes(76))
        for _ in range(low, high):
            offsets.append(f.tell())
            part = data.read(chunk).ljust(chunk, b"\0")
            f.write(zlib.compress(part) if packed else part)
        end = f.tell()
        table = struct.pack("<IIQII", len(offsets), 0, 0, 0, 0) + b"".join(struct.pack("<I", o | (packed << 31)) for o in offsets)
        f.write(_section(b"table", end, len(table)) + table)
        f.write(_section(b"done" if k == segments - 1 else b"next", f.tell(), 0, last=True))
        f.seek(begin)
        f.write(_section(b"sectors", begin, end - begin - 76))
    return out


def _section(kind: bytes, at: int, body: int, last: bool = False) -> bytes:
    return kind.ljust(16, b"\0") + struct.pack("<QQ", at if last else at + 76 + body, 76 + body) + bytes(44)


#: type -> (file, extension)
SAMPLES: dict[str, tuple[bytes, str]] = {
    "jpg": (jpg(), "jpg"), "png": (png(), "png"), "gif": (gif(), "gif"), "bmp": (bmp(), "bmp"), "tif": (tif(), "tif"), "pdf": (pdf(), "pdf"),
    "rtf": (rtf(), "rtf"), "ole": (ole(), "doc"), "pst": (pst(), "pst"), "zip": (zip_(), "zip"), "gz": (gz(), "gz"), "7z": (seven_zip(), "7z"),
    "sqlite": (sqlite(), "sqlite"), "mp4": (mp4(), "mp4"), "riff": (riff(), "wav"), "mp3": (mp3(), "mp3"), "elf": (elf(), "elf"), "ico": (ico(), "ico"),
    "ogg": (ogg(), "ogg"), "mkv": (mkv(), "mkv"), "evtx": (evtx(), "evtx"), "hive": (hive(), "hive"), "plist": (plist(), "plist"),
}

def class_id(first: int) -> bytes:
    return struct.pack("<I", first) + bytes.fromhex("00000000c000000000000046")


#: Files whose extension is refined from their content: name -> (type, file, extension).
VARIANTS: dict[str, tuple[str, bytes, str]] = {
    "zip_docx": ("zip", zip_("word/document.xml"), "docx"), "zip_xlsx": ("zip", zip_("xl/workbook.xml"), "xlsx"), "zip_jar": ("zip", zip_("META-INF/MANIFEST.MF"), "jar"),
    "zip_pptx": ("zip", zip_("ppt/slide.xml"), "pptx"), "zip_vsdx": ("zip", zip_("visio/pages.xml"), "vsdx"), "zip_apk": ("zip", zip_("AndroidManifest.xml"), "apk"),
    "zip_epub": ("zip", zip_("mimetype", b"application/epub+zip"), "epub"), "zip_odf": ("zip", zip_("mimetype", b"application/vnd.oasis.opendocument.text"), "odf"),
    "ole_xls": ("ole", ole("Workbook"), "xls"), "ole_book": ("ole", ole("Book"), "xls"), "ole_msg": ("ole", ole("__substg1.0_1000"), "msg"), "ole_msg_properties": ("ole", ole("__properties_version1.0"), "msg"),
    "ole_ppt": ("ole", ole("PowerPoint Document"), "ppt"), "ole_vsd": ("ole", ole("VisioDocument"), "vsd"), "ole_plain": ("ole", ole("Data"), "ole"),
    "ole_msi": ("ole", ole("Data", class_id(0x000C1084)), "msi"), "ole_msp": ("ole", ole("Data", class_id(0x000C1086)), "msp"), "ole_mst": ("ole", ole("Data", class_id(0x000C1082)), "mst"),
    "ole_pub": ("ole", ole("Data", class_id(0x0002123D)), "pub"), "ole_class_first": ("ole", ole("WordDocument", class_id(0x00020820)), "xls"),
    "ole_class_ppt": ("ole", ole("Data", bytes.fromhex("108d81649b4fcf1186ea00aa00b929e8")), "ppt"), "ole_class_msg": ("ole", ole("Data", class_id(0x00020D0B)), "msg"),
    "mp4_mov": ("mp4", mp4(b"qt  "), "mov"), "mp4_heic": ("mp4", mp4(b"heic"), "heic"), "mp4_avif": ("mp4", mp4(b"avif"), "avif"), "mp4_m4a": ("mp4", mp4(b"M4A "), "m4a"),
    "mp4_m4v": ("mp4", mp4(b"M4V "), "m4v"), "mp4_3gp": ("mp4", mp4(b"3gp5"), "3gp"), "mp4_3g2": ("mp4", mp4(b"3g2a"), "3g2"), "mp4_f4v": ("mp4", mp4(b"f4v "), "f4v"),
    "mp4_wide": ("mp4", mp4_wide(b"qt  "), "mp4"), "riff_avi": ("riff", riff(b"AVI "), "avi"), "riff_webp": ("riff", riff(b"WEBP"), "webp"),
    "mkv_webm": ("mkv", mkv(b"webm"), "webm"), "ico_cur": ("ico", ico(2), "cur"),
}

#: Files that are found without a definite end: name -> (type, file, extension, size; null: all that follows the header).
LOOSE: dict[str, tuple[str, bytes, str, int | None]] = {
    "zip_without_end": ("zip", zip_()[:-22], "zip", len(zip_()) - 22), "zip_cut_member": ("zip", zip_("a", bytes(40)) [:71] + zip_("b", bytes(4000))[:60], "zip", 71),
    "ole_end_mark_in_list": ("ole", patched(ole(), 80, b"\xfe\xff\xff\xff"), "ole", None), "ole_list_chain_without_count": ("ole", patched(ole(), 68, b"\x00\xff\xff\x00"), "ole", None),
    "pst_past_the_end": ("pst", patched(pst(), 0xB8, struct.pack("<Q", 1 << 60)), "pst", None), "sqlite_without_count": ("sqlite", patched(sqlite(), 28, bytes(4)), "sqlite", None),
    "mkv_unknown_size": ("mkv", mkv().replace(b"\x18\x53\x80\x67\x01" + (90).to_bytes(7, "big"), b"\x18\x53\x80\x67\xff"), "mkv", None),
    "mp3_few_frames": ("mp3", mp3(3), "mp3", len(mp3(3))),
}

#: Headers that no file follows: their walkers, or the checks before them, reject.
REJECTED: dict[str, tuple[str, bytes]] = {
    "jpg": ("jpg", b"\xff\xd8\xff\xe0\x00\x01"), "png": ("png", png()[:20]), "gif": ("gif", gif()[:13] + b"\x99"), "bmp": ("bmp", patched(bmp(), 14, b"\x07")), "tif": ("tif", b"II*\0" + struct.pack("<I", 8) + b"\0\0"),
    "pdf": ("pdf", b"%PDF-1.4\nno end"), "rtf": ("rtf", rtf()[:-1]), "ole": ("ole", patched(ole(), 30, b"\x0a")), "pst": ("pst", patched(pst(), 10, b"\x63")), "gz": ("gz", gz()[:10] + b"\xff" * 20), "7z": ("7z", patched(seven_zip(), 20, bytes(8))),
    "sqlite": ("sqlite", patched(sqlite(), 16, b"\x00\x03")), "mp4": ("mp4", mp4()[:20] + b"\0\0\0\x0cnope"), "mp4_size": ("mp4", b"\0\0\0\x07ftypisom"), "riff": ("riff", patched(riff(), 8, b"NOPE")), "mp3": ("mp3", b"ID3\x13" + bytes(200)),
    "elf": ("elf", patched(elf(), 4, b"\x07")), "ico": ("ico", patched(ico(), 14, bytes(4))), "mkv": ("mkv", patched(mkv(), 16, b"\x19")), "evtx": ("evtx", b"ElfFile\0" + bytes(100)), "hive": ("hive", b"regf" + bytes(100)), "plist": ("plist", plist()[:-1]),
}
