"""The registry of file signatures, their prechecks, and the names accepted for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import walkers as W

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


def _room(buf: bytes, i: int, n: int) -> bool:
    return i + n <= len(buf)


def pre_bmp(buf: bytes, i: int) -> bool:
    return not _room(buf, i, 26) or int.from_bytes(buf[i + 14 : i + 18], "little") in W.DIB_SIZES


def pre_riff(buf: bytes, i: int) -> bool:
    return not _room(buf, i, 12) or buf[i + 8 : i + 12] in W.RIFF_FORMS


def pre_ftyp(buf: bytes, i: int) -> bool:
    if i < 4:
        return False
    size = int.from_bytes(buf[i - 4 : i], "big")
    return size == 1 or 8 <= size <= 0xFFFFFF


def pre_id3(buf: bytes, i: int) -> bool:
    return not _room(buf, i, 10) or (buf[i + 3] < 16 and buf[i + 4] < 16 and max(buf[i + 6 : i + 10]) < 128)


@dataclass(frozen=True)
class Signature:
    name: str
    magics: tuple[bytes, ...]
    max_size: int
    walk: Callable[[W.View, bool], W.Found | None]
    description: str
    header_offset: int = 0
    precheck: Callable[[bytes, int], bool] | None = None


# fixed values: magics, size caps and descriptions of the registry
SIGNATURES: dict[str, Signature] = {
    s.name: s
    for s in (
        Signature("jpg", (b"\xff\xd8\xff",), 64 * MB, W.jpg, "JPEG image"),
        Signature("png", (b"\x89PNG\r\n\x1a\n",), 64 * MB, W.png, "PNG image"),
        Signature("gif", (b"GIF87a", b"GIF89a"), 32 * MB, W.gif, "GIF image"),
        Signature("bmp", (b"BM",), 64 * MB, W.bmp, "BMP image", precheck=pre_bmp),
        Signature("tif", (b"II*\x00", b"MM\x00*"), 256 * MB, W.tif, "TIFF image"),
        Signature("pdf", (b"%PDF-",), 128 * MB, W.pdf, "PDF document"),
        Signature("rtf", (b"{\\rtf",), 64 * MB, W.rtf, "Rich Text Format"),
        Signature("ole", (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",), 64 * MB, W.ole, "OLE2/CFB: doc, xls, ppt, msg, vsd, msi"),
        Signature("pst", (b"!BDN",), 64 * GB, W.pst, "Outlook store (.pst/.ost)"),
        Signature("zip", (b"PK\x03\x04",), 512 * MB, W.zip_, "ZIP, docx/xlsx/pptx, jar, apk, epub, odf"),
        Signature("gz", (b"\x1f\x8b\x08",), 256 * MB, W.gz, "gzip"),
        Signature("7z", (b"7z\xbc\xaf\x27\x1c",), 4 * GB, W.seven_zip, "7-Zip"),
        Signature("sqlite", (b"SQLite format 3\x00",), GB, W.sqlite, "SQLite 3 database"),
        Signature("mp4", (b"ftyp",), 4 * GB, W.mp4, "MP4/MOV/HEIC/AVIF/3GP/M4A/M4V", 4, pre_ftyp),
        Signature("riff", (b"RIFF",), 2 * GB, W.riff, "WAV, AVI, WebP", precheck=pre_riff),
        Signature("mp3", (b"ID3",), 256 * MB, W.mp3, "MP3 (ID3v2-tagged)", precheck=pre_id3),
        Signature("elf", (b"\x7fELF",), 256 * MB, W.elf, "ELF binary"),
        Signature("ico", (b"\x00\x00\x01\x00", b"\x00\x00\x02\x00"), 8 * MB, W.ico, "ICO / CUR"),
        Signature("ogg", (b"OggS",), 512 * MB, W.ogg, "OGG (Vorbis/Opus/Theora)"),
        Signature("mkv", (b"\x1a\x45\xdf\xa3",), 4 * GB, W.mkv, "Matroska / WebM"),
        Signature("evtx", (b"ElfFile\x00",), 256 * MB, W.evtx, "Windows event log"),
        Signature("hive", (b"regf",), 256 * MB, W.hive, "Windows registry hive"),
        Signature("plist", (b"bplist00",), 64 * MB, W.plist, "Apple binary plist"),
    )
}

# fixed values: names accepted for a type
ALIASES = {
    "jpeg": "jpg", "tiff": "tif", "gzip": "gz", "mov": "mp4", "avi": "riff", "wav": "riff", "webp": "riff", "docx": "zip",
    "xlsx": "zip", "pptx": "zip", "sqlite3": "sqlite", "db": "sqlite", "heic": "mp4", "heif": "mp4", "avif": "mp4", "m4a": "mp4",
    "m4v": "mp4", "3gp": "mp4", "webm": "mkv", "matroska": "mkv", "cur": "ico", "reg": "hive", "registry": "hive",
    "bplist": "plist", "doc": "ole", "xls": "ole", "ppt": "ole", "msg": "ole", "vsd": "ole", "msi": "ole", "pub": "ole",
    "msp": "ole", "mst": "ole", "ost": "pst", "vsdx": "zip", "odt": "zip", "ods": "zip",
}

# fixed values: groups of types
GROUPS = {
    "office": ("ole", "zip", "pdf", "rtf", "pst"),
    "docs": ("ole", "zip", "pdf", "rtf"),
    "mail": ("pst", "ole"),
    "images": ("jpg", "png", "gif", "bmp", "tif", "ico"),
    "media": ("mp4", "riff", "mp3", "mkv", "ogg"),
    "archives": ("zip", "gz", "7z"),
}


def resolve_types(spec: str | None) -> list[str]:
    """Type names of a comma list of groups, aliases and names; all types for None. First mention orders."""
    if spec is None:
        return list(SIGNATURES)
    names: list[str] = []
    for token in spec.split(","):
        key = token.strip().lower()
        if not key:
            continue
        for name in GROUPS.get(key, (ALIASES.get(key, key),)):
            if name not in SIGNATURES:
                raise ValueError(f"unknown type: {token.strip()}")
            if name not in names:
                names.append(name)
    if not names:
        raise ValueError("no signatures selected")
    return names


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    rows = [(k, s.name, list(s.magics), s.header_offset, s.max_size, s.precheck is not None, s.description) for k, s in enumerate(SIGNATURES.values())]
    return spark.createDataFrame(rows, "ord int, name string, magics array<binary>, header_offset long, max_size long, has_precheck boolean, description string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "alias string, name string")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, k, n) for g, names in GROUPS.items() for k, n in enumerate(names)], "group string, ord int, name string")
