"""Queries over the fixed parts of the carver: registry, names, sizes, refusals, matcher. Their SQL states the
expected values by hand."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..operators.scan import Matcher, parse_size
from ..sources.readers import EWF_MAGIC, container_kind, looks_like_ewf, segment_names

SEGMENTS = 20_000
SIZES = ["12", " 3k ", "2M", "1g", "0", "7K", "1.5M", "1KB", "", "-1", "k"]
HEADS = [("a.dd", b"EVF2\r\n\x81\x00"), ("b.dd", b"LVF\t\r\n\xff\x00"), ("c.dd", b"QFI\xfb"), ("d.dd", b"KDMV"), ("e.dd", b"conectix"), ("f.dd", b"vhdxfile"), ("g.Ex01", b""), ("h.l01", b""), ("i.qcow2", b""), ("j.vmdk", b""), ("k.VHD", b""), ("l.vhdx", b""), ("m.aff", b""), ("n.vhd", b"KDMV"), ("o.dd", b"AAAA"), ("p.e01", b""), ("q.S01", b"x"), ("r.dd", EWF_MAGIC)]
BUFFERS = [b"\xff\xd8\xff\xd8\xff", bytes(3) + b"\1\0\0\1\0", b"GIF87aBMM\0*", b"{\\rtftyp", b"regftyp", b"OggSQLite format 3\0", b"SQLite format 3\0\0\1\0", b"BMBM", b"PK\3\4PK\3\4", b"nothing"]


def q_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.registry(spark).select("ord", "name", F.array_join(F.transform("magics", lambda m: F.hex(m)), ",").alias("magics"), "header_offset", "max_size", "has_precheck", "description")


def q_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.groups(spark).withColumnRenamed("group", "group_name")


def q_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.aliases(spark)


def q_resolve_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = R.resolve_types("docs, JPEG,images ,mov")
    return spark.createDataFrame(list(enumerate(names)), "ord int, name string")


def q_segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(kind, k, n) for kind in "Ees" for k, n in enumerate(islice(segment_names(kind), SEGMENTS))]
    return spark.createDataFrame(rows, "kind string, k long, name string")


def q_size_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def value(text: str) -> int | None:
        try:
            return parse_size(text)
        except ValueError:
            return None

    return spark.createDataFrame([(t, value(t)) for t in SIZES], "literal string, bytes long")


def q_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, container_kind(p, h), looks_like_ewf(p, h)) for p, h in HEADS], "path string, refused_as string, ewf boolean")


def q_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    matcher = Matcher(tuple(R.SIGNATURES))
    rows = [(k, at, magic.hex(), ",".join(matcher.owners[magic])) for k, b in enumerate(BUFFERS) for at, magic in matcher.matches(b)]
    return spark.createDataFrame(rows, "buffer int, place int, magic string, owners string")


def queries() -> dict[str, Callable]:
    return {"registry": q_registry, "groups": q_groups, "aliases": q_aliases, "resolve_types": q_resolve_types, "segment_names": q_segment_names, "size_literals": q_size_literals, "refusals": q_refusals, "matcher": q_matcher}


# fixed values: the expected registry, written out by hand
_REGISTRY = """
SELECT CAST(ord AS INTEGER) AS ord, name, magics, CAST(header_offset AS BIGINT) AS header_offset, CAST(mib AS BIGINT) * 1048576 AS max_size, has_precheck, description FROM (VALUES
  (0, 'jpg', 'FFD8FF', 0, 64, false, 'JPEG image'),
  (1, 'png', '89504E470D0A1A0A', 0, 64, false, 'PNG image'),
  (2, 'gif', '474946383761,474946383961', 0, 32, false, 'GIF image'),
  (3, 'bmp', '424D', 0, 64, true, 'BMP image'),
  (4, 'tif', '49492A00,4D4D002A', 0, 256, false, 'TIFF image'),
  (5, 'pdf', '255044462D', 0, 128, false, 'PDF document'),
  (6, 'rtf', '7B5C727466', 0, 64, false, 'Rich Text Format'),
  (7, 'ole', 'D0CF11E0A1B11AE1', 0, 64, false, 'OLE2/CFB: doc, xls, ppt, msg, vsd, msi'),
  (8, 'pst', '2142444E', 0, 65536, false, 'Outlook store (.pst/.ost)'),
  (9, 'zip', '504B0304', 0, 512, false, 'ZIP, docx/xlsx/pptx, jar, apk, epub, odf'),
  (10, 'gz', '1F8B08', 0, 256, false, 'gzip'),
  (11, '7z', '377ABCAF271C', 0, 4096, false, '7-Zip'),
  (12, 'sqlite', '53514C69746520666F726D6174203300', 0, 1024, false, 'SQLite 3 database'),
  (13, 'mp4', '66747970', 4, 4096, true, 'MP4/MOV/HEIC/AVIF/3GP/M4A/M4V'),
  (14, 'riff', '52494646', 0, 2048, true, 'WAV, AVI, WebP'),
  (15, 'mp3', '494433', 0, 256, true, 'MP3 (ID3v2-tagged)'),
  (16, 'elf', '7F454C46', 0, 256, false, 'ELF binary'),
  (17, 'ico', '00000100,00000200', 0, 8, false, 'ICO / CUR'),
  (18, 'ogg', '4F676753', 0, 512, false, 'OGG (Vorbis/Opus/Theora)'),
  (19, 'mkv', '1A45DFA3', 0, 4096, false, 'Matroska / WebM'),
  (20, 'evtx', '456C6646696C6500', 0, 256, false, 'Windows event log'),
  (21, 'hive', '72656766', 0, 256, false, 'Windows registry hive'),
  (22, 'plist', '62706C6973743030', 0, 64, false, 'Apple binary plist')
) t(ord, name, magics, header_offset, mib, has_precheck, description)"""

_GROUPS = """
SELECT group_name, CAST(k - 1 AS INTEGER) AS ord, name FROM (
  SELECT group_name, unnest(string_split(names, ' ')) AS name, unnest(range(1, len(string_split(names, ' ')) + 1)) AS k FROM (VALUES
    ('office', 'ole zip pdf rtf pst'), ('docs', 'ole zip pdf rtf'), ('mail', 'pst ole'),
    ('images', 'jpg png gif bmp tif ico'), ('media', 'mp4 riff mp3 mkv ogg'), ('archives', 'zip gz 7z')) t(group_name, names))"""

_ALIASES = """
SELECT unnest(string_split(names, ' ')) AS alias, name FROM (VALUES
  ('jpg', 'jpeg'), ('tif', 'tiff'), ('gz', 'gzip'), ('mp4', 'mov heic heif avif m4a m4v 3gp'), ('riff', 'avi wav webp'),
  ('zip', 'docx xlsx pptx vsdx odt ods'), ('sqlite', 'sqlite3 db'), ('mkv', 'webm matroska'), ('ico', 'cur'), ('hive', 'reg registry'),
  ('plist', 'bplist'), ('ole', 'doc xls ppt msg vsd msi pub msp mst'), ('pst', 'ost')) t(name, names)"""

_SEGMENT_NAMES = f"""
WITH n AS (SELECT kind, k, kind BETWEEN 'a' AND 'z' AS low, ascii(upper(kind)) - 65 AS first FROM (VALUES ('E'), ('e'), ('s')) t(kind), range({SEGMENTS}) r(k)),
s AS (SELECT kind, k, CASE WHEN k < 99 THEN upper(kind) || format('{{:02d}}', k + 1) ELSE
    chr(CAST(65 + first + (k - 99) // 676 AS INTEGER)) || chr(CAST(65 + (k - 99) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (k - 99) % 26 AS INTEGER)) END AS name, low
  FROM n WHERE k < 99 + (26 - first) * 676)
SELECT kind, k, CASE WHEN low THEN lower(name) ELSE name END AS name FROM s"""


def oracle_sql() -> dict[str, str]:
    return {
        "registry": _REGISTRY,
        "groups": _GROUPS,
        "aliases": _ALIASES,
        "resolve_types": """SELECT CAST(ord AS INTEGER) AS ord, name FROM (VALUES (0, 'ole'), (1, 'zip'), (2, 'pdf'), (3, 'rtf'), (4, 'jpg'),
            (5, 'png'), (6, 'gif'), (7, 'bmp'), (8, 'tif'), (9, 'ico'), (10, 'mp4')) t(ord, name)""",
        "segment_names": _SEGMENT_NAMES,
        "size_literals": """SELECT literal, CAST(bytes AS BIGINT) AS bytes FROM (VALUES ('12', 12), (' 3k ', 3072), ('2M', 2097152), ('1g', 1073741824), ('0', 0), ('7K', 7168),
            ('1.5M', NULL), ('1KB', NULL), ('', NULL), ('-1', NULL), ('k', NULL)) t(literal, bytes)""",
        "refusals": """SELECT * FROM (VALUES ('a.dd', 'Ex01', false), ('b.dd', 'L01', false), ('c.dd', 'QCOW2', false), ('d.dd', 'VMDK', false), ('e.dd', 'VHD', false), ('f.dd', 'VHDX', false),
            ('g.Ex01', 'Ex01', false), ('h.l01', 'L01', false), ('i.qcow2', 'QCOW2', false), ('j.vmdk', 'VMDK', false), ('k.VHD', 'VHD', false), ('l.vhdx', 'VHDX', false), ('m.aff', 'AFF', false),
            ('n.vhd', 'VMDK', false), ('o.dd', NULL, false), ('p.e01', NULL, true), ('q.S01', NULL, true), ('r.dd', NULL, true)) t(path, refused_as, ewf)""",
        "matcher": """SELECT CAST(buffer AS INTEGER) AS buffer, CAST(place AS INTEGER) AS place, magic, owners FROM (VALUES
            (0, 0, 'ffd8ff', 'jpg'), (1, 1, '00000100', 'ico'), (2, 0, '474946383761', 'gif'), (2, 6, '424d', 'bmp'), (3, 0, '7b5c727466', 'rtf'), (4, 0, '72656766', 'hive'),
            (5, 0, '4f676753', 'ogg'), (6, 0, '53514c69746520666f726d6174203300', 'sqlite'), (7, 0, '424d', 'bmp'), (7, 2, '424d', 'bmp'), (8, 0, '504b0304', 'zip'), (8, 4, '504b0304', 'zip')) t(buffer, place, magic, owners)""",
    }
