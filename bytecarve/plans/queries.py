"""Queries over the driver's tables, with DuckDB SQL beside them.

Planted images: every document becomes an image of 512 zero bytes, its whole text, a sample file and 512 zero
bytes; the truth is then SQL over the same texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import SIGNATURES
from ..functions.samples import LOOSE, REJECTED, SAMPLES, VARIANTS, patched, png, zip_
from ..operators.select import containment, mark_duplicates, skip_ahead
from . import images, tables
from .carve import carve_column, summary

Query = Callable[[SparkSession, str], DataFrame]
PAD = 512
COLUMNS = ["source_id", "type", "ext", "offset", "size", "sha256", "validated", "confidence"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def planted(spark: SparkSession, sf_dir: str, *files: bytes) -> DataFrame:
    """(doc_id, image): the files one after the other, each followed by PAD zero bytes."""
    pad = F.lit(bytes(PAD))
    tail = [x for f in files for x in (F.lit(f), pad)]
    return _documents(spark, sf_dir).select("doc_id", F.concat(pad, F.encode(F.coalesce("text", F.lit("")), "UTF-8"), *tail).alias("image"))


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _at(shift: int = 0) -> str:
    return f"CAST({PAD + shift} + octet_length(encode(coalesce(text, ''))) AS BIGINT)"


def _truth(kind: str, data: bytes, ext: str, shift: int = 0) -> str:
    return f"SELECT CAST(doc_id AS VARCHAR) AS source_id, '{kind}' AS type, '{ext}' AS ext, {_at(shift)} AS \"offset\", CAST({len(data)} AS BIGINT) AS size, '{_sha(data)}' AS sha256, true AS validated, 'high' AS confidence FROM documents"


def _planted(kind: str, data: bytes, **options) -> Query:
    return lambda spark, sf_dir: carve_column(planted(spark, sf_dir, data), "doc_id", "image", kind, **options).select(*COLUMNS)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up records from lineitem: a source per part, an offset per order, a size per quantity.

    Of lines with the same part, order and number the first in the table's files stays, as the SQL's DISTINCT ON, which
    orders nothing, takes it when it reads the table in one thread. Fractions are rounded half to even, as its CASTs do.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("ord")
    row = F.struct("_metadata.file_path", "_metadata.row_index", "l_quantity", "l_returnflag")
    first = lines.select("l_partkey", place, row.alias("row")).groupBy("l_partkey", "ord").agg(F.min("row").alias("row"))
    return first.select(
        F.col("l_partkey").cast("string").alias("source_id"),
        "ord",
        F.col("ord").alias("offset"),
        F.rint(F.col("row.l_quantity") * 4000).cast("long").alias("size"),
        (F.col("row.l_returnflag") != "A").alias("validated"),
        F.concat("row.l_returnflag", F.lit("/"), F.rint("row.l_quantity").cast("int").cast("string")).alias("sha256"),
    )


_INTERVALS = """
iv AS (
  SELECT DISTINCT ON (source_id, ord) * FROM (
    SELECT CAST(l_partkey AS VARCHAR) AS source_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS ord,
      CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS "offset", CAST(l_quantity * 4000 AS BIGINT) AS size,
      l_returnflag <> 'A' AS validated, l_returnflag || '/' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS sha256 FROM lineitem)
)"""


def q_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment(_intervals(spark, sf_dir)).select("source_id", "ord", "offset", "size", "validated")


def q_skip_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_ahead(_intervals(spark, sf_dir)).select("source_id", "ord", "offset", "size", "validated")


def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(_intervals(spark, sf_dir)).select("source_id", "ord", "offset", "sha256", "duplicate_of")


_NESTED = zip_("img.png", png())


def q_nested(skip: bool) -> Query:
    return lambda spark, sf_dir: carve_column(planted(spark, sf_dir, _NESTED), "doc_id", "image", "zip,png", skip_carved=skip).select(*COLUMNS)


def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = carve_column(planted(spark, sf_dir, png(), png()), "doc_id", "image", "png")
    return found.select("source_id", "offset", "sha256", "duplicate_of")


def q_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every validated record of all types except bmp-like accidents in texts, counted by extension and confidence."""
    files = [SAMPLES[k][0] for k in ("png", "pdf", "zip", "gz", "ogg")]
    found = carve_column(planted(spark, sf_dir, *files), "doc_id", "image", "png,pdf,zip,gz,ogg")
    return summary(found)


def q_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted("png", png(), align=4)(spark, sf_dir)


def q_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted("png", png(), start=1024, length=4096)(spark, sf_dir)


def q_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = planted(spark, sf_dir, png(), SAMPLES["pdf"][0])
    return carve_column(image, "doc_id", "image", "png,pdf", min_size=len(png()) + 1).select(*COLUMNS)


def q_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the headers that no file follows in each document, all types on, and a whole png behind it."""
    heads = F.array(*[F.lit(data) for _, data in REJECTED.values()])
    head = F.get(heads, F.pmod("doc_id", F.lit(len(REJECTED))).cast("int"))
    pad = F.lit(bytes(PAD))
    image = _documents(spark, sf_dir).select("doc_id", F.concat(pad, F.encode(F.coalesce("text", F.lit("")), "UTF-8"), head, pad, F.lit(png()), pad).alias("image"))
    return carve_column(image, "doc_id", "image", ",".join(SIGNATURES)).select(*COLUMNS)


#: A png whose last chunk claims more bytes than the image has.
_OVERRUN = patched(png(), len(png()) - 12, b"\0\0\x70\0")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"carve_{k}": _planted(k, data) for k, (data, _) in SAMPLES.items()}
    out |= {f"ext_{k}": _planted(kind, data) for k, (kind, data, _) in VARIANTS.items()}
    out |= {f"loose_{k}": _planted(kind, data) for k, (kind, data, _, _) in LOOSE.items()}
    out |= tables.queries() | images.queries()
    out |= {
        "rejected": q_rejected, "overrun": _planted("png", _OVERRUN), "containment": q_containment, "skip_ahead": q_skip_ahead, "dedup": q_dedup,
        "nested_skip": q_nested(True), "nested_no_skip": q_nested(False), "duplicates": q_duplicates, "manifest_summary": q_all_types, "align": q_align, "offset_length": q_range, "min_size": q_min_size,
    }
    return out


def _loose(kind: str, data: bytes, ext: str, size: int | None) -> str:
    """A file without a definite end: of ``size`` bytes, or all that is left of the image."""
    body = data[:size] if size else data + bytes(PAD)
    return _truth(kind, body, ext).replace("true AS validated, 'high'", "false AS validated, 'low'")


def oracle_sql() -> dict[str, str]:
    out = {f"carve_{k}": _truth(k, data, ext) for k, (data, ext) in SAMPLES.items()}
    out |= {f"ext_{k}": _truth(kind, data, ext) for k, (kind, data, ext) in VARIANTS.items()}
    out |= {f"loose_{k}": _loose(*row) for k, row in LOOSE.items()}
    out |= tables.oracle_sql() | images.oracle_sql()
    size = " ".join(f"WHEN {k} THEN {len(data)}" for k, (_, data) in enumerate(REJECTED.values()))
    out["rejected"] = _truth("png", png(), "png").replace("octet_length", f"CASE doc_id % {len(REJECTED)} {size} END + {PAD} + octet_length", 1)
    out["overrun"] = _truth("png", _OVERRUN + bytes(PAD), "png")
    out["containment"] = f"""WITH {_INTERVALS}, c AS (SELECT *, max(CASE WHEN validated THEN "offset" + size END) OVER (PARTITION BY source_id
        ORDER BY "offset", size DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cov FROM iv)
        SELECT source_id, ord, "offset", size, validated FROM c WHERE cov IS NULL OR "offset" + size > cov"""
    out["skip_ahead"] = f"""WITH RECURSIVE {_INTERVALS}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord, "offset") AS k FROM iv),
        f AS (SELECT *, true AS keep, CASE WHEN validated THEN "offset" + size ELSE -1 END AS free FROM n WHERE k = 1
          UNION ALL SELECT n.*, n."offset" >= f.free, CASE WHEN n."offset" >= f.free AND n.validated THEN n."offset" + n.size ELSE f.free END
          FROM f JOIN n ON n.source_id = f.source_id AND n.k = f.k + 1)
        SELECT source_id, ord, "offset", size, validated FROM f WHERE keep"""
    out["dedup"] = f"""WITH {_INTERVALS}, d AS (SELECT *, first_value("offset") OVER (PARTITION BY source_id, sha256 ORDER BY ord, "offset") AS f,
        row_number() OVER (PARTITION BY source_id, sha256 ORDER BY ord, "offset") AS k FROM iv)
        SELECT source_id, ord, "offset", sha256, CASE WHEN k > 1 THEN f END AS duplicate_of FROM d"""
    inner = 30 + len("img.png")
    out["nested_skip"] = _truth("zip", _NESTED, "zip")
    out["nested_no_skip"] = _truth("zip", _NESTED, "zip") + " UNION ALL " + _truth("png", png(), "png", inner)
    second = len(png()) + PAD
    out["duplicates"] = f"""SELECT CAST(doc_id AS VARCHAR) AS source_id, {_at()} AS "offset", '{_sha(png())}' AS sha256, CAST(NULL AS BIGINT) AS duplicate_of FROM documents
        UNION ALL SELECT CAST(doc_id AS VARCHAR), {_at(second)}, '{_sha(png())}', {_at()} FROM documents"""
    picked = [(ext, len(data)) for data, ext in (SAMPLES[k] for k in ("png", "pdf", "zip", "gz", "ogg"))]
    values = ", ".join(f"('{ext}', {n})" for ext, n in picked)
    out["manifest_summary"] = f"SELECT ext, 'high' AS confidence, count(*) AS files, CAST(0 AS BIGINT) AS duplicates, CAST(sum(size) AS BIGINT) AS bytes FROM documents, (VALUES {values}) t(ext, size) GROUP BY ext"
    out["align"] = f"SELECT * FROM ({_truth('png', png(), 'png')}) WHERE \"offset\" % 4 = 0"
    out["offset_length"] = f"SELECT * FROM ({_truth('png', png(), 'png')}) WHERE \"offset\" >= 1024 AND \"offset\" + size <= 5120"
    out["min_size"] = _truth("pdf", SAMPLES["pdf"][0], "pdf", len(png()) + PAD) if len(SAMPLES["pdf"][0]) > len(png()) else f"SELECT * FROM ({_truth('pdf', b'', 'pdf')}) WHERE false"
    return out
