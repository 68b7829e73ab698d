"""Raw images and EWF sets made of the texts of ``documents``, and the queries that read them back."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samples as S
from ..functions.samples import SAMPLES
from ..operators.sinks import MANIFEST, json_rows, write_files
from ..sources.readers import opened, plain
from ..sources.work import work_dir
from .carve import carve, carve_counted
from .sql import register as register_sql

#: Images that the documents are dealt to by doc_id, and zero bytes before each text.
IMAGES, GAP = 8, 9000
FIVE = ["png", "pdf", "zip", "gz", "ogg"]
EVERY = sorted(SAMPLES)


def images(spark: SparkSession, sf_dir: str, files: list[bytes], each: bool = False, ewf: dict | None = None) -> list[str]:
    """Write IMAGES files of (GAP zeros, "x", text, "x", files) for each document in order of doc_id; their paths.

    ``each``: a document gets one of ``files``, by doc_id. Every image is written as a stream by one task, every EWF
    segment of it by another.
    """
    folder = plain(work_dir(spark, "images"))
    if "://" in folder:
        raise RuntimeError("images are written to a mounted folder")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        image, out, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["image"] != image:
                    if out:
                        out.close()
                    image = row["image"]
                    done.append(f"{folder}/img-{image}.dd")
                    out = open(done[-1], "wb")
                tail = files[row["doc_id"] // IMAGES % len(files)] if each else b"".join(files)
                out.write(bytes(GAP) + b"x" + (row["text"] or "").encode() + b"x" + tail)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.pmod("doc_id", F.lit(IMAGES)).alias("image"))
    docs = docs.repartitionByRange(IMAGES, "image").sortWithinPartitions("image", "doc_id")
    paths = sorted(r.path for r in docs.mapInArrow(write, "path string").collect())
    if ewf is None:
        return paths
    segments = ewf.get("segments", 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = [(paths[i // segments], i % segments) for i in batch.column("id").to_pylist()]
            done = [S.ewf_segment(p, p[:-2] + "E01", k, **ewf) for p, k in todo]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    n = len(paths) * segments  # a task for each segment
    done = spark.range(0, n, 1, n).mapInArrow(pack, "path string").collect()
    return sorted(r.path for r in done if r.path.endswith(".E01"))


def _image(path: str = "source_id"):
    return F.regexp_extract(path, r"img-(\d+)\.", 1).cast("long")


def _records(records: DataFrame) -> DataFrame:
    return records.select(_image().alias("image"), "type", "ext", "offset", "size", "sha256", "confidence", "duplicate_of")


def _carved(files: list[str], each: bool = False, ewf: dict | None = None, types: str | None = None, **options) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = images(spark, sf_dir, [SAMPLES[k][0] for k in files], each, ewf)
        return _records(carve(spark, paths, types or ",".join(files), **options))

    return query


def q_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several sources in one output folder, read back."""
    out = plain(work_dir(spark, "carved"))
    records = carve(spark, images(spark, sf_dir, [SAMPLES[k][0] for k in EVERY], each=True), out_dir=out, dedup=False)
    write_files(records)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out)
    parts = F.split(F.substring_index("path", "/", -3), "/")
    return back.select(F.regexp_extract(parts[0], r"img-(\d+)\.", 1).cast("long").alias("image"), parts[1].alias("ext"), parts[2].alias("name"), F.sha2("content", 256).alias("sha256"))


def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json_rows(carve(spark, images(spark, sf_dir, [SAMPLES["png"][0]]), "png", out_dir="/out"))
    told = F.regexp_replace("json", r"/out/img-\d+\.dd-[0-9a-f]+/", "/out/")
    return rows.select(_image().alias("image"), told.alias("json"))


def q_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rejected png and a whole one in each document; zero gaps pass whole chunks."""
    paths = images(spark, sf_dir, [S.REJECTED["png"][1] + b"x", SAMPLES["png"][0]])
    return carve_counted(spark, paths, "png", chunk_size=4096, chunks_per_task=70)[1].select(_image().alias("image"), "rejected", "blank_bytes", "corrupt_chunks")


def q_carve_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function at every place of a record, beside the record."""
    records = carve(spark, images(spark, sf_dir, [SAMPLES[k][0] for k in FIVE]), ",".join(FIVE))
    register_sql(spark, records)
    return spark.sql("SELECT r.*, c.size AS found_size, c.ext AS found_ext FROM carve_records r, LATERAL carve_at(r.source_id, r.type, r.offset, 0L) c").select(_image().alias("image"), "type", "offset", "found_size", "found_ext")


def q_ewf_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text read back from an EWF set, by place and length."""
    paths = {k: p for k, p in enumerate(images(spark, sf_dir, [b""], ewf={"per_chunk": 3, "segments": 3}))}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.pmod("doc_id", F.lit(IMAGES)).alias("image"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    from pyspark.sql import Window

    before = F.sum(F.col("n") + GAP + 2).over(Window.partitionBy("image").orderBy("doc_id")) - F.col("n") - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            sha = [hashlib.sha256(opened(paths[r["image"]]).pread(r["at"], r["n"])).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sha, pa.string())], ["doc_id", "sha256"])

    return docs.select("doc_id", "image", before.alias("at"), "n").mapInArrow(read, "doc_id long, sha256 string")


def queries() -> dict[str, Callable]:
    return {
        "raw_five_types": _carved(FIVE, chunk_size=1 << 16, chunks_per_task=8),
        "raw_parallel": _carved(FIVE, chunk_size=1 << 16, mode="parallel", chunks_per_task=3),
        "raw_chunk_borders": _carved(["png"], chunk_size=251, chunks_per_task=1000, skip_blank=False),
        "raw_every_type": _carved(EVERY, each=True, dedup=False),
        "raw_window": _carved(["pst"], max_size=20_000, dedup=False),
        "ewf_segments": _carved(FIVE, ewf={"per_chunk": 4, "segments": 3}, chunk_size=1 << 16, chunks_per_task=8),
        "ewf_stored": _carved(["png"], ewf={"per_chunk": 2, "packed": False}),
        "ewf_reads": q_ewf_reads,
        "written_files": q_written,
        "manifest_rows": q_manifest,
        "counters": q_counters,
        "carve_at": q_carve_at,
    }


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _places(length: str) -> str:
    """(doc_id, image, place): the place behind each document's text and its "x"; ``length`` is that of its files."""
    return f"""p AS (SELECT doc_id, doc_id % {IMAGES} AS image, coalesce(octet_length(encode(text)), 0) AS n, CAST({length} AS BIGINT) AS more FROM documents),
    q AS (SELECT *, CAST(sum({GAP} + 2 + n + more) OVER (PARTITION BY image ORDER BY doc_id) AS BIGINT) - more AS place FROM p)"""


def _truth(kinds: list[str]) -> str:
    rows, shift = [], 0
    for k in kinds:
        data, ext = SAMPLES[k]
        rows.append(f"('{k}', '{ext}', {shift}, {len(data)}, '{_sha(data)}')")
        shift += len(data)
    return f"""WITH {_places(str(shift))}, f(type, ext, shift, size, sha256) AS (VALUES {', '.join(rows)}),
    r AS (SELECT image, type, ext, CAST(place + shift AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size, sha256, 'high' AS confidence FROM q, f)
    SELECT *, nullif(min("offset") OVER (PARTITION BY image, sha256), "offset") AS duplicate_of FROM r"""


def _one_each(select: str) -> str:
    rows = ", ".join(f"({i}, '{k}', '{SAMPLES[k][1]}', {len(SAMPLES[k][0])}, '{_sha(SAMPLES[k][0])}')" for i, k in enumerate(EVERY))
    size = "CASE doc_id // %d %% %d %s END" % (IMAGES, len(EVERY), " ".join(f"WHEN {i} THEN {len(SAMPLES[k][0])}" for i, k in enumerate(EVERY)))
    return f"""WITH {_places(size)}, f(i, type, ext, size, sha256) AS (VALUES {rows})
    SELECT {select} FROM q JOIN f ON f.i = doc_id // {IMAGES} % {len(EVERY)}"""


def oracle_sql() -> dict[str, str]:
    png, pst = SAMPLES["png"][0], SAMPLES["pst"][0]
    bad = len(S.REJECTED["png"][1]) + 1
    return {
        "raw_five_types": _truth(FIVE),
        "raw_parallel": _truth(FIVE),
        "raw_chunk_borders": _truth(["png"]),
        "raw_every_type": _one_each("""image, type, ext, place AS "offset", CAST(size AS BIGINT) AS size, sha256, 'high' AS confidence, CAST(NULL AS BIGINT) AS duplicate_of"""),
        "raw_window": f"""WITH {_places(str(len(pst)))} SELECT image, 'pst' AS type, 'pst' AS ext, place AS "offset", CAST(20000 AS BIGINT) AS size,
            '{_sha(pst[:20_000])}' AS sha256, 'low' AS confidence, CAST(NULL AS BIGINT) AS duplicate_of FROM q""",
        "ewf_segments": _truth(FIVE),
        "ewf_stored": _truth(["png"]),
        "ewf_reads": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "written_files": _one_each("image, ext, 'f_' || format('{:012x}', place) || '.' || ext AS name, sha256"),
        "manifest_rows": f"""WITH {_places(str(len(png)))}, d AS (SELECT *, min(place) OVER (PARTITION BY image) AS first FROM q)
            SELECT image, '{{"type":"png","ext":"png","offset":' || place || ',"size":{len(png)},"sha256":"{_sha(png)}","validated":true,"confidence":"high","duplicate_of":'
            || CASE WHEN place = first THEN 'null' ELSE CAST(first AS VARCHAR) END || ',"path":"' || CASE WHEN place = first THEN '/out/png/f_' || format('{{:012x}}', place) || '.png' ELSE '' END || '"}}' AS json FROM d""",
        "counters": f"""WITH {_places(str(bad + len(png)))}, z AS (SELECT *, place - n - 2 - {GAP} AS a, place - n - 2 AS b FROM q)
            SELECT image, count(*) AS rejected, CAST(sum(4096 * greatest(0, b // 4096 - (a + 4095) // 4096)) AS BIGINT) AS blank_bytes, CAST(0 AS BIGINT) AS corrupt_chunks FROM z GROUP BY image""",
        "carve_at": f"""SELECT image, type, "offset", size AS found_size, ext AS found_ext FROM ({_truth(FIVE)})""",
    }


assert MANIFEST[-1] == "path"  # the oracle above spells the fields in this order
