"""Carve plans: a source path or a binary column in, records out."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import resolve_types
from ..operators.scan import Options, rescan, scan
from ..operators.select import containment, cut, mark_duplicates, skip_ahead, woken
from ..sources.datasource import FIELDS, FOUND, SCHEMA, candidate_batches, register
from ..sources.readers import BytesSource, opened

BLOCK = 8 << 20
RECORD = ["source_id", "ord", "type", "ext", "offset", "size", "sha256", "validated", "confidence", "duplicate_of", "path"]


def make_options(types: str | None = None, **options) -> Options:
    return Options(types=tuple(resolve_types(types)), **options)


def candidates(spark: SparkSession, paths: str | list[str], options: Options, chunks_per_task: int = 1) -> DataFrame:
    """Rows of the data source: walked and rejected candidates, and the tasks' counters."""
    register(spark)
    paths = [paths] if isinstance(paths, str) else paths
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    read = spark.read.format("bytecarve").option("paths", json.dumps(paths)).option("carve", json.dumps(asdict(options)))
    return read.option("chunksPerTask", chunks_per_task).option("pushdown", pushes).load()


def _hashed(on_corrupt: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for path, at, n in zip(batch.column("source_id").to_pylist(), batch.column("offset").to_pylist(), batch.column("size").to_pylist()):
                digest, done = hashlib.sha256(), 0
                while done < n:
                    part = opened(path, on_corrupt).pread(at + done, min(BLOCK, n - done))
                    if not part:
                        break
                    digest.update(part)
                    done += len(part)
                out.append(digest.hexdigest())
                sizes.append(done)
            yield batch.set_column(batch.schema.get_field_index("size"), "size", pa.array(sizes, pa.int64())).append_column("sha256", pa.array(out))

    return run


def _rescanned(options: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = rescan(opened(r["source_id"], options.on_corrupt), options, r["ord"], r["hidden"], r["offset"] + r["size"])
                yield from candidate_batches((r["source_id"], c.ord, c.type, c.offset, c.size, c.ext, c.validated, c.hidden) for c in rows)

    return run


def settle(found: DataFrame, options: Options) -> DataFrame:
    """Serial selection of ``found`` (cut), with the candidates that tasks put off.

    A carve that hides others and is itself dropped, with its end beyond the place where carving may begin again,
    gives its candidates back: they are walked and the selection is made anew. Each carve does so once at most; in
    the usual case none does.
    """
    key = ["source_id", "ord", "type"]
    while True:
        kept = cut(skip_ahead(found, woken=True))
        again = kept.where(woken())
        if again.isEmpty():
            return kept.where("not dropped").drop("dropped", "free")
        more = again.select("source_id", "ord", "offset", "size", "hidden").mapInArrow(_rescanned(options), FOUND)
        spent = again.select(*key, F.lit(True).alias("spent"))
        rest = found.join(spent.hint("merge"), key, "left").withColumn("hidden", F.when(F.col("spent").isNull(), F.col("hidden"))).drop("spent")
        # a magic that follows the outer carve's end may be there already
        more = more.join(found.select(*key).hint("merge"), key, "left_anti")
        found = cut(rest.select(*found.columns).unionByName(more.select(*found.columns)))


def selected(found: DataFrame, options: Options, mode: str = "serial") -> DataFrame:
    """``mode`` serial: skip-ahead; parallel: skip-ahead, then containment. Without skip_carved: all. Rejected candidates stay (size 0)."""
    if not options.skip_carved:
        return found.drop("hidden")
    kept = settle(found, options).drop("hidden")
    if mode != "parallel":
        return kept
    return containment(cut(kept.where("size > 0"))).unionByName(kept.where("size = 0"))


def source_folder(path: str) -> str:
    """The folder below the output folder that the files of one of several sources go to."""
    return f"{os.path.basename(path.rstrip('/'))}-{hashlib.sha256(path.encode()).hexdigest()[:12]}"


def finished(records: DataFrame, options: Options, out_dir: str | None, marked: bool = False, sources: list[str] = ()) -> DataFrame:
    """Adds duplicate_of, confidence and path; of several ``sources`` each has a folder of its own."""
    if not marked:
        records = mark_duplicates(records) if options.dedup else records.withColumn("duplicate_of", F.lit(None).cast("long"))
    path = F.lit("")
    if out_dir:
        folder = F.lit(out_dir.rstrip("/") + "/")
        if len(sources) > 1:
            own = F.create_map(*[F.lit(x) for s in sources for x in (s, source_folder(s) + "/")])
            folder = F.concat(folder, F.element_at(own, F.col("source_id")))
        name = F.concat(folder, F.col("ext"), F.lit("/f_"), F.format_string("%012x", F.col("offset")), F.lit("."), F.col("ext"))
        path = F.when(F.col("duplicate_of").isNull(), name).otherwise("")
    records = records.withColumn("confidence", F.when(F.col("validated"), "high").otherwise("low"))
    return records.withColumn("path", path).select(*RECORD)


def carve(spark: SparkSession, paths: str | list[str], types: str | None = None, mode: str = "serial", out_dir: str | None = None, chunks_per_task: int = 1, **options) -> DataFrame:
    """Records of one or several byte sources (executors must see the paths). ``options``: see ``Options``."""
    return carve_counted(spark, paths, types, mode, out_dir, chunks_per_task, **options)[0]


def carve_counted(spark: SparkSession, paths: str | list[str], types: str | None = None, mode: str = "serial", out_dir: str | None = None, chunks_per_task: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """``carve``'s records, and the counters of each source: (source_id, rejected candidates, blank_bytes skipped,
    corrupt_chunks read as zeros, all long); one scan gives both."""
    o = make_options(types, **options)
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    rows = cut(candidates(spark, paths, o, chunks_per_task))  # the bytes are scanned once, whatever the selection reads
    kept = selected(rows.where("type is not null"), o, mode)
    records = cut(kept.where("size > 0").mapInArrow(_hashed(o.on_corrupt), SCHEMA + ", sha256 string"))

    def n(what, value) -> Column:
        return F.coalesce(F.sum(F.when(what, value)), F.lit(0)).cast("long")

    told = rows.where("type is null").select("source_id", F.col("ext").alias("what"), F.col("size").alias("n"))
    told = told.unionByName(kept.where("size = 0").select("source_id", F.lit("rejected").alias("what"), F.lit(1).cast("long").alias("n")))
    counters = told.groupBy("source_id").agg(*[n(F.col("what") == k, F.col("n")).alias(name) for k, name in (("rejected", "rejected"), ("blank", "blank_bytes"), ("corrupt", "corrupt_chunks"))])
    every = spark.createDataFrame([(p,) for p in paths], "source_id string")
    counters = every.join(counters, "source_id", "left").na.fill(0)
    return finished(records, o, out_dir, sources=paths), counters


def fold(found: list, skip: bool) -> list:
    """Serial selection of one source's candidates in order: none may start before the last validated end."""
    free, kept = -1, []
    for c in sorted((c for c in found if c.size), key=lambda c: (c.ord, c.offset)):
        if skip and c.offset < free:
            continue
        kept.append(c)
        if c.validated:
            free = c.offset + c.size
    return kept


def carve_column(frame: DataFrame, id_column: str, content: str, types: str | None = None, mode: str = "serial", **options) -> DataFrame:
    """Records of every value of a binary column; ``source_id`` is the id as text. Null content gives none.

    A value is scanned from its start in one task, so what the scan puts off is what serial selection drops, and
    duplicates are settled there as well, without a shuffle; ``mode`` parallel adds the containment filter.
    """
    o = make_options(types, **options)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
    here = mode == "serial"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()):
                seen: dict[str, int] = {}
                for c in sorted((c for c in scan(BytesSource(data), o) if c.size), key=lambda c: c.ord) if data else ():
                    sha = hashlib.sha256(data[c.offset : c.offset + c.size]).hexdigest()
                    first = seen.setdefault(sha, c.offset)
                    rows.append((name, c.ord, c.type, c.offset, c.size, c.ext, c.validated, sha, first if first != c.offset else None))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [*FIELDS, "sha256", "duplicate_of"])

    found = frame.select(F.col(id_column).cast("string").alias("id"), F.col(content).alias("data")).mapInArrow(run, SCHEMA + ", sha256 string, duplicate_of long")
    if here:
        return finished(found, o, None, marked=o.dedup)
    found = found.drop("duplicate_of")
    return finished(containment(cut(found)) if o.skip_carved else found, o, None)


def summary(records: DataFrame) -> DataFrame:
    """Counts by extension and confidence: recovered files and duplicates."""
    fresh = F.col("duplicate_of").isNull()
    return records.groupBy("ext", "confidence").agg(F.count_if(fresh).alias("files"), F.count_if(~fresh).alias("duplicates"), F.sum("size").alias("bytes"))
