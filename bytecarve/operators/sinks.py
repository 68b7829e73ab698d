"""Sinks: carved files, and the JSON manifest."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import open_source, opened

BLOCK = 8 << 20
MANIFEST = ["type", "ext", "offset", "size", "sha256", "validated", "confidence", "duplicate_of", "path"]


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            part = f"{row['path']}.{uuid.uuid4().hex}.part"
            try:
                os.makedirs(os.path.dirname(row["path"]), exist_ok=True)
                with open(part, "wb") as out:
                    at, end = row["offset"], row["offset"] + row["size"]
                    while at < end and (got := opened(row["source_id"]).pread(at, min(BLOCK, end - at))):
                        out.write(got)
                        at += len(got)
                os.replace(part, row["path"])
                done.append(row["path"])
            except OSError:
                if os.path.exists(part):
                    os.unlink(part)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])


def write_files(records: DataFrame) -> int:
    """Copy the bytes of every record with a path, on the executors, into a folder they share; returns the files written.

    Contained and duplicate records have no path by then, so nothing is written that would be deleted again.
    A file appears under its name when it is whole, whatever task attempt wrote it.
    """
    return records.where("path <> ''").select("source_id", "offset", "size", "path").mapInArrow(_written, "path string").count()


def manifest(records: DataFrame, source: str, elapsed: float, tool: str = "bytecarve") -> str:
    """The manifest of one source as JSON text; records stream to the driver one partition at a time."""
    size = open_source(source).size
    rows = records.where(F.col("source_id") == source).orderBy("ord").select(*MANIFEST)
    head = json.dumps({"tool": tool, "source": os.path.realpath(source), "source_size": size, "elapsed_s": round(elapsed, 3)}, indent=2)[:-2]
    body = ",\n    ".join(json.dumps(r.asDict()) for r in rows.toLocalIterator())
    return f'{head},\n  "files": [\n    {body}\n  ]\n}}\n' if body else f'{head},\n  "files": []\n}}\n'


def write_manifest(records: DataFrame, source: str, elapsed: float, out_dir: str) -> str:
    os.makedirs(out_dir, exist_ok=True)
    path = os.path.join(out_dir, "manifest.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(manifest(records, source, elapsed))
    return path


def json_rows(records: DataFrame) -> DataFrame:
    """One JSON object per record, nulls kept: the distributed form of the manifest's array."""
    return records.select("source_id", "ord", F.to_json(F.struct(*MANIFEST), {"ignoreNullFields": "false"}).alias("json"))
