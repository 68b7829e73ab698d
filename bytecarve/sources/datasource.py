"""The Python data source ``bytecarve``: walked candidates of a byte source, partitioned by chunk ranges.

Bytes never become a column: each task reads its own chunks by path and yields only the candidates. Rows with size 0
are candidates that were tried and rejected; rows without a type are a task's counters (ext names the counter,
size holds it). Without skip_carved, bounds of offset are pushed down where the session
allows it (spark.sql.python.filterPushdown.enabled): tasks outside of them are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.scan import Options, Tally, scan
from .readers import open_source, opened

SCHEMA = "source_id string, ord long, type string, offset long, size long, ext string, validated boolean"
FIELDS = ["source_id", "ord", "type", "offset", "size", "ext", "validated"]
#: Rows of the source itself: ``hidden`` is the last magic that a validated carve kept from being walked.
FOUND = SCHEMA + ", hidden long"
_ARROW = pa.schema([("source_id", pa.string()), ("ord", pa.int64()), ("type", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("ext", pa.string()), ("validated", pa.bool_()), ("hidden", pa.int64())])
BATCH = 8192
#: A source of many ranges has TASKS tasks or more: neighbours share one, up to TASK_BYTES (a task costs a tenth of a
#: second before it reads anything).
TASKS, TASK_BYTES = 16, 16 << 20


def candidate_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)


class ChunkRange(InputPartition):
    """``ranges`` ranges of ``chunks`` chunks, one after the other; each is scanned by itself."""

    def __init__(self, path: str, first: int, chunks: int, ranges: int = 1) -> None:
        self.path, self.first, self.chunks, self.ranges = path, first, chunks, ranges


class CandidateReader(DataSourceReader):
    def __init__(self, paths: list[str], options: Options, per_task: int) -> None:
        self.paths, self.options, self.per_task = paths, options, per_task
        self.low, self.high = 0, None

    def partitions(self) -> list[InputPartition]:
        out, o = [], self.options
        step = o.chunk_size * self.per_task
        for path in self.paths:
            end = o.end(open_source(path, o.on_corrupt).size)
            # a file starts at its magic or up to four bytes before it
            bases = [b for b in range(o.start, end, step) if b + step > self.low and (self.high is None or b <= self.high + 4)]
            share = max(1, min(TASK_BYTES // step, len(bases) // TASKS))
            for k in range(0, len(bases), share):
                out.append(ChunkRange(path, (bases[k] - o.start) // o.chunk_size, self.per_task, min(share, len(bases) - k)))
        return out or [ChunkRange("", 0, 0)]

    def read(self, partition: ChunkRange) -> Iterator[pa.RecordBatch]:
        if not partition.chunks:
            return
        tally, path = Tally(), partition.path
        source = opened(path, self.options.on_corrupt)
        firsts = range(partition.first, partition.first + partition.ranges * partition.chunks, partition.chunks)
        rows = (c for first in firsts for c in scan(source, self.options, first, partition.chunks, tally))
        yield from candidate_batches((path, c.ord, c.type, c.offset, c.size, c.ext, c.validated, c.hidden) for c in rows)
        told = [(path, partition.first, None, 0, n, name, False, None) for name, n in (("blank", tally.blank_bytes), ("corrupt", tally.corrupt)) if n]
        yield from candidate_batches(iter(told))


class PushingReader(CandidateReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of ``offset`` leave whole tasks out, but only where every candidate is walked: else they would change what others hide."""
        for f in filters:
            if not self.options.skip_carved and getattr(f, "attribute", None) == ("offset",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f  # Spark still checks every row


class CandidateSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bytecarve"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> DataSourceReader:
        told = json.loads(self.options.get("carve", "{}"))
        if "types" in told:
            told["types"] = tuple(told["types"])
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        # Spark refuses a reader that takes filters in a session that pushes none
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else CandidateReader
        return kind(paths, Options(**told), int(self.options.get("chunkspertask", "1")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CandidateSource)
