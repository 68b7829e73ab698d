"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each scan partition tokenises its documents, cuts those longer than a sequence, and packs the pieces
best-fit in descending order. Bins that are nearly full are done. The pieces of all others are residual items of
the second level, which packs them best-fit in descending order over the whole corpus: equal totals are
interchangeable, so the plan is made from the number of items of each total, and every item finds its bin
by its total and its number among the items of that total. No task holds more than a scan partition's
pieces or the plan, whose size depends on the capacity alone. Texts are not shuffled: only (doc_id, piece,
start, length, crc) of the residual pieces moves, once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnp as T
from . import tokens as K
from .shared import limit_arrow, materialise, work_dir

LENGTH = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: A bin with at most this share of its room left is done in the scan.
NEARLY_FULL = 0.01
#: Pieces that a scan partition holds before it packs them and passes the residual ones on; bounds the worker's memory.
HOLD = 200_000

_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_ROW = pa.schema([("node", pa.int64()), ("done", pa.bool_()), ("sequence_id", pa.int64()), ("total", pa.int64()), ("number", pa.int64()), ("members", pa.list_(_MEMBER))])
_DDL = "node long, done boolean, sequence_id long, total long, number long, members array<struct<doc_id long, piece int, start long, length long, ids_crc32 long, offset long>>"
_PLACED = "sequence_id long, base long, members array<struct<doc_id long, piece int, start long, length long, ids_crc32 long, offset long>>"


def best_fit(lengths: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers: items in descending order, each into the fullest bin that it fits in."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has r left
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        room -= n
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Best fit of ``counts`` items by total, as (total, first number, first bin, items a bin, offset) in the order
    of total and number: item k from the first number on lies in bin first + (k - first number) // items, and the items
    of one bin lie one behind the other from ``offset`` on. Bins of equal room are filled as a range."""
    out, made = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first bin, bins)
    for total in sorted(counts, reverse=True):
        number, left = 0, counts[total]
        back: list[tuple[int, int, int]] = []
        rooms = sorted(r for r in groups if r >= total)
        while left:
            if rooms:
                room = rooms[0]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[0]
            else:
                room, first, bins = capacity, made, -(-left // (capacity // total))
                made += bins
            each = min(room // total, left)
            full = min(bins, left // each)
            out.append((total, number, first, each, capacity - room))
            back.append((room - each * total, first, full))
            rest = min(left - full * each, each) if full < bins else 0
            number, left = number + full * each + rest, left - full * each - rest
            if rest:
                back.append((room - rest * total, first + full, 1))
                full += 1
            back.append((room, first + full, bins - full))
        for room, first, bins in back:
            if room and bins:
                groups.setdefault(room, []).append((first, bins))
    return sorted(out)


def _pack(items: list[tuple[int, list[dict]]], node: int, capacity: int, serial: int, seen: dict[int, int]) -> list[tuple]:
    """Rows (node, done, sequence_id, total, number, members): nearly full bins of ``items`` (total, members), and the items of all others.

    Items of one total are numbered; ``seen`` counts them over the calls.
    """
    rows = []
    for k, chosen in enumerate(best_fit([n for n, _ in items], capacity)):
        total = sum(items[i][0] for i in chosen)
        if capacity - total <= NEARLY_FULL * capacity:
            at = 0
            for i in chosen:
                for m in items[i][1]:
                    m["offset"] = at
                    at += m["length"]
            rows.append((node, True, (node << 28) + serial + k, total, None, [m for i in chosen for m in items[i][1]]))
            continue
        for n, members in (items[i] for i in chosen):
            rows.append((node, False, None, n, seen.get(n, 0), members))
            seen[n] = seen.get(n, 0) + 1
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in _ROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, _ROW)], schema=_ROW)


def _scan(path: Callable[[], str], capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        encoder = K.encoder(path(), False)
        held: list[tuple[int, list[dict]]] = []
        serial, seen = 0, {}
        for batch in batches:
            ids_of = batch.column("doc_id").cast(pa.int64()).to_pylist()
            buf, off, _ = T.utf8(batch.column("text"))
            for i, j in T.slices(off, 4 << 20):
                ids, at = encoder.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                full = []
                for k in range(j - i):
                    raw = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4").tobytes()
                    n = len(raw) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        part = raw[4 * start : 4 * (start + capacity)]
                        m = {"doc_id": ids_of[i + k], "piece": piece, "start": start, "length": len(part) // 4, "ids_crc32": zlib.crc32(part), "offset": 0}
                        if m["length"] == capacity:
                            full.append((node, True, (node << 28) + serial, capacity, None, [m]))
                            serial += 1
                        else:
                            held.append((m["length"], [m]))
                if full:
                    yield _batch(full)
                if len(held) >= HOLD:
                    rows = _pack(held, node, capacity, serial, seen)
                    serial += len(rows)
                    yield _batch(rows)
                    held = []
        if held:
            yield _batch(_pack(held, node, capacity, serial, seen))

    return run


def _place(segments: list[tuple[int, int, int, int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, number, first, each, offset = np.array(segments, np.int64).T
        for rows in batches:
            t, k = rows.total.to_numpy(np.int64), rows.number.to_numpy(np.int64)
            # segments of one total are sorted by their first number, which is below 1 << 48
            at = np.searchsorted((total << 48) + number, (t << 48) + k, side="right") - 1
            k = k - number[at]
            yield pd.DataFrame({"sequence_id": (1 << 56) + first[at] + k // each[at], "base": offset[at] + k % each[at] * t, "members": rows.members})

    return run


def pack(documents: DataFrame, capacity: int = LENGTH, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of every row of ``documents`` (doc_id, text) in sequences of at most ``capacity`` ids:
    doc_id, piece int, start, length, ids_crc32, sequence_id, offset (long).

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null
    doc_id stays null. Other columns are ignored; an empty table gives no sequence. ``tokenizer_path``
    is a file that every executor has; the default is the installed public tokenizer.
    """
    spark = documents.sparkSession
    limit_arrow(spark)
    base = work_dir(spark, "packing")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = (lambda: tokenizer_path) if tokenizer_path else (lambda: K.public_path(TOKENIZER))
    packed = materialise(texts.mapInArrow(_scan(path, capacity, end_id), _DDL), f"{base}/0")
    done = packed.where("done").select("sequence_id", F.lit(0).cast("long").alias("base"), "members")
    left = packed.where("not done").drop("done", "sequence_id")
    sizes = materialise(left.groupBy("total", "node").agg(F.count(F.lit(1)).alias("n")), f"{base}/sizes")
    counts = {r.total: r.n for r in sizes.groupBy("total").agg(F.sum("n").alias("n")).collect()}
    if counts:
        before = F.sum("n").over(Window.partitionBy("total").orderBy("node")) - F.col("n")
        left = left.join(sizes.select("total", "node", before.alias("before")).hint("merge"), ["total", "node"])
        left = left.select("total", (F.col("number") + F.col("before")).alias("number"), "members")
        placed = materialise(left.mapInPandas(_place(plan(counts, capacity)), _PLACED), f"{base}/1")
        done = done.unionByName(placed)
    return done.select("sequence_id", "base", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", (F.col("base") + F.col("m.offset")).alias("offset"))
