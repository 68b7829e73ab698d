"""Token ids in a binary format: canonical length-limited Huffman codes from global counts.

Files follow each other in ascending doc_id order: each partition of a range of doc_id is a sorted stream, and a
file is closed when its ids reach FILE_BYTES, so no id, null included, has to fit one file. Layout of a file:

    magic "TOKHUF01", u32 length of the zlib-compressed header, header (JSON: n_docs, n_ids, block,
    words, max_bits, width), u32 length and zlib bytes of the code lengths (one byte per id),
    n_docs int64 doc ids, n_docs bytes null flags, n_docs int64 id counts, one u64 bit offset per block of
    ``block`` ids (the checkpoints), and ``words`` big-endian u64 of code bits.

Any block decodes on its own from its checkpoint; a reader decodes all blocks of a file side by side
with one table look-up per id and step. Codes are at most MAX_BITS long (package-merge).
"""

from __future__ import annotations

import json
import struct
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
from .files import read_file, write_file
from .shared import limit_arrow, materialise, work_dir

MAGIC = b"TOKHUF01"
MAX_BITS = 18
BLOCK = 512
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of ids, two each, at which a file is closed, and files that a partition is meant for.
FILE_BYTES, PART_FILES = 8 << 20, 2
_CHUNK = 1 << 20
U64 = np.uint64


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    single, kinds = np.arange(n), []
    row, kind = weight, single
    for level in range(most):
        kinds.append(kind)
        if level == most - 1:
            break
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        row, kind = both[by], np.concatenate([single, np.full(len(pairs), -1)])[by]
    take = 2 * n - 2
    for kind in reversed(kinds):
        head = kind[:take]
        items = head[head >= 0]
        out[order[items]] += 1
        take = 2 * int((head < 0).sum())
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    code = np.zeros(len(lengths), U64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return code
    n = lengths[order].astype(np.int64)
    top = int(n[-1])
    size = np.left_shift(1, top - n)
    code[order] = ((np.cumsum(size) - size) >> (top - n)).astype(U64)
    return code


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(checkpoints u64, words u64): the bit offset of every block, and the code bits."""
    checkpoints, words, base = [], [], 0
    for s in range(0, len(ids), _CHUNK):
        part = ids[s : s + _CHUNK]
        n = lengths[part].astype(np.int64)
        at = np.cumsum(n) - n
        checkpoints.append((at[::block] + base).astype(U64))
        total = int(at[-1] + n[-1])
        word, room = at >> 6, 64 - (at & 63) - n
        code = codes[part]
        fits = np.where(room >= 0, code << np.maximum(room, 0).astype(U64), code >> np.maximum(-room, 0).astype(U64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros((total + 63) // 64, U64)
        out[word[first]] = np.bitwise_or.reduceat(fits, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(U64)
        words.append(out)
        base += 64 * len(out)
    return (np.concatenate(checkpoints), np.concatenate(words)) if words else (np.zeros(0, U64), np.zeros(0, U64))


def decode_table(lengths: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each value of the next ``most`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    ids, size = np.repeat(order, 1 << (most - n)), np.repeat(n, 1 << (most - n))
    rest = (1 << most) - len(ids)
    return np.concatenate([ids, np.zeros(rest, ids.dtype)]).astype(np.uint32), np.concatenate([size, np.ones(rest, size.dtype)]).astype(np.int64)


def decode(n_ids: int, checkpoints: np.ndarray, words: np.ndarray, table: tuple[np.ndarray, np.ndarray], block: int = BLOCK, most: int = MAX_BITS) -> np.ndarray:
    """All ids; the blocks advance side by side."""
    if not n_ids:
        return np.zeros(0, np.uint32)
    symbol, size = table
    raw = np.frombuffer(words.astype(">u8").tobytes() + bytes(8), np.uint8)
    window = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    out = np.zeros((len(checkpoints), block), np.uint32)
    short = n_ids - (len(checkpoints) - 1) * block
    at = checkpoints.astype(np.int64)
    for k in range(block):
        live = at if k < short else at[:-1]
        if not len(live):
            break
        bits = (window[live >> 3].astype(U64) << (live & 7).astype(U64)) >> U64(64 - most)
        out[: len(live), k] = symbol[bits]
        live += size[bits]
    return out.ravel()[:n_ids]


def pack_file(docs: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate([d[1] for d in docs]) if docs else np.zeros(0, np.uint16)
    checkpoints, words = encode(ids, lengths, codes)
    header = zlib.compress(json.dumps({"n_docs": len(docs), "n_ids": len(ids), "block": BLOCK, "words": len(words), "max_bits": MAX_BITS, "width": len(lengths)}).encode())
    book = zlib.compress(lengths.tobytes())
    doc_ids = np.array([0 if d[0] is None else d[0] for d in docs], "<i8")
    nulls = np.array([d[0] is None for d in docs], np.uint8)
    counts = np.array([len(d[1]) for d in docs], "<i8")
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, struct.pack("<I", len(book)), book, doc_ids.tobytes(), nulls.tobytes(), counts.tobytes(), checkpoints.astype("<u8").tobytes(), words.astype(">u8").tobytes()])


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, id counts, and all ids of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 8
    parts = []
    for _ in range(2):
        n = struct.unpack_from("<I", data, at)[0]
        parts.append(zlib.decompress(data[at + 4 : at + 4 + n]))
        at += 4 + n
    head, lengths = json.loads(parts[0]), np.frombuffer(parts[1], np.uint8)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(data, kind, n, at)
        at += a.nbytes
        return a

    n = head["n_docs"]
    doc_ids, nulls, counts = take("<i8", n), take("u1", n), take("<i8", n)
    checkpoints = take("<u8", -(-head["n_ids"] // head["block"]))
    words = take(">u8", head["words"]).astype(U64)
    ids = decode(head["n_ids"], checkpoints, words, decode_table(lengths, head["max_bits"]), head["block"], head["max_bits"])
    return [None if z else int(d) for d, z in zip(doc_ids, nulls)], counts, ids


def _tokenise(path: Callable[[], str], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = K.encoder(path(), True)
        for batch in batches:
            buf, off, _ = T.utf8(batch.column("text"))
            for i, j in T.slices(off, 4 << 20):
                ids, at = encoder.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                raw = [np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4").tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([shrink(r) for r in raw], pa.binary())], ["doc_id", "ids"])

    return run


def shrink(raw: bytes) -> bytes:
    """Ids for the shuffle: two bytes each if all are below 65536 (first byte 2), else four."""
    a = np.frombuffer(raw, "<u4")
    return b"\x02" + a.astype("<u2").tobytes() if a.max(initial=0) < 65536 else b"\x04" + raw


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\x02" else "<u4", offset=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        got = np.bincount(np.concatenate([widen(x) for x in batch.column("ids").to_pylist()] or [np.zeros(0, np.uint16)]), minlength=len(total))
        got[: len(total)] += total
        total = got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


_LISTING = "part long, serial long, path string, n_docs long, n_ids long"


def _write(folder: str, lengths: np.ndarray, file_bytes: int):
    codes = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        held: list[tuple[int | None, np.ndarray]] = []
        serial = size = 0

        def close() -> pa.RecordBatch:
            target = f"{folder}/ids-{part:06d}-{serial:05d}-{attempt}.huf"  # the listing names the files of the attempt that counts
            write_file(target, pack_file(held, lengths, codes))
            row = (part, serial, target, len(held), sum(len(d[1]) for d in held))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "serial", "path", "n_docs", "n_ids"])

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                held.append((doc, widen(raw)))
                size += held[-1][1].nbytes
                if size >= file_bytes:
                    yield close()
                    held, size, serial = [], 0, serial + 1
        if held:
            yield close()

    return run


def write_ids(documents: DataFrame, folder: str, end_id: int = END_ID, tokenizer_path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the token files; their listing (part, serial, path, n_docs, n_ids), whose order by part and serial is that of doc_id.

    The counts of ids (one per vocabulary entry) are all that the driver gets.
    """
    spark = documents.sparkSession
    limit_arrow(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = (lambda: tokenizer_path) if tokenizer_path else (lambda: K.public_path(TOKENIZER))
    # tokenised once: the table serves the count and the writing
    ids = materialise(texts.mapInArrow(_tokenise(path, end_id), "doc_id long, ids binary"), f"{folder}/ids")
    counts = ids.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    size = ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    order = F.col("doc_id").asc_nulls_first()
    ranged = ids.repartitionByRange(max(1, -(-size // (PART_FILES * file_bytes))), order).sortWithinPartitions(order, F.xxhash64("ids"))
    return materialise(ranged.mapInArrow(_write(f"{folder}/files", code_lengths(total), file_bytes), _LISTING), f"{folder}/listing")


def _read(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in files:
        for path, start in zip(frame.path, frame.start):
            doc_ids, counts, ids = unpack_file(read_file(path))
            end = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - c : e].astype("<u4").tobytes()) for e, c in zip(end, counts)]
            yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": start + end - counts, "n_tokens": counts, "ids_crc32": np.array(crc, np.int64)})


def read_ids(listing: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files of ``listing``."""
    parts = listing.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count(F.lit(1)).alias("files"))
    parts = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # one row for each partition
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("serial")) - F.col("n_ids")
    starts = listing.join(parts.select("part", "before").hint("merge"), "part").select("path", (F.col("before") + inside).alias("start"))
    return starts.repartition(max(1, listing.count())).mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, **options) -> DataFrame:
    """Write the ids of every row of ``documents`` (doc_id, text) and read them back.

    A null or empty text is the end id alone; a null doc_id sorts first; rows with one doc_id all count,
    in order of a hash of their ids. Other columns are ignored; an empty table gives no rows.
    """
    return read_ids(write_ids(documents, work_dir(documents.sparkSession, "token-ids"), **options))
