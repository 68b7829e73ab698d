"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers. Rows are dealt into blocks; each block keeps a posting list per
component (row numbers and weights, zeros left out). A query's non-zero components scatter weighted
postings into a dense score array over the block, the block's best are cut out by partition selection,
and the blocks' lists are merged. Row blocks stay where they are: a task holds some of them (HOLD_BYTES) and
streams the query blocks past them from the shared folder, so the matrix is dealt once, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_file
from .shared import limit_arrow, materialise, work_dir

K, SCALE, QUERY_EVERY = 10, 1024, 100
#: Bytes of a block of rows or queries (eight a component), and of the row blocks that a task holds at once.
BLOCK_BYTES, HOLD_BYTES = 4 << 20, 64 << 20
#: Queries whose score arrays are filled together.
TOGETHER = 8


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each component: the rows where it is not zero (all of them: a slice) and its values."""
    out: list[tuple[np.ndarray | slice, np.ndarray]] = []
    for column in rows.T:
        at = np.flatnonzero(column)
        out.append((slice(None), np.ascontiguousarray(column)) if 2 * len(at) > len(column) else (at, column[at]))
    return out


def best(ids: np.ndarray, lists: list, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's ``k`` best rows of a block, by its posting ``lists``, ties to the smaller id."""
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(queries), TOGETHER):
        part, names = queries[s : s + TOGETHER], query_ids[s : s + TOGETHER]
        score = np.zeros((len(part), len(ids)), np.int64)
        for term in np.flatnonzero(part.any(0)):
            at, weight = lists[term]
            for q in np.flatnonzero(part[:, term]):
                score[q, at] += part[q, term] * weight
        for q, name in enumerate(names):
            others = np.flatnonzero(ids != name)
            mine = score[q, others]
            if len(mine) > k:
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                chosen = np.flatnonzero(mine >= least)
                others, mine = others[chosen], mine[chosen]
            order = np.lexsort((ids[others], -mine))[:k]
            got.append((np.full(len(order), name), ids[others[order]], mine[order]))
    if not got:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*got))  # type: ignore[return-value]


def _blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one block as two byte strings."""
    m = np.stack(rows.vector.to_list()).astype("<i8")
    return pd.DataFrame({"block": [rows.block.iloc[0]], "ids": [rows.vec_id.to_numpy("<i8").tobytes()], "matrix": [m.tobytes()]})


def _past(held: list[tuple[int, np.ndarray, list]], files: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """All query blocks past the held row blocks (width, ids, postings): each query's ``k`` best of all of them."""
    for uri in files if held else []:
        with open_file(uri) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(1, columns=["ids", "matrix"]):
                for row in batch.to_pylist():
                    query_ids = np.frombuffer(row["ids"], "<i8")
                    queries = np.frombuffer(row["matrix"], "<i8").reshape(len(query_ids), -1)
                    got = [best(ids, lists, query_ids, queries, k) for width, ids, lists in held if width == queries.shape[1]]
                    if not got:
                        continue
                    q, v, s = (np.concatenate(c) for c in zip(*got))
                    order = np.lexsort((v, -s, q))
                    q, v, s = q[order], v[order], s[order]
                    near = np.arange(len(q)) - np.searchsorted(q, q) < k
                    yield pa.RecordBatch.from_arrays([pa.array(q[near]), pa.array(v[near]), pa.array(s[near])], ["query_id", "vec_id", "score"])


def _work(files: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                rows = np.frombuffer(row["matrix"], "<i8").reshape(len(ids), -1)
                held.append((rows.shape[1], ids, postings(rows)))
                size += rows.nbytes
                if size >= HOLD_BYTES:
                    yield from _past(held, files, k)
                    held, size = [], 0
        yield from _past(held, files, k)

    return run


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, query_every: int = QUERY_EVERY) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: for each row of ``vectors`` (vec_id, embedding) whose
    id is divisible by ``query_every`` its ``k`` highest inner products with every other row.

    Components become floor(scale * x). Rows with a null id, and vectors that are null, empty, or hold a null or
    non-finite component, take no part; vectors of different lengths do not meet. Ties go to the smaller vec_id.
    Repeated rows are candidates as often as they occur, and one query; of different vectors under one query id
    each is scored, and the k highest of all count. Other columns are ignored. Products must fit 64 bits.
    """
    spark = vectors.sparkSession
    limit_arrow(spark)
    base = work_dir(spark, "topk")
    ok = vectors.where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    rows = ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))
    width = F.size("vector")
    asked = F.col("vec_id") % query_every == 0
    n, n_queries = (x or 0 for x in rows.select(F.sum(width), F.sum(F.when(asked, width))).first())
    ddl = "block long, ids binary, matrix binary"

    def deal(frame: DataFrame, components: int) -> DataFrame:
        # by a hash of the whole row, so that rows of one id spread
        keyed = frame.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(1, -(-8 * components // BLOCK_BYTES)))) + width.cast("long") * (1 << 32))
        return keyed.groupBy("block").applyInPandas(_blocks, ddl)

    queries = materialise(deal(rows.where(asked).distinct(), n_queries), f"{base}/queries")
    row_blocks = materialise(deal(rows, n), f"{base}/rows")
    found = row_blocks.select("ids", "matrix").mapInArrow(_work(queries.inputFiles(), k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
