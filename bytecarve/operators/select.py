"""Selection over carved intervals: skip-ahead, containment, and duplicates by content.

A source with at most FOLD_ROWS rows is folded, or ordered, in one task. For larger ones running extremes are
taken in two levels (inside buckets of the byte space, then over one row per bucket), so that no
task holds a whole source; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a source whose rows are ordered in one task.
BUCKET = 1 << 30
#: Rows of a source up to which one task orders them all.
FOLD_ROWS = 1_000_000
KEY = ["source_id"]
#: The end of a validated record of unknown size: nothing starts behind it.
NEVER = (1 << 63) - 1


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once: a reliable checkpoint where the cluster names a folder, else a cached copy with its lineage."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def _small(df: DataFrame) -> bool:
    most = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= FOLD_ROWS


def _running(df: DataFrame, value: Column, name: str, order: list[Column], place: str, backward: bool = False) -> DataFrame:
    """Adds ``name``: the greatest ``value`` of all earlier rows of the source (``backward``: the least of this and all later ones)."""
    df = df.withColumn("__v", value).withColumn("__b", F.floor(F.col(place) / BUCKET).cast("long"))
    inside, over = Window.partitionBy(*KEY, "__b").orderBy(*order), Window.partitionBy(*KEY).orderBy("__b")
    if backward:
        inside, over, pick, best = inside.rowsBetween(0, Window.unboundedFollowing), over.rowsBetween(1, Window.unboundedFollowing), F.min, F.least
    else:
        inside, over, pick, best = inside.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, -1), F.max, F.greatest
    whole = df.groupBy(*KEY, "__b").agg(pick("__v").alias("__w")).withColumn("__w", pick("__w").over(over))
    df = df.withColumn("__i", pick("__v").over(inside)).join(whole, [*KEY, "__b"])
    return cut(df.withColumn(name, best("__i", "__w")).drop("__v", "__b", "__i", "__w"))


def _folded(candidates: DataFrame, keys: list[str], woken: bool) -> DataFrame:
    """Serial selection inside each of ``keys``, over the sorted stream of a partition: one number is held, not a group.

    ``woken``: dropped rows that hide others and end beyond ``free`` are given out as well (see ``skip_ahead``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, free = None, -1
        for rows in batches:
            keep, told = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
            for k, (now, offset, size, sure) in enumerate(zip(zip(*(rows[c] for c in keys)), rows.offset, rows["size"], rows.validated)):
                first = now != key
                if first:
                    key, free = now, -1
                told[k] = free
                if offset >= free or first and offset != offset:  # an unknown place is nan
                    keep[k] = True
                    if sure:
                        end = offset + size
                        free = end if end == end else NEVER
            if woken:
                also = rows.hidden.notna().to_numpy() & (told < (rows.offset + rows["size"]).to_numpy())
                yield rows.assign(dropped=~keep, free=told)[keep | also]
            else:
                yield rows[keep]

    schema = candidates.schema if not woken else candidates.select("*", F.lit(True).alias("dropped"), F.lit(0).cast("long").alias("free")).schema
    order = [F.asc_nulls_last("ord"), F.asc_nulls_last("offset")]
    return candidates.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def woken() -> Column:
    """Rows of ``skip_ahead(..., woken=True)`` whose hidden candidates are to be walked after all."""
    return F.col("dropped") & F.col("hidden").isNotNull() & (F.col("free") < F.col("offset") + F.col("size"))


def skip_ahead(candidates: DataFrame, woken: bool = False) -> DataFrame:
    """Keep candidates in order of ``ord``; after a validated one, drop those that start before its end.

    After a validated one of unknown size all are dropped. One of unknown place comes last and is kept only if it is alone.
    Rows fall into islands that no earlier validated end reaches into; islands of one row need no fold. ``woken`` adds the
    columns ``dropped`` and ``free`` (the place from which on carving was allowed) and keeps the dropped rows for which ``woken()`` holds.
    """
    if _small(candidates):
        return _folded(candidates, KEY, woken)
    columns = candidates.columns
    end = F.when(F.col("validated") & F.col("offset").isNotNull(), F.coalesce(F.col("offset") + F.col("size"), F.lit(NEVER)))
    order = [F.col("ord"), F.col("offset")]
    df = _running(candidates, end, "__reach", order, "ord")
    df = _running(df, F.col("offset"), "__low", order, "ord", backward=True)
    head = F.when(F.col("__reach").isNull() | (F.col("__low") >= F.col("__reach")), F.col("ord"))
    df = _running(df.withColumn("__head", head), head, "__before", order, "ord")
    df = df.withColumn("island", F.coalesce("__head", "__before"))
    sizes = df.groupBy(*KEY, "island").agg(F.count(F.lit(1)).alias("__n"))
    df = df.drop("__reach", "__low", "__head", "__before").join(sizes, [*KEY, "island"])
    many = _folded(df.where("__n > 1").select(*columns, "island"), [*KEY, "island"], woken).drop("island")
    alone = df.where("__n = 1").select(*columns)
    if woken:
        alone = alone.withColumns({"dropped": F.lit(False), "free": F.lit(-1).cast("long")})
    return alone.unionByName(many)


def containment(records: DataFrame) -> DataFrame:
    """In order of (offset, size desc) drop records that end inside what earlier validated ones cover."""
    order = [F.col("offset"), F.desc("size"), F.col("ord")]
    end = F.when(F.col("validated"), F.col("offset") + F.col("size"))
    if _small(records):
        before = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        df = records.withColumn("__cover", F.max(end).over(before))
    else:
        df = _running(records, end, "__cover", order, "offset")
    return df.where("__cover is null or offset + size > __cover").drop("__cover")


def mark_duplicates(records: DataFrame, order: str = "ord") -> DataFrame:
    """Adds ``duplicate_of``: the offset of the first record with the same sha256, null for that first one.

    Null sources and digests are values like others, so no record is lost; a null place comes last.
    """
    place = F.struct(F.col(order).isNull().alias("a"), F.col(order).alias("b"), F.col("offset").isNull().alias("c"), "offset")
    first = records.groupBy(*KEY, "sha256").agg(F.min(place).alias("__first"))
    keys = [*KEY, "sha256"]
    first = first.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    df = records.join(first, same).drop(*[f"__{k}" for k in keys])
    return df.withColumn("duplicate_of", F.when(place != F.col("__first"), F.col("__first.offset"))).drop("__first")
