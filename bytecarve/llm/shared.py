"""Session plumbing shared by the operators: the shared work folder, Arrow limits, table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import remove, work_dir

__all__ = ["ARROW_BYTES", "ARROW_ROWS", "hot_keys", "limit_arrow", "materialise", "partitions_for", "remove", "salted_join", "table", "uniform", "work_dir"]

#: Upper bounds of one Arrow batch handed to Python; texts may be very long, so bytes bind first.
ARROW_ROWS = 4000
ARROW_BYTES = 8 << 20


def limit_arrow(spark: SparkSession) -> None:
    """Bound the memory of a Python worker whatever the length of single texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives executor loss."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(key, seed: int):
    """A uniform draw in (0, 1) that depends on ``key`` and ``seed`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with over 1 / HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE of them; SALTS tasks share one.
HOT_SHARE, SALTS = 1000, 32


def hot_keys(sizes: DataFrame, key: str, n: str = "n") -> list:
    """Keys of ``sizes`` (one row per key) that hold over 1 / HOT_SHARE of the sum of ``n``."""
    total = sizes.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in sizes.where(F.col(n) * HOT_SHARE > total).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, spread: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row per ``key``): rows of a hot key spread by a hash of ``spread`` over SALTS copies.

    By a shuffle at every size, since both sides grow with the corpus.
    """
    right = right.hint("merge")
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    salted = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("__salt", F.explode(copies)).hint("merge"), [key, "__salt"], how).drop("__salt")
