"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and partially aggregated minima over edges; nothing is collected but the names of hubs
(nodes with over a share of all edges, so few). A hub's edges are spread over many tasks by salt. Rounds are
cut by tables in the shared folder, so a lost executor costs one round at most; a round's tables go when the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_keys, materialise, remove, salted_join, work_dir

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, any order, repeats allowed) -> (node, root), root = least node, nodes <> root only."""
    spark = edges.sparkSession
    base = work_dir(spark, "components")
    now = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct()
    now = materialise(now, f"{base}/0")
    for k in range(1, MAX_ROUNDS):
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least = materialise(least, f"{base}/least{k}")
        large = salted_join(both, least.select("u", "m"), "u", hot_keys(least, "u"), ["v"]).where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = materialise(large, f"{base}/large{k}")
        low = materialise(large.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")), f"{base}/low{k}")
        small = salted_join(large, low.select("x", "m"), "x", hot_keys(low, "x"), ["y"])
        small = small.select(F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*").where("x <> y").distinct()
        now = materialise(small, f"{base}/{k}")
        for spent in (f"least{k}", f"large{k}", f"low{k}", str(k - 1)):
            remove(spark, f"{base}/{spent}")
        roots = now.select(F.col("y").alias("x")).distinct()
        inner = now.join(roots, "x", "left_semi").limit(1).count()
        if not inner and now.count() == now.select("x").distinct().count():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("x").alias("node"), F.col("y").alias("root"))
